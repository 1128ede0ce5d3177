"""Language identification by a linear-chain conditional random field over words.

Each word (a run of at most 32 letters, lower-cased; longer ones are cut, so that each letter counts) scores for each language
by its prefixes, suffixes, letter trigrams and, if three documents of the sample or more hold it, itself (a lexicon), hashed
into a table of fixed size; learned transitions tie neighbours together. All languages of the sample are learned. The field is fitted by AdaGrad on the conditional likelihood of sequences that join passages of several training documents,
so that switches within a text are learned too. Forward-backward gives each word's marginals over whole texts; their sum
over a text names its language, and runs of words with the same best language are its code-switched parts.

Inference is exact and vectorised: texts are cut into chunks of `CHUNK` words; products of the chunks' transfer matrices
carry the messages over the cuts, then all chunks are filled in side by side. There is no shuffle; the model (table,
lexicon, transitions) is bounded by the sample on which the driver fits it: `rows` documents of at most `max_bytes` each.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, map_texts

#: A longer run of letters, as in scripts without spaces, is successive words of at most 32 letters.
TOKEN = re.compile(r"[^\W\d_]{1,32}")
CHUNK = 64
#: Words whose scores a worker remembers.
REMEMBER = 200_000
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    rows: int = 4000
    max_bytes: int = 1 << 15
    lexicon: int = 3  # documents of the sample that hold a word of the lexicon
    table: int = 1 << 16
    sequences: int = 6000
    passage: int = 24  # words of a passage; a sequence has two
    epochs: int = 4
    batch: int = 256
    rate: float = 0.3
    seed: int = 6


def tokens(text: str) -> list[str]:
    """Words of a text; what has no letter (such as a fraction sign) is none."""
    found = TOKEN.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def features(word: str, lexicon: frozenset[str], table: int) -> list[int]:
    """Hashed features of a word."""
    w, edged = word, f"^{word}$"
    names = [f"p{w[:2]}", f"p{w[:3]}", f"s{w[-2:]}", f"s{w[-3:]}", *("t" + edged[i : i + 3] for i in range(len(edged) - 2))]
    if word in lexicon:
        names.append("w" + word)
    return [zlib.crc32(n.encode()) & (table - 1) for n in names]


@dataclass
class Field:
    languages: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray  # features x languages
    switch: np.ndarray  # log potentials of transitions
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Row of each word in self.scores, which gains rows for new words."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if self.scores is None or len(known) + len(new) > REMEMBER:
            known.clear()
            new = list(dict.fromkeys(words))
            self.scores = np.empty((0, len(self.languages)), np.float32)
        if new:
            lists = [features(w, self.lexicon, len(self.weights)) for w in new]
            starts = np.cumsum([0, *map(len, lists[:-1])])
            added = np.add.reduceat(self.weights[np.fromiter((f for x in lists for f in x), np.int64)], starts, axis=0)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, added.astype(np.float32)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of each list of words: words x languages, rows summing to one."""
        sizes = [len(t) for t in texts]
        flat = [w for t in texts for w in t]
        if not flat:
            return [np.zeros((0, len(self.languages)), np.float32) for _ in texts]
        rows = self.rows_of(flat)
        logs = self.scores[rows]
        return np.split(forward_backward(np.exp(logs - logs.max(axis=1, keepdims=True)), sizes, np.exp(self.switch).astype(np.float32)), np.cumsum(sizes)[:-1])


def forward_backward(potentials: np.ndarray, sizes: list[int], switch: np.ndarray) -> np.ndarray:
    """Marginals of chains laid end to end: potentials is positions x labels, sizes the chains' lengths."""
    n_labels = potentials.shape[1]
    lane_size, lane_first, lane_turn = [], [], []
    for n in sizes:
        for at in range(0, n, CHUNK):
            lane_size.append(min(CHUNK, n - at))
            lane_first.append(at == 0)
            lane_turn.append(at // CHUNK)
    lanes, size, first, turn = len(lane_size), np.array(lane_size), np.array(lane_first), np.array(lane_turn)
    steps = int(size.max())
    begin = np.cumsum(size) - size
    inside = np.arange(steps)[:, None] < size
    at = np.where(inside, begin + np.arange(steps)[:, None], 0)
    grid = potentials[at]  # steps x lanes x labels
    last = np.append(turn[1:] == 0, True)
    # Messages over the cuts: before each lane (row vectors) and after it (column vectors).
    ahead, behind = np.ones((lanes, n_labels), np.float32), np.ones((lanes, n_labels), np.float32)
    if not first.all():
        product = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (lanes, n_labels, n_labels)).copy()
        for t in range(steps):
            moved = product @ switch
            if t == 0:
                moved[first] = product[first]
            moved *= grid[t][:, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True)
            product = np.where(inside[t][:, None, None], moved, product)
        for k in range(1, int(turn.max()) + 1):
            now = np.flatnonzero(turn == k)
            message = np.einsum("li,lij->lj", ahead[now - 1], product[now - 1])
            ahead[now] = message / message.max(axis=1, keepdims=True)
        for k in range(int(turn.max()), 0, -1):
            now = np.flatnonzero(turn == k)
            message = np.einsum("lij,lj->li", product[now], behind[now])
            behind[now - 1] = message / message.max(axis=1, keepdims=True)
    alphas = np.empty_like(grid)
    alpha = ahead
    for t in range(steps):
        moved = alpha @ switch
        if t == 0:
            moved[first] = 1.0
        moved = moved * grid[t]
        alpha = np.where(inside[t][:, None], moved / moved.max(axis=1, keepdims=True), alpha)
        alphas[t] = alpha
    beta = behind.copy()
    beta[last] = 1.0
    out = np.empty_like(potentials)
    for t in range(steps - 1, -1, -1):
        here = inside[t]
        both = alphas[t][here] * beta[here]
        out[at[t][here]] = both / both.sum(axis=1, keepdims=True)
        moved = (grid[t] * beta) @ switch.T
        beta = np.where(here[:, None], moved / moved.max(axis=1, keepdims=True), beta)
    return out


def fit(sample: list[tuple[str, str]], settings: Settings = Settings()) -> Field:
    """A field over the languages of the sample; without any, one that knows `und` alone."""
    s, rnd = settings, random.Random(settings.seed)
    languages = sorted({lang for _, lang in sample}) or [UNDETERMINED]
    number = {lang: i for i, lang in enumerate(languages)}
    texts = [(words, number[lang]) for text, lang in sample if (words := tokens(text))]
    held: Counter = Counter()
    for words, _ in texts:
        held.update(set(words))
    lexicon = frozenset(w for w, n in held.items() if n >= s.lexicon)
    n = len(languages)
    weights, switch = np.zeros((s.table, n), np.float32), np.eye(n, dtype=np.float32) * 2
    if n == 1 or not texts:
        return Field(languages, lexicon, weights, switch)

    def passage() -> list[tuple[str, int]]:
        words, y = rnd.choice(texts)
        at = rnd.randrange(max(1, len(words) - s.passage + 1))
        return [(w, y) for w in words[at : at + s.passage]]

    sequences = [passage() + passage() for _ in range(s.sequences)]
    numbers: dict[str, int] = {}
    lists = []
    for seq in sequences:
        for w, _ in seq:
            if w not in numbers:
                numbers[w] = len(lists)
                lists.append(features(w, lexicon, s.table))
    width = max(map(len, lists))
    table = np.full((len(lists), width), s.table, np.int64)  # the row after the last is padding
    for i, x in enumerate(lists):
        table[i, : len(x)] = x
    big = np.zeros((s.table + 1, n), np.float32)
    seen, seen_switch = np.full_like(big, 1e-6), np.full_like(switch, 1e-6)
    for _ in range(s.epochs):
        rnd.shuffle(sequences)
        for lo in range(0, len(sequences), s.batch):
            part = sequences[lo : lo + s.batch]
            words = np.array([numbers[w] for seq in part for w, _ in seq])
            truth = np.array([y for seq in part for _, y in seq])
            sizes = [len(seq) for seq in part]
            rows = table[words]
            logs = big[rows].sum(axis=1)
            potentials = np.exp(logs - logs.max(axis=1, keepdims=True))
            moves = np.exp(switch)
            node, pair = _expectations(potentials, sizes, moves)
            error = -node
            error[np.arange(len(truth)), truth] += 1
            gradient = np.zeros_like(big)
            np.add.at(gradient, rows.ravel(), np.repeat(error, width, axis=0))
            gradient = gradient / len(part) - 1e-5 * big
            gradient[-1] = 0
            seen += gradient**2
            big += s.rate * gradient / np.sqrt(seen)
            inner = np.ones(len(truth), bool)
            inner[np.cumsum(sizes)[:-1]] = False
            inner[0] = False
            real = np.zeros((n, n), np.float32)
            np.add.at(real, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
            step = (real - pair) / len(part) - 1e-4 * switch
            seen_switch += step**2
            switch = switch + s.rate * step / np.sqrt(seen_switch)
    return Field(languages, lexicon, big[:-1].copy(), switch.astype(np.float32))


def _expectations(potentials: np.ndarray, sizes: list[int], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the positions, and the expected transitions summed over short chains that lie end to end."""
    size = np.array(sizes)
    begin, steps = np.cumsum(size) - size, int(size.max())
    inside = np.arange(steps)[:, None] < size
    at = np.where(inside, begin + np.arange(steps)[:, None], 0)
    grid = potentials[at]
    alphas = np.empty_like(grid)
    alpha = np.ones((len(size), potentials.shape[1]), potentials.dtype)
    for t in range(steps):
        moved = (alpha @ moves if t else alpha) * grid[t]
        alpha = np.where(inside[t][:, None], moved / moved.max(axis=1, keepdims=True), alpha)
        alphas[t] = alpha
    node, pair = np.empty_like(potentials), np.zeros_like(moves)
    beta = np.ones_like(alpha)
    for t in range(steps - 1, -1, -1):
        here = inside[t]
        both = alphas[t][here] * beta[here]
        node[at[t][here]] = both / both.sum(axis=1, keepdims=True)
        right = grid[t] * beta
        if t:
            left = alphas[t - 1][here]
            joint = left[:, :, None] * moves[None] * right[here][:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = right @ moves.T
        beta = np.where(here[:, None], moved / moved.max(axis=1, keepdims=True), beta)
    return node, pair


def train(docs: DataFrame, label: str = "lang", mod: int = 4, held: int = 2, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fits on documents with a language whose fold isn't the held-out one."""
    use = crc_fold(F.col(id_col), mod) != held
    return fit(labelled_sample(docs, docs.select(id_col, label), label, use, settings.rows, settings.max_bytes, id_col, text_col), settings)


def identify(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score in [0, 1] (the language's mean marginal) of every row's whole text; `und` and 0 for a text without letters or null.

    Null ids and repeated rows stay; other columns aren't read; an empty table gives an empty result.
    """

    def score(texts: list[str]) -> dict:
        found = model.marginals([tokens(t) for t in texts])
        sums = [m.mean(axis=0, dtype=np.float64) if len(m) else None for m in found]
        best = [(UNDETERMINED, 0.0) if s is None else (model.languages[int(s.argmax())], min(1.0, float(s.max()))) for s in sums]
        return {"lang_pred": pa.array([b[0] for b in best], pa.string()), "score": pa.array([b[1] for b in best], pa.float64())}

    return map_texts(docs, [id_col], text_col, "lang_pred string, score double", score, slice_bytes=4 << 20)


def runs(text: str, model: Field) -> list[tuple[int, int, str]]:
    """Code-switched parts of a text: (begin, end, language) in code points of runs of words whose best language is the same."""
    return next(_runs([text], model))


def _runs(texts: list[str], model: Field) -> Iterator[list[tuple[int, int, str]]]:
    places = [[m for m in TOKEN.finditer(t) if any(c.isalpha() for c in m[0])] for t in texts]
    for found, marks in zip(places, model.marginals([[m[0].lower() for m in p] for p in places]), strict=True):
        out: list[tuple[int, int, str]] = []
        for m, best in zip(found, marks.argmax(axis=1).tolist(), strict=True):
            lang = model.languages[best]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], m.end(), lang)
            else:
                out.append((m.start(), m.end(), lang))
        yield out


def label_runs(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs: array<struct<begin, end, lang>> of every row's text, as runs() gives them; empty without words, as in null texts.

    Null ids and repeated rows stay; an empty table gives an empty result. Other columns aren't read.
    """
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def score(texts: list[str]) -> dict:
        return {"runs": pa.array([[{"begin": a, "end": b, "lang": x} for a, b, x in r] for r in _runs(texts, model)], kind)}

    return map_texts(docs, [id_col], text_col, "runs array<struct<begin:bigint,end:bigint,lang:string>>", score, slice_bytes=4 << 20)


def op6_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
