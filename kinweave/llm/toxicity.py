"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens (runs of letters, lower-cased) and their first letters (three to seven, for inflected languages) get the log-odds
ratio of toxic against clean labelled texts, by the texts that hold them, under an informative Dirichlet prior (Monroe,
Colaresi and Quinn, "Fightin' words", 2008). A token scores as the longest of these units that enough labelled texts
hold; one whose unit isn't significant costs a fixed amount.
All maximal segments of a text are found in linear time (Ruzzo and Tompa, 1999). Their scores are calibrated by the
extreme-value law of Karlin and Altschul (1990): a segment of score S in a text of n tokens has E = K n exp(-lambda S)
by chance, with lambda and K from clean texts; segments with E under `significance` are toxic passages. A logistic
regression on the evidence -ln E of the best segment and of the best segments together gives the score.

The model is fitted on the driver on a bounded sample (`rows` labelled texts of at most `max_bytes` each, which bounds it);
all significant units are sent to the executors. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, logistic, map_texts, sigmoid

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the prefixes that count as units beside the whole token.
PREFIXES = range(3, 8)
#: Tokens whose scores a worker remembers.
REMEMBER = 300_000


def units(token: str) -> list[str]:
    """The token and its prefixes, the longest first."""
    return [token, *(token[:k] + "*" for k in reversed(PREFIXES) if k <= len(token))]


@dataclass(frozen=True)
class Settings:
    rows: int = 6000
    max_bytes: int = 1 << 15
    prior: float = 0.2  # the prior's weight, as a share of the sample's tokens
    least_z: float = 3.4
    known_in: int = 5  # labelled texts that must hold a unit for it to count without being significant
    gap: float = 0.3  # what a token without significance costs
    significance: float = 0.01


@dataclass(frozen=True)
class Model:
    odds: dict[str, float | None]  # by unit; None: well known and not significant
    lam: float
    log_k: float
    weights: tuple[float, float, float]
    settings: Settings
    known: dict[str, float | None] = field(default_factory=dict, repr=False, compare=False)

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments (first token, end token, score) of positive score, and the number of tokens; a token that repeats the one before scores nothing.

        Texts overwritten by one repeated word are junk whatever the word; on sf0.1 counting repeats in whole or discounted finds
        fewer toxic documents (README).
        """
        found = TOKEN.findall(text.lower())
        known = self.scores(found)
        runs = [(i, x) for i, x in enumerate(map(known.__getitem__, found)) if x is not None and (not i or found[i] != found[i - 1])]
        return segments(runs, self.settings.gap), len(found)

    def scores(self, tokens: list[str]) -> dict[str, float | None]:
        known, odds = self.known, self.odds
        if len(known) > REMEMBER:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = next((odds[u] for u in units(token) if u in odds), None)
        return known

    def evidence(self, text: str) -> tuple[float, float]:
        """-ln E of the best segment, at least 0, and that of the best r segments together, for the best r (Karlin and Altschul's sum statistic, 1993)."""
        found, n = self.passages(text)
        logs = np.sort([max(0.0, self.lam * s - self.log_k - np.log(n)) for _, _, s in found] or [0.0])[::-1]
        return float(logs[0]), float(logs.sum() + sum(np.log(np.arange(1, np.count_nonzero(logs) + 1))))

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(np.array([self.evidence(t) for t in texts], float).reshape(-1, 2))
        return sigmoid(x @ np.array(self.weights[:2]) + self.weights[2])


def segments(runs: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a sequence whose tokens cost `gap` but for those in runs: (place, score).

    Ruzzo and Tompa's algorithm over the candidates only, each with the cumulative sums before (l) and after (r) it; linear.
    """
    stack: list[list] = []  # begin, end, l, r, and the last candidate before with a smaller l
    total, last = 0.0, 0
    for place, score in runs:
        total -= gap * (place - last)
        last = place + 1
        low, total = total, total + score
        if score <= 0:
            continue
        new = [place, place + 1, low, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - l) for b, e, l, r, _ in stack]


def log_odds(toxic: Counter, clean: Counter, s: Settings) -> dict[str, float | None]:
    """Log-odds ratios of the significant units; and None for each unit of at least `known_in` texts that extends one of these."""
    n_t, n_c = sum(toxic.values()), sum(clean.values())
    if not n_t or not n_c:
        return {}
    words = list(toxic | clean)
    a, b = (np.array([c[w] for w in words], float) for c in (toxic, clean))
    prior = s.prior * (a + b)
    whole = prior.sum()
    delta = np.log((a + prior) / (n_t + whole - a - prior)) - np.log((b + prior) / (n_c + whole - b - prior))
    z = delta / np.sqrt(1 / (a + prior) + 1 / (b + prior))
    found: dict[str, float | None] = {words[i]: float(delta[i]) for i in np.flatnonzero(np.abs(z) >= s.least_z).tolist()}
    often = ((w, n) for w, n in zip(words, (a + b).tolist(), strict=True) if n >= s.known_in and w not in found)
    return found | {w: None for w, n in often if any(u in found for u in units(w.rstrip("*"))[1:])}


def fit(sample: list[tuple[str, int]], settings: Settings = Settings()) -> Model:
    """The whole sample gives the log-odds; lambda, K and the calibration come from each half under the other half's log-odds.

    Without both labels in both halves the score is the share of label 1.
    """
    share = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
    flat = (0.0, 0.0, float(np.log(share / (1 - share))))
    counts = [{y: Counter() for y in (0, 1)} for _ in range(2)]
    for i, (text, y) in enumerate(sample):
        counts[i % 2][y].update({u for token in set(TOKEN.findall(text.lower())) for u in units(token)})
    odds = log_odds(counts[0][1] + counts[1][1], counts[0][0] + counts[1][0], settings)
    if not odds:
        return Model({}, 1.0, 0.0, flat, settings)
    bare = [Model(log_odds(c[1], c[0], settings), 1.0, 0.0, flat, settings) for c in counts[::-1]]
    scores, n, clean = Counter(), 0, []
    for i, (text, y) in enumerate(sample):
        if not y:
            found = TOKEN.findall(text.lower())
            n += len(found)
            known = bare[i % 2].scores(found)
            scores.update(x for x in map(known.__getitem__, found) if x is not None)
            clean.append((bare[i % 2], text))
    scores[max(x for x in odds.values() if x is not None)] += 0
    lam = karlin_lambda({s: (c + 0.5) / (n + 1) for s, c in scores.items()}, settings.gap)
    total = 0.0
    for model, text in clean:
        found, size = model.passages(text)
        total += size * np.exp(-lam * max((s for *_, s in found), default=0.0))
    log_k = min(0.0, float(np.log(max(len(clean), 1) / max(total, 1e-9))))
    halves = [Model(m.odds, lam, log_k, flat, settings) for m in bare]
    x = np.log1p(np.array([halves[i % 2].evidence(t) for i, (t, _) in enumerate(sample)]))
    weights = logistic(x, np.array([y for _, y in sample], float), l2=0.1)
    return Model(odds, lam, log_k, tuple(map(float, weights)), settings)


def karlin_lambda(shares: dict[float, float], gap: float) -> float:
    """The positive root of sum of share * exp(lambda * score) = 1, where all further tokens cost `gap`."""
    x, p = np.array([*shares, -gap]), np.array([*shares.values(), max(0.0, 1 - sum(shares.values()))])
    value = lambda lam: float((p * np.exp(lam * x)).sum() - 1)
    low, high = 1e-6, 1e-3
    if value(low) > 0:  # the mean score isn't negative
        return 1e-3
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, held: int = 1, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled documents whose fold isn't the held-out one. Of repeated label rows the greatest label counts."""
    return fit(labelled_sample(docs, labels, label, crc_fold(F.col(id_col), mod) != held, settings.rows, settings.max_bytes, id_col, text_col), settings)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score in [0, 1], passages: array<struct<begin, end, score>> (tokens, end exclusive) of the significant segments of every row's whole text.

    Null counts as empty; an empty text has no passage and gets the score of no evidence. Null ids and repeated rows stay, an
    empty table gives an empty result, equal texts get equal scores. Other columns aren't read.
    """
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    cost = -float(np.log(model.settings.significance))

    def score(texts: list[str]) -> dict:
        rows = []
        for t in texts:
            found, n = model.passages(t)
            rows.append([{"begin": b, "end": e, "score": s} for b, e, s in found if model.lam * s - model.log_k - np.log(n) >= cost])
        return {"score": pa.array(model.score(texts), pa.float64()), "passages": pa.array(rows, kind)}

    return map_texts(docs, [id_col], text_col, "score double, passages array<struct<begin:bigint,end:bigint,score:double>>", score)


def op4_toxicity_segments(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
