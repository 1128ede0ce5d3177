"""Secret scans by one combined deterministic automaton over bytes.

Rule patterns are parsed, turned into one nondeterministic automaton, made deterministic by subset construction and
minimised; the result is an array of transitions over (state, byte). One pass over the bytes runs all rules: a batch of
texts becomes one stream (0xFF, which UTF-8 never holds, separates texts and resets the automaton), cut into lanes that
numpy steps together; a lane that began in the wrong state is corrected until both runs agree, so cuts change nothing.
State 0 means that no rule has anything begun. No match crosses it, so exact spans (leftmost, longest, non-overlapping
within a kind) are worked out only in the stretches between two such places that hold an accepting state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, release, slices

RESET = 0xFF


@dataclass(frozen=True)
class Rule:
    """A kind of secret: head then body; a match whose body has fewer than min_body bytes is dropped, after it has consumed its text.

    apart: the pass over the bytes seeks the head alone, which keeps its automaton small; the body is worked out from there on.
    """

    kind: str
    head: str
    body: str
    min_body: int = 1
    apart: bool = False


#: The base rules in their fixed order, then the rules that this method adds.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]{8,}", 24),  # 8 here keeps the automaton small; the 24 hold through min_body
)
#: Of a private key: header lines, then base64 up to the closing line; where that is missing, its runs of base64 with 16 characters or more. \\ is for line ends written as \\n.
PEM = r"(?:[\x0A\x0D]+[A-Za-z][A-Za-z0-9-]*:[\x20-\x7E]*)*(?:[A-Za-z0-9+/=\\\x09\x0A\x0D\x20]*-----END [A-Z ]*PRIVATE KEY-----|(?:[\\\x09\x0A\x0D\x20]+[A-Za-z0-9+/=]{16,})*)"
ADDED = (
    Rule("github", r"gh[opsur]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 20),
    Rule("github_fine", r"github_pat_", r"[A-Za-z0-9_]+", 22, True),
    Rule("gitlab", r"glpat-", r"[A-Za-z0-9_-]+", 20, True),
    Rule("stripe", r"[rs]k_(?:live|test)_", r"[A-Za-z0-9]+", 16, True),
    Rule("npm", r"npm_", r"[A-Za-z0-9]+", 36, True),
    Rule("pypi", r"pypi-", r"[A-Za-z0-9_-]+", 50, True),
    Rule("sendgrid", r"SG[.]", r"[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 39, True),
    Rule("hub", r"hf_", r"[A-Za-z0-9]+", 30, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", PEM, 0, True),
)


class Pattern:
    """Parser of a subset of regular expressions into a nondeterministic automaton over bytes.

    Literals (ASCII), \\xHH and escaped characters, [classes] with ranges and ^, groups ( ), (?: ) and (?i: ), |, and the
    repeats ?, *, +, {m}, {m,} and {m,n}.
    """

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, source: str) -> tuple[int, int]:
        """Start and end state of the pattern."""
        self.s, self.i, self.fold = source, 0, False
        begin, end = self.build(self.alternation())
        if self.i != len(source):
            raise ValueError(f"unexpected {source[self.i]!r} at {self.i} of {source!r}")
        return begin, end

    def alternation(self):
        parts = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence())
        return ("or", parts)

    def sequence(self):
        items = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            items.append(self.repeat(self.atom()))
        return ("then", items)

    def repeat(self, item):
        c = self.s[self.i : self.i + 1]
        if c and c in "?*+":
            self.i += 1
            return ("times", item, {"?": 0, "*": 0, "+": 1}[c], 1 if c == "?" else None)
        if c == "{":
            close = self.s.index("}", self.i)
            low, comma, high = self.s[self.i + 1 : close].partition(",")
            self.i = close + 1
            return ("times", item, int(low), (int(high) if high else None) if comma else int(low))
        return item

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            before = self.fold
            self.i += 1
            for mark, fold in (("?i:", True), ("?:", before)):
                if self.s.startswith(mark, self.i):
                    self.i, self.fold = self.i + len(mark), fold
                    break
            inner = self.alternation()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"no closing bracket in {self.s!r}")
            self.i, self.fold = self.i + 1, before
            return inner
        if c == "[":
            return ("one", self.char_class())
        return ("one", self.folded({self.char()}))

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError(f"only ASCII patterns are known, not {c!r}")
        return ord(c)

    def char_class(self) -> frozenset[int]:
        self.i += 1
        negated = self.s[self.i] == "^"
        self.i += negated
        found: set[int] = set()
        while self.s[self.i] != "]":
            low = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.char() + 1))
            else:
                found.add(low)
        self.i += 1
        return self.folded(set(range(RESET)) - found if negated else found)

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(chr(b).swapcase()) for b in found if chr(b).isalpha() and b < 128}
        return frozenset(found)

    def build(self, node) -> tuple[int, int]:
        if node[0] == "one":
            a, b = self.state(), self.state()
            self.edges[a].append((node[1], b))
            return a, b
        if node[0] == "then":
            a = b = self.state()
            for item in node[1]:
                c, d = self.build(item)
                self.free[b].append(c)
                b = d
            return a, b
        if node[0] == "or":
            a, b = self.state(), self.state()
            for item in node[1]:
                c, d = self.build(item)
                self.free[a].append(c)
                self.free[d].append(b)
            return a, b
        _, item, low, high = node
        a = b = self.state()
        for _ in range(low):
            c, d = self.build(item)
            self.free[b].append(c)
            b = d
        if high is None:
            c, d = self.build(item)
            self.free[b].append(c)
            self.free[d].append(c)
            end = self.state()
            self.free[b].append(end)
            self.free[d].append(end)
            return a, end
        end = self.state()
        self.free[b].append(end)
        for _ in range(high - low):
            c, d = self.build(item)
            self.free[b].append(c)
            b = d
            self.free[b].append(end)
        return a, end


@dataclass
class Automaton:
    """next[state << 8 | byte]; state 0 is the start. accepts[state] has a bit per rule. dead: the state that nothing leaves, or -1."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int

    def __len__(self) -> int:
        return len(self.accepts)


def compile_rules(patterns: list[str], anywhere: bool) -> Automaton:
    """The minimal deterministic automaton of all patterns together; anywhere: matches may begin at any byte, else at the first."""
    if len(patterns) > 63:
        raise ValueError("an automaton holds 63 rules at most; scan with several")
    nfa = Pattern()
    begins, ends = [], {}
    for k, source in enumerate(patterns):
        a, b = nfa.add(source)
        begins.append(a)
        ends[b] = ends.get(b, 0) | 1 << k

    def closure(states) -> frozenset[int]:
        found, queue = set(states), list(states)
        while queue:
            for x in nfa.free[queue.pop()]:
                if x not in found:
                    found.add(x)
                    queue.append(x)
        return frozenset(x for x in found if nfa.edges[x] or x in ends)

    classes: dict[tuple, list[int]] = {}  # bytes that no edge tells apart
    sets = list({s for row in nfa.edges for s, _ in row})
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sets), []).append(b)
    start = closure(begins)
    number, order, rows = {start: 0}, [start], []
    for now in order:  # grows while it runs
        row = np.zeros(256, np.int64)
        for members in classes.values():
            to = closure([t for x in now for s, t in nfa.edges[x] if members[0] in s])
            to = (to | start) if anywhere else to
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row[members] = number[to]
        row[RESET] = 0 if anywhere else row[RESET]
        rows.append(row)
    table = np.array(rows)
    mask = np.array([_either(s, ends) for s in order], dtype=np.int64)
    return minimised(table, mask)


def _either(states, ends) -> int:
    out = 0
    for x in states:
        out |= ends.get(x, 0)
    return out


def minimised(table: np.ndarray, mask: np.ndarray) -> Automaton:
    """Merges states that no input tells apart (Moore's refinement), the start keeping number 0."""
    if mask[0]:
        raise ValueError("a pattern matches the empty text")
    block = np.unique(mask, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    firsts = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
    order = np.argsort(firsts, kind="stable")  # the start is the first state, hence in the first block
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    accepts, new = mask[firsts[order]], rank[block[table[firsts[order]]]]
    last = np.argsort(accepts > 0, kind="stable")  # states that accept come last: one comparison finds them
    back = np.empty(len(last), np.int64)
    back[last] = np.arange(len(last))
    new, accepts = back[new[last]], accepts[last]
    dead = [i for i in range(len(new)) if not accepts[i] and (new[i] == i).all()]
    return Automaton(new.astype(np.int32).ravel(), accepts, dead[0] if dead else -1)


class Scanner:
    """All rules as one automaton for the pass over the bytes, and one anchored automaton a rule for the spans."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = compile_rules([r.head if r.apart else r.head + r.body for r in rules], anywhere=True)
        self.apart = sum(1 << k for k, r in enumerate(rules) if r.apart)
        self.first_hit = int(np.argmax(self.all.accepts > 0))
        self.table = self.all.next.astype(np.uint16 if len(self.all) <= 1 << 16 else np.uint32)
        self.own = []
        for r in rules:
            full, head = compile_rules([r.head + r.body], anywhere=False), compile_rules([r.head], anywhere=False) if r.head else None
            begins = frozenset(b for b in range(256) if full.next[b] != full.dead)
            self.own.append((full.next.tolist(), full.accepts.tolist(), full.dead, begins, head and (head.next.tolist(), head.accepts.tolist(), head.dead)))

    def spans(self, texts: list[bytes], lanes: int = 4096) -> list[list[tuple[int, int, int]]]:
        """(rule, begin, end) in bytes of each text, by begin, then rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        stream = np.frombuffer(b"\xff".join([b"", *texts, b""]), np.uint8)
        steps = max(64, -(-len(stream) // lanes))
        lanes = -(-len(stream) // steps)
        grid = np.full(lanes * steps, RESET, np.uint8)
        grid[: len(stream)] = stream
        columns = np.ascontiguousarray(grid.reshape(lanes, steps).T).astype(np.uint32)
        states, now, table = np.empty((steps, lanes), self.table.dtype), np.zeros(lanes, np.uint32), self.table
        for j in range(steps):
            now = table[now << 8 | columns[j]].astype(np.uint32)
            states[j] = now
        for w in np.flatnonzero(states[-1][:-1]).tolist():  # lanes that did not begin in state 0
            s, w = int(states[-1, w]), w + 1
            for j in range(steps):
                s = int(table[s << 8 | int(columns[j, w])])
                if s == states[j, w]:
                    break
                states[j, w] = s
            else:
                if w + 1 < lanes and s:
                    self._carry(states, columns, w + 1, s)
        line = states.T.reshape(-1)
        hits = np.flatnonzero(line >= self.first_hit)
        if not len(hits):
            return found
        starts = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
        done, met = 0, {}
        for hit in hits.tolist():
            if hit < done:
                continue
            low, high = hit, hit + 1
            while line[low - 1]:
                low -= 1
            while line[high]:
                high += 1
            done = high
            rules = int(np.bitwise_or.reduce(self.all.accepts[line[low:high]]))
            d = int(np.searchsorted(starts, low, side="right")) - 1
            at = low - int(starts[d])
            found[d] += [(k, a + at, b + at) for k, a, b in self.exact(texts[d][at : high - int(starts[d])], rules & ~self.apart)]
            if new := rules & self.apart & ~met.get(d, 0):  # these may go on beyond the stretch: once for all the rest of the text
                met[d] = met.get(d, 0) | new
                found[d] += [(k, a + at, b + at) for k, a, b in self.exact(texts[d][at:], new)]
        for x in found:
            x.sort(key=lambda y: (y[1], y[0]))
        return found

    def _carry(self, states, columns, w: int, s: int) -> None:
        """A stretch longer than a lane: goes on through the lanes until both runs agree."""
        for lane in range(w, columns.shape[1]):
            for j in range(columns.shape[0]):
                s = int(self.table[s << 8 | int(columns[j, lane])])
                if s == states[j, lane]:
                    return
                states[j, lane] = s

    def exact(self, text: bytes, rules: int) -> Iterator[tuple[int, int, int]]:
        """Leftmost, longest, non-overlapping matches of each of the rules (bits) in a stretch; those with a short body are dropped."""
        for k, (table, accepts, dead, begins, head) in enumerate(self.own):
            at = 0
            while rules >> k & 1 and at < len(text):
                if text[at] not in begins or (end := longest(table, accepts, dead, text, at)) <= at:
                    at += 1
                    continue
                body = end - (longest(*head, text, at) if head else at)
                if body >= self.rules[k].min_body:
                    yield k, at, end
                at = end


@lru_cache(4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def longest(table: list[int], accepts: list[int], dead: int, text: bytes, at: int) -> int:
    """End of the longest match that begins at `at`, or -1."""
    s, end = 0, -1
    for i in range(at, len(text)):
        s = table[s << 8 | text[i]]
        if s == dead:
            break
        if accepts[s]:
            end = i + 1
    return end


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (and the columns in `keep`), spans: array<struct<kind, begin, end>> in code points, end exclusive, by begin, then rule order.

    Null and empty texts have no spans, whatever else is null. Rows stay as they are, repeats included; an empty table gives
    an empty result. Columns outside id_col and keep aren't read. A text of any length is scanned whole.
    """
    scanner = scanner_of(rules)
    kinds = [r.kind for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def score(texts: list[str]) -> dict:
        raw = [t.encode() for t in texts]
        out = []
        for text, data, spans in zip(texts, raw, scanner.spans(raw), strict=True):
            if spans and len(text) != len(data):
                points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                place = lambda i, p=points: int(p[i - 1]) if i else 0
                spans = [(k, place(a), place(b)) for k, a, b in spans]
            out.append([{"kind": kinds[k], "begin": a, "end": b} for k, a, b in spans])
        return {"spans": pa.array(out, kind)}

    return map_texts(docs, [id_col, *(keep or [])], text_col, "spans array<struct<kind:string,begin:bigint,end:bigint>>", score)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Docs with every secret in the text replaced by `mark`, overlapping ones by one mark; texts without secrets, nulls included, stay as they are.

    All columns pass through (n_chars too, which then counts the old text); only the text column, found by its place, is rewritten,
    a few MB of text at a time. Rows with null ids and repeated rows stay; an empty table gives an empty result.
    """
    scanner, place, stamp = scanner_of(rules), docs.columns.index(text_col), mark.encode()

    def clean(data: bytes, spans: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for _, a, b in spans:
            if a >= at:
                parts += [data[at:a], stamp]
            at = max(at, b)
        return b"".join([*parts, data[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("")
        for batch in batches:
            for lo, hi in slices(batch.column(place), 2 << 20):
                part = batch.slice(lo, hi - lo)
                texts = part.column(place).to_pylist()
                found = scanner.spans([(t or "").encode() for t in texts])
                if any(found):
                    fixed = [clean(t.encode(), s) if s else t for t, s in zip(texts, found, strict=True)]
                    columns = [pa.array(fixed, part.schema.field(i).type) if i == place else c for i, c in enumerate(part.columns)]
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part
        release("")

    return docs.mapInArrow(run, docs.schema)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle(rules: tuple[Rule, ...] = BASE + ADDED) -> str:
    """The query in SQL: each rule marks its matches in the text; where a match begins, the lengths of what is before it tell."""

    def plain(pattern: str) -> str:  # letters in either case as classes, for ASCII alone
        return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern).replace("'", "''")

    found = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{rule.kind}' AS kind, {rule.min_body} AS least, '^(?:{plain(rule.head)})' AS head, string_split(regexp_replace(t, '(?:{plain(rule.head)})(?:{plain(rule.body)})', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS c FROM d WHERE regexp_matches(t, '(?:{plain(rule.head)})(?:{plain(rule.body)})')"
        for k, rule in enumerate(rules)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
    u AS (SELECT *, unnest(range(2, len(c) + 1)) AS i FROM f),
    m AS (SELECT r, k, kind, least, head, split_part(c[i], chr(2), 1) AS s, list_sum(list_transform(c[1:i - 1], lambda x: length(replace(x, chr(2), ''))))::BIGINT AS b FROM u),
    x AS (SELECT r, k, kind, b, kind || ':' || b || ':' || (b + length(s)) AS span FROM m WHERE length(s) - CASE WHEN head = '^(?:)' THEN 0 ELSE length(regexp_extract(s, head)) END >= least),
    g AS (SELECT r, {sums}, string_agg(span, ',' ORDER BY b, k) AS spans, string_agg(span, ',' ORDER BY b, k) FILTER (WHERE kind IN ({base})) AS base FROM x GROUP BY r)
    SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


ORACLE_SQL = _oracle()
