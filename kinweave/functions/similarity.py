"""String similarities. Those that SQL has stay in the JVM; the others run as Arrow functions, all that a caller wants in one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, let


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit per character of a (Hyyro, 2004)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """1 less the insertions and deletions from a to b over both lengths; two empty texts are alike."""
    total = len(a) + len(b)
    return 2 * common_length(a, b) / total if total else 1.0


def _windows(a: str, b: str, best: float, edges: bool) -> float:
    """The greatest of best and indel() of a with the stretches of b of a's length and, at both ends, shorter ones; with edges, of those that a letter of a bounds.

    A stretch is looked at only if the letters in common, whatever their order, allow more than the best so far: exact.
    """
    n, m = len(a), len(b)
    places: dict[str, int] = {}
    left: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
        left[c] = left.get(c, 0) + 1
    common, bounds = 0, []
    for i in range(1 - n, m):
        if i + n <= m:  # a letter comes in
            c = b[i + n - 1]
            if c in left:
                left[c] -= 1
                common += left[c] >= 0
        if i > 0:  # one goes
            c = b[i - 1]
            if c in left:
                left[c] += 1
                common -= left[c] > 0
        lo, hi = max(0, i), min(i + n, m)
        if not edges or (b[hi - 1] if i <= 0 else b[lo]) in places or 0 <= i <= m - n and b[hi - 1] in places:
            bound = 2 * common / (n + hi - lo)
            if bound > best:
                bounds.append((bound, lo, hi))
    full = (1 << n) - 1
    for bound, lo, hi in sorted(bounds, reverse=True):
        if bound <= best:
            break
        row = full
        for c in b[lo:hi]:
            hit = row & places.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        best = max(best, 2 * (n - row.bit_count()) / (n + hi - lo))
    return best


def partial(a: str, b: str) -> float:
    """The best indel() of the shorter text with a stretch of the longer: all of its length, and shorter ones at both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    if a in b:
        return 1.0
    best = _windows(a, b, 0.0, True)
    return _windows(b, a, best, False) if len(a) == len(b) else best


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best indel() between the common words, and these with either text's further words; 0 if either has none, 1 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 1.0
    more_x, more_y = " ".join(sorted(x - both)), " ".join(sorted(y - both))
    common = len(" ".join(sorted(both)))
    gap = int(common > 0)
    len_x, len_y = common + gap + len(more_x), common + gap + len(more_y)
    apart = len(more_x) + len(more_y) - 2 * common_length(more_x, more_y)
    best = 1 - apart / (len_x + len_y)
    if common:
        best = max(best, 1 - (gap + len(more_x)) / (common + len_x), 1 - (gap + len(more_y)) / (common + len_y))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity with Winkler's bonus of 0.1 for each of the first four letters in common, where it is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def alias_best(a: list[str], b: list[str]) -> float:
    """Best token_set() over two lists of names."""
    return max((token_set(x, y) for x in a for y in b), default=0.0)


#: Letters of the shorter of two texts whose places fit a word; entries of a table of places.
WORD_BITS, TABLE = 64, 1 << 18


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, one after the other; lengths)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _padded(codes: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """Places x texts."""
    out = np.full((int(lengths.max()), len(lengths)), pad, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths), owner] = codes
    return out


def common_lengths(pairs: list[tuple[str, str]]) -> list[int]:
    """common_length() of each pair, all at once: a machine word per pair, a step per letter of the longest text."""
    out = [0] * len(pairs)
    turn = []
    for i, (a, b) in enumerate(pairs):
        if min(len(a), len(b)) > WORD_BITS:
            out[i] = common_length(a, b)
        elif a and b:
            turn.append((max(len(a), len(b)), i))
    turn.sort()
    lo = 0
    while lo < len(turn):
        at = [i for _, i in turn[lo : lo + 2048]]
        (x, nx), (y, ny) = _coded([min(pairs[i], key=len) for i in at]), _coded([max(reversed(pairs[i]), key=len) for i in at])
        both = np.concatenate([x, y])
        seen = np.zeros(int(both.max()) + 1, bool)
        seen[both] = True
        number = np.cumsum(seen) - 1
        k, n = int(number[-1]) + 3, len(at)
        if n * k > TABLE and n > 1:  # many letters: fewer pairs at once
            n = max(1, TABLE // k)
            at = at[:n]
            x, y, nx, ny = x[: nx[:n].sum()], y[: ny[:n].sum()], nx[:n], ny[:n]
        left, right = _padded(number[x], nx, k - 1), _padded(number[y], ny, k - 2)
        base = np.arange(n) * k
        table = np.zeros(n * k, np.uint64)
        for i, codes in enumerate(left):
            table[base + codes] |= np.uint64(1 << i)
        full = np.where(nx < WORD_BITS, (np.uint64(1) << (nx % WORD_BITS).astype(np.uint64)) - np.uint64(1), np.uint64(2**WORD_BITS - 1))
        row = full.copy()
        for codes in right:
            hit = row & table[base + codes]
            row = ((row + hit) | (row - hit)) & full
        for i, found in zip(at, (nx - np.bitwise_count(row)).tolist(), strict=True):
            out[i] = found
        lo += n
    return out


def indel_many(pairs: list[tuple[str, str]]) -> list[float]:
    """indel() of each pair."""
    return [2 * n / (len(a) + len(b)) if a or b else 1.0 for (a, b), n in zip(pairs, common_lengths(pairs), strict=True)]


def token_sort_many(pairs: list[tuple[str, str]]) -> list[float]:
    """token_sort() of each pair; a text that is in several is sorted once."""
    line = {t: " ".join(sorted(t.split())) for t in {t for p in pairs for t in p}}
    return indel_many([(line[a], line[b]) for a, b in pairs])


def token_set_many(pairs: list[tuple[str, str]]) -> list[float]:
    """token_set() of each pair; a text that is in several is split once."""
    words = {t: dict.fromkeys(sorted(set(t.split()))) for t in {t for p in pairs for t in p}}
    out = [0.0] * len(pairs)
    asked, rest = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = words[a], words[b]
        if x and y:
            both = x.keys() & y.keys()
            if both and len(both) in (len(x), len(y)):
                out[i] = 1.0
            else:
                asked.append((i, sum(map(len, both)) + max(len(both) - 1, 0)))
                rest.append((" ".join([w for w in x if w not in both]), " ".join([w for w in y if w not in both])))
    for (i, common), (x, y), n in zip(asked, rest, common_lengths(rest), strict=True):
        gap = int(common > 0)
        len_x, len_y = common + gap + len(x), common + gap + len(y)
        best = 1 - (len(x) + len(y) - 2 * n) / (len_x + len_y)
        if common:
            best = max(best, 1 - (gap + len(x)) / (common + len_x), 1 - (gap + len(y)) / (common + len_y))
        out[i] = best
    return out


MEASURES: dict[str, Callable] = {"indel": indel, "partial": partial, "token_sort": token_sort, "token_set": token_set, "jaro_winkler": jaro_winkler, "alias_best": alias_best}
#: Those that are computed for all pairs of a batch at once.
MANY: dict[str, Callable] = {"indel": indel_many, "token_sort": token_sort_many, "token_set": token_set_many}


def measures(wanted: dict[str, tuple[str, Column | str, Column | str]]) -> Column:
    """struct of doubles: for each name in wanted, the measure of two columns. One Arrow pass computes all; equal column pairs travel once."""
    sides: list[Column] = []
    places: dict[str, int] = {}

    def place(c: Column | str) -> int:
        key = c if isinstance(c, str) else str(c)
        if key not in places:
            places[key] = len(sides)
            sides.append(col(c))
        return places[key]

    plan = [(name, kind, place(a), place(b)) for name, (kind, a, b) in wanted.items()]

    def run(*columns: pd.Series) -> pd.DataFrame:
        lists = [c.tolist() for c in columns]

        def values(kind: str, xs: list, ys: list) -> list[float]:
            if kind == "alias_best":
                return [alias_best(x if x is not None else [], y if y is not None else []) for x, y in zip(xs, ys, strict=True)]
            pairs = [(x if isinstance(x, str) else "", y if isinstance(y, str) else "") for x, y in zip(xs, ys, strict=True)]
            asked = list(dict.fromkeys(pairs))
            found = dict(zip(asked, MANY[kind](asked) if kind in MANY else [MEASURES[kind](*p) for p in asked], strict=True))
            return [found[p] for p in pairs]

        return pd.DataFrame({name: values(kind, lists[i], lists[j]) for name, kind, i, j in plan}, dtype="float64")

    return F.pandas_udf(run, ", ".join(f"{name} double" for name in wanted))(*sides)


def measure(kind: str, a: Column | str, b: Column | str) -> Column:
    return measures({"x": (kind, a, b)})["x"]


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the longer length; two empty texts are alike."""
    x, y = col(a), col(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def tri_state(a: Column | str, b: Column | str) -> Column:
    """0 if either is empty, 1 if they are equal, else -1."""
    x, y = col(a), col(b)
    return F.when((x == "") | (y == ""), 0).when(x == y, 1).otherwise(-1)


def coded(a: Column | str) -> Column:
    """Tokens with their weights, array<struct<w, idf>>, as strings: sets of strings meet by hash, those of structs don't. Done once a record, pairs need not do it."""
    a = col(a)
    return F.transform(a, lambda t: F.concat_ws("\x00", t["w"], t["idf"].cast("string")))


def _weights(a: Column) -> Column:
    return F.transform(a, lambda t: F.substring_index(t, "\x00", -1).cast("double"))


def _total(a: Column) -> Column:
    return F.aggregate(_weights(a), F.lit(0.0), lambda s, x: s + x)


def _split(a: Column, b: Column, body) -> Column:
    """body(a, b, common, only a, only b) of two coded() sets, each computed once."""
    parts = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_intersect(s["a"], s["b"]).alias("i"), F.array_except(s["a"], s["b"]).alias("x"), F.array_except(s["b"], s["a"]).alias("y"))
    return let(let(F.struct(a.alias("a"), b.alias("b")), parts), lambda s: body(s["a"], s["b"], s["i"], s["x"], s["y"]))


def set_features(a: Column, b: Column) -> Column:
    """struct(contain, wjac, unexpl_a, unexpl_b) of two coded() sets of distinct tokens with weights from one table; linear.

    contain: common words over the smaller set; wjac: weight of common words over all; unexpl: weights of one side's further
    words. Where a side is empty: -1, -1, 0, 0.
    """

    def body(a, b, i, x, y):
        empty = (F.size(a) == 0) | (F.size(b) == 0)
        sums = F.struct(_total(i).alias("i"), _total(x).alias("x"), _total(y).alias("y"))
        return let(
            sums,
            lambda w: F.struct(
                F.when(empty, -1.0).otherwise(F.size(i) / F.least(F.size(a), F.size(b))).alias("contain"),
                F.when(empty, -1.0).otherwise(w["i"] / (w["i"] + w["x"] + w["y"] + 1e-9)).alias("wjac"),
                F.when(empty, 0.0).otherwise(w["x"]).alias("unexpl_a"),
                F.when(empty, 0.0).otherwise(w["y"]).alias("unexpl_b"),
            ),
        )

    return _split(a, b, body)


#: Of a word's sketch: bits of its weight, and the weight's steps.
WEIGHT_BITS, STEPS = 24, 1 << 18


def with_sketch(records: DataFrame, words: str) -> DataFrame:
    """Records with `total`, the weight of their coded() words, `most`, that of the words with positive weight, and `sketch`: a long per such word, of 40 bits of its hash and its weight rounded up. Sets of longs meet many times faster than those of strings."""
    positive = F.filter(col(words), lambda w: ~F.substring_index(w, "\x00", -1).startswith("-"))
    weight = lambda w: F.least(F.ceil(F.substring_index(w, "\x00", -1).cast("double") * STEPS), F.lit((1 << WEIGHT_BITS) - 1)).cast("long")
    return records.withColumns({"total": _total(col(words)), "most": _total(positive), "sketch": F.transform(positive, lambda w: F.shiftleft(F.xxhash64(w), WEIGHT_BITS).bitwiseOR(weight(w)))})


def likeness_within(common: Column, total_a: Column, total_b: Column) -> Column:
    """A bound from above on the likeness (weight of common words over all) of two sets whose common words weigh `common` at most, rounding included; 1 where the weights, some negative, give none."""
    return F.when(total_a + total_b > common, common / (total_a + total_b - common) + 1e-4).otherwise(1.0)


def sketched(a: Column, b: Column) -> Column:
    """A bound from above on the weight of the common words of two sketches, close to it."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1))) / STEPS


def token_evidence(a: Column, b: Column) -> Column:
    """struct(wjac, max_idf, n_shared, unexpl_min, unexpl_max, overlap, both_empty) by the older rules, of sets as in set_features()."""

    def body(a, b, i, x, y):
        empty = (F.size(a) == 0) | (F.size(b) == 0)
        zero = lambda v: F.when(empty, 0.0).otherwise(v)
        sums = F.struct(_total(i).alias("i"), _total(x).alias("x"), _total(y).alias("y"))
        return let(
            sums,
            lambda w: F.struct(
                F.when(empty, -1.0).otherwise(w["i"] / (w["i"] + w["x"] + w["y"])).alias("wjac"),
                zero(F.coalesce(F.array_max(_weights(i)), F.lit(0.0))).alias("max_idf"),
                zero(F.size(i).cast("double")).alias("n_shared"),
                zero(F.least(w["x"], w["y"])).alias("unexpl_min"),
                zero(F.greatest(w["x"], w["y"])).alias("unexpl_max"),
                zero(F.size(i) / F.least(F.size(a), F.size(b))).alias("overlap"),
                ((F.size(a) == 0) & (F.size(b) == 0)).cast("int").alias("both_empty"),
            ),
        )

    return _split(a, b, body)


def number_features(a: Column, b: Column) -> Column:
    """struct(contain, symdiff) of two arrays of distinct numbers; -1 and 0 where a side is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    n = F.size(F.array_intersect(a, b))
    return F.struct(
        F.when(empty, -1.0).otherwise(n / F.least(F.size(a), F.size(b))).alias("contain"),
        F.when(empty, 0).otherwise(F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).alias("symdiff"),
    )


def number_features_old(a: Column, b: Column, pc_a: Column, pc_b: Column, house_a: Column, house_b: Column) -> Column:
    """struct(pc_state, pc3_eq, house_state, num_jac, num_conflict, num_both) by the older rules."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    known = (pc_a != "") & (pc_b != "")
    return F.struct(
        tri_state(pc_a, pc_b).alias("pc_state"),
        (known & (F.substring(pc_a, 1, 3) == F.substring(pc_b, 1, 3))).cast("int").alias("pc3_eq"),
        tri_state(house_a, house_b).alias("house_state"),
        F.when(both, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(-1.0).alias("num_jac"),
        F.when(both, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).otherwise(0).alias("num_conflict"),
        both.cast("int").alias("num_both"),
    )
