"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Each document is measured once and each rule evaluated once; the ledger keeps the measurements and the failure bits. What a
policy (a named, versioned set of rules) decides, and what it would decide without one of its rules, then comes from bit
operations on the ledger without reading texts again. All measurements are made within a row: no shuffle, no window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[], Column]  # over the measurements


#: A rule's place is its bit and never changes; new rules come last. The first two are the base.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: (2 * F.col("n_dup_lines") > F.col("n_lines")) & (F.col("n_lines") >= 4)),
    Rule("word_length", lambda: (F.col("word_chars") > 40 * F.col("n_words")) | (10 * F.col("word_chars") < 15 * F.col("n_words"))),
)
BASE = ("few_words", "repeated_words")
#: Policies by name and version.
POLICIES = {("base", 1): BASE, ("web", 1): (*BASE, "symbols", "word_length"), ("web", 2): (*BASE, "symbols", "repeated_lines", "word_length")}
CURRENT = ("web", 2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the variable of a function over an array of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rest(values: Column, first: int) -> Column:
    return F.slice(values, F.lit(first), F.greatest(F.size(values), F.lit(1)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the array holds twice or more, the first one included.

    Windows are told apart by a 64-bit hash of their words' 64-bit hashes; equal ones are neighbours after a sort.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        two = F.zip_with(h, _rest(h, 2), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(two, _rest(h, 3), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))

    def any_equal(s: Column) -> Column:
        return F.exists(F.zip_with(s, _rest(s, 2), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)

    def places(s: Column) -> Column:  # of a sorted array of (window, place): the places of windows equal to a neighbour
        same = F.zip_with(s, _rest(s, 2), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
        both = _let(same, lambda x: F.zip_with(x, F.concat(F.array(F.lit(False)), x), lambda a, b: F.coalesce(a, F.lit(False)) | b))
        marked = F.zip_with(s, both, lambda a, m: F.when(m, a["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.zip_with(p, _rest(p, 2), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda x, y: x + y)

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(_let(F.sort_array(w), any_equal), _let(_let(pairs, places), covered)).otherwise(0)

    return _let(_let(hashes, windows), count)


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of every row's whole text; null measures as empty."""
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = text.select(
        id_col,
        F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.length(F.translate("_t", SPACES, "")).alias("word_chars"),
        n_symbols(F.col("_t")).alias("n_symbols"),
        lines_with_words(F.col("_t")).alias("_lines"),
    )
    found = {"n_words": F.size("_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": repeated_words(F.col("_words"))}
    return split.select(id_col, *[c.cast("long").alias(k) for k, c in found.items()])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `failed`, a long with a bit per rule in the order of rules.

    Each row of docs has its row, repeats and null ids included; an empty text fails few_words; an empty table gives an empty
    ledger. Other columns aren't read.
    """
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << i)).otherwise(0).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(known[n] for n in set(names))


def kept(mask: int, failed: str = "failed") -> Column:
    """Whether none of the mask's rules has failed."""
    return F.col(failed).bitwiseAND(F.lit(mask)) == 0


def ablation(book: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the mask: n_failed; n_alone (documents that this rule alone rejects: kept without it); one pass of bitwise sums over the ledger."""
    failed = F.col("failed").bitwiseAND(F.lit(mask))
    used = [(i, r) for i, r in enumerate(rules) if mask >> i & 1]
    sums = book.agg(*[F.count_if(failed.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i, _ in used], *[F.count_if(failed == (1 << i)).alias(f"a{i}") for i, _ in used])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"a{i}").alias("n_alone")) for i, r in used])).alias("x")).select("x.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, policy = mask_of(BASE), mask_of(POLICIES[CURRENT])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept(base)).alias("base_failed"), kept(base | policy).alias("kept"), "failed")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, word AS w1, lead(word) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w1, w2, w3) > 1 AS twice FROM g),
c AS (SELECT r, i, twice OR coalesce(lag(twice) OVER s, false) OR coalesce(lag(twice, 2) OVER s, false) AS inside FROM f WINDOW s AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, count(*) FILTER (WHERE inside) AS n FROM c GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN n USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines AND n_lines >= 4 THEN 8 ELSE 0 END
           + CASE WHEN word_chars > 40 * n_words OR 10 * word_chars < 15 * n_words THEN 16 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""
