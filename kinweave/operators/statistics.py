"""Token statistics and learned dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import coded
from ..sources.staging import staged

#: Words that rarest() keeps on every executor, the most frequent ones.
COMMON = 20_000


def token_counts(records: DataFrame, tokens: str) -> DataFrame:
    """(w, n): occurrences of each token, repeats within a record included."""
    return records.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def document_counts(records: DataFrame, tokens: str) -> DataFrame:
    """(w, n): records that hold each token."""
    return records.select(F.explode(F.array_distinct(tokens)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def log_frequency(records: DataFrame, tokens: str) -> DataFrame:
    """(w, logf) of the tokens longer than a letter: log of the share among all occurrences."""
    counts = token_counts(records, tokens)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.where(F.length("w") > 1).crossJoin(F.broadcast(total)).select("w", F.log(F.col("n") / F.col("total")).alias("logf"))


def idf(counts: DataFrame, n_records: Column) -> DataFrame:
    """(w, idf) = log(records / count)."""
    return counts.select("w", F.log(n_records / F.col("n")).alias("idf"))


def idf_smooth(counts: DataFrame, n_records: Column) -> DataFrame:
    """(w, idf) = log((records + 1) / (count + 1)) + 1."""
    return counts.select("w", (F.log((n_records + 1) / (F.col("n") + 1)) + 1).alias("idf"))


def weigh_tokens(records: DataFrame, rid: str, tokens: str, weights: DataFrame, default: float, out: str) -> DataFrame:
    """(rid, out): each record's distinct tokens with their weights, sorted and coded as similarity.set_features() takes them, so that pairs need no join with the weights."""
    pairs = records.select(rid, F.explode(F.array_distinct(tokens)).alias("w")).join(weights, "w", "left")
    found = pairs.groupBy(rid).agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("idf", F.lit(default)).alias("idf")))).alias(out))
    return records.select(rid).join(found.withColumn(out, coded(out)), rid, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def unknown_fraction(records: DataFrame, rid: str, tokens: str, known: DataFrame) -> DataFrame:
    """(rid, unk_frac): share of a record's tokens, repeats included, that `known` (w) lacks; 1 without tokens."""
    marked = records.select(rid, F.explode_outer(tokens).alias("w")).join(known.select("w").distinct().withColumn("known", F.lit(1)), "w", "left")
    return marked.groupBy(rid).agg(F.avg(F.when(F.col("w").isNull() | F.col("known").isNull(), 1.0).otherwise(0.0)).alias("unk_frac"))


def rarest(records: DataFrame, rid: str, tokens: str, counts: DataFrame, k: int | None = 2, out: str = "rare") -> DataFrame:
    """(rid, out): a record's distinct tokens by ascending (count, token), the first k or all; unseen tokens count 0.

    One row per rid, which is one record's. With k, words that are more frequent than COMMON others are known on every executor, and
    only the others, which come before them, are shuffled; records with fewer than k of these are looked at whole. counts is read
    several times: stage it.
    """

    def ordered(pairs: DataFrame) -> DataFrame:
        known = pairs.join(counts, "w", "left")
        return known.groupBy(rid).agg(F.sort_array(F.collect_list(F.when(F.col("w").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("w"))))).alias("s"))

    if k is None:
        found = ordered(records.select(rid, F.explode_outer(F.array_distinct(tokens)).alias("w")))
        return found.select(rid, F.transform("s", lambda x: x["w"]).alias(out))
    least = counts.orderBy(F.desc("n")).limit(COMMON).agg(F.min("n")).first()[0] or 0
    common = F.broadcast(counts.where(F.col("n") > least).select("w"))
    first = F.transform(F.slice("s", 1, k), lambda x: x["w"])
    found = staged(ordered(records.select(rid, F.explode(F.array_distinct(tokens)).alias("w")).join(common, "w", "left_anti")).where(F.size("s") >= k).select(rid, first.alias(out)))
    rest = records.select(rid, tokens).join(found.select(rid), rid, "left_anti")
    return found.unionByName(ordered(rest.select(rid, F.explode_outer(F.array_distinct(tokens)).alias("w"))).select(rid, first.alias(out)))


def learn_dictionary(pairs: DataFrame, left: str, right: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """(x, y, n): replacements of tokens of `right` by those of `left` in aligned pairs of token arrays of equal length.

    x -> y is kept if x differs from y, occurs `least` times and makes up `share` of x's positions; of several y the most
    frequent, then the first, counts.
    """
    both = pairs.where(F.size(left) == F.size(right)).select(F.explode(F.arrays_zip(F.col(right).alias("x"), F.col(left).alias("y"))).alias("z")).select("z.x", "z.y")
    counts = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy("x")))
    kept = totals.where((F.col("x") != F.col("y")) & (F.col("n") >= least) & (F.col("n") / F.col("total") >= share))
    first = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "y"))
    return kept.withColumn("r", first).where("r = 1").select("x", "y", "n")


def word_states(records: DataFrame, words: str, state: str, least: int = 5, purity: float = 0.9) -> DataFrame:
    """(w, word_state): state that `purity` of a word's records with a state share, for words with `least` such records."""
    pairs = records.where(F.col(state) != "").select(F.explode(F.array_distinct(words)).alias("w"), F.col(state).alias("s"))
    counts = pairs.groupBy("w", "s").agg(F.count("*").alias("n"))
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy("w")))
    return totals.where((F.col("total") >= least) & (F.col("n") / F.col("total") >= purity)).select("w", F.col("s").alias("word_state"))


def infer_states(records: DataFrame, rid: str, words: str, state: str, votes: DataFrame) -> DataFrame:
    """(rid, state): a missing state filled by most votes of the record's words, of equal ones that of the first word."""
    missing = records.where(F.col(state) == "").select(rid, F.posexplode(F.array_distinct(words)).alias("pos", "w")).join(votes, "w")
    tally = missing.groupBy(rid, "word_state").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = tally.groupBy(rid).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "word_state"))["word_state"].alias("filled"))
    return records.select(rid, state).join(best, rid, "left").select(rid, F.when(F.col(state) != "", F.col(state)).otherwise(F.coalesce("filled", F.lit(""))).alias(state))
