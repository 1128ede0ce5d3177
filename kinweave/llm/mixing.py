"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes (words) are summed by source (map-side combine); the shares of the sources, the targets' caps and the resharing are
window expressions over the sources alone. Each source repeats whole for as many epochs as its target holds; the rest of the
target is drawn without replacement: a document's key is u^(1/quality) with u from a hash of its id (Efraimidis and
Spirakis, 2006), the greatest keys come first, and sizes are summed up to the rest of the target. The document on the
border gives only the words that still fit, so that a source's taken words differ from its target by under one word.

A source may hold a third of all rows, so nothing sorts a source in one task: keys fall into `buckets` ranges; the ranges'
sizes, summed by (source, range), tell which range holds the border, and only that range is sorted, by a second, finer set
of ranges first. The table of sources is broadcast after its rows have been counted, else joined by sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words
from .rules import lines_with_words, n_symbols

#: Weights in turn for the sources in their order, the total as a share of all sizes, and the most epochs, as the query contract fixes them.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
BUCKETS = 1024
#: Sources up to which their table (some 100 bytes a row) is broadcast.
BROADCAST = 100_000


def quality_of(text: Column) -> Column:
    """A quality weight from 0.1 to 1, of two measures of the quality rules: one less four times the symbols per character and less the share of lines that repeat an earlier one; 1 for an empty text."""
    lines = lines_with_words(text)
    repeats = F.when(text.contains("\n"), 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))).otherwise(0.0)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.1), 1 - 4 * n_symbols(text) / F.length(text) - repeats)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """One less the Efraimidis-Spirakis key u^(1/quality): the least come first. u in (0, 1) hashes id and text, so that null and repeated ids spread."""
    digits = F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text), F.lit(str(seed)))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    return 1 - F.pow(u, 1 / quality)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): `total` times all sizes shared by weight, a target being `most` times its source's size at most.

    What a cap leaves is shared again by weight among the rest until no target is above its cap. That ends in the least
    level L with sum(least(weight * L, cap)) = total; caps are met in the order of cap / weight, so one pass in this order
    finds for each source whether it is capped.
    """
    # The window without a partition runs over one row per source, which the caller has summed.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    filling = Window.orderBy("at", "rank")
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    found = ranked.withColumn("level", level)  # the common level if exactly the sources before are capped
    final = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "rank", "level"))).over(everything)["level"]
    return found.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("w") * F.col("final") >= F.col("cap")), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def mix(docs: DataFrame, keep: list[str] | None = None, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 8, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, taken (words that the mix takes, repeats counted), and the columns in `keep`.

    A null text has size 0; a null source is a source of its own, the last; a null id is hashed like a value. Rows that
    repeat one another count each; ties of the key go by a hash of the text, then in any order, between rows alike in size
    and id. Documents of size 0 take 0. An empty table gives an empty result. The same rows give the same mix.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = sampling_key(F.col(id_col), text, quality if quality is not None else quality_of(text), seed)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("tie"), *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep or [])])
    # Ranges and finer ranges of 1 - u^(1/quality), ascending.
    rows = rows.withColumn("b1", F.floor(F.col("key") * buckets).cast("int")).withColumn("b2", F.floor(F.pmod(F.col("key") * buckets, F.lit(1.0)) * buckets).cast("int"))
    # Without further columns the rows are small and are kept; with them (whole texts), only what the sums need is.
    light = cut(rows.select("source", "size", "key", "tie", "b1", "b2", "_id"))
    rows = rows if keep else light
    sums = light.groupBy("source", "b1").agg(F.sum("size").alias("n"))
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, total, most)
    plan = plan.withColumn("goal", F.round("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    plan = cut(plan)
    first = _border(sums, plan.select("source", "rest"), ["source"], "b1")
    within = _by_source(light, first.select(F.col("source").alias("s"), F.col("b1").alias("edge1"), F.col("rest").alias("r"))).where("b1 = edge1")
    fine = within.groupBy("source", "b2", "r").agg(F.sum("size").alias("n"))
    second = _border(fine.select("source", "b2", "n"), fine.groupBy("source").agg(F.max("r").alias("rest")), ["source"], "b2")
    edges = plan.join(first.select(F.col("source").alias("s1"), F.col("b1").alias("e1")), F.col("source").eqNullSafe(F.col("s1")), "left").join(second.select(F.col("source").alias("s2"), F.col("b2").alias("e2"), F.col("rest").alias("left_over")), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s1", "s2").withColumnRenamed("source", "s")
    joined = _by_source(rows, edges)
    on_edge = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2"))
    inside = F.when((F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2"))), F.col("size")).otherwise(0)
    on_edge = F.coalesce(on_edge, F.lit(False))
    # Only the rows of the border's finest range are sorted: about 1 / buckets^2 of a source. The rest pass through their own branch.
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("key", "tie", "_id").rowsBetween(Window.unboundedPreceding, -1))
    edge = joined.where(on_edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_over") - F.coalesce(so_far, F.lit(0)))))
    plain = joined.where(~on_edge).withColumn("extra", inside)
    taken = F.col("epochs") * F.col("size") + F.coalesce(F.col("extra"), F.lit(0))
    return plain.unionByName(edge).select(F.col("_id").alias(id_col), "size", "source", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep or [])])


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of table, which has a row per source (`s`): broadcast if counted at BROADCAST rows or fewer, else joined by sort, where Spark splits hot sources."""
    table = cut(table)
    small = table.count() <= BROADCAST
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _border(sums: DataFrame, rests: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """By source: the first range by which the sum of sizes exceeds `rest`, and what of rest is left at its begin."""
    there = sums.join(rests.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    passed = there.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    return passed.groupBy("source").agg(F.min(F.struct(bucket, (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("x")).select("source", "x.*")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as rows of docs: a document that is taken k times whole has k rows, and that on the border one more with its first words that fit; others go.

    The text of such a cut row ends after its last word; n_chars, where docs has it, is not changed. Null and empty texts have
    no words and go. Null ids, null sources, repeated rows and ties are as in mix(); docs may have columns of any names.
    """
    names = docs.columns
    found = mix(docs, keep=names, id_col=id_col, text_col=text_col, **options)
    # Columns go by place, so that no name of docs meets one of the mix.
    named = found.toDF("id", "size", "source", "source_size", "target", "taken", *[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    part = F.col("taken") - whole * F.col("size")
    spread = named.where("taken > 0").withColumns({"whole": whole, "part": part})
    spread = spread.withColumn("turn", F.explode(F.sequence(F.lit(1), (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int"))))
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), "")
    cut_text = F.when(F.col("turn") > F.col("whole"), some).otherwise(text)
    return spread.select(*[(cut_text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
q AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(t) || '|8'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u,
         CASE WHEN length(t) > 0 THEN greatest(0.1::DOUBLE, 1 - 4 * len(regexp_extract_all(t, '[#*$%&|<>]'))::DOUBLE / length(t)
           - CASE WHEN contains(t, chr(10)) THEN 1 - len(list_distinct(lines))::DOUBLE / greatest(len(lines), 1) ELSE 0::DOUBLE END) ELSE 1::DOUBLE END AS quality FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source IS NULL, source) AS rank, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS met, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
      FROM r WINDOW f AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT (SELECT level FROM l WHERE level <= met ORDER BY met, rank LIMIT 1) AS final),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR w * final >= cap THEN cap ELSE w * final END AS target FROM l, x),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs, round(target)::BIGINT AS goal FROM t),
o AS (SELECT q.*, source_size, target, epochs, goal - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY q.source ORDER BY 1 - pow(u, 1 / quality), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS so_far
      FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - so_far)))::BIGINT AS taken FROM o
"""
