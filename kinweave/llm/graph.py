"""Connected components of links, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key


ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node of its component.

    Alternating large and small stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014), cut after each
    round. A root's star holds its whole component; such nodes' rows are joined where they lie, by a broadcast of few nodes.
    What is cut lies in a partition per ROWS edges, so that few links don't make many small files.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(now)
    while seen[0]:
        narrow = lambda df, n=1 + seen[0] // ROWS: cut(df.coalesce(n))
        now = now.coalesce(1 + seen[0] // ROWS)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = narrow(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")))
        large = narrow(join_by_key(both.where("b > a"), least, "a", "n", how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = narrow(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_by_key(large, least, "a", "n", how="inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = narrow(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if (digest := _digest(now)) == seen:
            break
        seen = digest
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
