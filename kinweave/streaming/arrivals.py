"""Matching of records that arrive as a stream against the keys of known records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import bit_of, key_sizes
from ..operators.keys import CAPS
from pyspark.sql import functions as F


def known_keys(keys: DataFrame, caps: dict[str, tuple[int, int]] = CAPS) -> DataFrame:
    """(kind, key, i1) of the clean side, without keys over its caps; write it once, bucketed or sorted by key."""
    distinct = keys.where("side = 's1'").distinct()
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c[0])) for k, c in caps.items()])
    good = key_sizes(distinct).where(F.col("n1") <= limit).select("kind", "key")
    return distinct.join(good, ["kind", "key"], "left_semi").select("kind", "key", F.col("rid").alias("i1"))


def match_batch(arrived_keys: DataFrame, known: DataFrame) -> DataFrame:
    """(i1, it, keymask) of arrived records' keys (side 't') against the known ones."""
    hits = arrived_keys.distinct().join(known, ["kind", "key"]).select("kind", "i1", F.col("rid").alias("it"))
    return hits.groupBy("i1", "it").agg(F.bit_or(bit_of(F.col("kind"))).alias("keymask"))


def match_stream(arrivals: DataFrame, to_keys: Callable[[DataFrame], DataFrame], known: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes candidates of each micro-batch as Parquet under out/batch=<id>; a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        match_batch(to_keys(batch), known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
