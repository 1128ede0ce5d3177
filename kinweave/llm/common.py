"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The code points that separate words, for translate().
SPACES = " \t\n\x0b\x0c\r"
#: Blocks of a long text in a labelled sample.
BLOCKS = 8


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, one process alone (master local) gets an own folder; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or stash("shared folder", lambda: tempfile.mkdtemp(prefix="kinweave-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by checkpoint() in the shared folder, so that a lost executor costs no recomputation of what came before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def drop_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the files of shuffles that no plan refers to, as those before a cut(): it does so when the driver's JVM collects garbage, which with a heap to spare comes late or never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, key: str, row_bytes: int, task_bytes: int = 16 << 20) -> DataFrame:
    """df, which is cut, in so many partitions that what a task makes of its rows, row_bytes of each, is about task_bytes at most."""
    parts = -(-df.count() * row_bytes // task_bytes)
    return df.repartition(parts, key) if parts > df.rdd.getNumPartitions() else df


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "left", least: int = 512, parts: int = 10_000) -> DataFrame:
    """rows joined to table (`left` or `inner`) by one key, whatever share of the rows a key holds.

    table has one row per key and names in `count` how many of rows have it, or a multiple of that. Keys with more rows than
    `least` and than the rows' number over `parts` are fewer than least * parts / least = parts, so their rows of table are
    broadcast and their rows in `rows` stay where they are; all others are joined by hash, where no key is large. Rows with a
    null key match nothing. rows and table are read several times: cut them before.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(least, -(-int(total or 0) // parts))
    if (most or 0) <= limit and how == "inner":
        return rows.join(table, key).select(*rows.columns, *[c for c in table.columns if c != key])
    hot = F.broadcast(table.where(F.col(count) > limit))
    kept = rows.join(hot, key).select(*rows.columns, *[c for c in table.columns if c != key])
    cold = rows.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= limit), key, how)
    found = kept.unionByName(cold.select(*kept.columns))
    if how == "left":
        found = found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """(text, label) of the labelled rows with the smallest hashes of their ids among those that `use` admits: `rows` documents at most, of max_bytes at most each.

    First ids and labels alone are sought out; then their texts, by a broadcast of these ids. So no more than rows * max_bytes
    come to the driver, whatever the tables hold. Of repeated label rows the greatest label counts, of repeated documents the
    least text; null labels, ids and texts are left out. A text of over max_bytes gives BLOCKS blocks at even distances from
    its begin to its end, joined by line feeds. The list is in the order of the hashes.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & use).select(F.xxhash64(id_col, F.lit("fit")).alias("h"), F.col(id_col).alias("i"), F.col(label).alias("y"))
    picked = {r["i"]: (r["h"], r["y"]) for r in marks.groupBy("h", "i").agg(F.max("y").alias("y")).orderBy("h", "i").limit(rows).collect()}
    if not picked:
        return []
    kind = labels.select(F.col(id_col).alias("i")).schema
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], kind)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), "i")
    size = max_bytes // (4 * BLOCKS) - 1  # a code point has four bytes at most
    block = lambda k: F.substring("t", (1 + F.floor(k * (F.length("t") - size) / (BLOCKS - 1))).cast("int"), F.lit(size))
    some = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), block), "\n")
    texts = texts.withColumn("t", F.when(F.octet_length("t") <= max_bytes, F.col("t")).otherwise(some))
    found = texts.groupBy("i").agg(F.min("t").alias("t")).collect()
    return [(r["t"], picked[r["i"]][1]) for r in sorted(found, key=lambda r: picked[r["i"]][0])]


def map_texts(df: DataFrame, id_cols: list[str], text_col: str, schema: str, scorer: Callable[[list[str]], dict[str, list]], slice_bytes: int = 4 << 20) -> DataFrame:
    """Applies scorer to whole texts (null as empty) in Arrow batches, a few MB at a time, and carries id_cols along unchanged.

    scorer gets a list of texts and returns the further columns of schema as lists. Memory is bounded by one Arrow batch and slice_bytes or the longest text.
    """
    fields = df.select(*id_cols).schema
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("")
        for batch in batches:
            for lo, hi in slices(batch.column(batch.num_columns - 1), slice_bytes):
                part = batch.slice(lo, hi - lo)
                texts = ["" if t is None else t for t in part.column(part.num_columns - 1).to_pylist()]
                out = scorer(texts)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out.values())], names=[*part.schema.names[:-1], *out])
        release("")

    return df.select(*id_cols, F.col(text_col).alias("_text")).mapInArrow(run, f"{ids}, {schema}")


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text each, or one row."""
    lengths = np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept (the last weight), by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: What this process keeps between tasks, by name.
_KEPT: dict = {}


def release(keep: str) -> None:
    """Gives memory of a Python worker back to the system, so that operators that follow one another don't add up: what is kept under other names than such that begin with `keep`, and freed blocks."""
    import ctypes

    for name in [n for n in _KEPT if n != "shared folder" and (not keep or not n.startswith(keep))]:
        del _KEPT[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps freed blocks
        pass


def stash(name: str, make: Callable):
    """What make() returned when this name was first asked for in this process; it outlives the tasks of a Python worker until release()."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]
