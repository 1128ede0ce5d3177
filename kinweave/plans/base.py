"""The catalogue of queries: a Spark plan by name and, where SQL can express it, the equal DuckDB SQL.

The driver's tables hold no business records, so queries run on stand-ins: `rec` reads whole documents as records (tokens of
the whole text), `pairs` reads lineitem as scored pairs of an order and a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan under a name, with its SQL if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, rows: list[str], column: str = "t") -> DataFrame:
    """A fixture of texts with their places, from 1."""
    return spark.createDataFrame(list(enumerate(rows, 1)), f"id int, {column} string")


def values(rows: list[str], column: str = "t") -> str:
    """The same fixture in SQL, as a table expression."""
    quoted = ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(rows, 1))
    return f"(VALUES {quoted}) AS v(id, {column})"


CLEAN_SOURCES = ("src0", "src1", "src2", "src3")


def rec(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, country, side, src, state, num1, toks of every document, or of docs, which has the same columns, and `more` of these."""
    source = F.coalesce("source", F.lit(""))
    return (table(spark, sf_dir, "documents") if docs is None else docs).select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("country"),
        F.when(source.isin(*CLEAN_SOURCES), "s1").otherwise("t").alias("side"),
        F.when(source.isin(*CLEAN_SOURCES), "S1").when(source.rlike("^src([4-9]|1[01])$"), "S2").otherwise("S3").alias("src"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("z"), (F.col("doc_id") % 3).cast("string"))).alias("state"),
        (F.col("doc_id") % 50).cast("string").alias("num1"),
        text.alnum_tokens("text").alias("toks"),
        F.md5(F.coalesce("text", F.lit(""))).alias("copy"),
        *more,
    )


REC = """rec AS (
  SELECT doc_id, coalesce(lang, '') AS country, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 's1' ELSE 't' END AS side,
         CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'S1' WHEN regexp_matches(coalesce(source, ''), '^src([4-9]|1[01])$') THEN 'S2' ELSE 'S3' END AS src,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'z' || (doc_id % 3)::VARCHAR END AS state, (doc_id % 50)::VARCHAR AS num1,
         regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks, md5(coalesce(text, '')) AS copy
  FROM documents)"""


def truth(records: DataFrame) -> DataFrame:
    """(i1, it) of clean and other documents with equal texts, each of the others with the least clean one."""
    one = records.where("side = 's1'").groupBy("copy").agg(F.min("doc_id").alias("i1"))
    return records.where("side = 't'").select("copy", F.col("doc_id").alias("it")).join(one, "copy").select("i1", "it")


TRUTH = """truth AS (
  SELECT i1, t.doc_id AS it FROM rec t JOIN (SELECT copy, min(doc_id) AS i1 FROM rec WHERE side = 's1' GROUP BY copy) USING (copy) WHERE side = 't')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i1, it, v, p, qs, qn, qa, num_eq of every order and part."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i1"), F.col("l_partkey").alias("it")).agg(
        F.max("l_extendedprice").alias("v"),
        F.max(F.col("l_discount") * 10).alias("p"),
        F.max(F.col("l_quantity") / 50).alias("qs"),
        F.max(F.col("l_discount") * 10).alias("qn"),
        F.max(F.col("l_tax") * 10).alias("qa"),
        F.max(F.col("l_linenumber") % 2).alias("num_eq"),
        F.max("l_returnflag").alias("flag"),
    )


PAIRS = """pairs AS (
  SELECT l_orderkey AS i1, l_partkey AS it, max(l_extendedprice) AS v, max(l_discount * 10) AS p, max(l_quantity / 50) AS qs,
         max(l_discount * 10) AS qn, max(l_tax * 10) AS qa, max(l_linenumber % 2) AS num_eq, max(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, counts as long: what both engines agree on."""
    kinds = dict(df.dtypes)
    fix = {"double": lambda c: F.round(c, 6), "float": lambda c: F.round(F.col(c).cast("double"), 6), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[fix[kinds[c]](c).alias(c) if kinds[c] in fix else F.col(c) for c in df.columns])
