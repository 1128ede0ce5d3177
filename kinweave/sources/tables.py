"""Tab-separated sources, truth lists, submissions, and their files."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as strings, without quoting; an empty field is the empty string, and words such as NA are text."""
    header = spark.read.text(path).limit(1).collect()
    found = header[0][0].rstrip("\r").split("\t") if header else []
    missing = [c for c in columns if c not in found]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    schema = ", ".join(f"`{c}` string" for c in found)
    raw = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(*[F.coalesce(F.regexp_replace(c, "\r$", ""), F.lit("")).alias(c) for c in columns])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """The four columns of a source, white space around values off."""
    return read_tsv(spark, path, COLUMNS).select(*[F.trim(c).alias(c) for c in COLUMNS])


def read_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The clean source, and the union of the other two with is_s3."""
    one, two, three = (read_source(spark, f"{folder}/{split}/{split}_source{k}.tsv") for k in (1, 2, 3))
    return one, union_targets(two, three)


def union_targets(two: DataFrame, three: DataFrame) -> DataFrame:
    return two.withColumn("is_s3", F.lit(False)).unionByName(three.withColumn("is_s3", F.lit(True)))


def id_list(x: Column | str) -> Column:
    """A comma-joined list as an array, white space around ids off, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(i1, matches): one row per clean record, its matches an array."""
    return read_tsv(spark, path, TRUTH).select(F.trim(TRUTH[0]).alias("i1"), id_list(TRUTH[1]).alias("matches"))


def truth_links(truth: DataFrame) -> DataFrame:
    """(i1, it), a row per link."""
    return truth.select("i1", F.explode("matches").alias("it")).distinct()


def owners(links: DataFrame) -> DataFrame:
    """(it, owner): the one clean record of each target; the least id where the data has several."""
    return links.groupBy("it").agg(F.min("i1").alias("owner"))


def write_lists(records: DataFrame, links: DataFrame, path: str, column: str = "matched_entity_ids", rid: str = "i1", target: str = "it", files: int | None = None) -> None:
    """A TSV with a row per record: its targets comma-joined in order, once each, without clean ids; empty without any. Never quoted."""
    lists = list_rows(records, links, column, rid, target)
    (lists.coalesce(files) if files else lists).write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").option("header", True).csv(path)


def write_submission(records: DataFrame, candidates: DataFrame, matches: DataFrame, folder: str, rid: str = "i1", target: str = "it", files: int | None = None) -> None:
    """Both lists of a submission under a folder, candidates and matches, each with a row for every record, those without any target (such as of a country that has none) included. Matches that are no candidates are left out."""
    write_lists(records, candidates, f"{folder}/candidate_pairs.tsv", "candidate_entity_ids", rid, target, files)
    write_lists(records, matches.join(candidates.select(rid, target).distinct(), [rid, target], "left_semi"), f"{folder}/matching_results.tsv", "matched_entity_ids", rid, target, files)


def read_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON file of settings over defaults, from any file system of Spark's; unknown names and other types are errors."""
    import json

    found = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    for name, value in found.items():
        if name not in defaults or (defaults[name] is not None and not isinstance(value, type(defaults[name]))):
            raise ValueError(f"no setting {name!r} of {type(value).__name__}")
    return defaults | found


def list_rows(records: DataFrame, links: DataFrame, column: str = "matched_entity_ids", rid: str = "i1", target: str = "it") -> DataFrame:
    kept = links.where(~F.col(target).startswith("S1-")).groupBy(rid).agg(F.array_join(F.sort_array(F.collect_set(target)), ",").alias(column))
    return records.select(rid).join(kept, rid, "left").select(F.col(rid).alias(TRUTH[0]), F.coalesce(column, F.lit("")).alias(column))


def write_clean(cleaned: DataFrame, path: str) -> None:
    """Cleaned records as Parquet by country, for later runs."""
    cleaned.write.mode("overwrite").partitionBy("country").parquet(path)


def read_clean(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Cleaned records; a country reads its partition alone."""
    found = spark.read.parquet(path)
    return found if country is None else found.where(F.col("country") == country)


def write_report(report: dict, spark: SparkSession, path: str) -> None:
    """A small report as one JSON file, through Spark's file systems."""
    import json

    spark.createDataFrame([(json.dumps(report, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, through Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def region_slice(source: DataFrame, truth: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Records whose address matches a pattern, and the truth of the kept clean records."""
    kept = source.where(F.col("business_address").rlike(pattern))
    return kept, truth.join(kept.select(F.col("entity_id").alias("i1")), "i1", "left_semi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(fields, quoted, spaced) of each line of a submission but its header, for checks of its format."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith(TRUTH[0])).select(F.split("value", "\t").alias("fields"), F.col("value").contains('"').alias("quoted"), F.col("value").rlike(r" |\s$").alias("spaced"))


def find_files(root: str) -> dict[str, Path]:
    """Names of sources and truth (lower case) -> files under a local folder; archives there are opened in place, outside Spark."""
    wanted = re.compile(r"(train|test)_(source[123]|ground_truth)\.tsv$")
    for archive in sorted(Path(root).rglob("*.zip")):
        with zipfile.ZipFile(io.BytesIO(archive.read_bytes())) as z:
            for member in z.namelist():
                name = Path(member).name.lower()
                if wanted.search(name) and not (archive.parent / name).exists():
                    (archive.parent / name).write_bytes(z.read(member))
    return {p.name.lower(): p for p in sorted(Path(root).rglob("*")) if p.is_file() and wanted.search(p.name.lower())}
