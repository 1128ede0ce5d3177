"""URL filters over a sorted digest array.

The rules' keys (host and path together) become a file: their 64-bit xxhash digests in ascending order, then the full
strings and verdicts in the same order. Executors get the file through Spark, map it into memory and probe it with a
vectorised binary search for all hosts above a url's and all path lengths that rules have; each hit is confirmed by its
full string, so collisions of digests do no harm. There is no shuffle, and only ids and urls are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stash

ALLOW, BLOCK = "allow", "block"
#: The rules that the query contract fixes: verdict, host, path.
RULES = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


def build(rules, seed: int = 0) -> bytes:
    """The index as bytes: magic, number of keys, of path lengths and of bytes; digests, path lengths, offsets, host lengths, verdicts, strings."""
    kinds = {(host.translate(LOWER), path): verdict for verdict, host, path in rules}
    rows = sorted(((xxhash.xxh64_intdigest((h + p).encode(), seed), (h + p).encode(), len(h), v == BLOCK) for (h, p), v in kinds.items()), key=lambda r: r[:3])
    lengths = sorted({len(p) for _, p in kinds})
    text = b"".join(r[1] for r in rows)
    head = np.array([len(rows), len(lengths), len(text), seed], "<u8")
    arrays = (np.array([r[0] for r in rows], "<u8"), np.array(lengths, "<u8"), np.cumsum([0] + [len(r[1]) for r in rows]).astype("<u8"), np.array([r[2] for r in rows], "<u8"), np.array([r[3] for r in rows], "<u8"))
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays), text])


@dataclass
class Index:
    """An index in memory or mapped from its file."""

    data: np.ndarray

    def __post_init__(self) -> None:
        n, m, size, self.seed = (int(x) for x in self.data[:32].view("<u8"))
        bounds = np.cumsum([32, 8 * n, 8 * m, 8 * (n + 1), 8 * n, 8 * n, size])
        self.keys, self.lengths, self.offsets, self.hosts, self.blocks = (self.data[a:b].view("<u8") for a, b in zip(bounds[:5], bounds[1:6], strict=True))
        self.text = self.data[bounds[5] : bounds[6]]
        self.path_lengths = [int(x) for x in self.lengths]

    @classmethod
    def mapped(cls, path: str) -> Index:
        return cls(np.memmap(path, np.uint8, "r"))

    def lookup(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
        """host, path, rule and its verdict (nulls without one) of each url; the longest rule wins, of equally long ones that with the longer host."""
        split = [parts_of(u) for u in urls]
        found: list[tuple[str, int, int]] = []  # candidate, url, length of its host
        for i, (host, path) in enumerate(split):
            at = 0 if host else -1
            while at >= 0:
                suffix = host[at:]
                found += [(suffix + path[:k], i, len(suffix)) for k in self.path_lengths if k <= len(path)]
                at = host.find(".", at) + 1 or -1
        best: dict[int, tuple[int, int, int]] = {}
        digests = np.array([xxhash.xxh64_intdigest(c.encode(), self.seed) for c, *_ in found], np.uint64)
        place = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == digests) if len(self.keys) else []
        for j in hits:
            text, i, size = found[j]
            at = int(place[j])
            while at < len(self.keys) and self.keys[at] == digests[j]:  # equal digests stand together
                if int(self.hosts[at]) == size and bytes(self.text[int(self.offsets[at]) : int(self.offsets[at + 1])]) == text.encode():
                    best[i] = max(best.get(i, (0, 0, 0)), (len(text), size, at))
                at += 1
        out = []
        for i, (host, path) in enumerate(split):
            if i in best:
                at = best[i][2]
                out.append((host, path, bytes(self.text[int(self.offsets[at]) : int(self.offsets[at + 1])]).decode(), BLOCK if self.blocks[at] else ALLOW))
            else:
                out.append((host, path, None, None))
        return out


def publish(spark: SparkSession, data: bytes) -> str:
    """Writes the index to the shared folder by Spark's file systems and hands it to the executors; returns its name there."""
    name = f"url_index_{hashlib.sha256(data).hexdigest()[:32]}.bin"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = shared_dir(spark) if spark.conf.get("spark.checkpoint.dir", None) else stash("url folder", lambda: tempfile.mkdtemp(prefix="kinweave-"))
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    system = target.getFileSystem(conf)
    if not system.exists(target):
        half = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.{name}.{os.getpid()}")
        out = system.create(half, True)
        out.write(bytearray(data))
        out.close()
        system.rename(half, target)
    spark.sparkContext.addFile(target.toString())
    return name


def judge(pages: DataFrame, rules=RULES, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null without one), verdict: the rule's, else `default`, of every row.

    Null urls and such without "://" have empty parts, hence no rule; null ids and repeated rows stay. An empty table gives
    an empty result, no rules the default. Other columns aren't read.
    """
    name = publish(pages.sparkSession, build(rules))
    field = pages.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        path = SparkFiles.get(name)
        index = stash(f"url index {path}", lambda: Index.mapped(path))
        for batch in batches:
            found = index.lookup(batch.column(1).to_pylist())
            host, path_, rule, verdict = zip(*found, strict=True) if found else [()] * 4
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text(host), text(path_), text(rule), text([v or default for v in verdict])], names=[field.name, "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, host string, path string, rule string, verdict string")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
