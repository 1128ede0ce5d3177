"""SimHash near-duplicates by covering locality-sensitive hashing.

The masks follow Pagh, "CoveringLSH: locality-sensitive hashing without false negatives" (SODA 2016): bit i gets a
nonzero vector a(i) of r + 1 bits, and table v keeps the bits with odd <a(i), v>. The vectors of at most r differing
bits leave some v orthogonal to all of them, so that every pair within radius r meets in some table's bucket.

Plan: fingerprint (Arrow, no shuffle) -> one row per distinct fingerprint (map-side combine) -> a bucket row per table, by a
hash of table and bits (two buckets of one hash are compared as one: more work, no link lost) -> count of each bucket (map-side
combine, so a hot bucket shuffles a row per task). Buckets of two members or more, if few, are broadcast, so that only their
members travel; these are gathered as bounded lists, and each list gives a spanning forest of its near pairs, never all
pairs. A bucket over `hot` members is split by a second set of covering masks over the bits that its
table left out: what shares both masks differs in at most about 18 bits, which bounds the lists at any size.

Four of 64 bits find near copies only. similar_documents() links by an estimated Jaccard similarity (0.8 of sets of five-word
shingles by default): fingerprints of 512 bits, whose differing share tells the angle between two sets, hence the similarity;
candidates by covering masks over nine parts of them, so that pairs of up to 35 differing bits there always meet, and by
classes of the sets' sizes, since sets as similar have sizes as similar.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key, map_texts, release, spread
from .graph import components

SEED = 42
#: Words of a shingle and bits that may differ, as the query contract fixes them.
SHINGLE, RADIUS = 4, 4
#: Members of a bucket that one row may gather; larger buckets are split first.
HOT = 16384
#: Of wide fingerprints: bits, words of a shingle, and the Jaccard similarity that links.
BITS, WIDTH, SIMILARITY = 512, 5, 0.8
#: Parts of a wide fingerprint, their bits, and the radius that the masks cover in each.
PARTS, PART_BITS, PART_RADIUS = 9, 42, 3
#: A class of set sizes spans so many steps, each a ratio of sizes that the least similarity admits.
SIZE_STEPS = 4
#: As HOT, for wide fingerprints; the most blocks that a larger bucket is dealt into, and bytes of their members in a task.
WIDE_HOT, BLOCKS_OF, CELL_BYTES = 2048, 64, 16 << 20
#: Large buckets up to whose number their keys (16 bytes each) are broadcast.
BROADCAST = 200_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the shingles of `width` words, space-joined, repeats included; A-Z are lower-cased. Fewer words make one shingle, no word (or null) none."""
    words = (text or "").encode().lower().split()  # bytes.split() knows exactly the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, stops = np.concatenate([[0], ends[:-1] + 1]).tolist(), ends.tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits, the lowest first, that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones * 2 > len(hashes)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if set in over half of the hashes of the shingles, repeats included; zero without a word."""
    return int(np.packbits(majority(shingle_hashes(text, width)), bitorder="little").view("<u8")[0])


def wide_fingerprint(text: str | None, width: int) -> bytes:
    """BITS bits like fingerprint()'s, over the set of shingles; each 64 bits mix the hashes in another way. Then the set's size, in four bytes."""
    hashes, out = np.unique(shingle_hashes(text, width)), []
    for k in range(BITS // 64):
        mixed = (hashes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) if k else hashes
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(mixed ^ (mixed >> np.uint64(27))))
    return np.packbits(np.concatenate(out), bitorder="little").tobytes() + len(hashes).to_bytes(4, "little")


def radius_of(similarity: float, bits: int) -> int:
    """Bits that fingerprints of sets with this Jaccard similarity differ in, and a standard deviation more, so that five in six of such pairs are within."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + math.sqrt(bits * share * (1 - share)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: list[int] | range = range(64)) -> list[int]:
    """2^(radius+1) - 1 masks over the given bits; two values that differ in at most `radius` of these agree under one mask or more."""
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % tables) & v).bit_count() % 2) for v in range(1, tables + 1)]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of values within `radius` bits. Reached values leave the search, so dense groups end at once."""
    rest, edges = np.unique(values.astype(np.int64)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, offsets = np.asarray(lists.values, dtype=np.int64), np.asarray(lists.offsets)
            starts, sizes = offsets[:-1], np.diff(offsets)
            twos = np.sort(values[starts[sizes == 2][:, None] + np.arange(2)], axis=1)
            twos = twos[np.bitwise_count((twos[:, 0] ^ twos[:, 1]).view(np.uint64)) <= radius]
            edges: list[tuple[int, int]] = []
            for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                edges += forest(values[a : a + n], radius)
            pairs = np.concatenate([twos, np.array(sorted(set(edges)), dtype=np.int64).reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def near_edges(classes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` of `classes`; their connected components are those of all pairs within `radius` bits."""
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for t, m in enumerate(masks)]))
    keys = spread(classes, "fp", 24 * len(masks)).select("fp", table.alias("x")).select("x.key", "x.t", "fp")
    buckets = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2"))
    small = buckets.where(f"n <= {hot}").select("key")
    members = keys.select("key", "fp").join(F.broadcast(small) if small.count() <= BROADCAST else small, "key")
    edges = members.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_forests(radius), "a long, b long")
    if buckets.where(f"n > {hot}").limit(1).count():
        second = [[signed(m | x) for x in covering_masks(radius, [i for i in range(64) if not m >> i & 1])] for m in masks]
        grid = F.array(*[F.array(*[F.lit(x) for x in row]) for row in second])
        split = join_by_key(keys, buckets.where(f"n > {hot}").select("key", "n"), "key", "n", how="inner")
        split = split.select("key", "fp", F.posexplode(F.element_at(grid, F.col("t").cast("int") + 1)).alias("u", "m"))
        finer = split.groupBy("key", "u", F.col("fp").bitwiseAND(F.col("m")).alias("k2")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        edges = edges.unionByName(finer.mapInArrow(_forests(radius), "a long, b long"))
    return edges.distinct()


def wide_forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As forest(), of rows of 64-bit words; edges are places."""
    rest, edges = np.arange(len(values)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(values[rest] ^ values[x]).sum(axis=1, dtype=np.int64) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                queue += found.tolist()
                rest = rest[~near]
    return edges


def _part_keys(similarity: float):
    """(rep, key) of (rep, fp): a key for each table, with the table's number and the class of the set's size in the upper bits; sizes at most a step below the next class have its keys too."""
    masks = np.array(covering_masks(PART_RADIUS, range(PART_BITS)), np.uint64)
    table = np.arange(PARTS * len(masks), dtype=np.uint64).reshape(PARTS, -1) << np.uint64(PART_BITS)
    weights = np.uint64(1) << np.arange(PART_BITS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8 + 4)
                bits = np.unpackbits(raw[:, : BITS // 8], axis=1, bitorder="little")[:, : PARTS * PART_BITS]
                values = bits.reshape(len(bits), PARTS, PART_BITS).astype(np.uint64) @ weights
                found = (values[:, :, None] & masks | table).reshape(len(bits), -1)
                steps = np.log(np.maximum(raw[:, BITS // 8 :].copy().view("<u4").ravel(), 1)) / -math.log(similarity)
                size = np.floor(steps / SIZE_STEPS)
                twice = np.flatnonzero(steps - SIZE_STEPS * size >= SIZE_STEPS - 1 - 1e-9)
                at, size = np.concatenate([np.arange(len(bits)), twice]), np.concatenate([size, size[twice] + 1]).astype(np.uint64)
                keys = found[at] | size[:, None] << np.uint64(PART_BITS + 8)
                rep = part.column(0).take(pa.array(np.repeat(at, found.shape[1])))
                yield pa.RecordBatch.from_arrays([rep, pa.array(keys.reshape(-1).view(np.int64))], names=["rep", "key"])
        release("")

    return run


def _wide_forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.values, np.asarray(lists.offsets)
            rep, data = flat.field("rep"), flat.field("fp")
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                values = np.frombuffer(b"".join(x[: BITS // 8] for x in data.slice(lo, hi - lo).to_pylist()), "<u8").reshape(-1, BITS // 64)
                for x, y in wide_forest(values, radius):
                    a.append(lo + x)
                    b.append(lo + y)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(a, pa.int64())), rep.take(pa.array(b, pa.int64()))], names=["a", "b"])
        release("")

    return run


def similar_edges(classes: DataFrame, similarity: float = SIMILARITY, hot: int = WIDE_HOT) -> DataFrame:
    """Edges (a, b) between ids `rep` of classes (rep, fp) with wide fingerprints within radius_of(similarity) bits: of each bucket a spanning forest.

    A bucket over `hot` is dealt into blocks of at most about `hot` members, and each two of them are compared, so that none of its
    pairs is missed; blocks grow beyond BLOCKS_OF a bucket, which bounds how often a member travels.
    """
    kind, radius = dict(classes.dtypes)["rep"], radius_of(similarity, BITS)
    keys = spread(classes, "rep", 20 * PARTS * 2 ** (PART_RADIUS + 1)).select("rep", "fp").mapInArrow(_part_keys(similarity), f"rep {kind}, key long")
    prints = classes.select("rep", "fp")
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = keys.join(sizes.where(f"n <= {hot}").select("key"), "key").join(prints, "rep")
    gathered = F.collect_list(F.struct("rep", "fp")).alias("all")
    edges = members.groupBy("key").agg(gathered).select("all").mapInArrow(_wide_forests(radius), f"a {kind}, b {kind}")
    large = sizes.where(f"n > {hot}").withColumn("blocks", F.least(F.ceil(F.col("n") / hot), F.lit(BLOCKS_OF)).cast("int"))
    n_large = large.count()
    if n_large:
        held = keys.join(F.broadcast(large), "key") if n_large <= BROADCAST else join_by_key(cut(keys), large, "key", "n", how="inner")
        place = held.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = place.select("rep", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(prints, "rep")
        parts = int(large.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]) * (BITS // 8 + 40) // CELL_BYTES + 1
        tiles = cells.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").agg(gathered).select("all")
        edges = edges.unionByName(tiles.mapInArrow(_wide_forests(radius), f"a {kind}, b {kind}"))
    return edges.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id, `fp` (signed 64-bit fingerprint), `component_id`.

    component_id is the least id reachable over links of at most `radius` differing bits, the own one included. A null or
    empty text has fingerprint zero and links like any other. Rows with a null id are kept, take no part in linking and get
    a null component_id. Repeated rows are kept; equal fingerprints are one node. An empty table gives an empty result.
    Further columns of docs, whatever their names, aren't read.
    """
    score = lambda texts: {"fp": pa.array([signed(fingerprint(t, width)) for t in texts], pa.int64())}
    prints = cut(map_texts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")), ["_id"], "t", "fp long", score))

    def edges(classes: DataFrame) -> DataFrame:  # a class goes by its least id; a fingerprint has a bounded number of others near it
        found = near_edges(classes, radius, hot)
        for end in ("a", "b"):
            found = found.join(classes.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}")), end)
        return found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    return _grouped(prints, edges).withColumnRenamed("_id", id_col)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, hot: int = WIDE_HOT) -> DataFrame:
    """One row per row of docs: id, `fp` (wide fingerprint, binary), `component_id`: the least id reachable over links of texts whose sets of shingles are estimated to be as similar, the own one included.

    Null and empty texts are alike. Null ids, repeated rows, empty tables and further columns are as in near_duplicates().
    """
    score = lambda texts: {"fp": pa.array([wide_fingerprint(t, width) for t in texts], pa.binary())}
    prints = cut(map_texts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")), ["_id"], "t", "fp binary", score))
    return _grouped(prints, lambda classes: similar_edges(classes, similarity, hot)).withColumnRenamed("_id", id_col)


def _grouped(prints: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_id, fp, component_id) of (_id, fp); edges: of classes (fp, rep: the least id, rows) those between their reps, so that a component's root is its least id."""
    classes = cut(prints.where("_id is not null").groupBy("fp").agg(F.min("_id").alias("rep"), F.count("*").alias("rows")))
    roots = components(edges(classes)).withColumnRenamed("node", "rep")
    named = cut(classes.join(roots, "rep", "left").select(F.col("fp").alias("_key"), "rows", F.coalesce("root", "rep").alias("component_id")))
    found = join_by_key(prints.withColumn("_key", F.when(F.col("_id").isNotNull(), F.col("fp"))), named, "_key", "rows")
    return found.select("_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", find: Callable[..., DataFrame] = similar_documents, **options) -> DataFrame:
    """Docs without all but one document of each group of near-duplicates that `find` gives: that with the least id stays.

    Rows that repeat an id count as one document, and one of them stays; rows with a null id all stay.
    """
    found = find(docs, id_col, **options)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(stay, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
