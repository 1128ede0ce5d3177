import os

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import common, compression, packing, secrets, simhash, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def test_stages_against_brute_force(spark, tmp_path):
    docs = common.documents(spark, DATA)
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        steps.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = steps[-1][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "pack"]
    assert all(after.columns == before.columns for before, after in steps[:-1])
    # quality: exactly the documents that the classifier scores at 0.3 or more
    before, after = steps[0]
    score = compression.train(before, common.documents(spark, DATA, "labels")).scorer()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if score([r["text"] or ""])[0] >= 0.3}
    # near-duplicates: of each component of wide fingerprints within the radius the least id; similar texts are in one component
    before, after = steps[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    prints = {i: int.from_bytes(simhash.wide_fingerprint(t, 5)[:64], "little") for i, t in texts.items()}
    shingles = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    radius, root = simhash.radius_of(0.8, simhash.BITS), {i: i for i in prints}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= radius]
    assert {(a, b) for a in prints for b in prints if a < b and len(shingles[a] & shingles[b]) >= 0.85 * len(shingles[a] | shingles[b])} <= set(near)
    for _ in prints:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i in root if root[i] == i)
    # secrets: no base secret is left, other texts are unchanged
    before, after = steps[2]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    scanner = secrets.scanner_of(secrets.BASE + secrets.ADDED)
    for r in after.collect():
        assert not scanner.spans([(r["text"] or "").encode()])[0]
        assert r["text"] == old[r["doc_id"]] or scanner.spans([old[r["doc_id"]].encode()])[0]
    # mix: words near 150 % of what came in
    before, after = steps[3]
    words = lambda df: sum(len((r["text"] or "").encode().split()) for r in df.collect())
    assert abs(words(after) - 1.5 * words(before)) <= 30
    # pack: every id of every row in one piece
    before, after = steps[4]
    own = tokens.WordTokenizer(packing.vocabulary_path())
    assert sum(len(own.encode(r["text"] or "")) // 4 + 1 for r in before.collect()) == after.selectExpr("sum(length)").first()[0]
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    words = " ".join(f"word{i} and" for i in range(200))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (2, words + " more", None, None), (3, None, "de", "b"), (None, words, "en", "a"), (None, None, None, None), (4, "", "en", "b"), (5, "lorem ipsum " * 30_000, "en", "a"), (6, 'token = "abcdef123456"', "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(3).cast("long") for c in ("n_chars", "size", "key", "fp", "rep", "rows", "taken", "part", "t", "_text", "_id", "_key", "component_id")})
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert empty == (out.count() == 0) and (name == "pack" or out.columns == docs.columns)
        if name == "near_dedup" and not empty:
            kept = [r["doc_id"] for r in out.collect()]
            assert kept.count(1) <= 1 and kept.count(2) == 0
        if name == "mix" and not empty:
            assert all(r["text"] and r["size"] == 3 and r["part"] == 3 for r in out.collect())
        docs = out
