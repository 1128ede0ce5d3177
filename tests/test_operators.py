import collections
import hashlib
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import blocking, clean, context, decisions, diagnostics, keys, metrics, models, sampling, statistics
from kinweave.plans import base, catalogue, linkage, linkage_old, pair_queries
from kinweave.sources import tables
from kinweave.streaming import arrivals


def test_tables(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t A "B" \t\tNA\nS2-2\t"Q\tx\tnull\n')
    rows = [tuple(r) for r in tables.read_source(spark, str(path)).orderBy("entity_id").collect()]
    assert rows == [("S2-1", 'A "B"', "", "NA"), ("S2-2", '"Q', "x", "null")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("entity_id\tx\n1\t2\n")
    with pytest.raises(ValueError, match="business_name"):
        tables.read_source(spark, str(bad))
    records = spark.createDataFrame([("S1-1",), ("S1-2",)], "i1 string")
    links = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-9"), ("S1-1", "S2-9"), ("S1-1", "S1-2")], "i1 string, it string")
    tables.write_lists(records, links, str(tmp_path / "out"))
    back = {r[0]: r[1] for r in tables.read_tsv(spark, str(tmp_path / "out"), tables.TRUTH).collect()}
    assert back == {"S1-1": "S2-9,S3-2", "S1-2": ""}
    truth = tables.read_truth(spark, str(tmp_path / "out"))
    assert tables.truth_links(truth).count() == 2 and tables.owners(tables.truth_links(truth)).count() == 2


def key_rows(spark, rows):
    return spark.createDataFrame(rows, "side string, kind string, key string, rid int")


def test_capped_hits(spark):
    rows = [("s1", "n_key", "a", 1), ("t", "n_key", "a", 10), ("t", "n_key", "a", 10), ("s1", "n_tok", "b", 1), ("t", "n_tok", "b", 10)]
    rows += [("s1", "n_tok", "hot", i) for i in range(1, 9)] + [("t", "n_tok", "hot", 10)]
    found = blocking.candidate_pairs(blocking.capped_hits(key_rows(spark, rows))).collect()
    assert [(r["i1"], r["it"], r["keymask"]) for r in found] == [(1, 10, (1 << list(keys.CAPS).index("n_key")) | (1 << list(keys.CAPS).index("n_tok")))]


def test_keys_over_caps_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("s1", "n_tok", "hot", i) for i in range(1, 9)] + [("t", "n_tok", "hot", 10), ("s1", "n_key", "a", 1), ("t", "n_key", "a", 10), ("t", "n_key", None, 10), ("s1", "n_key", None, 1)]
        found = blocking.capped_hits(key_rows(spark, rows), unique=True)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "LeftAnti" in plan
        assert [(r["key"], r["i1"], r["it"]) for r in found.collect()] == [("a", 1, 10)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["link_fate", "key_contribution", "candidate_recall", "compare_submissions", "test_summary", "oracle_ceiling", "blocking_report", "submission_violations"])
def test_candidates_are_made_once(spark, monkeypatch, name):
    made = []
    docs = spark.createDataFrame([(0, "x y", "en", "src0"), (1, "x y", "en", "src9")], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(base, "table", lambda *_: docs)
    monkeypatch.setattr(pair_queries, "masks", lambda *_: made.append(1) or spark.createDataFrame([(0, 1, 3)], "i1 long, it long, keymask long"))
    catalogue.queries()[name](spark, "")
    assert len(made) == 1


@pytest.mark.parametrize("common", [1, 3, 20_000])
def test_rarest_with_common_words(spark, monkeypatch, common):
    monkeypatch.setattr(statistics, "COMMON", common)
    r = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["a", "b"]), (3, ["a"]), (4, []), (5, ["d", "c", "a"]), (6, None)], "rid int, w array<string>")
    got = {x["rid"]: x["rare"] for x in statistics.rarest(r, "rid", "w", statistics.token_counts(r, "w")).collect()}
    assert got == {1: ["b", "c"], 2: ["b", "a"], 3: ["a"], 4: [], 5: ["d", "c"], 6: []}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", "n_key", "a", 1), ("s1", "n_tok", "b", 2), ("t", "n_key", "a", 10), ("t", "n_tok", "b", 11)]
    known = arrivals.known_keys(key_rows(spark, rows)).cache()
    source = tmp_path / "in"
    key_rows(spark, [r for r in rows if r[0] == "t"]).write.parquet(str(source))
    stream = spark.readStream.schema("side string, kind string, key string, rid int").parquet(str(source))
    arrivals.match_stream(stream, lambda df: df, known, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["i1"], r["it"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 10), (2, 11)}


def test_context_of_single_and_tied(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7), (2, 2, 0.7), (2, 3, 0.1)], "i1 int, it int, v double")
    got = {(r["i1"], r["it"]): (r["g_rank"], r["g_margin"]) for r in df.select("i1", "it", *[c.alias(k) for k, c in context.group_context("i1", "v", "it", "g").items()]).collect()}
    assert got[1, 1] == (0, 1.0) and got[2, 1] == (0, 0.0) and got[2, 2] == (1, 0.0) and got[2, 3][0] == 2


def test_metrics_of_empty_sides(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "i1 int")
    links = "i1 int, it int"
    assert metrics.macro_f05(records, spark.createDataFrame([], links), spark.createDataFrame([], links)).first()["macro_f05"] == 1.0
    got = metrics.macro_f05(records, spark.createDataFrame([(1, 10), (2, 11)], links), spark.createDataFrame([(1, 10), (3, 12)], links)).first()
    assert got["macro_f05"] == pytest.approx(1 / 3)


def test_owner_lists_and_sets(spark):
    p = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.9), (3, 10, 0.5), (3, 11, 0.8)], "i1 int, it int, p double")
    owned = {(r["i1"], r["it"]): r["p"] for r in p.withColumn("p", decisions.one_owner()).collect()}
    assert owned == {(1, 10): 0.9, (2, 10): 0.9, (3, 10): 0.0, (3, 11): 0.8}
    chosen = decisions.expected_f05_sets(p)
    lists = {r["i1"]: r["matches"] for r in decisions.match_lists(spark.createDataFrame([(1,), (4,)], "i1 int"), chosen).collect()}
    assert lists == {1: "10", 4: ""}
    assert decisions.expected_f05_sets(p.limit(0)).count() == 0


def test_statistics(spark):
    r = spark.createDataFrame([(1, ["a", "a", "b"], ""), (2, ["b"], "oh"), (3, [], "")], "rid int, w array<string>, s string")
    assert {x["w"]: x["n"] for x in statistics.token_counts(r, "w").collect()} == {"a": 2, "b": 2}
    assert {x["rid"]: x["rare"] for x in statistics.rarest(r, "rid", "w", statistics.document_counts(r, "w"), 1).collect()} == {1: ["a"], 2: ["b"], 3: []}
    known = spark.createDataFrame([("a",)], "w string")
    assert {x["rid"]: round(x["unk_frac"], 3) for x in statistics.unknown_fraction(r, "rid", "w", known).collect()} == {1: 0.333, 2: 1.0, 3: 1.0}
    votes = statistics.word_states(r, "w", "s", least=1)
    assert {x["rid"]: x["s"] for x in statistics.infer_states(r, "rid", "w", "s", votes).collect()} == {1: "oh", 2: "oh", 3: ""}


def test_folds_and_groups(spark):
    ids = spark.range(100).withColumnRenamed("id", "rid")
    groups = sampling.split_groups(ids, "rid", 10, 20, 5, 1)
    assert {r["grp"]: r["count"] for r in groups.groupBy("grp").count().collect()} == {1: 10, 2: 20, 3: 5}
    assert ids.select(sampling.fold_of(F.col("rid"), 5).alias("f")).distinct().count() == 5


def test_fates(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "i1 int, it int")
    got = {r["it"]: r["fate"] for r in diagnostics.link_fate(t, t.where("it < 3"), t.where("it < 2")).collect()}
    assert got == {1: "kept", 2: "pruned", 3: "never"}


def test_mistakes(spark):
    t = spark.createDataFrame([(1, 1), (1, 2)], "i1 int, it int")
    p = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 4)], "i1 int, it int")
    assert sorted(tuple(r) for r in diagnostics.mistakes(p, t, 5).collect()) == [(1, 1, "missed"), (1, 3, "false"), (2, 4, "false")]
    assert diagnostics.mistakes(p, t, 1).count() == 2


def test_linker_is_kept(spark, tmp_path):
    from kinweave.operators import models
    from kinweave.plans import linkage

    d = spark.range(200).select(F.col("id").alias("i1"), (F.col("id") % 2).alias("y"), (F.col("id") % 2 + F.col("id") / 1000).alias("x"))
    model = models.fit(d, ["x"], trees=2, depth=2, leaf=1)
    scored = models.score(model, d, "raw")
    linker = linkage.Linker(model, model, models.calibration(scored), ["x"], [], ("thr", 0.5, 1.0))
    linker.save(spark, str(tmp_path / "linker"))
    back = linkage.Linker.load(spark, str(tmp_path / "linker"))
    assert back.columns == ["x"] and back.rule == ("thr", 0.5, 1.0)
    assert models.score(back.first, d, "raw").select("raw").collect() == scored.select("raw").collect()


def test_split_groups_is_a_whole_order(spark):
    ids = spark.range(5000).select(F.concat(F.lit("S1-"), "id").alias("i1"))
    got = {r["i1"]: r["grp"] for r in sampling.split_groups(ids, "i1", 2000, 1500, 700, 7).collect()}
    order = sorted((hashlib.md5(f"S1-{i}|7".encode()).hexdigest(), f"S1-{i}") for i in range(5000))
    assert got == {i: 1 if k < 2000 else 2 if k < 3500 else 3 for k, (_, i) in enumerate(order[:4200])}


def test_closure_holds_the_best_claims(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.8), (3, 10, 0.7), (4, 10, 0.6), (2, 11, 0.9), (1, 12, 0.1)], "i1 int, it int, qs double")
    got = {(r["i1"], r["it"]) for r in sampling.closure(pairs, spark.createDataFrame([(1,)], "i1 int"), 3).collect()}
    assert got == {(1, 10), (1, 12), (2, 10), (3, 10)}


def test_text_model_reads_uncertain_pairs(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(400):
        a = [word(), word(), word()]
        b = [*a[:2], word()] if i % 2 else [a[0], word(), word()]
        rows.append((i, " ".join(a), " ".join(b), i % 2, 0.5 if i % 5 else 0.999))
    pairs = spark.createDataFrame(rows, "id int, a_txt string, b_txt string, y int, p1 double")
    model = models.fit_text_model(pairs.where("id < 300"))
    got = models.text_model_scores(model, pairs.where("id >= 300")).collect()
    assert len(got) == 100 and all((r["ce"] == -1) == (r["id"] % 5 == 0) for r in got)
    assert models.auc(models.text_model_scores(model, pairs.where("id >= 300 and p1 < 0.9")), "ce") > 0.9


def test_submission_files_and_settings(spark, tmp_path):
    records = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "i1 string")
    links = lambda *x: spark.createDataFrame(list(x), "i1 string, it string")
    tables.write_submission(records, links(("S1-1", "S2-1"), ("S1-1", "S3-9"), ("S1-2", "S2-5")), links(("S1-1", "S3-9"), ("S1-2", "S2-7")), str(tmp_path))
    read = lambda name: {r[0]: r[1] for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/{name}").na.fill("").collect()}
    assert read("candidate_pairs.tsv") == {"S1-1": "S2-1,S3-9", "S1-2": "S2-5", "S1-3": ""}
    assert read("matching_results.tsv") == {"S1-1": "S3-9", "S1-2": "", "S1-3": ""}
    tables.write_report({"top": 5}, spark, f"{tmp_path}/settings")
    assert tables.read_settings(spark, f"{tmp_path}/settings", {"top": 8, "seed": 7}) == {"top": 5, "seed": 7}
    with pytest.raises(ValueError):
        tables.read_settings(spark, f"{tmp_path}/settings", {"seed": 7})


def test_sources_and_clean_frames(spark, tmp_path):
    text = "entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t\"Quoted\" Ltd\t1 Elm St, OH\tUS\nS2-2\tNo Address\t\tFrance\n"
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("in/Train_source2.tsv", text)
    found = tables.find_files(str(tmp_path))
    assert list(found) == ["train_source2.tsv"]
    got = tables.read_source(spark, str(found["train_source2.tsv"])).collect()
    assert [(r["entity_id"], r["business_name"]) for r in got] == [("S2-1", '"Quoted" Ltd'), ("S2-2", "No Address")]
    cleaned = spark.createDataFrame([("a", "US"), ("b", "France")], "entity_id string, country string")
    tables.write_clean(cleaned, str(tmp_path / "clean"))
    assert [r["entity_id"] for r in tables.read_clean(spark, str(tmp_path / "clean"), "France").collect()] == ["b"] and tables.read_clean(spark, str(tmp_path / "clean")).count() == 2
    (tmp_path / "sub.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2\nS1-2\t\"S2-3\"\n")
    lines = {r["fields"][0]: (len(r["fields"]), r["quoted"], r["spaced"]) for r in tables.read_lines(spark, str(tmp_path / "sub.tsv")).collect()}
    assert lines == {"S1-1": (2, False, True), "S1-2": (2, True, False)}


def test_older_retrieval_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(linkage_old, "MOST", {"A": 3, "B": 3, "C": 2, "D": 1, "R": 1, "cap": 5})
    rnd = random.Random(6)
    word = lambda: rnd.choice(["ab", "abc", "bca", "cab", "caba", "bb", "a"])
    rows = [(i, "S1" if i < 12 else "S2" if i % 2 else "S3", [word() for _ in range(rnd.randint(0, 3))], " ".join(word() for _ in range(4)), rnd.choice(["", "10001", "10002"])) for i in range(40)]
    records = spark.createDataFrame([(i, s, n, f, p, "".join(n)) for i, s, n, f, p in rows], "rid int, source string, name_core array<string>, full string, addr_postcode string, name_nospace string")
    a, b = records.where("source = 'S1'"), records.where("source <> 'S1'")
    got = {(r["i1"], r["it"]): r.asDict() for r in linkage_old.retrieved(a, b, {v: linkage_old.view(records, v) for v in ("name_char", "full_char", "full_word")}).collect()}

    def vectors(texts, low, high):
        def terms(t):
            return t.split() if not high else [w[i : i + n] for w in (f" {x} " for x in t.split()) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

        counts = {i: collections.Counter(terms(t)) for i, t in texts.items()}
        df = collections.Counter(w for c in counts.values() for w in c)
        raw = {i: {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in counts.items()}
        return {i: {w: x / math.sqrt(sum(v * v for v in c.values())) for w, x in c.items()} for i, c in raw.items()}

    name = vectors({r[0]: " ".join(r[2]) for r in rows}, 2, 4)
    full = vectors({r[0]: r[3] for r in rows}, 3, 5)
    words = vectors({r[0]: r[3] for r in rows}, 0, 0)
    cos = lambda v, i, j: sum(x * v[j].get(w, 0) for w, x in v[i].items())
    best = lambda found, k: [j for _, j in sorted(found, key=lambda x: (-round(x[0], 9), x[1]))[:k]]
    flags = collections.defaultdict(set)
    for source in ("S2", "S3"):
        left, right = [r for r in rows if r[1] == "S1"], [r for r in rows if r[1] == source]
        for q in left:
            for k, v in (("A", name), ("B", full), ("C", words)):
                for j in best([(c, t[0]) for t in right if (c := cos(v, q[0], t[0])) > 0], linkage_old.MOST[k]):
                    flags[q[0], j].add(k)
            for j in best([(cos(name, q[0], t[0]), t[0]) for t in right if q[4] and q[4] == t[4]], 1):
                flags[q[0], j].add("D")
            for t in right:
                if q[2] and "".join(q[2]) == "".join(t[2]):
                    flags[q[0], t[0]].add("E")
        for t in right:
            for i in best([(c, q[0]) for q in left if (c := cos(full, q[0], t[0])) > 0], 1):
                flags[i, t[0]].add("R")
    want = set()
    for i in range(12):
        mine = [(max(cos(name, i, j), cos(full, i, j)) + 0.01 * len(k), j) for (x, j), k in flags.items() if x == i]
        want |= {(i, j) for j in best(mine, 5)}
    assert got.keys() == want
    for pair, r in got.items():
        assert {k for k in "ABCDER" if r[f"blk_{k}"]} == flags[pair] and r["cos_full_char"] == pytest.approx(cos(full, *pair))


@pytest.mark.parametrize(("block", "dense"), [(8192, 0.1), (7, 0.3), (3, 2.0)])
def test_nearest_equals_all_pairs(spark, block, dense, monkeypatch):
    """The best by blocks are those of all pairs, ties by the other id among them, and no row per pair leaves an executor."""
    for name, value in (("BLOCK", block), ("DENSE", dense), ("ROWS", 4), ("PRODUCTS", 10)):
        monkeypatch.setattr(blocking, name, value)
    words = lambda i: [f"w{(i * k) % 13}" for k in range(1, 5)] + (["all"] if i % 7 else []) + [f"own{i % 9}"]
    records = spark.createDataFrame([(f"{'a' if i % 3 else 'b'}{i:02}", words(i % 20)) for i in range(50)] + [("a99", []), ("b99", ["alone"])], "rid string, terms array<string>")
    vectors = blocking.tfidf_vectors(records, "rid", "terms").localCheckpoint()
    direct = {(r["rid"], t): round(w, 9) for r in blocking.packed_tfidf(records, "rid", "terms").collect() for t, w in zip(r["terms"], r["ws"], strict=True)}
    often = {r["term"] for r in vectors.groupBy("term").count().where("count > 1").collect()}
    assert direct == {(r["rid"], r["h"]): round(r["w"], 9) for r in vectors.withColumn("h", F.xxhash64("term")).collect() if r["term"] in often}
    left, right = vectors.where("rid < 'b'").withColumnRenamed("rid", "i1"), vectors.where("rid >= 'b'").withColumnRenamed("rid", "it")
    every = blocking.cosine(left, right).localCheckpoint()
    want = {("i1", r["i1"], r["it"]): round(r["cos"], 6) for r in blocking.top_k(every, "i1", "cos", "it", 3).collect()} | {("it", r["i1"], r["it"]): round(r["cos"], 6) for r in blocking.top_k(every, "it", "cos", "i1", 2).collect()}
    found = blocking.nearest(blocking.packed(left, "i1").localCheckpoint(), blocking.packed(right, "it").repartition(3).localCheckpoint(), 3, 2)
    assert {(r["by"], r["i1"], r["it"]): round(r["cos"], 6) for r in found.collect()} == want
    assert found.count() == len(want) and blocking.nearest(blocking.packed(left.limit(0), "i1"), blocking.packed(right, "it"), 1, 1).count() == 0


def test_listed_cosines_equal_loops(spark, monkeypatch):
    monkeypatch.setattr(blocking, "BLOCK", 3)
    monkeypatch.setattr(blocking, "TOGETHER", 4)
    schema = "terms array<long>, ws array<double>"
    left = spark.createDataFrame([("a", [1, 2], [0.6, 0.8]), ("b", [], []), ("c", [5], [1.0])], f"i1 string, {schema}")
    right = spark.createDataFrame([(i, [i % 3, 5], [0.8, 0.6]) for i in range(8)], f"it int, {schema}")
    pairs = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 1), ("c", 2)], "i1 string, it int")
    got = {(r["i1"], r["it"]): round(r["cos"], 9) for r in blocking.pair_cosines(pairs, {"cos": (left, right)}).collect()}
    assert got == {**{("a", i): round(0.8 * (0, 0.6, 0.8)[i % 3], 9) for i in range(8)}, ("b", 1): 0.0, ("c", 2): 0.6}


def test_shared_keys_lose_no_pair_and_leave_lone_keys_out(spark):
    from kinweave.operators import wordkeys

    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("rue", "tal", "mont", "x") for b in ("ar", "ondissement", "9") for c in ("", "e", "ville")] + ["", "KK", "İz", "services"]
    rows = [(i if i else None, rng.choice(["s1", "t"]), rng.choice(["en", ""]), rng.choice(["", "z1", "z2"]), str(i % 3 or ""), rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(6))) + (f" lone{i}" if i % 4 else "")) for i in range(400)]
    rows += [(1000 + i, rng.choice(["s1", "t"]), "en", "z1", "7", "same copy twice") for i in range(60)] + [(2000, "t", "en", "", "1", None)]
    records = spark.createDataFrame(rows, "rid long, side string, country string, state string, num1 string, text string")
    found = wordkeys.shared_keys(records, 12).cache()
    base = records.withColumn("core2", text.alnum_tokens("text")).withColumn("alias", F.filter("core2", lambda w: F.length(w) >= 12)).withColumn("wset", F.array_sort(F.array_distinct("core2")))
    for tokens, counted, out in (("core2", "core2", "rare"), ("alias", "core2", "rare_alias"), ("wset", "wset", "rare_addr")):
        base = base.join(statistics.rarest(base, "rid", tokens, statistics.token_counts(base, counted).cache(), 2, out), "rid", "left")
    known = base.where("rid is not null").withColumn("street", F.array().cast("array<string>"))
    known = known.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("rare", "rare_alias", "rare_addr")})
    every = keys.all_keys(known, list(wordkeys.KINDS)).withColumn("key", F.unhex("key")).cache()
    pairs = lambda k: blocking.capped_hits(k, unique=True).select("kind", "i1", "it", F.hex("key").alias("key")).collect()
    assert sorted(pairs(found)) == sorted(pairs(every)) != []
    rows_of = lambda df: {tuple(r) for r in df.select("side", "kind", F.hex("key"), "rid").collect()}
    assert rows_of(found) <= rows_of(every) and found.count() == len(rows_of(found)) < 0.6 * every.count()


def test_cleaning_computes_each_name_once(spark):
    """Spark copied the expressions of names into each use, 600,000 characters of plan; and all records were one task's."""
    raw = spark.createDataFrame([(f"S2-{i}", f"Old River {i} ltd dba Best", f"{i} oak street, ohio", "US") for i in range(50)], "entity_id string, business_name string, business_address string, country string").coalesce(1)
    assert len(clean.clean_records(raw)._jdf.queryExecution().executedPlan().toString()) < 100_000
    assert linkage.spread(raw, "entity_id", 50).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert linkage.spread(raw, "entity_id", 10 * linkage.TASK_RECORDS + 1).rdd.getNumPartitions() == 11
    row = clean.clean_records(raw).where("entity_id = 'S2-7'").first()
    assert (row["nm_core2"], row["ad_num1"], row["txt"]) == (["old", "river", "7"], "7", "old river 7 ltd dba best | 7 oak street, ohio")
