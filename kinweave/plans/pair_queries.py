"""Queries of context, pruning, similarities, decisions, metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import blocking, context, decisions, diagnostics, keys, metrics, statistics
from ..sources.staging import staged
from .base import PAIRS, REC, TRUTH, pairs, query, rec, rounded, table, truth
from .statistics_queries import HITS, KINDS, MASKS, key_rows, masks


def ctx(group: str, value: str, tie: str, prefix: str) -> str:
    """Rank, margin and size in SQL."""
    return f"""row_number() OVER (PARTITION BY {group} ORDER BY {value} DESC, {tie})::BIGINT - 1 AS {prefix}_rank,
    round(coalesce({value} - CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY {value} DESC, {tie}) = 1 THEN lead({value}) OVER (PARTITION BY {group} ORDER BY {value} DESC, {tie}) ELSE max({value}) OVER (PARTITION BY {group}) END, 1.0), 6) AS {prefix}_margin"""


@query("group_context", f"WITH {PAIRS} SELECT i1, it, {ctx('i1', 'v', 'it', 'g')}, count(*) OVER (PARTITION BY i1)::BIGINT AS g_size FROM pairs")
def group_context(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("i1", "it", *[c.alias(k) for k, c in context.group_context("i1", "v", "it", "g").items()]))


@query("group_context_gap", f"WITH {PAIRS} SELECT i1, it, {ctx('it', 'v', 'i1', 'g')}, count(*) OVER (PARTITION BY it)::BIGINT AS g_size, round(max(v) OVER (PARTITION BY it) - v, 6) AS g_gap_top FROM pairs")
def group_context_gap(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("i1", "it", *[c.alias(k) for k, c in context.group_context("it", "v", "i1", "g", gap=True).items()]))


@query("group_totals", f"WITH {PAIRS} SELECT i1, it, round(max(v) OVER w, 6) AS group_max, round(sum(v) OVER w, 4) AS group_sum, count(*) OVER w::BIGINT AS group_size FROM pairs WINDOW w AS (PARTITION BY i1)".replace("count(*) OVER w::BIGINT", "(count(*) OVER w)::BIGINT"))
def group_totals(spark, sf_dir):
    t = pairs(spark, sf_dir).select("i1", "it", *[c.alias(k) for k, c in context.group_totals("i1", "v").items()])
    return rounded(t).withColumn("group_sum", F.round("group_sum", 4))


def rank(group: str, value: str, tie: str) -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY {value} DESC, {tie})"


PRUNED = f"{PAIRS}, k1 AS (SELECT * FROM pairs QUALIFY {rank('it', 'qs', 'i1')} <= 8 OR {rank('it', 'qn', 'i1')} <= 3 OR {rank('it', 'qa + 0.5 * num_eq', 'i1')} <= 3), k2 AS (SELECT * FROM k1 QUALIFY {rank('i1', 'qs', 'it')} <= 3)"


@query("prune_per_target", f"WITH {PRUNED} SELECT i1, it FROM k1")
def prune_per_target(spark, sf_dir):
    return context.prune_targets(pairs(spark, sf_dir)).select("i1", "it")


@query("prune_per_s1", f"WITH {PRUNED} SELECT i1, it FROM k2")
def prune_per_s1(spark, sf_dir):
    return context.prune_records(context.prune_targets(pairs(spark, sf_dir)), 3).select("i1", "it")


@query("cap_candidates", f"WITH {MASKS}, b AS (SELECT i1, it, bit_count(keymask) AS n FROM masks) SELECT i1, it, n::BIGINT AS n FROM b QUALIFY {rank('i1', 'n', 'it')} <= 80")
def cap_candidates(spark, sf_dir):
    """At most 80 candidates a record, those found by most kinds of keys first: the cap is the operator."""
    return rounded(context.prune_records(masks(spark, sf_dir).select("i1", "it", F.bit_count("keymask").alias("n")), 80, "n"))


@query("candidate_context", f"WITH {PAIRS} SELECT i1, it, " + ", ".join(ctx(g, q, t, f"{n}_{q}") for g, t, n in (("i1", "it", "s1"), ("it", "i1", "tg")) for q in ("qs", "qn", "qa")) + ", (count(*) OVER (PARTITION BY i1))::BIGINT AS s1_ncand, (count(*) OVER (PARTITION BY it))::BIGINT AS tg_ncand FROM pairs")
def candidate_context(spark, sf_dir):
    return rounded(context.candidate_context(pairs(spark, sf_dir).select("i1", "it", "qs", "qn", "qa")).drop("qs", "qn", "qa"))


def ctx_gap(group: str, value: str, tie: str, prefix: str) -> str:
    return f"{ctx(group, value, tie, prefix)}, round(max({value}) OVER (PARTITION BY {group}) - {value}, 6) AS {prefix}_gap_top"


@query("candidate_context_v1", f"WITH {PAIRS} SELECT i1, it, " + ", ".join(ctx_gap(g, q, t, f"{n}_{q}") for g, t, n in (("i1", "it", "s1"), ("it", "i1", "tg")) for q in ("qs", "qn", "qa")) + f", {ctx_gap('i1, flag', 'qs', 'it', 's1src_qs')}, (count(*) OVER (PARTITION BY i1))::BIGINT AS s1_n_cand, (count(*) OVER (PARTITION BY it))::BIGINT AS tg_n_cand FROM pairs")
def candidate_context_v1(spark, sf_dir):
    p = pairs(spark, sf_dir).select("i1", "it", "qs", "qn", "qa", "flag")
    return rounded(context.candidate_context_old(p, ("qs", "qn", "qa"), "flag").drop("qs", "qn", "qa", "flag"))


@query(
    "stage2_features_v1",
    f"""WITH {PAIRS}, t AS (SELECT i1, it, p, qs, flag FROM pairs QUALIFY {rank('i1', 'p', 'it')} <= 10),
    r AS (SELECT a.i1, a.it, least(1 - abs(a.qs - b.qs), b.p) AS s, a.flag <> b.flag AS x FROM t a JOIN t b ON a.i1 = b.i1 AND a.it <> b.it),
    s AS (SELECT i1, it, max(s) FILTER (WHERE NOT x) AS a, max(s) FILTER (WHERE x) AS b FROM r GROUP BY i1, it)
    SELECT i1, it, round(p, 6) AS p1, {ctx_gap('i1', 'p', 'it', 's1_p1')}, {ctx_gap('it', 'p', 'i1', 'tg_p1')}, round(sum(p) OVER (PARTITION BY i1), 6) AS s1_p1_sum, round(sum(p) OVER (PARTITION BY it), 6) AS tg_p1_sum,
      (count(*) FILTER (WHERE p > 0.5) OVER (PARTITION BY i1))::BIGINT AS s1_n_p50, round(coalesce(a, 0), 6) AS sup_same_src, round(coalesce(b, 0), 6) AS sup_cross_src FROM pairs LEFT JOIN s USING (i1, it)""",
)
def stage2_features_v1(spark, sf_dir):
    """The twelve second-stage columns of the older rules; likeness of targets stands for the cosine of their texts."""
    p = pairs(spark, sf_dir).withColumnRenamed("p", "p1")
    r = context.support_pairs(p, "p1", ["qs", "flag"], 10).withColumn("sim", 1 - F.abs(F.col("qs") - F.col("qs_o"))).withColumn("cross", F.col("flag") != F.col("flag_o"))
    return rounded(context.support(context.probability_context_old(p.select("i1", "it", "p1")), r).drop("sup_n_strong"))


@query("cap_by_cosines", f"WITH {PAIRS} SELECT i1, it FROM pairs QUALIFY row_number() OVER (PARTITION BY i1 ORDER BY round(greatest(qs, qn) + 0.01 * num_eq, 9) DESC, it) <= 3")
def cap_by_cosines(spark, sf_dir):
    """At most three candidates a record: the cap is the operator."""
    return blocking.cap_by_cosines(pairs(spark, sf_dir), ["qs", "qn"], 3, "num_eq").select("i1", "it")


@query("p_context", f"WITH {PAIRS} SELECT i1, it, {ctx('i1', 'p', 'it', 's1_p1')}, round(sum(p) OVER (PARTITION BY i1), 6) AS s1_p1_sum, (count(*) FILTER (WHERE p > 0.5) OVER (PARTITION BY i1))::BIGINT AS s1_p1_n50 FROM pairs")
def p_context(spark, sf_dir):
    p = pairs(spark, sf_dir).select("i1", "it", F.col("p").alias("p1"))
    return rounded(context.probability_context(p).drop("p1"))


@query(
    "support_features",
    f"""WITH {PAIRS}, t AS (SELECT i1, it, p, qs, flag FROM pairs QUALIFY {rank('i1', 'p', 'it')} <= 6),
    r AS (SELECT a.i1, a.it, b.p AS po, 1 - abs(a.qs - b.qs) AS sim, a.flag <> b.flag AS x FROM t a JOIN t b ON a.i1 = b.i1 AND a.it <> b.it),
    s AS (SELECT i1, it, max(least(sim, po)) FILTER (WHERE NOT x) AS a, max(least(sim, po)) FILTER (WHERE x) AS b, count(*) FILTER (WHERE sim > 0.8 AND po > 0.5) AS c FROM r GROUP BY i1, it)
    SELECT i1, it, round(coalesce(a, 0), 6) AS sup_same_src, round(coalesce(b, 0), 6) AS sup_cross_src, coalesce(c, 0)::BIGINT AS sup_n_strong FROM pairs LEFT JOIN s USING (i1, it)""",
)
def support_features(spark, sf_dir):
    p = pairs(spark, sf_dir)
    r = context.support_pairs(p, "p", ["qs", "flag"]).withColumn("sim", 1 - F.abs(F.col("qs") - F.col("qs_o"))).withColumn("cross", F.col("flag") != F.col("flag_o"))
    return rounded(context.support(p.select("i1", "it"), r))


NAMES_SQL = "SELECT a.p_partkey AS i1, b.s_suppkey AS it, lower(a.p_name) AS x, lower(b.s_name) AS y FROM part a JOIN supplier b ON a.p_partkey % (SELECT count(*) FROM supplier) + 1 = b.s_suppkey UNION ALL SELECT a.p_partkey, -b.p_partkey, lower(a.p_name), lower(b.p_name) FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey"


def name_pairs(spark, sf_dir):
    """Names of parts with those of suppliers and of the next part."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n = s.count()
    one = p.join(s, p.p_partkey % n + 1 == s.s_suppkey).select(F.col("p_partkey").alias("i1"), F.col("s_suppkey").alias("it"), F.lower("p_name").alias("x"), F.lower("s_name").alias("y"))
    b = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"))
    two = p.join(b, p.p_partkey + 1 == b.k).select(F.col("p_partkey").alias("i1"), (-F.col("k")).alias("it"), F.lower("p_name").alias("x"), F.lower("n").alias("y"))
    return one.unionByName(two)


@query("levenshtein_sim", f"WITH n AS ({NAMES_SQL}) SELECT i1, it, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS s FROM n")
def levenshtein_sim(spark, sf_dir):
    return rounded(name_pairs(spark, sf_dir).select("i1", "it", sim.levenshtein_similarity("x", "y").alias("s")))


@query("jaro_winkler_sim", f"WITH n AS ({NAMES_SQL}) SELECT i1, it, round(jaro_winkler_similarity(x, y), 6) AS s FROM n")
def jaro_winkler_sim(spark, sf_dir):
    return rounded(name_pairs(spark, sf_dir).select("i1", "it", sim.measure("jaro_winkler", "x", "y").alias("s")))


def common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts in SQL: a row of the table by each letter of a."""
    step = f"list_transform(range(1, length({b}) + 2), lambda j: greatest(row[j], coalesce(list_max(list_transform(range(2, j + 1), lambda k: CASE WHEN ({b})[k - 1] = x THEN row[k - 1] + 1 ELSE 0 END)), 0)))"
    return f"list_reduce(CASE WHEN {a} = '' THEN [] ELSE string_split({a}, '') END, lambda row, x: {step}, list_transform(range(0, length({b}) + 1), lambda i: 0))[-1]"


def indel_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * {common_sql(a, b)} / (length({a}) + length({b})) END"


SORTED = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda w: w <> '')), ' ')"
SETS_SQL = f"""n AS ({NAMES_SQL}), t AS (SELECT i1, it, list_distinct(list_filter(string_split(x, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(y, ' '), lambda w: w <> '')) AS y FROM n),
  u AS (SELECT i1, it, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS nb, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS p,
        array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS q, length(array_to_string(list_intersect(x, y), ' ')) AS c FROM t),
  v AS (SELECT *, CASE WHEN c > 0 THEN 1 ELSE 0 END AS g, {common_sql("p", "q")} AS l FROM u)"""
PARTIAL_SQL = f"""o AS (SELECT i1, it, CASE WHEN length(x) > length(y) THEN y ELSE x END AS a, CASE WHEN length(x) > length(y) THEN x ELSE y END AS b FROM ({NAMES_SQL})),
  d AS (SELECT DISTINCT a, b FROM o), r AS (SELECT a, b FROM d UNION SELECT b, a FROM d WHERE length(a) = length(b)),
  w AS (SELECT a, b, substr(b, greatest(i, 0) + 1, least(length(a), length(a) + i)) AS s FROM (SELECT a, b, unnest(range(1 - length(a), length(b))) AS i FROM r)),
  z AS (SELECT a, b, max({indel_sql("a", "s")}) AS m FROM w GROUP BY a, b)"""
RATIOS = {
    "indel_ratio": ("indel", f"WITH n AS ({NAMES_SQL}) SELECT i1, it, round({indel_sql('x', 'y')}, 6) AS s FROM n"),
    "partial_ratio": ("partial", f"WITH {PARTIAL_SQL} SELECT i1, it, round(greatest(z.m, coalesce(k.m, 0)), 6) AS s FROM o JOIN z USING (a, b) LEFT JOIN z k ON k.a = o.b AND k.b = o.a"),
    "token_sort_ratio": ("token_sort", f"WITH n AS ({NAMES_SQL}), t AS (SELECT i1, it, {SORTED.format('x')} AS p, {SORTED.format('y')} AS q FROM n) SELECT i1, it, round({indel_sql('p', 'q')}, 6) AS s FROM t"),
    "token_set_ratio": (
        "token_set",
        f"""WITH {SETS_SQL} SELECT i1, it, round(CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN nb > 0 AND (nb = nx OR nb = ny) THEN 1.0 ELSE
        greatest(1 - (length(p) + length(q) - 2 * l) / (2 * (c + g) + length(p) + length(q)), CASE WHEN c > 0 THEN 1 - (g + length(p)) / (2 * c + g + length(p)) ELSE 0 END, CASE WHEN c > 0 THEN 1 - (g + length(q)) / (2 * c + g + length(q)) ELSE 0 END) END, 6) AS s FROM v""",
    ),
}


def _register_measure(name: str, kind: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return rounded(name_pairs(spark, sf_dir).select("i1", "it", sim.measure(kind, "x", "y").alias("s")))


for _name, (_kind, _sql) in RATIOS.items():
    _register_measure(_name, _kind, _sql)


@query("alias_best", f"WITH n AS ({NAMES_SQL}), w AS (SELECT i1, it, p, unnest(string_split(y, ' ')) AS q FROM (SELECT i1, it, unnest(string_split(x, ' ')) AS p, y FROM n)) SELECT i1, it, round(max(CASE WHEN p = '' OR q = '' THEN 0.0 ELSE {indel_sql('p', 'q')} END), 6) AS s FROM w GROUP BY i1, it")
def alias_best(spark, sf_dir):
    p = name_pairs(spark, sf_dir).withColumn("a", F.split("x", " ")).withColumn("b", F.split("y", " "))
    return rounded(p.select("i1", "it", sim.measure("alias_best", "a", "b").alias("s")))


WEIGHED = f"""{REC}, {TRUTH}, c AS (SELECT w, count(*) AS n FROM (SELECT unnest(toks) AS w FROM rec) GROUP BY w), d AS (SELECT DISTINCT doc_id, unnest(toks) AS w FROM rec),
  z AS (SELECT doc_id, w, ln((SELECT count(*) FROM rec) / n) AS idf FROM d JOIN c USING (w)), near_ AS (SELECT i1, it FROM truth UNION SELECT a.doc_id, b.doc_id FROM rec a JOIN rec b ON b.doc_id = a.doc_id + 1),
  s AS (SELECT i1, it, sum(x.idf) AS wi, count(*) AS n, max(x.idf) AS top FROM near_ JOIN z x ON x.doc_id = i1 JOIN z y ON y.doc_id = it AND y.w = x.w GROUP BY i1, it),
  t AS (SELECT doc_id, sum(idf) AS w, count(*) AS n FROM z GROUP BY doc_id),
  e AS (SELECT i1, it, coalesce(s.n, 0) AS n, coalesce(wi, 0) AS wi, coalesce(top, 0) AS top, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, coalesce(a.w, 0) - coalesce(wi, 0) AS wa, coalesce(b.w, 0) - coalesce(wi, 0) AS wb
        FROM near_ LEFT JOIN s USING (i1, it) LEFT JOIN t a ON a.doc_id = i1 LEFT JOIN t b ON b.doc_id = it)"""


def weighed_pairs(spark, sf_dir):
    """Pairs of copies and of neighbours, with the documents' weighed words a and b."""
    r = rec(spark, sf_dir)
    idf = statistics.idf(statistics.token_counts(r, "toks"), F.lit(r.count()))
    w = statistics.weigh_tokens(r, "doc_id", "toks", idf, 12.0, "words")
    ids = r.select("doc_id")
    near = truth(r).unionByName(ids.select(F.col("doc_id").alias("i1")).join(ids.select(F.col("doc_id").alias("it")), F.col("it") == F.col("i1") + 1)).distinct()
    return near.join(w.select(F.col("doc_id").alias("i1"), F.col("words").alias("a")), "i1").join(w.select(F.col("doc_id").alias("it"), F.col("words").alias("b")), "it")


@query("set_features", f"WITH {WEIGHED} SELECT i1, it, round(CASE WHEN na = 0 OR nb = 0 THEN -1.0 ELSE n / least(na, nb) END, 6) AS contain, round(CASE WHEN na = 0 OR nb = 0 THEN -1.0 ELSE wi / (wi + wa + wb + 1e-9) END, 5) AS wjac, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE wa END, 3) AS unexpl_a, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE wb END, 3) AS unexpl_b FROM e")
def set_features(spark, sf_dir):
    f = weighed_pairs(spark, sf_dir).withColumn("f", sim.set_features(F.col("a"), F.col("b")))
    return f.select("i1", "it", F.round("f.contain", 6).alias("contain"), F.round("f.wjac", 5).alias("wjac"), F.round("f.unexpl_a", 3).alias("unexpl_a"), F.round("f.unexpl_b", 3).alias("unexpl_b"))


@query("token_evidence", f"WITH {WEIGHED} SELECT i1, it, round(CASE WHEN na = 0 OR nb = 0 THEN -1.0 ELSE wi / (wi + wa + wb) END, 5) AS wjac, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE top END, 6) AS max_idf, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE n END::BIGINT AS n_shared, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE n / least(na, nb) END, 6) AS overlap FROM e")
def token_evidence(spark, sf_dir):
    f = weighed_pairs(spark, sf_dir).withColumn("f", sim.token_evidence(F.col("a"), F.col("b")))
    return f.select("i1", "it", F.round("f.wjac", 5).alias("wjac"), F.round("f.max_idf", 6).alias("max_idf"), F.col("f.n_shared").cast("long").alias("n_shared"), F.round("f.overlap", 6).alias("overlap"))


NUMS = f"{REC}, n AS (SELECT doc_id, list_distinct(list_filter(toks, lambda w: regexp_matches(w, '^[0-9]+$'))) AS ns FROM rec), q AS (SELECT a.doc_id AS i1, b.doc_id AS it, a.ns AS a, b.ns AS b FROM n a JOIN n b ON b.doc_id = a.doc_id + 1)"


def number_pairs(spark, sf_dir):
    n = rec(spark, sf_dir).select("doc_id", F.array_distinct(F.filter("toks", lambda w: w.rlike("^[0-9]+$"))).alias("ns"))
    a, b = n.toDF("i1", "a"), n.toDF("it", "b")
    return a.join(b, F.col("it") == F.col("i1") + 1)


@query("num_features_v2", f"WITH {NUMS} SELECT i1, it, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN -1.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS contain, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(a) + len(b) - 2 * len(list_intersect(a, b)) END::BIGINT AS symdiff FROM q")
def num_features_v2(spark, sf_dir):
    f = number_pairs(spark, sf_dir).withColumn("f", sim.number_features(F.col("a"), F.col("b")))
    return rounded(f.select("i1", "it", "f.contain", "f.symdiff"))


TRI = "CASE WHEN {0} = '' OR {1} = '' THEN 0 WHEN {0} = {1} THEN 1 ELSE -1 END"


@query(
    "num_features_v1",
    f"""WITH {NUMS}, h AS (SELECT i1, it, a, b, coalesce(list_filter(a, lambda x: length(x) >= 4)[1], '') AS pa, coalesce(list_filter(b, lambda x: length(x) >= 4)[1], '') AS pb, coalesce(a[1], '') AS ha, coalesce(b[1], '') AS hb FROM q)
    SELECT i1, it, {TRI.format("pa", "pb")}::BIGINT AS pc_state, (pa <> '' AND pb <> '' AND substr(pa, 1, 3) = substr(pb, 1, 3))::BIGINT AS pc3_eq, {TRI.format("ha", "hb")}::BIGINT AS house_state,
    round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE -1.0 END, 6) AS num_jac,
    CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(a) + len(b) - 2 * len(list_intersect(a, b)) ELSE 0 END::BIGINT AS num_conflict, (len(a) > 0 AND len(b) > 0)::BIGINT AS num_both FROM h""",
)
def num_features_v1(spark, sf_dir):
    first = lambda c, n: F.coalesce(F.get(F.filter(c, lambda x: F.length(x) >= n), F.lit(0)), F.lit(""))
    f = number_pairs(spark, sf_dir).withColumn("f", sim.number_features_old(F.col("a"), F.col("b"), first("a", 4), first("b", 4), first("a", 1), first("b", 1)))
    return rounded(f.select("i1", "it", "f.*"))


@query("tri_state", f"WITH {REC} SELECT a.doc_id AS i1, b.doc_id AS it, {TRI.format('a.state', 'b.state')}::BIGINT AS s FROM rec a JOIN rec b ON b.doc_id = a.doc_id + 1")
def tri_state(spark, sf_dir):
    r = rec(spark, sf_dir).select("doc_id", "state")
    return rounded(r.toDF("i1", "a").join(r.toDF("it", "b"), F.col("it") == F.col("i1") + 1).select("i1", "it", sim.tri_state("a", "b").alias("s")))


@query("one_owner", f"WITH {PAIRS} SELECT i1, it, round(CASE WHEN p >= max(p) OVER (PARTITION BY it) - 1e-9 THEN p ELSE 0.0 END, 6) AS p FROM pairs")
def one_owner(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("i1", "it", decisions.one_owner().alias("p")))


@query("one_owner_strength", f"WITH {PAIRS} SELECT i1, it, round(CASE WHEN p >= max(p) OVER (PARTITION BY it) - 1e-12 THEN p ELSE p * 0.5 END, 6) AS p FROM pairs")
def one_owner_strength(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("i1", "it", decisions.one_owner(strength=0.5, tolerance=1e-12).alias("p")))


@query("threshold_sets", f"WITH {PAIRS}, s AS (SELECT i1, string_agg(it::VARCHAR, ',' ORDER BY it::VARCHAR) AS m FROM pairs WHERE p >= 0.6 GROUP BY i1) SELECT DISTINCT i1, coalesce(m, '') AS matches FROM pairs LEFT JOIN s USING (i1)")
def threshold_sets(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return decisions.match_lists(p.select("i1").distinct(), decisions.threshold_sets(p, 0.6))


RULES_SQL = " UNION ALL ".join(f"SELECT 'thr{t}_{n}' AS rule, i1, it FROM o WHERE {c} >= {t}" for t in decisions.THRESHOLDS for c, n in (("p", "any"), ("q", "owner")))
F05_SQL = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"


@query(
    "rule_grid_scores",
    f"""WITH {PAIRS}, o AS (SELECT i1, it, p, CASE WHEN p >= max(p) OVER (PARTITION BY it) - 1e-9 THEN p ELSE 0.0 END AS q FROM pairs), r AS ({RULES_SQL}),
    n AS (SELECT rule, i1, count(*) AS n_pred, count(*) FILTER (WHERE qs > 0.5) AS tp FROM r JOIN pairs USING (i1, it) GROUP BY rule, i1),
    t AS (SELECT i1, count(*) FILTER (WHERE qs > 0.5) AS n_true FROM pairs GROUP BY i1), a AS (SELECT DISTINCT rule FROM r),
    f AS (SELECT a.rule, t.i1, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM t CROSS JOIN a LEFT JOIN n ON n.rule = a.rule AND n.i1 = t.i1)
    SELECT rule, round(avg({F05_SQL}), 6) AS macro_f05 FROM f GROUP BY rule""",
)
def rule_grid_scores(spark, sf_dir):
    """Score of every threshold rule, from one pass: records without chosen pairs count 1 or 0 by whether they have true ones."""
    p = pairs(spark, sf_dir)
    grid = decisions.threshold_grid(p).join(p.select("i1", "it", (F.col("qs") > 0.5).cast("int").alias("y")), ["i1", "it"])
    per = grid.groupBy("rule", "i1").agg(F.count("*").alias("n_pred"), F.sum("y").alias("tp"))
    true = p.groupBy("i1").agg(F.sum((F.col("qs") > 0.5).cast("int")).alias("n_true"))
    scored = per.join(true, "i1").withColumn("f", metrics.f05())
    # Records without a chosen pair score 1 if nothing is true; they are what the sums per rule lack.
    empty = true.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("z"))
    sums = scored.groupBy("rule").agg(F.sum("f").alias("f"), F.count_if(F.col("n_true") == 0).alias("z0"))
    return rounded(sums.crossJoin(F.broadcast(empty)).select("rule", ((F.col("f") + F.col("z") - F.col("z0")) / F.col("n")).alias("macro_f05")))


def expected_sql(most: int, whole: bool) -> str:
    """The choice in SQL, by all worlds of a record's candidates: each true or not, weighed by its probability."""
    bound = "" if whole else f"QUALIFY r <= {most}"
    return f"""WITH {PAIRS}, r AS (SELECT i1, it, p, row_number() OVER (PARTITION BY i1 ORDER BY p DESC, it) AS r FROM pairs WHERE p > 1e-4 {bound}),
    n AS (SELECT i1, max(r)::INT AS n FROM r GROUP BY i1), w AS (SELECT i1, n, unnest(range(0, (1::BIGINT << n)::BIGINT)) AS w FROM n),
    x AS (SELECT i1, n, w, product(CASE WHEN (w >> (r - 1)::INT) & 1 = 1 THEN p ELSE 1 - p END) AS q FROM w JOIN r USING (i1) GROUP BY i1, n, w),
    k AS (SELECT i1, w, q, unnest(range(0, least(n, {most}) + 1)) AS k FROM x), t AS (SELECT *, bit_count(w) AS truly, bit_count(w & ((1::BIGINT << k::INT) - 1)) AS tp FROM k),
    e AS (SELECT i1, k, round(sum(q * CASE WHEN k = 0 THEN (truly = 0)::INT WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (truly - tp) + (k - tp)) END), 11) AS e FROM t GROUP BY i1, k),
    b AS (SELECT i1, k FROM e QUALIFY row_number() OVER (PARTITION BY i1 ORDER BY e DESC, k) = 1) SELECT i1, it FROM r JOIN b USING (i1) WHERE r <= k"""


@query("expected_f05_sets", expected_sql(12, False))
def expected_f05_sets(spark, sf_dir):
    return decisions.expected_f05_sets(pairs(spark, sf_dir).select("i1", "it", "p")).select("i1", "it")


@query("expected_f05_sets_whole", expected_sql(20, True))
def expected_f05_sets_whole(spark, sf_dir):
    return decisions.expected_f05_sets(pairs(spark, sf_dir).select("i1", "it", "p"), most=20, whole=True).select("i1", "it")


LINKS = f"{MASKS}, {TRUTH}, pred AS (SELECT i1, it FROM masks WHERE bit_count(keymask) >= 2), ids AS (SELECT doc_id AS i1, country FROM rec WHERE side = 's1')"
PER = """per AS (SELECT ids.i1, country, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true, coalesce(b.n, 0) AS tp FROM ids LEFT JOIN (SELECT i1, count(*) AS n FROM {0} GROUP BY i1) p ON p.i1 = ids.i1
  LEFT JOIN (SELECT i1, count(*) AS n FROM truth GROUP BY i1) t ON t.i1 = ids.i1 LEFT JOIN (SELECT i1, count(*) AS n FROM truth JOIN {0} USING (i1, it) GROUP BY i1) b ON b.i1 = ids.i1)"""


def linked(spark, sf_dir):
    """Clean records, pairs found by two kinds of keys, true links."""
    return records(spark, sf_dir), strong(masks(spark, sf_dir)), truth(rec(spark, sf_dir))


def records(spark, sf_dir):
    return rec(spark, sf_dir).where("side = 's1'").select(F.col("doc_id").alias("i1"), "country")


def strong(found):
    """Of pairs with key masks those found by two kinds of keys."""
    return found.where(F.bit_count("keymask") >= 2).select("i1", "it")


@query("macro_f05", f"WITH {LINKS}, {PER.format('pred')} SELECT round(avg({F05_SQL}), 6) AS macro_f05, count(*)::BIGINT AS n FROM per")
def macro_f05(spark, sf_dir):
    return rounded(metrics.macro_f05(*linked(spark, sf_dir)))


@query("f05_breakdown", f"WITH {LINKS}, {PER.format('pred')}, f AS (SELECT country, n_true, {F05_SQL} AS f FROM per) SELECT CASE WHEN n_true = 0 THEN 'singleton' ELSE 'has_match' END AS key, round(avg(f), 6) AS f05, count(*)::BIGINT AS n FROM f GROUP BY 1 UNION ALL SELECT 'country=' || country, round(avg(f), 6), count(*)::BIGINT FROM f GROUP BY 1")
def f05_breakdown(spark, sf_dir):
    return rounded(metrics.breakdown(*linked(spark, sf_dir)))


CEILING = "CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END"


@query("blocking_report", f"WITH {LINKS}, {PER.format('masks')} SELECT round(sum(tp) / greatest(sum(n_true), 1), 6) AS pair_recall, sum(n_true)::BIGINT AS n_true_pairs, sum(n_pred)::BIGINT AS n_candidates, round(sum(n_pred) / count(*), 6) AS avg_cand_per_s1, round(1 - sum(n_pred) / (count(*) * (SELECT count(*) FROM rec WHERE side = 't')), 6) AS reduction_ratio, round(avg({CEILING}), 6) AS oracle_macro_f05 FROM per")
def blocking_report(spark, sf_dir):
    n = rec(spark, sf_dir).where("side = 't'").count()
    return rounded(metrics.blocking_report(records(spark, sf_dir), masks(spark, sf_dir), truth(rec(spark, sf_dir)), n))


@query("candidate_recall", f"WITH {LINKS} SELECT country, count(*)::BIGINT AS n_true, count(m.i1)::BIGINT AS n_found FROM truth JOIN ids USING (i1) LEFT JOIN masks m USING (i1, it) GROUP BY country")
def candidate_recall(spark, sf_dir):
    m = masks(spark, sf_dir).select("i1", "it", F.lit(1).alias("hit"))
    return truth(rec(spark, sf_dir)).join(records(spark, sf_dir), "i1").join(m, ["i1", "it"], "left").groupBy("country").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))


@query("oracle_ceiling", f"WITH {LINKS}, {PER.format('masks')} SELECT country, round(avg({CEILING}), 6) AS ceiling FROM per GROUP BY country")
def oracle_ceiling(spark, sf_dir):
    true = truth(rec(spark, sf_dir))
    found = true.join(masks(spark, sf_dir).select("i1", "it"), ["i1", "it"], "left_semi")
    return rounded(metrics.hits(records(spark, sf_dir), found, true, ["country"]).groupBy("country").agg(F.avg(metrics.f05()).alias("ceiling")))


SUBMITTED = f"""{LINKS}, cand AS (SELECT ids.i1, coalesce(string_agg(it::VARCHAR, ',' ORDER BY it::VARCHAR), '') AS matches FROM ids LEFT JOIN masks USING (i1) GROUP BY ids.i1),
  sub AS (SELECT i1, CASE WHEN i1 % 7 = 1 THEN matches || ',999999999' WHEN i1 % 7 = 2 AND matches <> '' THEN matches || ',' || string_split(matches, ',')[1] WHEN i1 % 7 = 3 THEN matches || ' ' ELSE matches END AS matches FROM cand WHERE i1 % 11 <> 5
          UNION ALL SELECT i1, matches FROM cand WHERE i1 % 13 = 4 AND i1 % 11 <> 5 UNION ALL SELECT -1, ''),
  links AS (SELECT i1, unnest(list_filter(string_split(matches, ','), lambda x: x <> '')) AS it FROM sub), allowed AS (SELECT i1, unnest(list_filter(string_split(matches, ','), lambda x: x <> '')) AS it FROM cand)"""


def submitted(spark, sf_dir):
    """A submission with faults of every kind planted, its candidates, records, targets."""
    ids = records(spark, sf_dir).select("i1")
    cand = staged(decisions.match_lists(ids, masks(spark, sf_dir)))
    m, i = F.col("matches"), F.col("i1")
    faulty = F.when(i % 7 == 1, F.concat(m, F.lit(",999999999"))).when((i % 7 == 2) & (m != ""), F.concat(m, F.lit(","), F.get(F.split(m, ","), F.lit(0)))).when(i % 7 == 3, F.concat(m, F.lit(" "))).otherwise(m)
    sub = cand.where(i % 11 != 5).select("i1", faulty.alias("matches")).unionByName(cand.where((i % 13 == 4) & (i % 11 != 5))).unionByName(spark.createDataFrame([(-1, "")], "i1 long, matches string"))
    return sub, cand, ids, rec(spark, sf_dir).where("side = 't'").select(F.col("doc_id").alias("it"))


@query(
    "submission_violations",
    f"""WITH {SUBMITTED} SELECT 'duplicate_record' AS rule, count(*)::BIGINT AS n FROM (SELECT i1 FROM sub GROUP BY i1 HAVING count(*) > 1)
    UNION ALL SELECT 'missing_record', count(*) FROM ids WHERE i1 NOT IN (SELECT i1 FROM sub) UNION ALL SELECT 'unknown_record', count(*) FROM sub WHERE i1 NOT IN (SELECT i1 FROM ids)
    UNION ALL SELECT 'repeated_target', count(*) FROM sub WHERE len(list_filter(string_split(matches, ','), lambda x: x <> '')) <> len(list_distinct(list_filter(string_split(matches, ','), lambda x: x <> '')))
    UNION ALL SELECT 'unknown_target', count(*) FROM links WHERE it NOT IN (SELECT doc_id::VARCHAR FROM rec WHERE side = 't')
    UNION ALL SELECT 'quote_or_space', count(*) FROM sub WHERE regexp_matches(matches, '["\\s]')
    UNION ALL SELECT 'not_a_candidate', count(*) FROM (SELECT i1, it FROM links EXCEPT SELECT i1, it FROM allowed)""",
)
def submission_violations(spark, sf_dir):
    return metrics.violations(*submitted(spark, sf_dir))


@query(
    "compare_submissions",
    f"""WITH {LINKS}, a AS (SELECT ids.i1, country, list(m.it) FILTER (WHERE m.it IS NOT NULL) AS a FROM ids LEFT JOIN masks m USING (i1) GROUP BY ALL), b AS (SELECT ids.i1, list(p.it) FILTER (WHERE p.it IS NOT NULL) AS b FROM ids LEFT JOIN pred p USING (i1) GROUP BY ALL),
    x AS (SELECT country, coalesce(len(a), 0) AS na, coalesce(len(b), 0) AS nb, coalesce(len(list_intersect(a, b)), 0) AS s, (list_sort(coalesce(a, [])) = list_sort(coalesce(b, [])))::INT AS same FROM a JOIN b USING (i1))
    SELECT coalesce(country, 'ALL') AS country, round(avg(na), 6) AS a_per_s1, round(avg(nb), 6) AS b_per_s1, round(avg((na = 0)::INT), 6) AS a_empty, round(avg((nb = 0)::INT), 6) AS b_empty,
    round(sum(s) / greatest(sum(na), 1), 6) AS shared_of_a, round(sum(s) / greatest(sum(nb), 1), 6) AS shared_of_b, round(avg(same), 6) AS same_list FROM x GROUP BY ROLLUP (country)""",
)
def compare_submissions(spark, sf_dir):
    ids, found = records(spark, sf_dir), masks(spark, sf_dir)
    a, b = decisions.match_lists(ids, found), decisions.match_lists(ids, strong(found))
    return rounded(metrics.compare_lists(a, b, ids))


@query("profile_report", f"""WITH {REC}, {TRUTH}, p AS (SELECT doc_id, coalesce(n, 0) AS n FROM rec LEFT JOIN (SELECT i1, count(*) AS n FROM truth GROUP BY i1) ON i1 = doc_id WHERE side = 's1'),
  t AS (SELECT doc_id, n FROM rec LEFT JOIN (SELECT it, count(*) AS n FROM truth GROUP BY it) ON it = doc_id WHERE side = 't')
  SELECT 'n_s1' AS metric, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'singleton_share', round(avg((n = 0)::INT), 6) FROM p UNION ALL SELECT 'max_matches', max(n)::DOUBLE FROM p UNION ALL SELECT 'mean_matches', round(avg(n), 6) FROM p
  UNION ALL SELECT 'n_targets', count(*)::DOUBLE FROM t UNION ALL SELECT 'multi_owner', count(*) FILTER (WHERE n > 1)::DOUBLE FROM t UNION ALL SELECT 'never_matched', round(avg((n IS NULL)::INT), 6) FROM t""".replace("count(*) FILTER (WHERE n > 1)::DOUBLE", "(count(*) FILTER (WHERE n > 1))::DOUBLE"))  # fmt: skip
def profile_report(spark, sf_dir):
    r = rec(spark, sf_dir)
    return rounded(metrics.profile(r.where("side = 's1'").select(F.col("doc_id").alias("i1")), truth(r), r.where("side = 't'").select(F.col("doc_id").alias("it"))))


@query("test_summary", f"WITH {LINKS}, n AS (SELECT ids.i1, country, count(m.it) AS c, count(m.it) FILTER (WHERE bit_count(m.keymask) >= 2) AS p FROM ids LEFT JOIN masks m USING (i1) GROUP BY ALL) SELECT country, count(*)::BIGINT AS records, sum(c)::BIGINT AS pairs, sum(p)::BIGINT AS matches, round(avg((p = 0)::INT), 6) AS empty_share FROM n GROUP BY country")
def test_summary(spark, sf_dir):
    per = masks(spark, sf_dir).groupBy("i1").agg(F.count("*").alias("c"), F.count_if(F.bit_count("keymask") >= 2).alias("p"))
    n = records(spark, sf_dir).join(per, "i1", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("c", "p")})
    return rounded(n.groupBy("country").agg(F.count("*").alias("records"), F.sum("c").alias("pairs"), F.sum("p").alias("matches"), F.avg((F.col("p") == 0).cast("int")).alias("empty_share")))


FLAG_SQL = {
    "exact": "x = y", "casefold": "lower(x) = lower(y)", "upper": "regexp_matches(y, '[A-Za-z]') AND upper(y) = y", "lower": "regexp_matches(y, '[A-Za-z]') AND lower(y) = y", "empty": "trim(y) = ''",
    "pipe": "contains(y, '|')", "ampersand": "contains(y, '&')", "brackets": "regexp_matches(y, '[\\(\\)\\[\\]]')", "has_number": "regexp_matches(y, '[0-9]')", "shorter": "length(y) < length(x)", "longer": "length(y) > length(x)", "double_space": "contains(y, '  ')",
}


@query("noise_flags", f"WITH {REC}, {TRUTH}, q AS (SELECT t.lang AS lang, a.text AS x, t.text AS y FROM truth JOIN documents a ON a.doc_id = i1 JOIN documents t ON t.doc_id = it UNION ALL SELECT b.lang, a.text, b.text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT coalesce(lang, 'ALL') AS lang, count(*)::BIGINT AS n, " + ", ".join(f'round(avg(({v})::INT), 6) AS "{k}"' for k, v in FLAG_SQL.items()) + " FROM q GROUP BY ROLLUP (lang)")
def noise_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    a, b = d.select(F.col("doc_id").alias("i1"), F.col("text").alias("x")), d.select(F.col("doc_id").alias("it"), "lang", F.col("text").alias("y"))
    q = truth(rec(spark, sf_dir)).join(a, "i1").join(b, "it").select("lang", "x", "y").unionByName(a.join(b, F.col("it") == F.col("i1") + 1).select("lang", "x", "y"))
    return rounded(diagnostics.noise_audit(q, "x", "y", "lang").select("lang", "n", *FLAG_SQL))


#: Pairs of a record and its copy with one kind of noise each: names, addresses, countries, source of the copy.
NOISY = [
    ("Acme Tools", "Acme Tools", "1 Elm St", "1 Elm St", "US", "US", "S2"), ("Acme Tools", "ACME TOOLS", "1 Elm St", "1 ELM ST", "US", "US", "S2"), ("Acme Tools", "tools acme", "1 Elm St", "Elm St 1", "US", "US", "S3"),
    ("Acme Tools", "Àcme Tools", "1 Elm St", "", "US", "US", "S3"), ("Acme Tools", "www.acme.com", "12 Elm St", "012 Elm St", "US", "India", "S2"), ("Acme Tools", "Acm3 Tools", "1 Elm St", "null, Elm St", "US", "US", "S2"),
    ("Acme Tools", "** Acme Tools (old)", "1 Elm St", "1 Elm St, Unit 4", "US", "US", "S3"), ("Acme Tools", "Acme  Acme Tools #12 | x", "1 Elm St", "2 Elm St", "US", "US", "S3"), ("Acme Tools", "कमल", "1 Elm St", "कमल 1", "India", "India", "S2"),
    ("Acme Tools", "Best Shop", "Elm St", "Elm St", "US", "US", "S2"), ("Acme Tools", "Acme", "", "", "France", "France", "S3"), ("", "", "", "", "US", "US", "S2"),
]
NOISY_SQL = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in NOISY)
PART_PAIRS_SQL = "SELECT a.p_name AS an, b.p_name AS bn, a.p_size || ' ' || a.p_type AS aa, b.p_size || ' ' || b.p_type AS ba, a.p_brand AS ca, b.p_brand AS cb, 'S' || (2 + a.p_partkey % 2) AS src FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
RECORD_FLAGS_SQL = {
    "name_exact": "an = bn", "name_exact_casefold": "trim(fa) = trim(fb)", "name_same_tokens_ordered": "ta = tb", "name_same_token_set": "len(ab) = 0 AND len(ba_) = 0", "name_nonlatin": "nonlatin", "name_domain": "dom",
    "name_all_upper": "upper(bn) = bn AND lower(bn) <> bn", "name_all_lower": "lower(bn) = bn AND upper(bn) <> bn", "name_accent_injected": "fb <> lower(bn) AND fa = lower(an) AND NOT nonlatin",
    "name_leet_digit": "regexp_matches(lower(bn), '[a-z][0-9][a-z]|[a-z][0-9]\\b') AND NOT regexp_matches(lower(an), '[a-z][0-9]')", "name_leading_junk": "regexp_matches(trim(bn), '^[^\\p{L}\\p{N}_]')",
    "name_brackets": "regexp_matches(bn, '[\\[\\](){}]') AND NOT regexp_matches(an, '[\\[\\](){}]')", "name_hash_number": "regexp_matches(bn, '#\\s*[0-9]+')", "name_pipe_suffix": "contains(bn, '|')",
    "name_dup_token": "len(list_filter(tb, lambda w, i: i > 1 AND w = tb[i - 1])) > 0", "name_double_space": "contains(bn, '  ')", "name_subset": "len(ba_) = 0 AND len(ab) > 0", "name_superset": "len(ab) = 0 AND len(ba_) > 0",
    "name_token_overlap0": "NOT nonlatin AND len(list_intersect(ta, tb)) = 0 AND NOT dom", "addr_empty": "trim(ba) = ''", "addr_null_literal": "regexp_matches(lower(ba), '\\bnull\\b')", "addr_nonlatin": "regexp_matches(ba, '[ऀ-ൿ]')",
    "addr_exact": "aa = ba", "addr_same_token_set": "len(xab) = 0 AND len(xba) = 0", "addr_reordered": "len(xab) = 0 AND len(xba) = 0 AND xa <> xb", "addr_first_num_equal": "coalesce(na = nb, false)",
    "addr_first_num_lead0": "coalesce(na <> nb AND ltrim(nb, '0') = na, false)", "addr_num_missing": "na IS NOT NULL AND nb IS NULL AND trim(ba) <> ''", "addr_all_upper": "upper(ba) = ba AND lower(ba) <> ba", "country_mismatch": "ca <> cb",
}
RECORD_AUDIT_SQL = f"""WITH p AS (SELECT * FROM (VALUES {NOISY_SQL}) AS v(an, bn, aa, ba, ca, cb, src) UNION ALL {PART_PAIRS_SQL}),
  f AS (SELECT *, lower(strip_accents(an)) AS fa, lower(strip_accents(bn)) AS fb, regexp_extract_all(lower(strip_accents(an)), '[a-z0-9]+') AS ta, regexp_extract_all(lower(strip_accents(bn)), '[a-z0-9]+') AS tb,
        regexp_extract_all(lower(strip_accents(aa)), '[a-z0-9]+') AS xa, regexp_extract_all(lower(strip_accents(ba)), '[a-z0-9]+') AS xb, regexp_matches(bn, '[ऀ-ൿ]') AS nonlatin, regexp_matches(lower(bn), '\\.(com|in|net|org|co|fr|io|biz)\\b') AS dom FROM p),
  g AS (SELECT *, list_filter(ta, lambda w: NOT list_contains(tb, w)) AS ab, list_filter(tb, lambda w: NOT list_contains(ta, w)) AS ba_, list_filter(xa, lambda w: NOT list_contains(xb, w)) AS xab, list_filter(xb, lambda w: NOT list_contains(xa, w)) AS xba,
        list_filter(xa, lambda w: regexp_matches(w, '^[0-9]+$'))[1] AS na, list_filter(xb, lambda w: regexp_matches(w, '^[0-9]+$'))[1] AS nb FROM f)
  SELECT coalesce(src, 'ALL') AS src, count(*)::BIGINT AS n, {", ".join(f"round(avg(({c})::INT), 6) AS {k}" for k, c in RECORD_FLAGS_SQL.items())} FROM g GROUP BY ROLLUP (src)"""


@query("noise_audit_records", RECORD_AUDIT_SQL)
def noise_audit_records(spark, sf_dir):
    """The thirty flags of records on noisy copies and on neighbouring parts, whose size and type stand for an address and whose brand for a country."""
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("n"), F.concat_ws(" ", "p_size", "p_type").alias("a"), F.col("p_brand").alias("c"))
    b = a.toDF("k", "bn", "ba", "cb")
    parts = a.join(b, F.col("k") == F.col("p_partkey") + 1).select(F.col("n").alias("an"), "bn", F.col("a").alias("aa"), "ba", F.col("c").alias("ca"), "cb", F.concat(F.lit("S"), 2 + F.col("p_partkey") % 2).alias("src"))
    noisy = spark.createDataFrame(NOISY, "an string, bn string, aa string, ba string, ca string, cb string, src string")
    return rounded(diagnostics.record_audit(noisy.unionByName(parts), "src", ("an", "bn", "aa", "ba", "ca", "cb")))


TEXT_FLAGS_SQL = {
    "exact": "x = y", "casefold": "lower(x) = lower(y)", "same_words": "lost = 0 AND new = 0", "fewer_words": "lost > 0 AND new = 0", "more_words": "lost = 0 AND new > 0", "other_words": "lost > 0 AND new > 0", "empty": "trim(y) = ''",
    "accent": "regexp_matches(y, '[À-ɏ]')", "non_latin": "regexp_matches(y, '[Ͱ-῿]')", "domain": "regexp_matches(lower(y), '[a-z0-9-]+\\.(com|co\\.in|in|net|org|co|fr|biz|io|info)')", "handle": "regexp_matches(y, '(^|\\s)[#@][A-Za-z0-9]{3,}')",
    "upper": "regexp_matches(y, '[A-Za-z]') AND upper(y) = y", "lower": "regexp_matches(y, '[A-Za-z]') AND lower(y) = y", "leet": "regexp_matches(y, '[A-Za-z][0134]+[A-Za-z]')", "brackets": "regexp_matches(y, '[()\\[\\]]')", "pipe": "contains(y, '|')",
    "ampersand": "contains(y, '&')", "apostrophe": "contains(y, chr(39)) OR contains(y, '’')", "junk_prefix": "regexp_matches(y, '^[^A-Za-z0-9À-ɏ]')", "double_space": "contains(y, '  ')",
    "repeated_word": "len(list_filter(string_split(lower(y), ' '), lambda w, i: i > 1 AND w <> '' AND w = string_split(lower(y), ' ')[i - 1])) > 0", "has_number": "len(ny) > 0", "same_numbers": "nlost = 0 AND nnew = 0", "number_lost": "nlost > 0", "number_new": "nnew > 0",
    "shorter": "length(y) < length(x)", "longer": "length(y) > length(x)", "comma_count": "length(replace(x, ',', '')) - length(x) <> length(replace(y, ',', '')) - length(y)", "first_word_same": "coalesce(wx[1] = wy[1], false)", "null_word": "regexp_matches(lower(y), '\\b(null|none)\\b')",
}
TEXT_AUDIT_SQL = f"""WITH n AS ({NAMES_SQL}), w AS (SELECT (it > 0)::VARCHAR AS by_, x, y, regexp_extract_all(lower(x), '[a-z0-9]+') AS wx, regexp_extract_all(lower(y), '[a-z0-9]+') AS wy, regexp_extract_all(x, '[0-9]+') AS nx, regexp_extract_all(y, '[0-9]+') AS ny FROM n),
  f AS (SELECT *, len(list_filter(wx, lambda v: NOT list_contains(wy, v))) AS lost, len(list_filter(wy, lambda v: NOT list_contains(wx, v))) AS new, len(list_filter(nx, lambda v: NOT list_contains(ny, v))) AS nlost, len(list_filter(ny, lambda v: NOT list_contains(nx, v))) AS nnew FROM w)
  SELECT coalesce(by_, 'ALL') AS by, count(*)::BIGINT AS n, {", ".join(f"round(avg(({c})::INT), 6) AS {k}" for k, c in TEXT_FLAGS_SQL.items())} FROM f GROUP BY ROLLUP (by_)"""


@query("noise_flags_all", TEXT_AUDIT_SQL)
def noise_flags_all(spark, sf_dir):
    """All thirty flags on names of parts and suppliers."""
    return rounded(diagnostics.noise_audit(name_pairs(spark, sf_dir).withColumn("by", (F.col("it") > 0).cast("string")), "x", "y", "by"))


@query("token_add_drop", f"WITH {REC}, p AS (SELECT list_distinct(a.toks) AS a, list_distinct(b.toks) AS b FROM rec a JOIN rec b ON b.doc_id = a.doc_id + 1), z AS (SELECT unnest(list_filter(b, lambda x: NOT list_contains(a, x))) AS w, 1 AS k FROM p UNION ALL SELECT unnest(list_filter(a, lambda x: NOT list_contains(b, x))), 0 FROM p) SELECT w, count(*) FILTER (WHERE k = 1)::BIGINT AS added, count(*) FILTER (WHERE k = 0)::BIGINT AS dropped FROM z GROUP BY w".replace("FILTER (WHERE k = 1)::BIGINT", "FILTER (WHERE k = 1)").replace("FILTER (WHERE k = 0)::BIGINT", "FILTER (WHERE k = 0)"))
def token_add_drop(spark, sf_dir):
    r = rec(spark, sf_dir).select("doc_id", F.array_distinct("toks").alias("t"))
    return diagnostics.word_changes(r.toDF("i", "a").join(r.toDF("j", "b"), F.col("j") == F.col("i") + 1), "a", "b")


@query("link_fate", f"WITH {LINKS} SELECT i1, it, CASE WHEN p.i1 IS NOT NULL THEN 'kept' WHEN m.i1 IS NOT NULL THEN 'pruned' ELSE 'never' END AS fate FROM truth LEFT JOIN masks m USING (i1, it) LEFT JOIN pred p USING (i1, it)")
def link_fate(spark, sf_dir):
    found = masks(spark, sf_dir)
    return diagnostics.link_fate(truth(rec(spark, sf_dir)), found, strong(found))


@query("key_contribution", f"WITH {LINKS}, k(kind, bit) AS (VALUES " + ", ".join(f"('{k}', {1 << list(keys.CAPS).index(k)})" for k in keys.CAPS) + ") SELECT kind, count(*) FILTER (WHERE keymask & bit <> 0) AS found, count(*) FILTER (WHERE keymask = bit) AS alone FROM k CROSS JOIN (SELECT keymask FROM truth JOIN masks USING (i1, it)) GROUP BY kind")
def key_contribution(spark, sf_dir):
    return diagnostics.key_contribution(truth(rec(spark, sf_dir)), masks(spark, sf_dir))


@query(
    "capped_diagnosis",
    f"""WITH {HITS}, {TRUTH}, u AS (SELECT a.rid AS i1, b.rid AS it, max((g.key IS NOT NULL)::INT) AS ok FROM truth JOIN ks a ON a.rid = i1 AND a.side = 's1' JOIN ks b ON b.rid = truth.it AND b.side = 't' AND b.kind = a.kind AND b.key = a.key LEFT JOIN good g ON g.kind = a.kind AND g.key = a.key GROUP BY ALL)
    SELECT i1, it, CASE WHEN ok = 1 THEN 'found' WHEN ok IS NULL THEN 'none' ELSE 'capped' END AS cause FROM truth LEFT JOIN u USING (i1, it)""",
)
def capped_diagnosis(spark, sf_dir):
    return diagnostics.capped_diagnosis(truth(rec(spark, sf_dir)), key_rows(spark, sf_dir, KINDS))


@query("match_sizes", f"WITH {REC}, {TRUTH}, p AS (SELECT doc_id, count(it) AS n FROM rec LEFT JOIN truth ON i1 = doc_id WHERE side = 's1' GROUP BY doc_id) SELECT n AS n_matches, count(*)::BIGINT AS n FROM p GROUP BY 1")
def match_sizes(spark, sf_dir):
    r = rec(spark, sf_dir)
    return diagnostics.match_sizes(r.where("side = 's1'").select(F.col("doc_id").alias("i1")), truth(r))


@query("state_coverage_of_missed", f"WITH {LINKS} SELECT count(*)::BIGINT AS missed, round(avg((r.state = '')::INT), 6) AS without_state FROM truth JOIN rec r ON r.doc_id = it WHERE (i1, it) NOT IN (SELECT (i1, it) FROM pred)")
def state_coverage_of_missed(spark, sf_dir):
    _, pred, true = linked(spark, sf_dir)
    states = rec(spark, sf_dir).select(F.col("doc_id").alias("it"), "state")
    return rounded(true.join(pred, ["i1", "it"], "left_anti").join(states, "it").agg(F.count("*").alias("missed"), F.avg((F.col("state") == "").cast("int")).alias("without_state")))


@query("cumulative_hits", f"WITH {PAIRS} SELECT i1, it, (sum((qs > 0.5)::INT) OVER (PARTITION BY i1 ORDER BY p DESC, it ROWS UNBOUNDED PRECEDING))::BIGINT AS tp FROM pairs")
def cumulative_hits(spark, sf_dir):
    w = Window.partitionBy("i1").orderBy(F.desc("p"), "it").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(pairs(spark, sf_dir).select("i1", "it", F.sum((F.col("qs") > 0.5).cast("int")).over(w).alias("tp")))


@query("region_slice", f"WITH {REC}, {TRUTH}, k AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e|token') AND doc_id IN (SELECT doc_id FROM rec WHERE side = 's1')) SELECT i1, count(*)::BIGINT AS n FROM truth WHERE i1 IN (SELECT doc_id FROM k) GROUP BY i1")
def region_slice(spark, sf_dir):
    from ..sources.tables import region_slice as slice_

    ids = rec(spark, sf_dir).where("side = 's1'").select("doc_id")
    d = table(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("business_address"))
    return slice_(d, truth(rec(spark, sf_dir)), "(?i)licen[cs]e|token")[1].groupBy("i1").agg(F.count("*").alias("n"))

