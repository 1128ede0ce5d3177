"""Queries of features, models and whole linkage, over business records made of customers, parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import blocking, clean, context, decisions, features, models, statistics
from . import linkage, linkage_old
from .base import query, rec, rounded, table
from .statistics_queries import MASKS, masks


def business(spark, sf_dir):
    """(clean records, targets, true links): each customer as a business, with two noisy copies; every fifth copy has no owner.

    Noise follows the digits of md5: a letter dropped, words swapped, another legal form, a second name, digits for letters, a
    number left out.
    """
    n_parts = table(spark, sf_dir, "part").count()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey").join(p, F.col("c_custkey") % n_parts + 1 == F.col("k"))
    h = F.md5(F.col("c_custkey").cast("string"))
    words = F.array(F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.lower("c_mktsegment"), F.concat(F.lit("no"), F.substring(h, 1, 3)))
    base = c.select("c_custkey", words.alias("w"), F.concat(F.col("c_custkey") % 311 + 1).alias("num"), F.lower("n_name").alias("street"), F.translate(F.substring(h, 4, 4), "0123456789abcdef", "aeioubdgklmnprst").alias("town"), (F.col("c_custkey") % 6 + 1).cast("int").alias("s"), F.element_at(F.array(*[F.lit(s) for s in ("US", "India", "France")]), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("country"))
    state = lambda *names: F.element_at(F.array(*map(F.lit, names)), F.col("s"))
    one = base.select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.concat(F.array_join("w", " "), F.lit(" ltd")).alias("business_name"), F.concat("num", F.lit(" "), "street", F.lit(" street, "), "town", F.lit(", "), state("ohio", "texas", "kerala", "bihar", "bretagne", "corse")).alias("business_address"), "country")
    copies = base.withColumn("src", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("h", F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("src").cast("string"))))
    digit = lambda i: F.conv(F.substring("h", i, 1), 16, 10).cast("int")
    w = F.when(digit(1) < 4, F.reverse("w")).otherwise(F.col("w"))
    name = F.array_join(w, " ")
    name = F.when(digit(2) < 5, F.concat(F.substring(name, 1, 3), F.substr(name, F.lit(5)))).otherwise(name)
    name = F.when(digit(3) < 4, F.translate(name, "oe", "03")).otherwise(name)
    name = F.concat(name, F.when(digit(4) < 6, " limited").when(digit(4) < 9, " dba best choice").otherwise(" inc"))
    place = F.concat(F.when(digit(5) < 12, F.concat("num", F.lit(" "))).otherwise(F.lit("")), F.col("street"), F.when(digit(6) < 8, " st").otherwise(" street"), F.lit(", "), F.col("town"), F.when(digit(7) < 10, F.concat(F.lit(", "), state("oh", "tx", "kl", "br", "bre", "cor"))).otherwise(""))
    targets = copies.select(F.concat(F.lit("S"), "src", F.lit("-"), "c_custkey").alias("entity_id"), name.alias("business_name"), place.alias("business_address"), "country", (F.col("c_custkey") % 5 == 0).alias("orphan"), "c_custkey")
    truth = targets.where(~F.col("orphan")).select(F.concat(F.lit("S1-"), "c_custkey").alias("i1"), F.col("entity_id").alias("it"))
    moved = F.when(F.col("orphan"), F.translate("business_name", "aeioulnrst", "uoaeilrtsn")).otherwise(F.col("business_name"))
    return one, targets.select("entity_id", moved.alias("business_name"), "business_address", "country"), truth


def prepared(spark, sf_dir):
    one, targets, truth = business(spark, sf_dir)
    a, b = linkage.cleaned_sides(one, targets)
    raw = linkage.candidates(a, b)
    return a, b, raw, truth


@query("quick_score")
def quick_score(spark, sf_dir):
    a, b, raw, _ = prepared(spark, sf_dir)
    light = ("nm_core", "nm_alias", "ad_words", "ad_num1")
    q = features.quick_scores(features.attach(raw, a.withColumnRenamed("entity_id", "i1"), b.withColumnRenamed("entity_id", "it"), light))
    return rounded(q.select("i1", "it", "qn", "qa", "num_eq", "qs"))


@query("pair_features_v2")
def pair_features_v2(spark, sf_dir):
    a, b, raw, _ = prepared(spark, sf_dir)
    return rounded(linkage.featured_pairs(a, b, linkage.scored_pairs(a, b, raw)))


def cleaned_old(spark, sf_dir):
    one, targets, truth = business(spark, sf_dir)
    a, b = (linkage.staged(clean.clean_old(linkage.spread(x, "entity_id", x.count())).withColumnRenamed("entity_id", "rid")) for x in (one, targets))
    return a, b, truth


@query("candidates_v1")
def candidates_v1(spark, sf_dir):
    """What the six older retrievers find, at most 80 pairs a record: the cap is the operator."""
    a, b, _ = cleaned_old(spark, sf_dir)
    both = a.unionByName(b)
    return rounded(linkage_old.retrieved(a, b, {v: linkage_old.view(both, v) for v in ("name_char", "full_char", "full_word")}))


@query("pair_features_v1")
def pair_features_v1(spark, sf_dir):
    """The older features of the older candidates, with their seven contexts."""
    a, b, _ = cleaned_old(spark, sf_dir)
    return rounded(linkage_old.featured(a, b))


@query("two_stage_v1")
def two_stage_v1(spark, sf_dir):
    """The older path whole: features, out-of-fold first stage, its context and support, second stage; p of all pairs, out of fold."""
    a, b, truth = cleaned_old(spark, sf_dir)
    pairs = linkage.staged(linkage_old.featured(a, b))
    marked = linkage.staged(pairs.join(truth.withColumn("y", F.lit(1)), ["i1", "it"], "left").withColumn("y", F.coalesce("y", F.lit(0))))
    columns = [c for c in pairs.columns if c not in ("i1", "it")]
    small = {"trees": 8, "depth": 4, "leaf": 5}  # four fits of 87 columns
    p1, _ = models.out_of_fold(marked, columns, folds=2, **small)
    both = linkage.staged(linkage_old.second_stage(linkage.staged(p1), linkage_old.view(a.unionByName(b), "full_char")))
    scored, _ = models.out_of_fold(both, [c for c in both.columns if c not in ("i1", "it", "y", "fold")], folds=2, out="p", **small)
    return rounded(scored.select("i1", "it", "y", "p1", "p"))


#: Trees of the module's own number and depth; smaller leaves, as the tables are small.
TREES = {"trees": 30, "depth": 5, "leaf": 5}


def fitted(spark, sf_dir):
    a, b, raw, truth = prepared(spark, sf_dir)
    pairs = linkage.staged(linkage.featured_pairs(a, b, linkage.scored_pairs(a, b, raw)))
    ids = a.select(F.col("entity_id").alias("i1"))
    n = ids.count()
    rules = (("ef", None, 1.0), ("thr", 0.5, 1.0), ("thr", 0.7, 1.0))
    linker, report = linkage.fit(pairs, b, truth, ids, (n * 2 // 5, n * 2 // 5, n - 2 * (n * 2 // 5)), rules, **TREES)
    return a, b, pairs, truth, linker, report


@query("two_stage_scores")
def two_stage_scores(spark, sf_dir):
    _, b, pairs, _, linker, _ = fitted(spark, sf_dir)
    return rounded(linker.probabilities(pairs, b))


@query("match_two_stage")
def match_two_stage(spark, sf_dir):
    """Lists of matches of every clean record by the fitted rule, and the score on held-out records."""
    a, b, pairs, _, linker, report = fitted(spark, sf_dir)
    lists = decisions.match_lists(a.select(F.col("entity_id").alias("i1")), linker.matches(linker.probabilities(pairs, b)))
    return rounded(lists.withColumn("validation_f05", F.lit(float(report["validation"]))))


def labelled(spark, sf_dir):
    """Small numeric pairs with y: names of parts and their neighbours' likeness."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    t = F.col("text")
    share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / F.greatest(F.length(t), F.lit(1))
    return d.select(F.col("doc_id").alias("i1"), F.col("quality").alias("y"), share("[^#*$%&|]").alias("symbols"), share("[^A-Z]").alias("upper"), share(r"[^\s]").alias("spaces"))


@query("isotonic_calibrated")
def isotonic_calibrated(spark, sf_dir):
    d = linkage.staged(labelled(spark, sf_dir))
    scored, _ = models.out_of_fold(d, ["symbols", "upper", "spaces"], folds=2, out="raw", **TREES)
    return rounded(models.cross_calibrated(linkage.staged(scored), "raw").select("i1", "y", "raw", "p"))


@query("auc")
def auc(spark, sf_dir):
    d = linkage.staged(labelled(spark, sf_dir))
    scored, _ = models.out_of_fold(d, ["symbols", "upper", "spaces"], folds=3, out="p1", **TREES)
    return rounded(spark.createDataFrame([(models.auc(linkage.staged(scored), "p1"), d.count())], "auc double, n long"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    d = linkage.staged(labelled(spark, sf_dir))
    model = models.fit(d, ["symbols", "upper", "spaces"], **TREES)
    return rounded(spark.createDataFrame(models.importances(model, ["symbols", "upper", "spaces"]), "feature string, gain double"))


@query("country_transfer")
def country_transfer(spark, sf_dir):
    d = linkage.staged(labelled(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i1"), "lang"), "i1"))
    langs = [r["lang"] for r in d.groupBy("lang").agg(F.countDistinct("y").alias("k")).where("k = 2 and lang is not null").orderBy("lang").collect()]
    found = models.leave_one_out(d, ["symbols", "upper", "spaces"], "lang", langs, **TREES)
    return rounded(spark.createDataFrame(sorted(found.items()), "lang string, auc double"))


MATCH_SQL = f"""WITH {MASKS}, c AS (SELECT w, count(*) AS n FROM (SELECT unnest(toks) AS w FROM rec) GROUP BY w), d AS (SELECT DISTINCT doc_id, unnest(toks) AS w FROM rec),
  z AS (SELECT doc_id, w, ln((SELECT count(*) FROM rec) / n) AS idf FROM d JOIN c USING (w)), tot AS (SELECT doc_id, sum(idf) AS t FROM z GROUP BY doc_id),
  s AS (SELECT i1, it, sum(x.idf) AS wi FROM masks JOIN z x ON x.doc_id = i1 JOIN z y ON y.doc_id = it AND y.w = x.w GROUP BY i1, it),
  q AS (SELECT i1, it, round(coalesce(wi, 0) / (a.t + b.t - coalesce(wi, 0) + 1e-9), 5) AS p FROM masks LEFT JOIN s USING (i1, it) JOIN tot a ON a.doc_id = i1 JOIN tot b ON b.doc_id = it),
  t1 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY it ORDER BY p DESC, i1) <= 8), t2 AS (SELECT * FROM t1 QUALIFY row_number() OVER (PARTITION BY i1 ORDER BY p DESC, it) <= 50),
  o AS (SELECT i1, it FROM t2 WHERE p >= 0.5 QUALIFY p >= max(p) OVER (PARTITION BY it) - 1e-9),
  l AS (SELECT i1, string_agg(it::VARCHAR, ',' ORDER BY it::VARCHAR) AS m FROM o GROUP BY i1)
  SELECT doc_id AS i1, coalesce(m, '') AS matches FROM rec LEFT JOIN l ON l.i1 = doc_id WHERE side = 's1'"""


#: Likeness from which two documents match.
LIKELY = 0.5


@query("match_end_to_end", MATCH_SQL)
def match_end_to_end(spark, sf_dir):
    """For every clean document all other documents that match: keys, capped join, weighed likeness, pruning, threshold, owners, lists."""
    r = rec(spark, sf_dir)
    idf = statistics.idf(statistics.token_counts(r, "toks"), F.lit(r.count()))
    w = linkage.staged(sim.with_sketch(statistics.weigh_tokens(r, "doc_id", "toks", idf, 12.0, "words"), "words").where(F.size("words") > 0))
    # Pairs under the threshold outrank none above it, so they may go first: by their totals, then by a bound on their likeness.
    side = lambda rid, x, *more: w.select(F.col("doc_id").alias(rid), *[F.col(c).alias(f"{x}_{c}") for c in more])
    totals = (F.col("a_total"), F.col("b_total"))
    near = masks(spark, sf_dir).select("i1", "it").join(side("i1", "a", "total", "most"), "i1").join(side("it", "b", "total", "most"), "it")
    near = near.where(sim.likeness_within(F.least("a_most", "b_most"), *totals) >= LIKELY).drop("a_most", "b_most")
    near = near.join(side("i1", "a", "sketch"), "i1").join(side("it", "b", "sketch"), "it")
    near = near.where(sim.likeness_within(sim.sketched(F.col("a_sketch"), F.col("b_sketch")), *totals) >= LIKELY).select("i1", "it")
    both = linkage.staged(near).join(side("i1", "a", "words"), "i1").join(side("it", "b", "words"), "it")
    scored = linkage.staged(both.select("i1", "it", F.round(sim.set_features(F.col("a_words"), F.col("b_words"))["wjac"], 5).alias("p")))
    likely = decisions.threshold_sets(scored, LIKELY)
    kept = likely.withColumn("_t", context.rank_in("it", "p", "i1")).where("_t < 8").drop("_t")
    likely = context.prune_records(kept, 50, "p")
    owned = likely.withColumn("p", decisions.one_owner()).where("p > 0")
    return decisions.match_lists(r.where("side = 's1'").select(F.col("doc_id").alias("i1")), owned)

