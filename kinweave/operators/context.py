"""Where a pair stands among its competitors: ranks, margins, pruning, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_context(group: str, value: str, tie: str, prefix: str, gap: bool = False) -> dict[str, Column]:
    """Columns over the rows of a group: rank from 0 by falling value, then tie; margin over the best other row, 1 alone; size; with gap also the distance to the best.

    All share one window order, hence one sort; use them in one select.
    """
    ordered = Window.partitionBy(group).orderBy(F.desc(value), F.asc(tie))
    whole = Window.partitionBy(group)
    rank = F.row_number().over(ordered)
    top = F.max(value).over(whole)
    other = F.when(rank == 1, F.lead(value).over(ordered)).otherwise(top)
    found = {f"{prefix}_rank": rank - 1, f"{prefix}_margin": F.coalesce(F.col(value) - other, F.lit(1.0)), f"{prefix}_size": F.count("*").over(whole)}
    return found | ({f"{prefix}_gap_top": top - F.col(value)} if gap else {})


def rank_in(group: str, value: Column | str, tie: str) -> Column:
    """Rank from 0 in a group by falling value, then tie."""
    return F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), F.asc(tie))) - 1


def group_totals(group: str, value: str) -> dict[str, Column]:
    whole = Window.partitionBy(group)
    return {"group_max": F.max(value).over(whole), "group_sum": F.sum(value).over(whole), "group_size": F.count("*").over(whole)}


def prune_targets(pairs: DataFrame, top: int = 8, top_one: int = 3) -> DataFrame:
    """Per target the `top` best by qs, and the top_one best by qn alone and by address alone (qa + num_eq / 2)."""
    address = F.col("qa") + 0.5 * F.col("num_eq").cast("double")
    ranked = pairs.withColumn("_q", rank_in("it", "qs", "i1")).withColumn("_n", rank_in("it", "qn", "i1")).withColumn("_a", rank_in("it", address, "i1"))
    return ranked.where((F.col("_q") < top) | (F.col("_n") < top_one) | (F.col("_a") < top_one)).drop("_q", "_n", "_a")


def prune_records(pairs: DataFrame, top: int = 50, score: str = "qs") -> DataFrame:
    """Per clean record the `top` best."""
    return pairs.withColumn("_r", rank_in("i1", score, "it")).where(F.col("_r") < top).drop("_r")


def candidate_context(pairs: DataFrame, scores: tuple[str, ...] = ("qs", "qn", "qa")) -> DataFrame:
    """Pairs with rank and margin of each score on both sides, and both sides' candidate counts."""
    found: dict[str, Column] = {}
    for group, tie, name in (("i1", "it", "s1"), ("it", "i1", "tg")):
        for score in scores:
            columns = group_context(group, score, tie, f"{name}_{score}")
            size = columns.pop(f"{name}_{score}_size")
            found |= columns | {f"{name}_ncand": size}
    return pairs.withColumns(found)


def probability_context(pairs: DataFrame, p: str = "p1", group: str = "i1", tie: str = "it", prefix: str = "s1_p1") -> DataFrame:
    """Pairs with rank and margin of p in their group, its sum, and how many are over one half."""
    columns = group_context(group, p, tie, prefix)
    columns.pop(f"{prefix}_size")
    whole = Window.partitionBy(group)
    return pairs.withColumns(columns | {f"{prefix}_sum": F.sum(p).over(whole), f"{prefix}_n50": F.count_if(F.col(p) > 0.5).over(whole)})


def candidate_context_old(pairs: DataFrame, scores: tuple[str, str, str], source: str) -> DataFrame:
    """The older context: rank, margin and distance to the best of three scores on both sides, of the first also within a record's targets of one source; both sides' candidate counts."""
    found: dict[str, Column] = {}
    for group, tie, name in (("i1", "it", "s1"), ("it", "i1", "tg")):
        for score in scores:
            columns = group_context(group, score, tie, f"{name}_{score}", gap=True)
            found |= {f"{name}_n_cand": columns.pop(f"{name}_{score}_size")} | columns
    columns = group_context("_g", scores[0], "it", f"s1src_{scores[0]}", gap=True)
    columns.pop(f"s1src_{scores[0]}_size")
    return pairs.withColumn("_g", F.struct("i1", source)).withColumns(found | columns).drop("_g")


def probability_context_old(pairs: DataFrame, p: str = "p1") -> DataFrame:
    """The older second-stage context of p: rank, margin, distance to the best and sum on both sides, and how many of the record's are over one half."""
    found: dict[str, Column] = {}
    for group, tie, name in (("i1", "it", "s1_p1"), ("it", "i1", "tg_p1")):
        columns = group_context(group, p, tie, name, gap=True)
        columns.pop(f"{name}_size")
        found |= columns | {f"{name}_sum": F.sum(p).over(Window.partitionBy(group))}
    return pairs.withColumns(found | {"s1_n_p50": F.count_if(F.col(p) > 0.5).over(Window.partitionBy("i1"))})


def support_pairs(pairs: DataFrame, p: str, keep: list[str], top: int = 6) -> DataFrame:
    """Ordered pairs of different candidates among the `top` of each record by p: i1, it, it_o, p_o, and `keep` columns of both (suffix _o)."""
    best = pairs.withColumn("_r", rank_in("i1", p, "it")).where(F.col("_r") < top).drop("_r").select("i1", "it", F.col(p).alias("p"), *keep)
    other = best.select("i1", F.col("it").alias("it_o"), F.col("p").alias("p_o"), *[F.col(c).alias(f"{c}_o") for c in keep])
    return best.join(other, "i1").where("it <> it_o")


def support(pairs: DataFrame, related: DataFrame) -> DataFrame:
    """Pairs with the support of their record's other candidates: sup_same_src, sup_cross_src, sup_n_strong.

    related: support_pairs() with `sim` (their likeness) and `cross` (whether their sources differ). A candidate supports by
    the lesser of sim and its p; it is strong if sim is over 0.8 and p over 0.5.
    """
    s = F.least("sim", "p_o")
    sums = related.groupBy("i1", "it").agg(
        F.max(F.when(~F.col("cross"), s)).alias("a"),
        F.max(F.when(F.col("cross"), s)).alias("b"),
        F.count_if((F.col("sim") > 0.8) & (F.col("p_o") > 0.5)).alias("c"),
    )
    found = {"sup_same_src": F.coalesce("a", F.lit(0.0)), "sup_cross_src": F.coalesce("b", F.lit(0.0)), "sup_n_strong": F.coalesce("c", F.lit(0))}
    return pairs.join(sums, ["i1", "it"], "left").withColumns(found).drop("a", "b", "c")
