"""Feature columns of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from .keys import CAPS

#: Columns of a cleaned record that pair features read.
NEEDED = ("nm_full", "nm_core", "nm_core2", "nm_key", "nm_skel", "nm_nospace", "nm_alias", "nm_legal", "nm_ntok", "nm_native", "nm_joined", "unk_frac", "is_s3", "nm_idf", "ad_words", "ad_wset", "ad_nums", "ad_num1", "ad_pc", "ad_state", "ad_street", "ad_empty", "ad_idf")


def attach(pairs: DataFrame, a: DataFrame, b: DataFrame, columns: tuple[str, ...] = NEEDED) -> DataFrame:
    """Pairs with the records' columns as a_* and b_*; a has rid i1, b has rid it."""
    left = a.select("i1", *[F.col(c).alias(f"a_{c}") for c in columns if c in a.columns])
    right = b.select("it", *[F.col(c).alias(f"b_{c}") for c in columns if c in b.columns])
    return pairs.join(left, "i1").join(right, "it")


def text(c: str) -> Column:
    return F.array_join(c, " ")


def quick_scores(pairs: DataFrame) -> DataFrame:
    """Pairs (attached) with qn, qa, num_eq, qs: name and address likeness, equal street number, and their weighted sum.

    qn is the best token-set likeness of the cores and, where there is an alias, of either core with the other's alias.
    """
    a, b = text("a_nm_core"), text("b_nm_core")
    wanted = {"n": ("token_set", a, b), "x": ("token_set", a, text("b_nm_alias")), "y": ("token_set", text("a_nm_alias"), b), "q": ("token_set", text("a_ad_words"), text("b_ad_words"))}
    scored = pairs.withColumn("_s", sim.measures(wanted))
    eq = ((F.col("a_ad_num1") == F.col("b_ad_num1")) & (F.col("a_ad_num1") != "")).cast("int")
    scored = scored.withColumns({"qn": F.greatest("_s.n", "_s.x", "_s.y"), "qa": F.col("_s.q"), "num_eq": eq}).drop("_s")
    return scored.withColumn("qs", 0.55 * F.col("qn") + 0.35 * F.col("qa") + 0.10 * F.col("num_eq"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """The 76 features of attached pairs with keymask, quick scores and candidate context; one Arrow pass for the string measures, all else in the JVM."""
    an, bn, a2, b2 = text("a_nm_core"), text("b_nm_core"), text("a_nm_core2"), text("b_nm_core2")
    aw, bw = text("a_ad_words"), text("b_ad_words")
    wanted = {
        "n_ratio": ("indel", an, bn), "n_tset": ("token_set", an, bn), "n_tsort": ("token_sort", an, bn), "n_partial": ("partial", an, bn),
        "n2_tset": ("token_set", a2, b2), "n2_tsort": ("token_sort", a2, b2), "n_full_ratio": ("indel", text("a_nm_full"), text("b_nm_full")),
        "n_jw_nospace": ("jaro_winkler", F.col("a_nm_nospace"), F.col("b_nm_nospace")), "n_skel_ratio": ("indel", text("a_nm_skel"), text("b_nm_skel")), "n_skel_tset": ("token_set", text("a_nm_skel"), text("b_nm_skel")),
        "alias1": ("token_set", text("a_nm_alias"), bn), "alias2": ("token_set", an, text("b_nm_alias")), "a_tset": ("token_set", aw, bw),
        "a_ratio_sorted": ("indel", text("a_ad_wset"), text("b_ad_wset")), "a_partial": ("partial", aw, bw), "street_tset": ("token_set", text("a_ad_street"), text("b_ad_street")),
    }
    s = pairs.withColumn("_s", sim.measures(wanted))
    s = s.withColumn("_n", sim.set_features(F.col("a_nm_idf"), F.col("b_nm_idf"))).withColumn("_a", sim.set_features(F.col("a_ad_idf"), F.col("b_ad_idf"))).withColumn("_d", sim.number_features(F.col("a_ad_nums"), F.col("b_ad_nums")))
    number = lambda c: F.col(c).cast("double")
    found: dict[str, Column] = {f"key_{k}": F.shiftright("keymask", i).bitwiseAND(F.lit(1)) for i, k in enumerate(CAPS)}
    found |= {k: F.col(f"_s.{k}") for k in wanted if not k.startswith("alias")}
    found |= {"n_alias_best": F.greatest("_s.alias1", "_s.alias2"), "t_has_alias": (F.size("b_nm_alias") > 0).cast("int"), "s1_has_alias": (F.size("a_nm_alias") > 0).cast("int")}
    found |= {"n_best_tset": F.greatest("_s.n2_tset", "_s.alias1", "_s.alias2"), "n_key_eq": (F.col("a_nm_key") == F.col("b_nm_key")).cast("int"), "n_skel_eq": (F.col("a_nm_skel") == F.col("b_nm_skel")).cast("int")}
    for name, source in (("n", "_n"), ("a", "_a")):
        found |= {f"{name}_contain": F.col(f"{source}.contain"), f"{name}_wjac": F.col(f"{source}.wjac"), f"{name}_unexpl_s1": F.col(f"{source}.unexpl_a"), f"{name}_unexpl_t": F.col(f"{source}.unexpl_b")}
    found |= {"legal_state": sim.tri_state(text("a_nm_legal"), text("b_nm_legal")), "n_ntok_s1": F.col("a_nm_ntok"), "n_ntok_t": F.col("b_nm_ntok"), "t_native": number("b_nm_native"), "t_joined": number("b_nm_joined"), "t_unk_frac": F.col("b_unk_frac"), "t_is_s3": number("b_is_s3")}
    found |= {"num_contain": F.col("_d.contain"), "num_symdiff": F.col("_d.symdiff")}
    found |= {"num1_state": sim.tri_state("a_ad_num1", "b_ad_num1"), "pc_state": sim.tri_state("a_ad_pc", "b_ad_pc"), "state_state": sim.tri_state("a_ad_state", "b_ad_state"), "street_state": sim.tri_state(text("a_ad_street"), text("b_ad_street"))}
    found |= {"a_empty_t": number("b_ad_empty"), "a_empty_s1": number("a_ad_empty")}
    kept = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]
    return s.select(*kept, *[c.cast("double").alias(k) for k, c in found.items()])


#: The model's input columns: key bits and measures of pair_features(), with the quick scores and the context of candidates.
CONTEXT = ("qs", "qn", "qa", "s1_ncand", "tg_ncand", *(f"{g}_{q}_{k}" for g in ("s1", "tg") for q in ("qs", "qn", "qa") for k in ("rank", "margin")))


def feature_columns(features: DataFrame) -> list[str]:
    other = {"i1", "it", "keymask", "num_eq", "y", "grp", "country"}
    return [c for c in features.columns if c not in other]


OLD_NEEDED = ("name_core", "name_clean", "name_nospace", "name_skel", "name_aliases", "name_acronym", "name_legal", "name_idf", "addr_core", "addr_words", "addr_skel", "addr_landmark", "addr_nums", "addr_postcode", "addr_house", "addr_idf", "country_norm", "source")


def pair_features_old(pairs: DataFrame) -> DataFrame:
    """The older feature set of attached pairs (OLD_NEEDED) that have blocker flags and cosines; context columns come from candidate_context_old()."""
    an, bn, aa, ba = text("a_name_core"), text("b_name_core"), text("a_addr_core"), text("b_addr_core")
    la, lb = text("a_addr_landmark"), text("b_addr_landmark")
    wanted = {
        "nm_ratio": ("indel", an, bn), "nm_partial": ("partial", an, bn), "nm_tsort": ("token_sort", an, bn), "nm_tset": ("token_set", an, bn), "nm_jw": ("jaro_winkler", an, bn),
        "nm_clean_ratio": ("indel", F.col("a_name_clean"), F.col("b_name_clean")), "nm_nospace_ratio": ("indel", F.col("a_name_nospace"), F.col("b_name_nospace")),
        "nm_skel_tset": ("token_set", text("a_name_skel"), text("b_name_skel")), "ad_ratio": ("indel", aa, ba), "ad_partial": ("partial", aa, ba), "ad_tset": ("token_set", aa, ba), "ad_tsort": ("token_sort", aa, ba),
        "ad_words_tset": ("token_set", text("a_addr_words"), text("b_addr_words")), "ad_skel_tset": ("token_set", text("a_addr_skel"), text("b_addr_skel")),
        "lm": ("token_set", la, lb), "lm_a": ("token_set", la, ba), "lm_b": ("token_set", lb, aa), "alias": ("alias_best", F.col("a_name_aliases"), F.col("b_name_aliases")),
    }
    s = pairs.withColumn("_s", sim.measures(wanted)).withColumn("_n", sim.token_evidence(F.col("a_name_idf"), F.col("b_name_idf"))).withColumn("_a", sim.token_evidence(F.col("a_addr_idf"), F.col("b_addr_idf")))
    s = s.withColumn("_d", sim.number_features_old(F.array_distinct("a_addr_nums"), F.array_distinct("b_addr_nums"), F.col("a_addr_postcode"), F.col("b_addr_postcode"), F.col("a_addr_house"), F.col("b_addr_house")))
    several = (F.size("a_name_aliases") > 1) | (F.size("b_name_aliases") > 1)
    na, nb = F.size("a_name_core"), F.size("b_name_core")
    found: dict[str, Column] = {k: F.col(f"_s.{k}") for k in wanted if k not in ("lm", "lm_a", "lm_b", "alias")}
    found |= {"nm_lev": sim.levenshtein_similarity(an, bn), "nm_alias_best": F.when(several, F.col("_s.alias")).otherwise(F.col("_s.nm_tset")), "nm_exact": an == bn}
    found |= {"nm_first_tok_eq": F.coalesce(F.get("a_name_core", F.lit(0)) == F.get("b_name_core", F.lit(0)), F.lit(False))}
    found |= {"nm_acronym": ((F.col("a_name_acronym") != "") & (F.col("a_name_acronym") == F.col("b_name_nospace"))) | ((F.col("b_name_acronym") != "") & (F.col("b_name_acronym") == F.col("a_name_nospace")))}
    found |= {"legal_state": sim.tri_state(text("a_name_legal"), text("b_name_legal")), "nm_ntok_min": F.least(na, nb), "nm_ntok_diff": F.abs(na - nb), "nm_len_ratio": F.least(F.length(an), F.length(bn)) / F.greatest(F.length(an), F.length(bn), F.lit(1))}
    found |= {"ad_empty": (aa == "").cast("int") + (ba == "").cast("int"), "lm_tset": F.when((la != "") & (lb != ""), F.col("_s.lm")).otherwise(-1.0)}
    found |= {"lm_cross": F.greatest(F.when(la != "", F.col("_s.lm_a")).otherwise(-1.0), F.when(lb != "", F.col("_s.lm_b")).otherwise(-1.0))}
    for name, source in (("nm", "_n"), ("ad", "_a")):
        found |= {f"{name}_{k}": F.col(f"{source}.{k}") for k in ("wjac", "max_idf", "n_shared", "unexpl_min", "unexpl_max", "overlap", "both_empty")}
    found |= {"nm_s1_max_idf": F.coalesce(F.array_max(F.transform("a_name_idf", lambda t: F.substring_index(t, "\x00", -1).cast("double"))), F.lit(0.0))}
    found |= {k: F.col(f"_d.{k}") for k in ("pc_state", "pc3_eq", "house_state", "num_jac", "num_conflict", "num_both")}
    found |= {"country_state": sim.tri_state("a_country_norm", "b_country_norm"), "tgt_is_s3": F.col("b_source") == "S3"}
    kept = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]
    return s.select(*kept, *[c.cast("double").alias(k) for k, c in found.items()])
