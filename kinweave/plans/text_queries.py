"""Queries of sources, sinks and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, text, vocab
from ..operators import clean
from ..sources import tables
from ..sources.staging import shared_folder, staged
from .base import REC, TRUTH, inline, query, rec, table, truth, values

Q = "'{}'".format


def in_list(words) -> str:
    return ", ".join(Q(w) for w in sorted(set(words)))


@query("scan_union_sources", f"WITH {REC} SELECT doc_id, src = 'S3' AS is_s3, len(toks)::BIGINT AS n_tokens FROM rec WHERE src <> 'S1'")
def scan_union_sources(spark, sf_dir):
    r = rec(spark, sf_dir).select("doc_id", "src", F.size("toks").cast("long").alias("n_tokens"))
    return tables.union_targets(r.where("src = 'S2'").drop("src"), r.where("src = 'S3'").drop("src"))


LISTS = ["1,2, 3", " 7 ,,8", "", "x", " , "]


@query("parse_id_list", f"SELECT id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS ids FROM {values(LISTS)}")
def parse_id_list(spark, sf_dir):
    return inline(spark, LISTS).select("id", F.array_join(tables.id_list("t"), "|").alias("ids"))


@query(
    "explode_truth_links",
    f"""WITH {REC}, {TRUTH}, lists AS (SELECT i1, string_agg(it::VARCHAR, ',' ORDER BY it::VARCHAR) AS m FROM truth GROUP BY i1),
    links AS (SELECT i1::VARCHAR AS i1, unnest(string_split(m, ',')) AS it FROM lists)
    SELECT it, min(i1) AS owner, count(*)::BIGINT AS n FROM links GROUP BY it""",
)
def explode_truth_links(spark, sf_dir):
    lists = truth(rec(spark, sf_dir)).groupBy(F.col("i1").cast("string").alias("i1")).agg(F.array_join(F.sort_array(F.collect_list(F.col("it").cast("string"))), ",").alias("m"))
    links = tables.truth_links(lists.select("i1", tables.id_list("m").alias("matches")))
    return tables.owners(links).join(links.groupBy("it").agg(F.count("*").alias("n")), "it")


@query(
    "write_roundtrip_lists",
    f"""WITH {REC}, {TRUTH}, l AS (SELECT i1, string_agg('T-' || it, ',' ORDER BY 'T-' || it) AS m FROM truth GROUP BY i1)
    SELECT 'S1-' || doc_id AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM rec LEFT JOIN l ON l.i1 = doc_id WHERE side = 's1'""",
)
def write_roundtrip_lists(spark, sf_dir):
    import uuid

    r = rec(spark, sf_dir)
    links = truth(r).select(F.concat(F.lit("S1-"), "i1").alias("i1"), F.concat(F.lit("T-"), "it").alias("it"))
    records = r.where("side = 's1'").select(F.concat(F.lit("S1-"), "doc_id").alias("i1"))
    path = f"{shared_folder(spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    tables.write_lists(records, links, path)
    found = staged(tables.read_tsv(spark, path, tables.TRUTH))
    tables.remove(spark, path)
    return found


ACCENTS_SQL = "lower(strip_accents(replace(coalesce(text, ''), 'ß', 'ss')))"


@query("fold_latin", f"SELECT doc_id, md5({ACCENTS_SQL}) AS folded FROM documents")
def fold_latin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_latin("text")).alias("folded"))


@query(
    "basic_clean",
    rf"""WITH a AS (SELECT doc_id, replace(replace({ACCENTS_SQL}, '&', ' and '), '@', ' at ') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\p{{L}}\p{{N}}_])''s\b', '\1s', 'g'), '[''’`]', '', 'g') AS t FROM a)
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM b""",
)
def basic_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.basic_clean("text")).alias("cleaned"))


def nested_replace(x: str, pairs) -> str:
    for a, b in pairs:
        if a == "c(?!h)":  # twice, because a match takes the next letter with it
            x = f"regexp_replace(regexp_replace({x}, 'c([^h]|$)', '{b}\\1', 'g'), 'c([^h]|$)', '{b}\\1', 'g')"
        else:
            x = f"replace({x}, {Q(a)}, {Q(b)})"
    return x


#: tok(w) -> sk(w, s): sound-alike keys of distinct words in SQL.
SKELETON_SQL = f"""k1 AS (SELECT w, {nested_replace("CASE WHEN regexp_matches(w, '[a-z]') THEN translate(w, '0153', 'olse') ELSE w END", vocab.SOUNDS)} AS r FROM tok),
  k2 AS (SELECT w, string_split(substr(r, 1, 1) || translate(substr(r, 2), 'aeouy', ''), '') AS l FROM k1),
  sk AS (SELECT w, coalesce(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ''), '') AS s FROM k2)"""
WORDS_SQL = f"{REC}, tok AS (SELECT DISTINCT unnest(toks) AS w FROM rec)"


def words(spark, sf_dir):
    return rec(spark, sf_dir).select(F.explode("toks").alias("w")).distinct()


@query("skeleton_v2", f"WITH {WORDS_SQL}, {SKELETON_SQL} SELECT w, s FROM sk")
def skeleton_v2(spark, sf_dir):
    return words(spark, sf_dir).select("w", text.skeleton("w").alias("s"))


@query(
    "skeleton_v1",
    f"""WITH {WORDS_SQL}, a AS (SELECT w, string_split({nested_replace("w", vocab.SOUNDS_OLD)}, '') AS l FROM tok),
    b AS (SELECT w, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '') AS r FROM a)
    SELECT w, CASE WHEN length(r) > 3 THEN substr(r, 1, 1) || translate(substr(r, 2), 'aeiou', '') ELSE r END AS s FROM b""",
)
def skeleton_v1(spark, sf_dir):
    return words(spark, sf_dir).select("w", text.skeleton_old("w").alias("s"))


UNLEET_SQL = "CASE WHEN regexp_matches({0}, '[0-9]') AND NOT regexp_matches({0}, '^[0-9]+(st|nd|rd|th)$') AND length(regexp_replace({0}, '[^a-z]', '', 'g')) >= 3 THEN translate({0}, '01534', 'olsea') ELSE {0} END"


@query("leet_fix", f"WITH x AS (SELECT c_custkey, replace(lower(c_name), '#', '') AS w FROM customer) SELECT c_custkey, {UNLEET_SQL.format('w')} AS fixed FROM x")
def leet_fix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.unleet(F.replace(F.lower("c_name"), F.lit("#"), F.lit(""))).alias("fixed"))


@query(
    "strip_junk",
    r"""WITH x AS (SELECT c_custkey, lower(c_name) || ' (id: ' || c_custkey || ') - 1234567 | tail' AS t FROM customer),
    y AS (SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(t, '\(\s*id\s*:?\s*[0-9]+\s*\)', ' ', 'g'), '\|.*$', ' '), '\s-\s*[0-9]{6,}', ' ', 'g') AS t FROM x),
    z AS (SELECT c_custkey, t, regexp_replace(t, '#\s*[0-9]+', ' ', 'g') AS bare FROM y)
    SELECT c_custkey, CASE WHEN regexp_matches(bare, '[a-z]') THEN bare ELSE t END AS stripped FROM z""",
)
def strip_junk(spark, sf_dir):
    t = F.concat(F.lower("c_name"), F.lit(" (id: "), "c_custkey", F.lit(") - 1234567 | tail"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_junk(t).alias("stripped"))


@query(
    "extract_domain",
    rf"""WITH x AS (SELECT page_id, replace(regexp_extract(lower(url), '(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:com|c0m|co\.in|in|net|org|co|fr|biz|io|info)\b', 1), '-', '') AS w FROM pages)
    SELECT page_id, {UNLEET_SQL.format('w')} AS domain FROM x""",
)
def extract_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain_of(F.lower("url")).alias("domain"))


NAMES = ["acme tools dba best one", "dba acme", "acme aka best fka old", "acme acme tools tools acme", "a b c", "", "late mr smith and co ltd", "the of and", "global trading group", "silver foundation private limited", "acme llc"]


@query(
    "alias_split",
    f"""WITH x AS (SELECT id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM {values(NAMES)}),
    y AS (SELECT id, w, list_min(list_filter(range(1, len(w) + 1), lambda i: i > 1 AND w[i] IN ({in_list(vocab.ALIAS_WORDS)}))) AS p FROM x)
    SELECT id, array_to_string(CASE WHEN p IS NULL THEN w ELSE w[1:p - 1] END, ' ') AS main,
           array_to_string(CASE WHEN p IS NULL THEN [] ELSE list_filter(w[p + 1:], lambda v: v NOT IN ({in_list(vocab.ALIAS_WORDS)})) END, ' ') AS alias FROM y""",
)
def alias_split(spark, sf_dir):
    s = inline(spark, NAMES).withColumn("s", text.split_alias(text.tokens("t")))
    return s.select("id", F.array_join("s.main", " ").alias("main"), F.array_join("s.alias", " ").alias("alias"))


@query("dedupe_neighbours", f"WITH {REC} SELECT doc_id, len(list_filter(toks, lambda x, i: i = 1 OR x <> toks[i - 1]))::BIGINT AS n, md5(coalesce(array_to_string(list_filter(toks, lambda x, i: i = 1 OR x <> toks[i - 1]), ' '), '')) AS h FROM rec")
def dedupe_neighbours(spark, sf_dir):
    d = rec(spark, sf_dir).select("doc_id", text.drop_repeats(F.col("toks")).alias("d"))
    return d.select("doc_id", F.size("d").cast("long").alias("n"), F.md5(F.array_join("d", " ")).alias("h"))


LEGAL_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in vocab.LEGAL.items())


@query(
    "split_legal_core",
    f"""WITH x AS (SELECT id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM {values(NAMES)}), lg(v, c) AS (VALUES {LEGAL_VALUES}),
    a AS (SELECT id, w, list_filter(w, lambda v: v NOT IN ({in_list([*vocab.LEGAL, *vocab.HONORIFICS, *vocab.STOP])})) AS c1, list_filter(w, lambda v: v NOT IN ({in_list(vocab.STOP)})) AS c2 FROM x),
    b AS (SELECT id, w, CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 ELSE w END AS core FROM a),
    c AS (SELECT id, core, list_filter(core, lambda v: v NOT IN ({in_list(vocab.FILLER)})) AS k FROM b),
    l AS (SELECT id, string_agg(DISTINCT c, ' ' ORDER BY c) AS legal FROM (SELECT id, unnest(w) AS v FROM x) JOIN lg USING (v) GROUP BY id)
    SELECT id, array_to_string(core, ' ') AS core, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE core END, ' ') AS core2, coalesce(legal, '') AS legal FROM c LEFT JOIN l USING (id)""",
)
def split_legal_core(spark, sf_dir):
    s = inline(spark, NAMES).withColumn("s", text.core_of(text.tokens("t")))
    return s.select("id", *[F.array_join(F.col(f"s.{k}"), " ").alias(k) for k in ("core", "core2", "legal")])


ADDRESSES = ["larkspur ct, dunmore, tx", "2207 larkspur court, old mills, tx", "texas, 84 quarry trailer homes, dunmor city", "c/o mira paul, thazhevettom, kerala", "flat 12, 004410 main st, new york, 10001", "12 rue des lilas, 69003 lyon, ile de france", "unit 5 77 elm street, west bengal, 560001", "po box 77, null, 3rd floor 9 oak ave"]


@query("address_tokens", f"SELECT id, array_to_string(regexp_extract_all(regexp_replace(translate(regexp_replace(t, '\\b([0-9]+)(st|nd|rd|th|er|eme|ere|e)\\b', '\\1', 'g'), '/-''', '   '), '[^a-z0-9 ]+', ' ', 'g'), '[a-z]+|[0-9]+'), ' ') AS words FROM {values(ADDRESSES)}")
def address_tokens(spark, sf_dir):
    return inline(spark, ADDRESSES).select("id", F.array_join(address.component_tokens(F.col("t")), " ").alias("words"))


@query(
    "street_number",
    """SELECT * FROM (VALUES (1, '', '', '', 'larkspur ct dunmore', false), (2, '2207', '', '2207', 'larkspur ct old mills', false), (3, '84', '', '84', 'quarry trailer homes dunmor', false),
    (4, '', '', '', 'mira paul thazhevettom', false), (5, '4410', '10001', '12 4410 10001', 'main st', false), (6, '12', '69003', '12 69003', 'rue lilas lyon', false),
    (7, '77', '560001', '5 77 560001', 'elm st', false), (8, '3', '', '3 9', 'oak ave', false)) AS v(id, num1, pc, nums, words, empty)""",
)
def street_number(spark, sf_dir):
    p = inline(spark, ADDRESSES).withColumn("p", address.address_parts("t"))
    return p.select("id", "p.num1", "p.pc", F.array_join("p.nums", " ").alias("nums"), F.array_join("p.words", " ").alias("words"), "p.empty")


STATE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in vocab.states().items())
PLACES = ["ohio", "oh", "New York", "tamil nadu", "ts", "ile de france", "surat", "", "12", "ct"]


@query("state_lookup", f"WITH s(k, c) AS (VALUES {STATE_VALUES}) SELECT id, coalesce(c, '') AS state FROM {values([p.lower() for p in PLACES])} LEFT JOIN s ON k = t")
def state_lookup(spark, sf_dir):
    return inline(spark, [p.lower() for p in PLACES]).select("id", address.state_of(F.col("t")).alias("state"))


@query("street_key", "SELECT * FROM (VALUES (1, 'lrkspr', 'tx'), (2, 'lrkspr', 'tx'), (3, '', 'tx'), (4, '', 'kl'), (5, '', 'ny'), (6, 'ls', 'idf'), (7, 'elm', 'wb'), (8, 'ok', '')) AS v(id, street, state)")
def street_key(spark, sf_dir):
    p = inline(spark, ADDRESSES).withColumn("p", address.address_parts("t"))
    return p.select("id", F.array_join("p.street", " ").alias("street"), "p.state")


INDIC = ["कमल", "আলো", "ਪੰਜਾਬ", "தமிழ்", "Crème Østgård", ""]


@query("translit_indic", "SELECT * FROM (VALUES (1, 'kamal', true, 'DEVANAGARI'), (2, 'aalo', true, 'BENGALI'), (3, 'panjaab', true, 'GURMUKHI'), (4, 'tamil', true, 'TAMIL'), (5, 'creme østgard', false, ''), (6, '', false, '')) AS v(id, folded, native, script)")
def translit_indic(spark, sf_dir):
    return inline(spark, INDIC).select("id", text.fold_text("t").alias("folded"), text.is_native("t").alias("native"), text.scripts("t").alias("script"))


@query("segment_words", "SELECT p_partkey, lower(p_name) AS words FROM part")
def segment_words(spark, sf_dir):
    """Part names run together and split into the words of all part names. The vocabulary (not the rows) is collected."""
    counts = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).groupBy("w").count().collect()
    total = sum(r["count"] for r in counts) or 1
    import math

    frequency = {r["w"]: math.log(r["count"] / total) for r in counts if len(r["w"]) > 1}
    names = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("joined"))
    return names.select("p_partkey", F.array_join(text.segment_words("joined", frequency), " ").alias("words"))


@query("single_letter_runs", "SELECT * FROM (VALUES (1, 'abc corp'), (2, 'x'), (3, 'a bc de'), (4, 'an ab')) AS v(id, joined)")
def single_letter_runs(spark, sf_dir):
    return inline(spark, ["a b c corp", "x", "a bc d e", "an a b"]).select("id", text.join_single_letters("t").alias("joined"))


@query(
    "names_and_addresses_v2",
    f"""WITH b AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, c_nationkey AS n, c_name || ' ' || c_mktsegment || ' co ltd' AS nm, c_custkey || ' main st, unit ' || c_nationkey || ', oh' AS ad FROM customer),
    tok AS (SELECT DISTINCT seg AS w FROM b UNION SELECT 'customer'), {SKELETON_SQL},
    s AS (SELECT b.*, x.s AS s1, y.s AS s2 FROM b JOIN sk x ON x.w = seg JOIN sk y ON y.w = 'customer')
    SELECT 'S2-' || k AS entity_id, 'customer ' || seg || ' co ltd' AS nm_full, 'customer ' || seg AS nm_core, 'customer ' || seg AS nm_core2, least('customer', seg) || ' ' || greatest('customer', seg) AS nm_key,
      least(s1, s2) || ' ' || greatest(s1, s2) AS nm_skel, '' AS nm_alias, 'co ltd' AS nm_legal, 'main st' AS ad_words, 'main st' AS ad_wset, CASE WHEN k = n THEN k::VARCHAR ELSE k || ' ' || n END AS ad_nums, '' AS ad_street,
      'customer' || seg AS nm_nospace, 2 AS nm_ntok, k::VARCHAR AS ad_num1, CASE WHEN k >= 10000 AND k < 1000000 THEN k::VARCHAR ELSE '' END AS ad_pc, 'oh' AS ad_state, false AS ad_empty, lower(nm) || ' | ' || lower(ad) AS txt, false AS is_s3 FROM s""",
)
def names_and_addresses_v2(spark, sf_dir):
    """Customers as business records: every cleaned view."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("S2-"), "c_custkey").alias("entity_id"), F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" co ltd")).alias("business_name"), F.concat("c_custkey", F.lit(" main st, unit "), "c_nationkey", F.lit(", oh")).alias("business_address"), F.lit("US").alias("country"))
    done = clean.clean_records(c)
    return done.select("entity_id", *[F.array_join(x, " ").alias(x) for x in ("nm_full", "nm_core", "nm_core2", "nm_key", "nm_skel", "nm_alias", "nm_legal", "ad_words", "ad_wset", "ad_nums", "ad_street")], "nm_nospace", "nm_ntok", "ad_num1", "ad_pc", "ad_state", "ad_empty", "txt", "is_s3")


@query(
    "names_and_addresses_v1",
    """WITH b AS (SELECT s_suppkey AS k, lower(replace(s_name, '#', ' ')) AS nm, substr(s_name, 10) AS num FROM supplier),
    d AS (SELECT *, string_split(num, '') AS l FROM b), s AS (SELECT *, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '') AS sk FROM d)
    SELECT 'S3-' || k AS entity_id, nm || ' svc' AS name_canon, nm || ' svc' AS name_core, nm || ' svc' AS name_aliases, 'ltd pvt' AS name_legal, 'splr ' || sk || ' svc' AS name_skel, k || ' main st ny 10001' AS addr_core,
      'main st ny' AS addr_words, 'near mkt' AS addr_landmark, k || ' 10001' AS addr_nums, 'mn st ni' AS addr_skel, nm || ' services pvt ltd' AS name_clean, 'ss' AS name_acronym, replace(nm, ' ', '') || 'svc' AS name_nospace,
      '10001' AS addr_postcode, k::VARCHAR AS addr_house, 'us' AS country_norm, nm || ' svc ' || k || ' main st ny 10001' AS "full", 'S3' AS source FROM s""",
)
def names_and_addresses_v1(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S3-"), "s_suppkey").alias("entity_id"), F.concat("s_name", F.lit(" Services Pvt Ltd")).alias("business_name"), F.concat("s_suppkey", F.lit(" Main Street, near the market, New York 10001-2222")).alias("business_address"), F.lit("United States").alias("country"))
    done = clean.clean_old(c)
    return done.select("entity_id", *[F.array_join(x, " ").alias(x) for x in ("name_canon", "name_core", "name_aliases", "name_legal", "name_skel", "addr_core", "addr_words", "addr_landmark", "addr_nums", "addr_skel")], "name_clean", "name_acronym", "name_nospace", "addr_postcode", "addr_house", "country_norm", "full", "source")
