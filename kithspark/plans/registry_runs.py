"""Queries of sources and sinks, made-up names, addresses, seeded hashes, whole feature tables, tuning, plans and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithspark.functions.text import bucket, fold, indel_ratio, token_set_ratio
from kithspark.operators import audits, decide, learn, metrics, splits
from kithspark.operators import pair_features as pf
from kithspark.operators import retrieval as rt
from kithspark.operators import views as vw
from kithspark.plans import experiments, oracle, registry, runs
from kithspark.plans.oracle import F05, distinct_in_order, except_, jaccard, sql, strings, tokens
from kithspark.plans.oracle import fold as sql_fold
from kithspark.plans.registry import _big, _joined, _r, query
from kithspark.scratch import cut, scratch_path
from kithspark.session import table
from kithspark.sources import adapters, tables

# sources and sinks ---------------------------------------------------------------------------------------------------
_RAW = """SELECT 'P-' || p_partkey AS id, p_name AS name, p_brand || ', "' || p_type || '"' AS addr, 'US' AS country, NULL AS src FROM part"""


def _ingested(spark, d):
    """Raw tab-separated files of three sources and a list of matches, written, then ingested once and again."""
    raw, to = scratch_path(spark), scratch_path(spark)
    part, customer, supplier = (table(spark, d, t) for t in ("part", "customer", "supplier"))
    of = lambda df, p, k, name, addr: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("entity_id"), F.col(name).alias("name"), addr.alias("addr"), F.lit("US").alias("country"))
    tables.write_tsv(of(part, "P-", "p_partkey", "p_name", F.concat(F.col("p_brand"), F.lit(', "'), F.col("p_type"), F.lit('"'))), f"{raw}/train_s1.tsv")
    tables.write_tsv(of(customer, "C-", "c_custkey", "c_name", F.col("c_mktsegment")), f"{raw}/train_s2.tsv")
    tables.write_tsv(of(supplier, "S-", "s_suppkey", "s_name", F.lit("")), f"{raw}/train_s3.tsv")
    lists = customer.groupBy(F.concat(F.lit("N-"), F.col("c_nationkey").cast("string")).alias("n")).agg(F.array_join(F.collect_list(F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))), ",").alias("m"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("n"))
    tables.write_tsv(nations.join(lists, "n", "left").select("n", F.coalesce("m", F.lit("")).alias("m")), f"{raw}/train_gt.tsv")
    for _ in range(2):
        tables.ingest(spark, raw, to, ("train",))
    return to


@query(f"""{_RAW} UNION ALL SELECT 'C-' || c_custkey, c_name, c_mktsegment, 'US', CAST(2 AS TINYINT) FROM customer
UNION ALL SELECT 'S-' || s_suppkey, s_name, '', 'US', CAST(3 AS TINYINT) FROM supplier""")
def ingest_sources(spark, d):
    at = _ingested(spark, d)
    return tables.load(spark, at, "train", 1).withColumn("src", F.lit(None).cast("byte")).unionByName(tables.load_recs(spark, at, "train"))


@query("SELECT 'N-' || c_nationkey AS s1_id, 'C-' || c_custkey AS rec_id FROM customer")
def ingest_truth(spark, d):
    return tables.load_truth(spark, _ingested(spark, d))


@query(sql("SELECT rec_id, s1_id, hits FROM top", "top"))
def pair_sink(spark, d):
    at = scratch_path(spark)
    tables.write_pairs(registry._top(spark, d)[3], at)
    return spark.read.parquet(at)


@query("""SELECT * FROM (VALUES ('E-00', '', 'devval', '0.63965', 'KEEP', 'floor | first'), ('E-00', '', 'devtrain', '0.6', 'INFO', ''), ('E-01', 'E-00', 'devval', '0.7', 'KILL', 'names | '))
AS t(exp_id, parent_id, subset, macro_f05, conclusion, notes)""".replace("'names | '", "'names'"))
def experiment_log(spark, d):
    at = scratch_path(spark)
    experiments.log_experiment(spark, at, "E-00", subset="devval", macro_f05=0.6396512, notes="first")
    experiments.log_experiment(spark, at, "E-00", subset="devtrain", macro_f05=0.6)
    experiments.log_experiment(spark, at, "E-01", subset="devval", macro_f05=0.7)
    experiments.conclude(spark, at, "E-00", "KEEP", "floor")
    experiments.conclude(spark, at, "E-01", "KILL", "names")
    return experiments.read_log(spark, at).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("exp_id", "parent_id", "subset", "macro_f05", "conclusion", "notes")])


@query("""SELECT * FROM (VALUES ('E-00', 'E-00'), ('E-01', 'E-01'), ('E-07', 'E-07'), ('E-07b', 'E-07b'), ('E-08', 'E-07b'), ('E-09', 'E-07'), ('E-10', 'E-07b'), ('E-11', 'E-07b'), ('E-12', 'E-07'),
('E-13', 'E-07'), ('E-14', 'E-07b'), ('E-11h', 'E-07b'), ('E-11p', 'E-07p'), ('E-11q', 'E-07q'), ('E-11r', 'E-07r'), ('E-11s', 'E-07s'), ('E-11v', 'E-07s'), ('E-11x', 'E-07s')) AS t(experiment, pairs_of)""")
def pair_cache(spark, d):
    """Experiments that share a pair table: the first with the same place in the cache, by order of the registry."""
    asked = "E-00 E-01 E-07 E-07b E-08 E-09 E-10 E-11 E-12 E-13 E-14 E-11h E-11p E-11q E-11r E-11s E-11v E-11x".split()
    first: dict[str, str] = {}
    places = {e: experiments.pairs_path("", experiments.config(e), "dev") for e in experiments.EXPERIMENTS}
    for e in ("E-00", "E-01", "E-07", "E-07b", "E-07p", "E-07q", "E-07r", "E-07s"):
        first.setdefault(places[e], e)
    return spark.createDataFrame([(e, first[places[e]]) for e in asked], "experiment string, pairs_of string")


# names ---------------------------------------------------------------------------------------------------------------
_wrapped = """SELECT 'P-' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Old House Co. formerly known as: ' || p_name || ' L.L.C.' WHEN 1 THEN p_name || ' (ID: ' || p_partkey || ')'
  WHEN 2 THEN 'Some Firm d/b/a ' || p_name || ' P.C.' WHEN 3 THEN p_name || ' #' || p_partkey || ' S.A.R.L.' ELSE 'The ' || upper(p_name) || ' & Co Pvt. Ltd.' END AS name FROM part"""
_undot = sql_fold("name")
for _p in (r"\b([a-z])\.([a-z])\.", r"\b([a-z])\.([a-z])\b") * 2:
    _undot = f"regexp_replace({_undot}, '{_p}', '\\1\\2', 'g')"


def _bare(folded: str) -> str:
    return rf"regexp_replace(coalesce(nullif(regexp_extract({folded}, '{vw.WRAPPER}', 1), ''), {folded}), '\(id:?\s*\d+\)|#\s*\d+', ' ', 'g')"


def _key(n: str) -> str:
    return f"array_to_string(list_sort(list_distinct({except_(tokens(n), strings(vw.STOP + vw.LEGAL + vw.LEGAL_FR))})), ' ') AS nkey"


def _legal(n: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_intersect({tokens(n, '[a-z]+')}, {strings(vw.LEGAL + vw.LEGAL_FR)}))), ' ') AS lt"


@query(f"SELECT id, {_key('n')}, {_legal('n')} FROM (SELECT id, {_bare(sql_fold('name'))} AS n FROM ({_wrapped}))")
def name_wrappers_v2(spark, d):
    return vw.name_view(adapters.wrapped_names(spark, d), "V2").select("id", "nkey", _joined("lt"))


@query(f"SELECT id, {_key('n')}, {_legal('n')} FROM (SELECT id, {_bare('u')} AS n FROM (SELECT id, {_undot} AS u FROM ({_wrapped})))")
def name_wrappers_v4(spark, d):
    return vw.name_view(adapters.wrapped_names(spark, d), "V4").select("id", "nkey", _joined("lt"))


_words = "array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ')"


@query(f"""SELECT 'P-' || p_partkey AS id, CASE WHEN p_partkey % 3 = 2 AND length(replace(p_name, ' ', '')) < 7 THEN replace(p_name, ' ', '') || 'com' ELSE {_words} END AS nkey FROM part""")
def name_domains(spark, d):
    """Part names as domains and handles come apart into their own words; what is short and only ends in com isn't a domain."""
    words = vw.vocabulary(table(spark, d, "part").select(F.col("p_name").alias("name")))
    return vw.name_view(adapters.domain_names(spark, d), "V2", words).select("id", "nkey")


@query(f"""SELECT DISTINCT translate(w, '{adapters.LATIN}', '{adapters.NATIVE}') AS t, w AS t1 FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)""")
def native_dictionary(spark, d):
    s1, recs, truth = adapters.native_names(spark, d)
    return vw.learn_dictionary(recs, s1, truth)


@query(f"SELECT 'S2-' || p_partkey AS id, {_words} AS nkey FROM part")
def name_view_v3(spark, d):
    s1, recs, truth = adapters.native_names(spark, d)
    return vw.name_view(recs, "V3", None, vw.learn_dictionary(recs, s1, truth)).select("id", "nkey")


@query("SELECT 'name_only' AS stratum, count(*) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'indic', count(*) FROM part WHERE p_partkey % 2 = 1")
def strata_native(spark, d):
    s1, recs, truth = adapters.native_names(spark, d)
    odd = F.split("id", "-")[1].cast("bigint") % 2 == 1
    return vw.strata(s1, recs.withColumn("addr", F.when(odd, "1 road").otherwise("")), truth).groupBy("stratum").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS pairs, round(avg(CAST(p_partkey % 4 <> 0 AS INT)), 6) AS equal FROM part")
def audit_native_rows(spark, d):
    s1, recs, truth = adapters.native_names(spark, d)
    more = F.split("id", "-")[1].cast("bigint") % 4 == 0
    return audits.native_alignment(s1.withColumn("name", F.when(more, F.concat("name", F.lit(" two"))).otherwise(F.col("name"))), recs, truth).select("pairs", _r("equal"))


# addresses, hashes ---------------------------------------------------------------------------------------------------
def _replaced(x: str, phrases: dict[str, str]) -> str:
    """Whole-word phrases of a text whose words are parted by two spaces, longer phrases first, in one pass."""
    for k in sorted((k for k in phrases if " " in k), key=lambda k: -len(k)):
        x = f"replace({x}, ' {k.replace(' ', '  ')} ', ' <{phrases[k].replace(' ', '_')}> ')"
    single = {k: v for k, v in phrases.items() if " " not in k}
    known = f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in single.items())}}}"
    words = f"list_filter(list_transform(regexp_split_to_array(trim({x}), ' +'), lambda w: coalesce({known}[w], w)), lambda w: w <> '')"
    return f"('  ' || replace(translate(array_to_string({words}, '  '), '<>', ''), '_', '  ') || '  ')"


_padded = f"('  ' || trim(regexp_replace(regexp_replace({sql_fold('addr')}, '<null>|\\bnull\\b', ' ', 'g'), '[^a-z0-9]+', '  ', 'g')) || '  ')"
_by_country = f"CASE country WHEN 'US' THEN {_replaced('x', vw.US_STATES)} WHEN 'India' THEN {_replaced('x', vw.INDIAN_STATES)} WHEN 'France' THEN {_replaced('x', vw.FRENCH_PARTS)} ELSE x END"


def _a3(rows: str) -> str:
    nums = distinct_in_order("list_transform(" + tokens("a", "[0-9]+") + ", lambda v: TRY_CAST(v AS BIGINT))")
    return f"""SELECT id, array_to_string(list_sort(list_distinct({tokens('a')})), ' ') AS at, CAST(list_filter({nums}, lambda v: v IS NOT NULL)[1] AS VARCHAR) AS house
FROM (SELECT id, {_replaced('y', vw.ABBREVIATIONS)} AS a FROM (SELECT id, {_by_country} AS y FROM (SELECT id, country, {_padded} AS x FROM {rows})))"""


@query(sql(_a3("er"), "er"))
def addr_view_a3(spark, d):
    return vw.addr_view(adapters.er_records(spark, d), "A3").select("id", _joined("at"), "house")


_street = """(SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' ELSE 'X' END AS country,
  s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN ' N Main St, New York, West Virginia' WHEN 1 THEN ' second str., MH / TN <null>' WHEN 2 THEN ' bd. Pas de Calais, Nord' WHEN 3 THEN ' Ave NE, District of  Columbia' ELSE ' Hwy null 007' END AS addr FROM supplier)"""


@query(_a3(_street))
def addr_expansion(spark, d):
    """Streets with abbreviations, states of one and more words, and placeholders, in every country."""
    k = F.col("s_suppkey")
    country = F.element_at(F.array(*map(F.lit, ("US", "India", "France", "X"))), (k % 4 + 1).cast("int"))
    ends = (" N Main St, New York, West Virginia", " second str., MH / TN <null>", " bd. Pas de Calais, Nord", " Ave NE, District of  Columbia", " Hwy null 007")
    rows = table(spark, d, "supplier").select(k.alias("id"), country.alias("country"), F.concat(k.cast("string"), F.element_at(F.array(*map(F.lit, ends)), (k % 5 + 1).cast("int"))).alias("addr"))
    return vw.addr_view(rows, "A3").select("id", _joined("at"), "house")


@query(sql(f"SELECT id, CASE WHEN trim(addr) <> '' THEN {oracle.digits(f"array_to_string(list_sort(list_distinct({tokens(sql_fold('addr'))})), ' ')", 15)} END AS sig FROM er", "er"))
def address_signature(spark, d):
    return adapters.er_records(spark, d).select("id", vw.addr_signature(F.col("addr")).alias("sig"))


@query(f"SELECT o_orderkey, {oracle.bucket('CAST(o_custkey AS VARCHAR)', 17, 5)} AS fold FROM orders WHERE {oracle.bucket('CAST(o_custkey AS VARCHAR)', 11, 1000)} < 137")
def hash_sample(spark, d):
    """A hashed sample that keeps or leaves all orders of a customer, with seeded folds."""
    return vw.sampled(table(spark, d, "orders"), "o_custkey", 11, 1000, 137).select("o_orderkey", bucket(F.col("o_custkey"), 17, 5).alias("fold"))


# fuzzy ratios, whole feature tables ----------------------------------------------------------------------------------
def _lcs(a: str, b: str) -> str:
    """Longest common subsequence of two strings of at most 60 characters, a word of bits for a character of b."""
    full = f"((1::BIGINT << CAST(length({a}) AS INT)) - 1)"
    at = f"list_transform(range(1, length({b}) + 1), lambda j: coalesce(list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, CAST(i + 1 AS INT), 1) = substr({b}, CAST(j AS INT), 1) THEN 1::BIGINT << CAST(i AS INT) ELSE 0 END)), 0)::BIGINT)"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], {at}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def _indel(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE CAST(200 AS DOUBLE) * {_lcs(a, b)} / (length({a}) + length({b})) END)"


@query(f"""WITH n AS (SELECT p_partkey, p_name AS a, lead(p_name, 1, '') OVER (ORDER BY p_partkey) AS b FROM part),
s AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda w: w <> '')) AS y FROM n),
t AS (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, array_to_string(list_sort({except_('x', 'y')}), ' ') AS p, array_to_string(list_sort({except_('y', 'x')}), ' ') AS q FROM s),
u AS (SELECT *, trim(c || ' ' || p) AS cp, trim(c || ' ' || q) AS cq FROM t),
d AS (SELECT DISTINCT a, b, x, y, c, p, q, cp, cq FROM u),
r AS (SELECT a, b, round({_indel('a', 'b')}, 6) AS ratio, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN c <> '' AND (p = '' OR q = '') THEN 100.0
  WHEN c = '' THEN {_indel('cp', 'cq')} ELSE greatest({_indel('cp', 'cq')}, {_indel('c', 'cp')}, {_indel('c', 'cq')}) END, 6) AS token_set FROM d)
SELECT p_partkey, ratio, token_set FROM n JOIN r USING (a, b)""")
def fuzzy_ratios(spark, d):
    """Indel and token-set ratios of each part name and the next one's."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = part.join(following, "p_partkey", "left").na.fill("", ["b"])
    return both.select("p_partkey", F.round(indel_ratio("a", "b"), 6).alias("ratio"), F.round(token_set_ratio("a", "b"), 6).alias("token_set"))


_num = "list_intersect(nums_s, nums_r)"
_gone, _new = f"{except_('nums_s', 'nums_r')}[1]", f"{except_('nums_r', 'nums_s')}[1]"
_leg_a, _leg_d = f"len({except_('lt_r', 'lt_s')})", f"len({except_('lt_s', 'lt_r')})"
_EXACT = {
    "nj": jaccard("nt_r", "nt_s"), "aj": jaccard("at_r", "at_s"), "sj": jaccard("st_r", "st_s"), "n_inter": "len(list_intersect(nt_r, nt_s))",
    "nlen_r": "len(nt_r)", "nlen_s": "len(nt_s)", "alen_r": "len(at_r)", "alen_s": "len(at_s)", "aempty": "CAST(len(at_r) = 0 AS INT)",
    "n1": "len(nums_s)", "nr": "len(nums_r)", "ncover": f"len({_num}) / nullif(CAST(len(nums_s) AS DOUBLE), 0)", "nmiss": f"len(nums_s) - len({_num})", "nextra": f"len(nums_r) - len({_num})",
    "first_eq": "CAST(nums_s[1] = nums_r[1] AS INT)", "ndiff": f"abs({_gone} - {_new})", "ntrunc": f"CAST(ends_with(CAST({_gone} AS VARCHAR), CAST({_new} AS VARCHAR)) AS INT)",
    "leg_add": _leg_a, "leg_del": _leg_d, "grp_add": f"CAST(list_contains({except_('lt_r', 'lt_s')}, 'group') AS INT)",
    "leg_rel": f"CASE WHEN {_leg_a} = 0 AND {_leg_d} = 0 THEN 0 WHEN len(lt_r) = 0 THEN 1 WHEN len(lt_s) = 0 THEN 2 WHEN {_leg_a} = 0 THEN 3 WHEN {_leg_d} = 0 THEN 4 ELSE 5 END",
    "n_uns_r": f"len({except_('nt_r', 'nt_s')})", "n_uns_s": f"len({except_('nt_s', 'nt_r')})",
}
_oov = lambda key, ts, rows: f"(SELECT {key}, avg(CASE WHEN w IN (SELECT DISTINCT unnest({tokens(sql_fold('name'))}) FROM s1) THEN 0.0 ELSE 1.0 END) AS o FROM (SELECT {key}, unnest({ts}) AS w FROM {rows}) GROUP BY ALL)"
_whole = f"""SELECT * EXCLUDE (rec_id, s1_id), rec_id, s1_id FROM (
  SELECT p.rec_id, p.s1_id, {', '.join(f'{v} AS {k}' for k, v in _EXACT.items())}, CAST(src AS INT) AS src, sp_score, sp_rank, ex_hits, oov, uns_oov, n_collide, CAST(t.rec_id IS NOT NULL AS INT) AS y
  FROM (SELECT c.*, r.src, r.nt AS nt_r, s.nt AS nt_s, r.ad AS at_r, s.ad AS at_s, r.st AS st_r, s.st AS st_s, r.nums AS nums_r, s.nums AS nums_s, r.lt AS lt_r, s.lt AS lt_s
        FROM cand c JOIN view r ON r.id = c.rec_id JOIN view s ON s.id = c.s1_id) p
  LEFT JOIN (SELECT rec_id, o AS oov FROM {_oov('rec_id', 'nt', '(SELECT id AS rec_id, nt FROM view WHERE src > 1)')}) a ON a.rec_id = p.rec_id
  LEFT JOIN (SELECT rec_id, s1_id, o AS uns_oov FROM {_oov('rec_id, s1_id', except_('rn', 'sn'), '(SELECT c.rec_id, c.s1_id, r.nt AS rn, s.nt AS sn FROM cand c JOIN view r ON r.id = c.rec_id JOIN view s ON s.id = c.s1_id)')}) b ON b.rec_id = p.rec_id AND b.s1_id = p.s1_id
  JOIN (SELECT id, count(*) OVER (PARTITION BY country, nkey) AS n_collide FROM view WHERE src = 1) n ON n.id = p.s1_id
  LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.rec_id = p.rec_id AND t.s1_id = p.s1_id)"""
_PLAIN = [*_EXACT, "src", "sp_score", "sp_rank", "ex_hits", "oov", "uns_oov", "n_collide", "y"]
_CONTEXT = {
    "ncand_r": "count(*) OVER r", "ncand_s": "count(*) OVER s", "sp_rel": "CAST(sp_score AS DOUBLE) / nullif(CAST(max(sp_score) OVER r AS DOUBLE), 0)",
    "nj_gap": "max(nj) OVER r - nj", "aj_gap": "max(aj) OVER r - aj",
}


@query(sql(f"SELECT rec_id, s1_id, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS {c}' for c in _PLAIN)}, {', '.join(f'round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 4) AS {k}' for k, v in _CONTEXT.items())} FROM ({_whole}) WINDOW r AS (PARTITION BY rec_id), s AS (PARTITION BY s1_id)", "cand", "view", "s1", "truth"))
def pair_features_exact(spark, d):
    """Every feature of the last version but those of number crosses, which have a query of their own, and the fuzzy ones."""
    s1, recs, truth, _ = registry._top(spark, d)
    rows = pf.with_labels(pf.pair_features(registry._cand(spark, d).withColumns({"ch_score": F.lit(None).cast("float"), "ch_rank": F.lit(None).cast("smallint")}), s1, recs, 4, vw.vocabulary(s1), fuzzy=False), truth)
    return rows.select("rec_id", "s1_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in [*_PLAIN, *_CONTEXT]])


_WEAK = "(SELECT id FROM view WHERE src > 1 AND (len(ad) = 0 OR id NOT IN (SELECT rec_id FROM cand)))"


@query(sql(f"""SELECT coalesce(c.rec_id, h.rec_id) AS rec_id, coalesce(c.s1_id, h.s1_id) AS s1_id, round(CAST(sp_score AS DOUBLE), 4) AS sp_score, sp_rank, ex_hits,
  round(CAST(CAST(h.score AS FLOAT) AS DOUBLE), 4) AS ch_score, CAST(h.rank AS SMALLINT) AS ch_rank
FROM cand c FULL JOIN (SELECT * FROM ({oracle.sparse('gram', 'gvocab', 300, k=4)}) WHERE rec_id IN {_WEAK}) h ON h.rec_id = c.rec_id AND h.s1_id = c.s1_id""", "cand", "view", "gvocab"))
def candidates_char(spark, d):
    """Typed tokens and exact keys, and character grams for records without tokens in their address or without candidates."""
    s1, recs, _ = registry._views(spark, d)
    found = rt.candidates({"ret": "sparse+exact+char", "addr": "A2", "topk": 8, "cap": 100}, s1, recs)
    return found.select("rec_id", "s1_id", _r("sp_score", 4), "sp_rank", "ex_hits", _r("ch_score", 4), "ch_rank")


# the second stage ----------------------------------------------------------------------------------------------------
_scores = f"""SELECT t.rec_id, t.s1_id, {oracle.bucket("t.rec_id || t.s1_id", 3, 1000)} / CAST(1000 AS DOUBLE) AS p, CAST(r.src AS INT) AS src,
  CASE WHEN trim(r.addr) <> '' THEN {oracle.digits(f"array_to_string(list_sort(list_distinct({tokens(sql_fold('r.addr'))})), ' ')", 15)} END AS sig FROM top t JOIN recs r ON r.id = t.rec_id"""


def _over_scores(name: str) -> str:
    """The select of a registered query over `pred`, on other scores."""
    whole = registry._SQL[name]
    return whole[len(sql("", "pred")) :]


@query(sql(f"""SELECT a.rec_id, a.s1_id, p1, p_rank, p_r2, p_margin, CASE WHEN a.sig IS NOT NULL THEN sib_n END AS sib_n, CASE WHEN a.sig IS NOT NULL THEN sib_max END AS sib_max,
  s_hi_same, s_hi_other, s_max_other, s_sum_other, tr_min, tr_max, ts_min, ts_max, tr_n, tp_rate, tp_n
FROM pred a JOIN ({_over_scores('stage2_ctx2')}) b USING (rec_id, s1_id) JOIN ({_over_scores('stage2_siblings')}) c USING (rec_id, s1_id) JOIN ({_over_scores('stage2_xsrc')}) x USING (rec_id, s1_id)
LEFT JOIN (SELECT rec_id, s1_id, {oracle.rate_columns('rate', 'seen')} FROM ({oracle.rated('kept', 'krates', True)}) GROUP BY ALL) k USING (rec_id, s1_id)""", "top", "recs", "changed")
    .replace("\nSELECT a.rec_id", f""",
pred AS (SELECT * FROM ({_scores}) WHERE p >= 0.01), kept AS (SELECT * FROM changed SEMI JOIN pred USING (rec_id, s1_id)),
krates AS (SELECT side, t, fold, count(*) AS n, sum(CAST(y AS INT)) AS s FROM kept GROUP BY ALL)
SELECT a.rec_id""", 1))
def stage2_table(spark, d):
    """The second stage's whole table on hashed scores: the floor, all context, rates out of fold."""
    s1, recs, truth, top = registry._top(spark, d)
    pred = top.select("rec_id", "s1_id", (bucket(F.concat("rec_id", "s1_id"), 3, 1000) / F.lit(1000.0)).alias("p"))
    of = runs.Pairs(pf.with_labels(top.select("rec_id", "s1_id"), truth), s1, recs)
    out, _ = runs.stage_two_table({"stage2": ["CTX2", "SIB", "XSRC", "TOKR", "TOKP"]}, of, pred)
    rates = [_r(c) for c in ("tr_min", "tr_max", "ts_min", "ts_max")]
    return out.select("rec_id", "s1_id", "p1", "p_rank", "p_r2", _r("p_margin"), *_big("sib_n"), "sib_max", *_big("s_hi_same", "s_hi_other"), "s_max_other", _r("s_sum_other"), *rates, "tr_n", _r("tp_rate"), "tp_n")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ FROM lineitem")
def model_roundtrip(spark, d):
    """A model and its metadata, saved and loaded, score every row as before."""
    at = scratch_path(spark)
    rows = adapters.scored_pairs(spark, d).withColumn("y", F.col("y").cast("int"))
    feats = ["p", "src", "sig"]
    model = learn.fit(rows, feats, rounds=2, depth=2, least=20)
    learn.save(model, f"{at}/model")
    tables.write_meta(spark, f"{at}/meta", {"feats": feats})
    vectors = learn.assembled(rows, feats)
    both = learn.load(f"{at}/model").transform(model.transform(vectors).withColumnsRenamed({c: f"{c}_1" for c in ("features", "rawPrediction", "probability", "prediction")}))
    assert tables.read_meta(spark, f"{at}/meta") == {"feats": feats}
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("probability") != F.col("probability_1")).alias("differ"))


# tuning --------------------------------------------------------------------------------------------------------------
@query(f"SELECT tau, f FROM ({registry._SQL['tau_curve']}) ORDER BY f DESC, tau LIMIT 1")
def best_tau(spark, d):
    """The threshold that the out-of-fold scores choose: a report of one row."""
    pred = adapters.scored_pairs(spark, d)
    tau, f = decide.choose_tau(pred, registry._suppliers(spark, d), registry._pred_truth(pred))
    return spark.createDataFrame([(tau, round(f, 6))], "tau double, f double")


_GRID = [{"tau": t, "m": m} for t in (0.5, 0.7, 0.9) for m in (0.0, 0.1)]


@query(sql(f"""SELECT tau, m, round(f, 6) AS f FROM (SELECT tau, m, avg({F05}) AS f FROM (
  SELECT tau, m, s.id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
  FROM (VALUES {', '.join(f"({g['tau']}::DOUBLE, {g['m']}::DOUBLE)" for g in _GRID)}) g(tau, m) CROSS JOIN sup s LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM ptruth GROUP BY s1_id) t ON t.s1_id = s.id
  LEFT JOIN (SELECT tau AS tau2, m AS m2, s1_id, count(*) AS n_pred, count(*) FILTER (WHERE (s1_id, rec_id) IN (SELECT (s1_id, rec_id) FROM ptruth)) AS tp
    FROM (VALUES {', '.join(f"({g['tau']}::DOUBLE, {g['m']}::DOUBLE)" for g in _GRID)}) h(tau, m) JOIN best ON p >= tau AND p - p2 >= m GROUP BY ALL) b ON b.s1_id = s.id AND tau2 = tau AND m2 = m)
  GROUP BY tau, m) ORDER BY f DESC, tau, m LIMIT 1""", "sup", "ptruth", "best"))
def margin_tuning(spark, d):
    """The best of a grid of margins: a report of one row."""
    pred = adapters.scored_pairs(spark, d)
    best, f = decide.tune(decide.margin, _GRID, cut(pred), registry._suppliers(spark, d), registry._pred_truth(pred))
    return spark.createDataFrame([(best["tau"], best["m"], round(f, 6))], "tau double, m double, f double")


@query(sql("SELECT rec_id, s1_id, count(*) AS n FROM pred WHERE p >= 0.01 GROUP BY ALL", "pred"))
def stage2_floor(spark, d):
    return runs.above_floor(adapters.scored_pairs(spark, d)).groupBy("rec_id", "s1_id").agg(F.count("*").alias("n"))


# plans and runs ------------------------------------------------------------------------------------------------------
_SIZES = f"WITH RECURSIVE a AS ({registry._NATION_ADDR}), sizes AS (SELECT country, state, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, state) AS i FROM a GROUP BY country, state),"
_FIT = """fit(country, i, state, block, used) AS (SELECT country, i, state, 0, n FROM sizes WHERE i = 1 UNION ALL
  SELECT s.country, s.i, s.state, CASE WHEN f.used + s.n > {0} THEN f.block + 1 ELSE f.block END, CASE WHEN f.used + s.n > {0} THEN s.n ELSE f.used + s.n END
  FROM fit f JOIN sizes s ON s.country = f.country AND s.i = f.i + 1)"""


@query(f"{_SIZES} {_FIT.format(500)} SELECT CAST(id AS VARCHAR) AS id, country, country || '_' || block AS block FROM a JOIN fit USING (country, state)")
def block_plan(spark, d):
    """Next-fit of states, largest first, into blocks."""
    rows = registry._places(spark, d).drop("addr")
    return splits.plan_blocks(rows, rows, 500)[0]


_state = "CASE WHEN length(name) % 5 > 0 THEN country || ':' || length(name) % 2 END"
_in_blocks = f"""er0 AS ({oracle.CTES['er']}), st AS (SELECT *, {_state} AS state FROM er0),
sizes AS (SELECT country, state, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, state) AS i FROM st WHERE src = 1 AND state IS NOT NULL GROUP BY country, state),
{_FIT.format(100)}, planned AS (SELECT st.*, st.country || '_' || block AS b FROM st LEFT JOIN fit USING (country, state)),
every AS (SELECT DISTINCT country AS c, b AS eb FROM planned WHERE src = 1 AND b IS NOT NULL),
er AS (SELECT id || '@' || coalesce(b, eb) AS id, src, name, addr, coalesce(b, eb) AS country, key, doc_id FROM planned LEFT JOIN every ON planned.b IS NULL AND c = country WHERE coalesce(b, eb) IS NOT NULL)"""


def _with_blocks(select: str, *needs: str) -> str:
    """sql() over records that stand once in each of their blocks, with the block as their country."""
    whole = sql(select, *needs)
    first = f"er AS ({oracle.CTES['er']})"
    return whole.replace("WITH " + first, "WITH RECURSIVE " + _in_blocks, 1)


@query(_with_blocks("SELECT split_part(rec_id, '@', 2) AS block, split_part(rec_id, '@', 1) AS rec_id, split_part(s1_id, '@', 1) AS s1_id, round(score, 6) AS score FROM scored", "scored"))
def blockwise_rules(spark, d):
    """The rule scorer with the block as the partition key."""
    s1, recs, _ = registry._views(spark, d)
    state = lambda df: df.withColumn("state", F.when(F.length("name") % 5 > 0, F.concat_ws(":", "country", (F.length("name") % 2).cast("string"))))
    a, b = splits.plan_blocks(state(s1), state(recs), 100)
    return runs.score_blocks(s1, recs, a, b, experiments.config("E-04a")).withColumn("score", F.round("score", 6))


@query(sql("SELECT s1_id, rec_id FROM assigned", "assigned"))
def run_e04a(spark, d):
    """A whole run of a rules experiment: dictionary, views, keys, rules, assignment."""
    data = runs.Data(*adapters.er_tables(spark, d))
    return runs.run("E-04a", data, data)["assigned"]


_dev = "state IN ('US:0', 'India:1', 'es:0')"


@query(sql(f"""SELECT id, 'entity' AS kind FROM s1s WHERE {_dev}
UNION ALL SELECT id, 'record' FROM rs WHERE id IN (SELECT t.rec_id FROM truth t JOIN s1s ON s1s.id = t.s1_id WHERE {_dev})
UNION ALL SELECT id, 'record' FROM rs WHERE id NOT IN (SELECT rec_id FROM truth) AND {_dev}
UNION ALL SELECT id, 'record' FROM rs WHERE id NOT IN (SELECT rec_id FROM truth) AND state IS NULL
  AND {oracle.bucket('id', 11, 1000)} < (SELECT CAST(floor(count(*) FILTER (WHERE {_dev}) / CAST(count(*) AS DOUBLE) * 1000) AS INT) FROM s1s)""".replace("FROM s1s", f"FROM (SELECT *, {_state} AS state FROM s1) s1s").replace("JOIN s1s", f"JOIN (SELECT *, {_state} AS state FROM s1) s1s").replace("FROM rs", f"FROM (SELECT *, {_state} AS state FROM recs) rs"), "s1", "recs", "truth"))
def dev_subset(spark, d):
    """Entities and records of some states: their own, unowned ones of the states, a hashed share of the unowned without one."""
    state = lambda df: df.withColumn("state", F.when(F.length("name") % 5 > 0, F.concat_ws(":", "country", (F.length("name") % 2).cast("string"))))
    s1, recs, truth = adapters.er_tables(spark, d)
    own, some, _ = splits.dev_subset(["US:0", "India:1", "es:0"], state(s1), state(recs), truth)
    return own.select("id", F.lit("entity").alias("kind")).unionByName(some.select("id", F.lit("record").alias("kind")))


# reports -------------------------------------------------------------------------------------------------------------
@query(sql("SELECT least(CAST(floor(round(f, 9) * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(sum(1 - f), 6) AS loss FROM entity GROUP BY ALL", "entity"))
def f05_bins(spark, d):
    s1, _, truth, _, got = registry._assigned(spark, d)
    return metrics.f05_bins(metrics.per_entity(s1, truth, got)).select(*_big("bin"), "n", _r("loss"))


@query(sql("SELECT k, count(*) AS n FROM (SELECT s.id, count(t.rec_id) AS k FROM s1 s LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.s1_id = s.id GROUP BY s.id) GROUP BY k", "s1", "truth"))
def matches_per_entity(spark, d):
    s1, _, truth = adapters.er_tables(spark, d)
    return metrics.matches_per_entity(s1, truth)


@query(sql("""SELECT coalesce(country, 'all') AS country, count(*) AS n_s1, round(sum(1 - f), 6) AS loss, round(coalesce(sum(1 - f) FILTER (WHERE n_true = 0), 0), 6) AS loss_singleton,
  count(*) FILTER (WHERE f = 1) AS s1_perfect, count(*) FILTER (WHERE f = 0) AS s1_zero, count(*) FILTER (WHERE n_true = 0 AND n_pred > 0) AS singletons_with_pred FROM entity GROUP BY ROLLUP (country)""", "entity"))
def loss_report(spark, d):
    s1, _, truth, _, got = registry._assigned(spark, d)
    out = metrics.loss_report(metrics.per_entity(s1, truth, got))
    return out.select("country", "n_s1", _r("loss"), _r("loss_singleton"), "s1_perfect", "s1_zero", "singletons_with_pred")


@query(sql("SELECT 'B' || country AS block, count(*) AS n, round(avg(f), 6) AS f FROM entity GROUP BY country", "entity"))
def f05_by_block(spark, d):
    s1, _, truth, _, got = registry._assigned(spark, d)
    blocks = s1.select("id", F.concat(F.lit("B"), "country").alias("block"))
    return metrics.f05_by_block(metrics.per_entity(s1, truth, got), blocks).select("block", "n", _r("f"))
