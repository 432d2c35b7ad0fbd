"""Queries by name and the DuckDB SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithspark.functions.text import fold, indel_ratio, token_set_ratio
from kithspark.operators import audits, context, decide, learn, metrics, splits
from kithspark.operators import pair_features as pf
from kithspark.operators import retrieval as rt
from kithspark.operators import views as vw
from kithspark.plans import runs
from kithspark.plans.experiments import config
from kithspark.plans.oracle import CTES, F05, distinct_in_order, except_, fold as sql_fold, jaccard, rate_columns, rated as sql_rated, sql, strings, tokens
from kithspark.scratch import cut
from kithspark.session import table
from kithspark.sources import adapters
from kithspark.sources.tables import id_lists

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def _views(spark, d):
    """(entity view, record view, truth): documents are read and both views made once, then written."""
    return adapters.sides(cut(vw.addr_view(vw.name_view(adapters.er_records(spark, d), "V2"), "A2")))


def _top(spark, d):
    s1, recs, truth = _views(spark, d)
    return s1, recs, truth, cut(rt.exact_block(s1, recs, "A2", 8))


def _joined(c: str):
    return F.array_join(F.sort_array(c), " ").alias(c)


def _r(c, n: int = 6):
    return F.round(F.col(c).cast("double"), n).alias(c)


def _big(*cs: str):
    return [F.col(c).cast("bigint").alias(c) for c in cs]


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("country"))


def _pred_truth(pred):
    return pred.filter("y").select("s1_id", "rec_id").distinct()


# views ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("folded"))


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def fold_text_nfkd(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fold(F.col("text"), exact=True).cast("binary")).alias("folded"))


@query(sql(f"SELECT id, array_to_string(list_sort(list_distinct({except_(tokens(sql_fold('name')), strings(vw.STOP + vw.LEGAL))})), ' ') AS nkey FROM er", "er"))
def name_view_v1(spark, d):
    return vw.name_view(adapters.er_records(spark, d), "V1").select("id", "nkey")


@query(sql("SELECT id, nkey, array_to_string(lt, ' ') AS lt FROM view", "view"))
def name_view_v2(spark, d):
    return vw.name_view(adapters.er_records(spark, d), "V2").select("id", "nkey", _joined("lt"))


_undot = sql_fold("name")
for _p in (r"\b([a-z])\.([a-z])\.", r"\b([a-z])\.([a-z])\b") * 2:
    _undot = f"regexp_replace({_undot}, '{_p}', '\\1\\2', 'g')"


@query(rf"""SELECT id, array_to_string(list_sort(list_distinct({except_(tokens('n'), strings(vw.STOP + vw.LEGAL + vw.LEGAL_FR))})), ' ') AS nkey
FROM (SELECT id, regexp_replace({_undot}, '\(id:?\s*\d+\)|#\s*\d+', ' ', 'g') AS n FROM (
  SELECT 'P-' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'C-' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'H-' || page_id, '@' || regexp_extract(url, '^https?://(?:[a-z]+\.)?([a-z]+)\.example(\.[a-z]+)', 1) || '.com' FROM pages))""")
def name_view_v4(spark, d):
    return vw.name_view(adapters.names(spark, d), "V4").select("id", "nkey")


@query()
def name_segments(spark, d):
    """Page hosts as handles, split into the words of page titles' language: rows only, since the split is a search."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    hosts = adapters.names(spark, d).filter("id like 'H-%'")
    return vw.name_view(hosts, "V2", words).select("id", "nkey")


@query(sql(rf"""SELECT id, array_to_string(list_sort(list_distinct({tokens(sql_fold('addr'))})), ' ') AS at,
  nullif(regexp_extract(lower(addr), '^\D{{0,12}}?(\d[\w/-]*)', 1), '') AS house FROM er""", "er"))
def addr_view_a1(spark, d):
    return vw.addr_view(adapters.er_records(spark, d), "A1").select("id", _joined("at"), "house")


@query(sql("SELECT id, array_to_string(list_sort(ad), ' ') AS at, array_to_string(list_sort(st), ' ') AS st, array_to_string(nums, ' ') AS nums, CAST(nums[1] AS VARCHAR) AS house FROM view", "view"))
def addr_view_a2(spark, d):
    return vw.addr_view(adapters.er_records(spark, d), "A2").select("id", _joined("at"), _joined("st"), F.array_join(F.col("nums").cast("array<string>"), " ").alias("nums"), "house")


@query(sql("SELECT id, country, CAST(i - 1 AS INT) AS pos, lower(trim(parts[i])) AS comp FROM (SELECT id, country, string_split(addr, ',') AS parts, unnest(range(1, len(string_split(addr, ',')) + 1)) AS i FROM er)", "er"))
def address_components(spark, d):
    return vw.components(adapters.er_records(spark, d))


@query(sql("SELECT rec_id, s1_id, stratum FROM strat", "strat"))
def strata_case(spark, d):
    return vw.strata(*adapters.er_tables(spark, d))


# retrieval -----------------------------------------------------------------------------------------------------------
@query(sql("SELECT id, country, key FROM key", "key"))
def blocking_keys(spark, d):
    return rt.block_keys(vw.addr_view(vw.name_view(adapters.er_records(spark, d), "V2"), "A2"))


@query(sql("SELECT * FROM top", "top"))
def exact_block_topk(spark, d):
    return _top(spark, d)[3]


@query("""SELECT s_nationkey AS nation, k, count(*) AS n FROM (
  SELECT s_nationkey, s_suppkey // 3 AS k, count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 3) AS c FROM supplier) WHERE c <= 2 GROUP BY ALL""")
def key_frequency_cap(spark, d):
    keys = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_suppkey") / F.lit(3)).alias("k"))
    return rt.under_cap(keys, ["nation", "k"], 2).groupBy("nation", "k").agg(F.count("*").alias("n"))


@query(sql("SELECT id, country, tok FROM tok", "tok"))
def typed_tokens(spark, d):
    return rt.typed_tokens(vw.addr_view(vw.name_view(adapters.er_records(spark, d), "V2"), "A2"))


@query(sql("SELECT country, tok, df, round(w2, 6) AS w2 FROM vocab", "vocab"))
def token_df_idf(spark, d):
    return rt.document_frequencies(rt.typed_tokens(_views(spark, d)[0])).select("country", "tok", "df", _r("w2"))


_RANKED = "SELECT rec_id, s1_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM "


@query(sql(_RANKED + "sparse", "sparse"))
def sparse_topk(spark, d):
    s1, recs, _ = _views(spark, d)
    return rt.sparse_topk(s1, recs, 8, 100).select("rec_id", "s1_id", _r("score"), "rank")


@query(sql(_RANKED + "rare", "rare"))
def sparse_rare_q(spark, d):
    s1, recs, _ = _views(spark, d)
    return rt.sparse_topk(s1, recs, 8, 3000, 6, 3).select("rec_id", "s1_id", _r("score"), "rank")


@query(sql("SELECT id, country, tok FROM gram", "gram"))
def chargram_tokens(spark, d):
    return rt.name_grams(vw.name_view(adapters.er_records(spark, d), "V2"))


@query(sql(_RANKED + "chars", "chars"))
def chargram_topk(spark, d):
    s1, recs, _ = _views(spark, d)
    return rt.sparse_topk(s1, recs, 8, 100, tokens=rt.name_grams).select("rec_id", "s1_id", _r("score"), "rank")


@query(sql("SELECT id FROM view WHERE src > 1 AND (len(ad) = 0 OR id NOT IN (SELECT rec_id FROM top))", "view", "top"))
def weak_records(spark, d):
    _, recs, _, top = _top(spark, d)
    return rt.weak_records(recs, top).select("id")


def _cand(spark, d):
    s1, recs, _, top = _top(spark, d)
    return cut(rt.union_candidates(rt.sparse_topk(s1, recs, 8, 100), top).drop("ch_score", "ch_rank"))


_CAND = "SELECT rec_id, s1_id, round(CAST(sp_score AS DOUBLE), 4) AS sp_score, sp_rank, ex_hits FROM "
_cand_out = lambda df: df.select("rec_id", "s1_id", _r("sp_score", 4), "sp_rank", "ex_hits")


@query(sql(_CAND + "cand", "cand"))
def candidate_union(spark, d):
    return _cand_out(_cand(spark, d))


@query(sql(_CAND + "pruned", "pruned"))
def candidate_prune(spark, d):
    return _cand_out(rt.prune(_cand(spark, d)))


@query(sql(_CAND + """(SELECT *, coalesce(CAST(sp_score AS DOUBLE) / nullif(CAST(max(sp_score) OVER (PARTITION BY rec_id) AS DOUBLE), 0), 0) AS rel FROM pruned)
  QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY rel DESC, coalesce(ex_hits, 0) DESC, rec_id) <= 5""", "pruned"))
def candidate_s1cap(spark, d):
    return _cand_out(rt.cap_entities(rt.prune(_cand(spark, d)), 5))


# pair features -------------------------------------------------------------------------------------------------------
def _pairs(spark, d):
    s1, recs, _, top = _top(spark, d)
    return pf.with_sides(top, s1, recs), s1, recs


@query(sql(f"SELECT rec_id, s1_id, round({jaccard('nt_r', 'nt_s')}, 6) AS nj, round({jaccard('at_r', 'at_s')}, 6) AS aj, round({jaccard('st_r', 'st_s')}, 6) AS sj FROM pair", "pair"))
def pair_jaccard(spark, d):
    p = _pairs(spark, d)[0].withColumns({"nj": pf.jaccard("nt_r", "nt_s"), "aj": pf.jaccard("at_r", "at_s"), "sj": pf.jaccard("st_r", "st_s")})
    return p.select("rec_id", "s1_id", _r("nj"), _r("aj"), _r("sj"))


@query(sql(f"""SELECT rec_id, s1_id, CAST(len(nums_s) AS BIGINT) AS n1, CAST(len(nums_r) AS BIGINT) AS nr,
  round(len(list_intersect(nums_s, nums_r)) / nullif(CAST(len(nums_s) AS DOUBLE), 0), 6) AS ncover, len(nums_s) - len(list_intersect(nums_s, nums_r)) AS nmiss,
  len(nums_r) - len(list_intersect(nums_s, nums_r)) AS nextra, nums_s[1] = nums_r[1] AS first_eq,
  abs({except_('nums_s', 'nums_r')}[1] - {except_('nums_r', 'nums_s')}[1]) AS ndiff,
  ends_with(CAST({except_('nums_s', 'nums_r')}[1] AS VARCHAR), CAST({except_('nums_r', 'nums_s')}[1] AS VARCHAR)) AS ntrunc FROM pair""", "pair"))
def pair_numbers(spark, d):
    p = _pairs(spark, d)[0].withColumns(pf.number_features())
    return p.select("rec_id", "s1_id", *_big("n1", "nr"), _r("ncover"), *_big("nmiss", "nextra"), "first_eq", "ndiff", "ntrunc")


_digits = lambda x: f"list_distinct(string_split({x}, ''))"


@query(sql(f"""SELECT p.rec_id, p.s1_id, bool_or(a <> b AND (starts_with(a, b) OR starts_with(b, a))) AS n_prefix,
  bool_or(a <> b AND (ends_with(a, b) OR ends_with(b, a))) AS n_suffix,
  bool_or(a <> b AND length(a) = length(b) AND len({except_(_digits('a'), _digits('b'))}) + len({except_(_digits('b'), _digits('a'))}) <= 2) AS n_subst1,
  min(abs(x - y)) AS ndiff_min
FROM pair p LEFT JOIN (SELECT rec_id, s1_id, x, y, CAST(x AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b FROM (
  SELECT rec_id, s1_id, x, unnest(nums_r) AS y FROM (SELECT rec_id, s1_id, nums_r, unnest(nums_s) AS x FROM pair))) c USING (rec_id, s1_id) GROUP BY ALL""", "pair"))
def pair_numbers_cross(spark, d):
    return _pairs(spark, d)[0].select("rec_id", "s1_id", *[c.alias(n) for n, c in pf.cross_number_features().items()])


@query(r"""SELECT o_orderkey, CAST(len(x) AS INT) AS leg_add, CAST(len(y) AS INT) AS leg_del, list_contains(x, 'group') AS grp_add,
  CAST(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0 WHEN len(r) = 0 THEN 1 WHEN len(s) = 0 THEN 2 WHEN len(x) = 0 THEN 3 WHEN len(y) = 0 THEN 4 ELSE 5 END AS INT) AS leg_rel
FROM (SELECT o_orderkey, r, s, list_filter(r, lambda v: NOT list_contains(s, v)) AS x, list_filter(s, lambda v: NOT list_contains(r, v)) AS y FROM (
  SELECT o_orderkey, list_filter(['inc', 'group', 'llc'], lambda v: (o_orderkey // length(v)) % 2 = 0) AS r, list_filter(['inc', 'llc', 'ltd'], lambda v: (o_custkey // length(v) + length(v)) % 3 = 0) AS s FROM orders))""")
def pair_legal(spark, d):
    """The relation of two sets of legal forms, on sets derived from order numbers so that every case occurs."""
    keep = lambda words, test: F.filter(F.array(*map(F.lit, words)), test)
    r = keep(["inc", "group", "llc"], lambda v: F.floor(F.col("o_orderkey") / F.length(v)) % 2 == 0)
    s = keep(["inc", "llc", "ltd"], lambda v: (F.floor(F.col("o_custkey") / F.length(v)) + F.length(v)) % 3 == 0)
    return table(spark, d, "orders").select("o_orderkey", r.alias("r"), s.alias("s")).select("o_orderkey", *[c.alias(n) for n, c in pf.legal_relation("r", "s").items()])


@query(sql(f"""SELECT p.rec_id, p.s1_id, CAST(len({except_('nt_s', 'nt_r')}) AS BIGINT) AS n_uns_s, CAST(len({except_('nt_r', 'nt_s')}) AS BIGINT) AS n_uns_r, round(o, 6) AS uns_oov
FROM pair p LEFT JOIN (SELECT rec_id, s1_id, avg(CASE WHEN w IN (SELECT DISTINCT unnest({tokens(sql_fold('name'))}) FROM s1) THEN 0.0 ELSE 1.0 END) AS o
  FROM (SELECT rec_id, s1_id, unnest({except_('nt_r', 'nt_s')}) AS w FROM pair) GROUP BY ALL) USING (rec_id, s1_id)""", "pair", "s1"))
def pair_unshared_oov(spark, d):
    p, s1, recs = _pairs(spark, d)
    own, unknown = F.array_except("nt_r", "nt_s"), F.coalesce("unknown", F.array().cast("array<string>"))
    p = p.join(pf.unknown_words(recs, vw.vocabulary(s1)), "rec_id", "left")
    p = p.withColumns({"n_uns_s": F.size(F.array_except("nt_s", "nt_r")), "n_uns_r": F.size(own), "uns_oov": pf.share_of(own, unknown)})
    return p.select("rec_id", "s1_id", *_big("n_uns_s", "n_uns_r"), _r("uns_oov"))


@query(sql("SELECT id AS s1_id, count(*) OVER (PARTITION BY country, nkey) AS n_collide FROM view WHERE src = 1", "view"))
def name_collisions(spark, d):
    return pf.with_collisions(_views(spark, d)[0]).select(F.col("id").alias("s1_id"), "n_collide")


@query(sql(f"""SELECT rec_id, s1_id, count(*) OVER r AS ncand_r, count(*) OVER s AS ncand_s, round(hits / CAST(max(hits) OVER r AS DOUBLE), 6) AS sp_rel,
  round(max(nj) OVER r - nj, 6) AS nj_gap, round(max(aj) OVER r - aj, 6) AS aj_gap
FROM (SELECT *, {jaccard('nt_r', 'nt_s')} AS nj, {jaccard('at_r', 'at_s')} AS aj FROM pair) WINDOW r AS (PARTITION BY rec_id), s AS (PARTITION BY s1_id)""", "pair"))
def pair_context_gaps(spark, d):
    p = _pairs(spark, d)[0].withColumns({"nj": pf.jaccard("nt_r", "nt_s"), "aj": pf.jaccard("at_r", "at_s"), "sp_score": F.col("hits")})
    return pf.context(p).select("rec_id", "s1_id", "ncand_r", "ncand_s", _r("sp_rel"), _r("nj_gap"), _r("aj_gap"))


@query()
def pair_fuzzy_ratios(spark, d):
    """Indel and token-set ratios of name keys: no such function in SQL; unit-tested."""
    p = _pairs(spark, d)[0]
    return p.select("rec_id", "s1_id", indel_ratio("nkey_r", "nkey_s").alias("n_ratio"), token_set_ratio("nkey_r", "nkey_s").alias("n_tsr"))


@query()
def pair_features_v4(spark, d):
    """The whole feature table of the last version, with labels."""
    s1, recs, truth, top = _top(spark, d)
    cands = cut(rt.union_candidates(rt.sparse_topk(s1, recs, 8, 3000, 6, 3), top))
    return pf.with_labels(pf.pair_features(cands, s1, recs, 4, vw.vocabulary(s1)), truth)


# rules and decisions -------------------------------------------------------------------------------------------------
@query(sql("SELECT rec_id, s1_id, hits, round(nj, 6) AS nj, round(aj, 6) AS aj, round(score, 6) AS score FROM scored", "scored"))
def rule_score_a2(spark, d):
    s1, recs, _, top = _top(spark, d)
    return decide.rule_score(top, s1, recs, "A2").select("rec_id", "s1_id", "hits", _r("nj"), _r("aj"), _r("score"))


_house = r"nullif(regexp_extract(lower(addr), '^\D{0,12}?(\d[\w/-]*)', 1), '')"


@query(sql(f"""SELECT rec_id, s1_id, round(nj + aj, 6) AS score FROM (
  SELECT p.rec_id, p.s1_id, {jaccard('nt_r', 'nt_s', '0')} AS nj, {jaccard('at_r', 'at_s', '0')} AS aj, at_r, coalesce(r.h = s.h, FALSE) AS same
  FROM pair p JOIN (SELECT id, {_house} AS h FROM er) r ON r.id = p.rec_id JOIN (SELECT id, {_house} AS h FROM er) s ON s.id = p.s1_id)
WHERE (same AND (nj >= 0.4 OR aj >= 0.6)) OR (len(at_r) = 0 AND nj >= 0.8)""", "pair", "er"))
def rule_score_a1(spark, d):
    s1, recs, _, top = _top(spark, d)
    house = lambda df: df.drop("house").withColumn("house", F.nullif(F.regexp_extract(F.lower("addr"), r"^\D{0,12}?(\d[\w/-]*)", 1), F.lit("")))
    return decide.rule_score(top, house(s1), house(recs), "A1").select("rec_id", "s1_id", _r("score"))


def _assigned(spark, d):
    s1, recs, truth, top = _top(spark, d)
    return s1, recs, truth, top, decide.assign_untied(decide.rule_score(top, s1, recs, "A2"))


@query(sql("SELECT s1_id, rec_id FROM assigned", "assigned"))
def rules_match_v1(spark, d):
    return _assigned(spark, d)[4]


@query(sql("""SELECT min(s1_id) AS s1_id, rec_id FROM (SELECT rec_id, s1_id, p FROM pred QUALIFY rank() OVER (PARTITION BY rec_id ORDER BY p DESC) = 1)
GROUP BY rec_id HAVING count(*) = 1""", "pred"))
def assign_ties_dropped(spark, d):
    return decide.assign_untied(adapters.scored_pairs(spark, d).withColumnRenamed("p", "score"))


@query(sql("SELECT s1_id, rec_id, p FROM pred WHERE p >= 0.7 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY p DESC, s1_id) = 1", "pred"))
def assign_tau(spark, d):
    return decide.assign(adapters.scored_pairs(spark, d), 0.7)


@query(sql("SELECT s1_id, rec_id FROM best WHERE p >= 0.5 AND p - p2 >= 0.1", "best"))
def record_best_margin(spark, d):
    return decide.margin(adapters.scored_pairs(spark, d), 0.5, 0.1)


@query(sql("""SELECT s1_id, rec_id FROM (
  SELECT e.s1_id, rec_id, k, max(ef) OVER w AS top, first_value(k) OVER (PARTITION BY e.s1_id ORDER BY round(ef, 9) DESC, k) AS upto, none FROM (
    SELECT b.*, none, CAST(1.25 AS DOUBLE) * cum / (CAST(0.25 AS DOUBLE) * t + k) AS ef FROM (
      SELECT *, row_number() OVER o AS k, sum(p) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM best WHERE p >= 0.3 WINDOW o AS (PARTITION BY s1_id ORDER BY p DESC, rec_id)) b
    JOIN (SELECT s1_id, sum(p) AS t, exp(sum(ln(greatest(least(1 - p, 1), 1e-9)))) AS none FROM pred GROUP BY s1_id) USING (s1_id)) e WINDOW w AS (PARTITION BY e.s1_id))
WHERE top > none AND k <= upto""", "best"))
def ef05_prefix(spark, d):
    return decide.expected_f05(adapters.scored_pairs(spark, d), 0.3)


@query(sql("""SELECT s1_id, rec_id FROM (
  SELECT rec_id, max(CASE WHEN k = 1 THEN s1_id END) AS s1_id, max(CASE WHEN k = 1 THEN p END) AS p, coalesce(max(CASE WHEN k = 2 THEN p END), 0) AS p2 FROM (
    SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY p DESC, s1_id) AS k FROM (SELECT s1_id, rec_id, max(p) AS p FROM pred GROUP BY ALL) WHERE p >= 0.3) WHERE k <= 2 GROUP BY rec_id)
WHERE rec_id % 3 <> 0 OR p2 = 0 OR p - p2 >= 0.1""", "pred"))
def cross_block_assign(spark, d):
    pred = adapters.scored_pairs(spark, d)
    return decide.cross_block_assign(pred, 0.3, pred.filter("rec_id % 3 = 0"))


_TAUS = "(SELECT unnest([" + ", ".join(map(str, decide.TAUS)) + "])::DOUBLE AS tau)"


@query(sql(f"""SELECT tau, round(sum(tp) / greatest(sum(n_pred), 1)::DOUBLE, 6) AS "precision", round(sum(tp) / greatest(sum(n_true), 1)::DOUBLE, 6) AS recall, round(avg({F05}), 6) AS f FROM (
  SELECT tau, s.id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
  FROM {_TAUS} g CROSS JOIN sup s LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM ptruth GROUP BY s1_id) t ON t.s1_id = s.id
  LEFT JOIN (SELECT tau AS tau2, s1_id, count(*) AS n_pred, count(*) FILTER (WHERE (s1_id, rec_id) IN (SELECT (s1_id, rec_id) FROM ptruth)) AS tp
             FROM {_TAUS} JOIN best ON p >= tau GROUP BY ALL) b ON b.s1_id = s.id AND tau2 = tau) GROUP BY tau""", "sup", "ptruth", "best"))
def tau_curve(spark, d):
    pred = adapters.scored_pairs(spark, d)
    curve = metrics.macro_by_threshold(pred, _suppliers(spark, d), _pred_truth(pred), decide.TAUS)
    return curve.select("tau", _r("precision"), _r("recall"), _r("f"))


@query(sql("""SELECT rec_id, s1_id, w, count(*) AS n FROM (SELECT rec_id, s1_id, CASE WHEN NOT y AND p >= 0.1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT rec_id, s1_id, bool_or(y) AS y, max(p) AS p FROM pred GROUP BY ALL)) GROUP BY ALL""", "pred"))
def hard_negatives(spark, d):
    one = adapters.scored_pairs(spark, d).groupBy("rec_id", "s1_id").agg(F.bool_or("y").cast("int").alias("y"), F.max("p").alias("p"))
    return decide.hard_negative_weights(one.drop("p"), one).groupBy("rec_id", "s1_id", "w").agg(F.count("*").alias("n"))


# context and rates ---------------------------------------------------------------------------------------------------
@query(sql("""SELECT rec_id, s1_id, p AS p1, CAST(k AS INT) AS p_rank, r2 AS p_r2, round(p - CASE WHEN k = 1 THEN r2 ELSE top END, 6) AS p_margin FROM (
  SELECT *, coalesce(max(CASE WHEN k = 2 THEN p END) OVER r, 0) AS r2, max(p) OVER r AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY p DESC, s1_id) AS k FROM pred) WINDOW r AS (PARTITION BY rec_id))""", "pred"))
def stage2_ctx2(spark, d):
    return context.record_context(adapters.scored_pairs(spark, d)).select("rec_id", "s1_id", "p1", "p_rank", "p_r2", _r("p_margin"))


@query(sql("""SELECT rec_id, s1_id, src, sig, p, CAST(sum(CAST(p >= 0.5 AS INT)) OVER g - CAST(p >= 0.5 AS INT) AS BIGINT) AS sib_n,
  CASE WHEN p >= a THEN b ELSE a END AS sib_max FROM (
  SELECT *, max(CASE WHEN k = 1 THEN p END) OVER g AS a, max(CASE WHEN k = 2 THEN p END) OVER g AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY s1_id, src, sig ORDER BY p DESC, rec_id) AS k FROM pred) WINDOW g AS (PARTITION BY s1_id, src, sig))
WINDOW g AS (PARTITION BY s1_id, src, sig)""", "pred"))
def stage2_siblings(spark, d):
    return context.sibling_context(adapters.scored_pairs(spark, d)).select("rec_id", "s1_id", "src", "sig", "p", "sib_n", "sib_max")


@query(sql("""SELECT a.rec_id, a.s1_id, a.src, a.p, CAST(own - CAST(p >= 0.5 AS INT) AS BIGINT) AS s_hi_same, CAST(oth AS BIGINT) AS s_hi_other, mx AS s_max_other, round(sm, 6) AS s_sum_other FROM (
  SELECT p.*, sum(CAST(p.p >= 0.5 AS INT)) OVER (PARTITION BY s1_id, src) AS own,
    coalesce((SELECT n FROM agg x WHERE x.s1_id = p.s1_id AND x.src <> p.src), 0) AS oth, coalesce((SELECT m FROM agg x WHERE x.s1_id = p.s1_id AND x.src <> p.src), 0) AS mx,
    coalesce((SELECT t FROM agg x WHERE x.s1_id = p.s1_id AND x.src <> p.src), 0) AS sm
  FROM pred p) a""".replace("FROM agg", "FROM (SELECT s1_id, src, sum(CAST(p >= 0.5 AS INT)) AS n, max(p) AS m, sum(p) AS t FROM pred GROUP BY ALL)"), "pred"))
def stage2_xsrc(spark, d):
    return context.source_context(adapters.scored_pairs(spark, d)).select("rec_id", "s1_id", "src", "p", *_big("s_hi_same", "s_hi_other"), "s_max_other", _r("s_sum_other"))


_KINDS = ("name", "street", "pair", "shape")
_RATE_ORDER = [f"{p}_{f}" for p in ("tr", "ts", "ta", "tas", "tc1", "tc2") for f in ("min", "max")] + ["tp_rate"]


def _changed(spark, d):
    """Changed tokens of all kinds of the exact candidates, with fold and label."""
    s1, recs, truth, top = _top(spark, d)
    marked = truth.distinct().withColumn("t_", F.lit(True))
    tokens = runs.tokens_of(top, s1, recs, list(_KINDS)).join(marked, ["rec_id", "s1_id"], "left")
    return cut(tokens.withColumn("y", F.col("t_").isNotNull()).drop("t_"))


def _rate_columns(rated):
    out = context.token_rate_features(rated, *_KINDS)
    return out.select("rec_id", "s1_id", *[_r(c) for c in _RATE_ORDER], "tr_n", "tp_n")


@query(sql("SELECT * FROM rates", "rates"))
def token_rate_table(spark, d):
    return context.rate_table(_changed(spark, d))


@query(sql(f"SELECT rec_id, s1_id, {rate_columns('rate', 'seen')} FROM ({sql_rated('changed', 'rates', True)}) GROUP BY ALL", "rates"))
def token_rates_oof(spark, d):
    """Rates of added and dropped name and street tokens, exact substitutions and shapes, out of fold."""
    tokens = _changed(spark, d)
    return _rate_columns(context.rated(tokens, context.rate_table(tokens)))


_half = lambda parity: f"(SELECT * FROM changed WHERE CAST(split_part(rec_id, '-', 2) AS BIGINT) % 2 = {parity})"
_half_rates = f"(SELECT side, t, fold, count(*) AS n, sum(CAST(y AS INT)) AS s FROM {_half(0)} GROUP BY ALL)"


@query(sql(f"SELECT rec_id, s1_id, {rate_columns('rate', 'seen')} FROM ({sql_rated(_half(1), _half_rates, False)}) GROUP BY ALL", "changed"))
def token_rates_handed(spark, d):
    """Rates learnt from the records with even numbers, handed to those with odd ones."""
    tokens = _changed(spark, d)
    odd = F.split("rec_id", "-")[1].cast("bigint") % 2
    return _rate_columns(context.rated(tokens.filter(odd == 1), context.rate_table(tokens.filter(odd == 0)), False))


@query(sql("""SELECT side, t, fold, count(*) AS n, CAST(sum(CAST(y AS INT)) AS BIGINT) AS s FROM changed WHERE CAST(split_part(s1_id, '-', 2) AS BIGINT) % 3 <> 0 GROUP BY ALL""", "changed"))
def token_rates_full(spark, d):
    """The rate table of a whole run without the entities that results are measured on."""
    rows = adapters.er_records(spark, d)
    s1, recs, truth = adapters.sides(rows)
    views = _top(spark, d)
    out = s1.filter(F.split("id", "-")[1].cast("bigint") % 3 == 0).select(F.col("id").alias("s1_id"))
    return runs.full_rates({"name": "V2", "addr": "A2"}, views[3], runs.Data(s1, recs, truth), out)


# metrics -------------------------------------------------------------------------------------------------------------
@query(sql("SELECT s1_id, country, n_true, n_pred, tp, round(f, 6) AS f FROM entity", "entity"))
def f05_per_s1(spark, d):
    s1, _, truth, _, got = _assigned(spark, d)
    return metrics.per_entity(s1, truth, got).select("s1_id", "country", "n_true", "n_pred", "tp", _r("f"))


@query(sql("""SELECT coalesce(country, 'all') AS country, count(*) AS n_s1, round(avg(f), 6) AS macro_f05, round(sum(tp) / greatest(sum(n_pred), 1)::DOUBLE, 6) AS "precision",
  round(sum(tp) / greatest(sum(n_true), 1)::DOUBLE, 6) AS recall, round(avg(CASE WHEN n_true = 0 THEN f END), 6) AS singleton_f05 FROM entity GROUP BY ROLLUP (country)""", "entity"))
def evaluate_report(spark, d):
    s1, _, truth, _, got = _assigned(spark, d)
    return metrics.report(s1, truth, got).select("country", "n_s1", _r("macro_f05"), _r("precision"), _r("recall"), _r("singleton_f05"))


@query(sql(f"""SELECT 'all' AS stratum, (SELECT count(*) FROM top) AS n_cands, round((SELECT avg(CAST((s1_id, rec_id) IN (SELECT (s1_id, rec_id) FROM top) AS INT)) FROM truth), 6) AS recall,
  round(avg({F05}), 6) AS oracle_f05 FROM (SELECT s.id, coalesce(nt, 0) AS n_true, coalesce(h, 0) AS n_pred, coalesce(h, 0) AS tp FROM s1 s LEFT JOIN (
    SELECT s1_id, count(*) AS nt, count(*) FILTER (WHERE (s1_id, rec_id) IN (SELECT (s1_id, rec_id) FROM top)) AS h FROM truth GROUP BY s1_id) t ON t.s1_id = s.id)
UNION ALL SELECT stratum, NULL, round(avg(CAST((s1_id, rec_id) IN (SELECT (s1_id, rec_id) FROM top) AS INT)), 6), NULL FROM strat GROUP BY stratum""", "top", "s1", "strat"))
def blocking_report(spark, d):
    s1, recs, truth, top = _top(spark, d)
    return metrics.blocking_report(s1, truth, top, 1, vw.strata(s1, recs, truth)).select("stratum", "n_cands", _r("recall"), _r("oracle_f05"))


@query(sql("SELECT least(CAST(floor(p * 40) AS BIGINT), 39) AS bin, y, count(*) AS n FROM pred GROUP BY ALL", "pred"))
def score_histogram(spark, d):
    return metrics.score_histogram(adapters.scored_pairs(spark, d)).select(*_big("bin"), "y", "n")


@query(sql("SELECT n_true, count(*) AS n, round(avg(f), 6) AS f FROM entity GROUP BY n_true", "entity"))
def f05_by_k(spark, d):
    s1, _, truth, _, got = _assigned(spark, d)
    return metrics.f05_by_matches(metrics.per_entity(s1, truth, got)).select("n_true", "n", _r("f"))


@query(sql("""SELECT stratum, CASE WHEN (s1_id, rec_id) NOT IN (SELECT (s1_id, rec_id) FROM top) THEN 'not_retrieved' WHEN rec_id IN (SELECT rec_id FROM assigned) THEN 'given_to_other_s1' ELSE 'below_tau' END AS cause, count(*) AS n
FROM strat WHERE (s1_id, rec_id) NOT IN (SELECT (s1_id, rec_id) FROM assigned) GROUP BY ALL""", "strat", "assigned"))
def error_anatomy(spark, d):
    s1, recs, truth, top, got = _assigned(spark, d)
    return metrics.error_anatomy(truth, top, got, vw.strata(s1, recs, truth))


@query(sql("SELECT CASE WHEN rec_id IN (SELECT rec_id FROM truth) THEN 'wrong_s1' ELSE 'distractor' END AS kind, count(*) AS n FROM assigned WHERE (s1_id, rec_id) NOT IN (SELECT (s1_id, rec_id) FROM truth) GROUP BY ALL", "truth", "assigned"))
def fp_decomposition(spark, d):
    _, _, truth, _, got = _assigned(spark, d)
    return metrics.false_positives(truth, got)


@query(sql(f"""SELECT CASE WHEN rec_id IN (SELECT rec_id FROM truth) THEN 'record belongs to another S1' WHEN nj = 1 AND len(at_r) = 0 THEN 'same name, empty address'
  WHEN nj = 1 AND len(nums_s) > 0 AND len(list_intersect(nums_s, nums_r)) < len(nums_s) THEN 'near-miss decoy (same name, number differs)' WHEN nj = 1 THEN 'same name, numbers agree'
  WHEN nj >= 0.5 THEN 'similar name' ELSE 'dissimilar name, similar address' END AS kind, count(*) AS n
FROM (SELECT *, {jaccard('nt_r', 'nt_s')} AS nj FROM pair) WHERE (s1_id, rec_id) NOT IN (SELECT (s1_id, rec_id) FROM truth) GROUP BY ALL""", "pair", "truth"))
def fp_anatomy(spark, d):
    p, _, _ = _pairs(spark, d)
    truth = adapters.er_tables(spark, d)[2]
    wrong = p.withColumns({"nj": pf.jaccard("nt_r", "nt_s"), "aempty": F.size("at_r") == 0, **pf.number_features()}).join(truth, ["s1_id", "rec_id"], "left_anti")
    return metrics.false_positive_classes(wrong, truth)


@query()
def bootstrap_ci(spark, d):
    """Random resamples: no SQL."""
    s1, _, truth, _, got = _assigned(spark, d)
    return spark.createDataFrame([metrics.bootstrap_ci(metrics.per_entity(s1, truth, got))], "lo double, hi double")


# splits, plans, sinks ------------------------------------------------------------------------------------------------
_NATION_ADDR = "SELECT c_custkey AS id, 'X' AS country, c_mktsegment || ', ' || n_name AS addr, r_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _places(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").cast("string").alias("id"), F.lit("X").alias("country"), F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("n_name")).alias("addr"), F.col("r_name").alias("state"))


@query(f"""WITH a AS ({_NATION_ADDR}), c AS (SELECT country, lower(trim(unnest(string_split(addr, ',')))) AS comp, state FROM a), k AS (SELECT country, comp, state, count(*) AS k FROM c GROUP BY ALL)
SELECT country, comp, state FROM (SELECT *, sum(k) OVER (PARTITION BY country, comp) AS n FROM k) WHERE n >= 20 AND k / CAST(n AS DOUBLE) >= 0.95""")
def component_map(spark, d):
    rows = _places(spark, d)
    truth = rows.select(F.col("id").alias("s1_id"), F.col("id").alias("rec_id"))
    return splits.learn_components(rows, rows, truth)


@query(f"""WITH a AS ({_NATION_ADDR}), c AS (SELECT id, addr, unnest(range(1, len(string_split(addr, ',')) + 1)) AS i FROM a)
SELECT CAST(id AS VARCHAR) AS id, max_by('X:' || lower(trim(string_split(addr, ',')[i])), i) AS state FROM c
WHERE lower(trim(string_split(addr, ',')[i])) IN ('building', 'france', 'germany', 'china', 'india') GROUP BY id""")
def state_last_match(spark, d):
    known = spark.createDataFrame([("X", c, f"X:{c}") for c in ("building", "france", "germany", "china", "india")], "country string, comp string, state string")
    return splits.last_match(vw.components(_places(spark, d)), known)


@query("""WITH r AS (SELECT s_suppkey AS id, CAST(s_nationkey % 3 AS VARCHAR) AS country, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'B' || s_nationkey END AS block FROM supplier),
b AS (SELECT DISTINCT country, block FROM r WHERE block IS NOT NULL)
SELECT id, country, block FROM r WHERE block IS NOT NULL UNION ALL SELECT id, country, b.block FROM r JOIN b USING (country) WHERE r.block IS NULL""")
def block_replicate(spark, d):
    block = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("B"), F.col("s_nationkey").cast("string")))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).cast("string").alias("country"), block.alias("block"))
    return splits.replicate(rows, rows.filter("block is not null")).select("id", "country", "block")


@query(sql("""SELECT s.id AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM s1 s LEFT JOIN (
  SELECT s1_id, string_agg(rec_id, ',' ORDER BY rec_id) AS l FROM assigned GROUP BY s1_id) a ON a.s1_id = s.id""", "s1", "assigned"))
def id_lists_sink(spark, d):
    s1, _, _, _, got = _assigned(spark, d)
    return id_lists(s1, got)


# audits --------------------------------------------------------------------------------------------------------------
@query(sql("""SELECT (SELECT count(*) FROM truth) AS labels, (SELECT count(DISTINCT rec_id) FROM truth) AS records, (SELECT count(*) FROM (SELECT rec_id FROM truth GROUP BY 1 HAVING count(*) > 1)) AS multi_owner,
  count(*) AS entities, count(*) FILTER (WHERE k = 0) AS singletons, max(k) AS most, (SELECT k FROM m ORDER BY n DESC, k LIMIT 1) AS mode FROM x""".replace("FROM m ", "FROM (SELECT k, count(*) AS n FROM x GROUP BY k) ").replace("FROM x", "FROM (SELECT s.id, count(t.rec_id) AS k FROM s1 s LEFT JOIN truth t ON t.s1_id = s.id GROUP BY s.id)"), "s1", "truth"))
def audit_owner(spark, d):
    s1, _, truth = adapters.er_tables(spark, d)
    return audits.owners(s1, truth)


@query(sql("SELECT src, count(*) AS n, count(*) FILTER (WHERE id NOT IN (SELECT rec_id FROM truth)) AS unmatched, round(avg(CAST(id NOT IN (SELECT rec_id FROM truth) AS INT)), 6) AS share FROM recs GROUP BY src", "recs", "truth"))
def audit_distractors(spark, d):
    _, recs, truth = adapters.er_tables(spark, d)
    return audits.distractors(recs, truth).select("src", "n", "unmatched", _r("share"))


@query(sql("SELECT count(*) AS pairs, round(avg(CAST(r.country = s.country AS INT)), 6) AS agree FROM truth t JOIN s1 s ON s.id = t.s1_id JOIN recs r ON r.id = t.rec_id", "s1", "recs", "truth"))
def audit_country(spark, d):
    return audits.country_agreement(*adapters.er_tables(spark, d)).select("pairs", _r("agree"))


_n1, _n2 = r"regexp_extract(h1, '^(\d+)', 1)", r"regexp_extract(h, '^(\d+)', 1)"


@query(sql(f"""SELECT kind, rel, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY kind) AS DOUBLE), 6) AS share FROM (
  SELECT kind, CASE WHEN h = h1 THEN 'equal' WHEN {_n1} = {_n2} THEN 'suffix differs' WHEN ltrim({_n1}, '0') = ltrim({_n2}, '0') THEN 'leading zero'
    WHEN ends_with({_n1}, {_n2}) OR ends_with({_n2}, {_n1}) THEN 'first digit truncated' WHEN abs(CAST({_n1} AS BIGINT) - CAST({_n2} AS BIGINT)) <= 10 THEN '|delta| <= 10'
    WHEN abs(CAST({_n1} AS BIGINT) - CAST({_n2} AS BIGINT)) <= 100 THEN '|delta| <= 100' ELSE 'far' END AS rel FROM (
    SELECT 'match' AS kind, r.h, s.h AS h1 FROM truth t JOIN atok r ON r.id = t.rec_id JOIN atok s ON s.id = t.s1_id
    UNION ALL SELECT 'decoy', r.h, s.h1 FROM atok r JOIN (SELECT array_to_string(t, ' ') AS k, city, min_by(h, id) AS h1 FROM atok WHERE src = 1 GROUP BY ALL) s ON s.k = array_to_string(r.t, ' ') AND s.city = r.city
    WHERE r.src > 1 AND r.id NOT IN (SELECT rec_id FROM truth)) WHERE h IS NOT NULL AND h1 IS NOT NULL) GROUP BY kind, rel""", "truth", "atok"))
def audit_house_relation(spark, d):
    return audits.house_relation(*adapters.er_tables(spark, d)).select("kind", "rel", "n", _r("share"))


@query(sql("""SELECT count(*) AS groups, round(avg(CAST(d = 1 AS INT)), 6) AS one_number FROM (
  SELECT t.s1_id, r.src, count(*) AS k, count(DISTINCT r.nums[1]) AS d FROM truth t JOIN atok r ON r.id = t.rec_id JOIN atok s ON s.id = t.s1_id WHERE r.nums[1] <> s.nums[1] GROUP BY ALL HAVING count(*) >= 2)""", "truth", "atok"))
def audit_siblings(spark, d):
    return audits.sibling_agreement(*adapters.er_tables(spark, d)).select("groups", _r("one_number"))


@query(sql("""SELECT s.country, count(*) AS n, round(avg(CAST(len(list_intersect(r.t, s.t)) = 0 AS INT)), 6) AS no_shared, round(avg(CAST(trim(r.addr) = '' AS INT)), 6) AS empty_addr
FROM truth t JOIN atok r ON r.id = t.rec_id JOIN atok s ON s.id = t.s1_id GROUP BY s.country""", "truth", "atok"))
def audit_name_overlap(spark, d):
    return audits.name_overlap(*adapters.er_tables(spark, d)).select("country", "n", _r("no_shared"), _r("empty_addr"))


@query(sql("SELECT count(*) AS n, count(*) FILTER (WHERE id IN (SELECT rec_id FROM truth)) AS matched FROM recs WHERE trim(addr) = ''", "recs", "truth"))
def audit_empty_address(spark, d):
    _, recs, truth = adapters.er_tables(spark, d)
    return audits.empty_address(recs, truth)


@query(sql(f"""SELECT count(*) AS pairs, round(avg(CAST(len(string_split(r.name, ' ')) = len(string_split(s.name, ' ')) AS INT)), 6) AS equal
FROM truth t JOIN recs r ON r.id = t.rec_id JOIN s1 s ON s.id = t.s1_id WHERE regexp_matches(r.name, '{vw.INDIC}')""", "s1", "recs", "truth"))
def audit_native_alignment(spark, d):
    return audits.native_alignment(*adapters.er_tables(spark, d)).select("pairs", _r("equal"))


@query(sql(r"SELECT country, count(*) AS n, round(avg(CAST(regexp_matches(addr, '\b\d{5}\b') AS INT)), 6) AS five, round(avg(CAST(regexp_matches(addr, '\b\d{6}\b') AS INT)), 6) AS six FROM s1 GROUP BY country", "s1"))
def audit_postal(spark, d):
    return audits.postal_codes(adapters.er_tables(spark, d)[0]).select("country", "n", _r("five"), _r("six"))


@query("SELECT count(*) AS pairs, round(corr(o_orderkey, l_suppkey), 6) AS corr FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def audit_corr(spark, d):
    pairs = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return audits.order_leakage(pairs, "o_orderkey", "l_suppkey").select("pairs", _r("corr"))


@query(sql(f"""SELECT s.country, r.src, count(*) AS n, round(avg(CAST(r.name <> s.name AS INT)), 6) AS name_changed, round(avg(CAST(len({except_('r.t', 's.t')}) > 0 AS INT)), 6) AS token_added,
  round(avg(CAST(len({except_('s.t', 'r.t')}) > 0 AS INT)), 6) AS token_dropped, round(avg(CAST(r.addr <> s.addr AS INT)), 6) AS addr_changed, round(avg(CAST(trim(r.addr) = '' AS INT)), 6) AS addr_empty
FROM truth t JOIN atok r ON r.id = t.rec_id JOIN atok s ON s.id = t.s1_id GROUP BY ALL""", "truth", "atok"))
def audit_corruption(spark, d):
    out = audits.corruption_rates(*adapters.er_tables(spark, d))
    return out.select("country", "src", "n", *[_r(c) for c in ("name_changed", "token_added", "token_dropped", "addr_changed", "addr_empty")])


# learned -------------------------------------------------------------------------------------------------------------
@query()
def learned_scores(spark, d):
    """Boosted trees on scored pairs, few rounds; a fit has no SQL."""
    pred = adapters.scored_pairs(spark, d).withColumns({"y": F.col("y").cast("int"), "x": F.when(F.col("p") > 0.05, F.col("p"))})
    model = learn.fit(pred, ["x", "src", "sig"], rounds=5, depth=3, least=20)
    return learn.predict(model, pred, ["x", "src", "sig"])


_iso = """WITH pred AS (SELECT rec_id, s1_id, max(p) AS p, bool_or(y) AS y FROM (%s) GROUP BY ALL),
g AS (SELECT p, count(*) AS n, sum(CAST(y AS INT)) AS s, row_number() OVER (ORDER BY p) AS i, sum(count(*)) OVER (ORDER BY p) AS cn, sum(sum(CAST(y AS INT))) OVER (ORDER BY p) AS cs FROM pred GROUP BY p),
mean AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM g a JOIN g b ON a.i <= b.i),
least AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM mean),
fitted AS (SELECT k AS i, max(m) AS f FROM least GROUP BY k)
SELECT rec_id, s1_id, round(f, 6) AS p FROM pred JOIN g USING (p) JOIN fitted USING (i)"""


@query(_iso % CTES["pred"])
def isotonic_calibration(spark, d):
    """The SQL is the max-min form of an isotonic fit: of each score, the greatest over all starts up to it of the least mean
    over all ends from it on."""
    pred = adapters.scored_pairs(spark, d).groupBy("rec_id", "s1_id").agg(F.max("p").alias("p"), F.bool_or("y").alias("y"))
    return learn.calibrate(pred, pred.filter("y"), pred).select("rec_id", "s1_id", _r("p"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from kithspark.plans import registry_runs  # noqa: E402, F401  (adds its queries)
