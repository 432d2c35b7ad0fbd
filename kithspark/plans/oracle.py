"""SQL building blocks, in DuckDB's dialect, that repeat the adapters and operators for comparison."""

from __future__ import annotations

from kithspark.operators.views import INDIC, LEGAL, LEGAL_FR, STOP, WRAPPER


def strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def tokens(x: str, pattern: str = "[a-z0-9]+") -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def jaccard(a: str, b: str, empty: str = "NULL") -> str:
    both, size = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {size} > 0 THEN {both} / CAST({size} AS DOUBLE) ELSE {empty} END)"


def except_(a: str, b: str) -> str:
    return f"list_filter({a}, lambda v: NOT list_contains({b}, v))"


F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 ELSE CAST(1.25 AS DOUBLE) * tp / (CAST(0.25 AS DOUBLE) * n_true + n_pred) END"

CTES: dict[str, str] = {}
CTES["er"] = r"""
  SELECT 'S' || src || '-' || doc_id AS id, CAST(src AS TINYINT) AS src, name, addr, country, key, doc_id FROM (
    SELECT doc_id, CASE WHEN s < 8 THEN 1 WHEN s < 14 THEN 2 ELSE 3 END AS src, regexp_extract(text, '^[^.\n]*') AS name,
           n_chars || ' ' || substr(text, 61, 140) AS addr,
           CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'India' WHEN 'fr' THEN 'France' ELSE lang END AS country, left(text, 60) AS key
    FROM (SELECT *, CAST(substr(source, 4) AS INT) AS s FROM documents))"""
CTES["s1"] = "SELECT id, name, addr, country FROM er WHERE src = 1"
CTES["recs"] = "SELECT id, src, name, addr, country FROM er WHERE src > 1"
CTES["truth"] = """
  SELECT o.s1_id, r.id AS rec_id FROM er r JOIN (SELECT key, 'S1-' || min(doc_id) AS s1_id FROM er WHERE src = 1 GROUP BY key) o ON r.key = o.key
  WHERE r.src > 1"""
CTES["pred"] = """
  SELECT l_orderkey AS rec_id, l_suppkey AS s1_id, 2 + l_linenumber % 2 AS src,
         (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 7) % 1000 / CAST(1000 AS DOUBLE) AS p, l_returnflag = 'R' AS y, l_partkey % 7 AS sig
  FROM lineitem"""
CTES["sup"] = "SELECT s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS country FROM supplier"
CTES["ptruth"] = "SELECT DISTINCT s1_id, rec_id FROM pred WHERE y"
_bare = f"coalesce(nullif(regexp_extract({fold('name')}, '{WRAPPER}', 1), ''), {fold('name')})"
CTES["view"] = f"""
  SELECT *, array_to_string(nt, ' ') AS nkey, list_filter(ad, lambda v: regexp_full_match(v, '[a-z]{{3,}}')) AS st FROM (
    SELECT id, src, country, name, addr,
      list_sort(list_distinct({except_(tokens('n'), strings(STOP + LEGAL + LEGAL_FR))})) AS nt,
      list_sort(list_intersect({tokens('n', '[a-z]+')}, {strings(LEGAL + LEGAL_FR)})) AS lt,
      {distinct_in_order(tokens('a'))} AS ad,
      {distinct_in_order("list_transform(" + tokens('a', '[0-9]+') + ", lambda v: TRY_CAST(v AS BIGINT))")} AS nums
    FROM (SELECT *, regexp_replace({_bare}, '\\(id:?\\s*\\d+\\)|#\\s*\\d+', ' ', 'g') AS n,
                 regexp_replace({fold('addr')}, '<null>|\\bnull\\b', ' ', 'g') AS a FROM er))"""
_numbers = "unnest(list_slice(nums, 1, 4)) AS num"
CTES["key"] = f"""
  SELECT DISTINCT id, src, country, key FROM (
    SELECT id, src, country, 'n|' || nkey AS key FROM view WHERE nkey <> ''
    UNION ALL SELECT id, src, country, 'h|' || num || '|' || w FROM (SELECT id, src, country, num, unnest(st) AS w FROM (SELECT *, {_numbers} FROM view))
    UNION ALL SELECT id, src, country, 'hn|' || num || '|' || w FROM (SELECT id, src, country, num, unnest(nt) AS w FROM (SELECT *, {_numbers} FROM view)))"""
CTES["hit"] = """
  SELECT r.id AS rec_id, s.id AS s1_id, count(*) AS hits FROM key r
  JOIN (SELECT * FROM key WHERE src = 1 QUALIFY count(*) OVER (PARTITION BY country, key) <= 50) s ON r.country = s.country AND r.key = s.key
  WHERE r.src > 1 GROUP BY ALL"""
CTES["top"] = "SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY hits DESC, s1_id) <= 8"
CTES["pair"] = """
  SELECT c.*, r.src, s.country, s.name AS name_s, r.name AS name_r, r.nt AS nt_r, s.nt AS nt_s, r.ad AS at_r, s.ad AS at_s, r.st AS st_r, s.st AS st_s,
         r.nums AS nums_r, s.nums AS nums_s, r.lt AS lt_r, s.lt AS lt_s, r.nkey AS nkey_r, s.nkey AS nkey_s
  FROM top c JOIN view r ON r.id = c.rec_id JOIN view s ON s.id = c.s1_id"""
CTES["scored"] = f"""
  SELECT rec_id, s1_id, hits, nj, aj, nj + aj AS score FROM (
    SELECT *, {jaccard('nt_r', 'nt_s', '0')} AS nj, {jaccard('at_r', 'at_s', '0')} AS aj FROM pair)
  WHERE ((len(nums_s) = 0 OR (len(nums_r) > 0 AND len(list_intersect(nums_s, nums_r)) = len(nums_s))) AND (nj >= 0.4 OR aj >= 0.6))
     OR (len(at_r) = 0 AND nj >= 0.8)
     OR (len(at_r) > 0 AND len(nums_r) = 0 AND len(nums_s) > 0 AND nj >= 0.8 AND aj >= 0.5)"""
CTES["assigned"] = """
  SELECT min(s1_id) AS s1_id, rec_id FROM (SELECT * FROM scored QUALIFY rank() OVER (PARTITION BY rec_id ORDER BY score DESC) = 1)
  GROUP BY rec_id HAVING count(*) = 1"""
CTES["tok"] = f"""
  SELECT DISTINCT id, src, country, tok FROM (
    SELECT id, src, country, 'n:' || unnest(nt) AS tok FROM view
    UNION ALL SELECT id, src, country, 'a:' || unnest(st) FROM view
    UNION ALL SELECT id, src, country, '#:' || unnest(list_slice(nums, 1, 4)) FROM view
    UNION ALL SELECT id, src, country, 'h:' || num || '|' || w FROM (SELECT id, src, country, num, unnest(st) AS w FROM (SELECT *, {_numbers} FROM view))
    UNION ALL SELECT id, src, country, 'hn:' || num || '|' || w FROM (SELECT id, src, country, num, unnest(nt) AS w FROM (SELECT *, {_numbers} FROM view)))"""
CTES["gram"] = """
  SELECT DISTINCT id, src, country, substr(k, CAST(i AS INT), 5) AS tok FROM (
    SELECT id, src, country, k, unnest(range(1, greatest(length(k) - 3, 1))) AS i FROM (SELECT id, src, country, left('_' || replace(nkey, ' ', '_') || '_', 48) AS k FROM view))"""


def df_of(tok: str) -> str:
    return f"""
  SELECT country, tok, df, pow(ln(n / CAST(df AS DOUBLE)), 2) AS w2
  FROM (SELECT country, tok, count(*) AS df FROM {tok} WHERE src = 1 GROUP BY ALL) JOIN (SELECT country, count(DISTINCT id) AS n FROM {tok} WHERE src = 1 GROUP BY country) USING (country)"""


CTES["vocab"] = df_of("tok")
CTES["gvocab"] = df_of("gram")


def sparse(tok: str, vocab: str, cap: int, q: int | None = None, qn: int | None = None, k: int = 8) -> str:
    few = ""
    if q:
        few = f""" QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY df, t.tok) <= {q}
      OR (starts_with(t.tok, 'n:') AND df <= 500 AND row_number() OVER (PARTITION BY t.id, starts_with(t.tok, 'n:') AND df <= 500 ORDER BY df, t.tok) <= {qn})"""
    return f"""
  SELECT rec_id, s1_id, score, row_number() OVER (PARTITION BY rec_id ORDER BY round(score, 9) DESC, s1_id) AS rank FROM (
    SELECT rec_id, s1_id, sum(w2) / nullif(any_value(norm), 0) AS score FROM (
      SELECT t.id AS rec_id, t.country, t.tok, w2 FROM {tok} t JOIN {vocab} v ON t.country = v.country AND t.tok = v.tok WHERE t.src > 1 AND df <= {cap}{few}) qt
    JOIN (SELECT id AS s1_id, country, tok FROM {tok} WHERE src = 1) p USING (country, tok)
    JOIN (SELECT id AS s1_id, sqrt(sum(w2)) AS norm FROM {tok} JOIN {vocab} USING (country, tok) WHERE src = 1 AND df <= {cap} GROUP BY id) USING (s1_id)
    GROUP BY rec_id, s1_id)
  QUALIFY rank <= {k}"""


CTES["sparse"] = sparse("tok", "vocab", 100)
CTES["rare"] = sparse("tok", "vocab", 3000, 6, 3)
CTES["chars"] = sparse("gram", "gvocab", 100)
CTES["cand"] = """
  SELECT coalesce(a.rec_id, b.rec_id) AS rec_id, coalesce(a.s1_id, b.s1_id) AS s1_id, CAST(score AS FLOAT) AS sp_score, CAST(rank AS SMALLINT) AS sp_rank, hits AS ex_hits
  FROM sparse a FULL JOIN top b ON a.rec_id = b.rec_id AND a.s1_id = b.s1_id"""
CTES["pruned"] = """
  SELECT * EXCLUDE (ms, mh) FROM (SELECT *, max(sp_score) OVER (PARTITION BY rec_id) AS ms, max(ex_hits) OVER (PARTITION BY rec_id) AS mh FROM cand)
  WHERE CAST(sp_score AS DOUBLE) >= CAST(ms AS DOUBLE) * CAST(0.5 AS DOUBLE) OR ex_hits = mh"""
CTES["entity"] = f"""
  SELECT s1_id, country, n_true, n_pred, tp, {F05} AS f FROM (
    SELECT s.id AS s1_id, country, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
    FROM s1 s LEFT JOIN (
      SELECT coalesce(t.s1_id, a.s1_id) AS s1_id, count(t.rec_id) AS n_true, count(a.rec_id) AS n_pred, count(*) FILTER (WHERE t.rec_id IS NOT NULL AND a.rec_id IS NOT NULL) AS tp
      FROM (SELECT DISTINCT * FROM truth) t FULL JOIN assigned a ON t.s1_id = a.s1_id AND t.rec_id = a.rec_id GROUP BY 1) x ON x.s1_id = s.id)"""
CTES["strat"] = f"""
  SELECT t.rec_id, t.s1_id, CASE WHEN trim(r.addr) = '' THEN 'name_only' WHEN regexp_matches(r.name, '{INDIC}') THEN 'indic'
    WHEN len(list_intersect({tokens(fold('r.name'))}, {tokens(fold('s.name'))})) = 0 THEN 'addr_only' ELSE 'normal' END AS stratum
  FROM truth t JOIN recs r ON r.id = t.rec_id JOIN s1 s ON s.id = t.s1_id"""
CTES["best"] = """
  SELECT rec_id, max(CASE WHEN k = 1 THEN s1_id END) AS s1_id, max(CASE WHEN k = 1 THEN p END) AS p, coalesce(max(CASE WHEN k = 2 THEN p END), 0) AS p2
  FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY p DESC, s1_id) AS k FROM pred) WHERE k <= 2 GROUP BY rec_id"""
def digits(text: str, n: int) -> str:
    """The first n hexadecimal digits of a text's MD5 as a number."""
    return f"CAST('0x' || substr(md5({text}), 1, {n}) AS BIGINT)"


def bucket(value: str, seed: int, k: int) -> str:
    return f"CAST({digits(f"{value} || '/{seed}'", 8)} % {k} AS INT)"


_add, _drop = except_("nt_r", "nt_s"), except_("nt_s", "nt_r")
CTES["changed"] = f"""
  SELECT rec_id, s1_id, hits, side, t, {bucket('rec_id', 17, 5)} AS fold, t2.rec_id IS NOT NULL AS y FROM (
    SELECT rec_id, s1_id, hits, 'r' AS side, unnest({_add}) AS t FROM pair
    UNION ALL SELECT rec_id, s1_id, hits, 's', unnest({_drop}) FROM pair
    UNION ALL SELECT rec_id, s1_id, hits, 'ar', unnest({except_('st_r', 'st_s')}) FROM pair
    UNION ALL SELECT rec_id, s1_id, hits, 'as', unnest({except_('st_s', 'st_r')}) FROM pair
    UNION ALL SELECT rec_id, s1_id, hits, 'p', array_to_string(list_sort({_drop}), ' ') || '>' || array_to_string(list_sort({_add}), ' ') FROM pair
      WHERE len({_add}) <= 2 AND len({_drop}) <= 2 AND len({_add}) + len({_drop}) > 0
    UNION ALL SELECT rec_id, s1_id, hits, 'c1', unnest(list_transform({_add}, lambda v: left(v, 4))) FROM pair
    UNION ALL SELECT rec_id, s1_id, hits, 'c2', unnest(list_transform({_add}, lambda v: right(v, 4))) FROM pair)
  LEFT JOIN (SELECT DISTINCT * FROM truth) t2 USING (rec_id, s1_id)"""


def rate_columns(rate: str, seen: str) -> str:
    """The features of rated tokens, per pair."""
    out = []
    for side, name in {"r": "tr", "s": "ts", "ar": "ta", "as": "tas", "c1": "tc1", "c2": "tc2"}.items():
        out += [f"round({f}({rate}) FILTER (WHERE side = '{side}'), 6) AS {name}_{f}" for f in ("min", "max")]
    out.append(f"CASE WHEN count(*) FILTER (WHERE side = 'r') > 0 THEN count({rate}) FILTER (WHERE side = 'r') END AS tr_n")
    out += [f"round(max({rate}) FILTER (WHERE side = 'p'), 6) AS tp_rate", f"CAST(max(coalesce({seen}, 0)) FILTER (WHERE side = 'p') AS BIGINT) AS tp_n"]
    return ", ".join(out)


def rated(changed: str, rates: str, out_of_fold: bool) -> str:
    """changed tokens with seen and rate by a rate table."""
    own = f"LEFT JOIN {rates} o ON o.side = c.side AND o.t = c.t AND o.fold = c.fold" if out_of_fold else ""
    n, s = ("tn - coalesce(o.n, 0)", "ts - coalesce(o.s, 0)") if out_of_fold else ("tn", "ts")
    return f"""SELECT c.rec_id, c.s1_id, c.side, c.t, {n} AS seen, CASE WHEN {n} >= 5 THEN ({s}) / CAST({n} AS DOUBLE) END AS rate
  FROM {changed} c LEFT JOIN (SELECT side, t, sum(n) AS tn, sum(s) AS ts FROM {rates} GROUP BY ALL) w ON w.side = c.side AND w.t = c.t {own}"""


CTES["rates"] = "SELECT side, t, fold, count(*) AS n, CAST(sum(CAST(y AS INT)) AS BIGINT) AS s FROM changed GROUP BY ALL"
CTES["atok"] = f"""
  SELECT id, src, country, name, addr, list_sort(list_distinct({except_(tokens(fold('name')), strings(STOP + LEGAL))})) AS t,
    {distinct_in_order("list_transform(" + tokens(fold('addr'), '[0-9]+') + ", lambda v: TRY_CAST(v AS BIGINT))")} AS nums,
    nullif(regexp_extract({fold('addr')}, '^\\D{{0,12}}?(\\d[\\w/-]*)', 1), '') AS h,
    lower(trim(CASE WHEN len(string_split(addr, ',')) >= 2 THEN string_split(addr, ',')[-2] END)) AS city FROM er"""

NEEDS = {
    "s1": ["er"], "recs": ["er"], "truth": ["er"], "ptruth": ["pred"], "view": ["er"], "key": ["view"], "hit": ["key"], "top": ["hit"],
    "pair": ["top", "view"], "scored": ["pair"], "assigned": ["scored"], "tok": ["view"], "gram": ["view"], "vocab": ["tok"], "gvocab": ["gram"],
    "sparse": ["tok", "vocab"], "rare": ["tok", "vocab"], "chars": ["gram", "gvocab"], "cand": ["sparse", "top"], "pruned": ["cand"],
    "entity": ["s1", "truth", "assigned"], "strat": ["truth", "recs", "s1"], "best": ["pred"], "changed": ["pair", "truth"], "rates": ["changed"], "atok": ["er"],
}


def sql(select: str, *needs: str) -> str:
    """WITH the needed blocks, in order, then the select."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" if order else "") + select
