"""Queries of the text operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithspark.llm import chat_format, decontaminate, fingerprint, html_extract, jaccard_join, language_id, license_scan, line_dedup, packing, token_counts
from kithspark.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies lie; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_removed", "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.pair_answers(table(spark, sf_dir, "conversations")).withColumnRenamed("pair", "pair_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
         array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM item WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc, sizes WHERE len(words) >= size)),
occurrence AS (SELECT doc_id, item_id, i, d.size FROM doc_window d JOIN item_window USING (size, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occurrence) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurrence) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN found ON doc.doc_id = found.doc_id
"""


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id AS pair_id, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, turn
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY pair_id) AS n_turns FROM t),
answer AS (SELECT CASE WHEN pair_id % 2 = 0 THEN pair_id + 1 ELSE pair_id - 1 END AS pair_id, role, text FROM r WHERE i = n_turns),
c AS (SELECT r.* FROM r SEMI JOIN answer USING (pair_id)),
side AS (
  SELECT pair_id, false AS rejected, i, role, text FROM c UNION ALL
  SELECT c.pair_id, true, i, CASE WHEN i = n_turns THEN a.role ELSE c.role END, CASE WHEN i = n_turns THEN a.text ELSE c.text END
  FROM c JOIN answer a ON a.pair_id = c.pair_id),
other AS (
  SELECT a.pair_id, min(a.i) AS i FROM side a JOIN side b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE NOT a.rejected AND b.rejected AND (a.role <> b.role OR a.text <> b.text) GROUP BY 1),
prefix AS (SELECT DISTINCT c.pair_id, coalesce(o.i - 1, n_turns) AS n FROM c LEFT JOIN other o USING (pair_id)),
piece AS (
  SELECT side.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM side JOIN prefix USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, rejected, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + 13 + length(role) AS lo FROM piece)
SELECT pair_id, CAST(n AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE NOT rejected AND i <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE NOT rejected AND i > n), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE rejected AND i > n), '') AS rejected,
  coalesce(string_agg(lo || '-' || (lo + length(text) + 10), ',' ORDER BY i) FILTER (WHERE NOT rejected AND i > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(lo || '-' || (lo + length(text) + 10), ',' ORDER BY i) FILTER (WHERE rejected AND i > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id, n
"""


def op9_sql() -> str:
    """Exact containment in every window, without bands or anchors; the templates are values of the statement."""
    rows = []
    for width, stride, own in license_scan.classes(license_scan.TEMPLATES):
        size = min(license_scan.SHINGLE, min(map(len, own.values())))
        for name, tokens in own.items():
            parts = list(dict.fromkeys(" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)))
            rows.append(f"('{name}', {width}, {stride}, {size}, [{', '.join(repr(p) for p in parts)}])")
    return f"""
WITH template(license, width, stride, size, parts) AS (VALUES {', '.join(rows)}),
doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS words FROM documents),
shingle AS (
  SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS s, greatest(len(words) - size + 1, 1) AS n
  FROM (SELECT doc_id, words, size, unnest(range(1, greatest(len(words) - size + 1, 1) + 1)) AS i
        FROM doc, (SELECT DISTINCT size FROM template) WHERE len(words) > 0)),
part AS (SELECT license, width, stride, size, unnest(parts) AS s, len(parts) AS total FROM template),
met AS (
  SELECT doc_id, license, s, total, unnest(range(greatest(0, (i - (width - size + 1) + stride - 1) // stride), (i - 1) // stride + 1)) AS w
  FROM shingle JOIN part USING (size, s)),
share AS (SELECT doc_id, license, w, count(DISTINCT s) / CAST(any_value(total) AS DOUBLE) AS c FROM met GROUP BY doc_id, license, w)
SELECT doc_id, license, max(c) AS containment, count(*) AS n_windows FROM share WHERE c >= {license_scan.LEAST} GROUP BY doc_id, license
"""


OP10_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM doc WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT doc.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(doc.doc_id, coalesce(min(other), doc.doc_id)) AS component_id
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id LEFT JOIN reach ON reach.doc_id = doc.doc_id GROUP BY doc.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_decontaminate, op2_fingerprint, op3_html_extract, op4_line_dedup, op5_token_counts, op6_pack, op7_language_id, op8_chat_format, op9_license_scan, op10_jaccard_join)
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op8_chat_format": OP8_SQL, "op9_license_scan": op9_sql(), "op10_jaccard_join": OP10_SQL}
