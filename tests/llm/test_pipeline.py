"""Every stage against the plain versions of its operator, on a small corpus."""

import os
import random
import sys

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from test_ops import all_runs, brute_components, brute_hits, prose, sentences  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "pack"]
    assert [f.name for f in docs.schema] == COLUMNS.replace(",", "").split()[::2]
    rng = random.Random(1)
    more = [(10_000 + i, t, None, "src1", 0 if t is None else len(t)) for i, t in enumerate([None, "", "12 !", bench[0][1], "".join(sentences(rng, 20)), prose(rng, 80)])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.unionByName(docs.limit(3))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "pack" else {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            want = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            clean = all_runs(sorted(rows.items()))
            want = {i: t for i, t in clean.items() if t.strip(" ") or t == rows[i]}
        elif name == "jaccard_join":
            ids = sorted(rows)
            found = brute_components([rows[i] for i in ids])
            want = {i: rows[i] for k, i in enumerate(ids) if found[k][1] == k}
        elif name == "decontaminate":
            want = {i: t for i, t in rows.items() if not brute_hits(t, bench)[4]}
        else:
            want = set(rows)
        assert got == want, name
        rows = got


def test_empty(spark):
    import tempfile

    at = tempfile.mkdtemp()
    spark.createDataFrame([], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_clashing_columns(spark):
    rng = random.Random(2)
    text = "".join(sentences(rng, 9))
    docs = spark.createDataFrame([(i, text, "en", "src1", 0, 7, "y") for i in range(3)], COLUMNS + ", n_removed int, id string")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert got.columns == docs.columns and [r["n_removed"] for r in got.collect()] == [7]


def test_no_language_labels(spark):
    texts = ["Some words.", "日本語", "12 !", "", None]
    docs = spark.createDataFrame([(i, t, None, "src1", 0) for i, t in enumerate(texts)], COLUMNS)
    got = corpus_pipeline.keep_identified(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 1]
