"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; stages are written as Parquet
and read back. All but the last return the columns of documents.

In every stage a null text counts as empty, rows that share an id and a text have the same fate, further columns of any
name ride along untouched (but for pack_sequences, which doesn't read them), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithspark.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from kithspark.llm.common import cut_last, table, written
from kithspark.llm.registry import tokenizer_path


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; undetermined ones (no text, no letters) go. Where no document has both a language and a
    text, nothing can be fitted, and those with letters stay."""
    columns = docs.columns
    model = language_id.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs; those of which nothing is left go. n_chars follows the text. The first
    place by id, then text, keeps its lines; a null id comes first. Documents without repeated runs, empty ones too, stay as
    they are."""
    mark = "n_removed"
    while mark in docs.columns:
        mark += "_"
    clean = line_dedup.dedup_lines(docs, counts=mark)
    clean = clean.filter((F.col(mark) == 0) | (F.length(F.trim("text")) > 0))
    n_chars = F.when(F.col(mark) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; all rows of that id stay. Texts without words are
    linked with nothing and stay. A null id ranks behind all others."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, each row judged for itself."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 4096 tokens; each row is packed for itself, an empty text as one
    end token."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]
#: Hashes choose the fingerprints and the kernels' features, so SQL can't give the rows; the tests hold each stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way goes as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for _, stage in STAGES:
        docs = cut_last(stage(spark, docs, sf_dir), before)
    return docs
