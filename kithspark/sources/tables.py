"""Sources and sinks: tab-separated scans, Parquet tables, matched-id lists, pair tables, metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "addr", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("s1_id", "matched")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated, with a header, every column a string, quotes are data."""
    plain = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return spark.read.csv(path, schema=plain, sep="\t", quote="", escape="", header=True, enforceSchema=True)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A raw source as id, name, addr (null becomes ""), country."""
    return read_tsv(spark, path, RAW).na.fill("", ["addr"])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Pairs (s1_id, rec_id) of a list of matches; entities without matches have no rows."""
    return explode_matches(read_tsv(spark, path, TRUTH))


def explode_matches(lists: DataFrame) -> DataFrame:
    return lists.select("s1_id", F.explode(F.split("matched", ",")).alias("rec_id")).filter("rec_id <> ''")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def replace_with(spark: SparkSession, path: str, new: str) -> None:
    """The table at `new` takes the place of that at `path`, which is there, under one of two names, all the time."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(f"{path}.old"), True)
    if not fs.rename(at(path), at(f"{path}.old")) or not fs.rename(at(new), at(path)):
        raise OSError(f"can't put {new} in the place of {path}")
    fs.delete(at(f"{path}.old"), True)


def memo(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; computed and written by make() if it isn't there yet."""
    if not exists(spark, path):
        make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def ingest(spark: SparkSession, raw_dir: str, to: str, splits=("train", "test")) -> None:
    """Raw files to Parquet, once: <split>_s1, _s2, _s3, and train_gt where its file is there."""
    for split in splits:
        for s in (1, 2, 3):
            memo(spark, f"{to}/{split}_s{s}", lambda p=f"{raw_dir}/{split}_s{s}.tsv": read_raw(spark, p))
    if exists(spark, f"{raw_dir}/train_gt.tsv"):
        memo(spark, f"{to}/train_gt", lambda: read_truth(spark, f"{raw_dir}/train_gt.tsv"))


def load(spark: SparkSession, at: str, split: str, s: int) -> DataFrame:
    return spark.read.parquet(f"{at}/{split}_s{s}")


def load_recs(spark: SparkSession, at: str, split: str) -> DataFrame:
    """Both noisy sources with src 2 or 3."""
    two, three = (load(spark, at, split, s).withColumn("src", F.lit(s).cast("byte")) for s in (2, 3))
    return two.unionByName(three)


def load_truth(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}/train_gt")


def id_lists(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per entity of s1 (column id): its distinct matched ids, sorted and comma-joined, "" where none."""
    lists = pairs.select("s1_id", "rec_id").distinct().groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_list("rec_id")), ",").alias("matched"))
    ids = s1.select(F.col("id").alias("s1_id")).distinct()
    return ids.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("matched", F.lit("")).alias("matched_entity_ids"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, with a header in each part file, never quoted, empty strings as nothing."""
    df.write.mode("overwrite").csv(path, sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="")


def write_pairs(df: DataFrame, path: str, parts: int = 16) -> None:
    """The pair table, dealt out by record."""
    df.repartition(parts, "rec_id").write.mode("overwrite").parquet(path)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Metadata beside a model, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
