"""Tables in the cluster's shared folder that cut lineage, and joins that hold on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, tuple[SparkSession, int]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; only where it is unset, and all runs on this machine (tests), one
    of our own. A cluster without a shared folder is an error: its executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="kithspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _on(spark: SparkSession, key: str) -> bool:
    return spark.conf.get(key, "true").lower() == "true"


def few_files(df: DataFrame, merge: int = 32) -> DataFrame:
    """df, rows after a shuffle that are light beside the texts, in few partitions.

    AQE merges small partitions by their bytes, so partitions stay of the advised size however much there is. Only where
    the session has that switched off, up to `merge` partitions become one, but one per core at least; their number then
    grows with the partitions that the session asks for.
    """
    spark = df.sparkSession
    if _on(spark, "spark.sql.adaptive.enabled") and _on(spark, "spark.sql.adaptive.coalescePartitions.enabled"):
        return df
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // merge))


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows inner-joined on `key` with a written table that has one row a key and, in `n`, how many rows share it.

    A key with more than a quarter of an even partition's rows is hot. There are at most four of them a partition, whatever
    the data hold, so they are broadcast and their rows stay where they are; all other rows are joined by a shuffle in
    which no key is large. The column n is dropped.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    limit = max(1000, (total or 0) // (4 * parts))
    if (most or 0) <= limit:
        return rows.join(counted.drop(n), key)
    hot = F.broadcast(counted.filter(F.col(n) > limit).drop(n))
    rest = rows.join(hot.select(key), key, "left_anti").join(counted.filter(F.col(n) <= limit).drop(n), key)
    return rest.unionByName(rows.join(hot, key))


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted like the tables of cut()."""
    at = f"{scratch_dir(spark)}/kithspark/{uuid.uuid4().hex}"
    _written[at] = (spark, threading.get_ident())
    return at


def cut(df: DataFrame, merge: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    merge: see few_files().
    """
    spark = df.sparkSession
    if merge:
        df = few_files(df, merge)
    at = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def written() -> set[str]:
    """The tables of cut() that are there now."""
    return set(_written)


def cut_last(df: DataFrame, before: set[str]) -> DataFrame:
    """cut() of a result that nothing but itself is needed for: what this thread has written since `before` is deleted."""
    out = cut(df)
    last = next(reversed(_written))
    drop_scratch([at for at, (_, thread) in _written.items() if thread == threading.get_ident() and at not in before | {last}])
    return out


def drop_scratch(tables: list[str] | None = None) -> None:
    """Delete tables that cut() has written in this process, all by default. Only what nothing reads any more may go."""
    for at in list(_written) if tables is None else tables:
        spark, _ = _written.pop(at)
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; so is its folder's use
            pass


atexit.register(drop_scratch)
