"""Records as a stream against a static entity index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kithspark.operators.retrieval import block_keys, top_k, under_cap
from kithspark.operators.views import addr_view, name_view


def entity_index(s1: DataFrame, cap: int = 50) -> DataFrame:
    """(country, key, s1_id): the static side, keys under the cap."""
    return under_cap(block_keys(addr_view(name_view(s1, "V2"), "A2")), ["country", "key"], cap).withColumnRenamed("id", "s1_id")


def link_stream(records: DataFrame, index: DataFrame, sink: str, checkpoint: str, k: int = 8) -> StreamingQuery:
    """Write the k entities with most shared keys of each streamed record (id, name, addr, country) to `sink`.

    The keys of a micro-batch are joined with the index; a batch's folder is overwritten if the batch runs again.
    """
    def one(batch: DataFrame, number: int) -> None:
        keys = block_keys(addr_view(name_view(batch, "V2"), "A2")).withColumnRenamed("id", "rec_id")
        hits = keys.join(index, ["country", "key"]).groupBy("rec_id", "s1_id").agg(F.count("*").alias("hits"))
        top_k(hits, "rec_id", [F.desc("hits"), F.asc("s1_id")], k).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
