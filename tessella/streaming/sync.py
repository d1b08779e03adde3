"""Incremental index upkeep as a stream: each micro-batch of new postings is added to the chunk store (J1, K3 over files).

The batch engine has no stream; this wraps its sync for a folder in which postings keep arriving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.index import IndexStore


def stream_into_store(spark: SparkSession, postings: DataFrame, store: str, checkpoint: str, **how: int) -> StreamingQuery:
    """``postings``: a streaming table (slug, text, content_hash). A posting that comes again replaces its chunks; a batch that
    is repeated after a failure finds its rows unchanged, so the store ends up the same."""

    def upsert(batch: DataFrame, _: int) -> None:
        target = IndexStore(spark, store)
        now = target.current()
        if now is None:
            target.sync(batch, **how)
            return
        from tessella.operators.index import index_key, split_chunks
        from pyspark.sql import functions as F

        size, overlap, model = how.get("size", 400), how.get("overlap", 80), how.get("model", "none")
        keyed = batch.dropDuplicates(["slug"]).withColumn("index_key", index_key(F.col("content_hash"), size, overlap, model))
        kept = now.join(keyed.select("slug"), "slug", "left_anti")
        target.write(kept.unionByName(split_chunks(keyed, size=size, overlap=overlap).select(*kept.columns)))

    return postings.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
