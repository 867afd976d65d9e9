"""The same transformations over streams: pages to recipes, and the cache as a stateful sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import later_slots, limit_store, page_store, rate_schedule, upsert_store
from ..operators.recipe import normalize_nodes
from ..operators.refresh import refresh, result_store

PAGES = "page_id long, url string, html string"


def recipe_stream(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their error column from Parquet files of pages as they arrive."""
    return normalize_nodes(spark.readStream.schema(PAGES).parquet(path))


def upsert_batches(writes: DataFrame, store: str, checkpoint: str, *, buckets: int = 64):
    """Keep the cache at ``store`` up to date with a stream of responses (its columns and seq). A batch
    commits the buckets that it touches; one that was committed before a restart isn't again."""

    def apply(batch: DataFrame, n: int) -> None:
        upsert_store(batch, store, buckets=buckets, stream=checkpoint, batch=n)

    return writes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def extract_batches(writes: DataFrame, store: str, results: str, checkpoint: str, *, buckets: int = 64):
    """Keep the cache at ``store`` and the recipes at ``results`` up to date with a stream of responses (the
    cache's columns and seq): a batch normalises the pages that it changes."""
    spark = writes.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        upsert_store(batch, store, buckets=buckets, stream=checkpoint, batch=n)
        refresh(page_store(spark, store, buckets), result_store(spark, results, buckets))

    return writes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def schedule_batches(requests: DataFrame, out: str, limits: str, checkpoint: str, *, delay_ms: int = 1500, jitter: Column | None = None, state_buckets: int = 16):
    """Schedule a stream of requests (seq, host, arrival_ms) as they come: start times go to ``out``, a
    folder for each batch, and hosts' slots are carried from batch to batch, and over restarts, in the
    store at ``limits``. Batches in the order of seq give what one batch gives.

    A batch that broke off before its slots were committed is written anew from the same slots.
    """
    spark = requests.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        store = limit_store(spark, limits, state_buckets)
        if store.applied(checkpoint) >= n:
            return
        rows = rate_schedule(batch, delay_ms=delay_ms, jitter=jitter, state=store.lookup(batch, "host"))
        path = f"{out}/batch={n}"
        rows.write.mode("overwrite").parquet(path)
        gap = F.lit(max(0, int(delay_ms))) + (F.greatest(F.lit(0), jitter) if jitter is not None else F.lit(0))
        slots = spark.read.schema(rows.schema).parquet(path).groupBy("host").agg(F.max(F.col("start_ms") + gap).cast("long").alias("next_ms"))
        store.upsert(slots, later_slots, stream=checkpoint, batch=n)

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
