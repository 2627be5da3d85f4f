"""An extension: snapshots as a stream. History is appended once for each offer and time, and current
offers are kept by upsert in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.store import TableStore


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots that land in a folder, each (offer, time) once within the watermark."""
    rows = spark.readStream.schema(schemas.PRICE_HISTORY).parquet(path)
    return rows.withWatermark("checked_at", "1 day").dropDuplicatesWithinWatermark(["offer_id", "checked_at"])


def latest_prices(batch: DataFrame) -> DataFrame:
    """The newest snapshot of each offer in a batch."""
    return batch.groupBy(F.col("offer_id").alias("id")).agg(F.max_by(F.struct("price", "in_stock", F.col("checked_at").alias("last_checked_at")), F.struct("checked_at", "price")).alias("x")).select("id", "x.*")


def apply_batch(store: TableStore) -> Callable[[DataFrame, int], None]:
    """Appends a batch's history as a folder named by its number, so a batch that comes again adds nothing twice,
    and renews prices of offers that the batch has newer ones for."""

    def run(batch: DataFrame, number: int) -> None:
        history = batch.dropDuplicates(["offer_id", "checked_at"]).select("offer_id", "price", "in_stock", "checked_at")
        store.append("price_history", history, f"batch-{number}")
        store.upsert("offers", latest_prices(batch), ["id"], newer="last_checked_at", schema=schemas.OFFERS)

    return run


def start(spark: SparkSession, path: str, store: TableStore, checkpoint: str) -> StreamingQuery:
    return snapshots(spark, path).writeStream.foreachBatch(apply_batch(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
