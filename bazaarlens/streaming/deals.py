"""Deals kept up to date by a stream of snapshots: one state for each canonical product.

The state holds the newest snapshot of each merchant and the status of the product's deal; both are as large as a
product has merchants. A snapshot that comes late or again changes nothing. After each batch a product that got
snapshots is compared across merchants, as in a run over tables, and its deal moves on: a gap at the threshold makes or
keeps a candidate, a smaller one expires a known deal, and fewer than two merchants expire a candidate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Settings
from ..plans.storage import shared_dir

SNAPSHOTS = "canonical_product_id string, merchant_id string, price double, in_stock boolean, checked_at timestamp"
STATES = (
    "canonical_product_id string, n_merchants long, cheapest_merchant_id string, cheapest_price double, competitor_merchant_id string, competitor_price double, "
    "gap_percent double, outcome string, status string, version long"
)
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DealProcessor(StatefulProcessor):
    """Rows of one product: (merchant_id, price, in_stock, at), ``at`` in microseconds."""

    def __init__(self, settings: Settings = DEFAULT):
        self.threshold, self.slack = settings.deal_threshold, settings.slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", "merchant_id string", "at long, price double, in_stock boolean")
        self.deal = handle.getValueState("deal", "status string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the newest of each merchant first, so that the state is asked once for a merchant, not for a snapshot
        newest: dict[str, tuple] = {}
        for batch in rows:
            for merchant, *new in zip(batch["merchant_id"], batch["at"].astype(int), batch["price"].astype(float), batch["in_stock"].astype(bool)):
                if merchant not in newest or tuple(new) > newest[merchant]:
                    newest[merchant] = tuple(new)
        known = {merchant: tuple(at) for (merchant,), at in self.newest.iterator()}
        for merchant, new in newest.items():
            if merchant not in known or new > known[merchant]:
                known[merchant] = int(new[0]), float(new[1]), bool(new[2])
                self.newest.updateValue((merchant,), known[merchant])
        good = sorted((price, merchant) for merchant, (_, price, in_stock) in known.items() if in_stock and price > 0)
        (low, first), (high, second) = [*good[:2], (None, None), (None, None)][:2]
        gap = (high - low) / high * 100 if high else None
        outcome = "insufficient" if len(good) < 2 else "candidate" if gap + self.slack >= self.threshold else "normal"
        status, version = self.deal.get() if self.deal.exists() else (None, 0)
        if outcome == "candidate":
            status = "candidate"
        elif status and (outcome == "normal" or status == "candidate"):
            status = "expired"
        self.deal.update((status, version + 1))
        yield pd.DataFrame([(key[0], len(good), first, low, second, high, gap, outcome, status, version + 1)], columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


def states(snapshots: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A row for each product of each batch, numbered by ``version``. Snapshots with a null key, price or time are left out."""
    rows = snapshots.where("canonical_product_id IS NOT NULL AND merchant_id IS NOT NULL AND price IS NOT NULL AND checked_at IS NOT NULL")
    rows = rows.select("canonical_product_id", "merchant_id", "price", F.coalesce("in_stock", F.lit(False)).alias("in_stock"), F.unix_micros("checked_at").alias("at"))
    return rows.groupBy("canonical_product_id").transformWithStateInPandas(statefulProcessor=DealProcessor(settings), outputStructType=STATES, outputMode="Update", timeMode="None")


def run(spark: SparkSession, path: str, out: str | None = None, files: int = 1, settings: Settings = DEFAULT) -> DataFrame:
    """All snapshots (SNAPSHOTS) that have landed in a folder, ``files`` of them a batch, and the states after each batch.
    ``out`` keeps states and the stream's place, so that a later call goes on; a batch that comes again is written over."""
    out = out or f"{shared_dir(spark)}/deal-states-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    try:
        source = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", files).parquet(path)
        query = states(source, settings).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/place").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(STATES).parquet(f"{out}/states")


def final_states(found: DataFrame) -> DataFrame:
    """The last state of each product."""
    place = F.row_number().over(Window.partitionBy("canonical_product_id").orderBy(F.desc("version")))
    columns = [c.split()[0] for c in STATES.split(", ")]
    return found.withColumn("place", place).where("place = 1").select(*columns)
