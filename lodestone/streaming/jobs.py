"""Structured Streaming: ingest of arriving files, the status machine, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.config import TRANSITIONS
from lodestone.operators.store import Collection

DOCS = "doc_id bigint, source string, text string"


def ingest_files(spark: SparkSession, folder: str, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Arriving Parquet files of documents go into the collection, once each.

    A batch that runs again after a failure replaces the same sources, so it changes nothing.
    """
    arriving = spark.readStream.schema(DOCS).parquet(folder)
    return arriving.writeStream.foreachBatch(lambda batch, _: collection.ingest(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_status(events: DataFrame) -> DataFrame:
    """(source, status, steps, illegal): each key's state after each batch of its events.

    Events are (source, event_id, status); state is the last legal status and two counts.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, steps, illegal = state.get if state.exists else ("pending", 0, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        for new in rows["status"]:
            if new == "pending" or new in TRANSITIONS.get(status, ()):
                status, steps = new, steps + 1
            else:
                illegal += 1
        state.update((status, steps, illegal))
        yield pd.DataFrame({"source": [key[0]], "status": [status], "steps": [steps], "illegal": [illegal]})

    return events.groupBy("source").applyInPandasWithState(run, "source bigint, status string, steps bigint, illegal bigint", "status string, steps bigint, illegal bigint", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events with no gap of ``gap`` between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events")).select("user_id", F.col("s.start").alias("started"), "n_events")
