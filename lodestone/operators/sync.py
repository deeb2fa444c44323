"""Reconciling a listing with what is stored, and the file-status state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import RETRY_BACKOFF_S, STATUSES, TRANSITIONS
from lodestone.errors import FINAL, RETRYABLE, SyncError


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """(source, hash): the first hash that is not empty, by chunk order, file hash before content hash."""
    known = F.coalesce(F.nullif("file_content_hash", F.lit("")), F.nullif("content_hash", F.lit("")))
    return chunks.groupBy("source").agg(F.min_by(known, F.when(known.isNotNull(), F.col("chunk_index"))).alias("hash"))


def reconcile(current: DataFrame, stored: DataFrame, listing_failed: bool = False) -> DataFrame:
    """(source, action): ingest, update, unchanged, delete, or keep where a failed listing forbids deletion.

    An empty listing counts as failed: it never deletes everything.
    """
    guard = listing_failed or not current.head(1)
    both = current.select("source", F.col("hash").alias("new")).join(stored.select("source", F.col("hash").alias("old"), F.lit(1).alias("had")), "source", "full_outer")
    action = (
        F.when(F.col("new").isNull(), F.lit("keep" if guard else "delete"))
        .when(F.col("had").isNull(), "ingest")
        .when(F.col("new").eqNullSafe(F.col("old")), "unchanged")
        .otherwise("update")
    )
    return both.select("source", action.alias("action"))


def stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def transition_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "previous string, status string")


def steps(events: DataFrame, key: str = "source") -> DataFrame:
    """Events (key, ts, event_id, status) with ``previous`` (absent: pending) and whether the step is legal."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    seen = events.withColumn("previous", F.coalesce(F.lag("status").over(order), F.lit("pending")))
    legal = F.lit(False)
    for a, to in TRANSITIONS.items():
        legal = legal | ((F.col("previous") == a) & F.col("status").isin(*to))
    # pending bypasses validation: a record may always begin anew.
    return seen.withColumn("legal", legal | (F.col("status") == "pending"))


def latest(events: DataFrame, key: str = "source") -> DataFrame:
    """The last event per key; the largest (ts, event_id) by aggregation, without a sort."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in rest])


def summary(records: DataFrame) -> DataFrame:
    """Count per status, zeros included; unknown statuses are left out."""
    zero = records.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return zero.join(records.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def backoff_s(attempt: Column) -> Column:
    """Seconds to wait before the next try after ``attempt`` tries."""
    return F.element_at(F.array(*[F.lit(s) for s in RETRY_BACKOFF_S]), F.least(attempt, F.lit(len(RETRY_BACKOFF_S) - 1)).cast("int") + 1)


def should_retry(error_type: Column, message: Column, attempts: Column, most: int = len(RETRY_BACKOFF_S)) -> Column:
    """Types that are tried again first, then final types, then what the message says."""
    said = F.lower(F.coalesce(message, F.lit(""))).rlike("timeout|503|504|connection|gateway|unavailable")
    return (attempts < most) & F.when(error_type.isin(*RETRYABLE), True).when(error_type.isin(*FINAL), False).otherwise(said)


def due(records: DataFrame, now: Column) -> DataFrame:
    return records.filter((F.col("status") == "retry") & (F.col("next_retry_at") <= now))


def stale(records: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Records in processing for longer than ``days``, as failed."""
    old = (F.col("status") == "processing") & (F.col("ts") < now - F.make_dt_interval(F.lit(days)))
    return records.filter(old).withColumn("status", F.lit("failed"))


def stage_of(percent: Column) -> Column:
    return F.when(percent <= 72, "Converting").when(percent <= 74, "Context").when(percent <= 76, "Metadata").when(percent <= 89, "Embedding").otherwise("Storing")


def check_transition(previous: str | None, status: str) -> None:
    """Raises unless the step is legal."""
    if status != "pending" and status not in TRANSITIONS.get(previous or "pending", ()):
        raise SyncError(f"{previous} -> {status} is no legal step")
