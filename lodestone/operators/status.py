"""File-status records: writers, queries, retries.

A store is a Parquet folder of events that is only appended to, so writers never rewrite each
other's rows and a task that runs again leaves no half-written record. ``records`` folds the
events to one row per source: of each field the last value that is not null, since the last event that
began the record anew. All writers take many sources at once.

Defined results: a source that has no record is pending; a repeated source is written once; an
empty list of sources writes nothing; a step that the state machine forbids raises StorageError before
anything is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import TRANSITIONS
from lodestone.errors import StorageError
from lodestone.operators import sync

#: Fields of a record, and their types.
FIELDS = {
    "status": "string",
    "stage": "string",
    "source_name": "string",
    "chunks": "bigint",
    "error": "string",
    "error_type": "string",
    "hint": "string",
    "attempts": "bigint",
    "next_retry_at": "timestamp",
    "created_at": "timestamp",
    "completed_at": "timestamp",
    "updated_at": "timestamp",
}
SCHEMA = "source string, written bigint, anew boolean, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
STALE = "process likely died — status stale >7d"

Sources = str | Sequence[str] | DataFrame


class StatusStore:
    """Status records in ``folder``. ``now`` is the clock, a timestamp Column."""

    def __init__(self, spark: SparkSession, folder: str, now: Callable[[], Column] = F.current_timestamp):
        self.spark, self.folder, self.now = spark, folder, now
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(folder)

    def records(self, status: str | None = None) -> DataFrame:
        """One row per source; a retry's time only while it waits for it."""
        events = self.spark.read.schema(SCHEMA).parquet(self.folder)
        began = F.max(F.when(F.col("anew"), F.col("written"))).over(Window.partitionBy("source"))
        live = events.withColumn("began", began).filter(F.col("began").isNull() | (F.col("written") >= F.col("began")))
        last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("written"))).alias(n) for n in FIELDS]
        folded = live.groupBy("source").agg(*last).withColumn("next_retry_at", F.when(F.col("status") == "retry", F.col("next_retry_at")))
        return folded if status is None else folded.filter(F.col("status") == status)

    def listed(self, status: str | None = None, limit: int = 500) -> DataFrame:
        """The ``limit`` records that changed last, the newest first, ties by source."""
        return self.records(status).orderBy(F.desc("updated_at"), "source").limit(limit)

    def summary(self) -> DataFrame:
        return sync.summary(self.records().select("status"))

    def due(self) -> DataFrame:
        """Records whose retry time has passed."""
        return sync.due(self.records(), self.now())

    def _rows(self, sources: Sources) -> DataFrame:
        if isinstance(sources, DataFrame):
            return sources.dropDuplicates(["source"])
        named = [sources] if isinstance(sources, str) else list(dict.fromkeys(sources))
        return self.spark.createDataFrame([(s,) for s in named], "source string")

    def _write(self, sources: Sources, status: str, anew: bool = False, **values: object) -> None:
        """Appends an event per source. A column of ``sources`` goes before the value of the same name."""
        rows = self._rows(sources)
        if not anew:
            known = self.records().select("source", F.col("status").alias("_from"))
            steps = rows.select("source").join(known, "source", "left").withColumn("_from", F.coalesce("_from", F.lit("pending")))
            allowed = [a for a, to in TRANSITIONS.items() if status in to]
            if bad := steps.filter(~F.col("_from").isin(*allowed)).head():
                raise StorageError(f"illegal status transition {bad['_from']} -> {status} for {bad['source']}")
        said = {"status": status, "updated_at": self.now(), **values}
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        field = lambda n: F.col(n) if n in rows.columns and n != "status" else lit(said.get(n))
        event = [field(n).cast(t).alias(n) for n, t in FIELDS.items()]
        rows.select("source", F.lit(time.time_ns()).alias("written"), F.lit(anew).alias("anew"), *event).write.mode("append").parquet(self.folder)

    def mark_pending(self, sources: Sources, source_name: str = "") -> None:
        """Begins records anew."""
        self._write(sources, "pending", anew=True, stage="Scanning", source_name=source_name, created_at=self.now())

    def update_stage(self, sources: Sources, stage: str, chunks: int = 0) -> None:
        self._write(sources, "processing", stage=stage, chunks=chunks)

    def mark_done(self, sources: Sources, chunks: int = 0) -> None:
        self._write(sources, "done", stage="Done", chunks=chunks, completed_at=self.now())

    def mark_skipped(self, sources: Sources, reason: str = "") -> None:
        self._write(sources, "skipped", stage="Skipped", error=reason, completed_at=self.now())

    def mark_failed(self, sources: Sources, error: str = "", error_type: str = "", hint: str = "", stage: str = "Error") -> None:
        self._write(sources, "failed", stage=stage, error=error, error_type=error_type, hint=hint)

    def mark_deleted(self, sources: Sources) -> None:
        """Records that a source's chunks went; begins its record anew."""
        self._write(sources, "skipped", anew=True, stage="Deleting")

    def schedule_retry(self, sources: Sources, error: str = "", attempts: int = 1, backoff_s: int = 60) -> None:
        """Failed sources wait for ``backoff_s``; a column ``next_retry_at`` says it for each."""
        at = self.now() + F.make_dt_interval(secs=F.lit(backoff_s))
        self._write(sources, "retry", stage="Error", error=error, attempts=attempts, next_retry_at=at)

    def reset_for_retry(self, sources: Sources) -> None:
        self._write(sources, "processing", stage="Converting")

    def cleanup_stale(self, days: int = 7) -> int:
        """Records that have been processing for over ``days`` fail; returns their number."""
        old = sync.stale(self.records("processing").withColumn("ts", F.col("updated_at")), self.now(), days).select("source")
        n = old.count()
        if n:
            self.mark_failed(old, STALE)
        return n


def schedule(store: StatusStore, failures: DataFrame, auto_most: int | None = None, auto_backoff_s: int = 300) -> None:
    """Failures (source, error, error_type) fail; those worth another try then wait, longer each time.

    With ``auto_most`` (a sync's own retries) every failure is tried again up to so many times, after one
    fixed wait.
    """
    tried = store.records().select("source", "attempts")
    known = failures.select("source", "error", "error_type").dropDuplicates(["source"]).join(tried, "source", "left").withColumn("tried", F.coalesce("attempts", F.lit(0)))
    again = sync.should_retry(F.col("error_type"), F.col("error"), F.col("tried")) if auto_most is None else F.col("tried") < auto_most
    wait = sync.backoff_s(F.col("tried")) if auto_most is None else F.lit(auto_backoff_s)
    at = store.now() + F.make_dt_interval(secs=wait)
    # The plan's files are listed here, before the writes below add to them.
    waiting = known.filter(again).select("source", "error", (F.col("tried") + 1).alias("attempts"), at.alias("next_retry_at"))
    store.mark_failed(failures.select("source", "error", "error_type"))
    store.schedule_retry(waiting)


def process(store: StatusStore, ingest: Callable[[DataFrame], DataFrame]) -> int:
    """Due sources are ingested again; returns how many went well.

    ``ingest`` takes (source) rows and returns (source, error, error_type) of those that failed,
    a table that can be read again. The former go on as processing, the latter wait or fail.
    """
    due = store.due().select("source")
    if not due.head(1):
        return 0
    failed = ingest(due)
    well = due.join(failed, "source", "left_anti")
    n = well.count()
    schedule(store, failed)
    store.reset_for_retry(well)
    return n


def reset_failed(store: StatusStore, part: str | None = None) -> int:
    """Failed sources (that hold ``part``) go on as processing at once; returns their number."""
    failed = store.records("failed").select("source")
    failed = failed if part is None else failed.filter(F.contains("source", F.lit(part)))
    n = failed.count()
    if n:
        store.reset_for_retry(failed)
    return n


def fold_in(actions: DataFrame, due: DataFrame) -> DataFrame:
    """(source, action): listed sources whose retry is due are ingested, whatever their hashes say."""
    waits = due.select("source", F.lit(True).alias("_due")).dropDuplicates(["source"])
    again = F.col("_due") & F.col("action").isin("unchanged", "update")
    return actions.join(waits, "source", "left").select("source", F.when(again, "ingest").otherwise(F.col("action")).alias("action"))
