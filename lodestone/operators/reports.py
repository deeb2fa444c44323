"""Evaluation reports: means by run, category and k at several levels in one pass, kept as a table of runs.

``report`` takes metrics of queries (run, category, query_id, and columns ``metric_k`` or ``mrr``) and sums them up
by four grouping sets in one aggregation: run, category and k; run and k; run and category; run. ``ReportStore``
appends a report to a table and holds any run against any other.

Defined results: a null category is a level's "all" no more than any other value is: ``level`` says which rows
are of which grouping set; a metric without k has k 0; a run that is saved again counts by its last report; no metrics
give no report; a run that isn't there raises RetrievalError.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import RetrievalError

#: Grouping sets by their level, each with metric.
LEVELS = {"run_category_k": ["run", "category", "k"], "run_k": ["run", "k"], "run_category": ["run", "category"], "run": ["run"]}
SCHEMA = "run string, level string, category string, metric string, k int, n bigint, mean double, low double, high double"


def long_metrics(metrics: DataFrame) -> DataFrame:
    """(run, category, query_id, metric, k, value): one row for each metric column of each query."""
    names = [n for n, t in metrics.dtypes if t == "double"]
    cells = [F.struct(F.lit(n.rpartition("_")[0] or n).alias("metric"), F.lit(int(n.rpartition("_")[2]) if n.rpartition("_")[0] else 0).alias("k"), F.col(n).alias("value")) for n in names]
    return metrics.select("run", F.col("category").cast("string").alias("category"), "query_id", F.inline(F.array(*cells)))


def report(metrics: DataFrame) -> DataFrame:
    """(run, level, category, metric, k, n, mean, low, high) of all grouping sets, values rounded to 6 digits."""
    rows = long_metrics(metrics)
    columns = ["run", "category", "metric", "k"]
    sets = [[F.col(c) for c in columns if c in (*by, "metric")] for by in LEVELS.values()]
    summed = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.grouping("category").alias("_category"), F.grouping("k").alias("_k"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )
    level = F.when(F.col("_category") + F.col("_k") == 0, "run_category_k").when(F.col("_k") == 0, "run_k").when(F.col("_category") == 0, "run_category").otherwise("run")
    return summed.select("run", level.alias("level"), "category", "metric", "k", "n", "mean", "low", "high")


class ReportStore:
    """Reports of runs in ``folder``; each is one append, and is whole or not there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], SCHEMA + ", at bigint").write.mode("ignore").parquet(self.folder)

    def save(self, made: DataFrame) -> None:
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        made.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], F.lit(time.time_ns()).alias("at")).coalesce(1).write.mode("append").parquet(self.folder)

    def reports(self) -> DataFrame:
        """The last report of each run, with ``at`` (nanoseconds)."""
        rows = self.spark.read.schema(SCHEMA + ", at bigint").parquet(self.folder)
        last = rows.groupBy("run").agg(F.max("at").alias("at"))
        return rows.join(F.broadcast(last) if last.limit(10_001).count() <= 10_000 else last, ["run", "at"])

    def runs(self) -> DataFrame:
        """(run, at, n): every run with the number of its queries, the newest first."""
        return self.reports().filter("level = 'run_k'").groupBy("run", "at").agg(F.max("n").alias("n")).orderBy(F.desc("at"), "run")

    def _run(self, name: str) -> DataFrame:
        rows = self.reports().filter(F.col("run") == name)
        if not rows.head(1):
            raise RetrievalError(f"no report of run {name!r}")
        return rows

    def deltas(self, base: str, other: str | None = None) -> DataFrame:
        """(run, level, category, metric, k, base, mean, delta, delta_pct) of one run, or of all others, against ``base``."""
        self._run(base)
        if other is not None:
            self._run(other)
        rows = self.reports()
        return deltas(rows.filter(F.col("run") != base if other is None else F.col("run") == other), rows.filter(F.col("run") == base))

    def summary(self, name: str) -> str:
        """A markdown table of a run: a line for each metric, a column for each k."""
        rows = self._run(name).filter("level = 'run_k'").select("metric", "k", "mean").collect()  # metrics x ks
        ks = sorted({r["k"] for r in rows})
        cell = {(r["metric"], r["k"]): f"{r['mean']:.4f}" for r in rows}
        head = ["metric", *("all" if k == 0 else f"@{k}" for k in ks)]
        lines = [head, ["-"] * len(head), *([m, *(cell.get((m, k), "") for k in ks)] for m in sorted({r["metric"] for r in rows}))]
        return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def deltas(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Reports against the report of one run, level by level."""
    own = base.select(*[F.col(c).alias(f"_{c}") for c in ("level", "category", "metric", "k")], F.col("mean").alias("base"))
    same = F.lit(True)
    for c in ("level", "category", "metric", "k"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    delta = F.col("mean") - F.col("base")
    out = rows.join(own, same).select("run", "level", "category", "metric", "k", "base", "mean", F.round(delta, 6).alias("delta"), F.round(F.when(F.col("base") == 0, 0.0).otherwise(100 * delta / F.col("base")), 4).alias("delta_pct"))
    return out
