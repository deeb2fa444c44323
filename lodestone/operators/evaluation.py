"""Retrieval metrics over arrays ``retrieved`` and ``expected``, reports and comparisons.

Where much is expected, ``expected`` needs to hold only what was retrieved of it, beside the number of all (``of``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(r: Column, e: Column, k: int, of: Column | None = None) -> Column:
    n = F.size(F.array_distinct(e)) if of is None else of
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(r, 1, k), e)) / n)


def precision_at(r: Column, e: Column, k: int, of_window: bool = True) -> Column:
    """Hits in the window, repeats counted, over the window's length (or over k)."""
    window = F.slice(r, 1, k)
    hits = F.size(F.filter(window, lambda x: F.array_contains(e, x)))
    return F.when(F.size(window) == 0, 0.0).otherwise(hits / (F.size(window) if of_window else F.lit(k)))


def hit_at(r: Column, e: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(F.slice(r, 1, k), e), 1.0).otherwise(0.0)


def reciprocal_rank(r: Column, e: Column, k: int | None = None) -> Column:
    place = F.array_position(F.transform(r if k is None else F.slice(r, 1, k), lambda x: F.array_contains(e, x)), True)
    return F.when(place > 0, 1.0 / place).otherwise(0.0)


def ndcg_at(r: Column, e: Column, k: int, observed_ideal: bool = False, of: Column | None = None) -> Column:
    """Binary gain; the ideal has all expected first, or (``observed_ideal``) the hits found first."""
    window = F.transform(F.slice(r, 1, k), lambda x: F.array_contains(e, x))
    gain = F.aggregate(F.transform(window, lambda g, i: F.when(g, 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    n = F.size(F.filter(window, lambda g: g)) if observed_ideal else F.least(F.size(F.array_distinct(e)) if of is None else of, F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return F.when(ideal == 0, 0.0).otherwise(gain / ideal)


def keyword_coverage(content: Column, keywords: Column) -> Column:
    found = F.filter(keywords, lambda k: F.contains(F.lower(content), F.lower(k)))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(found) / F.size(keywords))


def all_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """query_id and hit, recall, precision, nDCG at each k, and MRR; rounded to 6 digits.

    With a column ``n_expected`` (int), ``expected`` holds what was retrieved of so many.
    """
    r, e = F.col("retrieved"), F.col("expected")
    of = F.col("n_expected") if "n_expected" in results.columns else None
    columns = [F.round(reciprocal_rank(r, e), 6).alias("mrr")]
    for k in ks:
        columns += [F.round(value, 6).alias(f"{name}_{k}") for name, value in (("hit", hit_at(r, e, k)), ("recall", recall_at(r, e, k, of)), ("precision", precision_at(r, e, k)), ("ndcg", ndcg_at(r, e, k, of=of)))]
    return results.select("query_id", *columns)


def aggregate(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of all metrics, and the number of queries."""
    names = [n for n, t in metrics.dtypes if t == "double"]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(n), 6).alias(f"avg_{n}") for n in names])


def compare(base: DataFrame, other: DataFrame) -> DataFrame:
    """(metric, base, other, delta, delta_pct) of two one-row tables of ``avg_`` columns."""
    names = [n for n in base.columns if n.startswith("avg_")]
    long = lambda df, v: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(v)) for n in names])).alias("m")).select("m.*")
    both = long(base, "base").join(long(other, "other"), "metric")
    delta = F.col("other") - F.col("base")
    return both.select("metric", "base", "other", F.round(delta, 6).alias("delta"), F.round(F.when(F.col("base") == 0, 0.0).otherwise(100 * delta / F.col("base")), 4).alias("delta_pct"))


def percentiles(rows: DataFrame, by: str, value: str, at: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles, count, mean, extremes per group, rounded to 2 digits.

    Ranks come from a window over the group, so no group is gathered in one row.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    ranked = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    place = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("v"), 2).alias("avg_ms"),
        *[F.round(F.max(F.when(F.col("i") == place(p), F.col("v"))), 2).alias(f"p{p}_ms") for p in at],
        F.round(F.min("v"), 2).alias("min_ms"),
        F.round(F.max("v"), 2).alias("max_ms"),
    )
