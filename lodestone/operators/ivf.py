"""An inverted-file vector index: approximate dense search over lists of near vectors, beside the exact one.

Centroids are fitted by k-means (cosine) on a sample of at most ``sample`` rows, those of smallest hash of the id;
every row is then in the list of its nearest centroid. A search compares each query with the centroids and
then with the rows of its ``probes`` nearest lists (``SHARE`` of all lists by default, which finds over 0.9 of the exact
hits even of vectors without any clusters; clustered ones need a few lists). ``recall`` holds it against the exact
search over all rows.

Lists are stored sorted in ``FOLDERS`` folders, and a query reads those of its lists. Rows are not shuffled: they
meet blocks of queries, each list those queries that read it, as matrix products (``dense``).

Defined results: a null or all-zero vector is in list -1, which every query reads, so that it is found where the exact
search finds it; fewer distinct rows than lists give fewer lists; equal vectors are in one list; other columns stay
behind; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.errors import RetrievalError
from lodestone.operators import dense, retrieval

#: Folders that lists are stored in.
FOLDERS = 64
#: Share of the lists that a search reads unless it is told how many.
SHARE = 0.7


def _norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def _unit(rows: DataFrame) -> DataFrame:
    """``rows`` (id, vec) with ``unit``, the vector of length 1; null where there is none."""
    wide = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    norm = _norm(F.col("vec"))
    return wide.withColumn("n", norm).withColumn("unit", F.when(F.col("n") > 0, F.transform("vec", lambda x: x / F.col("n")))).drop("n")


class VectorIndex:
    """Lists of vectors (id, vec) under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, rows: DataFrame, lists: int | None = None, sample: int = 20_000, seed: int = 7) -> int:
        """Fits and writes the index; returns the number of lists. ``lists`` is the square root of the rows by default."""
        unit = _unit(rows)
        fit = unit.filter("unit is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("unit").alias("features"))
        lists = lists or max(1, round(rows.count() ** 0.5))
        distinct = fit.distinct().count()
        if distinct < 2 or lists < 2:
            placed, centroids = unit.withColumn("list", F.when(F.col("unit").isNull(), -1).otherwise(0)), []
        else:
            # No checkpoint of the model's rows is needed: the sample is small.
            model = KMeans(k=min(lists, distinct), seed=seed, distanceMeasure="cosine", maxIter=10, predictionCol="list").fit(fit)
            whole = unit.filter("unit is not null").withColumn("features", array_to_vector("unit"))
            placed = model.transform(whole).drop("features").unionByName(unit.filter("unit is null").withColumn("list", F.lit(-1)))
            centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        out = placed.select("id", F.col("vec").cast("array<float>").alias("vec"), "list", F.pmod(F.col("list"), F.lit(FOLDERS)).alias("part"))
        out.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/kind")  # the columns, also of no rows
        out.hint("rebalance", "part").sortWithinPartitions("part", "list").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/lists")
        found = self.spark.createDataFrame(list(enumerate(centroids)), "id int, vec array<double>")
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")
        return max(1, len(centroids))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.folder}/kind").schema).parquet(f"{self.folder}/lists")

    def search(self, queries: DataFrame, k: int = 30, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) of (query_id, vec): the k best rows of each query's nearest lists."""
        centroids = self.spark.read.parquet(f"{self.folder}/centroids")
        probes = max(1, math.ceil(SHARE * centroids.count())) if probes is None else probes
        if probes < 1:
            raise RetrievalError("at least one list must be read")
        near = retrieval.dense_topk(queries, centroids, probes).select("query_id", F.col("id").alias("list"))
        own = queries.select("query_id")
        near = near.unionByName(own.withColumn("list", F.lit(-1))) if centroids.head(1) else own.withColumn("list", F.explode(F.array(F.lit(0), F.lit(-1))))
        read = near.groupBy("query_id").agg(F.collect_set("list").alias("lists"))  # at most all lists
        parts = [r[0] for r in near.select(F.pmod(F.col("list"), F.lit(FOLDERS))).distinct().collect()]  # FOLDERS at most
        rows = dense.packs(self.rows().filter(F.col("part").isin(parts)).select("id", "vec", "list"), lists="list")
        found = None
        for part in retrieval.blocks(queries.select("query_id", "vec").join(read, "query_id")):
            scored = dense.scored(rows, dense.packs(part, "q_", "lists"), k, lists=True)
            found = scored if found is None else found.unionByName(scored)
        return retrieval.top(found, k)

    def recall(self, queries: DataFrame, rows: DataFrame, k: int = 30, probes: int | None = None) -> float:
        """The share of the exact search's hits over all rows that ``search`` finds; equal scores count as equal."""
        exact = retrieval.dense_topk(queries, rows, k).select("query_id", "score")
        found = self.search(queries, k, probes).select("query_id", "score")
        numbered = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "score").orderBy(F.lit(1))))
        n = exact.count()
        return numbered(exact).join(numbered(found), ["query_id", "score", "nth"]).count() / n if n else 1.0


def described(index: VectorIndex) -> str:
    """The index's lists and rows, as JSON."""
    sizes = index.rows().groupBy("list").agg(F.count("*").alias("n")).agg(F.count("*").alias("lists"), F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    return json.dumps(sizes.asDict())
