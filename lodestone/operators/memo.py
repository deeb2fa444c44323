"""A table of vectors that were made before, by text and model: a second ingest asks the model for nothing.

``Memo.embed`` joins known vectors to a table's distinct texts, asks for the others, and appends those in one write:
the next job finds them, and so does this one when a task runs again, since what follows reads the table and
not the model. A model that gives null for a text is asked again up to ``tries`` times, then the fallback model; a
text that has no vector after that raises EmbeddingError, and what was made is kept.

Two jobs may write the same text: vectors of one model are taken to be equal, and the newest counts. ``compact``
writes each once.

Defined results: a null text has a null vector and is asked of no one; equal texts are asked once; an empty
table asks nothing and writes nothing; a vector of another size than ``dim`` counts as none.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import EmbeddingError
from lodestone.functions import text as T
from lodestone.operators.embedding import Embedder

SCHEMA = "model string, hash string, vec array<float>, at bigint"


class Memo:
    """Vectors in ``folder``, in generations: ``compact`` begins a new one, and readers take the last that is whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        if not self._generations():
            spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(f"{self.folder}/g00000001")

    def _generations(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        whole = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return [n for n in names if n.startswith("g") and whole(n)]

    def _at(self) -> str:
        return f"{self.folder}/{self._generations()[-1]}"

    def vectors(self, model: str) -> DataFrame:
        """(hash, vec): the newest vector of each text of a model; what it failed at has a null one and is left out."""
        rows = self.spark.read.schema(SCHEMA).parquet(self._at()).filter((F.col("model") == model) & F.col("vec").isNotNull())
        # Scans of one folder count as equal in a plan, also of before and after a write; the time tells them apart.
        rows = rows.filter(F.col("at") <= time.time_ns())
        return rows.groupBy("hash").agg(F.max_by("vec", "at").alias("vec"))

    def _add(self, made: DataFrame, model: str) -> None:
        made.select(F.lit(model).alias("model"), "hash", F.col("vec").cast("array<float>").alias("vec"), F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(self._at())

    def compact(self) -> None:
        """Writes each vector once, as a new generation."""
        rows = self.spark.read.schema(SCHEMA).parquet(self._at())
        number = int(self._generations()[-1][1:]) + 1
        rows.filter("vec is not null").groupBy("model", "hash").agg(F.max_by("vec", "at").alias("vec"), F.max("at").alias("at")).hint("rebalance").write.parquet(f"{self.folder}/g{number:08d}")

    def embed(self, rows: DataFrame, text: str, into: str, make: Embedder, model: str, dim: int | None = None, tries: int = 3, fallback: tuple[str, Embedder] | None = None) -> DataFrame:
        """``rows`` with vectors ``into`` of a text column."""
        key = f"_{uuid.uuid4().hex}"
        keyed = rows.withColumn(key, T.content_hash(F.col(text)))
        texts = keyed.filter(F.col(text).isNotNull()).groupBy(F.col(key).alias("hash")).agg(F.first(text).alias("text"))
        models = [(model, make, tries), *([(*fallback, 1)] if fallback else [])]

        def missing() -> DataFrame:
            """Texts that none of the models has a vector for."""
            left = texts
            for known, _, _ in models:
                left = left.join(self.vectors(known).select("hash"), "hash", "left_anti")
            return left

        fits = lambda v: v.isNotNull() if dim is None else F.coalesce(F.size(v) == dim, F.lit(False))
        for name, maker, times in models:
            for _ in range(times):
                left = missing()
                if not left.head(1):
                    break
                # The model's answer stands once in the plan; a filter of its own would ask twice.
                self._add(left.select("hash", F.get(F.filter(F.array(maker(F.col("text"))), fits), 0).alias("vec")), name)
        left = missing()
        if bad := left.select("hash").head():
            raise EmbeddingError(f"no model gave a vector of {dim or 'any'} numbers for the text of hash {bad['hash']}")
        found = self.vectors(model).select(F.col("hash").alias(key), F.col("vec").alias(into))
        if fallback is None:
            return keyed.join(found, key, "left").drop(key)
        other = self.vectors(fallback[0]).select(F.col("hash").alias(key), F.col("vec").alias("_other"))
        both = keyed.join(found, key, "left").join(other, key, "left").withColumn(into, F.coalesce(into, "_other"))
        return both.drop(key, "_other")
