"""Shared helpers of the training-data operators.

Lineage is cut with ``checkpoint()`` in the folder that the cluster names in
``spark.checkpoint.dir``; where that setting is missing, a local master (tests) gets a temporary
folder and any other raises.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast; the count is taken before.
BROADCAST_ROWS = 200_000

#: White space of the word rule, and its complement.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch, where the session has Spark's own default: such a batch is held by the
#: executor and by its Python worker at once, for each core (memory, not results).
ARROW_BYTES, _ARROW = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARK_ARROW_BYTES = 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers started from now on, and their batches small."""
    if spark.conf.get(_ARROW).rstrip("bB") == str(_SPARK_ARROW_BYTES):
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, which hands freed memory back to the system when its task ends.

    Workers live on between tasks and stages; what their allocators keep would be held until then.
    """

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return tidied


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        _own_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"


def _own_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared checkpoint folder and read from there.

    The result starts a new plan. A checkpoint's own plan keeps the constraints of the plan
    before it, and over a chain of joins these grow with every step until planning takes longer
    than running; it also keeps size estimates, on which large tables could be broadcast.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        _own_checkpoint_dir(spark)
    written = df.checkpoint(eager=True)._jdf
    fresh = spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False)
    return DataFrame(fresh, spark)


def compacted(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df``, checkpointed, in partitions of about ``rows`` counted rows, for tables of short rows.

    A table in many nearly empty partitions makes each shuffle after it write as many files.
    """
    written = checkpointed(df)
    parts = written._jdf.queryExecution().toRdd().getNumPartitions()
    wanted = max(2, -(-written.count() // rows))  # a lone partition would draw joins into one task
    return written.coalesce(wanted) if wanted < parts else written


def column(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, whatever characters it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def carried(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """The row's own columns as one struct, so that no name of ours can clash with them."""
    names = list(df.columns if columns is None else columns)
    return F.struct(*[column(df, c).alias(c) for c in names]).alias("_row")


def restored(names: Iterable[str]) -> list[Column]:
    """The columns of ``carried`` again, under their own names."""
    return [F.col("_row").getField(c).alias(c) for c in names]


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (checkpointed) table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
