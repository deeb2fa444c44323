"""File sources: a registry, directory listings through Spark's readers, hashes, and routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestone.errors import SourceError
from lodestone.functions import text as T

_SOURCES: dict[str, Callable[..., DataFrame]] = {}
LISTING = "name string, path string, size bigint, modified_at timestamp, content binary"


def register(kind: str):
    """Makes a function (spark, **options) -> listing known by name."""

    def add(make: Callable[..., DataFrame]):
        _SOURCES[kind] = make
        return make

    return add


def kinds() -> list[str]:
    return sorted(_SOURCES)


def listing(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in _SOURCES:
        raise SourceError(f"unknown source type {kind!r}; known: {', '.join(kinds())}")
    return _SOURCES[kind](spark, **options)


def suffix(extension: str) -> str:
    """``.md`` for ``md``, ``.MD`` and ``.md``."""
    return "." + extension.lower().lstrip(".")


def _files(spark: SparkSession, path: str, extensions: list[str] | None, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(path)
    except AnalysisException as e:
        raise SourceError(f"{path} can't be listed") from e  # no empty listing: that would delete
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    if extensions:
        rows = rows.filter(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin([suffix(x) for x in extensions]))
    return rows


@register("local")
def local(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Files under a folder; ``content`` is read only if it is asked for."""
    return _files(spark, path if "://" in path else f"file://{path}", extensions, recursive)


@register("s3")
def s3(spark: SparkSession, bucket: str, prefix: str = "", extensions: list[str] | None = None) -> DataFrame:
    """Objects of a bucket by the cluster's own s3a connector."""
    return _files(spark, f"s3a://{bucket}/{prefix}", extensions, True)


@register("table")
def table(spark: SparkSession, path: str, id: str, text: str) -> DataFrame:
    """Rows of a Parquet table as files."""
    content = F.encode(F.col(text), "UTF-8")
    return spark.read.parquet(path).select(F.col(id).cast("string").alias("name"), F.col(id).cast("string").alias("path"), F.octet_length(content).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"), content.alias("content"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def routed(paths: DataFrame) -> DataFrame:
    """``kind`` url or file, and the file's name and format."""
    is_url = T.is_url(F.col("path"))
    name = F.when(is_url, T.url_filename(F.col("path"))).otherwise(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1))
    return paths.withColumn("kind", F.when(is_url, "url").otherwise("file")).withColumn("file_name", name).withColumn("format", T.file_format(name))


def unmodified(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose size is the stored one and whose time is within a second of it."""
    s = stored.select(F.col("source").alias("path"), "file_size", "file_mtime")
    near = F.abs(F.unix_micros("modified_at") / 1e6 - F.col("file_mtime")) < 1.0
    return files.join(s, "path").filter((F.col("size") == F.col("file_size")) & near).select(*files.columns)
