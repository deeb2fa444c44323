"""Golden sets and evaluation datasets: YAML, JSON, JSONL, XML to one DataFrame shape."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ConfigError

GOLDEN = "query string, expected array<string>, keywords array<string>, category string, difficulty string, answer string"


def _listed(value) -> list[str]:
    return [] if value is None else [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]


def _rows(data) -> list[tuple]:
    items = data.get("queries") if isinstance(data, dict) else data
    if not isinstance(items, list):
        raise ConfigError("a golden set is a list, or a mapping with ``queries``")
    out = []
    for i, item in enumerate(items):
        if not isinstance(item, dict) or not item.get("query"):
            raise ConfigError(f"item {i} has no query")
        expected = item.get("expected_sources", item.get("expected"))
        if expected is None:
            raise ConfigError(f"item {i} has no expected sources")
        out.append((item["query"], _listed(expected), _listed(item.get("expected_content_keywords", item.get("keywords"))), item.get("category"), item.get("difficulty"), item.get("answer")))
    return out


def from_json(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(_rows(json.loads(text)), GOLDEN)


def from_yaml(spark: SparkSession, text: str) -> DataFrame:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("PyYAML is not installed") from e
    return spark.createDataFrame(_rows(yaml.safe_load(text)), GOLDEN)


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, read by Spark; the same keys as JSON."""
    schema = "query string, expected_sources array<string>, expected_content_keywords array<string>, category string, difficulty string, answer string"
    rows = spark.read.schema(schema).json(path).filter("query is not null")
    none = F.array().cast("array<string>")
    return rows.select("query", F.coalesce("expected_sources", none).alias("expected"), F.coalesce("expected_content_keywords", none).alias("keywords"), "category", "difficulty", "answer")


def from_xml(spark: SparkSession, path: str) -> DataFrame:
    """``qa_pair`` elements; lists are comma-separated attributes, keywords fall back to the answer."""
    schema = "question string, answer string, _category string, _difficulty string, _expected_sources string, _expected_keywords string"
    rows = spark.read.format("xml").option("rowTag", "qa_pair").schema(schema).load(path)
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    words = F.when(F.size(cut("_expected_keywords")) > 0, cut("_expected_keywords")).otherwise(F.filter(F.array(F.trim("answer")), lambda x: x.isNotNull() & (x != "")))
    return rows.select(F.trim("question").alias("query"), cut("_expected_sources").alias("expected"), words.alias("keywords"), F.col("_category").alias("category"), F.col("_difficulty").alias("difficulty"), F.trim("answer").alias("answer"))


def save(dataset: DataFrame, path: str) -> None:
    """JSON lines that ``from_jsonl`` reads."""
    dataset.select("query", F.col("expected").alias("expected_sources"), F.col("keywords").alias("expected_content_keywords"), "category", "difficulty", "answer").write.mode("overwrite").json(path)


def counts(dataset: DataFrame) -> DataFrame:
    """Queries by category and difficulty; those without are uncategorized and unknown."""
    return dataset.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(F.count("*").alias("n"))
