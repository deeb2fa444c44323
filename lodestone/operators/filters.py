"""Filters over metadata: building them, discovering fields, reading them from model answers."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import INTERNAL_FIELDS
from lodestone.functions import text as T


def build(df: DataFrame, filters: Mapping[str, object] | None, source: str | None = None) -> Column:
    """AND of equalities; a list means any of its values, an array field means contains.

    Both sides are compared in small letters. A field that is not there matches nothing.
    """
    kinds = dict(df.dtypes)
    out = F.lit(True) if source is None else F.col("source") == source
    for key, value in (filters or {}).items():
        if key.split(".")[0] not in kinds:
            return F.lit(False)
        wanted = [str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]
        if kinds.get(key, "").startswith("array"):
            out = out & F.arrays_overlap(F.transform(F.col(key).cast("array<string>"), F.lower), F.array(*[F.lit(w) for w in wanted]))
        else:
            out = out & F.lower(F.col(key).cast("string")).isin(*wanted)
    return out


def discover(df: DataFrame, most: int = 100) -> DataFrame:
    """(field, n_rows, n_values, sample): rows that have a field and its smallest distinct values.

    Internal fields are left out; arrays count as their elements. Distinct values are found by a
    shuffle of (field, value), so no field is gathered whole.
    """
    parts = []
    for name, kind in df.dtypes:
        if name in INTERNAL_FIELDS:
            continue
        value = F.col(name).cast("array<string>") if kind.startswith("array") else F.array(F.col(name).cast("string"))
        parts.append(F.struct(F.lit(name).alias("field"), F.filter(value, lambda v: v.isNotNull() & (v != "")).alias("values")))
    rows = df.select(F.explode(F.array(*parts)).alias("f")).select("f.field", "f.values").filter(F.size("values") > 0)
    counts = rows.groupBy("field").agg(F.count("*").alias("n_rows"))
    distinct = rows.select("field", F.explode("values").alias("value")).distinct()
    sizes = distinct.groupBy("field").agg(F.count("*").alias("n_values"))
    from pyspark.sql import Window

    first = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("field").orderBy("value"))).filter(F.col("nth") <= most)
    samples = first.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample"))
    return counts.join(sizes, "field").join(samples, "field")


def field_types(df: DataFrame) -> dict[str, str]:
    """list, integer, float or keyword for each field, from its Spark type."""
    return {n: "list" if t.startswith("array") else "integer" if t in ("tinyint", "smallint", "int", "bigint") else "float" if t in ("float", "double") or t.startswith("decimal") else "keyword" for n, t in df.dtypes if n not in INTERNAL_FIELDS}


def match_source(expected: Column, actual: Column, mode: str = "basename") -> Column:
    """Whether a result's source is the expected one, by base name, exactly or by containing it."""
    if mode == "basename":
        found = T.basename(expected) == T.basename(actual)
    elif mode == "exact":
        found = expected == actual
    elif mode == "contains":
        found = F.contains(F.lower(actual), F.lower(expected))
    else:
        raise ValueError(f"unknown match mode: {mode}")
    return F.when(F.coalesce(actual, F.lit("")) == "", False).otherwise(found)


def parse_arguments(value: object) -> dict:
    """A filter argument as a mapping: a mapping itself, or JSON of one; anything else is empty."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    return dict(value) if isinstance(value, Mapping) else {}


def read_answer(answer: str, fields: set[str]) -> tuple[dict, float, str]:
    """(filters, confidence, explanation) of a model's answer; keys that no field has are dropped."""
    text = re.sub(r"(?s)^\s*```[a-z]*\s*\n(.*?)\n?```", r"\1", answer.strip(), count=1)
    whole, block = None, re.search(r"\{[^{}]*\}", text, re.S)
    explanation = ""
    try:
        whole, end = json.JSONDecoder().raw_decode(text)
        explanation = text[end:].strip()
    except ValueError:
        pass
    if isinstance(whole, dict):
        found, confidence = whole, min(0.5 + 0.1 * len(whole), 0.95)
    elif whole is not None:
        return {}, 0.2, explanation
    elif block:
        try:
            found = json.loads(block[0])
        except ValueError:
            return {}, 0.1, text
        if not isinstance(found, dict):
            return {}, 0.15, text
        confidence, explanation = min(0.4 + 0.1 * len(found), 0.85), (text[: block.start()] + text[block.end() :]).strip()
    else:
        return {}, 0.1, text
    kept = {k: v for k, v in found.items() if k in fields}
    return kept, round(confidence * (0.8 if len(kept) < len(found) else 1), 2), explanation
