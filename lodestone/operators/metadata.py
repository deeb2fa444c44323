"""Metadata of texts: keywords, structure, language, document type, personal data."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DOC_TYPES, STOPWORDS
from lodestone.functions import text as T

#: Frequent function words by language; what a text's words hit most decides.
LANGUAGE_WORDS = {
    "de": "der die das und ist nicht ein eine von zu mit den des für auf im",
    "en": "the of and to in is that for it was on are as with be this",
    "es": "el la de que y en los se del las por un para con una su",
    "fr": "le la de et les des est en du une que pour dans qui au par",
}


_WORD = re.compile(r"(?<!\w)[a-z]{4,}(?!\w)")


def keywords(docs: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, keywords): words of four or more ASCII letters by count, ties by first place.

    Counted within the row in Arrow batches, so no word is shuffled; built-in functions would need one row
    a word, or an interpreted fold that costs twice the CPU. Documents without such words, null texts
    included, give no row.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```", " "), T.URL, " "), T.EMAIL, " "))
    stop = frozenset(STOPWORDS)

    def count(texts: pd.Series) -> pd.Series:
        counted = (Counter(w for w in _WORD.findall(t) if w not in stop) for t in texts)
        return pd.Series([[w for w, _ in c.most_common(most)] for c in counted], dtype=object)

    found = docs.select("doc_id", F.pandas_udf(count, "array<string>")(F.coalesce(bare, F.lit(""))).alias("keywords"))
    return found.filter(F.size("keywords") > 0)


def structural(docs: DataFrame) -> DataFrame:
    """Counts and flags of a chunk's form."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.length(F.regexp_extract(text, r"^(#{1,6})\s+", 1)).cast("long").alias("heading_level"),
        text.rlike(r"^\s*[-*\d]+[.)]\s").alias("is_list"),
        (text.contains("```") | text.startswith("    ")).alias("is_code"),
        (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 3).alias("is_table"),
        F.length(text).cast("long").alias("char_count"),
        F.size(T.words(text)).cast("long").alias("word_count"),
        F.regexp_count(text, F.lit(T.URL)).cast("long").alias("link_count"),
        F.regexp_count(text, F.lit(T.EMAIL)).cast("long").alias("email_count"),
        F.regexp_count(text, F.lit(T.PHONE)).cast("long").alias("phone_count"),
    )


def language(text: Column) -> Column:
    """The language whose function words a text holds most; empty for under 20 characters or none."""
    words = T.terms(text)
    hits = [F.struct(F.size(F.filter(words, _in(set(w.split())))).alias("n"), F.lit(code).alias("code")) for code, w in sorted(LANGUAGE_WORDS.items())]
    best = F.array_max(F.array(*[F.struct(h["n"].alias("n"), (-F.lit(i)).alias("i"), h["code"].alias("code")) for i, h in enumerate(hits)]))
    return F.when((F.length(F.trim(text)) < 20) | (best["n"] == 0), "").otherwise(best["code"])


def _in(words: set[str]):
    return lambda w: w.isin(*sorted(words))


def doc_type(label: Column) -> Column:
    """A model's answer to one of the document types: exact, else the first one contained, else other."""
    clean = F.lower(F.trim(label))
    inside = F.get(F.filter(F.array(*[F.lit(t) for t in DOC_TYPES]), lambda t: F.contains(clean, t)), F.lit(0))
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(F.coalesce(inside, F.lit("other")))


def topics(response: Column, most: int = 5) -> Column:
    """A model's JSON list of topics, fenced or not; anything else is no topic."""
    return F.coalesce(F.slice(F.from_json(T.strip_fences(response), "array<string>"), 1, most), F.array().cast("array<string>"))


def entities(response: Column, most: int = 10) -> Column:
    """A model's JSON object of entity lists, each cut to ``most``; values that are no lists are left out."""
    read = F.try_variant_get(F.try_parse_json(T.strip_fences(response)), "$", "map<string,variant>")
    lists = F.map_filter(read, lambda k, v: F.schema_of_variant(v).startswith("ARRAY"))
    return F.coalesce(F.transform_values(lists, lambda k, v: F.slice(F.try_variant_get(v, "$", "array<string>"), 1, most)), F.expr("cast(map() as map<string,array<string>>)"))
