"""Providers of vectors, answers and scores, with deterministic ones that need no network.

A provider is an expression over Columns: built-in functions for those here, a vectorised UDF for
a served model. Distinct texts are embedded once and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import ConfigError, EmbeddingError
from lodestone.functions import text as T
from lodestone.operators.retrieval import lexical_score

Embedder = Callable[[Column], Column]


def hash_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of terms, normalised: equal texts, equal vectors."""

    def embed(text: Column) -> Column:
        hashed = F.transform(T.terms(text), lambda w: F.xxhash64(w))
        signed = lambda h: F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0)
        places = F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(dim)).cast("int").alias("i"), signed(h).alias("s")))
        sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(places, lambda p: p["i"] == i), F.lit(0.0), lambda a, p: a + p["s"]))
        norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(sums, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm).cast("float"))

    return embed


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": hash_embedder}
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"lexical": lexical_score, "none": lambda q, t: F.lit(0.0)}


def embedder(name: str = "hash", **options) -> Embedder:
    if name not in EMBEDDERS:
        raise ConfigError(f"unknown embedding provider {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name](**options)


def embed(rows: DataFrame, text: str, into: str, make: Embedder, dim: int | None = None) -> DataFrame:
    """``rows`` with vectors of a text column; each distinct text is embedded once."""
    texts = rows.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    vectors = texts.select("_text", make(F.col("_text")).alias(into))
    if dim is not None:
        checked = F.when(F.size(into) == dim, F.col(into)).otherwise(F.raise_error(F.lit(f"{EmbeddingError.__name__}: vectors must have {dim} numbers")))
        vectors = vectors.withColumn(into, checked)
    return rows.join(vectors, F.col(text) == F.col("_text"), "left").drop("_text")


def dual(chunks: DataFrame, make: Embedder, embed: Callable[[DataFrame, str, str, Embedder], DataFrame] = embed) -> DataFrame:
    """``dense`` of the text without its context prefix, ``contextual_dense`` of the whole."""
    bare = chunks.withColumn("_bare", T.strip_context(F.col("content")))
    return embed(embed(bare, "_bare", "dense", make), "content", "contextual_dense", make).drop("_bare")


def expand(queries: DataFrame, rewrite: Callable[[Column], Column] | None = None, paraphrase: Callable[[Column], Column] | None = None, most: int = 3) -> DataFrame:
    """(query_id, variant, text): the query (rewritten where the provider gives a text), then up to ``most`` paraphrase lines."""
    base = F.col("text") if rewrite is None else F.coalesce(F.nullif(F.trim(rewrite(F.col("text"))), F.lit("")), F.col("text"))
    lines = F.array().cast("array<string>") if paraphrase is None else F.slice(F.filter(F.transform(F.split(F.coalesce(paraphrase(base), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return queries.select("query_id", F.posexplode(F.concat(F.array(base), lines)).alias("variant", "text"))


Chat = Callable[[Column], Column]
#: Prompts of the three expansions; the query follows.
REWRITE = "State this search query more clearly and specifically, in fewer than 50 words. Answer with the query alone.\n\nQuery: "
HYDE = "Answer this question in one short paragraph, as a document that knows the answer would.\n\nQuestion: "
PARAPHRASE = "Say this search query in {n} other ways, one a line, without numbers.\n\nQuery: "


@dataclass(frozen=True)
class Expansion:
    """Chat providers of query expansion; None leaves a step out, and so does a blank or null answer."""

    rewrite: Chat | None = None
    hyde: Chat | None = None
    paraphrase: Chat | None = None
    most: int = 3

    def rewriting(self) -> Expansion:
        return replace(self, hyde=None, paraphrase=None)


def variants(queries: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """(query_id, list, text): list 0 the query (rewritten), 2 its hypothetical answer, 3 and on its paraphrases.

    1 is left to the sparse list, so that lists are numbered in the order of their fusion.
    """
    e = expansion or Expansion()
    prompted = lambda chat, prompt: None if chat is None else lambda q: chat(F.concat(F.lit(prompt), q))
    made = expand(queries, prompted(e.rewrite, REWRITE), prompted(e.paraphrase, PARAPHRASE.format(n=e.most)), e.most)
    rows = made.select("query_id", F.when(F.col("variant") == 0, 0).otherwise(F.col("variant") + 2).alias("list"), "text")
    if e.hyde is None:
        return rows
    answer = F.trim(prompted(e.hyde, HYDE)(F.col("text")))
    base = rows.filter("list = 0").select("query_id", F.lit(2).alias("list"), answer.alias("text"))
    return rows.unionByName(base.filter(F.coalesce("text", F.lit("")) != ""))
