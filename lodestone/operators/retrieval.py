"""Search for many queries at once: dense and BM25 lists, fusion, reranking, diversity, pages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestone.errors import RetrievalError
from lodestone.functions import text as T
from lodestone.operators import dense, lexical

#: Queries of a block, and blocks of one broadcast: (queries x vector size) doubles, a few MB.
BLOCK, BLOCKS = 2_000, 8
#: (query, term) pairs that are broadcast, some 60 MB at most; more are joined by shuffle.
TERMS = 1_000_000


def _met(queries: DataFrame, chunks: DataFrame, keep: Column | None, k: int | None) -> DataFrame:
    rows = dense.packs((chunks if keep is None else chunks.filter(keep)).select("id", "vec"))
    asked = queries.select("query_id", "vec")
    found = None
    for part in blocks(asked):
        scored = dense.scored(rows, dense.packs(part, "q_"), k)
        found = scored if found is None else found.unionByName(scored)
    return found


def blocks(queries: DataFrame) -> list[DataFrame]:
    """``queries`` (query_id) in parts of counted size, each of which can be broadcast, a partition for each block."""
    n = queries.count()
    parts = max(1, -(-n // (BLOCK * BLOCKS)))
    each = [queries] if parts == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
    return [part.repartition(max(1, -(-n // (BLOCK * parts)))) for part in each]


def dense_scores(queries: DataFrame, chunks: DataFrame, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score): the cosine of each query with every row of ``chunks`` (id, vec).

    Queries go in blocks of counted size, broadcast, so chunks are never shuffled (``dense``).
    ``keep`` filters chunks before.
    """
    return _met(queries, chunks, keep, None)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 30, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of ``chunks`` (id, vec) for each query.

    Exact; only rows that can be among a task's k best per query leave the product, and only those k are shuffled.
    """
    return top(_met(queries, chunks, keep, k), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties by id; rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def postings(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl) of (id, text); only terms of ``among`` (term) where it is given, met before they are grouped."""
    rows = docs.select("id", T.terms(F.col("text")).alias("t"))
    words = rows.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    if among is not None:
        words = words.join(among, "term", "left_semi")
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by BM25 over distinct query terms.

    While the counted (query, term) pairs are within ``TERMS`` they go to every task, where a text is scored as it is
    read (``lexical``): no postings are shuffled, only hits. Rows that share an id are one document; they and more pairs than that
    are joined and summed by shuffle.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).distinct()
    lengths = docs.select(F.coalesce(F.size(T.terms(F.col("text"))), F.lit(0)).alias("dl"))  # a null text has no words
    if asked.count() > TERMS:
        return top(_bm25_joined(asked, postings(docs, asked.select("term").distinct()), None, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), k1, b), k)
    return top(_bm25_by_text(asked, docs, lengths, k, k1, b), k)


def _bm25_joined(asked: DataFrame, hit: DataFrame, df: DataFrame | None, totals: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of postings; ``df`` has their terms' frequencies where they are not those of ``hit``."""
    weighted = hit.join(document_frequency(hit) if df is None else df, "term").join(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weighted.select("term", "id", part.alias("part")).join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def _bm25_by_text(asked: DataFrame, docs: DataFrame, lengths: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """The same of texts, at least each query's k best."""
    spark = docs.sparkSession
    pairs = asked.orderBy("query_id", "term").toArrow()  # TERMS at most
    named = asked.select("query_id").distinct().orderBy("query_id").toArrow().column(0).combine_chunks()
    coded = pairs.column("term").combine_chunks().dictionary_encode()
    terms = coded.dictionary
    # Pairs are ordered by query, so a query's number rises where its id changes.
    per_query = asked.groupBy("query_id").agg(F.count("*").alias("n")).orderBy("query_id").toArrow().column("n").to_numpy()
    number = np.repeat(np.arange(len(named)), per_query)
    by = np.argsort(coded.indices.to_numpy(), kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(coded.indices.to_numpy(), minlength=len(terms)))]).astype(np.int64)
    words = docs.select("id", T.terms(F.col("text")).alias("words"))
    again = docs.groupBy("id").count().filter("count > 1").select("id")
    shared = again.limit(1).count() > 0
    single = words.join(again.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_anti") if shared else words
    df = single.select("id", "words").mapInArrow(lexical.counter(terms), "place bigint, df bigint")
    if shared:
        hit = postings(docs.join(again.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_semi"), asked.select("term").distinct())
        places = spark.createDataFrame(pa.table({"term": terms.cast(pa.string()), "place": pa.array(np.arange(len(terms)))}))
        df = df.unionByName(document_frequency(hit).join(places, "term").select("place", "df"))
    counted = df.groupBy("place").agg(F.sum("df").alias("df")).toArrow()  # asked terms at most
    totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    held = np.zeros(len(terms) + 2)  # the last two by -1 and -2
    held[counted.column("place").to_numpy()] = counted.column("df").to_numpy()
    n, mean = totals.first() if shared else (held[-1], held[-2] / held[-1] if held[-1] else None)
    held = held[:-2]
    kind = StructType([StructField("query", LongType()), docs.schema["id"], StructField("raw", DoubleType())])
    scored = single.mapInArrow(lexical.scorer(terms, np.log(1 + (n - held + 0.5) / (held + 0.5)), begins, number[by], len(named), mean or 1.0, k, k1, b), kind)
    numbers = spark.createDataFrame(pa.table({"query_id": named, "query": pa.array(np.arange(len(named)))}), StructType([asked.schema["query_id"], StructField("query", LongType())]))
    found = scored.join(F.broadcast(numbers), "query").select("query_id", "id", F.round("raw", 6).alias("score"))
    if not shared:
        return found
    own = places.join(spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(terms))), "df": pa.array(held.astype(np.int64))})), "place").select("term", "df")
    return found.unionByName(_bm25_joined(asked, hit, own, totals, k1, b))


def fuse(lists: Sequence[DataFrame], k: int = 60, mode: str = "standard") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank from 1).

    standard: 1 / (k + rank). offset: each list's ranks begin after those of the lists before
    it (their lengths for that query). Ties go to the list, then the rank, that had the id first.
    """
    rows = None
    for i, ranked in enumerate(lists):
        part = ranked.select("query_id", "id", "rank", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    return fuse_rows(rows, k, mode)


def fuse_rows(rows: DataFrame, k: int = 60, mode: str = "standard") -> DataFrame:
    """The same of rows (query_id, list, id, rank), lists numbered in their order."""
    if mode not in ("standard", "offset"):
        raise RetrievalError(f"unknown fusion mode: {mode}")
    # Spark takes a union of windows' lists as dealt by query_id, plans no exchange after it, and may then run it as not dealt (4.1,
    # where an exchange of nullable ids is used twice). By a key of its own a query's rows always meet.
    rows = rows.select(F.struct("query_id").alias("asked"), "list", "id", "rank")
    before = Window.partitionBy("asked").orderBy("list").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("shift", F.count("*").over(before) if mode == "offset" else F.lit(0))
    merged = rows.groupBy("asked", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank") + F.col("shift"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "first", "id")
    return merged.withColumn("rank", F.row_number().over(order)).select("asked.query_id", "id", "score", "rank")


def lexical_score(query: Column, text: Column) -> Column:
    """Share of a query's distinct terms that a text holds: the offline reranker's score."""
    asked = F.array_distinct(T.terms(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, T.terms(text))) / F.size(asked))


def rerank(ranked: DataFrame, score: Column) -> DataFrame:
    """Rows by ``score`` (missing: 0), ties by the rank they had."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    scored = ranked.withColumn("rerank_score", F.round(F.coalesce(score, F.lit(0.0)), 6))
    return scored.withColumn("new_rank", F.row_number().over(order))


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def mmr(ranked: DataFrame, vectors: DataFrame, k: int = 10, trade: float = 0.5) -> DataFrame:
    """(query_id, place, id): greedy choice of relevance less similarity to what is chosen.

    ``ranked`` has the fetched candidates (query_id, id, score, rank), ``vectors`` (id, vec). A
    fold over at most fetch_k candidates per query; ties go to the better rank.
    """
    rows = ranked.join(vectors, "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", F.col("vec").cast("array<double>").alias("vec")))).alias("c"))
    sims = F.transform("c", lambda x: F.transform("c", lambda y: F.round(T.cosine(x["vec"], y["vec"]), 6)))
    rows = rows.select("query_id", F.col("c"), sims.alias("s"))

    def pick(chosen, _):
        left = F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: ~F.array_contains(chosen, i))
        value = lambda i: F.round(trade * F.get("c", i)["score"] - (1 - trade) * F.coalesce(F.array_max(F.transform(chosen, lambda j: F.get(F.get("s", i), j))), F.lit(0.0)), 9)
        best = F.array_max(F.transform(left, lambda i: F.struct(value(i).alias("v"), (-i).alias("i"))))
        return F.when(F.size(left) > 0, F.array_append(chosen, -best["i"])).otherwise(chosen)

    order = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.expr("cast(array() as array<int>)"), pick)
    return rows.select("query_id", F.posexplode(F.transform(order, lambda i: F.get("c", i)["id"])).alias("place", "id"))
