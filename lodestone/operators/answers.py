"""Answers: packing context, refusals, citations, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

MARKER = "\n[truncated]"


def pack_context(hits: DataFrame, budget: int = 12_000, least: int = 200) -> DataFrame:
    """(query_id, context, n_used) of ranked hits (query_id, rank, source, content).

    A part is ``[n] Source: s``, a line end and the text; parts are joined by a blank line. A text
    over what remains is cut, with a marker; one that would keep under ``least`` characters keeps
    ``least``. An ordered fold, so a query's hits are the only thing gathered.
    """
    state = "struct<parts:array<string>,left:int>"
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("content", F.lit("")).alias("content")))).alias("h"))
    empty = F.expr(f"cast(named_struct('parts', array(), 'left', {budget}) as {state})")

    def step(acc, x):
        head = F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] Source: "), x["source"], F.lit("\n"))
        room = acc["left"] - F.length(head)
        cut = F.rtrim(F.substring(x["content"], F.lit(1), F.greatest(room - len(MARKER), F.lit(least))))
        body = F.when(F.length(x["content"]) <= room, x["content"]).otherwise(F.concat(cut, F.lit(MARKER)))
        part = F.concat(head, body)
        return F.when(acc["left"] <= 0, acc).otherwise(F.struct(F.array_append(acc["parts"], part).alias("parts"), (acc["left"] - F.length(part) - 2).alias("left")))

    packed = F.aggregate("h", empty, step, lambda acc: acc["parts"])
    return rows.select("query_id", packed.alias("p")).select("query_id", F.array_join("p", "\n\n").alias("context"), F.size("p").cast("long").alias("n_used"))


def is_refusal(answer: Column, sentinel: str = "INSUFFICIENT_CONTEXT") -> Column:
    clean = F.trim(F.coalesce(answer, F.lit("")))
    return (clean == "") | (F.contains(F.lower(clean), F.lit(sentinel.lower())) & (F.length(clean) < len(sentinel) + 120))


def citations(answer: Column) -> Column:
    """All numbers in square brackets, first occurrences in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def valid_citations(answer: Column, n: Column) -> Column:
    return F.filter(citations(answer), lambda c: (c >= 1) & (c <= n))


def without_invalid(answer: Column, n: Column) -> Column:
    """The answer without marks that cite nothing; blanks are tidied only if there were any."""
    pieces = F.regexp_extract_all(F.concat(answer, F.lit("[0]")), F.lit(r"(?s)(.*?)\[(\d{1,9})\]"), F.lit(1))
    numbers = F.regexp_extract_all(F.concat(answer, F.lit("[0]")), F.lit(r"(?s)(.*?)\[(\d{1,9})\]"), F.lit(2))
    rebuilt = F.array_join(F.zip_with(pieces, numbers, lambda p, c: F.concat(p, F.when((c.cast("int") >= 1) & (c.cast("int") <= n), F.concat(F.lit("["), c, F.lit("]"))).otherwise(""))), "")
    bad = F.size(F.filter(citations(answer), lambda c: (c < 1) | (c > n))) > 0
    return F.when(bad, F.trim(F.regexp_replace(rebuilt, " {2,}", " "))).otherwise(answer)


def confidence(answer: Column) -> Column:
    """Share of sentences with a citation; 0 without sentences."""
    s = T.sentences(answer)
    return F.when(F.size(s) == 0, 0.0).otherwise(F.size(F.filter(s, lambda x: x.rlike(r"\[\d+\]"))) / F.size(s))


def answer(hits: DataFrame, ask: Callable[[Column, Column], Column], refusal: str = "Not enough information to answer.", budget: int = 12_000) -> DataFrame:
    """(query_id, answer, citations, confidence, sources, refused) with an answering expression.

    ``ask(query, context)`` is the provider: any Column expression or vectorised UDF. ``hits`` also
    has ``query``. Queries whose answer refuses get the refusal text.
    """
    packed = pack_context(hits, budget)
    about = hits.groupBy("query_id").agg(F.first("query").alias("query"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("all"))
    said = packed.join(about, "query_id").withColumn("said", ask(F.col("query"), F.col("context")))
    refused = is_refusal(F.col("said"))
    n = F.col("n_used").cast("int")
    cited = valid_citations(F.col("said"), n)
    return said.select(
        "query_id",
        F.when(refused, F.lit(refusal)).otherwise(without_invalid(F.col("said"), n)).alias("answer"),
        F.when(refused, F.array().cast("array<int>")).otherwise(cited).alias("citations"),
        F.when(refused, 0.0).otherwise(confidence(F.col("said"))).alias("confidence"),
        F.array_distinct("all").alias("sources"),
        refused.alias("refused"),
    )


def formatted(answer: Column, sources: Column) -> Column:
    return F.when(F.size(sources) == 0, answer).otherwise(F.concat(answer, F.lit("\n\nSources:\n"), F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s)), "\n")))
