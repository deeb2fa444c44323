"""Summaries of whole documents by a chat provider, as a tree of bounded prompts.

A text is cut into pieces that fit a prompt; each is summarised, and ``fan`` neighbouring summaries at a time are
summarised again, until one is left. No prompt has more than ``chars`` characters of text, and every character of
a document is in one of the lowest. Levels are logarithmic in a text's length. Each level is a written table, so a task that
runs again asks for its own prompts only, and documents that are done leave.

Defined results: a null or blank text has an empty summary and asks nothing; a null answer is an empty summary of its
piece; repeated ids are documents of their own; texts are cut between code points; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import workspace

PIECE = "Summarise this part of a document in at most {n} characters.\n\n"
PARTS = "These are summaries of neighbouring parts of a document, in order. Summarise them as one text in at most {n} characters.\n\n"


def summarise(docs: DataFrame, ask: Callable[[Column], Column], chars: int = 4000, fan: int = 8) -> DataFrame:
    """(doc_id, summary, pieces, levels) of (doc_id, text); ``ask`` is given prompts of at most ``chars`` characters of text."""
    most = max(1, chars // fan - 2)  # of one summary, so that fan of them and what is between fit
    spark = docs.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = workspace(spark, "summaries")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def asked(text: Column, prompt: str) -> Column:
        return F.substring(F.coalesce(ask(F.concat(F.lit(prompt.format(n=most)), text)), F.lit("")), 1, most)

    numbered = written(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_id", F.monotonically_increasing_id()))
    full = numbered.filter(F.trim("text") != "")
    pieces = full.select("doc_id", "_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chars).cast("int")), lambda i: F.substring("text", i * chars + 1, F.lit(chars)))).alias("nth", "text"))
    level = written(pieces.select("doc_id", "_id", "nth", asked(F.col("text"), PIECE).alias("text")))
    done = numbered.filter(F.trim("text") == "").select("doc_id", F.lit("").alias("summary"), F.lit(0).cast("long").alias("pieces"), F.lit(0).alias("levels"))
    counts = level.groupBy("_id").agg(F.count("*").alias("pieces"))
    levels, left = 1, level
    while True:
        sizes = left.groupBy("_id").agg(F.count("*").alias("n"))
        single = left.join(sizes.filter("n = 1").select("_id"), "_id").join(counts, "_id")
        done = done.unionByName(single.select("doc_id", F.col("text").alias("summary"), "pieces", F.lit(levels).alias("levels")))
        rest = left.join(sizes.filter("n > 1").select("_id"), "_id")
        if not rest.head(1):
            return done
        # A group has ``fan`` rows at most.
        groups = rest.groupBy("doc_id", "_id", F.floor(F.col("nth") / fan).cast("int").alias("nth")).agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
        left = written(groups.select("doc_id", "_id", "nth", F.when(F.size("parts") == 1, joined).otherwise(asked(joined, PARTS)).alias("text")))
        levels += 1
