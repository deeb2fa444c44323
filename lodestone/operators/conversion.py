"""Reading converters' answers, choosing what needs OCR, joining pages; contexts for chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: What a converter answers: the parts that are read.
ANSWER = "struct<document:struct<md_content:string,html_content:string,text_content:string>,status:string,processing_time:double,errors:array<struct<error_message:string>>>"
CHUNKS = "struct<chunks:array<struct<text:string,headings:array<string>>>>"


def read_answers(answers: DataFrame) -> DataFrame:
    """(path, markdown, status, error_type, error) of JSON answers (path, answer).

    A failed one is a ConversionError with its messages; one without text is corrupted.
    """
    a = F.from_json("answer", ANSWER)
    rows = answers.select("path", a.alias("a")).withColumn("markdown", F.coalesce("a.document.md_content", "a.document.text_content", F.lit("")))
    status = F.coalesce("a.status", F.lit("failure"))
    messages = F.array_join(F.transform(F.coalesce("a.errors", F.array().cast("array<struct<error_message:string>>")), lambda e: e["error_message"]), "; ")
    error = F.when(~is_ok(status), "ConversionError").when(F.trim("markdown") == "", "CorruptedDocumentError")
    return rows.select("path", "markdown", status.alias("status"), error.alias("error_type"), F.when(error.isNotNull(), messages).alias("error"))


def is_ok(status: Column) -> Column:
    return status.isin("success", "partial_success")


def with_ocr(converted: DataFrame, ocr: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, markdown, needs_ocr, error_type): poor conversions go to the provider, or are deferred.

    ``converted`` has path, markdown and content; only poor rows call the provider.
    """
    poor = T.poor_quality(F.coalesce("markdown", F.lit("")), F.octet_length("content"))
    marked = converted.withColumn("poor", poor)
    fine = marked.filter("not poor").select("path", "markdown", F.lit(False).alias("needs_ocr"), F.lit(None).cast("string").alias("error_type"))
    rest = marked.filter("poor")
    if ocr is None:
        return fine.unionByName(rest.select("path", "markdown", F.lit(True).alias("needs_ocr"), F.lit(None).cast("string").alias("error_type")))
    read = rest.withColumn("markdown", F.coalesce(ocr(F.col("content")), F.lit("")))
    return fine.unionByName(read.select("path", "markdown", F.lit(False).alias("needs_ocr"), F.when(F.trim("markdown") == "", "CorruptedDocumentError").alias("error_type")))


def is_pdf(content: Column) -> Column:
    return F.ltrim(F.substring(content, 1, 64).cast("string")).startswith("%PDF-")


def joined_pages(lines: DataFrame) -> DataFrame:
    """(path, markdown, confidence) of recognised lines (path, page, line, text, score): pages with text, ruled off."""
    pages = lines.filter(F.trim("text") != "").groupBy("path", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    texts = pages.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("markdown"))
    return texts.join(lines.groupBy("path").agg(F.round(F.avg("score"), 6).alias("confidence")), "path")


def out_of_memory(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("out of memory|outofmemory|cuda error|oom")


def read_chunks(answers: DataFrame) -> DataFrame:
    """(path, chunk_index, content, section_header) of a chunker's JSON answers; blank chunks go."""
    kept = F.filter(F.coalesce(F.from_json("answer", CHUNKS)["chunks"], F.array().cast("array<struct<text:string,headings:array<string>>>")), lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    rows = answers.select("path", F.posexplode(kept).alias("chunk_index", "c"))
    return rows.select("path", "chunk_index", F.col("c.text").alias("content"), F.coalesce(F.get("c.headings", F.lit(0)), F.lit("")).alias("section_header"))


def enrich(chunks: DataFrame, strategy: str = "header", ask: Callable[[Column], Column] | None = None, batch: int = 10, most: int = 8, summaries: DataFrame | None = None) -> DataFrame:
    """Chunks (doc_id, chunk_index, content, section_header) with ``context_prefix`` before their content.

    header: the section's header. surrounding, summary: a model is asked once per batch of
    ``batch`` chunks, for at most ``most`` batches a document, with a numbered list; chunks
    beyond, and those it says nothing of, take the header. ``summaries`` (doc_id, summary) of whole
    documents go before the list.
    """
    by_header = T.context_header(F.col("section_header"))
    if strategy == "header" or ask is None:
        return chunks.withColumn("context_prefix", by_header).withColumn("content", T.apply_context(F.col("context_prefix"), F.col("content")))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    around = F.concat_ws("\n", F.right(F.coalesce(F.lag("content").over(w), F.lit("")), F.lit(200)), F.substring("content", 1, 300), F.substring(F.coalesce(F.lead("content").over(w), F.lit("")), 1, 200))
    about = around if strategy == "surrounding" else F.substring("content", 1, 500)
    rows = chunks.withColumn("nth", F.row_number().over(w) - 1).withColumn("about", about).withColumn("batch", F.floor(F.col("nth") / batch))
    asked = rows.filter(F.col("batch") < most).groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("nth", "about"))).alias("l"))
    prompt = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.regexp_replace(x["about"], "\n", " "))), "\n")
    if summaries is not None:
        asked = asked.join(summaries.select("doc_id", "summary"), "doc_id", "left")
        prompt = F.concat(F.lit("The document: "), F.coalesce("summary", F.lit("")), F.lit("\n\n"), prompt)
    said = asked.select("doc_id", "batch", F.posexplode(T.numbered_lines(F.coalesce(ask(prompt), F.lit("")), F.size("l"))).alias("i", "said"))
    told = said.select("doc_id", (F.col("batch") * batch + F.col("i")).alias("nth"), "said")
    full = rows.join(told, ["doc_id", "nth"], "left").withColumn("context_prefix", F.when(F.trim(F.coalesce("said", F.lit(""))) == "", by_header).otherwise(T.context_header(F.col("said"))))
    return full.withColumn("content", T.apply_context(F.col("context_prefix"), F.col("content"))).drop("nth", "about", "batch", "said")


def pending_items(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items of a batch that its state table does not have as completed or failed."""
    return items.join(state.filter(F.col("status").isin("completed", "failed")).select("item"), "item", "left_anti")


def expired_states(states: DataFrame, now: Column) -> DataFrame:
    """Batch states to remove: complete ones after 7 days, others after 30."""
    days = F.when(F.col("complete"), 7).otherwise(30)
    return states.filter(F.col("updated_at") < now - F.make_dt_interval(days))
