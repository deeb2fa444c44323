"""Layout-aware chunks: a document's elements as a tree of sections, packed within each section, with the path of headers.

``elements`` puts each block of a text under its heading: the path of a block is the last heading of each level, as
far as no heading of a higher rank came after it. Windows over a document's blocks find it, so blocks are rows and no
document is gathered. ``packed`` joins neighbouring blocks of one path: a chunk takes what begins within the same
``size`` characters of its section, so where it ends follows from lengths before it, and a table or code block is
never cut. ``hybrid`` takes a served chunker's answers, and these chunks where one failed.

Defined results: null and blank texts have no chunk; a heading is part of its path and no content of its own, but for one
without content below it, which gives a chunk of its text; a block longer than ``size`` is a chunk by itself with what
begins in its window; repeated ids would mix, so ids must be unique; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import chunking, conversion

LEVELS = 6
#: Between the headers of a path.
STEP = " > "


def elements(docs: DataFrame) -> DataFrame:
    """(doc_id, block, content, kind, level, path, leaf): blocks in order; level is that of a heading, else 0; leaf
    is a heading that nothing stands below."""
    marks = F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1))
    rows = chunking.blocks(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))).withColumn("level", F.when(F.col("kind") == "heading", F.when(marks > 0, marks).otherwise(LEVELS)).otherwise(0))
    own = Window.partitionBy("doc_id").orderBy("block")
    here = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.trim(F.regexp_replace("content", "^#+", ""))
    for n in range(1, LEVELS + 1):
        rows = rows.withColumn(f"at{n}", F.last(F.when(F.col("level") == n, F.struct(F.col("block").alias("block"), title.alias("title"))), ignorenulls=True).over(here))
    parts = []
    for n in range(1, LEVELS + 1):
        higher = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"at{m}.block"), F.lit(-1)) for m in range(1, n)])
        parts.append(F.when(F.col(f"at{n}.block") > higher, F.col(f"at{n}.title")))
    path = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), STEP)
    # Only a heading of a lower rank, or content, stands below a heading.
    after = F.lead("level").over(own)
    leaf = (F.col("level") > 0) & (after.isNull() | ((after > 0) & (after <= F.col("level"))))
    return rows.select("doc_id", "block", "content", "kind", "level", path.alias("path"), leaf.alias("leaf"))


def packed(found: DataFrame, size: int = 1024) -> DataFrame:
    """(doc_id, chunk_index, content, section_header, kinds) of ``elements``: section_header is the path of headers."""
    own = Window.partitionBy("doc_id").orderBy("block")
    rows = found.withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(own)).filter("level = 0 or leaf")
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("doc_id", "section").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = F.when(F.col("level") > 0, F.trim(F.regexp_replace("content", "^#+", ""))).otherwise(F.col("content"))
    placed = rows.withColumn("window", F.floor(before / size)).withColumn("body", body)
    joined = placed.groupBy("doc_id", "section", "window").agg(F.min("block").alias("first"), F.first("path").alias("section_header"), F.sort_array(F.collect_list(F.struct("block", "body", "kind"))).alias("b"))
    chunks = joined.select("doc_id", "first", F.array_join(F.transform("b", lambda x: x["body"]), "\n\n").alias("content"), "section_header", F.array_join(F.array_distinct(F.transform("b", lambda x: x["kind"])), ",").alias("kinds"))
    return chunks.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).cast("int")).select("doc_id", "chunk_index", "content", "section_header", "kinds")


def layout_chunks(docs: DataFrame, size: int = 1024, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index, content, section_header); sections don't overlap, so ``overlap`` has no effect."""
    return packed(elements(docs), size).drop("kinds")


def hybrid(docs: DataFrame, chunker: Callable[[Column], Column] | None, size: int = 1024, overlap: int = 128, least: int = 30) -> DataFrame:
    """(doc_id, chunk_index, content, section_header) by a served chunker (a Column of texts to its JSON answers);
    documents whose answer is null, can't be read or has no chunk of ``least`` characters take ``layout_chunks``."""
    if chunker is None:
        return layout_chunks(docs, size)
    answers = docs.select(F.col("doc_id").alias("path"), chunker(F.col("text")).alias("answer"))
    told = conversion.read_chunks(answers).withColumnRenamed("path", "doc_id").filter(F.length(F.trim("content")) >= least)
    rest = docs.join(told.select("doc_id").distinct(), "doc_id", "left_anti")
    return told.unionByName(layout_chunks(rest, size))
