"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered list of typed parts (``PART``). A visitor, one branch per
type, flattens text, image, audio and document parts into text with ordered placeholders,
records a reference for each attachment and counts the tokens its placeholder expands to.

``format_conversations`` writes one string per conversation::

    <s><|role|>\\n text </s> ... (a newline after each </s>)

The control strings are ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. Inside texts
each of them, and each of them already escaped, gets one more backslash after its first
character, so the template's own marks are the only bare ones and reading back removes one.
Roles are percent-encoded. ``read_back`` restores the turns from the string alone, and the
loss text from the string and the mask.

Defined results: null text and null role are empty; a null turn comes first; turns tie-break by role, then by
text as it was said; rows without a conv_id are one conversation; repeated rows are turns of their own; an
empty table gives an empty result; other columns are ignored, one called ``parts`` too unless it is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Fixed values of the template: begin, end of turn, escaped openings.
BEGIN, END = "<s>", "</s>\n"
CONTROL = r"(\||/?s>|/?INST\])"
#: Tokens an attachment expands to: image tiles, audio frames, document pages.
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 336, 144, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()]))


def _expanded(p: Column) -> Column:
    tiles = F.ceil(F.coalesce(p["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(p["height"], F.lit(TILE)) / TILE)
    return (
        F.when(p["type"] == "image", tiles * TOKENS_PER_TILE)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def visit_parts(parts: Column) -> Column:
    """struct<content, attachments, expanded_tokens> of a list of typed parts.

    Placeholders ``<|image_1|>`` are numbered over all attachments of the turn, in order. Texts
    between two attachments are joined before they are escaped, so a control string in pieces is
    escaped as a whole. A part of unknown or null type is read as text; a null list is an empty one.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attached = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    held = F.filter(parts, attached)
    # Places (from 1) of the attachments, with one before the first part and one behind the last.
    places = F.filter(F.transform(parts, lambda p, i: F.when(attached(p), i + 1)), lambda i: i.isNotNull())
    places = F.concat(F.array(F.lit(0)), places, F.array(F.size(parts) + 1))
    runs = F.transform(F.slice(places, 2, F.size(places) - 1), lambda end, k: escape(F.array_join(F.transform(F.slice(parts, F.get(places, k) + 1, end - F.get(places, k) - 1), lambda p: F.coalesce(p["text"], F.lit(""))), "")))
    marks = F.transform(held, lambda p, i: F.concat(F.lit("<|"), p["type"], F.lit("_"), (i + 1).cast("string"), F.lit("|>")))
    flat = F.zip_with(runs, marks, lambda run, mark: F.concat(F.coalesce(run, F.lit("")), F.coalesce(mark, F.lit(""))))
    refs = F.transform(held, lambda p, i: F.struct((i + 1).cast("int").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    return F.struct(F.array_join(flat, "").alias("content"), refs.alias("attachments"), F.aggregate(held, F.lit(0).cast("long"), lambda a, p: a + _expanded(p)).alias("expanded_tokens"))


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per conversation: formatted, loss_spans, attachments, expanded_tokens.

    ``turns`` has conv_id, turn, role and ``text``, which is visited as one text part, or a column of
    typed parts (array of ``PART``), named by ``parts``. ``loss_spans`` are (start, length) in code points of
    the formatted string, one for each assistant content; where a turn begins is a running sum over
    the conversation's turns in their order.
    """
    role = F.coalesce(column(turns, "role").cast("string"), F.lit(""))
    given = text_parts(column(turns, "text")) if parts is None else column(turns, parts)
    said = F.array_join(F.transform(given, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    visited = turns.select(column(turns, "conv_id").alias("conv_id"), column(turns, "turn").alias("turn"), role.alias("role"), F.coalesce(said, F.lit("")).alias("said"), visit_parts(given).alias("body"))
    header = F.concat(F.lit("<|"), F.url_encode("role"), F.lit("|>\n"))
    sized = visited.withColumn("header", header).withColumn("length", (F.length("header") + F.length("body.content") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    # The place is there because a list's own order is not promised; sort and grouping share one shuffle.
    placed = sized.withColumn("nth", F.row_number().over(order)).withColumn("before", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = len(BEGIN) + F.coalesce("before", F.lit(0).cast("long")) + F.length("header")
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("long").alias("start"), F.length("body.content").cast("long").alias("length")))
    turn = F.struct("nth", F.concat("header", "body.content", F.lit(END)).alias("segment"), span.alias("span"), F.col("body.attachments").alias("attachments"), F.col("body.expanded_tokens").alias("tokens"))
    grouped = placed.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join("turns.segment", "")).alias("formatted"),
        F.filter("turns.span", lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten("turns.attachments").alias("attachments"),
        F.aggregate("turns.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from ``formatted`` and ``loss_spans`` alone.

    Turns come from splitting the string at its bare end marks, the loss text from cutting
    the string at the mask's spans; both are unescaped.
    """
    pieces = F.split(F.substr(F.col("formatted"), F.lit(len(BEGIN) + 1)), END)
    head = r"\A<\|([^|]*)\|>\n"
    turns = F.transform("pieces", lambda p: F.struct(F.url_decode(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1)).select("conv_id", "formatted", "attachments", "expanded_tokens", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
