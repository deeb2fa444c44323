"""All metadata of chunks: what a chat provider is asked for, and what is computed.

``ask`` is a provider: a Column of prompts to a Column of answers. Chunks are (id, doc_id, chunk_index,
content); results are keyed by id. ``per_chunk`` asks for each chunk alone; ``batched`` asks once for up to
``size`` neighbouring chunks of a document and goes back to single chunks where that answer can't be read.

Defined results: an answer that can't be read gives no entities and topics and the type unknown (a type only
for a document's chunk 0, else null); an answer with fewer objects than chunks leaves the rest empty; null
content is empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DOC_TYPES, ENTITY_KEYS
from lodestone.functions import text as T
from lodestone.operators import metadata

Ask = Callable[[Column], Column]
#: Characters of a chunk that go into a prompt: alone, and in a batch; and of a text to classify.
ALONE, IN_BATCH, TO_CLASSIFY = 1000, 500, 2000
_ENTITIES = f"entities: a JSON object with lists of strings under {', '.join(ENTITY_KEYS)}"
_TYPE = f"doc_type: one of {', '.join(DOC_TYPES)}"


def _topics(most: int) -> str:
    return f"topics: a JSON array of at most {most} short noun phrases"


def _said(task: str, text: Column, chars: int) -> Column:
    return F.concat(F.lit(f"Read the text and answer with JSON only. {task}\n\nText: "), F.substring(text, 1, chars))


def computed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with language, keywords and structure; no provider is needed."""
    rows = chunks.select("id", "doc_id", "chunk_index", F.coalesce("content", F.lit("")).alias("content"))
    bare = rows.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    form = metadata.structural(bare)
    form = form.select(F.col("doc_id").alias("id"), F.struct(*[c for c in form.columns if c != "doc_id"]).alias("structural"))
    words = metadata.keywords(bare).withColumnRenamed("doc_id", "id")
    joined = rows.withColumn("language", metadata.language(F.col("content"))).join(words, "id", "left").join(form, "id", "left")
    return joined.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def per_chunk(chunks: DataFrame, ask: Ask, most_entities: int = 10, most_topics: int = 5) -> DataFrame:
    """(id, entities, topics, doc_type), three questions a chunk."""
    text = F.coalesce("content", F.lit(""))
    kind = metadata.doc_type(ask(_said(_TYPE, text, TO_CLASSIFY)))
    return chunks.select(
        "id",
        metadata.entities(ask(_said(_ENTITIES, text, ALONE)), most_entities).alias("entities"),
        metadata.topics(ask(_said(_topics(most_topics), text, ALONE)), most_topics).alias("topics"),
        F.when(F.col("chunk_index") == 0, kind).alias("doc_type"),
    )


def batched(chunks: DataFrame, ask: Ask, size: int = 10, most_entities: int = 10, most_topics: int = 5) -> DataFrame:
    """The same with one question for ``size`` chunks; a group gathers no more rows than that."""
    part = F.struct("chunk_index", "id", F.substring(F.coalesce("content", F.lit("")), 1, IN_BATCH).alias("text"))
    groups = chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / size).alias("nth")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    listed = F.array_join(F.transform("parts", lambda p, i: F.concat(F.lit("[Chunk "), i.cast("string"), F.lit("]: "), p["text"])), "\n\n")
    task = f"For each chunk give one object with these keys, in a JSON array in order. {_ENTITIES}; {_topics(most_topics)}; {_TYPE}.\n\n"
    read = F.try_parse_json(T.strip_fences(ask(F.concat(F.lit(task), listed))))
    items = F.coalesce(F.try_variant_get(read, "$", "array<variant>"), F.when(F.schema_of_variant(read).startswith("OBJECT"), F.array(read)))
    answered = groups.select("parts", items.alias("items")).select("items", F.posexplode("parts").alias("at", "p"))
    each = answered.select(F.col("p.id").alias("id"), F.col("p.chunk_index").alias("chunk_index"), F.col("items").isNotNull().alias("well"), F.get("items", F.col("at")).alias("item"))
    field = lambda name: F.try_variant_get("item", f"$.{name}", "variant")
    # A type asked for may come as any JSON value; only a text is one.
    kind = F.when(F.schema_of_variant(field("doc_type")) == "STRING", F.try_variant_get("item", "$.doc_type", "string"))
    well = each.filter("well").select(
        "id",
        metadata.entities(F.to_json(field("entities")), most_entities).alias("entities"),
        metadata.topics(F.to_json(field("topics")), most_topics).alias("topics"),
        F.when(F.col("chunk_index") == 0, metadata.doc_type(kind)).alias("doc_type"),
    )
    ill = chunks.join(each.filter("NOT well").select("id"), "id", "left_semi")
    return well.unionByName(per_chunk(ill, ask, most_entities, most_topics))


def extract(chunks: DataFrame, ask: Ask | None = None, size: int = 10) -> DataFrame:
    """``computed`` metadata, and the provider's where there is one (in batches of ``size``; 1 asks for each alone)."""
    made = computed(chunks)
    if ask is None:
        return made
    return made.join(per_chunk(chunks, ask) if size == 1 else batched(chunks, ask, size), "id", "left")
