"""The corpus pipeline: quality rules, near-duplicate removal, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All
but the last return the columns of ``docs``; the last returns packed pieces.

Defined results, for each stage: a null text is an empty one, and an empty table gives an empty result; other columns,
whatever their names, pass through (``n_chars`` too: it stays what it was when a stage shortens a text).
``quality`` rejects texts without words; of rows repeated it keeps all. ``near_duplicates`` keeps one row of equal rows
and of each group, that of the smallest id, a row with an id before one without; a row without words has no
group and stays. ``secrets`` keeps every row, ids null or equal too. ``mix`` gives a row its copies by its
id's draw, so rows of one id are copied alike; a text without words takes no words. ``pack`` gives each row, repeated ones too, its own pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, mixing, packing, quality, secrets
from lodestone.llm.common import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the base rules or the line rules reject (operator 8)."""
    return quality.filter_documents(docs, clean=True)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a shingle similarity of 0.8, the smallest id stays (operator 9)."""
    return jaccard.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are blanked in the text; all documents stay (operator 2)."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for (operator 1)."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies in windows of 2048 ids (operator 6)."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: SQL can't express tokenizing and packing; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
