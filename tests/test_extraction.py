"""Metadata of chunks by a provider that answers from the prompt itself."""

from pyspark.sql import functions as F

from lodestone.operators import extraction

ROWS = [("a0", 1, 0, "the report on the budget is long and it was sent"), ("a1", 1, 1, "short"), ("a2", 1, 2, None), ("b0", 2, 0, "broken answer here")]
CHUNKS = "id string, doc_id bigint, chunk_index int, content string"


def ask(prompt):
    batch = F.lit('```json\n[{"entities": {"people": ["Ann", "Bo"], "note": "x"}, "topics": ["budget", "money"], "doc_type": "Report"}, {"topics": "none", "doc_type": 3}]\n```')
    alone = F.when(prompt.contains("doc_type:"), F.lit("an email")).when(prompt.contains("topics:"), F.lit('["t"]')).otherwise(F.lit('{"dates": ["2024"]}'))
    return F.when(prompt.contains("For each chunk"), F.when(prompt.contains("broken"), F.lit("sorry")).otherwise(batch)).otherwise(alone)


def test_batches_and_their_fallback(spark):
    got = {r["id"]: r for r in extraction.extract(spark.createDataFrame(ROWS, CHUNKS), ask).collect()}
    assert len(got) == 4
    assert got["a0"]["entities"] == {"people": ["Ann", "Bo"]} and got["a0"]["topics"] == ["budget", "money"] and got["a0"]["doc_type"] == "report"
    assert all(got[i]["entities"] == {} and got[i]["topics"] == [] and got[i]["doc_type"] is None for i in ("a1", "a2"))
    assert got["b0"]["entities"] == {"dates": ["2024"]} and got["b0"]["topics"] == ["t"] and got["b0"]["doc_type"] == "email"
    assert got["a0"]["language"] == "en" and "budget" in got["a0"]["keywords"] and got["a2"]["keywords"] == [] and got["a1"]["structural"]["char_count"] == 5


def test_single_chunks_and_none(spark):
    rows = spark.createDataFrame(ROWS, CHUNKS).withColumn("items", F.lit(1))
    assert {r["topics"][0] for r in extraction.extract(rows, ask, 1).collect()} == {"t"}
    assert "topics" not in extraction.extract(rows).columns and extraction.extract(rows.limit(0), ask).count() == 0
