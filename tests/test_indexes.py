"""The inverted index against scoring everything, the vector index against the exact search."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.errors import RetrievalError
from lodestone.operators import inverted, retrieval
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.ivf import VectorIndex
from lodestone.plans import catalogue as C

TEXTS, QUERIES = "id bigint, text string", "query_id int, text string"


def corpus(spark, seed, n, most=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(words[min(399, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(0, most)))
    docs = [(i, text()) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "w0 " * 5000)]
    asked = [(q, " ".join(rng.choice(words[:60]) for _ in range(rng.randint(1, 6)))) for q in range(25)] + [(90, ""), (91, None), (92, "never seen"), (93, "w0 w0 W0")]
    return spark.createDataFrame(docs, TEXTS), spark.createDataFrame(asked, QUERIES)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.mark.parametrize("k", [1, 10])
def test_index_finds_what_scoring_all_finds(spark, tmp_path, k):
    docs, asked = corpus(spark, k, 1500)
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=8)
    index.add(docs)
    assert rows(index.search(asked, k)) == rows(retrieval.bm25_topk(asked, docs, k))
    read = index.pruned(asked, k).agg(F.sum("blocks"), F.sum("summed")).first()
    assert 0 < read[1] < read[0]


def test_shards(spark, tmp_path, monkeypatch):
    """Terms of every text lie in several shards; results are the same."""
    monkeypatch.setattr(inverted, "SHARD", 300)
    docs, asked = corpus(spark, 12, 1500)
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(docs)
    assert spark.read.parquet(f"{index.segments()[1]}/postings").filter("term = 'w0'").select("shard").distinct().count() == 6
    assert rows(index.search(asked, 10)) == rows(retrieval.bm25_topk(asked, docs, 10))


def test_segments_removal_and_compaction(spark, tmp_path):
    docs, asked = corpus(spark, 5, 900)
    more = corpus(spark, 6, 300, 90)[0].withColumn("id", F.col("id") + 10_000)  # longer texts: the mean grows
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.search(asked, 5).count() == 0
    assert [index.add(docs), index.add(more)] == [1, 2]
    both = docs.unionByName(more)
    assert rows(index.search(asked, 5)) == rows(retrieval.bm25_topk(asked, both, 5))
    best = index.search(asked, 5).filter("rank = 1").select("id").distinct()
    gone = {r["id"] for r in best.collect()}
    index.remove(best)
    left = {r["id"] for r in index.search(asked, 5).collect()}
    assert gone and not gone & left
    again = both.join(best, "id", "left_semi")
    index.add(again)
    assert gone & {r["id"] for r in index.search(asked, 5).collect()}
    assert index.compact(both) == 4 and list(index.segments()) == [4]
    assert rows(index.search(asked, 5)) == rows(retrieval.bm25_topk(asked, both, 5))


def test_a_segment_that_was_not_finished_is_left_out(spark, tmp_path):
    docs, asked = corpus(spark, 7, 200)
    index = InvertedIndex(spark, str(tmp_path / "i"))
    index.add(docs)
    os.makedirs(tmp_path / "i/segments/00000002/postings")
    assert rows(index.search(asked, 5)) == rows(retrieval.bm25_topk(asked, docs, 5))
    assert index.add(docs.withColumn("id", F.col("id") + 5000)) == 3 and list(index.segments()) == [1, 3]


def test_index_reads_the_asked_buckets(spark, tmp_path):
    docs, _ = corpus(spark, 8, 300)
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=16)
    index.add(docs.withColumn("extra", F.lit(1)))
    plan = index._asked(spark.createDataFrame([(1, "w3 w5")], QUERIES))[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term", plan)
    strings = docs.withColumn("id", F.concat(F.lit("d"), F.col("id").cast("string")))
    other = InvertedIndex(spark, str(tmp_path / "s"))
    other.add(strings)
    asked = spark.createDataFrame([(1, "w3 w5")], QUERIES)
    assert rows(other.search(asked, 7)) == rows(retrieval.bm25_topk(asked, strings, 7))


def test_search_shuffles_no_sums(spark, tmp_path):
    """A shard is summed in its task: blocks go there by shard, and nothing is dealt by query and document."""
    docs, asked = corpus(spark, 3, 100)
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(docs)
    plan = index.search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "hashpartitioning(segment" in plan
    assert not re.search(r"hashpartitioning\([^)]*\bid#", plan)


def test_parts_of_queries_and_of_texts(spark, tmp_path, monkeypatch):
    """Queries by parts, texts by parts, shards of few texts, more copies of a text than are asked for, removed texts."""
    monkeypatch.setattr(inverted, "SHARD", 200)
    monkeypatch.setattr(inverted, "PART", 2000)
    monkeypatch.setattr(inverted, "CELLS", 2000)
    docs, asked = corpus(spark, 15, 900)
    copies = spark.range(20_000, 20_100).select("id", F.lit("w1 w2 w3 w4").alias("text"))
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(docs.unionByName(copies))
    assert rows(index.search(asked, 10)) == rows(retrieval.bm25_topk(asked, docs.unionByName(copies), 10))
    gone = copies.filter("id % 3 = 0").select("id")
    index.remove(gone)
    left = {(r["query_id"], r["id"]): r["score"] for r in index.search(asked, 2000).collect()}
    every = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25_topk(asked, docs.unionByName(copies), 2000).collect()}
    assert left == {(q, i): s for (q, i), s in every.items() if i < 20_000 or i % 3}


def test_segment_of_the_earlier_form(spark, tmp_path):
    """One whose terms lie in folders by another hash, with its totals silent on it."""
    docs, asked = corpus(spark, 16, 400)
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(docs)
    old, new = InvertedIndex(spark, str(tmp_path / "o"), buckets=4), index.segments()[1]
    for part in ("postings", "terms"):
        rows_ = spark.read.parquet(f"{new}/{part}").withColumn("bucket", old._bucket("xxhash64"))
        rows_.write.partitionBy("bucket").parquet(f"{old.folder}/segments/00000001/{part}")
    spark.read.parquet(f"{new}/totals").drop("hashed").write.parquet(f"{old.folder}/segments/00000001/totals")
    assert rows(old.search(asked, 10)) == rows(index.search(asked, 10)) != []


def test_ivf_recall(spark, tmp_path, sf):
    index = VectorIndex(spark, str(tmp_path / "t"))
    index.build(C._vectors(spark, sf))
    assert index.rows().count() == C._vectors(spark, sf).count()
    assert index.recall(C._asked(spark, sf), C._vectors(spark, sf), 30) >= 0.9
    assert index.recall(C._asked(spark, sf), C._vectors(spark, sf), 30, probes=10_000) == 1.0


def test_ivf_of_clusters_needs_few_lists(spark, tmp_path):
    rng = random.Random(9)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    data = [(i, [x + rng.gauss(0, 0.2) for x in centers[i % 30]]) for i in range(1500)] + [(5000 + i, centers[0]) for i in range(400)]
    vectors = spark.createDataFrame(data, "id bigint, vec array<double>")
    asked = vectors.filter("id < 60").select(F.col("id").alias("query_id"), "vec")
    index = VectorIndex(spark, str(tmp_path / "c"))
    assert index.build(vectors, lists=30) == 30
    assert index.recall(asked, vectors, 10, probes=4) >= 0.9
    assert index.rows().filter("id >= 5000").select("list").distinct().count() == 1


def test_ivf_defined_results(spark, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "id int, vec array<double>").withColumn("list", F.lit("x"))
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id int, vec array<double>")
    index = VectorIndex(spark, str(tmp_path / "o"))
    assert index.build(odd) == 1
    hits = index.search(asked, 10).collect()
    assert {(h["query_id"], h["id"]) for h in hits if h["rank"] <= 2} >= {(7, 3), (7, 4)} and {h["id"] for h in hits if h["query_id"] == 8} == {1, 2, 3, 4}
    with pytest.raises(RetrievalError):
        index.search(asked, 10, probes=0)
    index.build(odd.filter("false"))
    assert index.search(asked, 10).count() == 0


def test_vector_search_leaves_out_what_cannot_be_a_hit(spark, tmp_path):
    """A task gives the k best of its lists for each query, not all rows of them."""
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "id bigint, vec array<double>")
    index = VectorIndex(spark, str(tmp_path / "v"))
    n = index.build(v, lists=6)
    asked = v.filter("id < 5").withColumnRenamed("id", "query_id")
    plan = index.search(asked, 3, n)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    assert sorted(r["query_id"] for r in index.search(asked, 3, n).collect()) == sorted([0, 1, 2, 3, 4] * 3)
    assert index.recall(asked, v, 3, n) == 1.0
