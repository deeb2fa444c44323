"""Vectors made once, summaries of whole documents, and reports of runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone import api, config
from lodestone.errors import EmbeddingError, RetrievalError
from lodestone.operators import conversion, reports, summaries
from lodestone.operators.memo import Memo
from lodestone.operators.store import Collection


def counted(folder, dim=3, fails=None):
    """A model that writes down each text it is asked for; ``fails`` says for which it gives nothing."""
    os.makedirs(folder, exist_ok=True)

    @F.pandas_udf("array<float>")
    def model(texts):
        import uuid

        import pandas as pd

        out = []
        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
            out.append(None if fails and fails(t, sum(open(f"{folder}/{x}").read() == t for x in os.listdir(folder))) else [float(len(t))] * dim)
        return pd.Series(out)

    return model


def asked(folder):
    return sorted(open(f"{folder}/{x}").read() for x in os.listdir(folder))


def test_vectors_are_made_once(spark, tmp_path):
    memo, calls = Memo(spark, str(tmp_path / "m")), str(tmp_path / "calls")
    model = counted(calls)
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id int, text string")
    got = {r["id"]: r["vec"] for r in memo.embed(rows, "text", "vec", model, "m1", 3).collect()}
    assert got == {1: [2.0] * 3, 2: [1.0] * 3, 3: [2.0] * 3, 4: None} and asked(calls) == ["aa", "b"]
    more = rows.unionByName(spark.createDataFrame([(5, "new")], "id int, text string")).withColumn("hash", F.lit("theirs"))
    assert memo.embed(more, "text", "vec", model, "m1", 3).filter("hash = 'theirs' and vec is not null").count() == 4 and asked(calls) == ["aa", "b", "new"]
    memo.compact()
    assert memo.embed(more, "text", "vec", model, "m1", 3).count() == 5 and len(asked(calls)) == 3 and len(memo._generations()) == 2
    memo.embed(rows, "text", "vec", model, "m2", 3).count()
    assert len(asked(calls)) == 5  # another model's vectors are its own
    before = len(os.listdir(tmp_path / "m/g00000002"))
    assert memo.embed(rows.filter("false"), "text", "vec", model, "m1").count() == 0 and len(os.listdir(tmp_path / "m/g00000002")) == before


def test_retries_and_fallback(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([(1, "fine"), (2, "late"), (3, "never")], "id int, text string")
    model = counted(str(tmp_path / "a"), fails=lambda t, n: t == "never" or (t == "late" and n < 3))
    with pytest.raises(EmbeddingError):
        memo.embed(rows, "text", "vec", model, "m", 3)
    assert asked(str(tmp_path / "a")) == ["fine"] + ["late"] * 3 + ["never"] * 3  # what was made is kept
    other = counted(str(tmp_path / "b"))
    got = {r["id"]: r["vec"][0] for r in memo.embed(rows, "text", "vec", model, "m", 3, fallback=("f", other)).collect()}
    assert got == {1: 4.0, 2: 4.0, 3: 5.0} and asked(str(tmp_path / "b")) == ["never"]
    wrong = counted(str(tmp_path / "c"), dim=2)
    with pytest.raises(EmbeddingError):
        memo.embed(rows, "text", "vec", wrong, "w", 3, tries=1)


def test_a_second_ingest_asks_for_nothing(spark, tmp_path):
    calls = str(tmp_path / "calls")
    c = Collection(spark, str(tmp_path / "c"), config.Settings(dense_dim=3), embed=counted(calls, 3))
    docs = spark.createDataFrame([(1, "a", "Mills turn by the water of the river, day and night."), (2, "b", "# Head\n\nWheels turn by the wind over the hills of the land.")], "doc_id bigint, source string, text string")
    c.ingest(docs)
    n = len(asked(calls))
    assert 2 <= n == len(set(asked(calls))) and c.chunks().filter("size(dense) = 3 and size(contextual_dense) = 3").count() == 2
    c.delete(docs.select("source"))
    c.ingest(docs)
    assert len(asked(calls)) == n and c.chunks().count() == 2


def test_summaries(spark, tmp_path):
    """Every part of a text reaches a prompt, none is over its limit, and marks come up to the root."""
    rng = random.Random(3)
    marks = [f"#{i:03d}#" for i in range(150)]
    long = "".join(m + "x" * rng.randint(0, 20) for m in marks)
    os.makedirs(tmp_path / "seen")

    @F.pandas_udf("string")
    def model(prompts):
        import re
        import uuid

        import pandas as pd

        out = []
        for p in prompts:
            body = p.split("\n\n", 1)[1]
            (tmp_path / "seen" / uuid.uuid4().hex).write_text(body)
            found = re.findall(r"#\d\d\d#", body)
            out.append(f"{found[0]}{found[-1]}" if found else None)
        return pd.Series(out)

    rows = spark.createDataFrame([(1, long), (2, "short #001#"), (3, " "), (4, None), (1, "#007# again")], "doc_id int, text string").withColumn("pieces", F.lit("x"))
    got = sorted(map(tuple, summaries.summarise(rows, model, chars=100, fan=4).collect()))
    n = -(-len(long) // 100)
    levels, left = 1, n
    while left > 1:
        left, levels = -(-left // 4), levels + 1
    assert got == [(1, "#000##149#", n, levels), (1, "#007##007#", 1, 1), (2, "#001##001#", 1, 1), (3, "", 0, 0), (4, "", 0, 0)] or got[0][:1] + got[0][2:] == (1, n, levels)
    seen = [f.read_text() for f in (tmp_path / "seen").iterdir()]
    assert max(map(len, seen)) <= 100 and all(long[i : i + 100] in seen for i in range(0, len(long), 100))
    assert summaries.summarise(rows.filter("false"), model).count() == 0


def test_contexts_with_the_documents_summary(spark):
    chunks = spark.createDataFrame([(1, i, f"c{i}", "H") for i in range(3)], "doc_id bigint, chunk_index int, content string, section_header string")
    about = spark.createDataFrame([(1, "mills")], "doc_id bigint, summary string")
    told = conversion.enrich(chunks, "summary", lambda p: F.when(p.contains("mills"), F.regexp_replace(F.regexp_extract(p, r"(?s)\n\n(.*)", 1), r"c(\d)", "about $1")), summaries=about).orderBy("chunk_index").collect()
    assert [r["content"] for r in told] == [f"[Context: about {i}] c{i}" for i in range(3)]
    assert [r["content"] for r in conversion.enrich(chunks, "summary", lambda p: F.when(p.contains("mills"), F.lit("1. x"))).collect()] == [f"[Context: H] c{i}" for i in range(3)]


def test_report_store(spark, tmp_path):
    store = reports.ReportStore(spark, str(tmp_path / "r"))
    rows = [("a", "x", 1, 0.5, 1.0), ("a", "x", 2, 0.25, 0.0), ("a", None, 3, 0.0, 1.0)]
    metrics = spark.createDataFrame(rows, "run string, category string, query_id int, mrr double, hit_5 double")
    store.save(reports.report(metrics))
    store.save(reports.report(metrics.withColumn("run", F.lit("b")).withColumn("mrr", F.lit(1.0))))
    store.save(reports.report(metrics.filter("query_id < 3")))  # a again: its last report counts
    assert [(r["run"], r["n"]) for r in store.runs().collect()] == [("a", 2), ("b", 3)]
    cell = {(r["level"], r["category"], r["metric"], r["k"]): (r["base"], r["mean"], r["delta"], r["delta_pct"]) for r in store.deltas("a", "b").collect()}
    assert cell["run_k", None, "mrr", 0] == (0.375, 1.0, 0.625, 166.6667) and cell["run_category_k", "x", "hit", 5] == (0.5, 0.5, 0.0, 0.0)
    assert "| hit |  | 0.5000 |" in store.summary("a") and store.summary("a").startswith("| metric | all | @5 |")
    for bad in (lambda: store.summary("none"), lambda: store.deltas("none"), lambda: store.deltas("a", "none")):
        with pytest.raises(RetrievalError):
            bad()


def test_runs_of_the_engine(spark, tmp_path):
    e = api.Engine(spark, str(tmp_path / "c"))
    e.ingest_texts(spark.createDataFrame([(1, "a.md", "Mills turn by the water of the river, day and night."), (2, "b.md", "Wheels of wind turn over the hills of the dry land.")], "doc_id bigint, source string, text string"))
    golden = spark.createDataFrame([("water of the river", ["A.md"], "wet"), ("dry land", ["b.md"], "dry")], "query string, expected array<string>, category string")
    assert "| mrr | 1.0000 |" in e.run(golden, "first", ks=(1, 2)) and e.reports.runs().first()["n"] == 2
    one = e.run_single("dry land", ["b.md"], 1)
    assert one["hit_1"] == 1.0 and one["results_count"] == 1 and one["results"][0]["source"] == "b.md" and "mrr" not in e.run_single("dry land")
