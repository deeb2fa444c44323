"""Operators on fixtures: chunking, fusion, answers, filters, status, sources, store, streams."""

import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config, errors
from lodestone.functions import text as T
from lodestone.operators import answers, chunking, dense, embedding, evaluation, filters, metadata, retrieval, sync
from lodestone.operators.store import Collection
from lodestone.plans import catalogue
from lodestone.sources import convert, datasets, files
from lodestone.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "int", list: "array<string>"}[type(v)]) for k, v in values.items()))) if values else spark.range(1)
    return row.select(column).first()[0]


# --- scalar functions


def test_uuid5_matches_the_standard(spark):
    import uuid

    names = ["a_0", "ü/日本_12", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5(F.col("n"))).collect()
    assert all(r[1] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r[0])) for r in got)


@pytest.mark.parametrize(("said", "want"), [("[Context: A b] x", "x"), ("[Context: a] b] x", "b] x"), ("x [Context: a]", "x [Context: a]")])
def test_strip_context(spark, said, want):
    assert one(spark, T.strip_context(F.col("s")), s=said) == want


def test_numbered_lines(spark):
    assert one(spark, T.numbered_lines(F.col("s"), F.lit(4)), s="1. a\n 2) b c\nnoise\n3. d") == ["a", "b c", "d", ""]
    assert one(spark, T.numbered_lines(F.col("s"), F.lit(1)), s="1. a\n2. b") == ["a"]


def test_cosine_edges(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, T.cosine(v(1, 0), v(0, 1))) == 0 and one(spark, T.cosine(v(0, 0), v(0, 1))) == 0 and one(spark, T.cosine(v(2, 2), v(1, 1))) == pytest.approx(1)


# --- chunking


def test_recursive_headers_and_overlap():
    r = chunking.Recursive(size=20, overlap=8)
    text = "# One\nfirst part. " + "a b c d e f. " * 12 + "\n\n# Two\nshort"
    got = r.split(text)
    assert {h for _, h in got} == {"One", "Two"} and all("#" not in c for c, _ in got)
    assert got[-1][0].endswith("short") and got[-1][0].split()[:2] == got[-2][0].split()[-2:]
    assert all(r.tokens(c) <= 30 for c, _ in got)


def test_recursive_paragraphs_are_emitted_once():
    long = "word " * 200
    text = f"small one.\n\n{long}\n\nsmall two."
    fixed = [c for c, _ in chunking.Recursive(50, 0).split(text)]
    stale = [c for c, _ in chunking.Recursive(50, 0, stale_buffer=True).split(text)]
    assert sum("small one." in c for c in fixed) == 1 and sum("small one." in c for c in stale) == 2


@pytest.mark.parametrize("seed", range(5))
def test_recursive_loses_no_word(seed):
    rng = random.Random(seed)
    text = "\n\n".join(" ".join(rng.choice(["alpha", "beta.", "gamma!", "delta"]) for _ in range(rng.randint(1, 90))) for _ in range(6))
    joined = " ".join(c for c, _ in chunking.Recursive(40, 0).split(text))
    assert joined.split() == text.split()


def test_markdown_chunks_headers(spark):
    docs = spark.createDataFrame([(1, "# A\n\n" + "x" * 68 + "\n\n# B\n\ny")], "doc_id bigint, text string")
    heads = lambda late: [r["section_header"] for r in chunking.markdown_chunks(docs, 71, 5, late).orderBy("chunk_index").collect()]
    # The header that begins the second chunk is not the first chunk's, unless asked for.
    assert heads(False) == ["A", "B"] and heads(True) == ["B", "B"]


@pytest.mark.parametrize(("block", "kind"), [("| a | b |", "table"), ("a | b\nc | d\ne | f", "table"), ("```py\nx\n```", "code"), ("## t", "heading"), ("- a", "list"), ("3. a", "list"), ("7. a", "paragraph"), ("text", "paragraph")])
def test_block_kinds(spark, block, kind):
    assert one(spark, chunking.block_kind(F.col("b")), b=block) == kind


def test_strategies(spark):
    docs = spark.createDataFrame([(1, "word " * 400), (2, ""), (3, None)], "doc_id bigint, text string")
    for name in ("fixed", "markdown", "recursive", "no such"):
        got = chunking.create_chunks(docs, name, 100, 10)
        assert got.columns == ["doc_id", "chunk_index", "content", "section_header"] and {r[0] for r in got.collect()} == {1}


# --- retrieval


def test_fusion_by_hand(spark):
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id int, id string, rank int") for ids in (["a", "b"], ["b", "c"])]
    standard = {r["id"]: r["score"] for r in retrieval.fuse(lists).collect()}
    assert standard == {"b": round(1 / 62 + 1 / 61, 9), "a": round(1 / 61, 9), "c": round(1 / 62, 9)}
    offset = retrieval.fuse(lists, mode="offset").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in offset] == [("b", round(1 / 62 + 1 / 63, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 64, 9))]
    with pytest.raises(errors.RetrievalError):
        retrieval.fuse(lists, mode="x")


@pytest.mark.parametrize("mode", ["standard", "offset"])
@pytest.mark.parametrize("taken", [(0, 1, 2), (0, 0)])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_fusion_of_lists_that_are_dealt_by_query(spark, mode, taken, broadcast):
    """A window's lists are dealt by query already, with ids that may be null, and are used twice: a query's rows still meet."""
    each = [spark.range(400).select((F.col("id") % 16).alias("query_id"), "id", (F.col("id") * p % 101).cast("double").alias("score")) for p in (7, 31, 53)]
    lists = [retrieval.top(each[i].mapInArrow(lambda rows: rows, each[i].schema), 6 - i) for i in taken]
    want = {}
    for q in range(16):
        sums, shift = {}, 0
        for n, i in enumerate(taken):
            best = sorted(range(q, 400, 16), key=lambda x: (-(x * (7, 31, 53)[i] % 101), x))[: 6 - i]
            for rank, x in enumerate(best, 1):
                sums.setdefault(x, []).append((n, rank, 1 / (60 + rank + (shift if mode == "offset" else 0))))
            shift += len(best)
        order = sorted(sums, key=lambda x: (-round(sum(s for *_, s in sums[x]), 9), sums[x][0][:2], x))
        want |= {(q, x): (rank, round(sum(s for *_, s in sums[x]), 9)) for rank, x in enumerate(order, 1)}
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, broadcast)
    try:
        got = retrieval.fuse(lists, mode=mode).collect()
    finally:
        spark.conf.set(threshold, before)
    assert len(got) == len(want) and {(r["query_id"], r["id"]): (r["rank"], r["score"]) for r in got} == want


def test_mmr_extremes(spark):
    vecs = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.0, 1.0]}
    v = spark.createDataFrame(list(vecs.items()), "id bigint, vec array<double>")
    ranked = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.1, 3)], "query_id int, id bigint, score double, rank int")
    pick = lambda lam, k: [r["id"] for r in retrieval.mmr(ranked, v, k, lam).orderBy("place").collect()]
    assert pick(1.0, 3) == [1, 2, 3] and pick(0.3, 2) == [1, 3] and sorted(pick(0.5, 9)) == [1, 2, 3]


def test_dense_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>")
    q = v.filter("id < 7").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, retrieval.dense_topk(q, v, 5).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    assert sorted(map(tuple, retrieval.dense_topk(q, v, 5).collect())) == whole


def test_dense_odd_vectors(spark, monkeypatch):
    """Packs of any size give what each pair's own sum gives, in Spark's order, and leave out what can't be a hit."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-2.0, 0.5, 1.0, 3.0]) for _ in range(3)]) for i in range(70)]  # many ties
    rows += [(70, None), (71, [1.0, None, 2.0]), (72, [0.0] * 3), (73, []), (74, [1.0, 2.0]), (75, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(3)
    q = v.filter("id % 9 = 0 or id >= 70").withColumnRenamed("id", "query_id")
    pair = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    n, qn = norm(F.col("vec")), norm(F.col("qvec"))
    plain = v.crossJoin(q.withColumnRenamed("vec", "qvec")).select("query_id", "id", F.round(F.when((n == 0) | (qn == 0), 0.0).otherwise(pair / (n * qn)), 6).alias("score"))
    told = lambda df: sorted(map(str, df.collect()))
    for pack in (100, dense.PACK):
        monkeypatch.setattr(dense, "PACK", pack)
        assert told(retrieval.dense_scores(q, v)) == told(plain)
        for k in (1, 4, 75, 100):
            assert told(retrieval.dense_topk(q, v, k)) == told(retrieval.top(plain, k))
    met = dense.scored(dense.packs(v.filter("id < 70").coalesce(1)), dense.packs(q.filter("query_id < 70").coalesce(1), "q_"), 4)
    assert met.count() == 8 * 4
    named = v.select(F.struct(F.lit("x").alias("a"), F.col("id").alias("b")).alias("id"), "vec")
    assert retrieval.dense_topk(q, named, 4).count() == retrieval.dense_topk(q, v, 4).count()


def test_scores_on_a_roundings_edge():
    raw = np.array([0.1234565, -0.1234565, 0.1234564, 2.5e-7, -2e-7, np.nan])
    assert dense._rounded(raw, lambda e: raw[e]).tolist()[:5] == [0.123457, -0.123457, 0.123456, 0.0, 0.0]
    assert dense._rounded(np.array([0.1234565 + 1e-13]), lambda e: np.array([0.1234565 - 1e-13]))[0] == 0.123456


def test_cosine_matrix_rows(spark, sf, monkeypatch):
    """Each vector of the stated query set meets every row of the table, in blocks too."""
    vec = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in vec.items()}
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    got = {(r["query_id"], r["id"]): r["similarity"] for r in catalogue.cosine_matrix_rows(spark, sf).collect()}
    assert set(got) == {(q, i) for q in vec if q % 100 == 0 for i in vec}
    assert all(s == pytest.approx(sum(map(float.__mul__, vec[q], vec[i])) / (norm[q] * norm[i]), abs=2e-6) for (q, i), s in got.items())


@pytest.mark.parametrize("ids", ["apart", "shared", "text"])
def test_bm25_by_text(spark, monkeypatch, ids):
    """Texts scored as they are read give what joined postings give, with shared and null ids, without a shuffle of sums."""
    rng = random.Random(8)
    said = [" ".join(rng.choices("abcdefghij", [10, 8, 5, 4, 3, 2, 1, 1, 1, 1], k=rng.randint(0, 12))) for _ in range(90)] + [None, "", "A a!"]
    if ids == "shared":  # texts of one length: which of several counts is open
        said[1:30:2] = [t[::-1] for t in said[:30:2]]
    rows = [(None if i in (4, 5) and ids == "shared" or i == 5 else i // 2 if ids == "shared" and i < 30 else i, t) for i, t in enumerate(said)]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    docs = docs.withColumn("id", F.col("id").cast("string")) if ids == "text" else docs
    asked = spark.createDataFrame([(3, "a b"), (1, "j i h a"), (2, ""), (7, "zz"), (8, "c d e f g a a"), (9, None)], "query_id int, text string")
    told = lambda k: sorted(map(str, retrieval.bm25_topk(asked, docs, k).collect()))
    if ids == "apart":
        plan = retrieval.bm25_topk(asked, docs, 3)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "sum(part" not in plan
    got = {k: told(k) for k in (1, 4, 100)}
    monkeypatch.setattr(retrieval, "TERMS", 0)
    assert got == {k: told(k) for k in (1, 4, 100)}


def test_reranking_leaves_texts_where_they_are(spark, sf, monkeypatch):
    """The hits go to the documents, also where they are too many to be broadcast by their size alone."""
    monkeypatch.setattr(catalogue, "bm25_topk", lambda spark, d: spark.createDataFrame([(1, 2, 0.5, 1)], "query_id int, id bigint, score double, rank int"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.rerank_lexical(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[id#\d+L\], \[id#\d+L\]", plan)


def test_metrics_of_many_expected(spark, sf):
    """What a query expects is counted, and listed only where it was retrieved; metrics are those of whole lists."""
    cases = [([1, 2, 3], [2, 9, 3, 8]), ([1, 2], [7]), ([4, 4, 5], [4, 4, 6]), ([], [1])]
    r, e = F.col("retrieved"), F.col("expected")
    whole = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "query_id int, retrieved array<int>, expected array<int>")
    short = whole.withColumn("n_expected", F.size(F.array_distinct(e))).withColumn("expected", F.array_intersect(e, r))
    assert sorted(evaluation.all_metrics(short).collect()) == sorted(evaluation.all_metrics(whole).collect())
    made = catalogue._evaluated(spark, sf).agg(F.max(F.size("expected")), F.min("n_expected")).first()
    assert made[0] <= 10 < made[1]


def test_keyword_coverage_retrieved(spark, sf):
    """Every item's terms are sought in the contents of its hits."""
    text = {r["doc_id"]: r["text"].lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hits = {}
    for r in catalogue.bm25_topk(spark, sf).collect():
        hits.setdefault(r["query_id"], []).append(text[r["id"]])
    want = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = set(re.findall(r"\w+", r["text"].lower()))
        want[r["item_id"]] = (len(hits.get(r["item_id"], [])), round(sum(any(w in t for t in hits.get(r["item_id"], [])) for w in words) / len(words), 6))
    assert {r["item_id"]: (r["n_hits"], r["coverage"]) for r in catalogue.keyword_coverage_retrieved(spark, sf).collect()} == want


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id bigint, t string")
    got = {r["id"]: r["v"] for r in embedding.embed(rows, "t", "v", embedding.embedder("hash", dim=16), 16).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    with pytest.raises(errors.ConfigError):
        embedding.embedder("nope")
    q = spark.createDataFrame([(1, "who")], "query_id int, text string")
    out = embedding.expand(q, lambda t: F.lit(" "), lambda t: F.lit("x\n\n y \nz\nw"))
    assert [r["text"] for r in out.orderBy("variant").collect()] == ["who", "x", "y", "z"]


# --- answers


@pytest.mark.parametrize(("said", "want"), [("", True), ("  ", True), ("INSUFFICIENT_CONTEXT", True), ("insufficient_context: none", True), ("x" * 200 + " INSUFFICIENT_CONTEXT", False), ("fine", False)])
def test_refusal(spark, said, want):
    assert one(spark, answers.is_refusal(F.col("s")), s=said) is want


def test_citations(spark):
    assert one(spark, answers.valid_citations(F.col("s"), F.lit(3)), s="a [2] b [9] c [1][2]") == [2, 1]
    assert one(spark, answers.without_invalid(F.col("s"), F.lit(3)), s="a [2] b [9] c  [1]") == "a [2] b c [1]"
    assert one(spark, answers.without_invalid(F.col("s"), F.lit(3)), s="a  [2]") == "a  [2]"
    assert one(spark, answers.confidence(F.col("s")), s="One [1]. Two. Three [2]! Four?") == 0.5


def test_packing_budget(spark):
    hits = spark.createDataFrame([(1, r, f"s{r}", "x" * 300) for r in (1, 2, 3)], "query_id int, rank int, source string, content string")
    row = answers.pack_context(hits, 500).first()
    assert row["n_used"] == 2 and row["context"].endswith("[truncated]") and "[3]" not in row["context"]
    assert answers.pack_context(hits, 5000).first()["n_used"] == 3


# --- metrics


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"], ["a", "z"]), (2, [], ["a"]), (3, ["q"], [])], "query_id int, retrieved array<string>, expected array<string>")
    got = {r["query_id"]: r for r in evaluation.all_metrics(df, (3,)).collect()}
    assert (got[1]["recall_3"], got[1]["precision_3"], got[1]["hit_3"], got[1]["mrr"]) == (0.5, round(2 / 3, 6), 1.0, 1.0)
    assert all(got[i][m] == 0 for i in (2, 3) for m in ("recall_3", "precision_3", "hit_3", "mrr", "ndcg_3"))
    assert one(spark, evaluation.keyword_coverage(F.col("c"), F.col("k")), c="Hello World", k=["hello", "moon"]) == 0.5
    assert one(spark, evaluation.keyword_coverage(F.col("c"), F.array().cast("array<string>")), c="x") == 1.0


# --- filters and metadata


@pytest.mark.parametrize(
    ("said", "want"),
    [('{"lang": "de"}', ({"lang": "de"}, 0.6)), ('{"lang": "de", "bad": 1}\nwhy', ({"lang": "de"}, 0.56)), ("[1]", ({}, 0.2)), ('I think {"lang": "fr"} fits', ({"lang": "fr"}, 0.5)), ("none", ({}, 0.1)), ("{broken", ({}, 0.1))],
)
def test_read_answer(said, want):
    assert filters.read_answer(said, {"lang"})[:2] == want


def test_filter_fields(spark):
    df = spark.createDataFrame([("A", ["X"], 1), ("b", ["y", "Z"], 2)], "source string, topics array<string>, n int")
    ask = lambda f: df.filter(filters.build(df, f)).count()
    assert ask({"topics": "x"}) == 1 and ask({"topics": ["Y", "x"]}) == 2 and ask({"n": [2, 3]}) == 1 and ask({"nope": 1}) == 0 and ask(None) == 2
    assert filters.field_types(df) == {"topics": "list", "n": "integer"} and filters.parse_arguments('{"a": 1}') == {"a": 1} == filters.parse_arguments({"a": 1}) and filters.parse_arguments("x") == {}
    with pytest.raises(ValueError):
        filters.match_source(F.lit("a"), F.lit("a"), "nope")


def test_model_answers(spark):
    assert one(spark, metadata.topics(F.col("s")), s='```json\n["a","b","c","d","e","f"]\n```') == ["a", "b", "c", "d", "e"]
    assert one(spark, metadata.topics(F.col("s")), s="no list") == []
    assert one(spark, metadata.entities(F.col("s")), s='{"people": ["x"]}') == {"people": ["x"]}
    assert one(spark, metadata.entities(F.col("s")), s='{"people": ["A", "B"], "note": "x", "dates": [], "n": 1}') == {"people": ["A", "B"], "dates": []}
    assert [one(spark, metadata.entities(F.col("s")), s=s) for s in ("", "no json", "[1]", "null")] == [{}] * 4
    assert one(spark, metadata.doc_type(F.col("s")), s="This is an Invoice.") == "invoice"


# --- status, sync


def test_transitions():
    sync.check_transition(None, "processing")
    sync.check_transition("done", "pending")
    with pytest.raises(errors.SyncError):
        sync.check_transition("done", "failed")


def test_retry_policy(spark):
    ask = lambda e, m, n: one(spark, sync.should_retry(F.lit(e), F.lit(m), F.lit(n)))
    assert ask("StorageError", "", 0) and not ask("CorruptedDocumentError", "timeout", 0) and ask("X", "HTTP 504", 3) and not ask("X", "timeout", 4) and not ask("X", "bad", 0)
    assert [one(spark, sync.backoff_s(F.lit(i))) for i in range(6)] == [60, 300, 1800, 7200, 7200, 7200]


# --- configuration, sources, conversion


def test_settings(monkeypatch):
    monkeypatch.setenv("A", "${B}")
    monkeypatch.setenv("B", "7")
    assert config.Settings.load({"top": {"k": "${A}"}, "rrf_mode": "offset"}).top_k == 7
    for bad in ({"nope": 1}, {"top_k": "x"}):
        with pytest.raises(errors.ConfigError):
            config.Settings.load(bad)


def test_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.MD", "b.txt", "in/c.md", "d"):
        (tmp_path / name).write_text(name)
    names = lambda **x: sorted(r["name"] for r in files.listing(spark, "local", path=str(tmp_path), **x).collect())
    assert names(extensions=["md"]) == ["a.MD", "c.md"] and names(recursive=False) == ["a.MD", "b.txt", "d"] and files.kinds() == ["local", "s3", "table"]
    hashed = files.with_hash(files.listing(spark, "local", path=str(tmp_path), extensions=[".txt"])).first()
    import hashlib

    assert hashed["content_hash"] == hashlib.sha256(b"b.txt").hexdigest()
    for bad in (lambda: files.listing(spark, "ftp"), lambda: files.listing(spark, "local", path=str(tmp_path / "none")).count()):
        with pytest.raises(errors.SourceError):
            bad()


def test_datasets(spark, tmp_path):
    rows = datasets.from_json(spark, json.dumps({"queries": [{"query": "q", "expected": "s", "category": "c"}, {"query": "r", "expected_sources": ["a", "b"]}]}))
    assert [tuple(r)[:2] for r in rows.collect()] == [("q", ["s"]), ("r", ["a", "b"])]
    datasets.save(rows, str(tmp_path / "d"))
    assert sorted(map(tuple, datasets.from_jsonl(spark, str(tmp_path / "d")).select("query", "expected").collect())) == [("q", ["s"]), ("r", ["a", "b"])]
    assert {tuple(r) for r in datasets.counts(rows).collect()} == {("c", "unknown", 1), ("uncategorized", "unknown", 1)}
    (tmp_path / "x.xml").write_text('<e><qa_pair category="k" expected_sources="a, b"><question>Q?</question><answer>A</answer></qa_pair></e>')
    x = datasets.from_xml(spark, str(tmp_path / "x.xml")).first()
    assert (x["query"], x["expected"], x["keywords"], x["category"]) == ("Q?", ["a", "b"], ["A"], "k")
    for bad in ("{}", '[{"query": "q"}]', '[{"expected": "s"}]'):
        with pytest.raises(errors.ConfigError):
            datasets.from_json(spark, bad)


def test_html_without_end_tags():
    for page, want in {"<html><head><title>t</title><body><p>hello world</p></body></html>": "hello world", "<head><meta a=b>plain": "plain", "<template>x<p>y": "x\n\ny", "<p>a<noscript>no": "a", "<head>\n<script>s</script>\n<p>q": "q"}.items():
        assert convert.markdown(page) == want


def test_html():
    got = convert.markdown("<head><title>t</title></head><h2>A &amp; b</h2><p>x <b>y</b><script>no</script></p><ul><li>i<li>j</ul><a href='/u'>l</a>")
    assert got == "## A & b\n\nx y\n\n- i\n\n- j\n\n[l](/u)" and convert.markdown(None) == ""


# --- store and streams


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), config.Settings(chunk_size=64, chunk_overlap=0))
    text = lambda w: " ".join(f"{w} sentence number {i} about {w}." for i in range(30))
    c.ingest(docs_of(spark, [(1, "a", text("apples")), (2, "b", text("boats"))]))
    n = c.chunks().count()
    c.ingest(docs_of(spark, [(1, "a", text("apples"))]))
    assert c.chunks().count() == n
    c.ingest(docs_of(spark, [(1, "a", text("anchors"))]))
    assert "apples" not in " ".join(r["content"] for r in c.chunks().collect())
    q = spark.createDataFrame([(1, "boats sentence"), (2, "anchors")], "query_id int, text string")
    for mode in ("hybrid", "similarity", "mmr"):
        best = {r["query_id"]: r["source"] for r in c.search(q, mode, 3).filter("rank = 1").collect()}
        assert best[2] == "a" and best[1] == "b", mode
    assert {r["source"] for r in c.search(q, source="b").collect()} == {"b"}
    assert [r["source"] for r in c.documents().collect()] and c.delete(spark.createDataFrame([("b",)], "source string")) > 0
    assert {r["source"] for r in c.chunks().collect()} == {"a"} and c.delete(spark.createDataFrame([("zz",)], "source string")) == 0


def test_streams(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    text = "Some sentence that is long enough to make a chunk of its own."
    docs_of(spark, [(1, "a", text)]).write.parquet(str(tmp_path / "in"))
    for more in ([], [(2, "b", text + " More.")]):
        if more:
            docs_of(spark, more).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest_files(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination()
    assert {r["source"] for r in c.chunks().collect()} == {"a", "b"}


def test_status_stream(spark, tmp_path):
    rows = [(1, 1, "processing"), (1, 2, "done"), (1, 3, "failed"), (2, 4, "processing")]
    spark.createDataFrame(rows, "source bigint, event_id bigint, status string").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("source bigint, event_id bigint, status string").parquet(str(tmp_path / "e"))
    q = jobs.track_status(events).writeStream.format("memory").queryName("status_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("status_out").collect()} == {(1, "done", 2, 1), (2, "processing", 1, 0)}


def test_windows_agree_with_batch(spark, sf, tmp_path):
    os.symlink(f"{sf}/events.parquet", tmp_path / "events.parquet")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path))
    q = jobs.windowed(events).writeStream.format("memory").queryName("win_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    from lodestone.plans.catalogue import hourly_events

    assert spark.table("win_out").count() == hourly_events(spark, sf).count()
