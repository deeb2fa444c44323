"""The pipeline's stages and result against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_jaccard import brute
from test_native import base_quality, base_spans
from test_records import check_packing, plain

from lodestone.llm import mixing, quality, secrets


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        if name != "pack":
            assert docs.columns == columns
    before, after = seen["quality"]
    failed = {r["doc_id"] for r in before if base_quality(r["text"])[-1]}
    kept = {r["doc_id"] for r in after}
    assert not failed & kept
    text, lines = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["text"] for r in quality.clean_text(spark.createDataFrame(before)).collect()}
    assert all(r["text"] == lines[r["doc_id"]] for r in after) and any(lines[i] != text[i] for i in kept)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert {i for i, q in labels.items() if q == 1} - failed <= kept and not {i for i, q in labels.items() if q == 0} & kept
    before, after = seen["near_duplicates"]
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in brute([(r["doc_id"], r["text"]) for r in before])})
    before, after = seen["secrets"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before)
    for r in before:
        spans = base_spans(r["text"])
        assert (text[r["doc_id"]] == r["text"]) == (not spans) and not base_spans(text[r["doc_id"]])
    before, after = seen["mix"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.takes(spark.createDataFrame(before)).collect()}
    assert Counter(r["doc_id"] for r in after) == Counter({i: n for i, n in plan.items() if n})
    before, after = seen["pack"]
    ids, want = plain(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in before:
        want[r["doc_id"]].append([*ids(r["text"]), 1])
    check_packing(after, want, 2048)


def test_defined_results(spark, hard_docs, clashing_docs, no_docs):
    """Each stage by itself on nulls, empty and very long texts, ties, repeated rows, clashing columns and no rows."""
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, None).collect() == []
        got, more = stage(spark, hard_docs, None), stage(spark, clashing_docs, None)
        if name == "pack":
            digest = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.filter("start = 0").collect() if r["length"] == r["doc_tokens"])
            assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in hard_docs.collect()} and digest(got) and digest(more)
            continue
        assert got.columns == hard_docs.columns and more.columns == clashing_docs.columns
        rows = Counter(got.collect())
        assert Counter(more.select(*hard_docs.columns).collect()) == rows
        assert {x for r in more.collect() for x in tuple(r)[5:]} <= {"theirs"}
        ids = Counter(r["doc_id"] for r in rows.elements())
        if name == "quality":
            assert not {1, 2, 8, 12} & set(ids)  # no or few words
        elif name == "near_duplicates":
            assert ids == Counter([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 14])
        elif name == "secrets":
            assert sum(ids.values()) == hard_docs.count() and ids[None] == 1 and ids[4] == 2
        else:
            assert all(n <= 3 * (1 + (i == 4)) for i, n in ids.items())


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    again = corpus_pipeline.run(spark, sf).collect()
    digest = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert rows and digest(rows) == digest(again)
    assert secrets.REDACTED and corpus_pipeline.ORACLE_SQL is None
