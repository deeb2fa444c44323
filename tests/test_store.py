"""Versions and buckets of a collection, files of all kinds, paths, expansion, keywords and chunks by brute force."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import api, config
from lodestone.errors import StorageError
from lodestone.functions import text as T
from lodestone.operators import chunking, embedding, metadata, store
from lodestone.operators.store import Collection

DOCS = "doc_id bigint, source string, text string"


def said(word):
    return " ".join(f"{word} sentence number {i} about {word}." for i in range(12))


def docs(spark, *words):
    return spark.createDataFrame([(i, w, said(w)) for i, w in enumerate(words)], DOCS)


def held(c):
    return {(r["source"], r["content"].split()[0]) for r in c.chunks().collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_increments_are_merged_when_read(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    assert c.chunks().count() == 0 and c.delete(docs(spark, "a")) == 0 and c._latest() == (0, [])
    words = [f"w{i}" for i in range(12)]
    c.ingest(docs(spark, *words))
    first = c._latest()[1][0]
    before = {f: os.path.getmtime(f"{first['chunks']}/{f}") for f in os.listdir(first["chunks"])}
    c.ingest(docs(spark, "w0", "new").withColumn("text", F.lit(said("changed"))))
    version, segments = c._latest()
    assert version == 2 and segments[0] == first and {f: os.path.getmtime(f"{first['chunks']}/{f}") for f in os.listdir(first["chunks"])} == before
    assert size(segments[1]["chunks"]) < size(first["chunks"]) + 4000 and {r["source"] for r in spark.read.parquet(segments[1]["sources"]).collect()} == {"w0", "new"}
    assert held(c) == {(w, w) for w in words[1:]} | {("w0", "changed"), ("new", "changed")}
    c.ingest(docs(spark, "w1").filter("false"))
    assert c._latest()[0] == version
    assert c.delete(docs(spark, "w2", "w0", "nowhere")) > 0
    c.ingest(docs(spark, "w2"))  # again, after it was deleted
    want = {(w, w) for w in words[1:]} | {("new", "changed")}
    assert held(c) == want
    assert c.compact() == 4 and len(c._latest()[1]) == 1 and held(c) == want and c.compact() == 0
    c.delete(docs(spark, *words, "new"))
    assert c.chunks().count() == 0
    assert c.vacuum(keep=1, hours=0) >= 3 and held(c) == set()


def test_word_index_of_the_collection(spark, tmp_path, monkeypatch):
    """A search by the index finds what one by the chunks finds, after increments, deletions and a compaction."""
    c = Collection(spark, str(tmp_path / "c"), config.Settings(store_buckets=4))
    asked = spark.createDataFrame([(1, "tea sentence"), (2, "about coffee number 3"), (3, "gone")], "query_id int, text string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "rank").collect()))
    scanned = lambda: rows(store.retrieval.bm25_topk(asked, c.chunks().select("id", F.col("content").alias("text")), 30))
    assert c.index() == 0
    c.ingest(docs(spark, "tea", "coffee", "milk", "gone"))
    assert c.index() == 1 and rows(c._word_list(asked, c.chunks(), False)) == scanned()
    c.delete(docs(spark, "gone"))
    c.ingest(docs(spark, "milk").withColumn("text", F.lit(said("tea and coffee"))))
    monkeypatch.setattr(store.InvertedIndex, "search", lambda *a: pytest.fail("an index of another version"))
    assert rows(c._word_list(asked, c.chunks(), False)) == scanned()
    monkeypatch.undo()
    assert c.index() == 3 == c._indexed() and c.index() == 3
    got = c._word_list(asked, c.chunks(), False)
    assert {i for _, i, _ in rows(got)} == {i for _, i, _ in scanned()} and got.filter("query_id = 3").count() == 0
    c.compact()
    assert c.index() == 4 and rows(c._word_list(asked, c.chunks(), False)) == scanned()
    assert {r["source"] for r in c.search(asked.filter("query_id = 2"), "hybrid", 1, rerank=False).collect()} <= {"coffee", "milk"}


def test_many_increments_are_compacted(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), config.Settings(store_segments=3))
    for i in range(5):
        c.ingest(docs(spark, f"w{i}"))
    assert len(c._latest()[1]) <= 3 and {s for s, _ in held(c)} == {f"w{i}" for i in range(5)}


def test_two_writers(spark, tmp_path):
    """Segments of both count, in the order of their manifests; a compaction leaves what came meanwhile behind it."""
    c, other = Collection(spark, str(tmp_path / "c")), Collection(spark, str(tmp_path / "c"))
    c.ingest(docs(spark, "a", "b", "e"))
    stale = c._latest()
    other.delete(docs(spark, "b"))
    calls = []
    c._latest = lambda: calls.append(1) or (stale if len(calls) == 1 else other._latest())  # read before the other wrote
    c._commit(lambda segments: [*segments])
    assert len(calls) > 1 and {s for s, _ in held(other)} == {"a", "e"}
    taken = other._latest()[1]
    first = Collection(spark, str(tmp_path / "c"))
    first._commit, commit = (lambda change: other.ingest(docs(spark, "late")) or commit(change)), first._commit
    assert first.compact() == len(taken) and {s for s, _ in held(other)} == {"a", "e", "late"}
    first._commit = lambda change: (other.compact(), commit(change))[1]
    with pytest.raises(StorageError):
        first.compact()


def test_a_writer_that_died(spark, tmp_path, monkeypatch):
    """A manifest without content stops nobody once its time is over."""
    c = Collection(spark, str(tmp_path / "c"))
    c.ingest(docs(spark, "a"))
    for name in ("000000000002.json", "000000000003.json"):
        (tmp_path / "c/versions" / name).write_text("")
    assert held(c) == {("a", "a")}
    monkeypatch.setattr(store, "GRACE", 0)
    c.ingest(docs(spark, "b"))
    assert c._latest()[0] == 4 and held(c) == {("a", "a"), ("b", "b")}


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in {"u.txt": said("tea").encode(), "l.txt": (said("café")).encode("latin-1"), "p.pdf": b"%PDF-1.4 \xff\x00\xfe" * 3, "w.docx": b"PK\x03\x04\xff", "none": said("plain").encode(), "e.txt": b""}.items():
        (tmp_path / "in" / name).write_bytes(content)
    e = api.Engine(spark, str(tmp_path / "c"))
    e.ingest_files(str(tmp_path / "in"))
    names = lambda rows: {r["source"].rsplit("/", 1)[1] for r in rows}
    assert names(e.collection.chunks().collect()) == {"u.txt", "l.txt", "none"}
    assert any("café" in r["content"] for r in e.collection.chunks().collect())
    assert {(r["source"].rsplit("/", 1)[1], r["problem"]) for r in e.unread(str(tmp_path / "in")).collect()} == {("p.pdf", "needs_ocr"), ("w.docx", "no converter")}
    full = api.Engine(spark, str(tmp_path / "d"), convert=lambda c, n: F.when(n.endswith("docx"), F.lit(said("word"))), ocr=lambda c: F.lit(said("scan")))
    full.ingest_files(str(tmp_path / "in"))
    assert names(full.collection.chunks().collect()) == {"u.txt", "l.txt", "none", "p.pdf", "w.docx"}
    # A file that is as it was is not read. Without the converter a changed one is unread, and what is stored of it stays.
    bare = api.Engine(spark, str(tmp_path / "d"))
    assert {r["action"] for r in bare.sync(str(tmp_path / "in"), dry_run=True).collect() if not r["source"].endswith("e.txt")} == {"unchanged"}
    for name in ("p.pdf", "w.docx"):
        os.utime(tmp_path / "in" / name, (1_800_000_000, 1_800_000_000))
    actions = {r["source"].rsplit("/", 1)[1]: r["action"] for r in bare.sync(str(tmp_path / "in")).collect()}
    assert actions["p.pdf"] == actions["w.docx"] == "unread" and actions["u.txt"] == "unchanged"
    assert "p.pdf" in names(bare.collection.chunks().collect())


def test_path_forms(spark, tmp_path):
    forms = ["/d/a.md", "file:/d/a.md", "file:///d/a.md", "\\d\\a.md", "/d//./a.md", "https://x.y/a//b", None]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "p string").select(T.canonical_path(F.col("p"))).collect()]
    assert got == ["/d/a.md"] * 5 + ["https://x.y/a//b", None]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(said("apples"))
    e = api.Engine(spark, str(tmp_path / "c"))
    e.ingest_texts(spark.createDataFrame([(1, f"file://{tmp_path}/in/a.md", said("old apples"))], DOCS))
    assert [r["action"] for r in e.sync(str(tmp_path / "in")).collect()] == ["update"]
    assert {r["source"] for r in e.documents().collect()} == {f"{tmp_path}/in/a.md"}


def test_expansion(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.ingest(docs(spark, "boats", "forests", "engines"))
    q = spark.createDataFrame([(1, "zzz unknown"), (2, "boats sentence")], "query_id int, text string")
    e = embedding.Expansion(rewrite=lambda p: F.lit(" "), hyde=lambda p: F.when(p.contains("zzz"), F.lit(said("forests"))), paraphrase=lambda p: F.when(p.contains("zzz"), F.lit("engines sentence\nforests about")))
    rows = {(r["query_id"], r["list"]): r["text"] for r in embedding.variants(q, e).collect()}
    assert set(rows) == {(1, 0), (1, 2), (1, 3), (1, 4), (2, 0)} and rows[1, 0] == "zzz unknown" and rows[1, 4] == "forests about"
    first = lambda **o: {r["query_id"]: r["source"] for r in c.search(q, "hybrid", 3, rerank=False, **o).filter("rank = 1").collect()}
    assert first(expansion=e)[1] == "forests" and first(expansion=e)[2] == "boats" == first()[2]
    again = c.search(q, "similarity", 1, expansion=embedding.Expansion(rewrite=lambda p: F.lit("engines sentence")), rerank=False)
    assert {r["source"] for r in again.collect()} == {"engines"}


def test_keywords_by_brute_force(spark):
    texts = ["", None, "tiny a1b2 words_x", "Beta alpha beta ALPHA gamma http://omega.example/omega x@omega.org", "```\ncode code code\n``` outside naïve İstanbul", "word " * 30_000 + "other " * 29_999, "that with from"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["keywords"] for r in metadata.keywords(rows.withColumn("keywords", F.lit(1))).collect()}
    want = {}
    for i, t in enumerate(texts):
        t = re.sub(T.EMAIL, " ", re.sub(T.URL, " ", re.sub(r"(?s)```.*?```", " ", t or ""))).lower()
        words = [w for w in re.split(r"[^\w]+", t) if re.fullmatch("[a-z]{4,}", w) and w not in config.STOPWORDS]
        order = sorted(Counter(words).items(), key=lambda x: (-x[1], words.index(x[0])))
        if order:
            want[i] = [w for w, _ in order[:10]]
    assert got == want and got[3][:2] == ["beta", "alpha"] and metadata.keywords(rows.filter("false")).count() == 0


@pytest.mark.parametrize("late", [False, True])
def test_markdown_chunks_by_brute_force(spark, late):
    """One pass packs blocks as a plain loop over them does, on headings, long blocks, empty and very long texts."""
    many = "\n\n".join(f"# Part {i}" if i % 7 == 3 else f"block {i} " + "x" * (i * 37 % 90) for i in range(3000))
    texts = ["", None, " \n\n ", "one", "# H\n\na\n\n## I ##\n\n" + "b" * 300, many]

    def plain(text, size, overlap):
        out, cur, chars, head = [], [], 0, ""
        for b in [x.strip() for x in (text or "").split("\n\n") if x.strip()]:
            new = re.sub("^#+", "", b).strip() if b.startswith("#") else head
            if cur and chars + len(b) > size:
                out.append(("\n\n".join(cur), new if late else head))
                tail = cur[-1][-overlap:]
                cur, chars = [tail], len(tail)
            cur, chars, head = [*cur, b], chars + len(b), new
        return out + ([("\n\n".join(cur), head)] if cur else [])

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = chunking.markdown_chunks(rows, 200, 20, late).collect()
    for i, t in enumerate(texts):
        assert [(r["content"], r["section_header"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["chunk_index"])] == plain(t, 200, 20)
