"""The engine's tools end to end, converters' answers, contexts, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import api, cli
from lodestone.errors import EngineError, RetrievalError, StorageError
from lodestone.operators import chunking, conversion, layout
from lodestone.sources import datasets


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/boats.md").write_text("# Boats\n\nBoats float on the water and carry people across rivers.")
    (tmp_path / "in/trees.html").write_text("<h1>Trees</h1><p>Trees grow in the forest and carry leaves in summer.</p>")
    return tmp_path


def test_tools(spark, folder):
    e = api.Engine(spark, str(folder / "c"), ask=lambda q, c: F.concat(F.lit("It says so [1]. "), F.substring(c, 1, 5)))
    assert e.ingest_files(str(folder / "in")) >= 2
    hits = e.query(["boats on the water", "leaves in the forest"], top_k=1).collect()
    assert {h["query_id"]: h["source"].rsplit("/", 1)[1] for h in hits} == {0: "boats.md", 1: "trees.html"}
    said = e.answer(["boats on the water"], top_k=2).first()
    assert said["citations"] == [1] and not said["refused"] and said["sources"]
    assert "### 1. " in api.markdown(e.query(["boats on the water"])).first()["markdown"]
    golden = datasets.from_json(spark, json.dumps([{"query": "boats on the water", "expected": "BOATS.md"}, {"query": "forest leaves", "expected": ["trees.html"]}]))
    assert {r["hit_2"] for r in e.evaluate(golden, 2).collect()} == {1.0}
    swept = e.sweep(golden, [{"name": "base", "top_k": 1}, {"name": "dense", "top_k": 2, "mode": "similarity"}]).collect()
    assert [r["name"] for r in swept] == ["base", "dense"] and swept[0]["hit_delta"] == 0
    assert e.stats().first()["sources"] == 2 and {"language", "source_name"} & {r["field"] for r in e.filter_context().collect()}
    (folder / "in/boats.md").unlink()
    (folder / "in/cars.md").write_text("Cars drive on the road and need a lot of fuel for that.")
    actions = {r["source"].rsplit("/", 1)[1]: r["action"] for r in e.sync(str(folder / "in"), dry_run=True).collect()}
    assert actions == {"boats.md": "delete", "cars.md": "ingest", "trees.html": "unchanged"}
    e.sync(str(folder / "in"))
    assert {r["source"].rsplit("/", 1)[1] for r in e.documents().collect()} == {"cars.md", "trees.html"}
    for bad in (lambda: e.query(["ok ok"], mode="x"), lambda: e.query(["x"]), lambda: e.query(["ok"], top_k=0)):
        with pytest.raises(RetrievalError):
            bad()
    with pytest.raises(EngineError):
        api.Engine(spark, str(folder / "c")).answer(["boats"])


def test_sync_reads_what_changed_and_keeps_records(spark, folder, monkeypatch):
    e = api.Engine(spark, str(folder / "c"))
    name = lambda rows: {r["source"].rsplit("/", 1)[1]: r for r in rows}
    e.ingest_files(str(folder / "in"))
    records = name(e.status.records().collect())
    assert {n: (r["status"], r["chunks"] > 0) for n, r in records.items()} == {"boats.md": ("done", True), "trees.html": ("done", True)}
    read, texts = [], e._texts
    monkeypatch.setattr(e, "_texts", lambda listing: read.append(sorted(r["name"] for r in listing.select("name").collect())) or texts(listing))
    (folder / "in/boats.md").write_text("# Boats\n\nBoats float on the lake and carry goods.")
    (folder / "in/scan.pdf").write_bytes(b"%PDF-1.4 \xff\x00")
    actions = {n: r["action"] for n, r in name(e.sync(str(folder / "in"), retries=2, backoff_s=0).collect()).items()}
    assert read == [["boats.md", "scan.pdf"]] and actions == {"boats.md": "update", "scan.pdf": "unread", "trees.html": "unchanged"}
    records = name(e.status.records().collect())
    assert records["boats.md"]["status"] == "done" and (records["scan.pdf"]["status"], records["scan.pdf"]["attempts"], records["scan.pdf"]["error"]) == ("retry", 1, "needs_ocr")
    # The retry is due at once, and the file has become readable by then.
    e.ocr = lambda content: F.lit("Scanned pages speak of mills and of water wheels. " * 3)
    actions = {n: r["action"] for n, r in name(e.sync(str(folder / "in")).collect()).items()}
    assert actions["scan.pdf"] == "ingest" and name(e.status.records().collect())["scan.pdf"]["status"] == "done"
    (folder / "in/trees.html").unlink()
    e.sync(str(folder / "in"))
    gone = name(e.status.records().collect())["trees.html"]
    assert (gone["status"], gone["stage"]) == ("skipped", "Deleting") and "trees.html" not in name(e.documents().collect())


def test_a_failed_ingest_is_recorded(spark, folder, monkeypatch):
    e = api.Engine(spark, str(folder / "c"))
    docs = spark.createDataFrame([(1, "a", "Mills turn by the water of the river, day and night.")], "doc_id bigint, source string, text string")
    ingest = e.collection.ingest
    monkeypatch.setattr(e.collection, "ingest", lambda docs: (_ for _ in ()).throw(RuntimeError("disk full")))
    with pytest.raises(RuntimeError):
        e.ingest_texts(docs)
    assert e.status.records().first()["status"] in ("failed", "retry") and "disk full" in e.status.records().first()["error"]
    monkeypatch.setattr(e.collection, "ingest", ingest)
    assert e.ingest_texts(docs) == 1 and e.status.records().first()["status"] == "done"


def test_results_have_the_chunks_metadata(spark, folder):
    told = lambda p: F.when(p.contains("For each chunk"), F.lit('[{"entities": {"people": ["Ann"], "dates": ["2024"]}, "topics": ["rivers"], "doc_type": "report"}]'))
    e = api.Engine(spark, str(folder / "c"), extract=told)
    e.ingest_files(str(folder / "in"), ["md"])
    for mode in ("hybrid", "similarity", "mmr"):
        hit = e.query(["boats on the water"], mode, 3).first()
        assert hit["topics"] == ["rivers"] and hit["doc_type"] == "report" and hit["entities"]["people"] == ["Ann"] and hit["dates"] == ["2024"] and hit["structural"]["word_count"] > 5
        assert hit["dense_score"] > 0 and (hit["sparse_score"] > 0) == (mode == "hybrid") and "boats" in hit["keywords"]
    c = e.collection
    asked = spark.createDataFrame([(1, "boats on the water")], "query_id int, text string")
    scores = [c.search(asked, "similarity", 1, contextual=x).first()["score"] for x in (True, False, None)]
    assert scores[2] == scores[0]
    assert api.Engine(spark, str(folder / "c")).query(["boats"], where={"topics": "rivers"}).count() == 1


def test_chunks_made_elsewhere(spark, folder):
    e = api.Engine(spark, str(folder / "c"))
    chunks = spark.createDataFrame([("s", 1, "second chunk with words enough in it", None), ("s", 0, "first chunk with words enough in it", "Head"), ("s", 2, "short", "")], "source string, chunk_index int, content string, section_header string")
    texts = spark.createDataFrame([("s", "first second")], "source string, text string")
    e.collection.ingest_chunks(chunks, texts)
    got = e.collection.chunks().orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["total_chunks"], r["section_header"]) for r in got] == [(0, 2, "Head"), (1, 2, "")] and got[0]["content"] == "[Context: Head] first chunk with words enough in it"
    with pytest.raises(StorageError):
        e.collection.ingest_chunks(chunks, spark.createDataFrame([("s", "x"), ("none", "x")], "source string, text string"))


def test_urls_batches_and_services(spark, folder):
    pages = {"https://x.y/mills.html": "<h1>Mills</h1><p>Mills turn by the water of the river, day and night.</p>", "https://x.y/bare.html": "<p> </p>"}
    fetch = lambda u: F.coalesce(*[F.when(u == k, F.lit(v)) for k, v in pages.items()])
    e = api.Engine(spark, str(folder / "c"), fetch=fetch, chat=lambda p: F.when(p.contains("- language: en"), F.lit('{"language": "en", "nothing": 1} as asked')))
    assert {r["source"]: r["problem"] for r in e.ingest_urls([*pages, "https://x.y/gone"]).collect()} == {"https://x.y/mills.html": None, "https://x.y/bare.html": "empty", "https://x.y/gone": "unreachable"}
    items = [str(folder / "in/boats.md"), str(folder / "none"), "https://x.y/mills.html", "https://x.y/gone"]
    got = {r["item"]: (r["status"], r["error"]) for r in e.ingest_batch(items).collect()}
    assert [got[i][0] for i in items] == ["completed", "failed", "completed", "failed"] and got[items[3]][1] == "unreachable" and "none" in got[items[1]][1]
    (folder / "none").mkdir()
    (folder / "none/late.md").write_text("Late pages speak of the harvest and of the barns.")
    again = {r["item"]: r["status"] for r in e.ingest_batch(items).collect()}
    assert [again[i] for i in items] == ["completed", "completed", "completed", "failed"]
    assert {r["source"].rsplit("/", 1)[1] for r in e.documents().collect()} == {"mills.html", "boats.md", "late.md"}
    counts, records = e.processing_status("done")
    assert counts["total"] == counts["done"] == records.count() == 3
    services = e.service_status()
    assert services["collection"]["healthy"] and services["chat"]["healthy"] and services["ocr"] == {"healthy": False, "error": "none given", "latency_ms": services["ocr"]["latency_ms"]}
    assert e.extract_filters("English texts")["filters"] == {"language": "en"}
    for bad in (lambda: api.Engine(spark, str(folder / "c")).ingest_urls(["https://x.y"]), lambda: api.Engine(spark, str(folder / "c")).extract_filters("x")):
        with pytest.raises(EngineError):
            bad()


def test_results_are_kept_for_a_time(spark, folder, monkeypatch):
    e = api.Engine(spark, str(folder / "c"))
    e.ingest_files(str(folder / "in"))
    calls, search = [], e.collection.search
    monkeypatch.setattr(e.collection, "search", lambda *a, **k: calls.append(1) or search(*a, **k))
    for _ in range(2):
        e.query(["boats on the water"]).count()
    assert len(calls) == 1
    monkeypatch.setattr(api, "TTL_S", -1)
    e.query(["boats on the water"]).count()
    assert len(calls) == 2


def test_hybrid_chunks_and_their_fallback(spark, folder):
    text = "# A\n\nIntro words that stand under the first header.\n\n## B\n\n" + "| a | b |\n| c | d |\n| e | f | g h i j k l m n o p" + "\n\n# C\n\n## D\n\nWords under the last one of them, and a few more."
    chunker = lambda t: F.when(t.startswith("served"), F.lit(json.dumps({"chunks": [{"text": "a chunk that was served with words", "headings": ["H"]}]})))
    docs = spark.createDataFrame([(1, "one", text), (2, "two", "served"), (3, "three", None)], "doc_id bigint, source string, text string")
    got = {(r["doc_id"], r["chunk_index"]): (r["content"].split()[0], r["section_header"]) for r in chunking.create_chunks(docs, "hybrid", chunker=chunker).collect()}
    assert got == {(1, 0): ("Intro", "A"), (1, 1): ("|", "A > B"), (1, 2): ("Words", "C > D"), (2, 0): ("a", "H")}
    assert chunking.create_chunks(docs, "layout").filter("doc_id = 2").count() == 0
    from lodestone.config import Settings

    e = api.Engine(spark, str(folder / "c"), Settings(chunk_strategy="hybrid"), chunker=chunker)
    assert e.ingest_texts(docs.filter("doc_id < 3")) == 4
    last = layout.packed(layout.elements(spark.createDataFrame([(1, "# A\n\n## B\n\n# C"), (2, "pre\n\n" + "x" * 30 + "\n\n" + "y" * 30)], "doc_id bigint, text string")), 20).orderBy("doc_id", "chunk_index").collect()
    assert [(r["content"][:3], r["section_header"]) for r in last] == [("B", "A > B"), ("C", "C"), ("pre", ""), ("yyy", "")]


def test_command_line(spark, folder, capsys):
    run = lambda *a: cli.main(["--collection", str(folder / "c"), *a], spark)
    assert run("ingest", str(folder / "in"), "--extension", "md") == 0 and run("query", "boats on water", "--top-k", "1") == 0 and run("list") == 0 and run("stats") == 0
    assert run("status") == 0 and run("retry") == 0 and run("batch", str(folder / "in/trees.html")) == 0 and run("compact") == 0
    assert "boats.md" in capsys.readouterr().out
    assert run("query", "boats", "--mode", "nope") == 1 and run("ingest", str(folder / "none")) == 1


def test_converter_answers(spark):
    rows = [("a", {"document": {"md_content": "# x"}, "status": "success"}), ("b", {"status": "failure", "errors": [{"error_message": "e1"}, {"error_message": "e2"}]}), ("c", {"document": {"md_content": " "}, "status": "success"})]
    got = {r["path"]: r for r in conversion.read_answers(spark.createDataFrame([(p, json.dumps(a)) for p, a in rows] + [("d", "no json")], "path string, answer string")).collect()}
    assert got["a"]["error_type"] is None and (got["b"]["error_type"], got["b"]["error"]) == ("ConversionError", "e1; e2") and got["c"]["error_type"] == "CorruptedDocumentError" and got["d"]["error_type"] == "ConversionError"
    chunks = conversion.read_chunks(spark.createDataFrame([("a", json.dumps({"chunks": [{"text": "x", "headings": ["h", "i"]}, {"text": " "}, {"text": "y"}]}))], "path string, answer string")).collect()
    assert [(c["content"], c["section_header"]) for c in chunks] == [("x", "h"), ("y", "")]


def test_ocr(spark):
    rows = spark.createDataFrame([("a", "long enough " * 60, bytearray(b"%PDF-1")), ("b", "", bytearray(b" %PDF-1"))], "path string, markdown string, content binary")
    assert {r["path"]: r["needs_ocr"] for r in conversion.with_ocr(rows).collect()} == {"a": False, "b": True}
    assert {r["path"]: r["error_type"] for r in conversion.with_ocr(rows, lambda c: F.lit(" ")).collect()} == {"a": None, "b": "CorruptedDocumentError"}
    assert rows.filter(conversion.is_pdf(F.col("content"))).count() == 2
    lines = spark.createDataFrame([("p", 2, 1, "c", 0.5), ("p", 1, 2, "b", 1.0), ("p", 1, 1, "a", 1.0), ("p", 3, 1, " ", 0.5)], "path string, page int, line int, text string, score double")
    assert tuple(conversion.joined_pages(lines).first()) == ("p", "a\nb\n\n---\n\nc", 0.75)


def test_enrich(spark):
    chunks = spark.createDataFrame([(1, i, f"c{i}", "H" if i else "") for i in range(5)], "doc_id bigint, chunk_index int, content string, section_header string")
    plain = [r["content"] for r in conversion.enrich(chunks).orderBy("chunk_index").collect()]
    assert plain[:2] == ["c0", "[Context: H] c1"]
    told = conversion.enrich(chunks, "summary", lambda p: F.regexp_replace(p, r"c(\d)", "about $1"), batch=2, most=2).orderBy("chunk_index").collect()
    assert [r["content"] for r in told] == ["[Context: about 0] c0", "[Context: about 1] c1", "[Context: about 2] c2", "[Context: about 3] c3", "[Context: H] c4"]


def test_batches(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    state = spark.createDataFrame([("a", "completed"), ("b", "running")], "item string, status string")
    assert {r["item"] for r in conversion.pending_items(items, state).collect()} == {"b", "c"}
    states = spark.sql("select * from values (1, true, timestamp'2024-01-01'), (2, false, timestamp'2024-01-01'), (3, true, timestamp'2024-01-18') t(id, complete, updated_at)")
    assert {r["id"] for r in conversion.expired_states(states, F.lit("2024-01-20").cast("timestamp")).collect()} == {1}
