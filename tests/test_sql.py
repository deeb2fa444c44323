"""The file source, batch and stream, and table functions in SQL."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.errors import SourceError
from lodestone.functions import tables
from lodestone.operators import chunking
from lodestone.sources import datasource


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for i, name in enumerate(["a.md", "b.MD", "c.txt", "deep/d.md", "empty.md"]):
        (tmp_path / "in" / name).write_bytes(b"" if name == "empty.md" else f"text {i} \xff".encode("latin-1"))
        os.utime(tmp_path / "in" / name, (1_700_000_000 + i, 1_700_000_000 + i))
    return tmp_path


@pytest.fixture
def source(spark):
    spark.dataSource.register(datasource.FileSource)
    return lambda reader, path, **o: reader.format("lodestone_files").options(**o).load(str(path))


def test_listing(spark, source, folder):
    rows = {r["name"]: r for r in source(spark.read, folder / "in", extensions="md", partitions="2").collect()}
    assert set(rows) == {"a.md", "b.MD", "d.md", "empty.md"} and bytes(rows["a.md"]["content"]) == b"text 0 \xff" and bytes(rows["empty.md"]["content"]) == b""
    assert rows["d.md"]["path"] == str(folder / "in/deep/d.md") and rows["d.md"]["size"] == 8 and rows["d.md"]["modified_at"].timestamp() == 1_700_000_003
    flat = source(spark.read, folder / "in", recursive="false", content="false").collect()
    assert {r["name"] for r in flat} == {"a.md", "b.MD", "c.txt", "empty.md"} and all(r["content"] is None for r in flat)
    with pytest.raises(Exception, match="can't be listed"):
        source(spark.read, folder / "none").count()
    (folder / "bare").mkdir()
    assert source(spark.read, folder / "bare").count() == 0


def test_files_are_dealt_by_size_and_may_go(folder):
    listing = datasource.Listing({"path": str(folder / "in"), "partitions": "3"})
    files = [(f"f{i}", s, 0) for i, s in enumerate([100, 1, 1, 50, 50, 1])]
    parts = [p.files for p in listing.dealt(files)]
    assert sorted(f for p in parts for f in p) == sorted(files) and sorted(sum(f[1] for f in p) for p in parts) == [51, 52, 100]
    rows = list(listing.rows([(str(folder / "gone"), 3, 0)]))
    assert rows[0][4] is None and rows[0][5].startswith("FileNotFoundError")
    with pytest.raises(SourceError):
        datasource.Listing({})


def test_cache_by_path_size_and_time(folder):
    listing = datasource.Listing({"path": str(folder / "in"), "cache": str(folder / "cache")})
    file = next(f for f in listing.files() if f[0].endswith("a.md"))
    assert listing._content(file) == b"text 0 \xff" and len(os.listdir(folder / "cache")) == 1
    (folder / "in/a.md").write_bytes(b"other 0!")
    assert listing._content(file) == b"text 0 \xff"  # as it was at that time
    changed = next(f for f in listing.files() if f[0].endswith("a.md"))
    assert listing._content(changed) == b"other 0!" and len(os.listdir(folder / "cache")) == 2


def test_stream(spark, source, folder):
    """Files come once, by their times, in batches; a restart goes on; changed files come again."""

    def drain():
        q = source(spark.readStream, folder / "in", per_batch="2", settle="0").select("name", F.length("content").alias("n")).writeStream.format("parquet").option("checkpointLocation", str(folder / "ck")).start(str(folder / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted(r["name"] for r in spark.read.parquet(str(folder / "out")).collect())

    names = ["a.md", "b.MD", "c.txt", "d.md", "empty.md"]
    assert drain() == names and len([f for f in os.listdir(folder / "out/_spark_metadata") if not f.startswith(".")]) >= 3
    assert drain() == names
    (folder / "in/new.md").write_text("new")
    (folder / "in/a.md").write_text("changed")
    time.sleep(0.1)
    assert drain() == sorted([*names, "new.md", "a.md"])


def test_chunks_in_sql(spark, sf):
    tables.register(spark)
    rng = random.Random(4)
    odd = [None, "", "  \n\n ", "# H\n\n" + "word " * 60, "|a|b|\n|c|d|\n\n" + "x" * 900, "\n\n".join(rng.choice(["# Part ##", "```code```", "- item", "plain text " * 9, "1. one"]) for _ in range(90)), " word " * 80]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), F.col("text")))
    docs.createOrReplaceTempView("docs")
    for strategy in ("fixed", "markdown", "recursive", "other"):
        want = sorted(map(tuple, chunking.create_chunks(docs, strategy, 96, 16).collect()))
        got = spark.sql(f"SELECT d.doc_id, c.* FROM docs d, LATERAL chunks(d.text, '{strategy}', 96, 16) c")
        assert got.columns == ["doc_id", "chunk_index", "content", "section_header"] and sorted(map(tuple, got.collect())) == want and want
    more = spark.sql("SELECT c.* FROM docs d, LATERAL chunks(d.text, strategy => 'markdown', size => 96, overlap => 0, extra => true) c")
    assert more.columns[-2:] == ["kind", "tokens"]
    both = more.select("kind", chunking.block_kind(F.col("content")).alias("k")).distinct().collect()
    assert {r["kind"] for r in both} >= {"table", "paragraph"} and all(r["kind"] == r["k"] for r in both)
    with pytest.raises(Exception, match="must be a constant"):
        spark.sql("SELECT c.* FROM docs d, LATERAL chunks(d.text, d.text) c")
    assert spark.sql("SELECT tokens_estimate('12345678'), strip_context('[Context: h] x'), content_hash('a')").first()[:2] == (2, "x")
