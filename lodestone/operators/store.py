"""The chunk table: ingest, replace by source, delete, list, search; increments merged when they are read.

Every write adds a segment and rewrites none: its own chunks, and a row in ``sources`` for each source that it replaces
or deletes. A version is a manifest, the list of segments in their order. Of each source the newest
segment that names it counts: reading takes a segment's chunks without the sources that later ones name, so a batch of
1,000 sources writes its own rows whatever the table holds. ``compact`` writes what counts as one segment, in folders by hash
of the source; a write does it when there are more than ``Settings.store_segments``.

A writer creates the next manifest, which no other can have created: by an exclusive create, or where a store has none
until the file is closed, by its conditional put. A writer that comes second adds its segment behind the other's, so of two
that name one source the later counts. A manifest that was never finished (its writer died) is passed over once it is older
than ``GRACE`` seconds. A failed write leaves files that no manifest names; ``vacuum`` removes them. Manifests go
through Hadoop's file system by the driver's JVM (classic Spark).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from lodestone.config import Settings
from lodestone.errors import StorageError
from lodestone.functions import text as T
from lodestone.operators import chunking, embedding, extraction, filters, memo, retrieval
from lodestone.operators.inverted import InvertedIndex

SCHEMA = (
    "id string, source string, chunk_index int, total_chunks int, content string, section_header string, context_prefix string, "
    "content_hash string, language string, keywords array<string>, ingested_at timestamp, dense array<float>, contextual_dense array<float>, "
    "entities map<string,array<string>>, topics array<string>, doc_type string, file_size bigint, file_mtime double, "
    "structural struct<heading_level:bigint,is_list:boolean,is_code:boolean,is_table:boolean,char_count:bigint,word_count:bigint,link_count:bigint,email_count:bigint,phone_count:bigint>"
)


#: What a hit has of its chunk.
RESULT = ("id", "source", "content", "section_header", "context_prefix", "doc_type", "topics", "language", "keywords", "entities", "structural")
#: Seconds after which a manifest without content counts as left by a writer that died.
GRACE = 600


class Collection:
    """A versioned chunk table under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, ask: extraction.Ask | None = None, embed: embedding.Embedder | None = None, chunker: Callable[[Column], Column] | None = None):
        """``ask`` is a chat provider of chunks' metadata; without it, what can be computed is. ``embed`` is a served
        model of ``Settings.dense_dim`` numbers, asked once for each text; without it, hashed features are taken. ``chunker`` is asked by the strategy ``hybrid``."""
        self.spark, self.folder, self.settings, self.ask, self.embed, self.chunker = spark, folder.rstrip("/"), settings or Settings(), ask, embed, chunker

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list:
        fs, p = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, version: int) -> dict | None:
        """A manifest's content; None while its writer has not closed it."""
        fs, p = self._fs(f"{self.folder}/versions/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        return sorted((int(n[:-5]) for f in self._names(f"{self.folder}/versions") if (n := f.getPath().getName()).endswith(".json")), reverse=True)

    def _latest(self) -> tuple[int, list[dict]]:
        """The newest whole version: its number and segments."""
        try:
            for v in self._versions():
                if (found := self._manifest(v)) is not None:
                    return v, found["segments"]
        except Py4JJavaError as e:
            raise StorageError(f"{self.folder} can't be read") from e
        return 0, []

    def _create(self, version: int, content: dict) -> bool:
        """Whether this writer was the one to create the manifest."""
        fs, p = self._fs(f"{self.folder}/versions/{version:012d}.json")
        try:
            # The option is for object stores, which find out at the end; others refuse at the beginning.
            out = fs.createFile(p).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", "true").build()
            out.write(json.dumps(content).encode())
            out.close()
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise StorageError(f"{self.folder} can't be written") from e
        return True

    def _unfinished(self, version: int) -> bool:
        """Whether a manifest has no content; waits for a writer that may be at it, but not for one that died."""
        fs, p = self._fs(f"{self.folder}/versions/{version:012d}.json")
        until = fs.getFileStatus(p).getModificationTime() / 1000 + GRACE
        while self._manifest(version) is None:
            if time.time() >= until:
                return True
            time.sleep(0.2)
        return False

    def _commit(self, change: Callable[[list[dict]], list[dict]]) -> int:
        """Creates the next version from what the newest one holds; returns its number."""
        while True:
            version, segments = self._latest()
            number = version + 1
            # Numbers above are of manifests that are being written, or were left.
            while number in self._versions() and self._unfinished(number):
                number += 1
            if number not in self._versions() and self._create(number, {"segments": change(segments)}):
                return number

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", bucket int").parquet(path).drop("bucket")

    def chunks(self, segments: list[dict] | None = None) -> DataFrame:
        """The chunks that count, of the newest version or of given segments."""
        segments = self._latest()[1] if segments is None else segments
        found, later = None, None
        for s in reversed(segments):
            if s.get("chunks"):
                rows = self._read(s["chunks"])
                rows = rows if later is None else rows.join(later, "source", "left_anti")
                found = rows if found is None else found.unionByName(rows)
            if s.get("sources"):
                named = self.spark.read.schema("source string").parquet(s["sources"])
                later = named if later is None else later.unionByName(named)
        return self.spark.createDataFrame([], SCHEMA) if found is None else found

    def _replace(self, sources: DataFrame, new: DataFrame | None = None) -> None:
        """The next version: ``sources`` (source) have the chunks of ``new``, or none."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        sources.select("source").distinct().write.parquet(f"{path}/sources")
        if not self.spark.read.schema("source string").parquet(f"{path}/sources").head(1):
            return
        segment = {"sources": f"{path}/sources"}
        if new is not None:
            kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
            new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).write.parquet(f"{path}/chunks")
            segment["chunks"] = f"{path}/chunks"
        self._commit(lambda segments: [*segments, segment])
        if len(self._latest()[1]) > self.settings.store_segments:
            self.compact()

    def compact(self) -> int:
        """Writes the chunks that count as one segment; those added meanwhile stay behind it. Returns the number of segments that it took over."""
        taken = self._latest()[1]
        if len(taken) < 2:
            return 0
        path = f"{self.folder}/data/{uuid.uuid4().hex}/chunks"
        bucket = F.pmod(F.xxhash64("source"), F.lit(self.settings.store_buckets)).cast("int")
        # AQE splits a large bucket's rows over tasks and joins small ones.
        self.chunks(taken).withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)

        def swapped(segments: list[dict]) -> list[dict]:
            if segments[: len(taken)] != taken:
                raise StorageError(f"{self.folder} was compacted meanwhile")
            return [{"chunks": path}, *segments[len(taken) :]]

        self._commit(swapped)
        return len(taken)

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` written once beside the collection and read back, where several jobs need them; ``vacuum`` removes them."""
        path = f"{self.folder}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> int:
        """Removes folders that none of the last ``keep`` versions names and that are older than ``hours``; returns their number."""
        last = self._latest()[0]
        kept = [v for v in self._versions() if v <= last][:keep]
        held = {at.split("/data/", 1)[1].split("/")[0] for v in kept for s in (self._manifest(v) or {"segments": []})["segments"] for at in s.values()}
        gone = 0
        for part in ("data", "staging"):
            for f in self._names(f"{self.folder}/{part}"):
                if f.getPath().getName() not in held and f.getModificationTime() <= (time.time() - hours * 3600) * 1000:
                    f.getPath().getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(f.getPath(), True)
                    gone += 1
        return gone

    def prepare(self, docs: DataFrame) -> DataFrame:
        """Chunks with ids, metadata and vectors of (doc_id, source, text), and of file_size and file_mtime if they are there."""
        s = self.settings
        return self._complete(chunking.create_chunks(docs, s.chunk_strategy, s.chunk_size, s.chunk_overlap, s.min_chunk_chars, self.chunker), docs)

    def _complete(self, made: DataFrame, docs: DataFrame) -> DataFrame:
        """Chunks (doc_id, chunk_index, content, section_header), each content once, with all that is stored of them."""
        s = self.settings
        first = made.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", T.content_hash(F.col("content"))).orderBy("chunk_index"))).filter("nth = 1")
        w = Window.partitionBy("doc_id")
        numbered = first.withColumn("chunk_index", (F.row_number().over(w.orderBy("chunk_index")) - 1).cast("int")).withColumn("total_chunks", F.count("*").over(w).cast("int"))
        of_file = [F.col(c) for c in ("file_size", "file_mtime") if c in docs.columns]
        rows = numbered.join(docs.select("doc_id", "source", T.content_hash(F.coalesce(F.col("text"), F.lit(""))).alias("content_hash"), *of_file), "doc_id")
        rows = rows.withColumn("id", T.uuid5(F.concat("source", F.lit("_"), F.col("chunk_index").cast("string"))))
        # Metadata is of the chunk alone; the context before it comes after.
        known = extraction.extract(rows.select("id", "doc_id", "chunk_index", "content"), self.ask, s.context_batch).drop("doc_id", "chunk_index", "content")
        prefix = T.context_header(F.col("section_header"))
        rows = rows.join(known, "id").withColumn("context_prefix", prefix).withColumn("content", T.apply_context(prefix, F.col("content"))).withColumn("ingested_at", F.current_timestamp())
        make = self.embed or embedding.embedder("hash", dim=s.dense_dim)
        if self.embed is None:  # built-in expressions cost less than a look at a table
            return embedding.dual(rows, make)
        held = memo.Memo(self.spark, f"{self.folder}/embeddings")
        return embedding.dual(self.staged(rows), make, lambda df, text, into, how: held.embed(df, text, into, how, s.embed_model, s.dense_dim, s.embed_tries))

    def ingest(self, docs: DataFrame) -> None:
        """Adds or replaces the sources of ``docs``; those stored with the same content are left out."""
        known = self.chunks().select("source", "content_hash").distinct()
        fresh = docs.withColumn("content_hash", T.content_hash(F.coalesce(F.col("text"), F.lit("")))).join(known, ["source", "content_hash"], "left_anti").drop("content_hash")
        self._replace(fresh.select("source").distinct(), self.prepare(fresh))

    def ingest_chunks(self, chunks: DataFrame, texts: DataFrame) -> None:
        """Adds or replaces sources by chunks (source, chunk_index, content, section_header) that were made elsewhere.

        ``texts`` has each source's whole text (source, text). Chunks below the least length go; a source of
        which none is left raises, and nothing is written.
        """
        long = chunks.filter(F.length(F.trim("content")) >= self.settings.min_chunk_chars)
        if bad := texts.join(long, "source", "left_anti").head():
            raise StorageError(f"{bad['source']} has no chunk of {self.settings.min_chunk_chars} characters")
        docs = texts.withColumn("doc_id", F.xxhash64("source"))
        made = long.join(docs.select("source", "doc_id"), "source").select("doc_id", "chunk_index", "content", F.coalesce("section_header", F.lit("")).alias("section_header"))
        self._replace(texts.select("source"), self._complete(made, docs))

    def _indexed(self) -> int:
        """The version that the word index is of; 0 without one."""
        path = f"{self.folder}/index/versions"
        return self.spark.read.parquet(path).agg(F.max("version")).first()[0] if self._names(path) else 0

    def index(self) -> int:
        """Brings the index of the chunks' words up to the newest version, which it returns.

        Sources that segments since its own version name are taken out and put in as they are now; after a
        compaction the index is written anew. A search without filters takes its word list from an index of its version,
        and scans the chunks otherwise. One job at a time may do this.
        """
        version, segments = self._latest()
        words, before = InvertedIndex(self.spark, f"{self.folder}/index/words", self.settings.store_buckets, self.settings.bm25_k1, self.settings.bm25_b), self._indexed()
        said = lambda rows: rows.select("id", F.col("content").alias("text"))
        if version and version != before:
            held = (self._manifest(before) or {"segments": []})["segments"] if before else []
            new = segments[len(held) :]
            if held and segments[: len(held)] == held and all("sources" in s for s in new):
                named = self.spark.read.schema("source string").parquet(*[s["sources"] for s in new]).distinct()
                words.remove(self.staged(self.chunks(held).join(named, "source", "left_semi").select("id")))
                words.add(said(self.chunks(segments).join(named, "source", "left_semi")))
            else:
                words.compact(said(self.chunks(segments)))
            self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.folder}/index/versions")
        return version

    def _word_list(self, queries: DataFrame, rows: DataFrame, filtered: bool) -> DataFrame:
        """(query_id, id, score, rank) by BM25, from the index if there is one of this version."""
        s = self.settings
        if not filtered and (v := self._indexed()) and v == self._latest()[0]:
            return InvertedIndex(self.spark, f"{self.folder}/index/words", s.store_buckets, s.bm25_k1, s.bm25_b).search(queries, s.candidate_k)
        return retrieval.bm25_topk(queries, rows.select("id", F.col("content").alias("text")), s.candidate_k, s.bm25_k1, s.bm25_b)

    def delete(self, sources: DataFrame) -> int:
        """Removes all chunks of the listed sources; returns how many there were."""
        old = self.chunks()
        gone = old.join(sources.select("source").distinct(), "source", "left_semi").count()
        if gone:
            self._replace(sources.select("source").distinct())
        return gone

    def documents(self) -> DataFrame:
        c = self.chunks()
        return c.groupBy("source").agg(F.count("*").alias("chunks"), F.min_by("language", "chunk_index").alias("language"), F.max("ingested_at").alias("ingested_at")).orderBy(F.desc("ingested_at"), "source")

    def search(self, queries: DataFrame, mode: str = "hybrid", top_k: int | None = None, where: dict | None = None, source: str | None = None, rerank: bool = True, expansion: embedding.Expansion | None = None, contextual: bool | None = None) -> DataFrame:
        """(query_id, rank, score, dense_score, sparse_score) and the chunk's ``RESULT`` for (query_id, text), all queries in one job.

        similarity: dense alone. hybrid: dense and BM25, fused. mmr: dense, then diverse; its order
        is kept. Filters come before ranking. ``expansion`` rewrites queries, and in the hybrid mode adds
        dense lists of a hypothetical answer and of paraphrases, scored in the same pass over the chunks.
        ``contextual`` chooses the vectors of chunks with their contexts, else those of the chunks alone.
        """
        s, k = self.settings, top_k or self.settings.top_k
        rows = self.chunks()
        rows = rows.filter(filters.build(rows, where, source))
        make = self.embed or embedding.embedder("hash", dim=s.dense_dim)
        variants = embedding.variants(queries, expansion if mode == "hybrid" else expansion and expansion.rewriting())
        asked_for = queries
        queries = variants.filter("list = 0").select("query_id", "text")
        asked = queries.select("query_id", "text", make(F.col("text")).alias("vec"))
        with_context = s.contextual_search if contextual is None else contextual
        vectors = rows.select("id", F.col("contextual_dense" if with_context else "dense").alias("vec"))
        if mode == "mmr":
            dense = retrieval.dense_topk(asked, vectors, s.mmr_fetch_k)
            found = retrieval.mmr(dense, vectors, k, s.mmr_lambda).select("query_id", "id", (F.col("place") + 1).alias("rank"), F.lit(None).cast("double").alias("score"))
            scores = dense.select("query_id", "id", F.col("score").alias("dense_score"))
            return self._results(found.join(scores, ["query_id", "id"]).withColumn("sparse_score", F.lit(0.0)), rows)
        if mode == "hybrid":
            each = variants.select(F.struct("query_id", "list").alias("query_id"), make(F.col("text")).alias("vec"))
            dense = retrieval.dense_topk(each, vectors, s.candidate_k).select("query_id.query_id", "query_id.list", "id", "rank", "score")
            sparse = self._word_list(queries, rows, bool(where) or source is not None)
            lists = dense.drop("score").unionByName(sparse.select("query_id", F.lit(1).alias("list"), "id", "rank"))
            found = retrieval.fuse_rows(lists, s.rrf_k, s.rrf_mode)
            own = dense.filter("list = 0").select("query_id", "id", F.col("score").alias("dense_score"))
            found = found.join(own, ["query_id", "id"], "left").join(sparse.select("query_id", "id", F.col("score").alias("sparse_score")), ["query_id", "id"], "left")
        else:
            found = retrieval.dense_topk(asked, vectors, s.candidate_k).withColumn("dense_score", F.col("score")).withColumn("sparse_score", F.lit(0.0))
        hits = found.join(rows.select("id", "content"), "id").join(asked_for.select("query_id", F.col("text").alias("query")), "query_id")
        if rerank:
            ranked = retrieval.rerank(hits, retrieval.lexical_score(F.col("query"), F.col("content")))
            hits = ranked.withColumn("rank", F.col("new_rank")).withColumn("score", F.col("rerank_score"))
        return self._results(hits.filter(F.col("rank") <= k), rows)

    @staticmethod
    def _results(hits: DataFrame, rows: DataFrame) -> DataFrame:
        """Hits with their chunk's fields; an empty value where a chunk has none."""
        scores = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("dense_score", "sparse_score")]
        none = {"doc_type": F.lit(""), "topics": F.array().cast("array<string>"), "entities": F.expr("cast(map() as map<string,array<string>>)")}
        fields = [F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in RESULT]
        found = hits.select("query_id", "rank", "id", "score", *scores).join(rows.select(*RESULT), "id").select("query_id", "rank", "score", "dense_score", "sparse_score", *fields)
        return found.withColumn("dates", F.coalesce(F.try_element_at("entities", F.lit("dates")), F.array().cast("array<string>")))
