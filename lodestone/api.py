"""The engine's tools as one object: ingest, query, answers, listing, sync, filters, evaluation, status."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import STATUSES, Settings
from lodestone.errors import EngineError, RetrievalError, SourceError
from lodestone.functions import text as T
from lodestone.operators import answers, conversion, evaluation, extraction, filters, status, sync
from lodestone.operators.embedding import Embedder, Expansion
from lodestone.operators.reports import ReportStore, report
from lodestone.operators.store import Collection
from lodestone.sources import files
from lodestone.sources.convert import html_to_markdown


#: Formats that are read as text; others than these and html go to the converter.
PLAIN = ("txt", "text", "md", "markdown", "rst", "log", "csv", "tsv", "json", "jsonl", "yaml", "yml", "xml")
#: Results of queries that are kept, and for how many seconds.
RESULTS, TTL_S = 64, 300
SCANS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


class Engine:
    """Tools over one collection, and their providers: Columns to Columns, each may be missing.

    ``ask(query, context)`` answers; ``convert(content, file name)`` gives markdown of files that are no
    text, ``ocr(content)`` that of scans; ``expansion`` rewrites and extends queries; ``extract`` gives chunks' metadata;
    ``embed`` is a served model of vectors, ``chunker`` a served one of chunks (strategy ``hybrid``), ``fetch`` gives the bytes of URLs, ``chat`` says a
    question's filters. ``status`` has a record of every source that an ingest or a sync took up.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, ask: Callable[[Column, Column], Column] | None = None, convert: Callable[[Column, Column], Column] | None = None, ocr: Callable[[Column], Column] | None = None, expansion: Expansion | None = None, extract: extraction.Ask | None = None, embed: Embedder | None = None, fetch: Callable[[Column], Column] | None = None, chat: Callable[[Column], Column] | None = None, chunker: Callable[[Column], Column] | None = None):
        self.spark, self.settings, self.ask, self.convert, self.ocr, self.expansion = spark, settings or Settings(), ask, convert, ocr, expansion
        self.collection = Collection(spark, folder, self.settings, extract, embed, chunker)
        self.fetch, self.chat = fetch, chat
        self.status = status.StatusStore(spark, f"{folder.rstrip('/')}/status")
        self.reports = ReportStore(spark, f"{folder.rstrip('/')}/reports")
        self._results: dict[str, tuple[float, DataFrame]] = {}

    def _texts(self, listing: DataFrame) -> DataFrame:
        """(doc_id, source, text, problem): one row a file; a file that can't be read has a problem and no text.

        html is converted, plain formats are UTF-8 or else Latin-1; files of unknown formats are text if they
        are UTF-8 without NUL. The rest goes to the converter, and what that gives too little of to OCR.
        """
        raw = F.col("content").cast("string")
        text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
        known = F.col("format").isin(*PLAIN, "html", "htm")
        unknown = (F.col("format") == "unknown") & F.is_valid_utf8(raw) & (F.instr(raw, "\0") == 0)
        rows = files.routed(listing.select("path", "content")).withColumn("plain", known | unknown)
        read = rows.filter("plain").select("path", "format", text.alias("text"))
        is_page = F.col("format").isin("html", "htm")
        pages = read.filter(is_page).select(F.xxhash64("path").alias("page_id"), "path", F.col("text").alias("html"))
        none = F.lit(None).cast("string").alias("problem")
        made = html_to_markdown(pages).join(pages.select("page_id", "path"), "page_id").select("path", F.col("markdown").alias("text"), none)
        rest = rows.filter("not plain")
        converted = F.lit("") if self.convert is None else F.coalesce(self.convert(F.col("content"), F.col("file_name")), F.lit(""))
        if self.convert is None:
            foreign = rest.filter(~F.col("format").isin(*SCANS)).select("path", F.lit(None).cast("string").alias("text"), F.lit("no converter").alias("problem"))
            made, rest = made.unionByName(foreign), rest.filter(F.col("format").isin(*SCANS))
        scans = conversion.with_ocr(rest.select("path", converted.alias("markdown"), "content"), self.ocr)
        problem = F.when(F.col("needs_ocr"), "needs_ocr").otherwise(F.col("error_type"))
        scans = scans.select("path", F.when(problem.isNull(), F.col("markdown")).alias("text"), problem.alias("problem"))
        every = read.filter(~is_page).select("path", "text", none).unionByName(made).unionByName(scans)
        return every.select(F.xxhash64("path").alias("doc_id"), T.canonical_path(F.col("path")).alias("source"), "text", "problem")

    def ingest_files(self, path: str, extensions: list[str] | None = None) -> int:
        """Ingests all files under a path that can be read; returns the number of chunks that the collection has."""
        listing = files.listing(self.spark, "local", path=path, extensions=extensions)
        texts = self.collection.staged(self._texts(listing).join(self._sizes(listing), "source"))
        return self.ingest_texts(texts.filter("problem is null").drop("problem"))

    @staticmethod
    def _sizes(listing: DataFrame) -> DataFrame:
        """What tells later that a file is as it was: (source, file_size, file_mtime)."""
        return listing.select(T.canonical_path(F.col("path")).alias("source"), F.col("size").alias("file_size"), (F.unix_micros("modified_at") / 1e6).alias("file_mtime"))

    def unread(self, path: str, extensions: list[str] | None = None) -> DataFrame:
        """(source, problem): files under a path that need a converter or OCR, or that gave no text."""
        return self._texts(files.listing(self.spark, "local", path=path, extensions=extensions)).filter("problem is not null").select("source", "problem")

    def ingest_texts(self, docs: DataFrame) -> int:
        self._ingest(docs)
        self._forget()
        return self.collection.chunks().count()

    def _ingest(self, docs: DataFrame, **retries: int) -> None:
        """Ingests (doc_id, source, text), with a record of each source; if the job fails, all of them fail and are due again later."""
        docs = self.collection.staged(docs)
        sources = docs.select("source").distinct()
        if not sources.head(1):
            return
        known = self.status.records().select("source")
        self.status.mark_pending(sources.join(known, "source", "left_anti"))
        self.status.update_stage(sources, "Chunking")
        try:
            self.collection.ingest(docs)
        except Exception as e:
            status.schedule(self.status, sources.select("source", F.lit(str(e)[:500]).alias("error"), F.lit(type(e).__name__).alias("error_type")), **retries)
            raise
        counts = self.collection.chunks().join(sources, "source", "left_semi").groupBy("source").agg(F.count("*").alias("chunks"))
        self.status.mark_done(sources.join(counts, "source", "left").select("source", F.coalesce("chunks", F.lit(0)).alias("chunks")))

    def sync(self, path: str, extensions: list[str] | None = None, dry_run: bool = False, retries: int | None = None, backoff_s: int = 300) -> DataFrame:
        """(source, action); unless ``dry_run``, new and changed files are ingested, then missing ones deleted.

        Sources are compared by their canonical paths. A file of the stored size and time is unchanged and is not
        read; of the others the contents' hashes decide. A file that can't be read is ``unread``: what is stored of it
        stays, and its record fails. Files whose retry is due are ingested whatever their hashes say. With
        ``retries``, a file that fails is tried again by later syncs so many times, ``backoff_s`` after each.
        """
        again = {} if retries is None else {"auto_most": retries, "auto_backoff_s": backoff_s}
        listing = files.listing(self.spark, "local", path=path, extensions=extensions).withColumn("source", T.canonical_path(F.col("path")))
        chunks = self.collection.chunks().withColumn("source", T.canonical_path(F.col("source")))
        stored = chunks.groupBy("source").agg(F.max("file_size").alias("file_size"), F.max("file_mtime").alias("file_mtime"))
        due = self.collection.staged(self.status.due().select("source"))
        same = files.unmodified(listing.select(F.col("source").alias("path"), "size", "modified_at"), stored).select(F.col("path").alias("source")).join(due, "source", "left_anti")
        same = self.collection.staged(same)
        texts = self.collection.staged(self._texts(listing.join(same, "source", "left_anti")).join(self._sizes(listing), "source"))
        hashes = chunks.select("source", "content_hash", "chunk_index", F.lit("").alias("file_content_hash"))
        kept = sync.stored_hashes(hashes).join(same, "source", "left_semi")
        current = texts.select("source", T.content_hash(F.col("text")).alias("hash")).unionByName(kept.select("source", F.col("hash")))
        bad = texts.filter("problem is not null").select("source", F.lit(True).alias("bad"))
        actions = status.fold_in(sync.reconcile(current, sync.stored_hashes(hashes)), due).join(bad, "source", "left")
        done = self.collection.staged(actions.select("source", F.when(F.col("bad"), "unread").otherwise(F.col("action")).alias("action")))
        if not dry_run:
            said = lambda *names: done.filter(F.col("action").isin(*names)).select(F.col("source").alias("at"))
            held = self.collection.chunks().select("source").distinct().withColumn("at", T.canonical_path(F.col("source")))
            old = held.join(said("delete"), "at", "left_semi").unionByName(held.filter("source <> at").join(said("update"), "at", "left_semi"))
            old = self.collection.staged(old.select("source"))
            failed = texts.join(said("unread").withColumnRenamed("at", "source"), "source", "left_semi").select("source", F.col("problem").alias("error"), F.col("problem").alias("error_type"))
            if failed.head(1):
                known = self.status.records().select("source")
                self.status.mark_pending(failed.select("source").join(known, "source", "left_anti"))
                self.status.update_stage(failed.select("source"), "Reading")
                status.schedule(self.status, failed, **again)
            self._ingest(texts.join(said("ingest", "update").withColumnRenamed("at", "source"), "source", "left_semi").drop("problem"), **again)
            if self.collection.delete(old):
                self.status.mark_deleted(old.distinct())
            self._forget()
        return done

    def retry(self, part: str | None = None) -> int:
        """Failed sources (that hold ``part``) are due in the next sync at once; returns their number."""
        failed = self.status.records("failed").select("source")
        failed = self.collection.staged(failed if part is None else failed.filter(F.contains("source", F.lit(part))))
        n = failed.count()
        if n:
            self.status.schedule_retry(failed, backoff_s=0)
        return n

    def ingest_urls(self, urls: Sequence[str]) -> DataFrame:
        """Fetches and ingests URLs; returns (source, problem), null where all went well."""
        if self.fetch is None:
            raise EngineError("no provider that fetches URLs")
        rows = self.spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "path string")
        got = self.collection.staged(rows.withColumn("content", self.fetch(F.col("path")).cast("binary")))
        lost = got.filter("content is null").select(T.canonical_path(F.col("path")).alias("source"), F.lit("unreachable").alias("problem"))
        texts = self.collection.staged(self._texts(got.filter("content is not null")))
        empty = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.coalesce("problem", F.lit("empty"))).otherwise(F.col("problem"))
        judged = texts.withColumn("problem", empty)
        self.ingest_texts(judged.filter("problem is null").drop("problem"))
        return judged.select("source", "problem").unionByName(lost)

    def ingest_batch(self, items: Sequence[str]) -> DataFrame:
        """(item, status, error) of paths and URLs, one by one in the result and together in the work.

        What happened to each is kept by the batch's own id, so the same batch begun again goes on with those
        that are not done; one item's failure stops no other.
        """
        items = list(dict.fromkeys(items))
        batch = hashlib.sha256(json.dumps(sorted(items)).encode()).hexdigest()[:12]
        folder = f"{self.collection.folder}/batches"
        kinds = "batch string, item string, status string, error string, at bigint"
        self.spark.createDataFrame([], kinds).write.mode("ignore").parquet(folder)

        def state() -> DataFrame:
            # The time tells scans of before and after a write apart.
            rows = self.spark.read.schema(kinds).parquet(folder).filter((F.col("batch") == batch) & (F.col("at") <= time.time_ns()))
            return rows.groupBy("item").agg(F.max_by("status", "at").alias("status"), F.max_by("error", "at").alias("error"))

        def note(rows: DataFrame) -> None:
            rows.select(F.lit(batch).alias("batch"), "item", "status", "error", F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(folder)

        named = self.spark.createDataFrame([(i,) for i in items], "item string")
        left = [r[0] for r in conversion.pending_items(named, state().filter("status = 'completed'")).collect()]
        urls, found, lost = [i for i in left if i.startswith(("http://", "https://"))], None, []
        for path in (i for i in left if i not in urls):
            try:
                rows = files.listing(self.spark, "local", path=path).select("path", "content", "size", "modified_at", F.lit(path).alias("item"))
                found = rows if found is None else found.unionByName(rows)
            except SourceError as e:
                lost.append((path, "failed", str(e)))
        if found is not None:
            texts = self.collection.staged(self._texts(found).join(self._sizes(found).dropDuplicates(["source"]), "source"))
            self._ingest(texts.filter("problem is null").drop("problem"))
            of = found.select(T.canonical_path(F.col("path")).alias("source"), "item").join(texts.select("source", "problem"), "source").groupBy("item").agg(F.max("problem").alias("error"))
            note(of.select("item", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error"))
        if urls and self.fetch is not None:
            told = self.ingest_urls(urls)
            note(told.select(F.col("source").alias("item"), F.when(F.col("problem").isNull(), "completed").otherwise("failed").alias("status"), F.col("problem").alias("error")))
        elif urls:
            lost += [(u, "failed", "no provider that fetches URLs") for u in urls]
        if lost:
            note(self.spark.createDataFrame(lost, "item string, status string, error string"))
        self._forget()
        return named.join(state(), "item", "left").select("item", F.coalesce("status", F.lit("failed")).alias("status"), F.when(F.col("status").isNull(), "nothing to read").otherwise(F.col("error")).alias("error"))

    def processing_status(self, status: str | None = None, limit: int = 100) -> tuple[dict[str, int], DataFrame]:
        """(number of records by status, with their total; the records that changed last)."""
        counts = {r["status"]: r["n"] for r in self.status.records().groupBy("status").agg(F.count("*").alias("n")).collect()}
        return {"total": sum(counts.values())} | {s: counts.get(s, 0) for s in STATUSES}, self.status.listed(status, limit)

    def service_status(self) -> dict[str, dict]:
        """Of the collection and each provider: whether it answers, and in how many milliseconds; or that there is none."""
        text, binary = F.lit("ping"), F.lit("ping").cast("binary")
        probes = {
            "convert": self.convert and (lambda: self.convert(binary, F.lit("ping.txt"))), "ocr": self.ocr and (lambda: self.ocr(binary)), "ask": self.ask and (lambda: self.ask(text, text)), "chat": self.chat and (lambda: self.chat(text)),
            "extract": self.collection.ask and (lambda: self.collection.ask(text)), "embed": self.collection.embed and (lambda: self.collection.embed(text)), "chunker": self.collection.chunker and (lambda: self.collection.chunker(text)),
        }
        runs = {"collection": lambda: self.collection.chunks().limit(1).count()} | {n: (p and (lambda p=p: self.spark.range(1).select(p().alias("x")).collect())) for n, p in probes.items()}
        out = {}
        for name, run in runs.items():
            begun = time.monotonic()
            try:
                out[name] = {"healthy": False, "error": "none given"} if run is None else (run(), {"healthy": True})[1]
            except Exception as e:
                out[name] = {"healthy": False, "error": str(e).splitlines()[0][:200]}
            out[name]["latency_ms"] = round(1000 * (time.monotonic() - begun), 2)
        return out

    def extract_filters(self, question: str) -> dict:
        """Filters that a question asks for, of the fields that there are: filters, confidence, explanation."""
        if self.chat is None:
            raise EngineError("no chat provider")
        fields = [(r["field"], r["sample"]) for r in self.filter_context().collect()]  # a row for each field
        listed = "\n".join(f"- {name}: {sample[:200]}" for name, sample in fields)
        prompt = f"Fields of a document collection and some of their values:\n{listed}\n\nSay which filters this question asks for, as one JSON object from field to value (or list of values), then explain it in a sentence.\n\nQuestion: {question}"
        said = self.spark.range(1).select(self.chat(F.lit(prompt)).alias("said")).first()["said"] or ""
        found, confidence, explanation = filters.read_answer(said, {name for name, _ in fields})
        return {"filters": found, "confidence": confidence, "explanation": explanation}

    def _forget(self) -> None:
        for _, hits in self._results.values():
            hits.unpersist()
        self._results.clear()

    def query(self, queries: Sequence[str], mode: str = "hybrid", top_k: int = 10, offset: int = 0, limit: int | None = None, where: dict | str | None = None, source: str | None = None, rerank: bool = True) -> DataFrame:
        """Hits of each query, a page of them. The last ``RESULTS`` results are kept, by all parameters, for ``TTL_S`` seconds or until something is ingested."""
        if mode not in ("hybrid", "similarity", "mmr"):
            raise RetrievalError(f"unknown mode: {mode}")
        if not 1 <= top_k <= 50 or offset < 0 or any(not 2 <= len(q) <= 500 for q in queries):
            raise RetrievalError("top_k is 1 to 50, offset at least 0, a query 2 to 500 characters")
        key = json.dumps([list(queries), mode, top_k, filters.parse_arguments(where), source, rerank], sort_keys=True)
        at, hits = self._results.pop(key, (0.0, None))
        if hits is not None and time.monotonic() - at > TTL_S:
            hits, _ = None, hits.unpersist()
        if hits is None:
            at = time.monotonic()
            asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
            hits = self.collection.search(asked, mode, top_k, filters.parse_arguments(where), source, rerank, self.expansion).cache()
            if len(self._results) >= RESULTS:
                self._results.pop(next(iter(self._results)))[1].unpersist()
        self._results[key] = at, hits  # the last used one is last
        return hits.filter((F.col("rank") > offset) & (F.col("rank") <= offset + (limit or top_k)))

    def answer(self, queries: Sequence[str], **options) -> DataFrame:
        if self.ask is None:
            raise EngineError("no answering provider")
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
        return answers.answer(self.query(queries, **options).join(asked, "query_id"), self.ask, budget=self.settings.context_chars)

    def delete(self, source: str) -> int:
        self._forget()
        return self.collection.delete(self.spark.createDataFrame([(source,)], "source string"))

    def documents(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return self.collection.documents().offset(offset).limit(limit)

    def stats(self) -> DataFrame:
        c = self.collection.chunks()
        return c.agg(F.count("*").alias("points"), F.countDistinct("source").alias("sources"), F.coalesce(F.max(F.size("dense")), F.lit(0)).alias("dim"))

    def filter_context(self) -> DataFrame:
        c = self.collection.chunks()
        return filters.discover(c.drop("dense", "contextual_dense", "id"), self.settings.discovery_values)

    def evaluate(self, golden: DataFrame, top_k: int = 5, mode: str = "hybrid", match: str = "basename", rerank: bool = True, ks: tuple[int, ...] | None = None) -> DataFrame:
        """Metrics per query of a golden set (query, expected), at ``top_k`` or at several k."""
        numbered = golden.withColumn("query_id", F.xxhash64("query")).dropDuplicates(["query_id"])
        hits = self.collection.search(numbered.select("query_id", F.col("query").alias("text")), mode, top_k, rerank=rerank)
        name = (lambda c: T.basename(c)) if match == "basename" else (lambda c: c)
        found = hits.groupBy("query_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: name(x["source"]))).alias("retrieved"))
        none = F.array().cast("array<string>")
        both = numbered.join(found, "query_id", "left").select("query_id", F.coalesce("retrieved", none).alias("retrieved"), F.transform("expected", name).alias("expected"))
        return evaluation.all_metrics(both, ks or (top_k,))

    def run(self, golden: DataFrame, name: str, ks: Sequence[int] = (1, 5, 10), **options) -> str:
        """Evaluates a golden set (query, expected, category if there is one) at several k from one search, saves the report as
        run ``name`` and returns its summary."""
        metrics = self.evaluate(golden, max(ks), ks=tuple(ks), **options)
        numbered = golden.withColumn("query_id", F.xxhash64("query")).dropDuplicates(["query_id"])
        category = F.col("category") if "category" in golden.columns else F.lit(None)
        made = metrics.join(numbered.select("query_id", category.cast("string").alias("category")), "query_id").withColumn("run", F.lit(name))
        self.reports.save(report(made))
        return self.reports.summary(name)

    def run_single(self, query: str, expected: Sequence[str] = (), k: int = 5, **options) -> dict:
        """One query's metrics, hits and milliseconds."""
        begun = time.monotonic()
        hits = self.query([query], top_k=k, **options).select("rank", "source", "score").orderBy("rank").collect()
        took = 1000 * (time.monotonic() - begun)
        held = self.spark.createDataFrame([(1, [r["source"] for r in hits], list(expected))], "query_id int, retrieved array<string>, expected array<string>")
        name = lambda c: F.transform(c, T.basename)
        metrics = evaluation.all_metrics(held.withColumns({"retrieved": F.array_distinct(name("retrieved")), "expected": name("expected")}), (k,)).first().asDict() if expected else {}
        metrics.pop("query_id", None)
        return {"query": query, "latency_ms": took, "results_count": len(hits), "results": [r.asDict() for r in hits], **metrics}

    def sweep(self, golden: DataFrame, variants: Sequence[dict]) -> DataFrame:
        """Mean metrics of each variant (name, and options of ``evaluate``), with differences to the first."""
        table = None
        for i, v in enumerate(variants):
            means = evaluation.aggregate(self.evaluate(golden, **{k: x for k, x in v.items() if k != "name"}))
            k = v.get("top_k", 5)
            row = means.select(F.lit(i).alias("nth"), F.lit(v["name"]).alias("name"), F.col("avg_mrr").alias("mrr"), *[F.col(f"avg_{m}_{k}").alias(m) for m in ("hit", "recall", "precision", "ndcg")])
            table = row if table is None else table.unionByName(row)
        base = table.filter("nth = 0").select(*[F.col(m).alias(f"{m}_0") for m in ("mrr", "hit", "recall", "precision", "ndcg")])
        return table.join(F.broadcast(base)).select("name", "nth", *[c for m in ("mrr", "hit", "recall", "precision", "ndcg") for c in (F.col(m), F.round(F.col(m) - F.col(f"{m}_0"), 6).alias(f"{m}_delta"))]).orderBy("nth")


def markdown(hits: DataFrame, limit: int = 25_000) -> DataFrame:
    """(query_id, markdown): hits as a numbered list, cut with a notice beyond ``limit`` characters."""
    line = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.col("source"), F.lit("\n"), F.col("content"))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", T.truncated(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"), limit).alias("markdown"))
