"""Every query of the engine over the test tables, each beside its oracle in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers, chunking, evaluation, filters, layout, metadata, reports, retrieval, sync
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.ivf import VectorIndex
from lodestone.session import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- hashes and identifiers ---------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(doc_id::VARCHAR || ':' || text) AS chunk_hash, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def content_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), T.chunk_hash(F.col("doc_id"), t).alias("chunk_hash"), T.tokens_estimate(t).alias("tokens"))


@query("""
WITH h AS (SELECT doc_id, source, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '_' || doc_id)) AS h, sha1(source) AS g FROM documents)
SELECT doc_id,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[(strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS chunk_uuid,
  g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] AS point_id
FROM h""")
def chunk_uuid(spark, d):
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", T.uuid5(name).alias("chunk_uuid"), T.sha1_uuid(F.col("source")).alias("point_id"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n_copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_docs(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc")).filter("n_copies > 1")


@query("SELECT source, sha256('[' || string_agg('\"' || doc_id || '\"', ', ' ORDER BY doc_id::VARCHAR) || ']')[1:12] AS batch_id FROM documents GROUP BY source")
def batch_ids(spark, d):
    items = F.sort_array(F.collect_list(F.col("doc_id").cast("string")))
    text = F.concat(F.lit('["'), F.array_join(items, '", "'), F.lit('"]'))
    return table(spark, d, "documents").groupBy("source").agg(F.substring(F.sha2(text.cast("binary"), 256), 1, 12).alias("batch_id"))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(content) ORDER BY i) AS nth FROM c)
SELECT doc_id, count(*) AS n_kept, min(i) AS first_kept, max(i) AS last_kept FROM r WHERE nth = 1 GROUP BY doc_id""")
def chunk_dedup(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return dedup_chunks(lines).groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.min("i").cast("long").alias("first_kept"), F.max("i").cast("long").alias("last_kept"))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """The first of equal contents within each document, in order."""
    w = Window.partitionBy("doc_id", T.content_hash(F.col("content"))).orderBy("i")
    return chunks.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


@query("SELECT a.doc_id, a.source FROM documents a WHERE EXISTS (SELECT 1 FROM documents b WHERE b.source = a.source AND sha256(b.text) = sha256(a.text) AND b.doc_id < a.doc_id)")
def already_ingested(spark, d):
    """Documents that an earlier one of the same source and content makes superfluous."""
    docs = table(spark, d, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("h"))
    first = docs.groupBy("source", "h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, ["source", "h"]).filter("doc_id > first").select("doc_id", "source")


@query("""
WITH s AS (SELECT conv_id, count(*) AS stored, max(turn) + 1 AS expected FROM conversations GROUP BY conv_id)
SELECT conv_id, stored, expected, stored > 0 AND expected > 0 AND stored <> expected AS partial FROM s""")
def partial_ingest(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("stored"), (F.max("turn") + 1).alias("expected"))
    return s.withColumn("partial", (F.col("stored") > 0) & (F.col("expected") > 0) & (F.col("stored") != F.col("expected")))


# --- sources and conversion ---------------------------------------------------------------------


@query(r"""
WITH u AS (SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, regexp_matches(url, '^https?://') AS is_url, CASE WHEN name = '' THEN 'document' ELSE name END AS file_name,
  CASE WHEN regexp_extract(name, '\.([^./\\]+)$', 1) = '' THEN 'unknown' ELSE lower(regexp_extract(name, '\.([^./\\]+)$', 1)) END AS format FROM u""")
def url_router(spark, d):
    name = T.url_filename(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"), name.alias("file_name"), T.file_format(name).alias("format"))


@query(r"""
WITH p AS (SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS chars, octet_length(encode(html)) AS n_bytes FROM pages)
SELECT page_id, chars, n_bytes::BIGINT AS n_bytes, chars = 0 OR (chars < 500 AND n_bytes > 5000) OR chars / greatest(n_bytes, 1) < 0.005 AS poor FROM p""")
def poor_quality(spark, d):
    text = F.regexp_replace("html", "<[^>]*>", "")
    n = F.octet_length("html").cast("long")
    return table(spark, d, "pages").select("page_id", F.length(F.trim(text)).cast("long").alias("chars"), n.alias("n_bytes"), T.poor_quality(text, n).alias("poor"))


@query()
def html_to_markdown(spark, d):
    from lodestone.sources.convert import html_to_markdown as convert

    return convert(table(spark, d, "pages").select("page_id", "html"))


# --- chunking and context -----------------------------------------------------------------------

_FIXED = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w), 112)) AS i FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, (i // 112)::INTEGER AS window_no, array_to_string(w[i + 1 : i + 128], ' ') AS content FROM i)
"""


@query(_FIXED + "SELECT doc_id, window_no, length(content) AS n_chars, sha256(content) AS content_hash FROM c WHERE length(content) >= 30")
def fixed_chunks(spark, d):
    made = chunking.fixed_chunks(table(spark, d, "documents"), 128, 16)
    return made.select("doc_id", F.col("window").alias("window_no"), F.length("content").cast("long").alias("n_chars"), T.content_hash(F.col("content")).alias("content_hash"))


@query(_FIXED + "SELECT doc_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars FROM c WHERE length(content) >= 30 GROUP BY doc_id")
def chunk_counts(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents"), 128, 16).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).cast("long").alias("n_chars"))


_BLOCKS = r"""
WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM documents)
"""
_KIND = r"CASE WHEN x LIKE '|%' THEN 'table' WHEN x LIKE '```%' THEN 'code' WHEN x LIKE '#%' THEN 'heading' WHEN regexp_matches(x, '^([-*] |[1-5]\. )') THEN 'list' ELSE 'paragraph' END"


def _markdown(spark, d):
    """Documents with a block for each line."""
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(_BLOCKS + f", e AS (SELECT doc_id, unnest(b) AS x FROM b) SELECT doc_id, {_KIND} AS kind, count(*) AS n, sum(length(x))::BIGINT AS chars FROM e GROUP BY ALL")
def markdown_blocks(spark, d):
    return chunking.blocks(_markdown(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


@query(_BLOCKS + r"""
, s AS (SELECT doc_id, list_transform(b, lambda x: {'out': []::VARCHAR[], 'cur': [x], 'n': length(x)::BIGINT}) AS s FROM b WHERE len(b) > 0),
f AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN a.n + x.n > 1024
   THEN {'out': list_append(a.out, array_to_string(a.cur, chr(10) || chr(10))), 'cur': [right(a.cur[len(a.cur)], 128), x.cur[1]], 'n': (least(length(a.cur[len(a.cur)]), 128) + x.n)::BIGINT}
   ELSE {'out': a.out, 'cur': list_append(a.cur, x.cur[1]), 'n': (a.n + x.n)::BIGINT} END) AS r FROM s),
c AS (SELECT doc_id, list_append(r.out, array_to_string(r.cur, chr(10) || chr(10))) AS c FROM f),
e AS (SELECT doc_id, unnest(c) AS content, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_index FROM c)
SELECT doc_id, chunk_index, length(content) AS n_chars, sha256(content) AS content_hash FROM e""")
def markdown_chunks(spark, d):
    made = chunking.markdown_chunks(_markdown(spark, d))
    return made.select("doc_id", "chunk_index", F.length("content").cast("long").alias("n_chars"), T.content_hash(F.col("content")).alias("content_hash"))


def _layout_sql(size: int = 512) -> str:
    levels = range(1, 7)
    last = ", ".join(f"max(CASE WHEN level = {n} THEN i END) OVER w AS at{n}" for n in levels)
    part = ", ".join(f"CASE WHEN at{n} > greatest(-1, {', '.join(f'coalesce(at{m}, -1)' for m in range(1, n)) or '-1'}) THEN at{n} END" for n in levels)
    return rf"""{_BLOCKS}, o AS (SELECT doc_id, list_transform(b, lambda x: CASE WHEN length(x) % 4 = 0 THEN repeat('#', 1 + (length(x) // 4) % 4) || ' ' || x ELSE x END) AS b FROM b),
e AS (SELECT doc_id, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS i FROM o),
k AS (SELECT *, {_KIND} AS kind, trim(regexp_replace(x, '^#+', '')) AS title FROM e),
l AS (SELECT *, CASE WHEN kind <> 'heading' THEN 0 WHEN regexp_matches(x, '^#{{1,6}}\s') THEN length(regexp_extract(x, '^(#{{1,6}})\s', 1)) ELSE 6 END AS level FROM k),
a AS (SELECT *, {last}, lead(level) OVER (PARTITION BY doc_id ORDER BY i) AS after, sum((level > 0)::INT) OVER w AS section FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, x, kind, level, title, section, list_filter([{part}], lambda n: n IS NOT NULL) AS steps FROM a WHERE level = 0 OR after IS NULL OR (after > 0 AND after <= level)),
s AS (SELECT p.doc_id, p.i, string_agg(h.title, ' > ' ORDER BY h.i) AS path FROM (SELECT doc_id, i, unnest(steps) AS h FROM p) p JOIN l h ON h.doc_id = p.doc_id AND h.i = p.h WHERE h.title <> '' GROUP BY ALL),
q AS (SELECT p.*, coalesce(path, '') AS path, coalesce(sum(length(x)) OVER (PARTITION BY p.doc_id, section ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {size} AS win FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i),
c AS (SELECT doc_id, min(i) AS i, any_value(path) AS section_header, string_agg(CASE WHEN level > 0 THEN title ELSE x END, chr(10) || chr(10) ORDER BY i) AS content, list(kind ORDER BY i) AS kinds FROM q GROUP BY doc_id, section, win)"""


@query(_layout_sql() + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, section_header, length(content) AS n_chars, sha256(content) AS content_hash FROM c")
def layout_chunks(spark, d):
    """Sections of documents (a block for each line), with their paths of headers; the documents have no headings, so lines of some lengths become headings."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rank = lambda x: F.repeat(F.lit("#"), (1 + F.floor(F.length(x) / 4) % 4).cast("int"))
    outlined = F.transform(lines, lambda x: F.when(F.length(x) % 4 == 0, F.concat(rank(x), F.lit(" "), x)).otherwise(x))
    made = layout.layout_chunks(table(spark, d, "documents").select("doc_id", F.array_join(outlined, "\n\n").alias("text")), 512)
    return made.select("doc_id", "chunk_index", "section_header", F.length("content").cast("long").alias("n_chars"), T.content_hash(F.col("content")).alias("content_hash"))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive_chunks(table(spark, d, "documents"), 256, 32)


@query(r"""
WITH c AS (SELECT doc_id, '[Context: ' || lang || ' ' || source || '] ' || text AS content FROM documents)
SELECT doc_id, length(content) AS n_enriched, sha256(regexp_replace(content, '^\[Context:.*?\]\s*', '')) AS stripped_hash FROM c""")
def context_prefix(spark, d):
    prefix = T.context_header(F.concat_ws(" ", "lang", "source"))
    c = T.apply_context(prefix, F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("n_enriched"), T.content_hash(T.strip_context(c)).alias("stripped_hash"))


@query("""
SELECT conv_id, turn, coalesce(right(lag(text) OVER w, 200), '') AS before, left(text, 300) AS content, coalesce(left(lead(text) OVER w, 200), '') AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.coalesce(F.right(F.lag("text").over(w), F.lit(200)), F.lit("")).alias("before"), F.substring("text", 1, 300).alias("content"), F.coalesce(F.substring(F.lead("text").over(w), 1, 200), F.lit("")).alias("after")
    )


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, sha256(array_to_string(list_transform(l, lambda x: ltrim(x)), '|')) AS lines_hash FROM s""")
def numbered_lines(spark, d):
    """A model's numbered answer, made of each document's lines, read back."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, d, "documents").select("doc_id", lines.alias("l"))
    said = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise(") "), x)), "\n")
    read = T.numbered_lines(said, F.size("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), T.content_hash(F.array_join(read, "|")).alias("lines_hash"))


# --- metadata -----------------------------------------------------------------------------------

_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"


def _sql_list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


@query(f"""
WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), 'https?://[^\\s<>"'']+', ' ', 'g'), '{T.EMAIL}', ' ', 'g') AS text FROM documents),
t AS (SELECT doc_id, {_TERMS} AS t FROM b),
w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS place FROM t),
n AS (SELECT doc_id, word, count(*) AS n, min(place) AS place FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN ({_sql_list(metadata.STOPWORDS)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS nth FROM n)
SELECT doc_id, string_agg(word, ',' ORDER BY nth) AS keywords FROM r WHERE nth <= 10 GROUP BY doc_id""")
def keywords_top10(spark, d):
    return metadata.keywords(table(spark, d, "documents")).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(rf"""
SELECT doc_id, length(regexp_extract(text, '^(#{{1,6}})\s+', 1))::BIGINT AS heading_level, regexp_matches(text, '^\s*[-*\d]+[.)]\s') AS is_list, contains(text, '```') OR starts_with(text, '    ') AS is_code,
  length(text) - length(replace(text, '|', '')) >= 3 AS is_table, length(text) AS char_count, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word_count,
  len(regexp_extract_all(text, 'https?://[^\s<>"'']+')) AS link_count, len(regexp_extract_all(text, '{T.EMAIL}')) AS email_count, len(regexp_extract_all(text, '{T.PHONE}')) AS phone_count
FROM documents""")
def structural_meta(spark, d):
    return metadata.structural(table(spark, d, "documents"))


def _language_sql() -> str:
    hits = ", ".join(f"len(list_filter(t, lambda x: x IN ({_sql_list(sorted(set(w.split())))}))) AS {c}" for c, w in sorted(metadata.LANGUAGE_WORDS.items()))
    return f"WITH t AS (SELECT doc_id, lang, text, {_TERMS} AS t FROM documents), h AS (SELECT doc_id, lang, length(trim(text)) AS n, {hits} FROM t), g AS (SELECT doc_id, lang, CASE WHEN n < 20 OR greatest(de, en, es, fr) = 0 THEN '' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS guess FROM h) "


@query(_language_sql() + "SELECT doc_id, lang, guess FROM g")
def language_guess(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", metadata.language(F.col("text")).alias("guess"))


@query(_language_sql() + "SELECT lang, guess, count(*) AS n FROM g GROUP BY ALL")
def language_confusion(spark, d):
    return language_guess(spark, d).groupBy("lang", "guess").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.EMAIL}')) AS emails, len(regexp_extract_all(text, '{T.PHONE}')) AS phones FROM documents WHERE regexp_matches(text, '{T.EMAIL}') OR regexp_matches(text, '{T.PHONE}')")
def pii_counts(spark, d):
    m = metadata.structural(table(spark, d, "documents"))
    return m.filter("email_count + phone_count > 0").select("doc_id", F.col("email_count").alias("emails"), F.col("phone_count").alias("phones"))


@query("""
WITH l AS (SELECT event_id, event_type, ' ' || upper(event_type) || ' Report' AS said FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'report' WHEN event_id % 3 = 1 THEN 'unknown' ELSE 'other' END AS doc_type FROM l""")
def classify_document(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" Report"))).when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.lit("??"))
    return table(spark, d, "events").select("event_id", metadata.doc_type(said).alias("doc_type"))


# --- retrieval ----------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _asked(spark, d):
    """The stated query set: vectors whose id is divisible by 100."""
    return _vectors(spark, d).filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vec", F.col("label").alias("query_label"))


def _dense_sql(k: int = 30, more: str = "", half: bool = False) -> str:
    v = "embedding[1:32]::DOUBLE[]" if half else "embedding::DOUBLE[]"
    return f"""s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.{v}, c.{v}), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 {more}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s), top AS (SELECT * FROM r WHERE rank <= {k})"""


@query(f"WITH {_dense_sql()} SELECT query_id, id, score, rank::INTEGER AS rank FROM top")
def dense_topk(spark, d):
    return retrieval.dense_topk(_asked(spark, d), _vectors(spark, d), 30)


@query(f"WITH {_dense_sql(10, 'AND c.label IN (1, 3, 5)')} SELECT query_id, id, score, rank::INTEGER AS rank FROM top")
def dense_topk_filtered(spark, d):
    v = _vectors(spark, d)
    return retrieval.dense_topk(_asked(spark, d), v, 10, filters.build(v, {"label": [1, 3, 5]}))


@query("SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0")
def cosine_matrix_rows(spark, d):
    """The stated query set's rows of the matrix, each against all rows of ``embeddings``."""
    return retrieval.dense_scores(_asked(spark, d), _vectors(spark, d)).withColumnRenamed("score", "similarity")


_BM25 = f"""
t AS (SELECT doc_id AS id, {_TERMS} AS t FROM documents), p AS (SELECT id, unnest(t) AS term, len(t) AS dl FROM t),
tf AS (SELECT id, term, count(*) AS tf, first(dl) AS dl FROM p GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark),
bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs), btop AS (SELECT * FROM br WHERE rank <= 30)"""


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_BM25} SELECT id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(dl) AS dl FROM tf GROUP BY id")
def bm25_postings(spark, d):
    return retrieval.postings(_texts(spark, d)).groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("dl").alias("dl"))


@query(f"WITH {_BM25} SELECT term, df FROM df")
def bm25_df(spark, d):
    return retrieval.document_frequency(retrieval.postings(_texts(spark, d)))


@query(f"WITH {_BM25} SELECT query_id, id, score, rank::INTEGER AS rank FROM btop")
def bm25_topk(spark, d):
    return retrieval.bm25_topk(_items(spark, d), _texts(spark, d), 30)


@query(f"WITH {_BM25} SELECT query_id, id, score, rank::INTEGER AS rank FROM btop")
def bm25_index_topk(spark, d):
    """The same from a persisted index over all documents."""
    index = InvertedIndex(spark, workspace(spark, "inverted"))
    index.add(_texts(spark, d))
    return index.search(_items(spark, d), 30)


@query()
def ivf_topk(spark, d):
    """The stated query set against all vectors by an inverted file; its recall is held against ``dense_topk`` in tests."""
    index = VectorIndex(spark, workspace(spark, "ivf"))
    index.build(_vectors(spark, d))
    return index.search(_asked(spark, d), 30)


def _fuse_sql(lists: list[str], offset: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS list FROM {t}" for i, t in enumerate(lists))
    shift = "coalesce((SELECT sum(z.n) FROM sizes z WHERE z.query_id = u.query_id AND z.list < u.list), 0)" if offset else "0"
    return f"""u AS ({rows}), sizes AS (SELECT query_id, list, count(*) AS n FROM u GROUP BY ALL), c AS (SELECT *, {shift} AS shift FROM u),
m AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank + shift)), 9) AS score, min({{'l': list, 'r': rank}}) AS f FROM c GROUP BY query_id, id),
fr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, id)::INTEGER AS rank FROM m)"""


def _named(cte: str, suffix: str) -> str:
    """The dense CTEs under other names, for a second list."""
    return cte.replace("s AS (", f"s{suffix} AS (", 1).replace("FROM s)", f"FROM s{suffix})").replace("r AS (SELECT *", f"r{suffix} AS (SELECT *").replace("top AS (SELECT * FROM r WHERE", f"top{suffix} AS (SELECT * FROM r{suffix} WHERE")


_TWO = f"{_dense_sql()}, {_named(_dense_sql(half=True), '2')}"


def _contextual(df):
    return df.withColumn("vec", F.slice("vec", 1, 32))


def _two_lists(spark, d):
    v, q = _vectors(spark, d), _asked(spark, d)
    return [retrieval.dense_topk(q, v, 30), retrieval.dense_topk(_contextual(q), _contextual(v), 30)]


@query(f"WITH {_TWO}, {_fuse_sql(['top', 'top2'], False)} SELECT * FROM fr")
def rrf_standard(spark, d):
    return retrieval.fuse(_two_lists(spark, d))


@query(f"WITH {_TWO}, {_fuse_sql(['top', 'top2'], True)} SELECT * FROM fr")
def rrf_offset(spark, d):
    return retrieval.fuse(_two_lists(spark, d), mode="offset")


@query(f"WITH {_TWO}, {_named(_dense_sql(10, 'AND c.label IN (1, 3, 5)'), '3')}, {_fuse_sql(['top', 'top2', 'top3'], True)} SELECT * FROM fr WHERE rank <= 10")
def rrf_multi_query(spark, d):
    return retrieval.fuse([*_two_lists(spark, d), dense_topk_filtered(spark, d)], mode="offset").filter("rank <= 10")


_LEX = f"""
lx AS (SELECT b.query_id, b.id, b.rank, q.t AS qt, t.t AS dt FROM btop b JOIN t ON t.id = b.id JOIN (SELECT item_id AS query_id, list_distinct({_TERMS}) AS t FROM benchmark) q USING (query_id)),
ls AS (SELECT query_id, id, rank, CASE WHEN len(qt) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(qt, lambda x: list_contains(dt, x))) / len(qt), 6) END AS rerank_score FROM lx),
lr AS (SELECT query_id, id, rank::INTEGER AS rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INTEGER AS new_rank FROM ls)"""


def _reranked(spark, d):
    hits = bm25_topk(spark, d)
    # With few items, their hits go to the documents, which are then not shuffled.
    hits = F.broadcast(hits) if _items(spark, d).count() <= retrieval.BLOCK else hits
    hits = _texts(spark, d).select("id", F.col("text").alias("content")).join(hits, "id").join(_items(spark, d).select("query_id", F.col("text").alias("query")), "query_id")
    return retrieval.rerank(hits, retrieval.lexical_score(F.col("query"), F.col("content")))


@query(f"WITH {_BM25}, {_LEX} SELECT * FROM lr")
def rerank_lexical(spark, d):
    return _reranked(spark, d).select("query_id", "id", "rank", "rerank_score", "new_rank")


@query(f"WITH {_BM25}, {_LEX} SELECT query_id, id, new_rank AS rank FROM lr WHERE new_rank > 5 AND new_rank <= 10")
def page_results(spark, d):
    return retrieval.page(_reranked(spark, d).select("query_id", "id", F.col("new_rank").alias("rank")), 5, 5)


@query(f"""
WITH RECURSIVE {_dense_sql(20)},
sim AS (SELECT a.query_id, a.id AS a, b.id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS v FROM top a JOIN top b USING (query_id) JOIN embeddings x ON x.vec_id = a.id JOIN embeddings y ON y.vec_id = b.id),
pick AS (SELECT DISTINCT query_id, 0 AS n, []::BIGINT[] AS sel FROM top
  UNION ALL SELECT p.query_id, p.n + 1, list_append(p.sel, z.id) FROM pick p JOIN LATERAL (
    SELECT t.id FROM top t LEFT JOIN sim m ON m.query_id = t.query_id AND m.a = t.id AND list_contains(p.sel, m.b)
    WHERE t.query_id = p.query_id AND NOT list_contains(p.sel, t.id) GROUP BY t.id, t.score, t.rank
    ORDER BY round(0.5 * t.score - 0.5 * coalesce(max(m.v), 0), 9) DESC, t.rank LIMIT 1) z ON true WHERE p.n < 5)
SELECT query_id, (unnest(range(0, 5)))::INTEGER AS place, unnest(sel) AS id FROM pick WHERE n = 5""")
def mmr_select(spark, d):
    v = _vectors(spark, d)
    return retrieval.mmr(retrieval.dense_topk(_asked(spark, d), v, 20), v.select("id", "vec"), 5)


@query("SELECT source, count(*) AS n_chunks, arg_min(lang, doc_id) AS lang, min(doc_id) AS first_doc, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def list_documents(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_chunks"), F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("first_doc"), F.sum("n_chars").alias("n_chars"))


@query("SELECT count(*) AS n_points, min(len(embedding))::BIGINT AS least_dim, max(len(embedding))::BIGINT AS most_dim, count(DISTINCT label) AS n_labels FROM embeddings")
def collection_stats(spark, d):
    n = F.size("embedding")
    return table(spark, d, "embeddings").agg(F.count("*").alias("n_points"), F.min(n).cast("long").alias("least_dim"), F.max(n).cast("long").alias("most_dim"), F.countDistinct("label").alias("n_labels"))


# --- filters ------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def filter_scalar(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(filters.build(docs, {"lang": "DE"}, source="src3")).select("doc_id", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND lower(source) IN ('src1', 'src2')")
def filter_any(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(filters.build(docs, {"lang": ["DE", "fr"], "source": ("SRC1", "src2")})).select("doc_id", "lang", "source")


@query("SELECT conv_id, len(list_distinct(list(role))) AS n_roles FROM conversations GROUP BY conv_id HAVING list_contains(list(role), 'system')")
def filter_array(spark, d):
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return convs.filter(filters.build(convs, {"roles": "SYSTEM"})).select("conv_id", F.size("roles").cast("long").alias("n_roles"))


@query("""
WITH v AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'doc_id', doc_id::VARCHAR FROM documents UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM documents),
u AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS nth FROM (SELECT DISTINCT field, value FROM v WHERE value IS NOT NULL AND value <> '')),
c AS (SELECT field, count(*) AS n_rows FROM v WHERE value IS NOT NULL AND value <> '' GROUP BY field)
SELECT field, any_value(n_rows) AS n_rows, count(*) AS n_values, string_agg(value, '|' ORDER BY value) FILTER (nth <= 100) AS sample FROM u JOIN c USING (field) GROUP BY field""")
def field_discovery(spark, d):
    return filters.discover(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))


@query("SELECT * FROM (VALUES ('vec_id', 'integer'), ('embedding', 'list'), ('label', 'integer')) t(field, kind)")
def field_types(spark, d):
    return spark.createDataFrame(list(filters.field_types(table(spark, d, "embeddings")).items()), "field string, kind string")


@query(r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '([^/]*)$', 1)) AS base FROM pages)
SELECT page_id, lower(regexp_extract('C:\x\' || base, '([^/\\]*)$', 1)) = base AND url <> '' AS by_basename, false AS by_exact, contains(lower(url), base) AND url <> '' AS by_contains FROM p""")
def source_match_modes(spark, d):
    base = F.regexp_extract("url", "([^/]*)$", 1)
    asked = F.concat(F.lit("C:\\x\\"), F.upper(base))
    return table(spark, d, "pages").select("page_id", filters.match_source(asked, F.col("url")).alias("by_basename"), filters.match_source(asked, F.col("url"), "exact").alias("by_exact"), filters.match_source(F.upper(base), F.col("url"), "contains").alias("by_contains"))


# --- evaluation ---------------------------------------------------------------------------------

def _eval_sql(half: bool = False) -> str:
    return f"""{_dense_sql(10, half=half)},
ret AS (SELECT query_id, list(id ORDER BY rank) AS r FROM top GROUP BY query_id),
exp AS (SELECT q.vec_id AS query_id, any_value(q.label) AS label, list(c.vec_id) AS e FROM embeddings q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id),
g AS (SELECT query_id, label, r, e, list_transform(r, lambda x: list_contains(e, x)) AS h FROM ret JOIN exp USING (query_id)),
met AS (SELECT query_id, label, round(coalesce(1.0 / nullif(list_position(h, true), 0), 0), 6)::DOUBLE AS mrr, {", ".join(
    f"len(list_filter(h[1:{k}], lambda x: x)) AS c{k}, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(len(e), {k}) + 1) t(i)) AS i{k}, list_sum(list_transform(h[1:{k}], lambda x, i: CASE WHEN x THEN 1 / log2(i + 1) ELSE 0 END)) AS d{k}" for k in (1, 5, 10))}, len(e) AS n_e FROM g),
mm AS (SELECT query_id, label, mrr, {", ".join(f"CASE WHEN c{k} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_{k}, round(c{k} / n_e, 6) AS recall_{k}, round(c{k} / {k}, 6) AS precision_{k}, round(d{k} / i{k}, 6) AS ndcg_{k}" for k in (1, 5, 10))} FROM met)"""


_EVAL = _eval_sql()
_NAMES = ["mrr", *[f"{m}_{k}" for k in (1, 5, 10) for m in ("hit", "recall", "precision", "ndcg")]]
_AVG = ", ".join(f"round(avg({n}), 6) AS avg_{n}" for n in _NAMES)


def _evaluated(spark, d, k: int = 10, half: bool = False):
    v, q = _vectors(spark, d), _asked(spark, d)
    cut = (lambda df: df.withColumn("vec", F.slice("vec", 1, 32))) if half else (lambda df: df)
    own = q.select("query_id", F.col("query_label").alias("label"))
    members = v.filter("label is not null").select("id", "label").distinct()
    # A query expects all others of its label: their number, and those of them that were retrieved.
    hits = retrieval.dense_topk(cut(q), cut(v), k).join(own, "query_id").join(members.withColumn("same", F.lit(True)), ["id", "label"], "left")
    top = hits.groupBy("query_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"), F.collect_set(F.when(F.col("same") & (F.col("id") != F.col("query_id")), F.col("id"))).alias("expected"))
    sizes = members.groupBy("label").agg((F.count("*") - 1).cast("int").alias("n_expected"))
    return top.join(sizes, "label").filter("n_expected > 0").drop("label")


@query(f"WITH {_EVAL} SELECT query_id, {', '.join(_NAMES)} FROM mm")
def metrics_all(spark, d):
    return evaluation.all_metrics(_evaluated(spark, d))


@query(f"WITH {_EVAL} SELECT count(*) AS n_queries, {_AVG} FROM mm")
def metrics_aggregate(spark, d):
    return evaluation.aggregate(metrics_all(spark, d))


@query(f"WITH {_EVAL} SELECT label, count(*) AS n_queries, {_AVG} FROM mm GROUP BY label")
def eval_by_category(spark, d):
    labels = _asked(spark, d).select("query_id", F.col("query_label").alias("label"))
    return evaluation.aggregate(metrics_all(spark, d).join(labels, "query_id"), ["label"])


def _runs_sql() -> str:
    one = lambda run, half: f"SELECT * FROM (WITH {_eval_sql(half)} SELECT '{run}' AS run, label::VARCHAR AS category, {', '.join(_NAMES)} FROM mm)"
    cells = " UNION ALL ".join(f"SELECT run, category, '{n.rpartition('_')[0] or n}' AS metric, {n.rpartition('_')[2] if '_' in n else 0} AS k, {n}::DOUBLE AS value FROM m" for n in _NAMES)
    return f"""m AS ({one("half", True)} UNION ALL {one("whole", False)}), l AS ({cells}),
g AS (SELECT run, category, metric, k, CASE WHEN grouping(category) + grouping(k) = 0 THEN 'run_category_k' WHEN grouping(k) = 0 THEN 'run_k' WHEN grouping(category) = 0 THEN 'run_category' ELSE 'run' END AS level,
  count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM l GROUP BY GROUPING SETS ((run, category, metric, k), (run, metric, k), (run, category, metric), (run, metric)))"""


def _runs(spark, d) -> DataFrame:
    labels = _asked(spark, d).select("query_id", F.col("query_label").cast("string").alias("category"))
    one = lambda run, half: evaluation.all_metrics(_evaluated(spark, d, half=half)).withColumn("run", F.lit(run))
    return one("half", True).unionByName(one("whole", False)).join(labels, "query_id")


@query(f"WITH {_runs_sql()} SELECT * FROM g")
def run_reports(spark, d):
    """Two runs, over half and whole vectors, at four levels in one pass, saved and read back."""
    store = reports.ReportStore(spark, workspace(spark, "reports"))
    store.save(reports.report(_runs(spark, d)))
    return store.reports().drop("at")


@query(f"""WITH {_runs_sql()} SELECT o.run, o.level, o.category, o.metric, o.k, b.mean AS base, o.mean, round(o.mean - b.mean, 6) AS delta, round(CASE WHEN b.mean = 0 THEN 0 ELSE 100 * (o.mean - b.mean) / b.mean END, 4) AS delta_pct
FROM g o JOIN g b ON o.run = 'whole' AND b.run = 'half' AND o.level = b.level AND o.category IS NOT DISTINCT FROM b.category AND o.metric = b.metric AND o.k IS NOT DISTINCT FROM b.k""")
def run_deltas(spark, d):
    made = reports.report(_runs(spark, d))
    return reports.deltas(made.filter("run = 'whole'"), made.filter("run = 'half'"))


@query(f"""WITH {_EVAL}, a AS (SELECT round(avg(hit_5), 6) AS h, round(avg(recall_5), 6) AS r, round(avg(precision_5), 6) AS p, round(avg(ndcg_5), 6) AS n, round(avg(hit_10), 6) AS h2, round(avg(recall_10), 6) AS r2, round(avg(precision_10), 6) AS p2, round(avg(ndcg_10), 6) AS n2 FROM mm),
l AS (SELECT unnest(['avg_hit', 'avg_recall', 'avg_precision', 'avg_ndcg']) AS metric, unnest([h, r, p, n]) AS base, unnest([h2, r2, p2, n2]) AS other FROM a)
SELECT metric, base, other, round(other - base, 6) AS delta, round(CASE WHEN base = 0 THEN 0 ELSE 100 * (other - base) / base END, 4) AS delta_pct FROM l""")
def ab_compare(spark, d):
    """Results cut at 5 against results cut at 10."""
    a = metrics_aggregate(spark, d)
    at = lambda k: a.select(*[F.col(f"avg_{m}_{k}").alias(f"avg_{m}") for m in ("hit", "recall", "precision", "ndcg")])
    return evaluation.compare(at(5), at(10))


@query(f"""
WITH k AS (SELECT item_id, text AS t0, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS kw FROM benchmark)
SELECT b.item_id, k.item_id AS other, CASE WHEN len(kw) = 0 THEN 1.0 ELSE round(len(list_filter(kw, lambda w: contains(lower(b.text), w))) / len(kw), 6) END AS coverage
FROM benchmark b JOIN k ON k.item_id // 10 = b.item_id // 10""")
def keyword_coverage(spark, d):
    """Each item's text against the terms of the items of its ten; retrieved content is in ``keyword_coverage_retrieved``."""
    items = table(spark, d, "benchmark").withColumn("ten", F.floor(F.col("item_id") / 10))
    other = items.select("ten", F.col("item_id").alias("other"), F.array_distinct(T.terms(F.col("text"))).alias("kw"))
    return items.join(other, "ten").select("item_id", "other", F.round(evaluation.keyword_coverage(F.col("text"), F.col("kw")), 6).alias("coverage"))


@query(f"""
WITH {_BM25}, c AS (SELECT query_id, string_agg(d.text, chr(10)) AS content, count(*) AS n_hits FROM btop JOIN documents d ON d.doc_id = btop.id GROUP BY query_id),
k AS (SELECT item_id, list_distinct({_TERMS}) AS kw FROM benchmark)
SELECT item_id, coalesce(n_hits, 0) AS n_hits, CASE WHEN len(kw) = 0 THEN 1.0 ELSE round(len(list_filter(kw, lambda w: contains(lower(coalesce(content, '')), w))) / len(kw), 6) END AS coverage FROM k LEFT JOIN c ON query_id = item_id""")
def keyword_coverage_retrieved(spark, d):
    """Each item's terms against the contents of all its BM25 hits."""
    hits = bm25_topk(spark, d).select("query_id", "id")
    # With few items, their hits go to the documents, which are then not shuffled.
    hits = F.broadcast(hits) if _items(spark, d).count() <= retrieval.BLOCK else hits
    found = _texts(spark, d).select("id", "text").join(hits, "id")
    content = found.groupBy("query_id").agg(F.array_join(F.collect_list("text"), "\n").alias("content"), F.count("*").alias("n_hits"))
    items = _items(spark, d).select("query_id", F.array_distinct(T.terms(F.col("text"))).alias("kw")).join(content, "query_id", "left")
    coverage = evaluation.keyword_coverage(F.coalesce("content", F.lit("")), F.col("kw"))
    return items.select(F.col("query_id").alias("item_id"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.round(coverage, 6).alias("coverage"))


@query("""
WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(v), 2) AS avg_ms, round(max(v) FILTER (i = least(n * 50 // 100, n - 1)), 2) AS p50_ms, round(max(v) FILTER (i = least(n * 95 // 100, n - 1)), 2) AS p95_ms,
  round(max(v) FILTER (i = least(n * 99 // 100, n - 1)), 2) AS p99_ms, round(min(v), 2) AS min_ms, round(max(v), 2) AS max_ms FROM r GROUP BY event_type""")
def latency_percentiles(spark, d):
    return evaluation.percentiles(table(spark, d, "events"), "event_type", "value")


@query("SELECT user_id, count(*) AS n_requests, count(*) FILTER (event_type = 'view') AS n_hits, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate FROM events GROUP BY user_id")
def cache_hit_rate(spark, d):
    hits = F.count_if(F.col("event_type") == "view")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_requests"), hits.alias("n_hits"), F.round(hits / F.count("*"), 6).alias("hit_rate"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 1000")
def timing_ring(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("nth", F.row_number().over(w)).filter("nth <= 1000").select("event_type", "event_id", "value")


# --- answers ------------------------------------------------------------------------------------


@query("""
WITH h AS (SELECT conv_id, turn + 1 AS rank, role, text, '[' || (turn + 1) || '] Source: ' || role || chr(10) AS head FROM conversations),
RECURSIVE_INPUT AS (SELECT conv_id, list({'head': head, 'text': text} ORDER BY rank) AS l FROM h GROUP BY conv_id),
s AS (SELECT conv_id, list_prepend({'parts': []::VARCHAR[], 'room': 1500::BIGINT, 'head': '', 'text': ''}, list_transform(l, lambda x: {'parts': []::VARCHAR[], 'room': 0::BIGINT, 'head': x.head, 'text': x.text})) AS l FROM RECURSIVE_INPUT),
f AS (SELECT conv_id, list_reduce(l, lambda a, x: CASE WHEN a.room <= 0 THEN a ELSE {'parts': list_append(a.parts, x.head || CASE WHEN length(x.text) <= a.room - length(x.head) THEN x.text ELSE rtrim(left(x.text, greatest(a.room - length(x.head) - 12, 200)::BIGINT)) || chr(10) || '[truncated]' END),
  'room': (a.room - 2 - length(x.head) - CASE WHEN length(x.text) <= a.room - length(x.head) THEN length(x.text) ELSE length(rtrim(left(x.text, greatest(a.room - length(x.head) - 12, 200)::BIGINT))) + 12 END)::BIGINT, 'head': '', 'text': ''} END) AS r FROM s)
SELECT conv_id AS query_id, array_to_string(r.parts, chr(10) || chr(10)) AS context, len(r.parts)::BIGINT AS n_used FROM f""")
def pack_context(spark, d):
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("source"), F.col("text").alias("content"))
    return answers.pack_context(hits, 1500)


_SAID = "CASE WHEN turn % 4 = 1 THEN 'insufficient_context: ' || left(text, 60 * (turn % 3)) WHEN turn % 4 = 3 THEN '' ELSE text END"


@query(f"WITH a AS (SELECT conv_id, turn, trim({_SAID}) AS a FROM conversations) SELECT conv_id, turn, a = '' OR (contains(lower(a), 'insufficient_context') AND length(a) < 140) AS refused FROM a")
def refusal(spark, d):
    said = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("insufficient_context: "), F.substring(F.col("text"), F.lit(1), (60 * (F.col("turn") % 3)).cast("int")))).when(F.col("turn") % 4 == 3, "").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.is_refusal(said).alias("refused"))


_MARKED = r"regexp_replace(text, '\.(\s|$)', ' [' || (turn + 1) || '].\1', 'g') || ' [' || (turn % 3) || '] [9]'"


def _marked(spark, d):
    n = F.col("turn")
    marked = F.concat(F.regexp_replace(F.col("text"), F.lit(r"\.(\s|$)"), F.concat(F.lit(" ["), (n + 1).cast("string"), F.lit("].$1"))), F.lit(" ["), (n % 3).cast("string"), F.lit("] [9]"))
    return table(spark, d, "conversations").select("conv_id", "turn", marked.alias("a"))


@query(rf"""
WITH a AS (SELECT conv_id, turn, {_MARKED} AS a FROM conversations),
c AS (SELECT conv_id, turn, a, list_transform(regexp_extract_all(a, '\[(\d+)\]', 1), lambda x: x::INTEGER) AS n FROM a)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_distinct(n), lambda x: x BETWEEN 1 AND 5), lambda x: x::VARCHAR).list_sort(), ',') AS cited,
  sha256(trim(regexp_replace(regexp_replace(a, '\[(0|[6-9]|\d\d+)\]', '', 'g'), ' {{2,}}', ' ', 'g'))) AS answer_hash FROM c""")
def citations(spark, d):
    five = F.lit(5)
    cited = F.array_join(F.sort_array(F.transform(answers.valid_citations(F.col("a"), five), lambda x: x.cast("string"))), ",")
    return _marked(spark, d).select("conv_id", "turn", cited.alias("cited"), T.content_hash(answers.without_invalid(F.col("a"), five)).alias("answer_hash"))


@query(rf"""
WITH a AS (SELECT conv_id, turn, {_MARKED} AS a FROM conversations),
s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM a)
SELECT conv_id, turn, len(s) AS n_sentences, CASE WHEN len(s) = 0 THEN 0.0 ELSE round(len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]'))) / len(s), 6) END AS confidence FROM s""")
def citation_confidence(spark, d):
    return _marked(spark, d).select("conv_id", "turn", F.size(T.sentences(F.col("a"))).cast("long").alias("n_sentences"), F.round(answers.confidence(F.col("a")), 6).alias("confidence"))


@query("""
WITH r AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)
SELECT conv_id AS query_id, string_agg(role, ',' ORDER BY first) AS sources, false AS refused FROM r GROUP BY conv_id""")
def answer_sources(spark, d):
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("source"), F.col("text").alias("content"), F.lit("q").alias("query"))
    said = answers.answer(hits, lambda q, context: F.concat(F.substring(context, 1, 300), F.lit(" [1]")))
    return said.select("query_id", F.array_join("sources", ",").alias("sources"), "refused")


# --- sync and status ----------------------------------------------------------------------------

_LISTING = """
cur AS (SELECT 'f' || doc_id AS source, sha256(text) AS h FROM documents WHERE lang <> 'fr'),
old AS (SELECT 'f' || doc_id AS source, CASE WHEN quality = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents JOIN labels USING (doc_id)),
act AS (SELECT coalesce(cur.source, old.source) AS source, CASE WHEN cur.source IS NULL THEN 'delete' WHEN old.source IS NULL THEN 'ingest' WHEN cur.h = old.h THEN 'unchanged' ELSE 'update' END AS action FROM cur FULL JOIN old ON cur.source = old.source)"""


def _listing(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source"), T.content_hash(F.col("text")).alias("hash"), "lang", "doc_id")
    old = docs.join(table(spark, d, "labels"), "doc_id").select("source", F.when(F.col("quality") == 0, F.lit("x")).otherwise(F.col("hash")).alias("hash"))
    return docs.filter("lang <> 'fr'").select("source", "hash"), old


@query(f"WITH {_LISTING} SELECT source, action FROM act")
def reconcile_actions(spark, d):
    return sync.reconcile(*_listing(spark, d))


@query(f"WITH {_LISTING} SELECT action, count(*) AS n FROM act GROUP BY action")
def sync_stats(spark, d):
    return sync.stats(reconcile_actions(spark, d))


@query(f"WITH {_LISTING} SELECT source, 'keep' AS action FROM old")
def deletion_guard(spark, d):
    """An empty listing deletes nothing."""
    current, stored = _listing(spark, d)
    return sync.reconcile(current.filter("false"), stored)


@query("SELECT source, arg_min(nullif(lang, ''), doc_id) AS hash FROM documents GROUP BY source")
def stored_hashes(spark, d):
    rows = table(spark, d, "documents").select("source", F.lit("").alias("file_content_hash"), F.col("lang").alias("content_hash"), F.col("doc_id").alias("chunk_index"))
    return sync.stored_hashes(rows)


_STATUS = """
ev AS (SELECT user_id AS source, ts, event_id, CASE hash_no WHEN 0 THEN 'processing' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'retry' WHEN 4 THEN 'skipped' ELSE 'pending' END AS status, value FROM (SELECT *, event_id % 7 AS hash_no FROM events)),
last AS (SELECT source, max({'ts': ts, 'event_id': event_id, 'status': status}) AS e FROM ev GROUP BY source)"""


def _events(spark, d):
    no = F.col("event_id") % 7
    status = F.coalesce(*[F.when(no == i, F.lit(s)) for i, s in enumerate(("processing", "done", "failed", "retry", "skipped"))], F.lit("pending"))
    return table(spark, d, "events").select(F.col("user_id").alias("source"), "ts", "event_id", status.alias("status"), "value")


@query(f"WITH {_STATUS} SELECT source, e.status AS status, e.event_id AS event_id FROM last")
def status_latest(spark, d):
    return sync.latest(_events(spark, d)).select("source", "status", "event_id")


@query(f"WITH {_STATUS}, z AS (SELECT unnest(['pending', 'processing', 'done', 'failed', 'retry', 'skipped']) AS status) SELECT z.status, count(last.source) AS n FROM z LEFT JOIN last ON last.e.status = z.status GROUP BY z.status")
def status_summary(spark, d):
    return sync.summary(status_latest(spark, d))


_LEGAL = " OR ".join(f"(previous = '{a}' AND status IN ({_sql_list(to)}))" for a, to in sync.TRANSITIONS.items())


@query(f"WITH {_STATUS}, st AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY source ORDER BY ts, event_id), 'pending') AS previous FROM ev) SELECT source, event_id, previous, status FROM st WHERE NOT (({_LEGAL}) OR status = 'pending')")
def illegal_transitions(spark, d):
    return sync.steps(_events(spark, d)).filter("not legal").select("source", "event_id", "previous", "status")


@query(f"WITH {_STATUS}, w AS (SELECT source, event_id, ts + INTERVAL 1 SECOND * ([60, 300, 1800, 7200])[least(event_id % 6, 3) + 1] AS next_retry_at FROM ev WHERE status = 'retry') SELECT source, event_id FROM w WHERE next_retry_at <= (SELECT max(ts) FROM events)")
def due_retries(spark, d):
    e = _events(spark, d)
    planned = e.withColumn("next_retry_at", F.col("ts") + F.make_dt_interval(secs=sync.backoff_s(F.col("event_id") % 6)))
    now = planned.agg(F.max("ts").alias("now"))
    return sync.due(planned.join(F.broadcast(now)), F.col("now")).select("source", "event_id")


@query("""
SELECT event_id, (event_id % 6)::BIGINT AS attempts, ([60, 300, 1800, 7200])[least(event_id % 6, 3) + 1]::INTEGER AS wait_s,
  event_id % 6 < 4 AND CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS again FROM events""")
def retry_backoff(spark, d):
    n, kind = F.col("event_id") % 6, F.col("event_id") % 4
    error = F.when(kind == 0, "ServiceUnavailableError").when(kind == 1, "CorruptedDocumentError").otherwise("Error")
    message = F.when(kind == 1, "timeout").when(kind == 2, "HTTP 503 Gateway").otherwise("bad header")
    return table(spark, d, "events").select("event_id", n.alias("attempts"), sync.backoff_s(n).alias("wait_s"), sync.should_retry(error, message, n).alias("again"))


@query(f"WITH {_STATUS} SELECT source, 'failed' AS status FROM last WHERE e.status = 'processing' AND e.ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def stale_processing(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return sync.stale(sync.latest(e).join(F.broadcast(now)), F.col("now")).select("source", "status")


@query("SELECT event_id, CASE WHEN p <= 72 THEN 'Converting' WHEN p <= 74 THEN 'Context' WHEN p <= 76 THEN 'Metadata' WHEN p <= 89 THEN 'Embedding' ELSE 'Storing' END AS stage FROM (SELECT event_id, event_id % 101 AS p FROM events)")
def stage_mapping(spark, d):
    return table(spark, d, "events").select("event_id", sync.stage_of(F.col("event_id") % 101).alias("stage"))


# --- event time, relational extras --------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n_events FROM s GROUP BY user_id, session""")
def user_sessions(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n_events"))
    return s.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n_events")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS sum_disc_price, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter("l_shipdate <= DATE '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("sum_disc_price"), F.count("*").alias("n"))
