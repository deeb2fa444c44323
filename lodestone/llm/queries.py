"""The queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import binary_ids, bpe, chat, divergence, jaccard, licenses, mixing, packing, prefix_trie, quality, secrets, telephony, warc
from lodestone.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3: what the mix takes of each."""
    return mixing.takes(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with verdicts by ownership."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


#: Conversation -1: texts made of other templates' control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, then read back from the formatted string."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as response records, derived to metadata and conversion records, read back."""
    return warc.summary(warc.derive(warc.responses(_table(spark, sf_dir, "pages"))))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as binary records and read back from the files."""
    folder, index = shared_folder(spark, "ids"), shared_folder(spark, "ids-index")
    binary_ids.write(_table(spark, sf_dir, "documents"), folder, _vocabulary("byte_bpe_50k.json"), end_id=2)
    return binary_ids.build_index(spark, folder, index).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over every document."""
    return quality.judge(_table(spark, sf_dir, "documents"))


def op8_quality_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, without their failing lines."""
    cleaned = quality.filter_documents(_table(spark, sf_dir, "documents"), clean=True)
    return cleaned.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents that 5-word shingles link at 0.8."""
    return jaccard.link_groups(_table(spark, sf_dir, "documents"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as mu-law, A-law and ADPCM files, decoded and resampled; files and samples written, then read back."""
    folder = shared_folder(spark, "media")
    stored = telephony.with_pcm(telephony.as_wave(_table(spark, sf_dir, "documents")))
    stored.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(folder)
    return telephony.features(spark.read.parquet(folder))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by ranks, and decoded again from the ids."""
    import public_tokenizers

    made = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, by pairs and by terms."""
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, forked from the heads of their blocks."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"), forked=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_secrets": op2_secrets,
        "op3_chat": op3_chat,
        "op4_licenses": op4_licenses,
        "op5_warc": op5_warc,
        "op6_packing": op6_packing,
        "op7_binary_ids": op7_binary_ids,
        "op8_quality": op8_quality,
        "op8_quality_text": op8_quality_text,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_telephony": op10_telephony,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_divergence": op12_divergence,
        "op13_prefix_trie": op13_prefix_trie,
    }


_OP1 = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s GROUP BY source),
w AS (SELECT *, ([1.0, 2.0, 3.0]::DOUBLE[])[(rank - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM p),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight, sum(cap) OVER o AS capped, sum(weight) OVER o AS capped_weight FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, CASE WHEN all_weight > capped_weight THEN (total - capped) / (all_weight - capped_weight) END AS after FROM f),
v AS (SELECT coalesce(arg_max(after, capped_weight) FILTER (after >= cap / weight), any_value(total / all_weight)) AS level FROM a),
t AS (SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN least(least(cap, level * weight) / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate FROM a, v),
f2 AS (SELECT *, rate - floor(rate) AS fraction FROM t),
u AS (SELECT s.doc_id, s.size, f2.*, r AS number, ('0x' || md5('{mixing.SEED}:' || r || ':' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM s JOIN f2 ON f2.source IS NOT DISTINCT FROM s.source, range({mixing.SEEDS}) q(r)),
x AS (SELECT *, floor(u * {mixing.TURNS})::INT AS enters, floor((u - fraction + CASE WHEN u < fraction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * {mixing.TURNS})::INT AS leaves FROM u),
e AS (SELECT source, number, enters AS cell, size AS net, CASE WHEN u < fraction THEN size ELSE 0 END AS first FROM x WHERE fraction > 0 AND size > 0 UNION ALL SELECT source, number, leaves, -size, 0 FROM x WHERE fraction > 0 AND size > 0),
k AS (SELECT source, number, cell, sum(net) AS net, sum(first) AS first FROM e GROUP BY ALL),
n AS (SELECT source, number, cell, sum(net) OVER (PARTITION BY source, number ORDER BY cell DESC) + sum(first) OVER (PARTITION BY source, number) AS words FROM k),
b AS (SELECT source, number, turn FROM (SELECT n.source, number, cell AS turn, row_number() OVER (PARTITION BY n.source ORDER BY abs(words::DOUBLE - fraction * source_size), number, cell) AS nth FROM n JOIN f2 ON f2.source IS NOT DISTINCT FROM n.source) WHERE nth = 1),
c AS (SELECT x.*, floor(rate)::BIGINT + (enters >= coalesce(turn, 0))::BIGINT - (leaves >= coalesce(turn, 0))::BIGINT + (u < fraction)::BIGINT AS copies
  FROM x LEFT JOIN b ON b.source IS NOT DISTINCT FROM x.source WHERE x.number = coalesce(b.number, 0))
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, rate FROM c"""



def _op2() -> str:
    """Matches of each kind by splitting and running sums of lengths; then verdicts by distinct owners and repositories."""
    found = []
    for no, (kind, _, pattern, group, least) in enumerate((*secrets.BASE_KINDS, secrets.ADDED)):
        quoted = pattern.replace("'", "''")
        found.append(f"""SELECT r, {no} AS no, '{kind}' AS kind, unnest(string_split_regex(t, '{quoted}')) AS piece, unnest(regexp_extract_all(t, '{quoted}')) AS whole,
    unnest(regexp_extract_all(t, '{quoted}', {group})) AS part, generate_subscripts(string_split_regex(t, '{quoted}'), 1) AS i, {least} AS least FROM d""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(found)}),
p AS (SELECT *, sum(length(piece) + coalesce(length(whole), 0)) OVER (PARTITION BY r, no ORDER BY i)::BIGINT AS e FROM m),
s AS (SELECT r, no, kind, part, e - length(whole) AS b, e FROM p WHERE whole IS NOT NULL AND length(part) >= least
  AND (no < {len(secrets.BASE_KINDS)} OR (regexp_matches(part, '[0-9]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]')))),
o AS (SELECT part, count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) AS n_repos, count(DISTINCT coalesce('=' || source, 'null')) AS n_owners FROM s JOIN d USING (r) GROUP BY part),
v AS (SELECT r, no, b, kind || ':' || b || ':' || e AS said, NOT (n_owners >= {secrets.EXAMPLE_OWNERS} AND n_repos >= {secrets.EXAMPLE_REPOS}) AS live FROM s JOIN o USING (part))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY b, no) FILTER (no < {len(secrets.BASE_KINDS)}), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY b, no) FILTER (no < {len(secrets.BASE_KINDS)} OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM d LEFT JOIN v USING (r) GROUP BY r"""


_OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(role) + 5 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\])')) + 5))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g2, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
e AS (SELECT r, unnest(l) AS x, generate_subscripts(l, 1) = len(l) AS is_last FROM w),
f AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, regexp_matches(x, '[.!?:;。！？…]["''”’»)\]]*\s*$') AS ends,
  len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(x, '[|»›•·]|\s>\s')) AS seps, len(regexp_extract_all(x, '!!')) AS shouts FROM e),
lost AS (SELECT r, sum(CASE WHEN words > 0 AND ((NOT (ends OR is_last OR (words >= {quality.LONG_LINE} AND regexp_matches(x, '[.!?]\s'))) OR symbols * 20 > greatest(length(x), 1) OR shouts * 2 > words)
   OR (words < {quality.NAVIGATION_WORDS} AND NOT ends AND NOT is_last) OR (seps >= {quality.SEPARATORS} AND seps * 4 > words)
   OR (regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}') AND words < 30)) THEN length(x) ELSE 0 END)::BIGINT AS lost,
   count(*) FILTER (words > 0) - count(DISTINCT x) FILTER (words > 0) AS dups FROM f GROUP BY r),
o AS (SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, dups AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, lost AS lost_chars
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {quality.MAX_LOST_PERCENT} * length(t) AS kept, lost_chars FROM o"""

_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 80 * (u.n + v.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.root) AS component_id FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""


_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS nn FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (nn + v) AS p FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM y WHERE part = 'pair' OR rank <= 200"""

#: CRC-32 of a decimal number: the bits of each byte shifted through the fixed polynomial.
_OP13 = r"""
WITH RECURSIVE o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o2 AS (SELECT c, length(text) AS chars, md5(length(role)::VARCHAR || ':' || role || text) AS t, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS i FROM o),
z AS (SELECT DISTINCT c, c::VARCHAR AS s, 4294967295::BIGINT AS crc, 0 AS step FROM o
  UNION ALL SELECT c, s, CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END, step + 1
  FROM (SELECT c, s, step, CASE WHEN step % 8 = 0 THEN xor(crc, ascii(s[step // 8 + 1])::BIGINT) ELSE crc END AS b FROM z WHERE step < 8 * length(s))),
h AS (SELECT c, c - ((c % 100) + 100) % 100 AS p, xor(crc, 4294967295::BIGINT) % 6 AS h FROM z WHERE step = 8 * length(s)),
r AS (SELECT h.c, 0 AS own, i, t, chars FROM h JOIN o2 ON o2.c = h.p AND i <= h UNION ALL SELECT h.c, 1, i, t, chars FROM h JOIN o2 ON o2.c = h.c AND i > h),
s AS (SELECT c, t, chars, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM r),
m AS (SELECT c, d, chars, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS k, string_agg(t, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up, d = count(*) OVER (PARTITION BY c) AS ends FROM s
  UNION ALL SELECT c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM s WHERE s.c = h.c) FROM h),
n AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars, any_value(CASE WHEN d > 0 THEN coalesce(up, '') END) AS up, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM m GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT n.k, n.d, m.k AS above, coalesce(kids.n, 0) = 0 AS leaf, (n.n - 1) * n.chars AS saved FROM n JOIN m ON m.c = n.c AND m.d <= n.d LEFT JOIN kids ON kids.k = n.k),
t AS (SELECT above AS k, count(*) FILTER (leaf) AS leaves, sum(saved) AS saved FROM a GROUP BY above)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, n.e AS ends_sha256
FROM n JOIN t USING (k) LEFT JOIN kids ON kids.k = n.k LEFT JOIN n u ON u.k = n.up"""


def oracle_sql() -> dict[str, str]:
    """Oracles of those that SQL can express; the others are tested against brute force."""
    return {"op1_mixing": _OP1, "op2_secrets": _op2(), "op3_chat": _OP3, "op8_quality": _OP8, "op9_ngram_jaccard": _OP9, "op12_divergence": _OP12, "op13_prefix_trie": _OP13}
