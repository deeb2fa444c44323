"""How far the sources of a language are apart, term by term, in exact whole numbers.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents, V of them. A group (a source of a
language) with N occurrences of them in all gives a term that it has n times p = 1 + floor(SCALE (n + 1) / (N + V)).
What a term adds to the divergence of p from q is f = floor((p - q)^2 / q). Two reports: each source against
each other one, summed over all kept terms; each source against its language, by term.

Terms that have the same counts in all sources are the same column of counts. They are grouped by 128
bits of their sparse vector of (source, count), which are sums over its entries, so no vector is gathered in
one row. Each pair of sources is evaluated once for each distinct vector and multiplied by the number of its
terms. Most entries are zero, so a pair starts from V terms that neither has::

    V f(0, 0) + sum over a's entries of f(a, 0) - f(0, 0) + sum over b's entries of f(0, b) - f(0, 0)
              + sum over vectors that both have of f(a, b) - f(a, 0) - f(0, b) + f(0, 0)

where the second and third sums need a's and b's distinct counts alone. Terms are ranked by their vectors
first; only vectors that can be among the first ``TOP`` are resolved to their terms.

Texts are counted in Arrow batches, (language, source, term) summed within a batch and again before the shuffle.
p and products stay within 64 bits: p is at most SCALE + 1, and no sum exceeds its square; a sum
that did would raise, not wrap.

Defined results: null text, language and source are empty strings; repeated rows are documents of
their own; a source without kept terms has a report against others all the same, of p = 1 + floor(SCALE / V);
a language without kept terms has pairs of value 0; ties go by the item's bytes; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, column, compacted, prepare, small_enough, tidy

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text that are split at a time (memory, not results).
SLICE = 4 << 20
#: What is between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_VECTOR = ["lang", "h0", "h1", "h2", "h3"]


def _counts_of(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some texts; the empty term stands for each group itself."""
    groups = pa.StructArray.from_arrays([lang, source], ["l", "s"])
    pair = pc.binary_join_element_wise(pc.cast(pc.binary_length(lang), pa.string()), lang, source, ":").dictionary_encode()
    group = pair.indices.to_numpy().astype(np.int64)
    terms = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    row = np.repeat(np.arange(len(text)), np.diff(terms.offsets.to_numpy()))
    coded = terms.flatten().dictionary_encode()
    width = len(coded.dictionary) + 1
    key, times = np.unique(row * width + coded.indices.to_numpy() + 1, return_counts=True)
    within, where = np.unique(group[key // width] * width + key % width, return_inverse=True)
    docs = np.bincount(where, minlength=len(within))
    n = np.bincount(where, times, len(within)).astype(np.int64)
    first = np.zeros(len(pair.dictionary), np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    of = groups.take(pa.array(first[within // width]))
    return pa.RecordBatch.from_arrays([of.field("l"), of.field("s"), coded.dictionary.take(pa.array(within % width - 1)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
            yield _counts_of(*(batch.column(i).slice(begin, end - begin) for i in range(3)))
            begin = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, also of the empty term, which each text has
    before, between or after its terms."""
    prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(column(docs, c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # An empty text splits into one empty string, so each group has the empty term once at least.
    ended = rows.withColumn("text", F.concat("text", F.lit(" ")))
    partial = ended.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact for all counts of 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    made = F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1)
    return 1 + F.call_function("div", made, wide(total + terms))


def _f(p: str | Column, q: str | Column) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _entries(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept (lang, source, term, n, all: the lang's n, first: one entry of each term, the term's vector), groups (lang, source))."""
    by = Window.partitionBy("lang", "term")
    digest = F.md5(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("source")).cast("binary"))
    parts = {f"h{i}": F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")).over(by) for i in range(4)}
    counted = term_counts(docs)
    held = counted.withColumn("kept", F.when(F.col("term") != "", F.sum("docs").over(by) >= MIN_DOCS))
    held = held.filter("kept is null or kept").withColumns({**parts, "all": F.sum("n").over(by), "first": F.col("source") == F.min("source").over(by)})
    out = checkpointed(held.select("source", "term", "n", "all", "first", *_VECTOR))
    return out.filter("term <> ''"), out.filter("term = ''").select("lang", "source")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df) else df


def divergences(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: of each source, all others of its language, and
    the ``top`` terms that it has more of than its language."""
    kept, groups = _entries(docs)
    per_lang = kept.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("terms"), F.sum("n").alias("all_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sized = groups.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("all_total"))
    # p of a term that the group has not; a language without terms has none.
    of = compacted(sized.withColumn("p0", F.when(F.col("terms") > 0, _p(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)))
    known = _bounded(of)

    # Distinct vectors: each entry once, with the number of its terms.
    vectors = kept.groupBy(*_VECTOR, "source").agg(F.max("n").alias("n"), F.max("all").alias("all"), F.count("*").alias("copies"))
    vectors = compacted(vectors.join(known, ["lang", "source"]).select(*_VECTOR, "source", "n", "copies", "p0", _p(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _p(F.col("all"), F.col("all_total"), F.col("terms")).alias("q")))

    item = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "terms")
    base = of.select("lang", "source", "p0").join(item, "lang").filter("source <> item").select("lang", "source", "item", (F.col("terms") * _f("p0", "q0")).alias("value"))
    # Entries that one of the two has: by the group's distinct counts.
    counts = compacted(vectors.groupBy("lang", "source", "p", "p0").agg(F.sum("copies").alias("copies")))
    one = counts.join(item, "lang").filter("source <> item")
    having = one.select("lang", "source", "item", (F.col("copies") * (_f("p", "q0") - _f("p0", "q0"))).alias("value"))
    lacking = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("copies") * (_f("q0", "p") - _f("q0", "p0"))).alias("value"))
    # Entries that both have: each pair once for each distinct vector.
    right = vectors.select(*_VECTOR, F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    both = vectors.join(right, _VECTOR).filter("source <> item").select("lang", "source", "item", (F.col("copies") * (_f("p", "r") - _f("p", "r0") - _f("p0", "r") + _f("p0", "r0"))).alias("value"))
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (base, having, lacking, both)]
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    within = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(within).alias("rank"))

    # A vector with that many better ones has no term among the first.
    over = vectors.filter("p > q").select(*_VECTOR, "source", _f("p", "q").alias("value"))
    best = over.withColumn("nth", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))).filter(F.col("nth") <= top).drop("nth")
    named = kept.select(*_VECTOR, "source", "term").join(compacted(best), [*_VECTOR, "source"])
    terms = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
