"""Exact n-gram Jaccard join by PartEnum signatures, and its groups.

Sets are a text's distinct word shingles (64-bit hashes). Two sets link when their Jaccard
similarity reaches ``PERCENT``. Linked sets of sizes s <= t differ in at most (s + t) / 9
elements, and t lies in the size band of s or the next one.

Signatures. Each band's instance splits the domain into ``n1`` groups of ``n2`` partitions.
Linked sets differ in at most ``k`` elements, so of the groups all but k // (k2 + 1) have at most
``k2`` differences, and in each of those some n2 - k2 partitions are equal: every subset of that
many partitions gives one signature, a hash of the elements in it. A set joins its own band's
instance and the one below. ``slack`` more groups mean that linked sets share slack + 1
signatures at least.

Frequent signatures. A signature of no, few or common shingles is shared by many unrelated
sets. Those without elements are not signed by a set that has no more of them than the slack;
they are taken off its slack. A set in no more runs of over ``RUN`` sets than the rest of its
slack leaves those runs. So linked sets lose no more shared signatures than the slack of the set
that leaves, and one in a small run remains. Sets in more large runs (large groups of near copies)
may leave as many as their rest, the largest, and meet in the others as candidate groups. Where a
pair's small runs, and either set's large runs and signatures without elements, are too few for
a link, it goes.

Candidates are verified on the sets themselves. First each large run's sets meet one of them;
what this links is one component, and pairs of small runs within a component go before they
are verified. Large runs within one component are then done with, and sets that
have no more of the others than the slack leave. What is left are candidate groups. Each is
compared with one center, and groups that this makes one component go. In the others, members not
linked to the center are compared in blocks with those whose distance to the center differs by 0.2 at most (Jaccard
distance is a metric), by a matrix product per pair of blocks. A pair of blocks gives a
spanning forest of the components that it joins, not all its links.

One pass over the texts makes sets and signatures. Copies of a set within a task sign once, and
signatures travel in packed chunks: a row per batch and hash bucket. Equal sets are one class
from then on. Links, components and classes stay in tables.

Defined results: null or empty texts and texts without words have no shingle and are alone; a
text of fewer words is one shingle; repeated rows and equal texts are one class; a null id is
never smaller than a number, and a group without numbers has null; an empty table gives an
empty result; other columns, whatever their names, pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import combinations as subsets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import carried, checkpointed, column, compacted, prepare, restored, small_enough, tidy
from lodestone.llm.components import components

WORDS, PERCENT = 5, 80
#: Sets in a run of equal signatures that are paired off; larger runs go by candidate groups.
RUN = 8
#: Elements of a block of sets that is compared as a matrix.
BLOCK = 1 << 17
#: Turns in which pairs are verified (disk, not results).
TURNS = 2
#: Tasks that sort signatures, for each shuffle partition: they hold all of theirs in memory.
SPREAD = 4
_BATCH = 500
#: Elements of sets that are signed at a time.
_ELEMENTS = 50_000
_KEEP_WORDS = 60_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads them (splitmix64's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Word to 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEEP_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(text: bytes | None, words: Words, n: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the shingles of a text in UTF-8."""
    found = (text or b"").lower().split()  # of bytes: A-Z and the six blanks of ASCII alone
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(words.__getitem__, found), _U, len(found))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, _U)
    for k in range(size):
        out = (out ^ h[k : k + len(out)]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return np.unique(mix(out))


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Bands:
    """Size bands and each band's instance: lower ends, n1, scheme, slack."""

    def __init__(self, most: int = 1 << 40):
        low, self.low, self.n1, self.deep, self.slack = 1, [], [], [], []
        while low < most:
            high = low * 100 // PERCENT
            k = high * (100 - PERCENT) // PERCENT  # (s + t) / 9 at s = high, t = 1.25 s
            deep = k <= 12  # two differences a group; else one
            groups = k // (3 if deep else 2) + 1
            slack = groups // 4 + 2 * (groups >= 6)
            self.low.append(low)
            self.n1.append(groups + slack if k else 0)  # no difference: equal sets only
            self.deep.append(deep)
            self.slack.append(slack)
            low = high + 1
        self.low, self.n1, self.deep, self.slack = (np.array(v) for v in (self.low, self.n1, self.deep, self.slack))

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1


BANDS = Bands()
#: (partitions of a group, of which so many are left out of a signature)
SCHEMES = {True: (5, 2), False: (3, 1)}


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, number of each one's set, and rows of set, instance, signatures without elements).

    The instance's number is a signature's low byte. Those without elements are left out, unless
    a set has more of them than its slack.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if sets else np.empty(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    halves = [(h & _U(0xFFFFFFFF)).astype(float), (h >> _U(32)).astype(float)]
    spread = mix(h ^ _U(0x51ED2701A9C4F7B3))
    group_of, part_of = spread >> _U(32), spread & _U(0xFFFFFFFF)
    sig, of, without = [], [], [np.empty((3, 0), np.int64)]
    for down in (0, 1):
        instance = BANDS.of(sizes) - down
        n1 = np.where(instance >= 0, BANDS.n1[np.maximum(instance, 0)], 0)
        for deep, (n2, out) in SCHEMES.items():
            jobs = np.flatnonzero((BANDS.deep[np.maximum(instance, 0)] == deep) & (n1 > 0))
            if not len(jobs):
                continue
            base = np.zeros(len(sets), np.int64)
            base[jobs] = np.cumsum(n1[jobs]) - n1[jobs]
            chosen = np.zeros(len(sets), bool)
            chosen[jobs] = True
            some = chosen[owner]
            own = owner[some]
            group = base[own] + (group_of[some] % n1[own].astype(_U)).astype(np.int64)
            cell = group * n2 + (part_of[some] % _U(n2)).astype(np.int64)
            total = int(n1[jobs].sum())
            low, high = (np.bincount(cell, x[some], total * n2).astype(_U) for x in halves)
            sums = (low + (high << _U(32))).reshape(total, n2)
            full = np.bincount(cell, minlength=total * n2).reshape(total, n2)
            whole, size = sums.sum(1, dtype=_U), full.sum(1)
            job = np.repeat(jobs, n1[jobs])
            place = (np.arange(total) - base[job]).astype(_U) * _U(16)
            cuts = list(subsets(range(n2), out))
            empty = np.stack([size == sum(full[:, p] for p in left_out) for left_out in cuts], 1)
            number_empty = np.bincount(job, empty.sum(1), len(sets)).astype(np.int64)
            dropped = np.zeros(len(sets), bool)
            dropped[jobs] = number_empty[jobs] <= BANDS.slack[instance[jobs]]
            some_empty = jobs[(number_empty[jobs] > 0) & dropped[jobs]]
            without.append(np.stack([some_empty, instance[some_empty], number_empty[some_empty]]))
            for number, left_out in enumerate(cuts):
                kept = whole - sum(sums[:, p] for p in left_out)
                tag = mix((place + _U(number)) * _U(256) + instance[job].astype(_U))
                stays = ~(empty[:, number] & dropped[job])
                sig.append(((mix(kept ^ tag) & ~_U(255)) | instance[job].astype(_U))[stays])
                of.append(job[stays])
    without = np.concatenate(without, 1)
    if not sig:
        return np.empty(0, _U), np.empty(0, np.int64), without
    return np.concatenate(sig), np.concatenate(of), without


def _signed_in_parts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signatures`` of some sets at a time, so that its many counts are of few sets (memory, not results)."""
    cuts = [0]
    for i, n in enumerate(np.cumsum([len(s) for s in sets])):
        if n > len(cuts) * _ELEMENTS:
            cuts.append(i + 1)
    cuts.append(len(sets))
    parts = []
    for i, j in zip(cuts, cuts[1:]):
        if j > i or not sets:
            sig, of, without = signatures(sets[i:j])
            without[0] += i
            parts.append((sig, (of + i).astype(np.int32), without))
    return tuple(np.concatenate(x, -1) for x in zip(*parts))


_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("e", pa.int64()), ("f", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
_ROW_SQL = "kind int, bucket bigint, a bigint, b bigint, c bigint, d bigint, e bigint, f bigint, x binary, y binary"
#: Kinds: a document (a: row, b: doc_id, c and d: digest, e: text hash, f: size), a chunk (a: first
#: row, x: signatures, y: rows from there), a pair (a, b: rows, c: instance, d: signatures that they
#: share in small runs), a large run's member (a: row, b: signature),
#: signatures without elements (a: row, b: instance, c: how many).
DOC, CHUNK, PAIR, MEMBER, EMPTY = range(5)


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    arrays = []
    for f in _ROW:
        if f.name == "kind":
            arrays.append(pa.array(np.full(n, kind, np.int32)))
        elif f.name in columns:
            given = columns[f.name]
            arrays.append(given if isinstance(given, pa.Array) else pa.array(given, f.type))
        else:
            arrays.append(pa.nulls(n, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ROW)


def _signed(buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, words, seen = TaskContext.get().partitionId() << 40, Words(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                ids, texts = (batch.column(i).slice(at, _BATCH) for i in (0, 1))
                sets = [shingles(t.as_py(), words) for t in texts]
                found = [digest(s) for s in sets]
                sizes = np.array([len(s) for s in sets])
                yield _rows(DOC, len(sets), bucket=-1 - np.arange(len(sets)), f=sizes, a=np.arange(row, row + len(sets)), b=ids, c=[f[0] for f in found], d=[f[1] for f in found], e=batch.column(2).slice(at, _BATCH))
                first = []
                for i, f in enumerate(found):
                    if f not in seen:
                        seen.add(f)
                        first.append(i)
                sig, of, without = _signed_in_parts([sets[i] for i in first])
                if without.shape[1]:
                    yield _rows(EMPTY, without.shape[1], bucket=-1 - without[0], a=row + np.array(first, np.int64)[without[0]], b=without[1], c=without[2])
                # A run of this batch's signatures for each bucket.
                bucket = ((sig >> _U(40)) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = np.array(first, "<u2")[of[order]] if first else np.empty(0, "<u2")
                sig, full = sig[order].astype("<u8"), np.flatnonzero(np.diff(cuts))
                spans = [(cuts[b], cuts[b + 1]) for b in full]
                if spans:
                    yield _rows(CHUNK, len(spans), bucket=full, a=np.full(len(spans), row), x=[sig[i:j].tobytes() for i, j in spans], y=[rows[i:j].tobytes() for i, j in spans])
                row += len(sets)

    return run


@tidy
def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a partition to runs of equal signatures: pairs of small ones, members of large ones."""
    sigs, rows = [], []
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        if len(passing := np.flatnonzero((kinds == DOC) | (kinds == EMPTY))):
            yield batch.take(pa.array(passing))
        for i in np.flatnonzero(kinds == CHUNK):
            sigs.append(np.frombuffer(batch.column("x")[i].as_buffer(), "<u8"))
            rows.append(np.frombuffer(batch.column("y")[i].as_buffer(), "<u2").astype(np.int64) + batch.column("a")[i].as_py())
    if not sigs:
        return
    sig, row = np.concatenate(sigs), np.concatenate(rows)
    del sigs, rows, batch
    order = np.argsort(sig, kind="stable").astype(np.int32 if len(sig) < 1 << 31 else np.int64)
    sig, row = sig[order], row[order]
    del order
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[begin, len(sig)])
    triples = [np.empty((3, 0), np.int64)]
    for n in range(2, RUN + 1):
        at = begin[size == n]
        instance = (sig[at] & _U(255)).astype(np.int64)
        for i, j in subsets(range(n), 2):
            x, y = row[at + i], row[at + j]
            triples.append(np.stack([np.minimum(x, y), np.maximum(x, y), instance]))
    met = np.concatenate(triples, 1)
    met = met[:, np.lexsort(met)]
    new = np.flatnonzero(np.r_[True, (met[:, 1:] != met[:, :-1]).any(0)]) if met.shape[1] else np.empty(0, np.int64)
    times = np.diff(np.r_[new, met.shape[1]])
    for at in range(0, len(new), 50_000):
        part = met[:, new[at : at + 50_000]]
        yield _rows(PAIR, part.shape[1], a=part[0], b=part[1], c=part[2], d=times[at : at + 50_000])
    large = np.repeat(size > RUN, size)
    sig, row = sig[large], row[large]
    for at in range(0, len(sig), 50_000):
        yield _rows(MEMBER, len(sig[at : at + 50_000]), a=row[at : at + 50_000], b=sig[at : at + 50_000].view(np.int64))


@tidy
def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once in a task, however often its row is repeated."""
    words, seen = Words(), set()
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            part = batch.slice(at, _BATCH)
            keep, made = [], []
            for i, (rep, c, d, text) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)), part.column(3))):
                if rep in seen:
                    continue
                s = shingles(text.as_py(), words)
                if digest(s) == (c, d):  # another text of this id may have the same hash
                    seen.add(rep)
                    keep.append(i)
                    made.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(made, pa.binary())], ["rep", "elements"])


def _similar(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both, len(a) + len(b) - both


@tidy
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) to (a, b, distance, linked)."""
    for batch in batches:
        distance, linked = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            both, union = _similar(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U))
            distance.append(1 - both / union)
            linked.append(100 * both >= PERCENT * union)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "distance", "linked"])


def _incidence(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(common)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(common, s)
        at[at == len(common)] = 0
        out[i, at[common[at] == s]] = 1
    return out


def linked_between(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Places (i, j) of all linked pairs of two lists of sets, by products over shared elements."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    if not len(common):
        return np.empty((0, 2), np.int64)
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    inter = np.zeros((len(left), len(right)), np.float32)
    step = max(1, 4_000_000 // max(len(left), len(right)))
    for at in range(0, len(common), step):
        inter += _incidence(left, common[at : at + step]) @ _incidence(right, common[at : at + step]).T
    both = np.round(inter).astype(np.int64)
    return np.argwhere(100 * both >= PERCENT * (sizes[0][:, None] + sizes[1][None, :] - both))


def forest(left: list[int], right: list[int], hits: np.ndarray) -> list[tuple[int, int]]:
    """Of the hits (places in left and right), as few as join the same roots: no more than there are roots."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for i, j in {(left[p], right[q]): None for p, q in hits.tolist() if left[p] != right[q]}:
        a, b = top(i), top(j)
        if a != b:
            above[a] = b
            out.append((i, j))
    return out


@tidy
def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of (root, elements) to (a, b): roots that their links join."""
    for batch in batches:
        for i in range(batch.num_rows):
            roots = [batch.column(k)[i].values.field("root").to_pylist() for k in (0, 1)]
            if len({*roots[0], *roots[1]}) == 1:
                continue
            sets = [[np.frombuffer(e.as_buffer(), _U) for e in batch.column(k)[i].values.field("elements")] for k in (0, 1)]
            found = forest(*roots, linked_between(*sets))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _to_reps(rows: DataFrame, rep_of: DataFrame, name: str) -> DataFrame:
    return rows.join(rep_of.select(F.col("row").alias(name), F.col("rep").alias(f"{name}_rep")), name).drop(name).withColumnRenamed(f"{name}_rep", name)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("elements").alias(f"{name}_set")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")


def _key(docs: DataFrame):
    """(doc_id, text, text_key): what a row of ``docs`` is known by."""
    text = column(docs, "text").cast("string")
    return column(docs, "doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row, doc_id, text_key, n_shingles, root (its component), checkpointed.

    root is a row number of the component, null for a set without elements.
    """
    spark = prepare(docs.sparkSession)
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*_key(docs))
    signed = rows.select("doc_id", "text", "text_key").mapInArrow(_signed(buckets), _ROW_SQL)
    made = checkpointed(signed.repartition(buckets, "bucket").mapInArrow(_paired, _ROW_SQL).coalesce(buckets // SPREAD))
    del signed
    _free(spark)  # the signatures' shuffle files are done with
    docs_ = made.filter(F.col("kind") == DOC).select(F.col("a").alias("row"), F.col("b").alias("doc_id"), F.col("e").alias("text_key"), F.col("f").alias("n_shingles"), "c", "d")
    reps = compacted(docs_.filter("n_shingles > 0").groupBy("c", "d").agg(F.min("row").alias("rep"), F.min_by("doc_id", "row").alias("rep_doc"), F.min_by("text_key", "row").alias("rep_key"), F.min("n_shingles").alias("n"), F.count("*").alias("copies")))
    # A class of one row is its own representative; only the others need the join.
    many = compacted(reps.filter("copies > 1").select("c", "d", "rep"))
    rep_of = compacted(docs_.join(many, ["c", "d"], "left").select("row", "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "row")).alias("rep")))
    roots = _roots(rows, made, reps, rep_of.select("row", "rep", F.col("n_shingles").alias("n")), reps.select("rep", "n"))
    return compacted(rep_of.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("row", "doc_id", "text_key", "n_shingles", F.coalesce("root", "rep").alias("root")))


def _free(spark) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(rep, elements) of the needed sets, made anew from their texts, which id and text hash find."""
    side = F.broadcast(needed) if small_enough(needed) else needed
    texts = rows.join(side, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("rep", "c", "d", "text")
    made = checkpointed(texts.mapInArrow(_with_set, "rep bigint, elements binary"))
    if made.count() > needed.count():  # rows repeated over several tasks
        made = checkpointed(made.groupBy("rep").agg(F.first("elements").alias("elements")))
    return made


def _rarest(held: DataFrame) -> DataFrame:
    """Large runs that each set stays in: sets that share more of them than ``spare`` still share
    one if each leaves ``spare`` of its own, the largest first, in one order for all."""
    sizes = compacted(held.groupBy("sig").agg(F.count("*").alias("size")))
    own = Window.partitionBy("rep", "instance")
    ranked = held.join(sizes, "sig")
    ranked = ranked.withColumn("nth", F.row_number().over(own.orderBy("size", "sig"))).withColumn("all", F.count("*").over(own))
    return ranked.filter(F.col("nth") <= F.col("all") - F.col("spare")).filter("size > 1").select("rep", "sig", "runs")


def _roots(rows: DataFrame, made: DataFrame, reps: DataFrame, rep_of: DataFrame, sized: DataFrame) -> DataFrame:
    """(node, root) of all representatives that have a link."""
    spark = rows.sparkSession
    members = made.filter(F.col("kind") == MEMBER).select(F.col("a").alias("row"), F.col("b").alias("sig"), F.col("b").bitwiseAND(255).alias("instance"))
    bands = spark.createDataFrame([(i, int(low), int(slack)) for i, (low, slack) in enumerate(zip(BANDS.low, BANDS.slack))], "instance bigint, low bigint, slack bigint")
    without = made.filter(F.col("kind") == EMPTY).select(F.col("a").alias("row"), F.col("b").alias("instance"), F.lit(0).cast("long").alias("runs"), F.col("c").alias("empty"))
    counted = members.groupBy("row", "instance").agg(F.count("*").alias("runs")).withColumn("empty", F.lit(0).cast("long")).unionByName(without)
    runs = compacted(counted.groupBy("row", "instance").agg(F.sum("runs").alias("runs"), F.sum("empty").alias("empty")))

    # Linked sets share more signatures of the smaller one's band than its slack. Not seen in
    # small runs are shared large runs and those without elements, no more than either set has.
    pairs = made.filter(F.col("kind") == PAIR).groupBy("a", "b", F.col("c").alias("instance")).agg(F.sum("d").alias("shared"))
    of = lambda name: rep_of.select(F.col("row").alias(name), F.col("rep").alias(f"{name}_rep"), F.col("n").alias(f"{name}_n"))
    had = lambda name: runs.select(F.col("row").alias(name), "instance", F.col("runs").alias(f"{name}_runs"), F.col("empty").alias(f"{name}_empty"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").filter("a_rep <> b_rep").filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * PERCENT)
    ends = F.lead("low").over(Window.orderBy("low"))
    pairs = pairs.join(F.broadcast(bands.withColumn("end", F.coalesce(ends, F.lit(1 << 62)))), "instance").filter((F.least("a_n", "b_n") >= F.col("low")) & (F.least("a_n", "b_n") < F.col("end")))
    both = lambda what: F.least(F.coalesce(f"a_{what}", F.lit(0)), F.coalesce(f"b_{what}", F.lit(0)))
    pairs = pairs.join(had("a"), ["a", "instance"], "left").join(had("b"), ["b", "instance"], "left").filter(F.col("shared") + both("runs") + both("empty") > F.col("slack"))
    pairs = compacted(pairs.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct())

    # Pairs that meet in no small run share more large runs than the slack has left. First each
    # large run's sets meet one of them, that with most large runs: the likeliest original.
    heavy = compacted(runs.join(F.broadcast(bands), "instance").withColumn("spare", F.col("slack") - F.col("empty")).filter("runs > spare").select("row", "instance", "runs", "spare"))
    held = _to_reps(members.join(heavy, ["row", "instance"]).select("row", "instance", "sig", "runs", "spare"), rep_of, "row")
    held = compacted(held.groupBy(F.col("row").alias("rep"), "instance", "sig").agg(F.max("runs").alias("runs"), F.max("spare").alias("spare")))
    first = compacted(_rarest(held).groupBy("sig").agg(F.max_by("rep", F.struct("runs", -F.col("rep"))).alias("center")))
    tried = _rarest(held).join(first, "sig").filter("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"))
    tried = compacted(tried.distinct())
    out = "a bigint, b bigint, distance double, linked boolean"
    nodes = pairs.unionByName(tried).select(F.explode(F.array("a", "b")).alias("rep")).unionByName(held.select("rep")).distinct()
    sets = _sets(rows, compacted(nodes.join(reps, "rep").select("rep", "c", "d", F.col("rep_doc").alias("id"), F.col("rep_key").alias("key"))))
    root = components(compacted(_with_sets(tried, sets).mapInArrow(_verified, out).filter("linked").select("a", "b")))
    _free(spark)
    # Then the pairs of small runs, but for those within a component.
    side = lambda name: root.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    across = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    pairs = compacted(across.select("a", "b"))
    # A pair travels with a set, so pairs go in turns, each turn's shuffle files freed before the next.
    links = None
    for turn in range(TURNS):
        some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(TURNS)) == turn)
        part = compacted(_with_sets(some, sets).mapInArrow(_verified, out).filter("linked").select("a", "b"))
        links = part if links is None else links.unionByName(part)
        _free(spark)
    root = components(links, root)

    # What is left: sets that share more large runs than the slack with sets of other components.
    left = compacted(held.join(root.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    while True:
        mixed = left.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("sig")
        mixed = left.join(compacted(mixed), "sig")
        enough = mixed.groupBy("rep", "instance").agg(F.count("*").alias("runs_left"), F.max("spare").alias("least")).filter("runs_left > least").select("rep", "instance", "runs_left")
        fewer = compacted(mixed.drop("runs").join(compacted(enough), ["rep", "instance"]).withColumnRenamed("runs_left", "runs"))
        done = fewer.count() > 0.9 * left.count()
        left = fewer
        if done or not left.head(1):
            break
    if not left.head(1):
        return root
    stays = compacted(_rarest(left).select("rep", "sig", "runs"))
    least = compacted(stays.groupBy("sig").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most").select("sig", "least"))
    met = stays.join(least, "sig").filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(met)
    weight = stays.groupBy(F.col("rep").alias("node")).agg(F.max("runs").alias("runs"))
    grouped = compacted(groups.join(weight, "node").select(F.col("node").alias("rep"), F.col("root").alias("group"), "runs"))
    center = compacted(grouped.groupBy("group").agg(F.min_by("rep", F.struct(-F.col("runs"), F.col("rep"))).alias("center")))
    stars = compacted(grouped.join(center, "group").filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b"), "group"))
    if not stars.head(1):
        return root
    one = compacted(_with_sets(stars.select("a", "b"), sets).mapInArrow(_verified, out))
    root = components(one.filter("linked"), root)

    # Distances to the center, in bins of 0.05; a bin is cut into blocks by hash.
    far = one.join(stars, ["a", "b"]).groupBy("group", F.col("b").alias("rep")).agg(F.min("distance").alias("distance"), F.min("a").alias("center"))
    far = far.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    far = compacted(far.join(root.select(F.col("node").alias("center"), F.col("root").alias("of_center")), "center", "left"))
    mixed = far.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first(F.coalesce("of_center", "center")).alias("own")).filter("low < high or low <> own").select("group")
    placed = far.join(mixed, "group").join(sized, "rep").withColumn("bin", F.floor(F.col("distance") * 20).cast("int")).withColumn("outer", 100 * (1 - F.col("distance")) < PERCENT - 1e-9)
    placed = compacted(placed.select("rep", "group", "root", "n", "bin", "outer"))
    cuts = compacted(placed.groupBy("group", "bin", "outer").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("cuts")))
    blocked = placed.join(cuts, ["group", "bin", "outer"]).withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    packed = checkpointed(blocked.join(sets.hint("merge"), "rep").groupBy("group", "bin", "outer", "cut").agg(F.collect_list(F.struct("root", "elements")).alias("sets")))
    keys = packed.select("group", "bin", "outer", "cut")
    left = keys.filter("outer").select("group", F.col("bin").alias("bin1"), F.col("cut").alias("cut1"))
    near = left.join(keys, "group").filter(F.abs(F.col("bin") - F.col("bin1")) <= 5)
    # Two outer blocks meet once.
    near = compacted(near.filter(~F.col("outer") | (F.struct("bin1", "cut1") <= F.struct("bin", "cut"))))
    first = packed.filter("outer").select("group", F.col("bin").alias("bin1"), F.col("cut").alias("cut1"), F.col("sets").alias("left"))
    met = near.join(first.hint("merge"), ["group", "bin1", "cut1"]).join(packed.hint("merge"), ["group", "bin", "outer", "cut"]).select("left", F.col("sets").alias("right"))
    return components(compacted(met.mapInArrow(_blocks_linked, "a bigint, b bigint")), root)


def link_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    rows = classes(docs)
    # Only rows that share a class or a component need another's id.
    least = compacted(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("root", "least"))
    found = rows.join(least, "root", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each component, that of the smallest id; all columns kept.

    Rows are known by id and text. Those of components of one row need no join: only the keys
    of the rest are joined, by broadcast if their counted rows allow. Of rows equal in id and
    text, one stays.
    """
    rows = classes(docs).filter("root is not null")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    best = compacted(rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("size")).filter("size > 1").select("root", F.col("best.row").alias("stays")))
    shared = rows.join(best, "root").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.max((F.col("row") == F.col("stays")).cast("int")).alias("stays"))
    side = compacted(shared)
    if small_enough(side):
        side = F.broadcast(side)
    names = docs.columns
    keyed = docs.select(carried(docs), *_key(docs)).drop("text")
    judged = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    single = judged.filter("stays is null")
    # Keys that stay, one row each: so few that a window over them is small.
    one = judged.filter("stays = 1").withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1))))
    return single.select(*restored(names)).unionByName(one.filter("nth = 1").select(*restored(names)))
