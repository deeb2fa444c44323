"""Packing documents into fixed windows by non-negative least squares.

1. ``pieces`` tokenizes each document, appends the end id and cuts it into full windows and
   one rest. Pieces are written once, numbered within their task and length.
2. The histogram of lengths has ``window`` rows, whatever the corpus; it alone reaches the
   driver. ``plan`` enumerates all combinations of two or three lengths that fill a window,
   solves for their repeat counts against the histogram (least squares, non-negative, by
   multiplicative updates), rounds, and gives what no combination takes to a greedy stream:
   longest first, each window filled to the brim and the piece at its end cut.
3. A piece's rank among all pieces of its length decides its sequence and offset, so
   ``packed`` is a lookup and no piece is gathered or sorted. Ranks come from running sums of
   (task, length) counts.

All sequences but the last are full. The plan has at most window**2 / 4 rows (three for each
combination), and is broadcast.

Defined results: null and empty texts are a lone end id; repeated rows and equal ids are
documents of their own; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, prepare, shared_folder, small_enough, tidy
from lodestone.llm.tokens import encoder

WINDOW = 2048
UPDATES = 120
_BIG = 1 << 40


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0 and b > 0, of present lengths that sum to the window."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    has[0] = True
    a, c = np.meshgrid(np.flatnonzero(has[1:window]) + 1, np.flatnonzero(has[: window // 3 + 1]), indexing="ij")
    a, c = a.ravel(), c.ravel()
    b = window - a - c
    ok = (b <= a) & (b >= np.maximum(c, 1))
    a, b, c = a[ok], b[ok], c[ok]
    ok = has[b]
    return np.stack([a[ok], b[ok], c[ok]])


def solve(combos: np.ndarray, hist: np.ndarray, updates: int = UPDATES) -> np.ndarray:
    """Repeat counts x >= 0 with least squares of (pieces used - hist), by multiplicative updates."""
    n = len(hist)
    used = lambda x: sum(np.bincount(part, x, n) for part in combos) * live
    live = np.arange(n) > 0  # length 0 stands for no third piece
    h = hist * live
    want = h[combos].sum(0)
    x = np.full(combos.shape[1], h.sum() / max(1, 3 * combos.shape[1]))
    for _ in range(updates):
        x *= want / np.maximum(used(x)[combos].sum(0), 1e-12)
    return x


def rounded(combos: np.ndarray, x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Whole counts: running sums are rounded, then cut to the pieces there are, most wanted first."""
    total = np.floor(np.cumsum(x) + 0.5)
    counts = np.diff(total, prepend=0.0).astype(np.int64)
    left = hist.astype(np.int64).tolist()
    for k in np.flatnonzero(counts)[np.argsort(-x[counts > 0], kind="stable")]:
        parts = [int(p) for p in combos[:, k] if p]
        most = min(left[p] // parts.count(p) for p in parts)
        counts[k] = take = min(int(counts[k]), most)
        for p in parts:
            left[p] -= take
    return counts


@dataclass
class Plan:
    """Where the piece of a length and rank goes.

    keys: length * 2**40 + first rank of each run, ascending; base: sequence of that rank;
    at: offset there. From rank ``used[length]`` on, pieces are in the stream, which begins at
    sequence ``stream`` and has ``before[length]`` ids of longer pieces first.
    """

    window: int
    keys: np.ndarray
    base: np.ndarray
    at: np.ndarray
    used: np.ndarray
    before: np.ndarray
    stream: int
    tokens: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece; in the stream it may go on in the next sequence."""
        streamed = rank >= self.used[length]
        place = self.before[length] + (rank - self.used[length]) * length
        key = length * _BIG + rank
        i = np.maximum(np.searchsorted(self.keys, key, "right") - 1, 0)
        if not len(self.keys):
            return self.stream + place // self.window, place % self.window
        return np.where(streamed, self.stream + place // self.window, self.base[i] + key - self.keys[i]), np.where(streamed, place % self.window, self.at[i])


def plan(hist: np.ndarray, window: int = WINDOW) -> Plan:
    """hist[n]: pieces of length n, for n from 0 to the window."""
    hist = hist.astype(np.int64)
    combos = combinations(np.flatnonzero(hist[:window]), window)
    counts = rounded(combos, solve(combos, hist[: window + 1].astype(float)), hist) if combos.shape[1] else np.zeros(0, np.int64)
    combos, counts = combos[:, counts > 0], counts[counts > 0]
    # Full windows are sequences of their own, then the combinations, then the stream.
    base = hist[window] + np.cumsum(counts) - counts
    length = np.concatenate([combos[0], combos[1], combos[2], [window]])
    at = np.concatenate([np.zeros_like(combos[0]), combos[0], combos[0] + combos[1], [0]])
    copies, base = np.concatenate([counts, counts, counts, hist[window : window + 1]]), np.concatenate([base, base, base, [0]])
    some = (length > 0) & (copies > 0)
    order = np.argsort(length[some], kind="stable")
    length, at, copies, base = (v[some][order] for v in (length, at, copies, base))
    used = np.bincount(length, copies, window + 1).astype(np.int64)
    ends = np.cumsum(copies)
    first = ends - copies - (np.cumsum(used) - used)[length]
    left = (hist - used) * np.arange(window + 1)
    before = np.cumsum(left[::-1])[::-1] - left
    return Plan(window, length * _BIG + first, base, at, used, before, int(hist[window] + counts.sum()), int((hist * np.arange(window + 1)).sum()))


def _cut(path: str, end_id: int, window: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, enc = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(path, False)
        end = np.asarray([end_id], enc.dtype).tobytes()
        width = len(end)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = []
                for doc_id, ids in zip(batch.column(0).slice(at, 2_000).to_pylist(), enc.encode_all(batch.column(1).slice(at, 2_000))):
                    ids += end
                    n = len(ids) // width
                    for begin in range(0, n, window):
                        size = min(window, n - begin)
                        rows.append((task, size, seen[size], doc_id, begin, ids[begin * width : (begin + size) * width], n))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE_TYPES)], PIECE_NAMES)

    return run


PIECE_NAMES = ["task", "len", "rank", "doc_id", "start", "ids", "doc_tokens"]
PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
_SQL = {pa.int64(): "bigint", pa.binary(): "binary"}


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """All documents' pieces, written once; ids are little-endian u16, or u32 for large vocabularies."""
    spark = prepare(docs.sparkSession)
    schema = ", ".join(f"{n} {_SQL[t]}" for n, t in zip(PIECE_NAMES, PIECE_TYPES))
    folder = shared_folder(spark, "pieces")
    docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_cut(tokenizer_path, end_id, window), schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _placed(plan_value, dtype: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan_value.value
        for batch in batches:
            length, rank, start, doc_tokens = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 5))
            sequence, offset = p.place(length, rank)
            doc_ids, rows = batch.column(2).to_pylist(), []
            for i, ids in enumerate(batch.column(4)):
                ids = np.frombuffer(ids.as_buffer(), dtype).astype("<u4")
                done, seq, at = 0, int(sequence[i]), int(offset[i])
                while done < len(ids):
                    size = min(len(ids) - done, p.window - at)
                    part = ids[done : done + size]
                    rows.append((doc_ids[i], int(start[i]) + done, size, part.tobytes(), int(doc_tokens[i]), seq, at, zlib.crc32(part)))
                    done, seq, at = done + size, seq + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT_TYPES)], OUT_NAMES)

    return run


OUT_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
OUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row per piece with its sequence and offset; ``ids`` are little-endian u32."""
    spark = prepare(docs.sparkSession)
    cut = pieces(docs, tokenizer_path, end_id, window)
    counts = checkpointed(cut.groupBy("task", "len").agg(F.count("*").alias("n")))
    hist = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("len").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        hist[row["len"]] = row["n"]
    made = plan(hist, window)
    before = Window.partitionBy("len").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    offsets = checkpointed(counts.select("task", "len", (F.sum("n").over(before) - F.col("n")).alias("before")))
    side = F.broadcast(offsets) if small_enough(offsets) else offsets
    ranked = cut.join(side, ["task", "len"]).select("len", (F.col("before") + F.col("rank")).alias("rank"), "doc_id", "start", "ids", "doc_tokens")
    dtype = encoder(tokenizer_path, False).dtype
    schema = ", ".join(f"{n} {_SQL[t]}" for n, t in zip(OUT_NAMES, OUT_TYPES))
    out = ranked.mapInArrow(_placed(spark.sparkContext.broadcast(made), dtype), schema)
    return out if with_ids else out.drop("ids")
