"""Byte-level BPE encoding and decoding by a table of ranks.

A text is cut into the matches of a splitting pattern, and each match's bytes are merged by
themselves: again and again the leftmost pair of neighbours whose joined bytes have the lowest
rank becomes one token, until no pair has a rank. A match that is itself a token stays one.

A segment tree over a match's byte positions finds that pair. Leaf ``i`` holds ``rank * width + i``
of the pair that begins at position ``i`` (or ``NONE``), an inner node the least of its two, so the
root is the leftmost pair of least rank. A merge changes three leaves: the merged pair's own, its
right half's, which dies, and that of the live neighbour to the left; each goes up in ``log2(width)``
steps. ``n`` bytes thus take O(n log n) steps, however long a match without blanks is.

Matches of up to ``SHORT`` bytes are merged many at a time, one tree to a row of a numpy array; a
longer one has a tree of its own. Each distinct match is merged once while its worker keeps it:
``KEEP`` of them at most (memory, not results). Texts are handled in slices of bytes; no text is cut.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are
encoded alike; an empty table gives an empty result; other columns, whatever their names, pass
through; decoding a null list gives null, an id that the table doesn't have raises.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lodestone.llm.common import carried, prepare, restored, text_or_empty, tidy

#: Matches that a worker keeps, characters of text handled at a time (memory, not results).
KEEP, SLICE = 500_000, 2 << 20
#: Longest match, in bytes, that is merged together with others of its width.
SHORT = 128
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """A table of ranks: lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Merges by one table of ranks; a pair's rank is that of its joined bytes, and its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.ids = {rank: token for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """What the leaves ``at`` hold for these neighbours; a right one below 0 is missing."""
        out = np.full(len(left), NONE)
        if len(self.keys):
            key = left << 32 | np.maximum(right, 0)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[place] == key) & (right >= 0)
            out[found] = self.values[place[found]] * width + at[found]
        return out

    def many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of 1 to ``width`` bytes (a power of two), a tree to each row."""
        n, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        places = np.arange(width)
        inside = places < sizes[:, None]
        token = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        token[:, :width][inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(places + 1 < sizes[:, None], places + 1, width)
        before = np.where(inside, places - 1, -1)
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self._leaves(token[:, :-1].ravel(), token[:, 1:].ravel(), np.tile(places, n), width).reshape(n, width)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.arange(n)
        while True:
            least = tree[rows, 1]
            going = least != NONE
            rows, least = rows[going], least[going]
            if not len(rows):
                break
            at, rank = least % width, least // width
            dead = after[rows, at]
            right, left = after[rows, dead], before[rows, at]
            token[rows, at], token[rows, dead], after[rows, at] = rank, -1, right
            has_right, has_left = right < width, left >= 0
            before[rows[has_right], right[has_right]] = at[has_right]
            tree[rows, width + dead] = NONE
            tree[rows, width + at] = self._leaves(rank, token[rows, right], at, width)
            tree[rows[has_left], width + left[has_left]] = self._leaves(token[rows[has_left], left[has_left]], rank[has_left], left[has_left], width)
            for node, own in ((width + at, rows), (width + dead, rows), (width + left[has_left], rows[has_left])):
                for _ in range(width.bit_length() - 1):
                    node = node >> 1
                    tree[own, node] = np.minimum(tree[own, 2 * node], tree[own, 2 * node + 1])
        live = token[:, :width]
        kept = live >= 0
        return np.split(live[kept], np.cumsum(kept.sum(1))[:-1]) if n else []

    def one(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        token = self.first[np.frombuffer(piece, np.uint8)]
        leaves = np.full(width, NONE)
        leaves[: n - 1] = self._leaves(token[:-1], token[1:], np.arange(n - 1), width)
        levels = [leaves]
        while len(levels[0]) > 1:
            levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
        tree = [0, *chain.from_iterable(x.tolist() for x in levels)]
        token, none, pairs = token.tolist(), int(NONE), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            dead, left = after[at], before[at]
            right = after[dead]
            token[at], token[dead], after[at] = rank, -1, right
            if right >= 0:
                before[right] = at
            for place, a, b in ((dead, -1, -1), (at, at, right), (left, left, at)):
                if place >= 0:
                    joined = pairs.get(token[a] << 32 | token[b]) if a >= 0 and b >= 0 else None
                    put(place, none if joined is None else joined * width + place)
        return np.array([t for t in token if t >= 0], np.int64)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; none of them is empty."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole], np.int64)
            elif len(piece) > SHORT:
                out[i] = self.one(piece)
            else:
                widths.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
        for width, places in widths.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(places), step):
                some = places[at : at + step]
                for i, ids in zip(some, self.many([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ids.__getitem__, ids))


class _Numbers(dict):
    """Numbers of distinct matches, in the order in which they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """Ids of whole texts; distinct matches are kept between calls."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merger, self.findall = Merger(read_ranks(path)), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.ends = _Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end)."""
        if len(self.numbers) > KEEP:
            self._forget()
        found = [self.findall(t) for t in texts]
        known = len(self.numbers)
        which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        bounds = np.cumsum([0, *map(len, found)])
        del found
        if len(self.numbers) > known:
            new = [p.encode() for p in list(self.numbers)[known:]]
            ids = self.merger.encode(new)
            self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        lengths = (self.ends[1:] - self.ends[:-1])[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.ends[:-1][which] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[take], ends[bounds]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's own encoder."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` characters; a longer text goes alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _batches(path: str, pattern: str, decoded: bool):
    """(row, text) to (row, ids), and, if asked, the bytes that the ids decode to."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                ids, bounds = own.encode_all(texts[begin:end])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                out = [batch.column(0).slice(begin, end - begin), lists]
                if decoded:
                    tokens, spans = ids.tolist(), bounds.tolist()
                    out.append(pa.array([own.merger.decode(tokens[i:j]) for i, j in zip(spans, spans[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["_row", "_ids", "_decoded"][: len(out)])

    return run


def _encoded(df: DataFrame, path: str, pattern: str, text: str, **made: str) -> DataFrame:
    prepare(df.sparkSession)
    kept = [c for c in df.columns if c not in made.values()]
    rows = df.select(carried(df, kept), text_or_empty("`" + text.replace("`", "``") + "`").alias("_text"))
    fields = [rows.schema["_row"], StructField("_ids", ArrayType(IntegerType())), StructField("_decoded", BinaryType())]
    out = rows.mapInArrow(_batches(path, pattern, "decoded" in made), StructType(fields[: 1 + len(made)]))
    return out.select(*restored(kept), *[F.col(f"_{k}").alias(name) for k, name in made.items()])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of ``df`` with a list of the ids of ``text`` (a column ``ids`` of its own is replaced)."""
    return _encoded(df, path, pattern, text, ids=ids)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass of Python: the rows with ids and the bytes decoded from them."""
    return _encoded(df, path, pattern, text, ids=ids, decoded=decoded)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows of ``df`` with the bytes that its lists of ids stand for."""
    prepare(df.sparkSession)
    kept = [c for c in df.columns if c != decoded]
    rows = df.select(carried(df, kept), F.col("`" + ids.replace("`", "``") + "`").cast("array<int>").alias("_ids"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            made = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["_row", "_decoded"])

    out = rows.mapInArrow(run, StructType([rows.schema["_row"], StructField("_decoded", BinaryType())]))
    return out.select(*restored(kept), F.col("_decoded").alias(decoded))
