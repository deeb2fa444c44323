"""Cosines of blocks of queries with packs of rows, as matrix products in Arrow tasks.

Rows (id, vec) are gathered into packs of about ``PACK`` bytes where they are scanned, queries into packs of a block each;
packs of queries are broadcast and meet every pack of rows. A task holds a pair of packs, ``TILE`` scores and the k best
scores of the queries so far, whatever the tables' sizes; with k, it gives only rows that can be among a query's k best.

Scores are those of the sums in the vectors' order, rounded half up to six places: a product that rounding might
tell from that sum is summed anew.

Defined results: a zero or empty vector's cosine is 0; a null vector's, one's with a null element and that of vectors of
different lengths is null, after all others; NaN comes before all others, as in Spark's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

#: Bytes of a pack's vectors, scores of a tile, rows of an Arrow batch that is given back (memory, not results).
PACK, TILE, OUT = 4 << 20, 1 << 20, 1 << 18
#: Distance from a rounding's edge, in the sixth place, within which a score is summed anew.
NEAR = 1e-6


def _norms(vecs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vecs))
    for j in range(vecs.shape[1]):
        total += vecs[:, j] * vecs[:, j]
    return np.sqrt(total)


def _packer(lists: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vec) to packs of vectors of one length, -1 for those without a length; with ``lists``, the row's list or lists too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            dims = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy().astype(np.int64)
            flat = vecs.flatten()
            if flat.null_count:
                owner = np.repeat(np.arange(len(dims)), np.maximum(dims, 0))
                dims[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                step = max(1, PACK // max(8, 8 * dim))
                for at in range(0, len(own), step):
                    some = pa.array(own[at : at + step])
                    values = vecs.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim) if dim > 0 else np.zeros((len(some), 0))
                    row = [pa.array([made]), pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(some)), pa.array([values.tobytes()], pa.binary()), pa.array([_norms(values).tobytes()], pa.binary())]
                    names = ["pack", "dim", "ids", "vecs", "norms"]
                    if lists:
                        row.append(pa.array([_listed(batch.column(2).take(some))], pa.binary()))
                        names.append("lists")
                    yield pa.RecordBatch.from_arrays(row, names)
                    made += 1

    return run


def _listed(column: pa.Array) -> bytes:
    """Each row's list as an int32, or each query's lists as bits, -1 first, after the number of bits."""
    if not pa.types.is_list(column.type):
        return column.to_numpy().astype(np.int32).tobytes()
    flat = column.flatten().to_numpy() + 1
    held = np.zeros((len(column), int(flat.max(initial=0)) + 1), bool)
    held[np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy()), flat] = True
    return np.int32(held.shape[1]).tobytes() + np.packbits(held, axis=1).tobytes()


def packs(rows: DataFrame, prefix: str = "", lists: str | None = None) -> DataFrame:
    """One row for each pack of ``rows`` (id, vec), and their column ``lists``."""
    first = rows.columns[0]
    kind = [("pack", LongType()), ("dim", IntegerType()), ("ids", ArrayType(rows.schema[first].dataType)), ("vecs", BinaryType()), ("norms", BinaryType()), *([("lists", BinaryType())] if lists else [])]
    asked = rows.select(first, F.col("vec").cast("array<double>").alias("vec"), *([lists] if lists else []))
    made = asked.mapInArrow(_packer(lists is not None), StructType([StructField(n, t) for n, t in kind]))
    return made.select(*[F.col(n).alias(prefix + n) for n, _ in kind])


def _rounded(raw: np.ndarray, again: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Scores half up to six places; ``again`` sums those of given places anew."""
    with np.errstate(invalid="ignore"):
        scaled = raw * 1e6
        low = np.floor(scaled)
        part = scaled - low
        out = np.where(np.isfinite(raw), (low + (part >= 0.5)) / 1e6, raw)
        edge = np.flatnonzero(np.abs(part - 0.5) < NEAR)
    if len(edge):
        values, which = np.unique(again(edge), return_inverse=True)
        out[edge] = np.array([float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if np.isfinite(v) else v for v in values.tolist()])[which]
    return out


class _Vectors:
    """A pack's vectors, or some of them."""

    def __init__(self, dim: int, vecs: np.ndarray, norms: np.ndarray):
        self.dim, self.vecs, self.norms = dim, vecs, norms

    @classmethod
    def read(cls, dim: int, vecs: pa.Scalar, norms: pa.Scalar) -> _Vectors:
        n = np.frombuffer(norms.as_buffer())
        return cls(dim, np.frombuffer(vecs.as_buffer()).reshape(len(n), max(0, dim)), n)

    def at(self, which) -> _Vectors:
        return _Vectors(self.dim, self.vecs[which], self.norms[which])


def _scores(q: _Vectors, v: _Vectors) -> np.ndarray:
    """The matrix of cosines, not rounded; NaN as infinity and null as its negative, so that they order as in Spark."""
    zero = (q.dim >= 0) & (q.norms == 0)[:, None] | ((v.dim >= 0) & (v.norms == 0))[None, :]
    if q.dim != v.dim or q.dim < 0:
        return np.where(zero, 0.0, -np.inf)
    with np.errstate(all="ignore"):
        found = q.vecs @ v.vecs.T
        found /= q.norms[:, None] * v.norms[None, :]
    found[zero] = 0.0
    found[np.isnan(found)] = np.inf
    return found


def _summed(q: _Vectors, v: _Vectors, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(qi))
    for j in range(q.dim):
        total += q.vecs[qi, j] * v.vecs[vi, j]
    return total / (q.norms[qi] * v.norms[vi])


def _all(q: _Vectors, v: _Vectors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the query, place of the row, score) of all pairs."""
    step = max(1, OUT // max(1, len(v.norms)))
    for at in range(0, len(q.norms), step):
        part = q.at(slice(at, at + step))
        raw = _scores(part, v).ravel()
        qi, vi = np.divmod(np.arange(len(raw)), len(v.norms))
        yield qi + at, vi, _rounded(raw, lambda e: _summed(part, v, qi[e], vi[e]))


def _best(q: _Vectors, v: _Vectors, order: np.ndarray | None, k: int, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of pairs that can be among the k best; ``held`` has each query's k best scores so far, ascending.

    ``order`` has the rows' places by id; without, all rows that tie with the k-th are given.
    """
    n = len(v.norms)
    step = max(1, TILE // max(1, n))
    for at in range(0, len(q.norms), step):
        part, seen = q.at(slice(at, at + step)), held[at : at + step]
        raw = _scores(part, v)
        low = seen[:, 0].copy()
        if n > k:
            wide = np.flatnonzero(np.count_nonzero(raw >= (low - NEAR)[:, None], axis=1) > 4 * k)
            low[wide] = np.maximum(low[wide], np.partition(raw[wide], n - k, axis=1)[:, n - k])
        qi, vi = np.nonzero(raw >= (low - NEAR)[:, None])
        score = _rounded(raw[qi, vi], lambda e: _summed(part, v, qi[e], vi[e]))
        by = np.lexsort((order[vi] if order is not None else vi, -score, qi))
        qi, vi, score = qi[by], vi[by], score[by]
        first = np.searchsorted(qi, np.arange(len(seen)))
        nth = np.arange(len(qi)) - first[qi]
        top = np.full((len(seen), k), -np.inf)
        top[qi[nth < k], nth[nth < k]] = score[nth < k]
        taken = (nth < k if order is not None else score >= top[qi, k - 1]) & (score >= seen[qi, 0])
        held[at : at + step] = np.sort(np.concatenate([seen, top], axis=1), axis=1)[:, -k:]
        yield qi[taken] + at, vi[taken], score[taken]


def _order(ids: pa.Array) -> np.ndarray | None:
    try:
        by = pc.array_sort_indices(ids, order="ascending", null_placement="at_start").to_numpy()
    except (pa.ArrowNotImplementedError, pa.ArrowTypeError):
        return None
    order = np.empty(len(by), np.int64)
    order[by] = np.arange(len(by))
    return order


def _scorer(k: int | None, lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(c)[i] for c, n in enumerate(batch.schema.names)}
                v = _Vectors.read(row["dim"].as_py(), row["vecs"], row["norms"])
                q = _Vectors.read(row["q_dim"].as_py(), row["q_vecs"], row["q_norms"])
                ids, asked = row["ids"].values, row["q_ids"].values
                order = _order(ids) if k else None
                held = best.setdefault(row["q_pack"].as_py(), np.full((len(q.norms), k), -np.inf)) if k else None
                for of_q, of_v in _runs(row) if lists else [(slice(None), slice(None))]:
                    qs, vs = np.arange(len(q.norms))[of_q], np.arange(len(v.norms))[of_v]
                    mine = held[qs] if k else None
                    for qi, vi, score in _best(q.at(of_q), v.at(of_v), order[vs] if order is not None else None, k, mine) if k else _all(q.at(of_q), v.at(of_v)):
                        score[score == np.inf] = np.nan
                        for at in range(0, len(qi), OUT):
                            cut = slice(at, at + OUT)
                            yield pa.RecordBatch.from_arrays([asked.take(pa.array(qs[qi[cut]])), ids.take(pa.array(vs[vi[cut]])), pa.array(score[cut], mask=score[cut] == -np.inf)], ["query_id", "id", "score"])
                    if k:
                        held[qs] = mine

    return run


def _runs(row: dict[str, pa.Scalar]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the queries that read a list, places of the list's rows) for each list of a pack."""
    own = np.frombuffer(row["lists"].as_buffer(), np.int32)
    width = int(np.frombuffer(row["q_lists"].as_buffer(), np.int32, 1)[0])
    bits = np.frombuffer(row["q_lists"].as_buffer(), np.uint8, offset=4).reshape(len(row["q_ids"]), -1)
    for one in np.unique(own).tolist():
        if one + 1 < width:
            asked = np.flatnonzero(bits[:, (one + 1) >> 3] >> (7 - ((one + 1) & 7)) & 1)
            if len(asked):
                yield asked, np.flatnonzero(own == one)


def scored(row_packs: DataFrame, query_packs: DataFrame, k: int | None = None, lists: bool = False) -> DataFrame:
    """(query_id, id, score) of packs against packs whose columns begin with q_; with k, at least each query's k best.

    ``lists``: a query meets the rows of its lists only.
    """
    of = lambda df, c: df.schema[c].dataType.elementType
    kind: list[tuple[str, DataType]] = [("query_id", of(query_packs, "q_ids")), ("id", of(row_packs, "ids")), ("score", DoubleType())]
    met = row_packs.join(F.broadcast(query_packs))
    return met.mapInArrow(_scorer(k, lists), StructType([StructField(n, t) for n, t in kind]))
