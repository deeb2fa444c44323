"""BM25 scores of whole texts, one text at a time: only document frequencies and lists of hits cross the cluster.

A text's words are counted in the task that reads it, met with the terms that queries ask for, and summed per
query; a task gives only rows that can be among a query's k best. What it holds is a piece of ``PAIRS`` (text, query)
sums, and the k best scores of each query so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.operators.dense import _order

#: Sums of a piece, and words of it (memory, not results).
PAIRS, WORDS = 1 << 21, 1 << 20
#: Scores are rounded to six places, so one that near still counts.
NEAR = 1e-6


def pieces(batch: pa.RecordBatch, terms: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, term's place in ``terms``, times, each row's words) of runs of a batch (id, words)."""
    lists = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    begin, ends = 0, np.cumsum(lengths)
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + WORDS, "right")))
        coded = lists.slice(begin, end - begin).flatten().dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, terms), -1).to_numpy()
        words = place[coded.indices.to_numpy()].astype(np.int64) if len(place) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(end - begin), lengths[begin:end])[words >= 0]
        key, tf = np.unique(rows * max(1, len(terms)) + words[words >= 0], return_counts=True)
        row, term = np.divmod(key, max(1, len(terms)))
        yield begin, row, term, tf, lengths[begin:end]
        begin = end


def counter(terms: pa.Array):
    """(id, words) to (term's place, texts that have it), summed over a task; place -1 has all texts, -2 all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, words = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, _, term, _, lengths in pieces(batch, terms):
                held += np.bincount(term, minlength=len(terms))
                texts, words = texts + len(lengths), words + int(lengths.sum())
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2])), pa.array(np.append(held[found], [texts, words]))], ["place", "df"])

    return run


def scorer(terms: pa.Array, idf: np.ndarray, begins: np.ndarray, asking: np.ndarray, n_queries: int, mean: float, k: int, k1: float, b: float):
    """(id, words) to (query, id, score): ``asking[begins[t]:begins[t + 1]]`` are the queries, by number, of term t."""
    fans = np.diff(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((n_queries, k), -np.inf)
        for batch in batches:
            order = _order(batch.column(0))
            for first, row, term, tf, lengths in pieces(batch, terms):
                part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean))
                met = np.cumsum(fans[term])
                at = 0
                while at < len(row):
                    # Whole rows, until their sums are enough.
                    end = int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS, "right"))
                    end = int(np.searchsorted(row, row[end], "left")) if end < len(row) else end
                    end = end if end > at else int(np.searchsorted(row, row[at], "right"))
                    fan = fans[term[at:end]]
                    places = np.repeat(begins[term[at:end]] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
                    keys, weights = np.repeat((row[at:end] - row[at]) * n_queries, fan) + asking[places], np.repeat(part[at:end], fan)
                    wide = (int(row[end - 1] - row[at]) + 1) * n_queries
                    if wide <= 2 * PAIRS:  # every part is above 0
                        score = np.bincount(keys, weights=weights, minlength=wide)
                        keys = np.flatnonzero((score.reshape(-1, n_queries) >= (best[:, 0] - NEAR)[None, :]).ravel() & (score > 0))
                        score = score[keys]
                    else:
                        keys, which = np.unique(keys, return_inverse=True)
                        score = np.bincount(which, weights=weights, minlength=len(keys))
                        near = score >= best[keys % n_queries, 0] - NEAR
                        keys, score = keys[near], score[near]
                    doc, query = np.divmod(keys, n_queries)
                    doc += row[at] + first
                    by = np.lexsort((order[doc] if order is not None else doc, -np.round(score, 6), query))
                    doc, query, score = doc[by], query[by], score[by]
                    nth = np.arange(len(query)) - np.searchsorted(query, query)
                    some, where = np.unique(query, return_inverse=True)
                    top = np.full((len(some), k), -np.inf)
                    top[where[nth < k], nth[nth < k]] = score[nth < k]
                    taken = score >= top[where, k - 1] - NEAR
                    best[some] = np.sort(np.concatenate([best[some], top], axis=1), axis=1)[:, -k:]
                    if taken.any():
                        yield pa.RecordBatch.from_arrays([pa.array(query[taken]), batch.column(0).take(pa.array(doc[taken])), pa.array(score[taken])], ["query", "id", "raw"])
                    at = end

    return run
