"""Operator 9 against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard
from lodestone.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id) of all rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for v in holders.values():
        for j in range(len(v)):
            for k in range(j):
                shared[v[k], v[j]] += 1
    for (i, j), both in shared.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, jaccard.link_groups(df).collect()), key=str)


def near_copies(seed, groups=6, most=40, low=6, high=120):
    """Groups of edited copies at all distances, with common passages and short texts among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(20))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(low, high))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy += [word() for _ in range(rng.randint(1, 12))]
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    texts += [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(30)] + texts[:10]
    rng.shuffle(texts)
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = near_copies(seed)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute([r[:2] for r in rows])


def test_large_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "small_enough", lambda df: False)
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    rows = near_copies(3, groups=2, most=150, low=60)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("own_id", [None, 5])
def test_many_rows_of_one_id(spark, own_id):
    """Rows of null or equal id meet their own set only, repeated rows once."""
    rows = near_copies(6, groups=12, most=30)
    rows = [(own_id, *r[1:]) for r in rows[:-5]] + rows[-5:] + [(own_id, *rows[0][1:])] * 50
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute([r[:2] for r in rows])


def test_batches_of_copies_alone(spark, monkeypatch):
    """A batch may hold no set that its task has not seen."""
    monkeypatch.setattr(jaccard, "_BATCH", 10)
    rows = [(i, "one two three four five six seven eight", "en", "s", 1) for i in range(200)] + [(900, "other words stand here in this row", "en", "s", 1)]
    assert got(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == brute([r[:2] for r in rows])
    assert [len(x) for x in jaccard._signed_in_parts([])[:2]] == [0, 0]


def test_signing_in_parts_changes_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64)) for _ in range(60)]
    whole = jaccard.signatures(sets)
    monkeypatch.setattr(jaccard, "_ELEMENTS", 1000)
    parts = jaccard._signed_in_parts(sets)
    pairs = lambda x: sorted(zip(x[0].tolist(), x[1].tolist()))
    assert pairs(whole) == pairs(parts) and sorted(whole[2].T.tolist()) == sorted(parts[2].T.tolist())


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_hard_rows(hard_docs, hard_rows, clashing_docs, no_docs):
    want = brute([r[:2] for r in hard_rows])
    assert got(hard_docs) == want and got(clashing_docs) == want and got(no_docs) == []
    assert jaccard.deduplicate(no_docs).count() == 0


def test_deduplicate(spark, clashing_docs, hard_rows):
    rows = near_copies(4)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(r["doc_id"] for r in jaccard.deduplicate(df).collect())
    assert kept == sorted({c for _, _, c in brute([r[:2] for r in rows])})
    out = jaccard.deduplicate(clashing_docs)
    assert out.columns == clashing_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 14] and None not in ids


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_linked_sets_share_signatures(size, seed):
    """Every linked pair shares more signatures than the slack, those without elements included."""
    rng = np.random.default_rng(seed)
    union = jaccard.mix(rng.integers(0, 1 << 63, size + size // 4 + 1).astype(np.uint64))
    differ = rng.integers(0, size // 5 + 1)
    left = np.unique(union[:size])
    cut = rng.integers(0, differ + 1)
    right = np.unique(np.concatenate([left[cut:], union[size : size + differ - cut]]))
    both = len(np.intersect1d(left, right))
    if 100 * both < 80 * (len(left) + len(right) - both) or len(left) == len(right) == both:
        return
    sig, of, without = jaccard.signatures([left, right])
    shared = np.intersect1d(sig[of == 0], sig[of == 1])
    instance = jaccard.BANDS.of(np.array([min(len(left), len(right))]))[0]
    empty = [int(without[2][(without[0] == i) & (without[1] == instance)].sum()) for i in (0, 1)]
    assert np.count_nonzero((shared & np.uint64(255)) == instance) > jaccard.BANDS.slack[instance] - min(empty)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("aB é\n\x1c\x1f 日.")), max_size=40))
def test_shingles_count(text):
    assert len(jaccard.shingles(text.encode(), jaccard.Words())) == len(shingle_set(text))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1, 40)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {(n, find(n)) for n in nodes}
