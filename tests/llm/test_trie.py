"""The conversation trie against brute force over whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, forked=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if forked else 0
        built[c] = own.get(c - c % 100, [])[:h] + said[h:]
    nodes = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            nodes[tuple(said[:d])].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = sum(saved[k] for k in children[key]) + (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0)
    ends = {k: ",".join(map(str, sorted(c for c in v if len(built[c]) == len(k)))) for k, v in nodes.items()}
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in nodes.items())


def found(spark, rows, forked=True, parts=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in prefix_trie.trie(df, forked).select(*OUT).collect())


def conversations(seed, n, most=4, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(5 * n), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "é" * rng.randint(0, words)))
    return rows


@pytest.mark.parametrize("forked", [True, False])
def test_random(spark, forked):
    rows = conversations(1, 150, 9, 1)
    assert found(spark, rows, forked) == brute(rows, forked)


def test_a_conversation_in_all_partitions(spark):
    rows = [(100, t, "user", str(t % 3)) for t in range(900)] + [(c, t, "user", str(t % 3)) for c in (101, 102, 250) for t in range(300)] + conversations(2, 30)
    assert found(spark, rows) == brute(rows)
    rows = [(205, t, "user", str(t % 2)) for t in range(700)]  # no head to fork from
    assert found(spark, rows) == brute(rows)


def test_copies_and_caterpillars(spark):
    copies = [(c, t, "user", str(t)) for c in range(1000, 1040) for t in range(3)]
    chain = [(c, t, "user", str(t)) for c in (2000, 2100, 2200) for t in range(60)]
    spine = [(c * 100, t, "user", "x" if t < c - 29 else f"{c}") for c in range(30, 90) for t in range(c - 28)]
    for rows in (copies, chain, spine, copies + chain + spine):
        assert found(spark, rows, False) == brute(rows, False)


def test_chunks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 20000, 100)]
    assert found(spark, rows) == brute(rows)


def test_defined_results(spark):
    rows = [(None, 0, "user", "no id"), (7, None, None, None), (7, 2, "user", "b"), (7, 2, "user", "a"), (7, 2, "user", "a"), (150, 0, "user", "gone"), (-120, 0, "user", "m"), (-200, 0, "user", "n"), (9, 0, "user", "long " * 20000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"k1": F.lit("x"), "depth": F.lit(None).cast("int"), "digest": F.lit(3)})
    assert sorted(tuple(r) for r in prefix_trie.trie(extra, True).select(*OUT).collect()) == brute(rows)
