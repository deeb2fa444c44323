"""Source divergence against brute force with Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import divergence

SCHEMA = "doc_id bigint, lang string, source string, text string"
OUT = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, top=200):
    docs = defaultdict(list)
    for _, lang, source, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, held in docs.items():
        seen = Counter(t for _, words in held for t in set(words))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        counts = {s: Counter() for s, _ in held}
        for s, words in held:
            counts[s].update(w for w in words if seen[w] >= 3)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in ps:
            pair = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in ps if o != s]
            term = [(-f(ps[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and ps[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def found(spark, rows, top=200):
    return sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA), top).select(*OUT).collect())


def texts(seed, n, words=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["w", "É", "Ж", "漢"]) + str(int(rng.paretovariate(0.7)) % words).translate(str.maketrans("0123456789", "abcdefghij"))
    return [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", None, "Ünï"]), rng.choice([" ", "-", "\n9"]).join(word() for _ in range(rng.randint(0, 40)))) for i in range(n)]


def test_random(spark):
    rows = texts(1, 250)
    assert found(spark, rows) == brute(rows)


def test_few_ranks_with_ties(spark):
    rows = texts(2, 80, 300) + [(1, "en", "s1", "alpha beta gamma delta")] * 4
    for top in (1, 3):
        assert found(spark, rows, top) == brute(rows, top)


def test_vectors_of_equal_counts_meet_once(spark):
    rows = [(i, "en", s, "aa bb cc dd ee") for i in range(3) for s in ("x", "y")] + [(9, "en", "x", "ff")] * 3
    kept, _ = divergence._entries(spark.createDataFrame(rows, SCHEMA))
    assert kept.select(*divergence._VECTOR).distinct().count() == 2
    assert found(spark, rows) == brute(rows)


def test_defined_results(spark):
    rows = [(1, None, None, None), (2, "en", "a", ""), (3, "en", "b", "12 !"), (4, "fr", "a", "One one ONE"), (4, "fr", "a", "one"), (4, "fr", "a", "one"), (5, "fr", "b", None), (6, "fr", "c:", "x" * 300_000 + " one" * 50_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "h0": F.lit(1), "term": F.lit(None).cast("int")})
    assert sorted(tuple(r) for r in divergence.divergences(extra).select(*OUT).collect()) == brute(rows)


def test_large_counts_stay_exact(spark):
    row = spark.sql("select 10000000000000 n, 90000000000000 total, 7 terms").select(divergence._p(F.col("n"), F.col("total"), F.col("terms")))
    assert row.first()[0] == 1 + 10**9 * (10**13 + 1) // (9 * 10**13 + 7)
