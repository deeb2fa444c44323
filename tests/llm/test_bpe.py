"""Byte-level BPE against the tiktoken library, and a round trip."""

import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.merger.ranks, special_tokens={})


def strings(seed, n, lengths):
    rng = random.Random(seed)
    letters = ["aaaabcdeé 漢字\n\t '.!1234", "abab", "the ing<|endoftext|>'s're ", "é́\U0001F600ﬁİſ‍\x00\x85　", "  \n \r\n"]
    return ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice(lengths))) for _ in range(n)] + ["".join(rng.choice("abcd") for _ in range(rng.choice(lengths))) for _ in range(n)]


def test_ids_are_the_librarys(own, library):
    for text in strings(1, 250, (0, 1, 2, 7, 60, 500)):
        ids, bounds = own.encode_all([text])
        assert ids.tolist() == library.encode_ordinary(text)
        assert bounds.tolist() == [0, len(ids)]
        assert own.merger.decode(ids.tolist()) == text.encode()


def test_both_trees_agree(own):
    rng = random.Random(2)
    for n in (2, 3, 7, 8, 9, 31, 64, 127, 128):
        pieces = [bytes(rng.choice(b"aabbcdet \xc3\xa9") for _ in range(n)) for _ in range(40)]
        width = 1 << max(1, (n - 1).bit_length())
        assert [x.tolist() for x in own.merger.many(pieces, width)] == [own.merger.one(p).tolist() for p in pieces]


def test_leftmost_of_equal_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaaa": 257}
    merger = bpe.Merger(ranks)
    assert merger.one(b"aaaaa").tolist() == [257, 97] and merger.many([b"aaaaa"], 8)[0].tolist() == [257, 97]
    assert bpe.Merger({bytes([b]): b for b in range(256)}).encode([b"abc"])[0].tolist() == [97, 98, 99]


def test_a_long_word_without_blanks(own, library):
    text = "abcdefghij" * 6000
    assert own.encode_all([text])[0].tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 50)
    own = bpe.Encoder(PATH, PATTERN)
    texts = strings(3, 40, (60, 200))
    for i in range(0, len(texts), 7):
        ids, bounds = own.encode_all(texts[i : i + 7])
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts[i : i + 7]]


def test_round_trip(spark, library):
    texts = [None, "", *strings(4, 30, (5, 90)), "same", "same", "x " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({"_row": F.lit(1), "a`b": F.lit("kept")})
    out = bpe.round_trip(df, PATH, PATTERN).collect()
    assert len(out) == len(texts) and {r["a`b"] for r in out} == {"kept"}
    for r in out:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    apart = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in apart.collect()) == sorted((r.doc_id, bytes(r.decoded)) for r in out)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).collect() == []
    assert bpe.decode(spark.sql("select cast(null as array<int>) ids"), PATH).first().decoded is None


def test_an_unknown_id_raises(spark):
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.sql("select array(50256) ids"), PATH).collect()
