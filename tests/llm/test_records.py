"""Operators 4, 5, 6, 7 and 10 against brute force and exact round trips."""

import gzip
import hashlib
import json
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import binary_ids, licenses, packing, telephony, warc
from lodestone.llm import queries as Q
from lodestone.llm.common import shared_folder
from lodestone.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=["hard", "table"])
def docs(request, spark, sf, hard_docs):
    return hard_docs if request.param == "hard" else spark.read.parquet(f"{sf}/documents.parquet")


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PLAIN = {p: plain(p) for p in (BYTE, WORD)}
ENCODERS = {p: Encoder(p, p == BYTE) for p in (BYTE, WORD)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aB1'sé.\n \t \u0085\x1c　日<|>endoftext!-’́Σ")), max_size=60))
def test_pieces_encode_like_the_library(text):
    for path, enc in ENCODERS.items():
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == PLAIN[path](text)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4"))


def test_binary_ids(spark, docs):
    folder, index = shared_folder(spark, "t"), shared_folder(spark, "i")
    binary_ids.write(docs, folder, BYTE, 2)
    got = binary_ids.build_index(spark, folder, index).collect()
    want = [(r["doc_id"], [*PLAIN[BYTE](r["text"]), 2]) for r in docs.collect()]
    assert Counter((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == Counter((i, len(x), crc(x)) for i, x in want)
    numbers = lambda name: tuple(map(int, re.search(r"part-(\d+)-.*-c(\d+)", name).groups()))
    in_order = sorted(got, key=lambda g: (numbers(g["file"]), g["offset"]))
    ids = [(g["doc_id"] is not None, g["doc_id"] or 0) for g in in_order]
    assert ids == sorted(ids)
    assert [g["start"] for g in in_order] == np.cumsum([0, *[g["n_tokens"] for g in in_order]])[:-1].tolist()
    some = spark.createDataFrame(random.Random(1).sample(got, 5), spark.read.parquet(index).schema)
    read = binary_ids.read_at(spark, folder, some).collect()
    assert {(r["file"], r["offset"], crc(r["ids"])) for r in read} == {(r["file"], r["offset"], r["ids_crc32"]) for r in some.collect()}


def test_binary_ids_many_files(spark, sf, monkeypatch):
    """Files end by bytes, whatever the number of documents, and follow each other by number."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(-1, "long text " * 40_000, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    monkeypatch.setattr(binary_ids, "FILE_BYTES", 300)  # workers take it along: the module is the driver's own here
    folder = shared_folder(spark, "t")
    binary_ids.write(docs, folder, BYTE, 2)
    got = binary_ids.build_index(spark, folder, shared_folder(spark, "i")).orderBy("doc_id").collect()
    assert [g["start"] for g in got] == np.cumsum([0, *[g["n_tokens"] for g in got]])[:-1].tolist() and len({g["file"] for g in got}) > 100
    names = ["part-100000-x-c000.txt", "part-99999-x-c1000.txt", "part-99999-x-c200.txt", "part-00007-x-c000.txt"]
    ordered = spark.createDataFrame([(n,) for n in names], "file string").select("file", *binary_ids.file_order(F.col("file"))).orderBy("task", "nth").collect()
    assert [r["file"] for r in ordered] == names[::-1]


def test_frames_detect_damage():
    data = binary_ids.frame(7, np.arange(5, dtype="<u2")) + binary_ids.frame(None, np.arange(0, dtype="<u4")) + b"\n"
    assert [(i, len(x)) for _, i, x, _ in binary_ids.records(data)] == [(7, 5), (None, 0)] and list(binary_ids.records(b"")) == []
    for at in range(len(data)):
        with pytest.raises(binary_ids.Corrupt):
            list(binary_ids.records(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    for cut in range(1, len(data)):
        with pytest.raises(binary_ids.Corrupt):
            list(binary_ids.records(data[:cut]))


def check_packing(rows, want, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += window - at
    assert padding < window
    for doc_id, texts in want.items():
        got = sorted(by_doc.pop(doc_id), key=lambda r: (r["doc_tokens"], r["start"]))
        assert sum(r["length"] for r in got) == sum(map(len, texts))
        assert Counter((r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter((r["start"], r["length"], crc(next(t for t in texts if len(t) == r["doc_tokens"])[r["start"] : r["start"] + r["length"]])) for r in got)
    assert not by_doc


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(docs, window):
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append([*PLAIN[WORD](r["text"]), 1])
    check_packing(packing.pack(docs, WORD, 1, window).collect(), want, window)


def test_packing_without_broadcast(hard_docs, monkeypatch):
    want = sorted(map(str, packing.pack(hard_docs, WORD, 1, 64, with_ids=False).collect()))
    monkeypatch.setattr(packing, "small_enough", lambda df: False)
    assert sorted(map(str, packing.pack(hard_docs, WORD, 1, 64, with_ids=False).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=300))
def test_plans_place_every_piece_once(lengths):
    hist = np.bincount(lengths, minlength=33)
    plan, filled = packing.plan(hist, 32), set()
    for n in range(1, 33):
        seq, at = plan.place(np.full(hist[n], n), np.arange(hist[n]))
        for s, a in zip(seq.tolist(), at.tolist()):
            cells = {s * 32 + a + k for k in range(n)}
            assert not cells & filled
            filled |= cells
    assert len(filled) == sum(lengths) and (not filled or max(filled) == len(filled) - 1)


def test_repeat_counts_are_the_least_squares_optimum():
    hist = np.zeros(65)
    hist[[40, 24, 30, 20, 14]] = [100, 60, 50, 50, 90]
    combos = packing.combinations(np.flatnonzero(hist[:64]), 64)
    assert (combos.sum(0) == 64).all()
    x = packing.solve(combos, hist, 2000)
    # At the least-squares optimum no combination's gradient is negative, and used ones' are 0.
    miss = sum(np.bincount(c, x, 65) for c in combos) - hist
    miss[0] = 0
    gradient = miss[combos].sum(0)
    assert (x >= 0).all() and (gradient > -1e-3).all() and np.abs(gradient[x > 1e-3]).max() < 1e-3
    assert (sum(np.bincount(c, packing.rounded(combos, x, hist), 65) for c in combos)[1:] <= hist[1:]).all()


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_base(docs):
    want = Counter()
    for r in docs.collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        words, places, labels = LICENSE_WORD.findall(text), [], set()
        for phrase, label in [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want[r["doc_id"], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    got = licenses.scan(docs).collect()
    assert Counter(tuple(g[:6]) for g in got) == want
    assert all(set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1 for g in got)


def test_license_labels(spark):
    filler = " lorem ipsum" * 400
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = ["x " + mit + filler, filler + bsd, "public work license general", mit.replace("free of charge", "for money"), "", None, "All rights reserved.", "software granted person " + filler]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1.0 and got[1]["labels"] == "bsd" and got[6]["labels"] == "all-rights-reserved"
    assert all(got[i]["labels"] == "" for i in (2, 3, 4, 5, 7)) and got[4]["score"] == 0


def license_brute(words, idf):
    """(labels, score) over every offset at which any template word stands."""
    labels, best = set(), 0.0
    for label, text, keys in licenses.TEMPLATES:
        rare = [(q, w) for q, w in enumerate(text.split()) if w not in licenses.COMMON]
        near = lambda p, w: w in words[max(p - licenses.SLACK, 0) : max(p + licenses.SLACK + 1, 0)]
        there = lambda p, key: p >= 0 and words[p : p + len(key.split())] == key.split()
        stands = lambda p, key: there(p, key) and not any(there(p - j, k) for k in licenses.KEYS if len(k) > len(key) and f" {key} " in f" {k} " for j in range(len(k.split())) if k.split()[j : j + len(key.split())] == key.split())
        for o in {p - q for q, w in rare for p in range(len(words)) if words[p] == w}:
            share = min(1.0, sum(idf[w] for q, w in rare if near(o + q, w)) / sum(idf[w] for _, w in rare))
            best = max(best, share)
            reach = range(o - licenses.SLACK, o + len(text.split()) + licenses.SLACK + 1)
            if share >= licenses.LEAST_SCORE and all(any(stands(p, key) for p in reach) for key in keys):
                labels.add(label)
    return sorted(labels), best


def test_license_judge_against_brute_force():
    rng = random.Random(5)
    index = licenses.Index(100, {i: rng.randrange(90) for i in range(len(licenses.VOCABULARY))})
    idf = dict(zip(licenses.VOCABULARY, index.idf))
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            words += [rng.choice(["lorem", rng.choice(licenses.VOCABULARY)]) for _ in range(rng.randrange(8))]
            words += [w for w in notice if rng.random() > 0.1] if rng.random() < 0.6 else notice
        hits = [x for i, w in enumerate(words) if w in idf for x in (licenses.VOCABULARY.index(w), i)]
        found = licenses.standing(licenses.places([w.encode() for w in words], licenses.KEYS))
        labels, score = index.judge(hits, [x for key, own in found.items() for p in own for x in (licenses.KEYS.index(key), p)])
        want, best = license_brute(words, idf)
        assert labels == want and score == pytest.approx(best, abs=1e-6)


def test_license_labels_of_whole_tables(spark, docs):
    """Labels and scores of all rows against brute force over whole texts."""
    lines = docs.collect()
    words = [LICENSE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in lines]
    df = Counter(w for x in words for w in set(x))
    idf = {w: math.log((1 + len(lines)) / (1 + df[w])) + 1 for w in licenses.VOCABULARY}
    want = Counter()
    for r, x in zip(lines, words):
        if len(x) > 200_000:
            assert idf.keys().isdisjoint(x)  # brute force takes too long otherwise
        labels, score = ([], 0.0) if idf.keys().isdisjoint(x) else license_brute(x, idf)
        line = f" {' '.join(x)} "
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in line}
        want[r["doc_id"], ",".join(sorted(base | set(labels))), round(score, 5)] += 1
    assert Counter((g["doc_id"], g["labels"], round(g["score"], 5)) for g in licenses.scan(docs).collect()) == want


def test_license_key_phrases_are_whole(spark):
    texts = ["permission xx yy copy modify and or distribute this software for any purpose with or without fee is hereby granted", "// SPDX-License-Identifier: Apache-2.0", "This is free and unencumbered software released into the public domain.", "spdx identifier apache"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: "", 1: "apache", 2: "unlicense", 3: ""}


def test_license_notices_that_contain_others(spark):
    """A longer key phrase takes the place of a shorter one within it."""
    notices = {
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl",
        "SPDX-License-Identifier: Zlib": "zlib",
        "Distributed under the Boost Software License, Version 1.0.": "boost",
        "SPDX-License-Identifier: CC0-1.0": "cc0",
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(notices)), "doc_id bigint, text string")).collect()}
    assert {i: got[i]["labels"] for i in got} == dict(enumerate(notices.values())) and min(r["score"] for r in got.values()) >= licenses.LEAST_SCORE


def test_license_many_notices(spark):
    """A file keeps the licenses of all its notices, however many template words it holds."""
    every = (" lorem ipsum" * 3000 + " ").join(text for _, text, _ in licenses.TEMPLATES)
    bsd = "copyright acme all rights reserved " + next(text for label, text, _ in licenses.TEMPLATES if label == "bsd")
    docs = spark.createDataFrame([(0, every), (1, bsd), (2, "plain text")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[0]["labels"] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES})) and got[0]["score"] == 1.0
    assert got[1]["labels"] == "all-rights-reserved,bsd" and got[2]["labels"] == ""


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "u\r\nX: y", "<title>a &amp; b</title><p>x<script>no</script>y<br>z</p><!-- no --><a href='/q'>w</a>"), (-2, "", "")], "page_id bigint, url string, html string")
    derived = warc.derive(warc.responses(pages.unionByName(odd))).collect()
    assert len(derived) == pages.count() + 3
    for d in derived:
        (r, block), (m, said), (c, text) = (warc.parse(bytes(d[k])) for k in ("response", "metadata", "conversion"))
        payload = block.partition(b"\r\n\r\n")[2]
        assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == r["WARC-Record-ID"] and r["WARC-Payload-Digest"] == c["WARC-Source-Payload-Digest"] == warc.digest(payload)
        assert json.loads(said)["payload_length"] == len(payload)
        if d["page_id"] == -1:
            assert text.decode() == "a & b\nx y\nz\nw" and json.loads(said)["links"] == [{"tag": "a", "url": "/q"}] and json.loads(said)["title"] == "a & b"
            assert r["WARC-Target-URI"] == "u X: y"
    assert len({warc.parse(bytes(d["response"]))[0]["WARC-Record-ID"] for d in derived}) == len(derived)
    assert Q.op5_warc(spark, sf).count() == pages.count()
    assert warc.summary(warc.derive(warc.responses(pages.limit(0)))).count() == 0


def http_record(head, payload, **warc_headers):
    block = ("\r\n".join(["HTTP/1.1 200 OK", *head]) + "\r\n\r\n").encode() + payload
    names = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", **{k.replace("_", "-"): v for k, v in warc_headers.items()}}
    return "".join(["WARC/1.0\r\n", *[f"{k}: {v}\r\n" for k, v in names.items()], f"content-length: {len(block)}\r\n\r\n"]).encode() + block + b"\r\n\r\n"


def read_derived(data):
    metadata, conversion = warc.derivatives(data)
    return warc.parse(metadata), warc.parse(conversion), json.loads(warc.parse(metadata)[1])


def test_warc_of_real_records():
    """Records without digests, with other charsets, repeated headers, and encoded bodies."""
    page = "<title>é</title><p>größe"
    (m, _), (c, text), said = read_derived(http_record(["content-type: text/html; charset=ISO-8859-1", "Set-Cookie: a", "Set-Cookie: b"], page.encode("latin-1")))
    assert text.decode() == "é\ngröße" and said["title"] == "é" and [v for k, v in said["http_headers"] if k == "Set-Cookie"] == ["a", "b"]
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == "<urn:uuid:1>" and m["WARC-Source-Payload-Digest"] == warc.digest(page.encode("latin-1"))
    packed = gzip.compress(page.encode())
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    for head, payload in ((["Content-Encoding: gzip"], packed), (["Transfer-Encoding: chunked", "Content-Encoding: gzip"], chunked), ([], b'<meta charset="utf-8">' + page.encode()), (["Content-Type: text/html; charset=no-such"], page.encode()), (["Content-Encoding: gzip"], page.encode())):
        assert read_derived(http_record(head, payload))[1][1].decode() == "é\ngröße"
    assert read_derived(http_record([], b""))[2]["title"] is None
    with pytest.raises(ValueError):
        warc.derivatives(http_record([], b"x", WARC_Block_Digest="sha1:AAAA"))
    for wrong in (b"", b"no record", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx"):
        with pytest.raises(ValueError):
            warc.parse(wrong)


class Brute(HTMLParser):
    """Visible text, links and title by the standard library's parser, for well-formed pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.hidden, self.in_title = [], [], None, 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        self.in_title = tag == "title" or self.in_title
        self.text += ["\n"] if tag in warc.BLOCKS else [" "] if tag in warc.HIDDEN else []
        target = next((v for k, v in attrs if k in ("href", "src")), None)
        self.links += [{"tag": tag, "url": target}] if tag in warc.LINKS and target is not None else []

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.in_title = self.in_title and tag != "title"
        self.text += ["\n"] if tag in warc.BLOCKS else []

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            self.title = " ".join(f"{self.title or ''} {data}".split()) if self.in_title else self.title


def test_warc_pages_against_a_parser(spark, sf):
    """Every page of the table: title, links and text as the standard library's parser gives them."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        title, links, text = warc.read_page(r["html"] or "")
        want = Brute(r["html"] or "")
        lines = (" ".join(x.split()) for x in "".join(want.text).split("\n"))
        assert (title, links, text) == (want.title, want.links, "\n".join(x for x in lines if x))


@pytest.mark.parametrize("unit", ["<a ", "<!--", "<script>", "<title>", "<", '<a href="', "<a ='", "</", "<p>", "&amp", "<style ", "<a href="])
def test_warc_time_is_linear(unit):
    started = time.monotonic()
    warc.read_page(unit * 200_000)
    assert time.monotonic() - started < 5


def test_warc_quotes_and_open_ends():
    assert warc.read_page('<a title="x>y" href="/a>b">t</a><p>1 < 2<br>z <!-- open')[1:] == ([{"tag": "a", "url": "/a>b"}], "t\n1 < 2\nz <!-- open")


def test_warc_files(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(None, None, "a\n\n"), (None, None, "b\r\n"), (-1, "u", "é" * 100_000), (-2, "r", "same"), (-2, "r", "same")], "page_id bigint, url string, html string")
    derived = warc.derive(warc.responses(pages.unionByName(odd, allowMissingColumns=True))).cache()
    warc.write_files(derived, str(tmp_path / "w"), 50)
    back = warc.read_files(spark, str(tmp_path / "w" / "part-*")).collect()
    want = Counter(bytes(r[k]) for r in derived.collect() for k in ("response", "metadata", "conversion"))
    assert Counter(bytes(r["record"]) for r in back) == want and max(want.values()) == 2
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in want))
    assert {bytes(r["record"]) for r in warc.read_files(spark, str(tmp_path / "z")).collect()} == set(want)
    clash = pages.limit(3).withColumn("response", F.lit(1)).withColumn("metadata", F.lit("x"))
    assert warc.summary(warc.derive(warc.responses(clash))).count() == 3


def test_telephony_query(docs, spark, tmp_path):
    telephony.as_wave(docs).write.parquet(str(tmp_path / "m"))
    got = telephony.features(spark.read.parquet(str(tmp_path / "m"))).collect()
    want = Counter()
    for r in docs.collect():
        data = (r["text"] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        want[r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter((g["doc_id"], g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) for g in got) == want
    assert all(g["media_bytes"] == g["payload_bytes"] + 58 for g in got)


def test_telephony_query_stores_pcm(spark, sf, tmp_path, monkeypatch):
    """The query's samples are stored, and its features are those of the stored samples."""
    monkeypatch.setattr(Q, "shared_folder", lambda spark, name: str(tmp_path / name))
    got = {r["doc_id"]: r["feature"] for r in Q.op10_telephony(spark, sf).collect()}
    stored = spark.read.parquet(str(tmp_path / "media"))
    for r in stored.collect():
        pcm = telephony.unpack_pcm(bytes(r["pcm"]))
        assert pcm.tobytes() == telephony.to_pcm(bytes(r["media"])).tobytes() and f"pcm_crc32={zlib.crc32(pcm)}" in got[r["doc_id"]]
    other = telephony.features(stored.withColumn("pcm", F.substring("pcm", 1, 8))).collect()
    assert len(other) == len(got) and all("samples=4;" in r["feature"] for r in other)


def pcm_brute(tag, payload):
    """Samples one by one: segments and steps of the companders, ADPCM, then midpoints."""
    if tag == 17:
        pcm = ima_brute(payload, 64)
    elif tag == 7:
        size = lambda c: (((c & 15) * 8 + 132) * 2 ** (c >> 4 & 7)) - 132
        pcm = [-size(255 - b) if (255 - b) & 128 else size(255 - b) for b in payload]
    else:
        size = lambda c: (c & 15) * 16 + 8 if c >> 4 & 7 == 0 else ((c & 15) * 16 + 264) * 2 ** ((c >> 4 & 7) - 1)
        pcm = [size(b ^ 85) if (b ^ 85) & 128 else -size(b ^ 85) for b in payload]
    return [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for x in (a, (a + b) >> 1)]


def test_telephony_features_brute(spark, sf):
    """Every column of the whole small table, formats, stored files and features included."""
    got = {r["doc_id"]: r for r in Q.op10_telephony(spark, sf).collect()}
    seen, texts = Counter(), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        g, data = got.pop(r["doc_id"]), (r["text"] or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        tag = [7, 7, 7, 7, 6, 6, 6, 17][zlib.crc32(payload) % 8]
        form = struct.pack("<HHIIHHH", tag, 1, 8000, 8000, 64 if tag == 17 else 1, 4 if tag == 17 else 8, 0)
        body = b"WAVEfmt " + struct.pack("<I", 18) + form + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload
        media = b"RIFF" + struct.pack("<I", len(body)) + body
        assert (g["payload_sha256"], g["media_bytes"], g["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
        pcm = pcm_brute(tag, payload)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        rms = (sum(x * x for x in pcm) / len(pcm)) ** 0.5
        said = dict(x.split("=") for x in g["feature"].split(";"))
        assert (said["tag"], said["samples"], said["peak"], said["crossings"]) == (str(tag), str(len(pcm)), str(max(map(abs, pcm))), str(crossings))
        assert float(said["rms"]) == pytest.approx(rms, abs=0.02) and said["pcm_crc32"] == str(zlib.crc32(struct.pack(f"<{len(pcm)}h", *pcm)))
        assert texts.setdefault(data, tuple(g)[1:]) == tuple(g)[1:]
        seen[tag] += 1
    assert not got and set(seen) == {6, 7, 17}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=40))
def test_stored_pcm_is_lossless(samples):
    pcm = np.array(samples, "<i2")
    assert telephony.unpack_pcm(telephony.pack_pcm(pcm)).tolist() == samples


@pytest.mark.parametrize("rate, target", [(11_025, 16_000), (44_100, 16_000), (8_000, 11_025), (16_000, 8_000)])
def test_resampling_between_any_rates(rate, target):
    pcm = np.random.default_rng(3).integers(-32768, 32768, 500).astype("<i2")
    got = telephony.resample(pcm, rate, target)
    assert len(got) == 500 * target // rate
    for i, x in enumerate(got.tolist()):
        at = min(i * rate / target, 499)
        low, high = int(pcm[int(at)]), int(pcm[min(int(at) + 1, 499)])
        assert abs(x - (low + (high - low) * (at - int(at)))) <= 0.5 + 1e-6


def test_companding_tables():
    # Known values of G.711 and the property that codes differ.
    assert telephony.ulaw_table()[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(telephony.alaw_table().tolist())) == 256


def ima_brute(data, block):
    out, steps = [], telephony.step_table().tolist()
    for b in range(0, len(data) // block * block, block):
        v, i = struct.unpack_from("<hB", data, b)
        i = min(i, 88)
        out.append(v)
        for byte in data[b + 4 : b + block]:
            for n in (byte & 15, byte >> 4):
                s = steps[i]
                d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
                v = max(-32768, min(32767, v - d if n & 8 else v + d))
                i = max(0, min(88, i + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
                out.append(v)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=4))
def test_files_decode_together_as_alone(payloads):
    files = [telephony.wave(p, tag, block=b) for p in payloads for tag, b in ((telephony.IMA, 36), (telephony.ULAW, 1), (telephony.IMA, 64))]
    assert [p.tolist() for p in telephony.to_pcm_all(files)] == [telephony.to_pcm(f).tolist() for f in files]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_ima(data):
    assert telephony.decode_ima(data, 36).tolist() == ima_brute(data, 36)


def test_decode_formats(spark):
    pcm = np.array([0, 100, -100, 32767, -32768], "<i2")
    files = [telephony.wave(pcm.tobytes(), telephony.PCM, 16_000), telephony.wave(bytes(range(256))), telephony.wave(bytes(range(256)), telephony.ALAW), telephony.wave(bytes(72), telephony.IMA, 8_000, 36), telephony.wave(bytes(100), telephony.ULAW, 11_025), None]
    got = {r[0]: np.frombuffer(r[1], "<i2") for r in telephony.decode(spark.createDataFrame(list(enumerate(files)), "doc_id bigint, media binary")).collect()}
    assert got[0].tolist() == pcm.tolist() and got[1][::2].tolist() == telephony.ulaw_table().tolist() and got[2][::2].tolist() == telephony.alaw_table().tolist()
    assert len(got[3]) == 2 * 2 * 65 and len(got[4]) == 100 * 16_000 // 11_025 and len(got[5]) == 0


def test_clashing_and_empty(clashing_docs, no_docs, spark):
    n = clashing_docs.count()
    assert licenses.scan(clashing_docs).count() == telephony.features(telephony.as_wave(clashing_docs)).count() == n
    assert packing.pack(clashing_docs, WORD, 1).count() >= n
    assert licenses.scan(no_docs).count() == telephony.features(telephony.as_wave(no_docs)).count() == packing.pack(no_docs, WORD, 1).count() == 0
    for docs, rows in ((clashing_docs, n), (no_docs, 0)):
        folder = shared_folder(spark, "t")
        binary_ids.write(docs, folder, BYTE, 2)
        assert binary_ids.build_index(spark, folder, shared_folder(spark, "i")).count() == rows
