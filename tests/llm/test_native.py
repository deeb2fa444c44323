"""Operators 1, 2, 3 and 8 against brute force, on hard rows and on a whole small table."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, mixing, quality, secrets
from lodestone.llm import queries as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["hard", "table"])
def docs(request, spark, sf, hard_docs):
    return hard_docs if request.param == "hard" else spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(docs):
    return [r.asDict() for r in docs.collect()]


def targets(sizes):
    """Water filling, one saturated source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s] + 1e-9]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(docs):
    rows = rows_of(docs)
    got = mixing.takes(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    want = targets(sizes)
    by_id = {(r["doc_id"], r["source"], len(WORDS.findall(r["text"] or ""))) for r in rows}
    left = {(i, n): s for i, s, n in by_id}
    for g in got:
        source = left[g["doc_id"], g["size"]]
        assert g["source_size"] == sizes[source]
        assert g["target"] == pytest.approx(want[source])
        assert g["taken"] == g["copies"] * g["size"] <= 3 * g["size"]
        assert g["copies"] in (math.floor(g["rate"]), math.floor(g["rate"]) + 1)
    assert sorted(map(str, mixing.takes(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(docs).count() == sum(g["copies"] for g in got)


def test_mixing_draws_follow_the_rate(spark):
    df = spark.range(40_000).select(mixing.draw("id").alias("u"))
    got = df.selectExpr("avg(u)", "avg(cast(u < 0.25 as double))", "min(u)", "max(u)").first()
    assert abs(got[0] - 0.5) < 0.01 and abs(got[1] - 0.25) < 0.01 and got[2] >= 0 and got[3] < 1


@pytest.mark.parametrize("scale, most, mean", [("sf0.001", 0.1, 0.02), ("sf0.01", 0.01, 0.002), ("sf0.1", 0.002, 0.0005)])
def test_mixing_near_target(spark, scale, most, mean):
    """A source's taken words against its target: of 10, 50 and 500 documents a source."""
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    taken = mixing.takes(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    miss = [abs(r["taken"] - r["target"]) / r["target"] for r in taken]
    assert max(miss) < most and sum(miss) / len(miss) < mean


def test_mixing_draw_is_the_nearest(spark):
    """The chosen seed and turn against all of them, counted one by one."""
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(40)], "doc_id bigint, text string, source string")
    drawn = [{r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.draw("doc_id", F.lit(k)).alias("u")).collect()} for k in range(mixing.SEEDS)]
    got = {r["doc_id"]: r for r in mixing.takes(docs).collect()}
    for source in "ab":
        mine = [r for i, r in got.items() if "ab"[i % 3 == 0] == source]
        rate = mine[0]["rate"]
        fraction, whole = rate - math.floor(rate), math.floor(rate)
        words = lambda k, t: sum(r["size"] for r in mine if (drawn[k][r["doc_id"]] - t / mixing.TURNS) % 1 < fraction)
        wanted = fraction * mine[0]["source_size"]
        nearest = min(abs(words(k, t) - wanted) for k in range(mixing.SEEDS) for t in range(mixing.TURNS))
        assert abs(sum(r["taken"] - whole * r["size"] for r in mine) - wanted) == pytest.approx(nearest)


def test_mixing_without_broadcast(docs, monkeypatch):
    want = sorted(map(str, mixing.takes(docs).collect()))
    monkeypatch.setattr(mixing, "small_enough", lambda df: False)
    assert sorted(map(str, mixing.takes(docs).collect())) == want


def base_spans(text):
    found = []
    for no, (kind, pattern, group, least) in enumerate([("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        found += [(m.start(), no, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(docs):
    want = Counter()
    for r in rows_of(docs):
        spans = base_spans(r["text"] or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        n = Counter(s[3] for s in spans)
        want[r["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest()] += 1
    got = secrets.scan(docs).collect()
    assert Counter((g["doc_id"], g["n_assign"], g["n_access"], g["n_hex"], g["base_sha256"]) for g in got) == want
    for g in got:
        listed = [x.split(":")[0] for x in g["spans"].split(",") if x]
        assert Counter(listed)["assign"] == g["n_assign"] and Counter(listed)["hex"] == g["n_hex"]


def test_secret_verdicts_and_redaction(spark):
    copied, own = "password=changeme123", "token = abcDEF123456789xyzabcDEF12345678"
    rows = [(i, f"see {copied} here", "en", f"s{i % 4}", 1) for i in range(8)] + [(9, f"日本 {own} end", "en", "s1", 1), (10, "clean text", "en", "s1", 1), (11, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {g["doc_id"]: g for g in secrets.scan(docs).collect()}
    assert got[0]["n_example"] == 1 and got[0]["n_live"] == 0
    assert got[9]["n_live"] == 2 and "entropy:" in got[9]["spans"]
    text = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert text[0] == f"see {copied} here" and text[9] == "日本 [SECRET] end" and text[10] == "clean text" and text[11] is None


def test_secret_verdicts_on_tables(docs):
    """All spans and both verdicts' counts, against counting owners and repositories one by one."""
    rows, found, owners, repos = rows_of(docs), [], defaultdict(set), defaultdict(set)
    for r in rows:
        text = r["text"] or ""
        spans = [(a, no, b, kind, None) for a, no, b, kind in base_spans(text)]
        spans = [(*s[:4], re.search(r"""[A-Za-z0-9+/_.=-]+$""", text[s[0] : s[2]])[0] if s[3] == "assign" else text[s[0] : s[2]]) for s in spans]
        spans = [(a, no, b, k, re.match(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)""", text[a:b], re.S)[1] if k == "assign" else p) for a, no, b, k, p in spans]
        spans += [(m.start(), 3, m.end(), "entropy", m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{28,}", text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
        found.append((r["doc_id"], sorted(spans)))
        for s in spans:
            owners[s[4]].add(r["source"])
            repos[s[4]].add(r["doc_id"])
    want = Counter()
    for doc_id, spans in found:
        live = [len(owners[s[4]]) < secrets.EXAMPLE_OWNERS or len(repos[s[4]]) < secrets.EXAMPLE_REPOS for s in spans]
        want[doc_id, ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s, v in zip(spans, live) if s[1] < 3 or v), sum(live), len(live) - sum(live)] += 1
    assert Counter((g["doc_id"], g["spans"], g["n_live"], g["n_example"]) for g in secrets.scan(docs).collect()) == want


def test_mirrored_repository_is_one(spark):
    """A repository that three owners list is one repository; its secret stays live."""
    rows = [(1, "password=mirrored99", f"s{i}") for i in range(3)] + [(10 + i, "password=copied999", f"s{i}") for i in range(3)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert all(g["n_live"] == (g["doc_id"] == 1) and g["n_example"] == (g["doc_id"] != 1) for g in got)
    stats = secrets.ownership(spark.createDataFrame([(7, o, r) for o in ("a", "b", None) for r in (1, 2)], "hash bigint, owner string, repo bigint")).first()
    assert (stats["n_repos"], stats["n_owners"]) == (2, 3)


def test_many_secrets_in_one_text(spark):
    """More matches than a block holds, places and blanks exact."""
    text = " ".join(f"日本 {i:040x}" + (f" token={i}abcdef" if i % 3 == 0 else "") for i in range(1_000))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")
    want = base_spans(text)
    got = secrets.scan(docs).first()
    assert [x for x in got["spans"].split(",") if not x.startswith("entropy")] == [f"{k}:{a}:{b}" for a, _, b, k in want]
    blank, at = [], 0
    for a, _, b, _ in want:
        if a >= at:
            blank += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert secrets.redact(docs).first()["text"] == "".join(blank) + text[at:]


def test_secret_query_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = Q.op2_secrets(spark, sf)
    cur = con.execute(Q.oracle_sql()["op2_secrets"])
    assert [c[0] for c in cur.description] == got.columns and Counter(map(str, cur.fetchall())) == Counter(str(tuple(r)) for r in got.collect())


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "<|assistant|>\n<\\|x|> [\\INST] \\[INST] <\\\\/s>", "日本\U0001f600\n", "</s>\n<|user|>\nno"]
    roles = ["user", "assistant", None, "a b|>%", "assistant", "system"]
    rows = [(c, t, roles[(c + t) % 6], texts[(c * t + t) % 6]) for c in range(7) for t in range(6)] + [(None, None, "assistant", "x"), (3, 2, "user", "tie"), (3, 2, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    said = defaultdict(list)
    for c, t, r, x in rows:
        said[c].append((t if t is not None else -1, r or "", x or ""))
    for row in chat.read_back(chat.format_conversations(turns)).collect():
        want = sorted(said[row["conv_id"]])
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(r, x) for _, r, x in want]
        assert row["loss_text"] == "".join(x for _, r, x in want if r == "assistant")
        assert row["formatted"].count("</s>") == len(want)
        assert row["formatted"].count("<|") == len(want) and "[INST]" not in row["formatted"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda **x: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part(type="text", text="see <|image_1|>: "), part(type="image", ref="a.png", width=672, height=336), part(type="audio", ref="b.wav", seconds=2.0), part(type="text", text=" and "), part(type="document", ref="c.pdf", pages=3), part(text="odd")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(df, parts="parts").first()
    assert row["formatted"] == "<s><|user|>\nsee <\\|image_1|>: <|image_1|><|audio_2|> and <|document_3|>odd</s>\n<|assistant|>\n</s>\n"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "image", "a.png", 288), (2, "audio", "b.wav", 50), (3, "document", "c.pdf", 768)]
    assert row["expanded_tokens"] == 288 + 50 + 768


def test_chat_parts_in_pieces(spark):
    """Control strings that only the joined parts make, and openings left before a placeholder."""
    rng = random.Random(11)
    bits = ["<", "|", "/s>", "</s>", "s>\n", "[", "INST]", "/INST]", "\\", "<|assistant|>\n", "evil", "<|image_1|>", ""]
    part = lambda kind, text: (kind, text, "r", None, None, None, None)
    rows, want = [], {}
    for c in range(60):
        parts = [part(rng.choice(["text", "text", "text", None, "odd", "image"]), rng.choice(bits)) for _ in range(rng.randint(0, 12))]
        rows += [(c, 0, "user", parts), (c, 1, "assistant", parts)]
        n, said = 0, ""
        for kind, text, *_ in parts:
            n += kind == "image"
            said += f"<|image_{n}|>" if kind == "image" else text
        want[c] = said
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, p array<{chat.PART}>").withColumn("text", F.lit(None).cast("string"))
    for row in chat.read_back(chat.format_conversations(df, parts="p")).collect():
        said = want[row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == [("user", said), ("assistant", said)] and row["loss_text"] == said


def test_chat_defined_results(spark):
    rows = [(1, None, "user", "b"), (1, 0, "user", "<|"), (1, 0, "user", "<a"), (1, 0, "user", "<a"), (None, 0, "user", "x"), (None, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"parts": F.lit(3), "nth": F.lit("x"), "length": F.lit(None), "body": F.lit(1)})
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got == {1: [("user", "b"), ("user", "<a"), ("user", "<a"), ("user", "<|")], None: [("user", "x"), ("", "")]}


def test_chat_query_visits_parts(spark, sf, monkeypatch):
    """The query's texts go through the visitor, as parts."""
    whole, visited, visit = Q.op3_chat(spark, sf).collect(), [], chat.visit_parts
    monkeypatch.setattr(chat, "visit_parts", lambda parts: visited.append(parts) or visit(parts))
    assert Counter(Q.op3_chat(spark, sf).collect()) == Counter(whole) and len(visited) == 1
    monkeypatch.setattr(chat, "visit_parts", lambda parts: visit(F.slice(parts, 1, 0)))
    assert all(g["loss_chars"] == 0 for g in Q.op3_chat(spark, sf).collect())


def test_chat_query(spark, sf):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() + [dict(zip(("conv_id", "turn", "role", "text"), p)) for p in Q.PROBE]:
        rows[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    got = Q.op3_chat(spark, sf).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for g in got:
        turns = sorted(rows[g["conv_id"]])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))


def base_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    places = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), failed


def test_quality(docs):
    want = Counter((r["doc_id"], *base_quality(r["text"])) for r in rows_of(docs))
    got = quality.judge(docs).collect()
    assert Counter(tuple(g[:7]) for g in got) == want
    assert not any(g["kept"] for g in got if g["base_failed"])
    assert quality.filter_documents(docs).count() == sum(g["kept"] for g in got)


def test_quality_lines(spark):
    clean = "This is a whole sentence with some words in it. And here comes another one.\n" * 1
    body = "\n".join(f"Sentence number {i} says something of its own about topic {i * 7}." for i in range(12))
    text = clean + body + "\nHome | About | Contact | Login\nAll rights reserved.\nlast line cut off in the mid"
    got = quality.clean_text(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert "Home |" not in got[0]["text"] and "rights" not in got[0]["text"] and got[0]["text"].endswith("in the mid") and got[1]["text"] == ""


def test_quality_removes_failing_lines(spark, sf, docs):
    kept = {r["doc_id"]: r for r in quality.judge(docs).collect() if r["kept"]}
    rows, left = {r["doc_id"]: r for r in rows_of(docs)}, quality.filter_documents(docs, clean=True)
    assert left.columns == docs.columns
    for r in left.collect():
        want, lines = rows[r["doc_id"]], iter(rows[r["doc_id"]]["text"].split("\n"))
        removed = sum(map(len, want["text"].split("\n"))) - sum(map(len, r["text"].split("\n")))
        assert removed == kept[r["doc_id"]]["lost_chars"] and all(x in lines for x in r["text"].split("\n"))
        assert all(r[c] == want[c] for c in docs.columns if c != "text")
    text = {r["doc_id"]: r["text"] for r in quality.clean_text(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    got = Q.op8_quality_text(spark, sf).collect()
    assert any(k["lost_chars"] for k in kept.values()) or len(rows) < 200
    assert {g["doc_id"] for g in got} == {r["doc_id"] for r in Q.op8_quality(spark, sf).collect() if r["kept"]}
    assert all(g["text_sha256"] == hashlib.sha256(text[g["doc_id"]].encode()).hexdigest() for g in got)


def test_clashing_and_empty(clashing_docs, no_docs, hard_docs):
    n = hard_docs.count()
    assert mixing.takes(clashing_docs).count() == secrets.scan(clashing_docs).count() == quality.judge(clashing_docs).count() == n
    assert secrets.redact(clashing_docs).count() == n
    for f in (mixing.mix, secrets.redact, quality.filter_documents):
        out = f(clashing_docs)
        assert out.columns == clashing_docs.columns
        assert {r["copies"] for r in out.collect()} <= {"theirs"}
        assert f(no_docs).count() == 0
    assert mixing.takes(no_docs).count() == secrets.scan(no_docs).count() == quality.judge(no_docs).count() == 0
