"""Documents to chunks: fixed windows, markdown-aware blocks, recursive splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def fixed_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128, least: int = 30) -> DataFrame:
    """(doc_id, window, content): windows of ``size`` words, ``overlap`` shared; short ones go."""
    step = max(1, size - overlap)
    words = T.words(F.col("text"))
    rows = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.array_join(F.slice("w", i + 1, F.lit(size)), " "))
    return rows.select("doc_id", F.posexplode(windows).alias("window", "content")).filter(F.length("content") >= least)


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, content, kind): parts between blank lines, stripped, with their kind."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    return docs.select("doc_id", F.posexplode(parts).alias("block", "content")).withColumn("kind", block_kind(F.col("content")))


def block_kind(block: Column) -> Column:
    """table, code, heading, list or paragraph."""
    lines = F.split(block, "\n")
    table = block.startswith("|") | ((F.size(lines) > 1) & F.forall(F.slice(lines, 1, 3), lambda x: x.contains("|")))
    return (
        F.when(table, "table")
        .when(block.startswith("```"), "code")
        .when(block.startswith("#"), "heading")
        .when(block.rlike(r"^([-*] |[1-5]\. )"), "list")
        .otherwise("paragraph")
    )


def _bounds(size: int, overlap: int, late_header: bool):
    """A UDF of blocks' lengths and whether they are headings: (start, end, head) of each chunk in one pass.

    ``head`` is the place of the heading that holds for the chunk, -1 without one. No text goes to Python.
    """

    def bounds(lengths: pd.Series, headings: pd.Series) -> pd.Series:
        out = []
        for row, heads in zip(lengths, headings):
            found, start, chars, head = [], 0, 0, -1
            for i, n in enumerate(row):
                now = i if heads[i] else head
                if i > start and chars + n > size:
                    found.append({"start": start, "end": i, "head": now if late_header else head})
                    start, chars = i, min(int(row[i - 1]), overlap)
                chars, head = chars + int(n), now
            if len(row):
                found.append({"start": start, "end": len(row), "head": head})
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(bounds, "array<struct<start:int,end:int,head:int>>")


def markdown_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128, late_header: bool = False) -> DataFrame:
    """(doc_id, chunk_index, content, section_header): blocks packed up to ``size`` characters.

    A flush seeds the next chunk with the last ``overlap`` characters of the last block.
    ``late_header`` gives a flushed chunk the header of the block that came after it. Time is linear in
    the number of blocks; null and blank texts give no chunk.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    rows = docs.select("doc_id", parts.alias("parts"))
    lengths, heads = F.transform("parts", lambda b: F.length(b)), F.transform("parts", lambda b: block_kind(b) == "heading")
    rows = rows.withColumn("bounds", _bounds(size, overlap, late_header)(lengths, heads))

    def chunk(c):
        body = F.slice("parts", c["start"] + 1, c["end"] - c["start"])
        tail = F.transform(F.slice("parts", F.greatest(c["start"], F.lit(1)), F.when(c["start"] > 0, 1).otherwise(0)), lambda b: F.right(b, F.lit(overlap)))
        header = F.when(c["head"] >= 0, F.trim(F.regexp_replace(F.get("parts", c["head"]), "^#+", ""))).otherwise("")
        return F.struct(F.array_join(F.concat(tail, body), "\n\n").alias("content"), header.alias("section_header"))

    return rows.select("doc_id", F.posexplode(F.transform("bounds", chunk)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.content", "c.section_header")


_HEADER = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


class Recursive:
    """Splits one text: by headers, paragraphs, sentences, then words; sizes in estimated tokens."""

    def __init__(self, size: int = 1024, overlap: int = 128, stale_buffer: bool = False):
        self.size, self.overlap, self.stale = size, overlap, stale_buffer

    @staticmethod
    def tokens(text: str) -> int:
        return max(1, len(text) // 4)

    def split(self, text: str) -> list[tuple[str, str]]:
        """(content, section header) of each chunk; a header's line is not content."""
        marks = [(m.start(), m.end(), m[2].strip()) for m in _HEADER.finditer(text)]
        bounds = [(0, "")] + [(end, title) for _, end, title in marks]
        ends = [start for start, _, _ in marks] + [len(text)]
        out = []
        for (begin, title), end in zip(bounds, ends):
            if body := text[begin:end].strip():
                out += [(c, title) for c in self._parts(body)]
        return self._overlapped(out)

    def _parts(self, body: str) -> list[str]:
        if self.tokens(body) <= self.size:
            return [body]
        paragraphs = [p for p in (x.strip() for x in re.split(r"\n\s*\n", body)) if p]
        if len(paragraphs) > 1:
            return self._packed(paragraphs, "\n\n")
        sentences = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", body)) if s]
        if len(sentences) > 1:
            return self._packed(sentences, " ", whole=True)
        words, step = body.split(), max(1, (self.size - self.overlap) // 4)
        windows = (" ".join(words[i : i + self.size]) for i in range(0, len(words), step))
        return [w for w in windows if self.tokens(w) >= 10]

    def _packed(self, parts: list[str], glue: str, whole: bool = False) -> list[str]:
        out, buffer = [], ""
        for part in parts:
            joined = f"{buffer}{glue}{part}" if buffer else part
            if self.tokens(joined) <= self.size:
                buffer = joined
                continue
            if buffer:
                out.append(buffer)
            if self.tokens(part) > self.size and not whole:
                out += self._parts(part)
                buffer = buffer if self.stale else ""
            else:
                buffer = part
        return out + ([buffer] if buffer else [])

    def _overlapped(self, chunks: list[tuple[str, str]]) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for content, title in chunks:
            if out and self.overlap:
                last = out[-1][0].split()
                lead = " ".join(last[-min(self.overlap // 4, len(last)) :]) if self.overlap >= 4 else ""
                joined = f"{lead} {content}" if lead else content
                if self.tokens(joined) <= int(self.size * 1.5):
                    content = joined
            out.append((content, title))
        return out


def recursive_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128, least: int = 30, stale_buffer: bool = False) -> DataFrame:
    """(doc_id, chunk_index, content, section_header) by ``Recursive``, in Arrow batches."""
    splitter = Recursive(size, overlap, stale_buffer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                kept = [c for c in splitter.split(text or "") if len(c[0].strip()) >= least]
                rows += [(doc_id, i, content, title) for i, (content, title) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "section_header"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk_index int, content string, section_header string")


STRATEGIES = {"fixed": fixed_chunks, "markdown": markdown_chunks, "recursive": recursive_chunks}


def create_chunks(docs: DataFrame, strategy: str = "recursive", size: int = 1024, overlap: int = 128, least: int = 30, chunker: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks by the named strategy; an unknown one is taken as recursive. Short chunks go last.

    ``layout`` packs within sections; ``hybrid`` asks the ``chunker`` first.
    """
    if strategy in ("layout", "hybrid"):
        from lodestone.operators import layout

        made = layout.hybrid(docs, chunker if strategy == "hybrid" else None, size, overlap, least)
        return made.filter(F.length(F.trim("content")) >= least)
    made = STRATEGIES.get(strategy, recursive_chunks)(docs, size, overlap)
    if "window" in made.columns:
        made = made.withColumnRenamed("window", "chunk_index").withColumn("section_header", F.lit(""))
    return made.filter(F.length(F.trim("content")) >= least).select("doc_id", "chunk_index", "content", "section_header")


def kind(block: str) -> str:
    """``block_kind`` of one text."""
    lines = block.split("\n")
    if block.startswith("|") or (len(lines) > 1 and all("|" in x for x in lines[:3])):
        return "table"
    marks = (("```", "code"), ("#", "heading"))
    found = next((k for mark, k in marks if block.startswith(mark)), None)
    return found or ("list" if re.match(r"([-*] |[1-5]\. )", block) else "paragraph")


def _fixed(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    words = [w for w in re.split(r"\s+", text, flags=re.A) if w]
    return [(" ".join(words[i : i + size]), "") for i in range(0, len(words), max(1, size - overlap))]


def _markdown(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    parts = [b for b in (x.strip(" \t\n\r\f\v") for x in text.split("\n\n")) if b]
    out, start, chars, head = [], 0, 0, ""
    chunk = lambda i, j: "\n\n".join([*([parts[i - 1][-overlap:] if overlap else ""] if i else []), *parts[i:j]])
    for i, b in enumerate(parts):
        if i > start and chars + len(b) > size:
            out.append((chunk(start, i), head))
            start, chars = i, min(len(parts[i - 1]), overlap)
        chars, head = chars + len(b), b.lstrip("#").strip(" ") if kind(b) == "heading" else head
    return [*out, (chunk(start, len(parts)), head)] if parts else []


def split(text: str | None, strategy: str = "recursive", size: int = 1024, overlap: int = 128, least: int = 30) -> list[tuple[int, str, str]]:
    """(chunk_index, content, section_header) of one text: what ``create_chunks`` gives for it."""
    text = text or ""
    if strategy in ("fixed", "markdown"):
        made = list(enumerate((_fixed if strategy == "fixed" else _markdown)(text, size, overlap)))
        made = [(i, c) for i, c in made if strategy == "markdown" or len(c[0]) >= least]
    else:
        made = list(enumerate(c for c in Recursive(size, overlap).split(text) if len(c[0].strip()) >= least))
    return [(i, content, header) for i, (content, header) in made if len(content.strip(" ")) >= least]
