"""Scalar functions over Columns; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DNS = "6ba7b8109dad11d180b400c04fd430c8"
SENTENCE_END = r"(?<=[.!?])\s+"
#: Patterns of the data model.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = r"https?://[^\s<>\"']+"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"


def content_hash(text: Column) -> Column:
    """SHA-256 of UTF-8, hex."""
    return F.sha2(text.cast("binary"), 256)


def chunk_hash(id_: Column, content: Column) -> Column:
    return F.sha2(F.concat(id_.cast("string"), F.lit(":"), content).cast("binary"), 256)


def _dashed(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5, DNS namespace)."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return _dashed(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def sha1_uuid(name: Column) -> Column:
    """The first 128 bits of SHA-1, written as a UUID."""
    return _dashed(F.sha1(name.cast("binary")))


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def basename(path: Column) -> Column:
    return F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))


def canonical_path(path: Column) -> Column:
    """One form of a path's spellings: slashes forward, a file scheme left out, no empty or ``.`` segment; URLs stay."""
    slashed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file:/*", "/")
    plain = F.regexp_replace(F.regexp_replace(slashed, r"(?<!:)/{2,}", "/"), r"/(\./)+", "/")
    return F.when(is_url(path), path).otherwise(plain)


def is_url(path: Column) -> Column:
    return path.rlike("^https?://")


def url_filename(url: Column) -> Column:
    """The last path segment without its query, or ``document``."""
    name = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://[^/]*", ""), r"([^/]*)$", 1)
    return F.when(name == "", F.lit("document")).otherwise(name)


def file_format(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(ext == "", F.lit("unknown")).otherwise(ext)


def poor_quality(markdown: Column, n_bytes: Column) -> Column:
    """Whether a conversion gave too little text for its file."""
    chars = F.length(F.trim(markdown))
    return (chars == 0) | ((chars < 500) & (n_bytes > 5000)) | (chars / F.greatest(n_bytes, F.lit(1)) < 0.005)


def context_header(header: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("[Context: "), header, F.lit("]")))


def apply_context(prefix: Column, content: Column) -> Column:
    return F.when(prefix == "", content).otherwise(F.concat_ws(" ", prefix, content))


def strip_context(content: Column) -> Column:
    return F.regexp_replace(content, r"^\[Context:.*?\]\s*", "")


def numbered_lines(response: Column, size: Column) -> Column:
    """Texts of ``1. x`` / ``2) y`` lines, padded with empty ones or cut to ``size``."""
    found = F.regexp_extract_all(response, F.lit(r"(?:^|\n)\s*\d+[.)]\s*([^\n]+)"), F.lit(1))
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), size)), F.lit(1), size)


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", "$1"))


def truncated(text: Column, limit: int, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
