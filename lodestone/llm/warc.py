"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

``responses`` frames pages as WARC/1.1 response records (for tables that hold bare pages).
``derive`` reads response records and writes, for each, a metadata record (JSON: all HTTP and
WARC headers in order, title, links, digests) and a conversion record (plain text). Both carry the
response's id in WARC-Refers-To, its target URI and date, its payload digest as
WARC-Source-Payload-Digest and its own HTTP content type, and digests of their own blocks.
``parse`` reads a record; ``write_files`` and ``read_files`` write .warc files and read them.

Of a response only WARC-Type, a record id and Content-Length are needed: digests are checked where
they are given (SHA-1, in base 32 or hex) and computed where not; header names match in any case.
Chunked and gzip or deflate bodies are decoded (one that can't be is read as it stands), and
the text by the charset of the header, else of a meta element, else UTF-8. Pages are
scanned once, from tag to tag, in time linear in their length.

Record ids are name-based (UUID version 5 of URI, page, payload digest and kind), so a task that
runs again writes the same bytes. Defined results: null html is an empty payload; a null URL is an
empty URI; repeated rows are the same record and give equal records with equal ids; an empty table
gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import prepare, tidy

#: The date of records made from bare pages, which have none.
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_END = re.compile(r"""=\s*(["'])|>""")
_TARGET = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
#: Elements whose content is not seen, elements that end a line, elements that link.
HIDDEN = frozenset("script style noscript template".split())
BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 ul ol li table tr nav header footer title head body blockquote pre br hr".split())
LINKS = frozenset("a link img".split())
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN} | {"title": re.compile("</title", re.I)}

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(uri: str, key: object, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {key} {uri}')}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record; line ends in values become blanks."""
    named = {"WARC-Type": kind, **headers, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in named.items())
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def fields(lines: list[str]) -> Headers:
    """Header lines as (name, value) in order, repeated ones too; a line that begins with a blank goes on with the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def first(headers: Headers, name: str, default: str = "") -> str:
    """The first value of a header, whose name matches in any case."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def _agrees(given: str, data: bytes) -> bool:
    """Whether a digest is that of the data; an algorithm that is not known here counts as agreeing."""
    kind, _, value = given.partition(":")
    own = hashlib.sha1(data).digest()
    return kind.lower() not in ("sha1", "sha-1") or value.upper() == base64.b32encode(own).decode() or value.lower() == own.hex()


def records(data: bytes) -> Iterator[tuple[Headers, bytes, bytes]]:
    """(headers, block, whole bytes) of the records that stand one after another in ``data``."""
    at = 0
    while data[at : at + 1]:
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not head[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = fields(head[1:])
        stop = end + 4 + int(first(headers, "Content-Length", "0"))
        if stop > len(data):
            raise ValueError("record is cut")
        block = data[end + 4 : stop]
        given = first(headers, "WARC-Block-Digest")
        if given and not _agrees(given, block):
            raise ValueError("block digest differs")
        yield headers, block, data[at:stop] + b"\r\n\r\n"
        at = stop


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(first value of each header, block) of a record; a block digest is checked."""
    found = next(records(data), None)
    if found is None:
        raise ValueError("not a WARC record")
    return dict(reversed(found[0])), found[1]


def response(uri: str, key: object, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    own = digest(payload)
    headers = {"WARC-Record-ID": record_id(uri, f"{key} {own}", "response"), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": own, "Content-Type": "application/http; msgtype=response"}
    return record("response", headers, http + payload)


def _unchunked(data: bytes) -> bytes:
    """A chunked body's chunks; ``data`` itself where it is not chunked after all."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else data


def body(http: Headers, payload: bytes) -> bytes:
    """The payload without its transfer and content encodings."""
    if "chunked" in first(http, "Transfer-Encoding").lower():
        payload = _unchunked(payload)
    coding = first(http, "Content-Encoding").strip().lower()
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompressobj(bits).decompress(payload)
        except zlib.error:
            continue
    return payload


def decoded(http: Headers, data: bytes) -> str:
    """A page's text by the charset of its header, else of a meta element, else UTF-8."""
    said = _CHARSET.search(first(http, "Content-Type")) or _CHARSET.search(data[:1024].decode("latin-1"))
    try:
        return data.decode(said[1] if said else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def read_page(page: str) -> tuple[str | None, list[dict[str, str]], str]:
    """(title, links, visible text) of a page in one pass from tag to tag.

    The text has a line per block, white space within lines as one blank, and no empty lines.
    A comment or hidden element that never ends hides nothing but its own tag. Each search that
    finds nothing is not made again, so the time is linear.
    """
    parts: list[str] = []
    links: list[dict[str, str]] = []
    title, at, missing = None, 0, set()
    while (begin := page.find("<", at)) >= 0:
        parts.append(page[at:begin])
        if page.startswith("<!--", begin) and "-->" not in missing:
            if (end := page.find("-->", begin + 4)) >= 0:
                parts.append(" ")
                at = end + 3
                continue
            missing.add("-->")
        name = _NAME.match(page, begin + 1)
        if not name and not page.startswith("<!", begin):
            parts.append("<")
            at = begin + 1
            continue
        end = page.find(">", begin) if not name else _tag_end(page, name.end())
        if end < 0:  # no tag ends from here on
            at = begin
            break
        at = end + 1
        kind = name[1].lower() if name else "!"
        opens = name is not None and page[begin + 1] != "/"
        if kind in BLOCKS:
            parts.append("\n")
        if not opens:
            continue
        if kind in LINKS and (m := _TARGET.search(page, name.end(), end)):
            links.append({"tag": kind, "url": html.unescape(m[1] or m[2] or m[3] or "")})
        if kind in _CLOSES and kind not in missing and (kind in HIDDEN or title is None):
            close = _CLOSES[kind].search(page, at)
            if close is None:
                missing.add(kind)
            elif kind == "title":
                title = html.unescape(" ".join(page[at : close.start()].split()))
            else:
                parts.append(" ")
                at = close.end()
    parts.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split("\n"))
    return title, links, "\n".join(x for x in lines if x)


def _tag_end(page: str, at: int) -> int:
    """Where a tag's ``>`` stands, outside quoted values; the next one where a quote never ends."""
    while m := _END.search(page, at):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1
    return -1


def plain_text(page: str) -> str:
    return read_page(page)[2]


def derivatives(data: bytes) -> tuple[bytes, bytes]:
    """(metadata record, conversion record) of a response record."""
    source, block, _ = next(records(data))
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *rest = head.decode("latin-1").split("\r\n")
    http = fields(rest)
    title, links, text = read_page(decoded(http, body(http, payload)))
    uri, own = first(source, "WARC-Target-URI"), first(source, "WARC-Record-ID")
    common = {
        "WARC-Date": first(source, "WARC-Date", DATE),
        "WARC-Target-URI": uri,
        "WARC-Refers-To": own,
        "WARC-Source-Payload-Digest": first(source, "WARC-Payload-Digest") or digest(payload),
        "WARC-Source-Content-Type": first(http, "Content-Type"),
    }
    envelope = {"status": status, "http_headers": http, "source": source, "title": title, "links": links, "payload_length": len(payload)}
    said = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    metadata = record("metadata", {"WARC-Record-ID": record_id(uri, own, "metadata"), **common, "Content-Type": "application/json"}, said)
    conversion = record("conversion", {"WARC-Record-ID": record_id(uri, own, "conversion"), **common, "Content-Type": "text/plain; charset=utf-8"}, text.encode("utf-8", "surrogatepass"))
    return metadata, conversion


def _mapped(df: DataFrame, make, names: list[str]) -> DataFrame:
    """A key column and binary columns made from the row, in Arrow batches of at most 200 rows."""
    prepare(df.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = list(zip(*[make(*row) for row in zip(*[c.to_pylist() for c in part.columns])]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in made]], ["page_id", *names])

    return df.mapInArrow(run, "page_id bigint, " + ", ".join(f"{n} binary" for n in names))


def responses(pages: DataFrame) -> DataFrame:
    """page_id and its response record."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return _mapped(rows, lambda key, url, page: (response(url, key, page.encode("utf-8", "surrogatepass")),), ["response"])


def derive(responses: DataFrame) -> DataFrame:
    """page_id and the metadata and conversion records of its response record."""
    return _mapped(responses.select("page_id", "response"), lambda _, data: (data, *derivatives(data)), ["response", "metadata", "conversion"])


def write_files(derived: DataFrame, folder: str, rows_per_file: int = 2_000) -> None:
    """The records of each row one after another, in files of WARC records by Spark's commit protocol.

    A row's records end with a line end, which is the one that the text writer sets after each row.
    """
    whole = F.concat("response", "metadata", "conversion")
    lines = derived.select(F.substring(whole, F.lit(1), F.octet_length(whole) - 1).cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", rows_per_file).text(folder)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, refers_to, record) of all records in .warc or .warc.gz files under a path; a task holds one file."""
    prepare(spark)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [(first(h, "WARC-Type"), first(h, "WARC-Record-ID"), first(h, "WARC-Refers-To") or None, whole) for h, _, whole in records(_members(content.as_py()))]
                for at in range(0, len(rows), 200):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 200]), [*[pa.string()] * 3, pa.binary()])], ["type", "record_id", "refers_to", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "type string, record_id string, refers_to string, record binary")


def _members(data: bytes) -> bytes:
    """A file's bytes, with gzip members (one per record, as is usual) put together."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def summary(derived: DataFrame) -> DataFrame:
    """What the three records say when read back: ids, links between them, digests and sizes."""
    prepare(derived.sparkSession)
    names = ["page_id", "url", "response_id", "metadata_id", "conversion_id", "refers_to", "source_digest", "metadata_digest", "conversion_digest", "title", "n_links", "text_chars", "text_sha256", "warc_bytes"]
    types = [pa.int64(), *[pa.string()] * 9, pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def row(page_id, response_bytes, metadata_bytes, conversion_bytes):
        (r, _), (m, envelope), (c, text) = map(parse, (response_bytes, metadata_bytes, conversion_bytes))
        if not m["WARC-Refers-To"] == c["WARC-Refers-To"] == r["WARC-Record-ID"]:
            raise ValueError("records are not linked")
        said = json.loads(envelope)
        return page_id, r["WARC-Target-URI"], r["WARC-Record-ID"], m["WARC-Record-ID"], c["WARC-Record-ID"], c["WARC-Refers-To"], c["WARC-Source-Payload-Digest"], m["WARC-Block-Digest"], c["WARC-Block-Digest"], said["title"], len(said["links"]), len(text.decode("utf-8", "surrogatepass")), hashlib.sha256(text).hexdigest(), sum(map(len, (response_bytes, metadata_bytes, conversion_bytes)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*x) for x in zip(*[c.to_pylist() for c in batch.columns])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in zip(names, types))
    return derived.select("page_id", "response", "metadata", "conversion").mapInArrow(run, schema)
