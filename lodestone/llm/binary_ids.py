"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of frames, closed by a newline::

    length      u64   bytes of the payload
    length_crc  u32   masked CRC-32 of the eight bytes before
    payload           doc_id i64, flags u8 (1: null id; 2: ids are u16, else u32), ids
    payload_crc u32   masked CRC-32 of the payload

All numbers are little-endian; a mask rotates a checksum by 15 bits and adds a constant, as
checksums of data that hold checksums are weak. Frames are gathered to ``FILE_BYTES`` and Spark's own
text writer writes each such run as a file of its own (a run is a row, the newline its line end), so
files land by its commit protocol on whatever store the folder is in, and a lost executor's task is
written again. No file is larger than that and one document. Documents are in
ascending id order over files and within them; files are ordered by the numbers in their names, task
and file of the task. ``build_index`` walks the files and writes
(file, offset, length, doc_id, n_tokens, start); ``read_at`` reads any of them in any order.

Range partitioning samples the input first, so it is read twice; rows with one id are spread
by a hash of their texts. Defined results: null text is empty, so only the end id is written;
a null id comes first; repeated rows are records of their own; ties of an id go by text hash;
an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, prepare, small_enough, tidy
from lodestone.llm.tokens import encoder

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
ID = struct.Struct("<qB")
#: Bytes after which a task goes on in another file.
FILE_BYTES = 16 << 20


class Corrupt(ValueError):
    """A frame's lengths or checksums don't fit."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The frame of one document."""
    flags = (doc_id is None) | 2 * (ids.dtype == np.dtype("<u2"))
    payload = ID.pack(0 if doc_id is None else doc_id, flags) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def record(data: bytes | memoryview, offset: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids as u32, offset of the next frame), checked."""
    view = memoryview(data)
    if len(view) < offset + HEAD.size:
        raise Corrupt(f"cut off in a head at {offset}")
    length, crc = HEAD.unpack_from(view, offset)
    begin, end = offset + HEAD.size, offset + HEAD.size + length
    if masked_crc(view[offset : offset + 8]) != crc or len(view) < end + 4:
        raise Corrupt(f"bad length at {offset}")
    payload = view[begin:end]
    if struct.unpack_from("<I", view, end)[0] != masked_crc(payload):
        raise Corrupt(f"bad record at {offset}")
    doc_id, flags = ID.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=ID.size).astype("<u4")
    return None if flags & 1 else doc_id, ids, end + 4


def records(data: bytes | memoryview) -> Iterator[tuple[int, int | None, np.ndarray, int]]:
    """(offset, doc_id, ids, offset of the next frame) of all frames of a file, checked."""
    at, end = 0, len(data) - 1
    if end >= 0 and data[end] != 10:
        raise Corrupt("cut off at the end")
    while at < end:
        doc_id, ids, after = record(data, at)
        yield at, doc_id, ids, after
        at = after
    if end >= 0 and at != end:
        raise Corrupt(f"cut off at {at}")


def _framed(path: str, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        end = np.asarray([end_id], enc.dtype).tobytes()
        made, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 2_000):  # frames of 2,000 texts at a time, whatever the batch's size
                for i, b in zip(ids[at : at + 2_000], enc.encode_all(texts.slice(at, 2_000))):
                    made.append(frame(i, np.frombuffer(b + end, enc.dtype)))
                    size += len(made[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], ["frames"])
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], ["frames"])

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Write all texts' ids to ``folder``, ascending by doc_id."""
    prepare(docs.sparkSession)
    spread = F.xxhash64("text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", F.col("text").cast("string").alias("text"), spread.alias("spread")).repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread")
    frames = ranged.select("doc_id", "text").mapInArrow(_framed(tokenizer_path, end_id), "frames binary")
    frames.select(F.col("frames").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


@tidy
def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            start, rows = 0, []
            for at, doc_id, ids, after in records(memoryview(content.as_buffer())):
                rows.append((file, at, after - at, doc_id, len(ids), start, zlib.crc32(ids)))
                start += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES)], INDEX_NAMES)


INDEX_NAMES = ["file", "offset", "length", "doc_id", "n_tokens", "start_in_file", "ids_crc32"]
INDEX_TYPES = [pa.string(), *[pa.int64()] * 6]


def file_order(file: Column) -> list[Column]:
    """The numbers in a file's name, its task and its place among the task's files: ascending as ids are."""
    return [F.regexp_extract(file, r"part-(\d+)", 1).cast("long").alias("task"), F.regexp_extract(file, r"-c(\d+)\b", 1).cast("long").alias("nth")]


def build_index(spark: SparkSession, folder: str, index_folder: str) -> DataFrame:
    """Walk and check every record of ``folder``; write the index and return it.

    ``start`` counts ids over all files before: running sums over a task's files, and over one row per task.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = ", ".join(f"{n} {'string' if n == 'file' else 'bigint'}" for n in INDEX_NAMES)
    walked = checkpointed(files.mapInArrow(_walked, schema))
    per_file = checkpointed(walked.groupBy("file").agg(F.sum("n_tokens").alias("tokens")).select("file", "tokens", *file_order(F.col("file"))))
    before = lambda window, name: (F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col(name)).alias("before")
    per_task = per_file.groupBy("task").agg(F.sum("tokens").alias("tokens")).select("task", before(Window.orderBy("task"), "tokens"))
    in_task = per_file.select("file", "task", before(Window.partitionBy("task").orderBy("nth"), "tokens").alias("in_task"))
    base = checkpointed(in_task.join(per_task, "task").select("file", (F.col("before") + F.col("in_task")).alias("base")))
    side = F.broadcast(base) if small_enough(base) else base
    index = walked.join(side, "file").select("file", "offset", "length", "doc_id", "n_tokens", (F.col("base") + F.col("start_in_file")).alias("start"), "ids_crc32")
    index.write.parquet(index_folder)
    return spark.read.parquet(index_folder)


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids, file, offset) of the index rows ``wanted``, in no order: a shuffled read.

    Each file is opened once; the wanted offsets of a file travel to it as one list.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    lists = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, offsets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                rows = [(*record(content.as_buffer(), at)[:2], file, at) for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.uint32())).cast(pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "ids", "file", "offset"])

    return files.join(lists, "file").select("file", "content", "offsets").mapInArrow(run, "doc_id bigint, ids array<bigint>, file string, offset bigint")
