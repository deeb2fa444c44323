"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM to resampled PCM.

``as_wave`` stores bytes as 8-bit mu-law or A-law samples, or as IMA ADPCM blocks, of a RIFF file,
losslessly; with no format given, the payload's CRC-32 chooses one by ``SHARES``, so equal texts
have equal files. ``decode`` expands the companded codes by 256-entry lookup tables, decodes ADPCM
with numpy across blocks (a step of the loop decodes one nibble of all blocks of all files of a slice), and
resamples. ``with_pcm`` stores the resampled PCM beside the files, in the lossless form of ``pack_pcm``.

Defined results: null text and null media are empty; equal bytes give equal values; a payload
is padded with zero bytes to a positive multiple of 64; repeated rows are rows of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import prepare, tidy

PAD = 64
RATE, TARGET_RATE = 8_000, 16_000
#: RIFF format tags.
PCM, ALAW, ULAW, IMA = 1, 6, 7, 17
#: Format of a payload by the lowest three bits of its CRC-32: one in eight is ADPCM, whose PCM is the largest.
SHARES = (ULAW, ULAW, ULAW, ULAW, ALAW, ALAW, ALAW, IMA)
#: Files that are decoded at a time.
SLICE = 100


def ulaw_table() -> np.ndarray:
    """PCM of each mu-law code (ITU-T G.711): sign, three bits of segment, four of step."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype("<i2")


def alaw_table() -> np.ndarray:
    """PCM of each A-law code (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    segment, step = (code >> 4) & 7, (code & 15) << 4
    size = np.where(segment == 0, step + 8, step + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype("<i2")


def step_table() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM, each about a tenth above the one before."""
    # Fixed values of the format.
    return np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_ULAW, _ALAW, _STEPS = ulaw_table(), alaw_table(), step_table()


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM of whole blocks (sample i16, index u8, 0, nibbles low first).

    Samples within a block depend on each other, blocks don't: so all blocks step together.
    """
    blocks = np.frombuffer(data, np.uint8)[: len(data) // block * block].reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), 2 * (block - 4))
    out = np.empty((len(blocks), nibbles.shape[1] + 1), "<i2")
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        n = nibbles[:, k].astype(np.int32)
        step = _STEPS[index]
        diff = (step >> 3) + np.where(n & 4, step, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 1, step >> 2, 0)
        value = np.clip(np.where(n & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[n], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def resample(pcm: np.ndarray, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """PCM at the target rate by linear interpolation; doubling takes midpoints in whole numbers."""
    if rate == target or not len(pcm):
        return pcm
    if target == 2 * rate:
        out = np.empty(2 * len(pcm), "<i2")
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * target // rate
    return np.round(np.interp(np.arange(n) * (rate / target), np.arange(len(pcm)), pcm)).astype("<i2")


def wave(payload: bytes, tag: int = ULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono RIFF file around the payload."""
    bits = {PCM: 16, IMA: 4}.get(tag, 8)
    form = struct.pack("<HHIIHHH", tag, 1, rate, rate * max(1, bits // 8), max(block, bits // 8), bits, 0)
    fact = struct.pack("<I", len(payload))
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<I", 4) + fact + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(data: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block, payload) of a RIFF file, from its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, tag, rate, block = 12, PCM, RATE, 1
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", data, at + 8)
        elif kind == b"data":
            return tag, rate, block, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def to_pcm_all(files: list[bytes], target: int = TARGET_RATE) -> list[np.ndarray]:
    """Resampled 16-bit PCM of RIFF files in any of the four formats; ADPCM blocks of all files step together."""
    parsed, out, blocks = [parse_wave(f) for f in files], [], {}
    for tag, _, block, payload in parsed:
        if tag == IMA:
            blocks.setdefault(block, []).append(payload[: len(payload) // block * block])
    decoded = {block: decode_ima(b"".join(held), block) for block, held in blocks.items()}
    begun = dict.fromkeys(blocks, 0)
    for tag, rate, block, payload in parsed:
        if tag == IMA:
            n = len(payload) // block * (2 * (block - 4) + 1)
            pcm = decoded[block][begun[block] : begun[block] + n]
            begun[block] += n
        elif tag == PCM:
            pcm = np.frombuffer(payload, "<i2")
        else:
            pcm = (_ULAW if tag == ULAW else _ALAW)[np.frombuffer(payload, np.uint8)]
        out.append(resample(pcm, rate, target))
    return out


def to_pcm(data: bytes, target: int = TARGET_RATE) -> np.ndarray:
    return to_pcm_all([data], target)[0]


def _middles(even: np.ndarray, n: int) -> np.ndarray:
    """What the n samples between (and after) the even ones are expected to be."""
    wide = np.append(even, even[-1:]).astype(np.int32)
    return ((wide[:-1] + wide[1:]) >> 1)[:n].astype("<i2")


def pack_pcm(pcm: np.ndarray) -> bytes:
    """PCM for storage, without loss: every other sample, then what the rest differ from the middle of
    their neighbours (modulo 2**16), which is little or nothing in signals below half the rate."""
    even = pcm[::2].astype("<i2")
    return even.tobytes() + (pcm[1::2] - _middles(even, len(pcm) // 2)).astype("<i2").tobytes()


def unpack_pcm(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, "<i2")
    out, even = np.empty(len(held), "<i2"), held[: (len(held) + 1) // 2]
    out[::2] = even
    out[1::2] = held[len(even) :] + _middles(even, len(held) // 2)
    return out


def as_wave(docs: DataFrame, tag: int | None = None) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's UTF-8 bytes, padded, as the samples of a RIFF file.

    tag: the format of all files; without it, the payload's CRC-32 chooses by ``SHARES``.
    """
    prepare(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).slice(at, 500).to_pylist()]
                made = []
                for data in texts:
                    payload = data + b"\0" * (-len(data) % PAD or PAD * (not data))
                    form = SHARES[zlib.crc32(payload) & 7] if tag is None else tag
                    made.append(wave(payload, form, block=PAD if form == IMA else 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def _decoded(part: pa.Array, target: int) -> list[np.ndarray]:
    """PCM of each file; null and empty media have none."""
    files = [m or b"" for m in part.to_pylist()]
    found = iter(to_pcm_all([f for f in files if f], target))
    return [next(found) if f else np.empty(0, "<i2") for f in files]


def decode(media: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """doc_id and ``pcm``, 16-bit little-endian samples at the target rate; null media is empty."""
    prepare(media.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes() for p in _decoded(part.column(1), target)], pa.binary())], ["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, pcm binary")


def with_pcm(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and ``pcm``, the resampled samples that each file decodes to, as ``pack_pcm`` has them."""
    prepare(media.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([pack_pcm(p) for p in _decoded(part.column(2), TARGET_RATE)], pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, pcm binary")


def digest(data: bytes, stored: bytes | None = None) -> tuple:
    """What ``features`` says of one stored file, of its stored samples if it has them."""
    tag, rate, _, payload = parse_wave(data)
    pcm = to_pcm(data) if stored is None else unpack_pcm(stored)
    wide = pcm.astype(np.float32)
    crossings = int(np.count_nonzero((pcm[1:] ^ pcm[:-1]) < 0))
    said = f"tag={tag};rate={rate};samples={len(pcm)};peak={int(np.abs(wide).max())};rms={float(np.sqrt(np.mean(np.square(wide), dtype=np.float64))):.2f};crossings={crossings};pcm_crc32={zlib.crc32(pcm)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), said


def features(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes, and features of the resampled PCM: column ``pcm``, or else what they decode to."""
    columns = ["doc_id", "n_bytes", "media", *[c for c in ("pcm",) if c in media.columns]]
    prepare(media.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(*(x.as_py() for x in files)) for files in zip(*batch.columns[2:])]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], ["doc_id", "n_bytes", *names])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select(*columns).mapInArrow(run, schema)
