"""Media columns: telephony audio in WAVE containers (mu-law, A-law, IMA ADPCM), decoded and resampled with numpy.

Logarithmic samples are expanded by lookup tables; ADPCM blocks are decoded a sample at a time across all blocks of a
batch; linear PCM is resampled by whole factors. A batch of rows is decoded at once, in parts of bounded memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import drop_tables, write_table

RATE = 8_000
#: WAVE format tags (fixed values of the RIFF registry).
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Bytes of an ADPCM block: a header of 4 bytes, then two samples a byte.
BLOCK = 64
#: Bytes of payload that are decoded at once.
PART = 2_000_000
#: Parts of the media whose PCM is stored at one time.
PARTS = 8

#: IMA ADPCM index changes by code (fixed values of the format).
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


#: The format's 89 step sizes (fixed values of the format).
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
        209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289,
        16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    return np.where(u & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte (ITU-T G.711)."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    part, chord = (a & 0x0F) << 4, (a & 0x70) >> 4
    size = np.where(chord == 0, part + 8, (part + 0x108) << np.maximum(chord - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def wave(payload: bytes, codec: str) -> bytes:
    """A WAVE file of one channel at 8 kHz that holds the payload as it is."""
    tag, block = TAGS[codec], BLOCK if codec == "adpcm" else 1
    per_block = (BLOCK - 4) * 2 + 1
    rate = RATE * BLOCK // per_block if codec == "adpcm" else RATE
    form = struct.pack("<HHIIHH", tag, 1, RATE, rate, block, 4 if codec == "adpcm" else 8)
    form += struct.pack("<HH", 2, per_block) if codec == "adpcm" else struct.pack("<H", 0)
    samples = len(payload) // BLOCK * per_block if codec == "adpcm" else len(payload)
    fact = struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse_wave(media: bytes) -> tuple[str, int, memoryview]:
    """(codec, sample rate, payload) of a WAVE file; ValueError where it is none of these."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(view):
        kind, size = struct.unpack_from("<4sI", view, at)
        if kind == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", view, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), None)
            if codec is None or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels is not known")
        elif kind == b"data":
            if codec is None or at + 8 + size > len(view):
                raise ValueError("the data chunk is cut or has no format before it")
            return codec, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) 16-bit PCM of IMA ADPCM blocks (blocks, BLOCK) of bytes: every step is done across all blocks."""
    head = blocks[:, :4]
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(np.stack((blocks[:, 4:] & 15, blocks[:, 4:] >> 4), axis=2).reshape(len(blocks), -1).T)
    out = np.empty((codes.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value
    # the change for each step size and code, so that a step is two lookups and two clips
    code = np.arange(16)
    change = ((2 * (code & 7) + 1)[None, :] * STEPS[:, None]) >> 3
    change = np.where(code & 8, -change, change).astype(np.int32).ravel()
    moves = np.tile(INDEX_STEPS, 2)
    for k in range(len(codes)):
        c = codes[k]
        value += change[(index << 4) + c]
        np.clip(value, -32768, 32767, out=value)
        index += moves[c]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, factor: int = 2) -> np.ndarray:
    """PCM at ``factor`` times the rate: straight lines between samples, the last one held."""
    if not len(pcm):
        return pcm
    wide = np.empty((len(pcm), factor), np.int32)
    now = pcm.astype(np.int32)
    step = np.diff(now, append=now[-1])
    for k in range(factor):
        wide[:, k] = now + step * k // factor
    return wide.reshape(-1).astype(np.int16)


def decode(codec: str, payload: memoryview | bytes) -> np.ndarray:
    """16-bit PCM at the stored rate; a last ADPCM block that is cut is not decoded."""
    data = np.frombuffer(payload, np.uint8)
    if codec != "adpcm":
        return TABLES[codec][data]
    whole = len(data) // BLOCK * BLOCK
    return np.ascontiguousarray(decode_adpcm(data[:whole].reshape(-1, BLOCK))).reshape(-1)


def decode_many(codec: str, payloads: list) -> Iterator[np.ndarray]:
    """``decode`` of each payload; short ADPCM payloads go through one pass over all of their blocks."""
    if codec != "adpcm":
        yield from (decode(codec, p) for p in payloads)
        return
    at = 0
    while at < len(payloads):
        size, end = 0, at
        while end < len(payloads) and (end == at or size + len(payloads[end]) <= PART):
            size += len(payloads[end]) // BLOCK * BLOCK
            end += 1
        some = [np.frombuffer(p, np.uint8)[: len(p) // BLOCK * BLOCK] for p in payloads[at:end]]
        pcm = np.ascontiguousarray(decode_adpcm(np.concatenate(some).reshape(-1, BLOCK))).reshape(-1)
        edges = np.cumsum([0] + [len(x) // BLOCK * ((BLOCK - 4) * 2 + 1) for x in some])
        yield from (pcm[a:b] for a, b in zip(edges[:-1], edges[1:]))
        at = end


def features(pcm: np.ndarray) -> str:
    """Samples, mean magnitude, peak, zero crossings and a checksum of the PCM."""
    if not len(pcm):
        return "0;0;0;0;0"
    wide = pcm.astype(np.int32)
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    size = np.abs(wide)
    return f"{len(pcm)};{int(size.sum(dtype=np.int64)) // len(pcm)};{int(size.max())};{crossings};{zlib.crc32(pcm.astype('<i2').tobytes())}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, the text's UTF-8 with bytes 0 up to a positive multiple of 64)."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def codec_of(payload: bytes) -> str:
    """One of the three codecs, by checksum, so that equal payloads are stored alike."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A written table doc_id, n_bytes, media: each whole text's bytes as the samples of a WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                own = [payload_of(x.as_py()) for x in part.column(1)]
                media = [wave(p, codec_of(p)) for _, p in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return write_table(texts.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def pcm_column(media: DataFrame, factor: int = 2, media_column: str = "media") -> DataFrame:
    """media with rate (int) and pcm (little-endian 16-bit) decoded and resampled; both null where media is null or no known WAVE file.

    Short ADPCM files of a batch are decoded together, a step across all of their blocks."""
    at, names = media.columns.index(media_column), [*media.columns, "rate", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                parsed: list[tuple | None] = []
                for x in part.column(at):
                    try:
                        parsed.append(parse_wave(x.as_py() or b""))
                    except ValueError:
                        parsed.append(None)
                out: list[bytes | None] = [None] * len(parsed)
                for codec in TAGS:
                    own = [k for k, p in enumerate(parsed) if p and p[0] == codec]
                    for k, pcm in zip(own, decode_many(codec, [parsed[k][2] for k in own])):
                        out[k] = resample(pcm, factor).astype("<i2").tobytes()
                rates = [p[1] * factor if p else None for p in parsed]
                # a batch leaves in pieces of a bounded size
                ends, size = [0], 0
                for k, x in enumerate(out):
                    size += len(x or b"")
                    if size > 4 * PART:
                        ends.append(k + 1)
                        size = 0
                for i, j in zip(ends, [*ends[1:], len(out)]):
                    if i < j:
                        yield pa.RecordBatch.from_arrays([*part.slice(i, j - i).columns, pa.array(rates[i:j], pa.int32()), pa.array(out[i:j], pa.binary())], names=names)

    schema = T.StructType([*media.schema.fields, T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])
    return media.mapInArrow(run, schema)


def pcm_digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored media and the stored PCM (of pcm_column) give when they are read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, pcm in zip(batch.column(2), batch.column(3)):
                media = x.as_py()
                codec, _, p = parse_wave(media)
                samples = np.frombuffer(pcm.as_py(), "<i2")
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{codec};{features(samples)}"))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_describe(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int = PARTS) -> DataFrame:
    """The query's whole way: texts become media, the media are stored, decoded and resampled; the PCM is stored beside
    them, and all is read back and described.

    Uncompressed PCM at twice the rate takes 4 to 8 bytes for a byte of media, so a part of the media (by hash of their
    bytes) is stored with its PCM, described, and its PCM removed before the next; ``pcm_column`` keeps it. Null and empty texts give
    64 bytes 0; equal texts give equal values; a null id stays null; repeated rows are described once each; other
    columns of any name are ignored; an empty table gives an empty result.
    """
    media = store_texts(docs, id_column, text_column)
    out = []
    for k in range(parts):
        own = media.where(F.pmod(F.xxhash64("media"), F.lit(parts)) == k)
        stored = write_table(pcm_column(own), "pcm")
        out.append(write_table(pcm_digests(stored), "described"))
        drop_tables(stored)
    drop_tables(media)
    return reduce(DataFrame.union, out)
