"""Best-fit packing of token sequences by best-two-fit.

Lengths are whole numbers up to the capacity, so the whole corpus enters the planner as a histogram of at most
``capacity`` counts. The planner fills one bin greedily (always the largest length that fits), then replaces the bin's
smallest document by the two unpacked documents that fill its gap best, and repeats that composition as often as the
counts allow. Documents find their place from their rank within their length, so no group of rows meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import gapless_rank, write_table
from lodestack.llm.pieces import pieces_of

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of at most ``capacity`` ids of each document (null text: empty; an end id follows each)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces_of(tokenizer).ids
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(encode(text.as_py() or "") + end)
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, piece, start, length, crc), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=PIECES.names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES)


def best_pair(lengths: list[int], counts: dict[int, int], gap: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum of at most ``gap``; of equal sums that with the longer document."""
    own = np.array(lengths[: bisect_right(lengths, gap - 1)], dtype=np.int64)
    if not len(own):
        return None
    at = np.searchsorted(own, gap - own, side="right") - 1
    alone = (at >= 0) & (own[np.maximum(at, 0)] == own) & (np.array([counts[int(x)] for x in own]) < 2)
    at = at - alone
    total = np.where(at >= 0, own + own[np.maximum(at, 0)], -1)
    if total.max() < 0:
        return None
    k = int(np.flatnonzero(total == total.max())[-1])
    return int(own[k]), int(own[at[k]])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Compositions ([(length, copies)], times) that together use each length as often as the histogram has it."""
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a length is outside 1 to the capacity")
    lengths, out = sorted(counts), []

    def take(x: int, n: int = 1) -> None:
        counts[x] -= n
        if not counts[x]:
            lengths.pop(bisect_left(lengths, x))

    def give(x: int) -> None:
        if not counts[x]:
            insort(lengths, x)
        counts[x] += 1

    while lengths:
        inside: dict[int, int] = {}
        gap = capacity
        while gap and (k := bisect_right(lengths, gap)):
            x = lengths[k - 1]
            n = min(gap // x, counts[x])
            inside[x] = inside.get(x, 0) + n
            gap -= n * x
            take(x, n)
        small = min(inside)
        if gap and sum(inside.values()) > 1 and (pair := best_pair(lengths, counts, gap + small)) and sum(pair) > small:
            for x in pair:
                take(x)
                inside[x] = inside.get(x, 0) + 1
            give(small)
            inside[small] -= 1
            inside = {k: n for k, n in inside.items() if n}
        more = min(counts[x] // n for x, n in inside.items())
        for x, n in inside.items():
            if more:
                take(x, n * more)
        out.append((sorted(inside.items(), reverse=True), more + 1))
    return out


def places(compositions: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length the segments of its ranks: first rank, first sequence, copies in a sequence, first offset."""
    segments: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for inside, times in compositions:
        offset = 0
        for x, n in inside:
            segments.setdefault(x, []).append((used.get(x, 0), sequence, n, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in segments.items()}


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces of 1 to ``capacity`` ids.

    The histogram has at most ``capacity`` rows, whatever the corpus; only it reaches the driver, and only the plan
    (a few segments for each length) is broadcast. An empty table gives no rows; equal rows are packed one by one;
    other columns are kept. ``order`` only makes ranks stable.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    table = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = gapless_rank(pieces, [length], order, "_rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    columns, names = pieces.columns, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(k)) for k in (length, "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(size, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(size[by])) + 1) if len(by) else []:
                x = int(size[own[0]])
                first, start, n, at = table.value[x][np.searchsorted(table.value[x][:, 0], rank[own], side="right") - 1].T
                sequence[own] = start + (rank[own] - first) // n
                offset[own] = at + (rank[own] - first) % n * x
            kept = [batch.column(k) for k in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenizes, cuts and packs whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (their sequence is the end id alone), a null id stays null, repeated rows are packed
    once each, other columns of any name are ignored, an empty table gives an empty result.
    """
    return pack(write_table(token_pieces(docs, tokenizer, capacity, end_id, id_column, text_column), "pieces"), capacity, ["doc_id", "piece", "ids_crc32"])
