"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens with their token counts, of a fixed size; tier two is each worker's
cache of the others, filled through the library. Pre-tokens never meet in a shuffle: what tier one holds is chosen from
a bounded sample of whole documents, which one task cuts. The counts themselves never depend on it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.pieces import GENERATION, PIECE_CHARS, pieces_of

#: Pre-tokens in the broadcast table: at most this many of at most PIECE_CHARS characters.
FREQUENT = 20_000
#: Documents whose pre-tokens choose the table, at most; they are drawn by hashes of their ids.
SAMPLED = 2_000
#: Steps of the share of documents that are drawn.
STEPS = 1 << 40
#: Distinct pre-tokens of the sample that are counted at once; beyond it the rarer half is forgotten.
COUNTED = 400_000


class FrequentTable:
    """A compact table of pre-tokens and token counts: one compressed string and one array; at most FREQUENT entries."""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.text = zlib.compress("\x00".join(pieces).encode())
        self.counts = np.array(counts, dtype=np.uint16)

    def lookup(self) -> dict[str, int]:
        return dict(zip(zlib.decompress(self.text).decode().split("\x00"), self.counts.tolist())) if len(self.counts) else {}


def frequent_pieces(docs: DataFrame, tokenizer: str, text_column: str = "text", most: int = FREQUENT, sampled: int = SAMPLED, id_column: str = "doc_id") -> FrequentTable:
    """The most frequent pre-tokens of ``sampled`` whole documents with their numbers of tokens; an empty table has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = pieces_of(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(own.cut(text.as_py() or "") or ())
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        fit = [p for p in seen if len(p) <= PIECE_CHARS and "\x00" not in p]
        top = sorted(fit, key=lambda p: (-seen[p], p))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([len(own.whole(p)) // 4 for p in top], pa.int64())], names=["piece", "n"])

    # drawn where they are: about ``sampled`` rows meet in the one task, however many tasks there are
    room = sampled * STEPS // max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64(id_column, F.lit("drawn")), F.lit(STEPS)) < room
    some = docs.where(drawn).select(F.col(text_column).alias("text")).limit(sampled).coalesce(1)
    rows = some.select("text").mapInArrow(run, "piece string, n long").collect()
    return FrequentTable([r.piece for r in rows], [r.n for r in rows])


class Counts:
    """A worker's two tiers for one tokenizer and one table; the second in two generations of a fixed size."""

    def __init__(self, tokenizer: str, table: FrequentTable):
        self.own, self.first = pieces_of(tokenizer), table.lookup()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, text: str) -> int:
        pieces = self.own.cut(text) if text else []
        if pieces is None:
            return len(self.own.whole(text)) // 4
        found = list(map(self.first.get, pieces))
        if None in found:
            at = 0
            try:
                while True:
                    at = found.index(None, at)
                    n = self.young.get(pieces[at])
                    found[at] = self.miss(pieces[at]) if n is None else n
            except ValueError:
                pass
        return sum(found)

    def miss(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.own.encode(piece))
        if len(piece) <= PIECE_CHARS:
            if len(self.young) >= GENERATION:
                self.young, self.old = {}, self.young
            self.young[piece] = n
        return n


_counts: dict[tuple[str, str], Counts] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text", table: FrequentTable | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, in one pass without a shuffle.

    Null texts count as empty (0 bytes, 0 tokens), a null id stays null, repeated rows give repeated rows, other
    columns of any name are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(table or frequent_pieces(docs, tokenizer, text_column, id_column=id_column))
    key = (tokenizer, str(id(sent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counts:
            _counts.clear()
            _counts[key] = Counts(tokenizer, sent.value)
        count = _counts[key].count
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            n = np.array([count(x) for x in texts], dtype=np.int64)
            size = np.array([len(x.encode()) for x in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
