"""Token-id files coded by static range asymmetric numeral systems (rANS).

A file holds the documents of one range of ids in order. Its header carries one frequency table, counted over all of
the file's tokens and shared by all of its blocks. A block of BLOCK_TOKENS tokens is coded by LANES interleaved states
and starts from states of its own, kept in its checkpoint with the block's place, its first token and checksums, so
blocks are decoded independently; numpy steps through all blocks of a file at once.

    magic, header length | header: counts, table (zlib) | documents' lengths and ids (zlib) | checkpoints | blocks' words

Files are named by part and number, in the order of ids, and hold all that is read from them: a folder's headers give the
number of ids before each file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import shared_dir, write_table
from lodestack.llm.pieces import pieces_of

MAGIC = b"RANSIDS1"
LANES = 16
BLOCK_TOKENS = 16_384
#: Frequencies sum to 2 to this power; states stay in 2^31 to 2^63 and move 32 bits at once.
SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: Ranges of ids whose bounds one expression holds; more are left to Spark's range partitioning.
MOST_BOUNDS = 512
#: Rows that a task encodes before it starts another file, in tokens.
FILE_TOKENS = 8_000_000
#: Files whose sizes are summed up together when starts are counted.
FILE_GROUP = 4_096
CHECKPOINT = np.dtype([("words", "<u8"), ("n_words", "<u4"), ("n_tokens", "<u4"), ("words_crc32", "<u4"), ("ids_crc32", "<u4"), ("states", "<u8", (LANES,))])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**SCALE, in the proportions of the (positive) counts; whole-number steps."""
    room = (1 << SCALE) - len(counts)
    freq = 1 + counts.astype(np.int64) * room // int(counts.sum())
    freq[np.argmax(freq)] += (1 << SCALE) - int(freq.sum())
    return freq.astype(np.uint64)


def encode_blocks(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(states (blocks, LANES), each block's words in the order of reading) of symbols (blocks, steps, LANES)."""
    blocks, steps, lanes = symbols.shape
    state = np.full((blocks, lanes), LOW, np.uint64)
    moved = np.empty((steps, blocks, lanes), bool)
    words = np.empty((steps, blocks, lanes), np.uint32)
    top = np.uint64(63 - SCALE)
    scale = np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t]
        f = freq[s]
        out = state >= (f << top)
        moved[t] = out
        words[t] = state  # the low 32 bits
        state = np.where(out, state >> WORD, state)
        q = state // f
        state = (q << scale) + (state - q * f) + start[s]
    return state, [words[:, b][moved[:, b]] for b in range(blocks)]


def decode_blocks(states: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, symbol: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Symbols (blocks, steps, LANES) from states, all words, and where each block's words begin."""
    state, at = states.copy(), at.astype(np.int64).copy()
    out = np.empty((len(states), steps, states.shape[1]), symbol.dtype)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    words = np.append(words, np.zeros(LANES, np.uint32)).astype(np.uint64)
    for t in range(steps):
        slot = state & mask
        s = symbol[slot]
        out[:, t] = s
        state = freq[s] * (state >> scale) + slot - start[s]
        low = state < LOW
        if low.any():
            place = at[:, None] + np.cumsum(low, axis=1) - 1
            state = np.where(low, (state << WORD) | words[np.maximum(place, 0)], state)
            at += low.sum(axis=1)
    return out


def pack_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None] | None = None) -> bytes:
    """The file of these documents: all ids in order, and each document's number of ids and id (may be null)."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    table = zlib.compress(np.stack((used, counts[used])).astype("<u8").tobytes(), 6)
    named = [None] * len(lengths) if doc_ids is None else doc_ids
    known = np.array([x is not None for x in named], np.uint8)
    docs = zlib.compress(lengths.astype("<u4").tobytes() + known.tobytes() + np.array([x or 0 for x in named], "<i8").tobytes(), 6)
    points, parts = np.zeros(-(-len(ids) // BLOCK_TOKENS), CHECKPOINT), []
    if len(ids):
        freq = scaled(counts[used])
        start = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
        index = np.zeros(len(counts), np.uint16 if len(used) <= 65_536 else np.uint32)
        index[used] = np.arange(len(used))
        symbols = index[ids]
        whole = len(ids) // BLOCK_TOKENS
        states, words = encode_blocks(symbols[: whole * BLOCK_TOKENS].reshape(whole, -1, LANES), freq, start) if whole else (np.zeros((0, LANES), np.uint64), [])
        if whole < len(points):
            rest = symbols[whole * BLOCK_TOKENS :]
            rest = np.concatenate((rest, np.full(-len(rest) % LANES, np.argmax(freq), rest.dtype)))
            last, more = encode_blocks(rest.reshape(1, -1, LANES), freq, start)
            states, words = np.concatenate((states, last)), words + more
        place = 0
        for b, own in enumerate(words):
            data = own.astype("<u4").tobytes()
            tokens = ids[b * BLOCK_TOKENS : (b + 1) * BLOCK_TOKENS]
            points[b] = (place, len(own), len(tokens), zlib.crc32(data), zlib.crc32(tokens.astype("<u4").tobytes()), states[b])
            place += len(own)
            parts.append(data)
    head = struct.pack("<QIIIII", len(ids), len(lengths), len(points), len(table), len(docs), zlib.crc32(table + docs + points.tobytes()))
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, table, docs, points.tobytes(), *parts))


class IdFile:
    """A file's parts, read from its bytes; ``ids(first, last)`` decodes a range of blocks by their checkpoints."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an id file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.n_tokens, n_docs, n_points, n_table, n_lengths, crc = struct.unpack_from("<QIIIII", data, 12)
        at = 12 + size
        body = at + n_table + n_lengths + n_points * CHECKPOINT.itemsize
        if zlib.crc32(data[at:body]) != crc:
            raise ValueError("the header's checksum differs")
        used, counts = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u8").reshape(2, -1)
        told = zlib.decompress(data[at + n_table : at + n_table + n_lengths])
        if len(told) != 13 * n_docs:
            raise ValueError("the number of documents differs")
        self.lengths = np.frombuffer(told, "<u4", n_docs)
        known = np.frombuffer(told, np.uint8, n_docs, 4 * n_docs)
        self.doc_ids = pa.array(np.frombuffer(told, "<i8", n_docs, 5 * n_docs), pa.int64(), mask=known == 0)
        self.points = np.frombuffer(data, CHECKPOINT, n_points, at + n_table + n_lengths)
        self.words = np.frombuffer(data, "<u4", -1, body) if len(data) > body else np.zeros(0, "<u4")
        self.used = used.astype(np.uint32)
        if len(used):
            self.freq = scaled(counts)
            self.start = np.concatenate(([0], np.cumsum(self.freq)))[:-1].astype(np.uint64)
            self.symbol = np.repeat(np.arange(len(used), dtype=np.uint16 if len(used) <= 65_536 else np.uint32), self.freq.astype(np.int64))

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last - 1; ValueError where a checksum differs."""
        points, out = self.points[first:last], []
        for p in points:
            if zlib.crc32(self.words[p["words"] : p["words"] + p["n_words"]].tobytes()) != p["words_crc32"]:
                raise ValueError("a block's checksum differs")
        whole = int(np.count_nonzero(points["n_tokens"] == BLOCK_TOKENS))
        for own in (points[:whole], points[whole:]):
            if len(own):
                steps = -(-int(own["n_tokens"][0]) // LANES)
                got = decode_blocks(own["states"], self.words, own["words"], steps, self.symbol, self.freq, self.start)
                out.append(got.reshape(len(own), -1)[:, : int(own["n_tokens"][0])].reshape(-1))
        ids = self.used[np.concatenate(out)] if out else np.zeros(0, np.uint32)
        edges = np.concatenate(([0], np.cumsum(points["n_tokens"], dtype=np.int64)))
        for p, a, b in zip(points, edges[:-1], edges[1:]):
            if zlib.crc32(ids[a:b].astype("<u4").tobytes()) != p["ids_crc32"]:
                raise ValueError("a block's ids differ from their checksum")
        return ids


def put(uri: str, data: bytes) -> None:
    """Writes a file of the shared folder whole or not at all: a task that runs again replaces it with the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{np.random.default_rng().integers(1 << 62):x}.tmp"
    with store.open_output_stream(temporary) as f:
        f.write(data)
    store.move(temporary, path)


def get(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


def dealt_by_id(docs: DataFrame, id_column: str, text_column: str, part_rows: int) -> DataFrame:
    """doc_id, text with documents dealt to partitions by ranges of ids (equal shares of the rows), sorted within.

    The bounds are quantiles of the ids alone; a run of equal ids stays together.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = own.select(F.count(F.lit(1))).first()[0]
    parts = max(1, -(-rows // part_rows))
    shares = [k / parts for k in range(1, parts)]
    bounds = own.select(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10 * parts + 1_000)).first()[0] if shares and rows else None
    if bounds and len(bounds) <= MOST_BOUNDS:
        bounds = sorted(set(bounds))
        own = own.repartitionById(len(bounds) + 1, F.when(F.col("doc_id").isNull(), 0).otherwise(bucket(bounds)))
    else:  # Spark's own ranges, from a sample of whole rows
        own = own.repartitionByRange(parts, F.asc_nulls_first("doc_id"))
    return own.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))


def bucket(bounds: list[int]):
    """How many bounds are below doc_id, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"IF(doc_id <= {bounds[mid]}L, {tree(low, mid)}, {tree(mid + 1, high)})"

    return F.expr(tree(0, len(bounds)))


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", part_rows: int = 8_000) -> DataFrame:
    """Encodes whole documents and writes their files in ascending order of ids under path; a written table of uri,
    n_docs, n_tokens, for reports: the files are read without it. Null texts are the end id alone; null ids come first."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), pieces_of(tokenizer).ids
        doc_ids: list = []
        coded: list[bytes] = []
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(coded), "<u4")
            uri = f"{path}/part-{part:08d}-{number:06d}.rans"
            put(uri, pack_file(data, np.array([len(x) // 4 for x in coded], np.int64), doc_ids))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(coded)], pa.int64()), pa.array([len(data)], pa.int64())], names=["uri", "n_docs", "n_tokens"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = encode(text.as_py() or "") + end
                doc_ids.append(doc)
                coded.append(x)
                size += len(x) // 4
                if size >= FILE_TOKENS:
                    yield flush()
                    doc_ids, coded, size, number = [], [], 0, number + 1
        if coded:
            yield flush()

    dealt = dealt_by_id(docs, id_column, text_column, part_rows)
    return write_table(dealt.mapInArrow(run, "uri string, n_docs long, n_tokens long"), "index")


def files_in(path: str) -> list[str]:
    """The URIs of a folder's id files, in order; none where there is no such folder."""
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(own)]
    found = store.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return sorted(scheme + x.path for x in found if x.base_name.endswith(".rans"))


def header_tokens(uri: str) -> int:
    """The number of ids in a file, from its first bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        head = f.read(20)
    if head[:8] != MAGIC:
        raise ValueError(f"{uri} is not an id file")
    return struct.unpack_from("<Q", head, 12)[0]


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """uri, start (ids in all files before) of a folder's files, from their headers; a written table. Sums run over
    groups of FILE_GROUP files first, so no task orders all files."""
    uris = [(k, u) for k, u in enumerate(files_in(path))]
    listed = spark.createDataFrame(uris, "place long, uri string").repartition(max(1, min(len(uris), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([header_tokens(u) for u in batch.column(1).to_pylist()], pa.int64())], names=["place", "uri", "n"])

    sized = write_table(listed.mapInArrow(run, "place long, uri string, n long"), "headers").withColumn("_g", F.expr(f"place div {FILE_GROUP}"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sized.groupBy("_g").agg(F.sum("n").alias("_n")).select("_g", before(Window.orderBy("_g"), "_n").alias("_base"))
    own = sized.join(F.broadcast(groups), "_g")  # a row for FILE_GROUP files
    return write_table(own.select("uri", (F.col("_base") + before(Window.partitionBy("_g").orderBy("place"), "n")).cast("long").alias("start")), "starts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a folder's files, all of it from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(batch.column(k).to_pylist() for k in range(2))):
                own = IdFile(get(uri))
                data = memoryview(own.ids().astype("<u4").tobytes())
                edges = np.concatenate(([0], np.cumsum(own.lengths, dtype=np.int64)))
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([own.doc_ids, pa.array(start + edges[:-1]), pa.array(own.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = file_starts(spark, path).repartition(max(1, spark.sparkContext.defaultParallelism * 4), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The query's whole way: files in the shared folder, then each document from the files alone.

    Null texts count as empty, null ids come first and stay null, repeated rows are written once each, equal ids are
    ordered by text, other columns are ignored, an empty table writes no file and gives an empty result.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids"
    write_ids(docs, tokenizer, path, end_id, id_column, text_column)
    return read_ids(spark, path)
