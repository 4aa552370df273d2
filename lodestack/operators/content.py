"""Content pipeline: segmentation, hashing, deduplication, manifests, range reads, packs, incremental work.

Files are rows with a path and ``data`` (binary). All offsets are byte offsets. Nothing here groups whole bodies: bodies
stay in their row until they are cut, and later stages carry hashes and lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestack.functions.expressions import (
    TEXT_EXTENSIONS, content_hash, document_extension, has_extension, is_text, lossy_text, mime_type, passage_metadata, slice_bytes, under, within_size,
)

#: Passages: least, average and most bytes; the same for storage chunks (fixed values).
PASSAGE_SIZES = (256, 1_024, 4_096)
STORAGE_SIZES = (16 * 1_024, 64 * 1_024, 256 * 1_024)


# segmentation ------------------------------------------------------------------------------------------------------


def windows(n: Column, size: int, overlap: int) -> Column:
    """The starts of overlapping windows over n units; the last one is the first to reach the end."""
    size = max(size, 1)
    step = size - min(overlap, size - 1)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: k * step)).otherwise(F.array().cast("array<long>"))


def whole_spans(data: Column) -> Column:
    n = F.octet_length(data).cast("long")
    return F.when(n > 0, F.array(F.struct(F.lit(0).cast("long").alias("a"), n.alias("b")))).otherwise(F.array().cast("array<struct<a: bigint, b: bigint>>"))


def fixed_spans(data: Column, size: int, overlap: int = 0) -> Column:
    n = F.octet_length(data).cast("long")
    return F.transform(windows(n, size, overlap), lambda a: F.struct(a.alias("a"), F.least(a + max(size, 1), n).alias("b")))


def line_cuts(data: bytes, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Byte spans of windows of ``size`` lines, in one pass over the line ends."""
    ends = (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    edges, size = [0, *ends], max(size, 1)
    step, n = size - min(overlap, size - 1), len(ends)
    starts = range(0, max(0, -(-(n - size) // step)) * step + 1, step) if n else ()
    return [(edges[k], edges[min(k + size, n)]) for k in starts]


def cut_passages(files: DataFrame, strategy: str, size: int = 1_024, overlap: int = 0, keep: list[str] | None = None) -> DataFrame:
    """path (and ``keep``), ordinal, byte_start, byte_end, hash, bytes of each passage of each file.

    Strategies: whole and fixed (JVM expressions), lines and content_defined (Arrow: one pass over a file's bytes). Empty and null data have none.
    """
    keep = ["path", *(keep or [])]
    if strategy == "content_defined":
        sizes = (size // 4, size, size * 4)
        spans = spans_by(files, lambda data: list(zip([0, *(cuts := cdc_cuts(data, sizes))], cuts)), keep)
    elif strategy == "lines":
        spans = spans_by(files, lambda data: line_cuts(data, size, overlap), keep)
    else:
        data = F.coalesce("data", F.unhex(F.lit("")))
        found = whole_spans(data) if strategy == "whole" else fixed_spans(data, size, overlap)
        spans = files.select(*keep, "data", F.posexplode(found).alias("ordinal", "s"))
    piece = slice_bytes(F.col("data"), F.col("s.a"), F.col("s.b"))
    cut = spans.select(*keep, "ordinal", F.col("s.a").alias("byte_start"), F.col("s.b").alias("byte_end"), piece.alias("bytes"))
    return cut.select(*keep, "ordinal", "byte_start", "byte_end", content_hash(F.col("bytes")).alias("hash"), "bytes")


def gear_table() -> np.ndarray:
    """256 fixed random 64-bit words: splitmix64 from seed 1 (our own table, as the published algorithm leaves it open)."""
    out, state = np.empty(256, np.uint64), 1
    for k in range(256):
        state = (state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        out[k] = z ^ (z >> 31)
    return out


GEAR = gear_table()


def cdc_cuts(data: bytes, sizes: tuple[int, int, int]) -> list[int]:
    """The ends of content-defined chunks: a gear hash over the last 32 bytes, cut where its high bits are zero.

    Normalised chunking: a harder mask before the average size and an easier one behind it. The hash of every
    position is computed at once (a windowed sum of shifted gear words), then the cuts are chosen in one scan over the
    candidate positions.
    """
    least, average, most = max(sizes[0], 64), max(sizes[1], 256), max(sizes[2], 1_024)
    n = len(data)
    if n <= least:
        return [n] if n else []
    words = GEAR[np.frombuffer(data, np.uint8)]
    hashes = words.copy()
    width = 1
    while width < 32:  # sums of 1, 2, 4 .. 32 words, each shifted by its age
        older = np.zeros_like(hashes)
        older[width:] = hashes[:-width] << np.uint64(width)
        hashes = hashes + older
        width *= 2
    top = hashes >> np.uint64(20)
    bits = max(1, int(round(np.log2(average))))
    hard = np.flatnonzero((top & np.uint64((1 << (bits + 1)) - 1)) == 0)
    easy = np.flatnonzero((top & np.uint64((1 << (bits - 1)) - 1)) == 0)
    cuts, start = [], 0
    while n - start > least:
        end = min(start + most, n)
        middle = min(start + average, end)
        k = np.searchsorted(hard, start + least)
        if k < len(hard) and hard[k] < middle:
            cut = int(hard[k]) + 1
        else:
            k = np.searchsorted(easy, max(middle, start + least))
            cut = int(easy[k]) + 1 if k < len(easy) and easy[k] < end - 1 else end
        cuts.append(cut)
        start = cut
    if start < n:
        cuts.append(n)
    return cuts


def spans_by(files: DataFrame, cut: Callable[[bytes], list[tuple[int, int]]], keep: list[str]) -> DataFrame:
    """keep, data, ordinal, s (a, b): the spans that a function finds in each file's data."""
    own = files.select(*keep, F.coalesce("data", F.unhex(F.lit(""))).alias("data"))
    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = T.StructType([*own.schema.fields, T.StructField("spans", span)])
    at, names = len(own.columns) - 1, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in cut(x.as_py())] for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=names)

    return own.mapInArrow(run, schema).select(*keep, "data", F.posexplode("spans").alias("ordinal", "s"))


def distinct_chunks(passages: DataFrame) -> DataFrame:
    """hash, len, bytes of each distinct chunk."""
    return passages.select("hash", (F.col("byte_end") - F.col("byte_start")).alias("len"), "bytes").dropDuplicates(["hash"])


def dedup_stats(passages: DataFrame) -> DataFrame:
    """objects, bytes (distinct), total_objects, total_bytes: counts of hashes, pre-aggregated by hash."""
    by = passages.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("byte_end") - F.col("byte_start")).alias("len"))
    return by.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_objects"),
        F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).alias("total_bytes"),
    )


# manifests and reads -----------------------------------------------------------------------------------------------


def build_manifests(passages: DataFrame) -> DataFrame:
    """path, mhash, size, chunks: each file's chunks in order; mhash covers hashes and lengths. A decoded manifest must
    have sum(len) = size (see check_manifests)."""
    ref = F.struct("ordinal", "hash", (F.col("byte_end") - F.col("byte_start")).alias("len"))
    own = passages.groupBy("path").agg(F.array_sort(F.collect_list(ref)).alias("c"))
    own = own.select("path", F.transform("c", lambda x: F.struct(x["hash"].alias("hash"), x["len"].alias("len"))).alias("chunks"))
    size = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    told = F.array_join(F.transform("chunks", lambda x: F.concat_ws(":", x["hash"], x["len"].cast("string"))), "\n")
    return own.select("path", F.sha2(told, 256).alias("mhash"), size.alias("size"), "chunks")


def check_manifests(manifests: DataFrame) -> DataFrame:
    """manifests, failing where lengths do not add up to the size."""
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    wrong = F.raise_error(F.concat(F.lit("corrupt manifest "), F.col("mhash")))
    return manifests.withColumn("size", F.when(total == F.col("size"), F.col("size")).otherwise(wrong.cast("long")))


def extents(manifests: DataFrame) -> DataFrame:
    """path, ordinal, hash, offset, len: chunk extents by an exclusive running sum over each file."""
    own = manifests.where(F.size("chunks") > 0).select("path", F.posexplode("chunks").alias("ordinal", "c"))
    before = F.sum("c.len").over(Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return own.select("path", "ordinal", F.col("c.hash").alias("hash"), F.coalesce(before, F.lit(0)).alias("offset"), F.col("c.len").alias("len"))


def overlapping(left: DataFrame, right: DataFrame, on: str, a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Rows of left and right with equal ``on`` whose intervals [start, end), named by ``a`` and ``b``, overlap.

    Both sides are dealt to every stretch of ``width`` offsets that they touch, and a pair is told in the first stretch
    that both touch: what meets within one key is what lies near, not all pairs of a large file.
    """

    def dealt(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        first, last = F.col(ends[0]), F.greatest(F.col(ends[1]) - 1, F.col(ends[0]))
        return df.withColumn("_stretch", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))

    both = dealt(left, a).join(dealt(right, b), [on, "_stretch"])
    met = (F.col(a[0]) < F.col(b[1])) & (F.col(a[1]) > F.col(b[0])) & (F.col("_stretch") == F.floor(F.greatest(a[0], b[0]) / width))
    return both.where(met).drop("_stretch")


def range_plan(extents: DataFrame, requests: DataFrame, width: int = 1 << 20) -> DataFrame:
    """path, request, ordinal, hash, chunk_from, chunk_to: the chunk slices that each request (path, request, start,
    end) reads; only chunks that overlap it."""
    own = extents.withColumn("_end", F.col("offset") + F.col("len"))
    both = overlapping(own, requests, "path", ("offset", "_end"), ("start", "end"), width)
    return both.select(
        "path", "request", "ordinal", "hash",
        F.greatest(F.col("start") - F.col("offset"), F.lit(0)).alias("chunk_from"),
        F.least(F.col("end") - F.col("offset"), F.col("len")).alias("chunk_to"),
    )


def read_ranges(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, request, data: the planned slices joined with chunk bytes and put together in order. A chunk that is
    missing is an error."""
    got = plan.join(chunks.select("hash", "bytes"), "hash", "left")
    piece = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("missing chunk "), F.col("hash"))).cast("binary")).otherwise(
        slice_bytes(F.col("bytes"), F.col("chunk_from"), F.col("chunk_to"))
    )
    return got.select("path", "request", "ordinal", piece.alias("b")).groupBy("path", "request").agg(F.expr("listagg(b) WITHIN GROUP (ORDER BY ordinal)").alias("data"))


def read_files(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, data of whole files."""
    requests = manifests.select("path", F.lit(0).alias("request"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    return read_ranges(range_plan(extents(manifests), requests), chunks).select("path", "data")


def read_stream(plan: DataFrame, chunks: DataFrame) -> Iterator[bytes]:
    """The bytes of one request's slices, a partition at a time."""
    got = plan.join(chunks.select("hash", "bytes"), "hash").orderBy("ordinal")
    for row in got.select(slice_bytes(F.col("bytes"), F.col("chunk_from"), F.col("chunk_to")).alias("b")).toLocalIterator(prefetchPartitions=True):
        yield bytes(row.b)


def write_new(passages: DataFrame, stored: DataFrame) -> DataFrame:
    """The distinct chunks that the store (hash) lacks."""
    return distinct_chunks(passages).join(stored.select("hash"), "hash", "left_anti")


def integrity_failures(chunks: DataFrame) -> DataFrame:
    """Chunks whose bytes do not have their hash or length."""
    return chunks.where((content_hash(F.col("bytes")) != F.col("hash")) | (F.octet_length("bytes") != F.col("len")))


def new_passages(passages: DataFrame, embedded: DataFrame) -> DataFrame:
    """The distinct passage hashes that are not embedded yet."""
    return passages.select("hash").distinct().join(embedded.select("hash").distinct(), "hash", "left_anti")


# packs -------------------------------------------------------------------------------------------------------------


def assign_packs(chunks: DataFrame, target: int = 4 << 20, lanes: int | None = None) -> DataFrame:
    """hash, len, lane, pack_no, offset: chunks staged in hash order until a pack holds ``target`` bytes, then sealed.

    The fold resets at each seal, so it is sequential; chunks are dealt to lanes by hash, each with packs of its own.
    Without ``lanes`` there is one for every 256 packs' bytes, so that a lane's work does not grow with the store.
    """
    if lanes is None:
        lanes = max(64, (chunks.agg(F.sum("len")).first()[0] or 0) // (256 * target))
    own = chunks.select("hash", F.col("len").cast("long").alias("len"), F.pmod(F.crc32(F.col("hash").cast("binary")), F.lit(lanes)).cast("int").alias("lane"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, number, size = None, 0, 0
        for batch in batches:
            out: list[list] = [[], []]
            for own_lane, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                if own_lane != lane:
                    lane, number, size = own_lane, 0, 0
                elif size >= target:
                    number, size = number + 1, 0
                out[0].append(number)
                out[1].append(size)
                size += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in out]], names=["hash", "len", "lane", "pack_no", "offset"])

    dealt = own.repartition(lanes, "lane").sortWithinPartitions("lane", "hash")
    return dealt.mapInArrow(fold, "hash string, len long, lane int, pack_no long, offset long")


def pack_liveness(members: DataFrame, live: DataFrame) -> DataFrame:
    """pack, total, live, live_bytes, state (dead, partial, full) from members (pack, hash, len) and live hashes."""
    marked = members.join(live.select("hash").distinct().withColumn("_live", F.lit(True)), "hash", "left")
    on = F.coalesce(F.col("_live"), F.lit(False))
    by = marked.groupBy("pack").agg(F.count(F.lit(1)).alias("total"), F.count_if(on).alias("live"), F.coalesce(F.sum(F.when(on, F.col("len"))), F.lit(0)).alias("live_bytes"))
    return by.withColumn("state", F.when(F.col("live") == 0, "dead").when(F.col("live") < F.col("total"), "partial").otherwise("full"))


def repack_plan(members: DataFrame, live: DataFrame) -> DataFrame:
    """pack, hash, len of what a repack rewrites: the live members of partly live packs. Dead packs are deleted."""
    partial = pack_liveness(members, live).where("state = 'partial'").select("pack")
    return members.join(partial, "pack", "left_semi").join(live.select("hash"), "hash", "left_semi")


def pack_trailer(entries: list[tuple[str, int, int]]) -> bytes:
    """A pack's trailer: for each member its hash (32 bytes), offset and length, then their number and the tag."""
    import struct

    body = b"".join(bytes.fromhex(h) + struct.pack("<QQ", o, n) for h, o, n in entries)
    return body + struct.pack("<I", len(entries)) + b"ORGP\x01"


def parse_trailers(packs: DataFrame) -> DataFrame:
    """pack, hash, offset, len from packs (pack, data); a pack without a sound trailer is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        for batch in batches:
            rows = []
            for pack, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(data) < 9 or data[-5:] != b"ORGP\x01":
                    raise ValueError(f"pack {pack} has no trailer")
                (count,) = struct.unpack_from("<I", data, len(data) - 9)
                first = len(data) - 9 - 48 * count
                if first < 0:
                    raise ValueError(f"pack {pack} has a cut trailer")
                for k in range(count):
                    at = first + 48 * k
                    rows.append((pack, data[at : at + 32].hex(), *struct.unpack_from("<QQ", data, at + 32)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["pack", "hash", "offset", "len"])

    return packs.select("pack", "data").mapInArrow(run, "pack string, hash string, offset long, len long")


# converters --------------------------------------------------------------------------------------------------------


def convert(files: DataFrame, converter: Callable[[str, bytes, str | None], str | None]) -> DataFrame:
    """path, data (text of the converted document), converter: files that the callable (path, data, mime) converts;
    those it returns None for are left out."""
    name = getattr(converter, "__name__", type(converter).__name__)
    own = files.select("path", F.col("data"), mime_type(F.col("path")).alias("mime"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, converter(p, d, m)) for p, d, m in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            rows = [(p, t.encode()) for p, t in rows if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.binary())], names=["path", "data"])

    return own.mapInArrow(run, "path string, data binary").withColumn("converter", F.lit(name))


def custom_spans(text: str, parts: list[str]) -> list[tuple[int, int]]:
    """Byte spans of a splitter's parts by a forward scan; a part that is not found is placed at the cursor."""
    data, at, out = text.encode(), 0, []
    for part in parts:
        own = part.encode()
        found = data.find(own, at)
        start = found if found >= 0 else at
        at = min(start + len(own), len(data))
        out.append((start, at))
    return out


def split_custom(files: DataFrame, splitter: Callable[[str], list[str]]) -> DataFrame:
    """path, ordinal, byte_start, byte_end, hash, bytes by a user's splitter of text.

    The bytes are the splitter's own parts, also where it rewrites the text; the span says where in the file they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (data or b"").decode("utf-8", "replace")
                parts = splitter(text)
                rows += [(path, k, *span, part.encode()) for k, (span, part) in enumerate(zip(custom_spans(text, parts), parts))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "ordinal", "byte_start", "byte_end", "bytes"])

    cut = files.select("path", "data").mapInArrow(run, "path string, ordinal int, byte_start long, byte_end long, bytes binary")
    return cut.select("path", "ordinal", "byte_start", "byte_end", content_hash(F.col("bytes")).alias("hash"), "bytes")


# passages end to end -----------------------------------------------------------------------------------------------


def corpus_files(files: DataFrame, converter: Callable[[str, bytes, str | None], str | None] | None = None) -> DataFrame:
    """path, data, converter of the files that hold text: those with a text extension as they are (converter null), the
    others as the converter tells them. What no converter takes is read as it is where it is UTF-8, and skipped else."""
    native = document_extension(F.col("path")).isin(*TEXT_EXTENSIONS)
    none = F.lit(None).cast("string").alias("converter")
    text = files.where(native).select("path", "data", none)
    other = files.where(~native | native.isNull()).select("path", "data")
    if converter is not None:
        told = convert(other, converter)
        text = text.unionByName(told)
        other = other.join(told.select("path"), "path", "left_anti")
    return text.unionByName(other.where(is_text(F.col("data"))).select("path", "data", none))


def extract_passages(
    files: DataFrame, strategy: str = "content_defined", size: int = 1_024, overlap: int = 0, root: str = "/",
    extensions: tuple[str, ...] = (), cap: int = 0, converter: Callable[[str, bytes, str | None], str | None] | None = None,
) -> DataFrame:
    """path, ordinal, byte_start, byte_end, hash, bytes, converter: the passages of the files (path, data) under root
    that have one of the extensions and at most cap bytes. Converted text has no stable bytes to cut by content: for it
    content_defined falls back to fixed windows."""
    size_of = F.octet_length("data")
    own = files.where(under(F.col("path"), root) & has_extension(F.col("path"), list(extensions)) & within_size(size_of, cap))
    corpus = corpus_files(own, converter)
    if strategy != "content_defined" or converter is None:
        return cut_passages(corpus, strategy, size, overlap, ["converter"])
    stored, told = corpus.where("converter IS NULL"), corpus.where("converter IS NOT NULL")
    return cut_passages(stored, strategy, size, overlap, ["converter"]).unionByName(cut_passages(told, "fixed", size, overlap, ["converter"]))


def passage_records(passages: DataFrame, spans: DataFrame, source: str) -> DataFrame:
    """id, text, metadata: a retrieval framework's record for each passage, with the authors of the blame spans (path,
    actor, byte_start, byte_end) that it overlaps, first seen first. Authors are those of stored bytes: a converted
    passage has none."""
    own = passages.where("converter IS NULL").select("path", F.col("ordinal").alias("_o"), F.col("byte_start").alias("_p0"), F.col("byte_end").alias("_p1"))
    met = overlapping(own, spans.select("path", "actor", "byte_start", "byte_end"), "path", ("_p0", "_p1"), ("byte_start", "byte_end"), 1 << 16)
    first = met.groupBy("path", "_o", "actor").agg(F.min("byte_start").alias("at"))
    authors = first.groupBy("path", "_o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "actor"))), lambda x: x["actor"].cast("string")), ",").alias("authors"))
    both = passages.join(authors.withColumnRenamed("_o", "ordinal"), ["path", "ordinal"], "left")
    told = passage_metadata(F.col("path"), F.col("byte_start"), F.col("byte_end"), F.col("hash"), F.lit(source))
    more = F.create_map(F.lit("authors"), F.coalesce("authors", F.lit("")), F.lit("converter"), F.coalesce("converter", F.lit("")))
    return both.select(F.concat_ws("#", "path", "ordinal").alias("id"), lossy_text(F.col("bytes")).alias("text"), F.map_concat(told, more).alias("metadata"))
