"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits and link at ``THRESHOLD`` = 2 or fewer differing bits. Of two such fingerprints one half
(bits 0 to 31 or 32 to 63) differs in at most one bit. In each half the anchors are the codewords of the [31, 26]
Hamming code on the half's first 31 bits: every 31-bit word is within the covering radius 1 of exactly one anchor, its
home. A fingerprint is replicated to every anchor within covering radius plus the half's threshold, 1 + 1 = 2 (16
anchors at most, one of them its home); the home anchor of either of a linked pair is among the anchors of the other,
so comparing within anchors, at least one of the two being at home, finds every link.

Equal fingerprints are one row from the start, so copies never meet. An anchor with very many different fingerprints
is divided by exact thirds of the fingerprint (two that differ in 2 bits agree in one of three parts), over tasks where
it is crowded. Links leave an anchor as a spanning forest, never as all pairs, and components are found by label
spreading over written tables; nothing that grows with the corpus reaches the driver.

The above is the setting ``HALVES``. ``QUARTERS`` is a wider one: of two fingerprints that differ in 7 or fewer bits, one
of four parts of 16 bits differs in at most one. Its anchors are the codewords of the [15, 11] Hamming code on the part's
first 15 bits (8 anchors at most within 2), and crowded anchors are divided by eighths of the fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import drop_tables, write_table

THRESHOLD = 2
SEED = 42
SHINGLE_WORDS = 3
#: Anchors that are home to more different fingerprints are dealt to several tasks.
CROWDED = 50_000
#: Different fingerprints of one anchor or part that are compared with each other directly.
DIRECT = 2_048


@dataclass(frozen=True)
class Cover:
    """How fingerprints meet: two that differ in ``threshold`` or fewer bits differ in at most one bit of a part of
    ``width`` bits, and agree in one of ``slices`` (first bit and bits)."""

    threshold: int
    width: int
    slices: tuple[tuple[int, int], ...]


HALVES = Cover(THRESHOLD, 32, ((0, 22), (22, 21), (43, 21)))
QUARTERS = Cover(7, 16, tuple((at, 8) for at in range(0, 64, 8)))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 where there is no word."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))[: len(found) - words + 1].tolist()
    ends = np.concatenate((blanks, [len(joined)]))[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, h (Spark's xxhash64 of the text; null counts as empty) and fp (long: the 64 bits) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_hash(F.col(text_column)).alias("h"), F.col(text_column).alias("text"))
    return own.mapInArrow(run, "doc_id long, h long, fp long")


def text_hash(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Hamming codes: position i (from 1) has parity check i; a word's syndrome is the xor of its set positions.
_POSITIONS = np.arange(1, 32, dtype=np.uint8)


def syndrome(part: np.ndarray, positions: np.ndarray = _POSITIONS) -> np.ndarray:
    """The position (from 1) whose flip leads to the home anchor; 0 at an anchor. part: the low bits count."""
    out = np.zeros(len(part), np.uint8)
    for i in positions:
        out ^= ((part >> np.uint64(i - 1)) & np.uint64(1)).astype(np.uint8) * i
    return out


def anchors(part: np.ndarray, cover: Cover = HALVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor within 2 bits of each part's bits but the last.

    Off an anchor (syndrome s): flip s alone (home), or two positions i and j with i xor j = s (15 pairs, or 7). At an
    anchor no other anchor is nearer than 3.
    """
    positions = _POSITIONS[: cover.width - 1]
    part = part & np.uint64((1 << len(positions)) - 1)
    s, rows = syndrome(part, positions), np.arange(len(part))
    bit = np.concatenate(([0], 1 << np.arange(31))).astype(np.uint64)
    out = [(rows, part ^ bit[s], np.ones(len(part), bool))]
    for i in positions:
        j = s ^ i
        own = np.flatnonzero((s > 0) & (j > i))
        out.append((own, part[own] ^ bit[i] ^ bit[j[own]], np.zeros(len(own), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def replicate(distinct: DataFrame, homes: bool = False, cover: Cover = HALVES) -> DataFrame:
    """A row for each fingerprint and anchor near it (its homes only): anchor (long; from bit 32 the part), fp, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(whole), 50_000):
                fp = whole[at : at + 50_000]
                for part in range(64 // cover.width):
                    rows, anchor, home = anchors(fp >> np.uint64(cover.width * part), cover)
                    if homes:
                        rows, anchor, home = rows[home], anchor[home], home[home]
                    key = (anchor | np.uint64(part << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def forest(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links of different fingerprints, at least one of each two at home, that connect all that are so linked.

    From each fingerprint reached, those within the threshold that are not reached yet are taken at once, so there is
    at most one link for each fingerprint and memory grows with their number only.
    """
    left, out = np.ones(len(fp), bool), []
    for first in np.flatnonzero(home).tolist():
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            close = left & (np.bitwise_count(fp ^ fp[x]) <= threshold)
            if not home[x]:
                close &= home
            new = np.flatnonzero(close).tolist()
            left[new] = False
            queue += new
            out += [(int(fp[x]), int(fp[y])) for y in new]
    return out


def near(fp: np.ndarray, home: np.ndarray, cover: Cover = HALVES) -> list[tuple[int, int]]:
    """The forest of one anchor. Many fingerprints are first dealt by each slice of their bits: linked ones agree in one."""
    if not home.any():
        return []
    if len(fp) <= DIRECT:
        return forest(fp, home, cover.threshold)
    out: list[tuple[int, int]] = []
    for low, width in cover.slices:
        part = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        by = np.argsort(part, kind="stable")
        for g in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
            if len(g) > 1:
                out += forest(fp[g], home[g], cover.threshold)
    return out


def crowded_anchors(distinct: DataFrame, cover: Cover = HALVES) -> DataFrame:
    """anchor of those that are the home of more than CROWDED different fingerprints; a written table, mostly empty."""
    count = replicate(distinct, homes=True, cover=cover).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return write_table(count.where(F.col("n") > CROWDED).select("anchor"), "crowded")


def divided(near_anchor: DataFrame, crowded: DataFrame, cover: Cover = HALVES) -> DataFrame:
    """near_anchor with each crowded anchor's rows dealt to keys of their own by each slice of their bits.

    Two linked fingerprints agree in one of the slices, so they still meet; no task gets more of a crowded anchor than
    shares a slice. A key that falls together with another only adds comparisons.
    """
    if crowded.isEmpty():
        return near_anchor
    marked = near_anchor.join(crowded.withColumn("_crowded", F.lit(True)), "anchor", "left")
    parts = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in cover.slices]
    keys = F.array(*[F.xxhash64("anchor", F.lit(k), part) for k, part in enumerate(parts)])
    return marked.select(F.explode(F.when(F.col("_crowded"), keys).otherwise(F.array("anchor"))).alias("anchor"), "fp", "home")


def links(distinct: DataFrame, cover: Cover = HALVES) -> DataFrame:
    """a, b: links between different fingerprints that connect all that are linked (a spanning forest per anchor)."""
    dealt = divided(replicate(distinct, cover=cover), crowded_anchors(distinct, cover), cover).repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            two = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(two.min(axis=1)), pa.array(two.max(axis=1))], names=["a", "b"])

        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            key, fp, home = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2).to_numpy(zero_copy_only=False))
            if rest is not None:
                key, fp, home = (np.concatenate(x) for x in zip(rest, (key, fp, home)))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], side="left"))
            rest = (key[last:], fp[last:], home[last:])
            yield made(scan(key[:last], fp[:last], home[:last], cover))
        if rest is not None:
            yield made(scan(*rest, cover))

    return dealt.mapInArrow(run, "a long, b long")


def scan(key: np.ndarray, fp: np.ndarray, home: np.ndarray, cover: Cover = HALVES) -> list[tuple[int, int]]:
    """The links of each run of equal keys; runs of one row cost nothing."""
    edges = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0))) if len(key) else np.array([], int)
    size = np.diff(np.concatenate((edges, [len(key)])))
    out: list[tuple[int, int]] = []
    two = edges[size == 2]
    close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= cover.threshold]
    close = close[home[close] | home[close + 1]]
    out += list(zip(fp[close].tolist(), fp[close + 1].tolist()))
    for at, n in zip(edges[size > 2].tolist(), size[size > 2].tolist()):
        out += near(fp[at : at + n], home[at : at + n], cover)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges a, b, by large and small stars.

    Each round is two aggregations over the edges; round by round each node hangs on a smaller one, until every node
    hangs on its root. Written tables cut the lineage. Edges within a star are dealt by node and smallest neighbour,
    so a large component's edges are pre-aggregated before they meet.
    """
    now = write_table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    for k in range(most_rounds):
        # large star: all larger neighbours hang on the smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        # small star: the smaller neighbours and the node itself hang on the smallest of them
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m")), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e"))
        after = small.select(F.col("e.v").alias("v"), F.col("e.m").alias("u")).where("v <> u").distinct()
        after = write_table(after, f"stars{k}")
        told = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        same = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        drop_tables(now)
        now = after
        if told == same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links) of every document.

    Null and blank texts have the fingerprint zero, linked like any other. Repeated rows and equal texts give equal
    fingerprints and components. Null ids keep their fingerprint and get the component of the others with it, or null
    where there is none. Other columns of any name are ignored; an empty table gives an empty result.
    """
    own, member = grouped_fingerprints(docs, id_column, text_column, words)
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by = member.join(lowest, "root").select("fp", "component_id")
    return own.join(by, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped_fingerprints(docs: DataFrame, id_column: str, text_column: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp of every row; fp, least id, root of every fingerprint), the first a written table."""
    own = write_table(fingerprints(docs, id_column, text_column, words), "fingerprints")
    distinct = write_table(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    return own, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, h, root: each row's id, text hash and component (a fingerprint)."""
    own, member = grouped_fingerprints(docs, id_column, text_column, SHINGLE_WORDS)
    return own.join(member.select("fp", "root"), "fp").select("doc_id", "h", "root")


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", groups: Callable[..., DataFrame] = groups_of) -> DataFrame:
    """docs with one row of each component of ``groups`` (doc_id, h, root): of the rows with the smallest id, those with
    the least text hash, and of them any one.

    Rows without an id cannot be compared by id and stay as they are. An id may have several texts: each row counts by
    id and text. Columns may have any names; an empty table gives an empty result.
    """
    at = F.struct("doc_id", "h")
    first = groups(docs, id_column, text_column).where("doc_id IS NOT NULL").groupBy("root").agg(F.min(at).alias("at"))
    # each (id, text) is in one component only
    first = write_table(first.select(F.col("at.doc_id").alias("_i"), F.col("at.h").alias("_h")), "firsts")
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    own = row.select("_row", F.col("_row")[id_column].cast("long").alias("_id"), text_hash(F.col("_row")[text_column]).alias("_text"))
    # texts are dealt by id at every size: the kept ids grow with the corpus and are not for broadcasting
    kept = own.join(first.hint("shuffle_hash"), (F.col("_id") == F.col("_i")) & (F.col("_text") == F.col("_h")))
    one = kept.dropDuplicates(["_id", "_text"])
    return one.select("_row.*").union(docs.where(F.col(id_column).isNull()))
