"""Near copies by word shingles: all texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first, by operator 6's method in a wider setting: 64-bit fingerprints of the sets of 5-word shingles, dealt
to the anchors of ``simhash.QUARTERS``, so that all that differ in 7 or fewer bits meet. What it links is checked on the
whole texts. Two sets of similarity 0.8 may differ in more bits (9.7 are to be expected, 4.6 at 0.95), and no radius
that anchors can serve takes in all; so an exact search for the rest follows, between texts of different components only.

Its candidates come from prefixes: with the shingles of every text in one common order, two such texts
share one of the first n - ceil(0.8 n) + 1 of each. Shingles that many prefixes hold come last in that order, which any
order may; nothing is skipped. Each candidate pair is checked on the whole texts. A first round checks the members of a
shared shingle against one of them only, so that a large group of near copies is one component before the second round
checks all pairs between different components. In a large group most of those fail: where many prefixes share a shingle,
its rows carry small bitmaps (sketches), and only pairs that pass them leave the task that compares them. Components are found from spanning forests of the links: a large group
has many links for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm import simhash
from lodestack.llm.common import drop_tables, tidy, write_table
from lodestack.llm.ngram import blocks, spark_hash, word_keys

SHINGLE_WORDS = 5
#: Shingles in more prefixes come last in the order of shingles.
COMMON = 500
#: A shingle in more prefixes is dealt with its texts' sketches, so that only pairs that pass them leave a task.
CROWDED = 32
#: Most places of a sketch.
SKETCH_PLACES = 1_024
#: Links of which one task makes a forest.
FOREST_LINKS = 500_000
#: Pairs that leave a task together.
BLOCK_PAIRS = 100_000


def words_below(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The word shingles; all words where they are fewer."""
    w = words_below(text)
    return set(zip(*(w[i:] for i in range(SHINGLE_WORDS)))) if len(w) >= SHINGLE_WORDS else {tuple(w)}


def shingle_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The ascending 64-bit hashes of each text's shingles, made from the hashes of their words."""
    h, many = word_keys([""] * len(texts), [x.lower() for x in texts])
    last = SHINGLE_WORDS - 1
    whole = spark_hash(*(h[i : len(h) - last + i] for i in range(SHINGLE_WORDS))) if len(h) > last else h[:0]
    ends = np.cumsum(many)
    for a, b in zip((ends - many).tolist(), ends.tolist()):
        yield np.unique(whole[a : b - last]) if b - a > last else np.array([xxhash.xxh64_intdigest(h[a:b].tobytes())], np.uint64)


def bitmap(h: np.ndarray) -> bytes:
    """Parities of how many of the hashes fall on each place; the places are the power of two above their number."""
    places = max(64, 1 << len(h).bit_length())
    return np.packbits(np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The bits in which two bitmaps differ; the longer one is folded, which keeps parities."""
    one, two = sorted((x, y), key=len)
    value, size = int.from_bytes(two, "little"), 8 * len(two)
    while size > 8 * len(one):
        size //= 2
        value = (value >> size) ^ (value & ((1 << size) - 1))
    return (value ^ int.from_bytes(one, "little")).bit_count()


def sketch(bits: bytes) -> bytes:
    """A bitmap, folded to SKETCH_PLACES at most, which keeps parities."""
    own = np.frombuffer(bits, np.uint8)
    while 8 * len(own) > SKETCH_PLACES:
        own = own[: len(own) // 2] ^ own[len(own) // 2 :]
    return own.tobytes()


class Sketches:
    """The sketches of some texts, folded to each size that one of them has; two differ no more than the sets do."""

    def __init__(self, bits: list[bytes]) -> None:
        self.size = np.array([len(x) for x in bits])
        width = int(self.size.max())
        whole = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in bits), np.uint64).reshape(len(bits), -1)
        self.folded = {}
        for size in np.unique(self.size).tolist()[::-1]:
            while width > size:
                # narrower rows have nothing in the upper half
                whole, width = whole[:, : whole.shape[1] // 2] ^ whole[:, whole.shape[1] // 2 :], width // 2
            self.folded[size] = whole

    def differing(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many places the sketch of i and each of the others differ at least; compared at the smaller size."""
        out, least = np.zeros(len(others), np.int64), np.minimum(self.size[others], self.size[i])
        for size in np.unique(least).tolist():
            own = self.folded[size]
            here = least == size
            out[here] = np.bitwise_count(own[others[here]] ^ own[i]).sum(axis=1, dtype=np.int64)
        return out


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed long."""
    return int(np.uint64(simhash.majority(h)).view(np.int64))


def similar(common: int, n: int, m: int) -> bool:
    """Whether sets of n and m with so many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * common >= 4 * (n + m)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, h, digest (128 bits of all words) of (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [xxhash.xxh3_128_digest(b" ".join(words_below(x.as_py()))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["doc_id", "h", "digest"])

    return docs.mapInArrow(run, "doc_id long, h long, digest binary")


def prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """k, node, n, at, bits, sketch, fp: the shingles of each text's prefix with its number of shingles and the place among
    them; the first place has the text's bitmap, sketch and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in blocks(batch):
                keys, nodes, sizes, places, bits, sketches, fps = [], [], [], [], [], [], []
                for node, h in zip(own, shingle_hashes(texts)):
                    # one order for all texts: by hash, the common ones behind the others
                    late = np.isin(h, common)
                    n, first = len(h), len(h) - (4 * len(h) + 4) // 5 + 1
                    keys.append(np.concatenate((h[~late], h[late]))[:first] if late.any() else h[:first])
                    nodes.append(np.full(first, node, np.int64))
                    sizes.append(np.full(first, n, np.int32))
                    places.append(np.arange(first, dtype=np.int32))
                    bits.extend((bitmap(h), *[None] * (first - 1)))
                    sketches.extend((sketch(bits[-first]), *[None] * (first - 1)))
                    fps.extend((fingerprint(h), *[None] * (first - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (nodes, sizes, places)], pa.array(bits, pa.binary()), pa.array(sketches, pa.binary()), pa.array(fps, pa.int64())], names=["k", "node", "n", "at", "bits", "sketch", "fp"])

    return texts.select("node", "text").mapInArrow(run, "k long, node long, n int, at int, bits binary, sketch binary, fp long")


def met_at_anchors(marked: DataFrame) -> DataFrame:
    """a, b: pairs that connect all nodes whose fingerprints differ in 7 or fewer bits. marked: node, fp."""
    distinct = write_table(marked.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    found = simhash.links(distinct, simhash.QUARTERS).distinct()
    side = lambda x: distinct.select(F.col("fp").alias(x), F.col("first").alias(f"_{x}"))
    between = found.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    within = marked.join(distinct, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    out = write_table(between.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "met")
    drop_tables(distinct)
    return out


def candidates(dealt: DataFrame, stars: bool) -> DataFrame:
    """a, b: pairs that share a prefix's shingle and may be similar by their sizes and places; each with the smallest
    only (stars), or all that are not of one ``comp`` and may be similar by their sketches, where a shingle has them.
    dealt: k, node, n, at, comp, sketch (null or not for all of a k)."""
    own = dealt.repartition("k").sortWithinPartitions("k", "node")

    def met(node: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        drawn = None if stars or bits[0] is None else Sketches(bits.tolist())
        for i in range(1 if stars else len(node) - 1):
            most = 1 + np.minimum(n[i] - at[i], n[i + 1 :] - at[i + 1 :]) - 1
            own = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (9 * most >= 4 * (n[i] + n[i + 1 :])))
            if drawn and len(own):
                own = own[9 * drawn.differing(i, own) <= n[i] + n[own]]
            yield np.full(len(own), node[i]), node[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def scan(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edges = np.append(np.flatnonzero(np.concatenate(([True], np.diff(cols[0]) != 0))), len(cols[0]))
            size = 0
            for k in np.flatnonzero(np.diff(edges) > 1):
                node, n, at, comp, bits = (x[edges[k] : edges[k + 1]] for x in cols[1:])
                if (comp == comp[0]).all():
                    continue
                for pair in met(node, n, at, comp, bits):
                    out.append(pair)
                    size += len(pair[0])
                    if size > BLOCK_PAIRS:
                        yield made()
                        size = 0
            yield made()

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            rest = [x[last:] for x in cols]
            if last:
                yield from scan([x[:last] for x in cols])
        if rest is not None:
            yield from scan(rest)

    return own.select("k", "node", "n", "at", "comp", "sketch").mapInArrow(run, "a long, b long").distinct()


def close(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs a, b that may be similar by their bitmaps (node, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, one, two = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            fine = [9 * differing(x, y) <= i + j for i, j, x, y in zip(n, m, one, two)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda x: bitmaps.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("bits").alias(f"_bits{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_na", "_nb", "_bitsa", "_bitsb").mapInArrow(run, "a long, b long")


def checked(pairs: DataFrame, whole: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs a, b whose whole texts are similar; a written table. Only texts of candidates are dealt to the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int | None, set]] = [(None, set()), (None, set())]
        for batch in batches:
            fine = []
            for *nodes, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                for side, text in enumerate((one, two)):
                    if last[side][0] != nodes[side]:
                        last[side] = (nodes[side], shingles(text.as_py()))
                x, y = last[0][1], last[1][1]
                fine.append(similar(len(x & y), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    pairs = write_table(pairs, "candidates")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = write_table(texts_of(whole, distinct.join(need, "node")).dropDuplicates(["node"]), "wanted")
    two = pairs.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("_one")), "a").join(wanted.select(F.col("node").alias("b"), F.col("text").alias("_two")), "b")
    out = write_table(two.select("a", "b", "_one", "_two").mapInArrow(run, "a long, b long"), "links")
    drop_tables(pairs, wanted)
    return out


def spanned(links: DataFrame) -> DataFrame:
    """Links that connect all that links (a, b; a written table) connect: a spanning forest of each task's."""
    tasks = max(1, -(-links.count() // FOREST_LINKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for batch in batches:
            fine = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(a), top(b)
                fine.append(x != y)
                above[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(fine, pa.bool_()))

    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def texts_of(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of nodes (node, _i, _h: the row that has it); a row may be repeated."""
    at = nodes.select("node", "_i", "_h").hint("shuffle_hash")
    return whole.join(at, (F.col("doc_id") == F.col("_i")) & (F.col("h") == F.col("_h"))).select("node", "text")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links) of every document with an id.

    Upper case counts as lower; null and blank texts are equal to each other. An id may have several texts: each is a
    document. Other columns of any name are ignored; an empty table gives an empty result.
    """
    own = groups_of(docs, id_column, text_column)
    lowest = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(lowest, "root").select("doc_id", "component_id")


def groups_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, h (text hash), root (the component's number) of every row with an id; a written table."""
    text = F.col(text_column)
    whole = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), simhash.text_hash(text).alias("h"), text.alias("text"))
    own = write_table(digests(whole), "digests")
    distinct = own.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("at"))
    distinct = write_table(distinct.select("digest", F.monotonically_increasing_id().alias("node"), F.col("at.doc_id").alias("_i"), F.col("at.h").alias("_h")), "nodes")
    first = write_table(prefixes(texts_of(whole, distinct), np.zeros(0, np.uint64)), "prefixes")
    # at most a row for each COMMON prefix rows
    with tidy(docs.sparkSession):
        common = first.groupBy("k").count().where(F.col("count") > COMMON).select("k").toArrow().column("k").to_numpy().astype(np.int64).view(np.uint64)
    if len(common):
        drop_tables(first)
        first = write_table(prefixes(texts_of(whole, distinct), common), "prefixes")
    # most shingles are in one text only: they make no pair and are dealt no further
    bitmaps = write_table(first.where("at = 0").select("node", "n", "bits", "sketch", "fp"), "bitmaps")
    shared = first.drop("bits", "sketch", "fp").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("_n > 1")
    shared = shared.withColumn("crowded", F.col("_n") > CROWDED).drop("_n")
    shared = write_table(shared, "shared")
    drop_tables(first)
    first = shared
    near = met_at_anchors(bitmaps.select("node", "fp"))
    some = checked(close(near, bitmaps), whole, distinct)
    drop_tables(near)
    told = simhash.components(spanned(some))
    links = [some]
    for stars in (True, False):
        drawn = F.lit(None).cast("binary")
        rows = first.join(told, "node", "left")
        if not stars:
            rows = rows.join(bitmaps.select("node", "sketch"), "node")
            drawn = F.when(F.col("crowded"), F.col("sketch"))
        dealt = rows.select("k", "node", "n", "at", F.coalesce("root", "node").alias("comp"), drawn.alias("sketch"))
        links.append(checked(close(candidates(dealt, stars), bitmaps), whole, distinct))
        told = simhash.components(reduce(DataFrame.union, map(spanned, links)))
    roots = told
    by = distinct.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = write_table(own.join(by, "digest").select("doc_id", "h", "root"), "groups")
    drop_tables(own, distinct, first, bitmaps, *links)
    return out
