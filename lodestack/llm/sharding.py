"""Sharding by Karmarkar-Karp differencing of indivisible groups.

Equal texts are one group with the sum of their sizes. A chunk of groups is divided into k parts by repeatedly
combining the two partial partitions with the largest spread, the larger parts of one with the smaller parts of the
other. Chunks become items of k sizes themselves and are combined in the same way, level by level, so a task never
holds more than a chunk, and the last level has one item. Going down again, every group gets its shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import gapless_rank, write_table

#: Items that one task differences.
CHUNK = 4_000
#: Bytes that each document adds to its text's.
OVERHEAD = 16


def difference(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(assignment, sizes): for items (n, k), each with k sizes, the part of each item's each size, and the parts' sums.

    The combined partition with the largest spread is taken with the next one, oppositely ordered. What was combined
    is a tree; the parts are handed down it at the end.
    """
    n, k = items.shape
    sizes: list[np.ndarray] = []
    orders: list[np.ndarray] = []
    for row in items:
        order = np.argsort(-row, kind="stable")
        sizes.append(row[order])
        orders.append(order)
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sizes[a] + sizes[b][::-1]
        order = np.argsort(-both, kind="stable")
        sizes[a] = sizes[b] = None
        sizes.append(both[order])
        made.append((a, b, order))
        heapq.heappush(heap, (int(both[order[-1]] - both[order[0]]), len(sizes) - 1))
    part: list[np.ndarray | None] = [None] * len(sizes)
    part[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        own = np.empty(k, np.int64)
        own[order] = part[n + i]
        part[a], part[b] = own, own[::-1]
        part[n + i] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, orders[i]] = part[i]
    return out, sizes[-1]


def divide(groups: DataFrame, shards: int, size: str = "size", chunk: int = CHUNK) -> DataFrame:
    """A written table of groups (any columns, one with sizes) with ``shard`` added; sizes must be known (not null)."""
    spark = groups.sparkSession
    names = groups.columns
    n = groups.count()
    # a chunk takes rows of like sizes by turns, so that chunks are alike: rows are dealt by a hash
    level = groups.withColumn("_chunk", F.pmod(F.xxhash64(*names), F.lit(max(1, math.ceil(n / chunk)))))
    first = f"{groups.select(*names).schema.simpleString()[7:-1]}, _chunk long, _part int, _sums array<long>"

    def leaf(frame: pd.DataFrame) -> pd.DataFrame:
        items = np.zeros((len(frame), shards), np.int64)
        items[:, 0] = frame[size]
        part, sums = difference(items)
        told = [None] * len(frame)
        told[0] = sums
        return frame.assign(_part=part[:, 0].astype(np.int32), _sums=told)[[*names, "_chunk", "_part", "_sums"]]

    own = write_table(level.groupBy("_chunk").applyInPandas(leaf, first), "chunks")
    steps = []
    items = own.where("_sums IS NOT NULL").select(F.col("_chunk").alias("item"), F.col("_sums").alias("sums"))
    count = items.count()
    while count > 1:
        chunks = math.ceil(count / chunk)

        def node(frame: pd.DataFrame) -> pd.DataFrame:
            part, sums = difference(np.array(frame["sums"].tolist(), np.int64))
            told = [None] * len(frame)
            told[0] = sums
            return pd.DataFrame({"item": frame["item"], "upper": frame["upper"], "part": list(part), "sums": told})

        dealt = items.withColumn("upper", F.pmod(F.xxhash64("item"), F.lit(chunks)))
        done = write_table(dealt.groupBy("upper").applyInPandas(node, "item long, upper long, part array<long>, sums array<long>"), "level")
        steps.append(done.select("item", "upper", "part"))
        items = done.where("sums IS NOT NULL").select(F.col("upper").alias("item"), "sums")
        count = chunks if chunks == 1 else items.count()
    route = None
    for step in reversed(steps):
        if route is None:
            route = step.select("item", "part")
        else:
            up = route.select(F.col("item").alias("upper"), F.col("part").alias("_up"))
            route = step.join(up, "upper").select("item", F.transform("part", lambda p: F.col("_up")[p.cast("int")]).alias("part"))
    if route is None:
        return own.select(*names, F.col("_part").alias("shard"))
    route = route.select(F.col("item").alias("_chunk"), "part")
    return own.join(route, "_chunk").select(*names, F.col("part")[F.col("_part")].cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law ``bytes``.

    Documents with equal texts are in one shard. A shard's slots are numbered from 0 by a two-step count, so no shard
    is one task. Null texts are a group of their own (size OVERHEAD, checksum 0, as empty texts); a null id stays null;
    repeated rows get a slot each; other columns are ignored; an empty table gives an empty result.
    """
    data = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    own = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.when(F.col(text_column).isNull(), F.lit("")).otherwise(F.sha2(data, 256)).alias("_group"),
    )
    own = write_table(own, "documents")
    groups = write_table(own.groupBy("_group").agg(F.sum("size").alias("size")), "groups")
    placed = divide(groups, shards).select("_group", "shard")
    out = write_table(own.join(placed, "_group").select("doc_id", "size", "text_crc32", "shard"), "placed")
    return gapless_rank(out, ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """docs as Parquet folders shard=0.. under path, by the placement of shard_documents (ids must be unique)."""
    own = placed.select(F.col("doc_id").alias("_id"), "shard")
    docs.join(own, docs[id_column] == F.col("_id")).drop("_id").write.partitionBy("shard").parquet(path)


def spread(placed: DataFrame) -> Iterator[tuple[int, int]]:
    """(shard, bytes), for reports."""
    yield from ((r.shard, r.size) for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).orderBy("shard").collect())
