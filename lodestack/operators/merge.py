"""Three-way merge of trees and of texts, and locks.

One level of a tree is two left joins from the union of the names; directories that both sides changed are merged a
level deeper, so a conflict is reported where the reference semantics has it: at the directory, not at its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.expressions import join_path
from lodestack.operators.attribution import common_lines, split_lines
from lodestack.plans.storage import settle

ENTRY = ("mode", "kind", "hash")


def side(entries: DataFrame, tag: str) -> DataFrame:
    """dir, name and the entry as one struct column."""
    return entries.select("dir", "name", F.struct(*ENTRY).alias(tag))


def decide(b: Column, o: Column, t: Column) -> tuple[Column, Column, Column]:
    """(action, entry, conflict) of one name; action: keep, drop, recurse or merge_file.

    Entries are equal when mode, kind and hash are: a changed mode is a change here.
    """
    both = o.isNotNull() & t.isNotNull()
    same_kind = o["kind"] == t["kind"]
    action = (
        F.when(~both & b.isNull(), "keep")
        .when(~both & (b == F.coalesce(o, t)), "drop")
        .when(~both, "keep")
        .when((o == t) | b.eqNullSafe(o) | b.eqNullSafe(t), "keep")
        .when(same_kind & (o["kind"] == "dir"), "recurse")
        .when(same_kind & (o["kind"] == "file"), "merge_file")
        .otherwise("keep")
    )
    entry = F.when(~both, F.coalesce(o, t)).when((o == t) | b.eqNullSafe(t), o).when(b.eqNullSafe(o), t).otherwise(o)
    conflict = (
        F.when(o.isNotNull() & t.isNull() & b.isNotNull() & (b != o), "modify/delete")
        .when(o.isNull() & t.isNotNull() & b.isNotNull() & (b != t), "delete/modify")
        .when(both & (o != t) & ~b.eqNullSafe(o) & ~b.eqNullSafe(t) & ~same_kind, "type")
        .when(both & (o != t) & ~b.eqNullSafe(o) & ~b.eqNullSafe(t) & (o["kind"] == "symlink"), "symlink")
    )
    return action, entry, conflict


def merge_level(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """dir, name, action, entry, conflict, b, o, t of every name that ours or theirs has."""
    names = ours.select("dir", "name").union(theirs.select("dir", "name")).distinct()
    rows = names
    for df, tag in ((base, "b"), (ours, "o"), (theirs, "t")):
        rows = rows.join(side(df, tag), ["dir", "name"], "left")
    action, entry, conflict = decide(F.col("b"), F.col("o"), F.col("t"))
    return rows.select("dir", "name", action.alias("action"), entry.alias("entry"), conflict.alias("conflict"), "b", "o", "t")


def merge_trees(base: DataFrame, ours: DataFrame, theirs: DataFrame, entries: DataFrame, most_depth: int = 4_096) -> DataFrame:
    """dir, name, action, entry, conflict, b, o, t over all levels that have to be entered.

    base, ours, theirs: the root level (dir "/", name, mode, kind, hash); entries: tree_hash, name, mode, kind, hash of
    all trees. Equal subtrees are never entered.
    """
    out = None
    for _ in range(most_depth):
        level = settle(merge_level(base, ours, theirs))
        out = level if out is None else out.union(level)
        deeper = level.where("action = 'recurse'")
        if deeper.isEmpty():
            return out

        def below(tag: str, deeper: DataFrame = deeper) -> DataFrame:
            dirs = deeper.where(f"{tag}.kind = 'dir'").select(join_path(F.col("dir"), F.col("name")).alias("dir"), F.col(f"{tag}.hash").alias("tree_hash"))
            return dirs.join(entries, "tree_hash").select("dir", "name", *ENTRY)

        base, ours, theirs = below("b"), below("o"), below("t")
    raise ValueError("the tree is deeper than allowed")


def merge_text(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    """(text, whether it conflicts) of a line merge: stretches between lines common to all three are taken from the
    side that changed them; where both changed one differently both stand between markers."""
    b, o, t = split_lines(base), split_lines(ours), split_lines(theirs)
    of, tf = dict(common_lines(b, o)), dict(common_lines(b, t))
    anchors = [(i, of[i], tf[i]) for i in range(len(b)) if i in of and i in tf] + [(len(b), len(o), len(t))]
    out, conflict, i, j, k = [], False, 0, 0, 0
    for x, y, z in anchors:
        bs, os_, ts = b[i:x], o[j:y], t[k:z]
        if os_ == ts or bs == ts:
            out += os_
        elif bs == os_:
            out += ts
        else:
            conflict = True

            def ended(part: list[str]) -> list[str]:
                return [*part[:-1], part[-1] if part[-1].endswith("\n") else part[-1] + "\n"] if part else []

            out += ["<<<<<<< ours\n", *ended(os_), "||||||| base\n", *ended(bs), "=======\n", *ended(ts), ">>>>>>> theirs\n"]
        if x < len(b):
            out.append(b[x])
        i, j, k = x + 1, y + 1, z + 1
    return "".join(out), conflict


def merge_files(rows: DataFrame) -> DataFrame:
    """path, data, conflict, theirs of files that both sides have: rows of path, base, ours, theirs (binary; base may
    be null).

    Text merges by lines. Else a side that did not change gives way; where both changed, ours stays and theirs is kept
    beside it under a ``.theirs`` name (column theirs). A conflict of texts has its markers in data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for base, ours, theirs in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                try:
                    text, bad = merge_text((base or b"").decode(), ours.decode(), theirs.decode())
                    made = (text.encode(), bad, None)
                except UnicodeDecodeError:
                    if base == ours or ours == theirs:
                        made = (theirs, False, None)
                    elif base == theirs:
                        made = (ours, False, None)
                    else:
                        made = (ours, True, theirs)
                for column, value in zip(out, made):
                    column.append(value)
            kinds = (pa.binary(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=["path", "data", "conflict", "theirs"])

    return rows.select("path", "base", "ours", "theirs").mapInArrow(run, "path string, data binary, conflict boolean, theirs binary")


def apply_hunks(rows: DataFrame) -> DataFrame:
    """path, text: rows of path, old, new (text) and keep (numbers of the hunks to apply, from 0)."""

    def chosen(old: str, new: str, keep: set[int]) -> str:
        a, b = split_lines(old), split_lines(new)
        out, i, j, hunk = [], 0, 0, 0
        for x, y in [*common_lines(a, b), (len(a), len(b))]:
            if a[i:x] or b[j:y]:
                out += b[j:y] if hunk in keep else a[i:x]
                hunk += 1
            if x < len(a):
                out.append(a[x])
            i, j = x + 1, y + 1
        return "".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [chosen(o, n, set(k or ())) for o, n, k in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "text"])

    return rows.select("path", "old", "new", "keep").mapInArrow(run, "path string, text string")


def lock_holders(attempts: DataFrame) -> DataFrame:
    """path, owner, acquired_at: the first to ask holds the lock (ties: the least owner)."""
    first = attempts.groupBy("path").agg(F.min(F.struct("acquired_at", "owner")).alias("_m"))
    return first.select("path", "_m.owner", "_m.acquired_at")


def release_locks(locks: DataFrame, releases: DataFrame) -> DataFrame:
    """Locks without those that their own owner releases (path, owner)."""
    return locks.join(releases.select("path", "owner"), ["path", "owner"], "left_anti")
