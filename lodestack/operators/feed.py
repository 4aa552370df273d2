"""The change feed: paging, dispatch, coalescing, the current-state view, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events of a page (fixed value).
PAGE = 1_000


def since(feed: DataFrame, cursor: int, branch: str | None = None, limit: int = PAGE) -> DataFrame:
    """A page of events behind the cursor, in order; the branch is chosen before the page is cut, so it can't stall."""
    own = feed.where(F.col("seq") > cursor)
    own = own.where(F.col("branch") == branch) if branch is not None else own
    return own.orderBy("seq").limit(limit)


def head(feed: DataFrame) -> DataFrame:
    return feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))


def dispatch(feed: DataFrame) -> DataFrame:
    """seq, sub, op (upsert, delete, commit, other), path, kind and more: a rename is a delete and an upsert of its
    target (none where it has no target)."""
    def op(name: str, sub: int, path: Column) -> Column:
        return F.struct(F.lit(name).alias("op"), F.lit(sub).alias("sub"), path.alias("path"))

    one = (
        F.when(F.col("kind") == "write", F.array(op("upsert", 0, F.col("path"))))
        .when(F.col("kind") == "remove", F.array(op("delete", 0, F.col("path"))))
        .when((F.col("kind") == "rename") & (F.coalesce("detail", F.lit("")) != ""), F.array(op("delete", 0, F.col("path")), op("upsert", 1, F.col("detail"))))
        .when(F.col("kind") == "rename", F.array(op("delete", 0, F.col("path"))))
        .when(F.col("kind") == "commit", F.array(op("commit", 0, F.col("path"))))
        .otherwise(F.array(op("other", 0, F.col("path"))))
    )
    rest = [c for c in feed.columns if c != "path"]
    return feed.select(*rest, F.explode(one).alias("_o")).select(*rest, "_o.op", "_o.sub", "_o.path")


def coalesced(feed: DataFrame) -> DataFrame:
    """path, op, seq, first_seq, place: the last content operation of each path; ``place`` is the order of delivery
    (by first appearance). Commits and others are not coalesced (see dispatch) and are delivered before these."""
    ops = dispatch(feed).where("op IN ('upsert', 'delete')")
    at = F.struct("seq", "sub")
    by = ops.groupBy("path").agg(F.max_by("op", at).alias("op"), F.max("seq").alias("seq"), F.min(at).alias("_first"))
    return by.select("path", "op", "seq", F.col("_first.seq").alias("first_seq"), F.col("_first.sub").alias("first_sub"))


def sink_rows(feed: DataFrame) -> DataFrame:
    """seq, ts, actor_id, kind, path, branch as a warehouse keeps them: upsert, delete and commit rows."""
    return dispatch(feed).where("op <> 'other'").select("seq", "sub", "ts", "actor_id", F.when(F.col("op") == "commit", "commit").otherwise(F.col("op")).alias("kind"), F.when(F.col("op") == "commit", "/").otherwise(F.col("path")).alias("path"), "branch")


def latest(rows: DataFrame, tie: list[str]) -> DataFrame:
    """The newest row of each path by seq; ``tie`` columns (descending) settle equal ones, as a snapshot's rows have
    one seq and the view itself has no tie-break."""
    # combined before rows meet, so that a path with very many rows (commits are all "/") is no task's burden
    rest = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("seq", *tie)).alias("_r")).select("path", "_r.*").select(*rows.columns)


def current_state(rows: DataFrame, content: DataFrame, tie: list[str], cleaned: bool = False) -> DataFrame:
    """path, seq, actor_id, branch, size, text: newest row of each path that is not a delete, with its content.

    rows: sink rows with sha256; content: sha256, size, text. Commit rows are let through as ``/`` with no content,
    as the view does; ``cleaned`` drops them.
    """
    own = latest(rows, tie).where("kind <> 'delete'")
    own = own.where("kind <> 'commit'") if cleaned else own
    return own.join(content, "sha256", "left").select("path", "seq", "actor_id", "branch", "size", "text")


def distinct_content(content: DataFrame) -> DataFrame:
    return content.dropDuplicates(["sha256"])


def superseded_dropped(ops: DataFrame, tree: DataFrame) -> DataFrame:
    """Upserts whose path is gone by now do nothing; deletes stay."""
    live = ops.where("op = 'upsert'").join(tree.select("path"), "path", "left_semi")
    return live.unionByName(ops.where("op = 'delete'"))


def bootstrap(feed: DataFrame, tree: DataFrame, mode: str) -> DataFrame:
    """path, op, seq to begin with: every file of the tree at the head's seq (snapshot), all events (replay), none."""
    if mode == "snapshot":
        return tree.crossJoin(F.broadcast(head(feed))).select("path", F.lit("upsert").alias("op"), F.col("head").alias("seq"))  # one row
    if mode == "replay":
        return coalesced(feed).select("path", "op", "seq")
    if mode == "none":
        return coalesced(feed).select("path", "op", "seq").limit(0)
    raise ValueError(mode)
