"""Namespace changes, review, presence and actors: each takes a snapshot and a batch and gives rows of the next one.

A working tree is rows of path, kind ("file", "dir", "symlink") and more. Errors are raised in the plan, so a wrong
batch fails as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.expressions import content_hash, may_write, parent_path
from lodestack.operators.tree import ancestors_of, is_inside, unified_diff
from lodestack.plans.storage import ranked


def failing(bad: Column, message: str, value: Column) -> Column:
    """value, or an error with the row's path where bad."""
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), value))).otherwise(value)


def mkdir(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """path, kind of new directories; one that exists is an error."""
    own = paths.select("path").distinct().join(tree.select("path", F.col("kind").alias("_k")), "path", "left")
    return own.select(failing(F.col("_k").isNotNull(), "exists", F.col("path")).alias("path"), F.lit("dir").alias("kind"))


def mkdir_missing(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """path, kind of the directories and ancestors that are missing; anything else in the way is an error."""
    wanted = ancestors_of(paths).select(F.col("ancestor").alias("path")).union(paths.select("path")).distinct()
    own = wanted.join(tree.select("path", F.col("kind").alias("_k")), "path", "left")
    # the error is part of the filter: a filter above it would be pushed below and pass it by
    wrong = F.raise_error(F.concat(F.lit("not a directory: "), "path")).cast("boolean")
    missing = F.when(F.col("_k").isNotNull() & (F.col("_k") != "dir"), wrong).otherwise(F.col("_k").isNull())
    return own.where(missing).select("path", F.lit("dir").alias("kind"))


def missing_dirs(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """path of the ancestors of paths that the tree lacks (mkdir_missing without the paths themselves)."""
    return ancestors_of(paths).select(F.col("ancestor").alias("path")).distinct().join(tree.select("path"), "path", "left_anti")


def rmdir(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """The tree without empty directories; one with a child is an error."""
    parents = tree.select(parent_path(F.col("path")).alias("path")).distinct().withColumn("_full", F.lit(True))
    own = paths.select("path").distinct().join(parents, "path", "left").select(failing(F.coalesce("_full", F.lit(False)), "not empty", F.col("path")).alias("path"))
    return tree.join(own, "path", "left_anti")


def unlink(dentry: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dentries left, ino of inodes that no entry names any more)."""
    left = dentry.join(gone.select("parent_ino", "name"), ["parent_ino", "name"], "left_anti")
    named = dentry.join(gone.select("parent_ino", "name"), ["parent_ino", "name"], "left_semi").select("ino").distinct()
    return left, named.join(left.select("ino"), "ino", "left_anti")


def rename(tree: DataFrame, source: str, target: str) -> DataFrame:
    """The tree with source (and all below it) at target. A file or an empty directory there is replaced; a directory
    with children, or a target within the source, is an error; onto itself nothing happens."""
    if source == target:
        return tree
    inside = is_inside(F.lit(target), F.lit(source))
    full = tree.where(parent_path(F.col("path")) == target).limit(1).select(F.lit(True).alias("_full"))
    own = tree.join(F.broadcast(full), how="left")  # one row at most
    moved = F.when(is_inside(F.col("path"), F.lit(source)), F.concat(F.lit(target), F.substring(F.col("path"), len(source) + 1, 1 << 30))).otherwise(F.col("path"))
    wrong = inside | F.coalesce(F.col("_full"), F.lit(False))
    return own.where(F.col("path") != target).withColumn("path", failing(wrong, "cannot be replaced", moved)).drop("_full")


def copy_subtree(tree: DataFrame, source: str, target: str) -> DataFrame:
    """The tree and a copy of source (and all below it) at target."""
    own = tree.where(is_inside(F.col("path"), F.lit(source)))
    return tree.unionByName(own.withColumn("path", F.concat(F.lit(target), F.substring(F.col("path"), len(source) + 1, 1 << 30))))


def removal_plan(tree: DataFrame, root: str) -> DataFrame:
    """path, kind, step: files first, then directories from the deepest up."""
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    own = tree.where(is_inside(F.col("path"), F.lit(root))).withColumn("depth", depth)
    order = [F.when(F.col("kind") == "dir", 1).otherwise(0), F.desc("depth"), F.col("path")]
    return ranked(own.select("path", "kind", "depth"), order, "step").drop("depth")


def symlinks(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, kind, target of new links; a path that exists is an error."""
    own = wanted.select("path", "target").join(tree.select("path", F.col("kind").alias("_k")), "path", "left")
    return own.select(failing(F.col("_k").isNotNull(), "exists", F.col("path")).alias("path"), F.lit("symlink").alias("kind"), "target")


# review ------------------------------------------------------------------------------------------------------------


def propose(changes: DataFrame, current: DataFrame, now: int) -> DataFrame:
    """Pending proposals from changes (id, actor_id, path, data): of the data's hash, or of a deletion where data is
    null. The base is the path's content now (null: none); deleting what is not there is an error."""
    own = changes.join(current.select("path", F.col("content_hash").alias("base_hash"), F.lit(True).alias("_is")), "path", "left")
    deletes = F.col("data").isNull()
    return own.select(
        "id", "actor_id", failing(deletes & F.col("_is").isNull(), "not found", F.col("path")).alias("path"), "base_hash",
        F.when(deletes, "delete").otherwise("bytes").alias("kind"), content_hash(F.col("data")).alias("content_hash"),
        F.lit("pending").alias("status"), F.lit(now).cast("long").alias("created_at"),
    )


def listed(suggestions: DataFrame, status: str | None = None) -> DataFrame:
    """Proposals, of one status where given, newest first."""
    return filtered(suggestions, status=status).orderBy(F.desc("id"))


def proposal_diff(proposals: DataFrame, content: DataFrame) -> DataFrame:
    """path (the proposal's id), diff: the unified difference of each proposal's base and its text; content: hash, text."""
    text = lambda name: content.select(F.col("hash").alias(f"{name}_hash"), F.col("text").alias(f"_{name}"))
    own = proposals.join(text("base"), "base_hash", "left").join(text("content"), "content_hash", "left")
    return unified_diff(own.select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.col("_base").alias("old"), F.col("_content").alias("new")))


def scoped(rows: DataFrame, inodes: DataFrame, workspace_id: int) -> DataFrame:
    """Rows (ino) whose inode belongs to the workspace; inodes: ino, workspace_id."""
    return rows.join(inodes.where(F.col("workspace_id") == workspace_id).select("ino"), "ino", "left_semi")


def stale_suggestions(suggestions: DataFrame, current: DataFrame, excepted: int | None = None) -> DataFrame:
    """id of pending byte proposals whose base is no longer the path's content (null equals null)."""
    own = suggestions.where("status = 'pending' AND kind = 'bytes'")
    if excepted is not None:
        own = own.where(F.col("id") != excepted)
    both = own.join(current.select("path", "content_hash"), "path", "left")
    return both.where(~F.col("base_hash").eqNullSafe(F.col("content_hash"))).select("id")


def route_writes(writes: DataFrame, actors: DataFrame) -> DataFrame:
    """writes with outcome wrote or proposed, by the writer's policy; an unknown writer may only propose."""
    policy = actors.select(F.col("id").alias("actor"), "write_policy")
    return writes.join(policy, "actor", "left").withColumn("outcome", F.when(may_write(F.col("write_policy")), "wrote").otherwise("proposed"))


def review(suggestions: DataFrame, reviews: DataFrame, actors: DataFrame, current: DataFrame) -> DataFrame:
    """id, reviewer, decision of reviews (id, reviewer, accept) of proposals.

    not_pending, not_allowed (the reviewer may not write), own (reviewer is the author), conflict (the base of an
    accepted byte proposal has changed), accepted or rejected.
    """
    own = reviews.join(suggestions.select("id", "actor_id", "path", "base_hash", "status", F.col("kind").alias("_kind")), "id", "left")
    own = own.join(actors.select(F.col("id").alias("reviewer"), "write_policy"), "reviewer", "left").join(current.select("path", "content_hash"), "path", "left")
    decision = (
        F.when(~F.coalesce(F.col("status") == "pending", F.lit(False)), "not_pending")
        .when(~may_write(F.col("write_policy")), "not_allowed")
        .when(F.col("reviewer") == F.col("actor_id"), "own")
        .when(~F.col("accept"), "rejected")
        .when((F.col("_kind") == "bytes") & ~F.col("base_hash").eqNullSafe(F.col("content_hash")), "conflict")
        .otherwise("accepted")
    )
    return own.select("id", "reviewer", decision.alias("decision"))


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each given value; None leaves a column open."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


# presence and live documents ---------------------------------------------------------------------------------------


def presence(heartbeats: DataFrame) -> DataFrame:
    """session_id, actor_id, path, last_seen: each session's newest heartbeat (ties: greatest path)."""
    rest = [c for c in heartbeats.columns if c != "session_id"]
    newest = F.max_by(F.struct(*rest), F.struct("last_seen", "path", "actor_id"))
    return heartbeats.groupBy("session_id").agg(newest.alias("_r")).select("session_id", "_r.*").select(*heartbeats.columns)


def active(rows: DataFrame, actors: DataFrame, now: int, window: int = 60) -> DataFrame:
    """Sessions seen within the window, with their actor, most recent first."""
    names = actors.select(F.col("id").alias("actor_id"), "kind", "display_name")
    return rows.where(F.col("last_seen") >= now - window).join(names, "actor_id").orderBy(F.desc("last_seen"), "session_id")


def reaped(rows: DataFrame, now: int, grace: int = 300) -> DataFrame:
    """Presence without sessions that were last seen before the grace period."""
    return rows.where(F.col("last_seen") >= now - grace)


def live_documents(marks: DataFrame) -> DataFrame:
    """path, since, session_id, actor_id, content_hash: the first mark's time, the newest mark's other values."""
    newest = F.struct("at", "seq", "session_id", "actor_id", "content_hash")
    by = marks.groupBy("path").agg(F.min("at").alias("since"), F.max(newest).alias("_n"))
    return by.select("path", "since", "_n.session_id", "_n.actor_id", "_n.content_hash")
