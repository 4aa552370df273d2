"""Trees: listing, path materialisation, building and flattening of trees, snapshot differences.

Recursion is a loop over levels of joins; each level is one join, and the loop ends with the deepest directory. Where a
level's lineage would grow too long, levels are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.expressions import join_path
from lodestack.plans.storage import settle


def list_dir(dentry: DataFrame, inode: DataFrame, parent: int) -> DataFrame:
    """name, ino, kind, size of a directory's entries by name; an entry whose inode vanished drops out."""
    return dentry.where(F.col("parent_ino") == parent).join(inode, "ino").select("name", "ino", "kind", "size").orderBy("name")


def list_dir_page(dentry: DataFrame, inode: DataFrame, parent: int, after: str | None, limit: int) -> DataFrame:
    """A keyset page behind ``after``. The page is the feature; entries are cut before inodes are looked up."""
    own = dentry.where(F.col("parent_ino") == parent)
    own = own.where(F.col("name") > after) if after is not None else own
    return own.orderBy("name").limit(limit).join(inode, "ino").select("name", "ino", "kind", "size").orderBy("name")


def page_state(page: DataFrame, limit: int) -> DataFrame:
    """next_after, end: an exactly full last page does not know that it is the last."""
    return page.agg(F.max("name").alias("next_after"), (F.count(F.lit(1)) < limit).alias("end"))


def get_inodes(inode: DataFrame, ids: DataFrame) -> DataFrame:
    return inode.join(ids.select("ino").distinct(), "ino", "left_semi")


def child_count(dentry: DataFrame) -> DataFrame:
    return dentry.groupBy("parent_ino").agg(F.count(F.lit(1)).alias("children"))


def first_name(dentry: DataFrame) -> DataFrame:
    """ino, parent_ino, name: the least name that an inode has in a directory."""
    return dentry.groupBy("parent_ino", "ino").agg(F.min("name").alias("name"))


def tree_paths(dentry: DataFrame, inode: DataFrame, root: int = 1, most_depth: int = 4_096) -> DataFrame:
    """ino, kind, size, path, depth of everything below the root (the root itself left out)."""
    edges = dentry.join(inode.select("ino", "kind", "size"), "ino")
    level = edges.where(F.col("parent_ino") == root).select("ino", "kind", "size", F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth"))
    out = level
    for depth in range(2, most_depth + 1):
        parents = level.where("kind = 'dir'").select(F.col("ino").alias("parent_ino"), F.col("path").alias("_up"))
        level = edges.join(parents, "parent_ino").select("ino", "kind", "size", join_path(F.col("_up"), F.col("name")).alias("path"), F.lit(depth).alias("depth"))
        level = settle(level)
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError("the tree is deeper than allowed, or has a cycle")


def resolve(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with its inode; null where nothing is there."""
    return wanted.join(paths.select("path", "ino", "kind"), "path", "left")


def tally(paths: DataFrame) -> DataFrame:
    """path, files, dirs, bytes: of everything below each directory; one row for each directory of paths (path, kind, size)."""
    own = paths.select("path", F.col("kind").alias("_kind"), "size")
    up = ancestors_of(own, "_kind", "size")
    is_dir = F.col("_kind") == "dir"
    below = up.groupBy(F.col("ancestor").alias("path")).agg(F.count_if(~is_dir).alias("files"), F.count_if(is_dir).alias("dirs"), F.sum(F.when(~is_dir, F.col("size")).otherwise(0)).alias("bytes"))
    zero = F.lit(0).cast("long")
    dirs = own.where(is_dir).select("path").join(below, "path", "left")
    return dirs.select("path", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("files", "dirs", "bytes")])


def ancestors_of(paths: DataFrame, *keep: str) -> DataFrame:
    """path (and ``keep``), ancestor: every proper ancestor prefix of each path, nearest last."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return paths.select("path", *keep, F.explode(F.when(F.size(parts) > 1, prefix).otherwise(F.array().cast("array<string>"))).alias("ancestor"))


def is_inside(target: Column, source: Column) -> Column:
    """The target is the source or lies below it (a rename into itself is refused)."""
    return (target == source) | target.startswith(F.concat(source, F.lit("/")))


def entry_line(mode: Column, kind: Column, hash_: Column, name: Column) -> Column:
    return F.concat_ws(" ", mode.cast("string"), kind, hash_, name)


def build_tree(files: DataFrame, empty_hash: str) -> DataFrame:
    """tree_hash, path (of the directory), name, mode, kind, hash: all tree entries, built from the deepest level up.

    files: path, mode, kind, hash. Empty files (null hash) are stored as the empty manifest's hash. Entries are in byte
    order of their names; a tree's hash covers them.
    """
    cut = F.regexp_extract("path", "^(.*)/([^/]+)$", 1)
    level = files.select(cut.alias("dir"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "mode", "kind", F.coalesce("hash", F.lit(empty_hash)).alias("hash"))
    level = level.withColumn("depth", F.length("dir") - F.length(F.replace("dir", F.lit("/"), F.lit(""))))
    deepest = level.agg(F.max("depth")).first()[0]
    if deepest is None:
        return level.select(F.lit("").alias("tree_hash"), F.col("dir").alias("path"), "name", "mode", "kind", "hash")
    out, above = None, level.limit(0)
    for depth in range(deepest, -1, -1):
        here = level.where(F.col("depth") == depth).unionByName(above)
        line = F.struct("name", entry_line(F.col("mode"), F.col("kind"), F.col("hash"), F.col("name")).alias("line"))
        trees = here.groupBy("dir").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("tree_hash"))
        trees = settle(trees)
        entries = here.join(trees, "dir").select("tree_hash", F.col("dir").alias("path"), "name", "mode", "kind", "hash")
        out = entries if out is None else out.union(entries)
        if depth:
            above = trees.select(
                F.regexp_extract("dir", "^(.*)/([^/]+)$", 1).alias("dir"), F.regexp_extract("dir", "([^/]+)$", 1).alias("name"),
                F.lit(0o40000).cast("long").alias("mode"), F.lit("dir").alias("kind"), F.col("tree_hash").alias("hash"), F.lit(depth - 1).alias("depth"),
            )
            above = above.select(*level.columns)
    return out


def flatten_tree(entries: DataFrame, root: str, most_depth: int = 4_096) -> DataFrame:
    """path, kind, hash of a tree object's files: directories are entered and left out, modes don't count."""
    level = entries.where(F.col("tree_hash") == root).select(F.concat(F.lit("/"), "name").alias("path"), "kind", "hash")
    out = level.where("kind <> 'dir'")
    for _ in range(most_depth):
        dirs = level.where("kind = 'dir'").select(F.col("path").alias("_up"), F.col("hash").alias("tree_hash"))
        level = settle(entries.join(dirs, "tree_hash").select(join_path(F.col("_up"), F.col("name")).alias("path"), "kind", "hash"))
        if level.isEmpty():
            return out
        out = out.union(level.where("kind <> 'dir'"))
    raise ValueError("the tree is deeper than allowed")


def diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """path, status (A, M, D) by hash only; mode and kind don't count. By path."""
    b, t = base.select("path", F.col("hash").alias("_b")), target.select("path", F.col("hash").alias("_t"))
    status = F.when(F.col("_b").isNull(), "A").when(F.col("_t").isNull(), "D").when(F.col("_b") != F.col("_t"), "M")
    return b.join(t, "path", "full_outer").select("path", status.alias("status")).where("status IS NOT NULL").orderBy("path")


def live_touched(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Live documents that a difference touches."""
    return live.join(changes, "path", "left_semi")


def unified_diff(pairs: DataFrame) -> DataFrame:
    """path, diff of pairs (path, old, new: text); empty where they are equal."""
    import difflib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, old, new in zip(*(batch.column(k).to_pylist() for k in range(3))):
                a, b = (old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True)
                out.append("" if old == new else "".join(difflib.unified_diff(a, b, f"a{path}", f"b{path}")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "diff"])

    return pairs.select("path", "old", "new").mapInArrow(run, "path string, diff string")


def git_order(entries: DataFrame) -> DataFrame:
    """Tree entries in git's order: a directory's name compares with a slash behind it."""
    key = F.when(F.col("kind") == "dir", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("tree_hash").orderBy(key)))
