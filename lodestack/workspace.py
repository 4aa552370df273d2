"""A workspace as one object: files, versions, branches, merges and collection over snapshot tables.

All state is tables of a SnapshotStore; every change writes new snapshots and then the pointer. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import attribution, content, history, merge, tree, workspace
from lodestack.plans.storage import SnapshotStore, settle
from lodestack.sources.stores import ChunkStore

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
FILE_MODE = 0o100644
SCHEMAS = {
    "working": "path string, mode long, kind string, hash string, size long",
    "manifests": "mhash string, size long, chunks array<struct<hash: string, len: bigint>>",
    "trees": "tree_hash string, name string, mode long, kind string, hash string",
    "commits": "hash string, tree string, parents array<string>, author string, message string, ts long",
    "refs": "name string, value string",
    "blame": f"content_hash string, runs {attribution.RUNS}",
    "events": "seq long, actor_id long, session_id long, kind string, path string, detail string, ts long, branch string",
}


class Workspace:
    """Files are named by path; their content is chunked, deduplicated and named by hash; ``now`` is always given."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.chunks = spark, SnapshotStore(spark, f"{root}/meta"), ChunkStore(spark, f"{root}/chunks")

    def table(self, name: str) -> DataFrame:
        try:
            return self.store.read(name)
        except KeyError:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: DataFrame, key: list[str]) -> None:
        old = self.table(name)
        self.store.write(name, old.unionByName(rows.join(old.select(*key), key, "left_anti")))

    # files

    def write(self, files: DataFrame, actor: int, session: int, now: int) -> None:
        """path, data: new contents. Lines that stay keep their authors; the order is content, metadata, feed."""
        own = settle(files.select("path", F.coalesce("data", F.unhex(F.lit(""))).alias("data")))
        cut = settle(content.cut_passages(own, "content_defined", content.STORAGE_SIZES[1]))
        manifests = settle(content.build_manifests(cut))
        before = settle(self.read(own.select("path")).select("path", F.col("data").alias("_old")))
        self.chunks.put(content.distinct_chunks(cut))
        self.append("manifests", manifests.select("mhash", "size", "chunks").dropDuplicates(["mhash"]), ["mhash"])
        rows = own.select("path", F.octet_length("data").cast("long").alias("size")).join(manifests.select("path", F.col("mhash").alias("hash")), "path", "left")
        rows = rows.select("path", F.lit(FILE_MODE).cast("long").alias("mode"), F.lit("file").alias("kind"), "hash", "size")
        self.attribute(own, before, rows, actor, session)
        old = self.table("working")
        self.store.write("working", old.join(rows.select("path"), "path", "left_anti").unionByName(rows))
        self.emit(own.select("path"), "write", actor, session, now)

    def attribute(self, own: DataFrame, before: DataFrame, rows: DataFrame, actor: int, session: int) -> None:
        """Blame by content: the old bytes' runs are a first revision, the new bytes a second one."""
        known = self.table("working").join(self.table("blame"), F.col("hash") == F.col("content_hash")).select("path", "runs")
        fold = before.join(known, "path", "left").join(own, "path", "right").join(rows.select("path", F.col("hash").alias("content_hash")), "path")
        columns = fold.select("path", "content_hash", "_old", "data", "runs")
        runs = attribution.derived_runs(columns, (actor, session)).where("content_hash IS NOT NULL")
        new = runs.dropDuplicates(["content_hash"])
        self.store.write("blame", self.table("blame").join(new.select("content_hash"), "content_hash", "left_anti").unionByName(new))

    def read(self, paths: DataFrame) -> DataFrame:
        """path, data of the files that exist."""
        own = self.table("working").join(paths.select("path").distinct(), "path", "left_semi")
        found = own.join(self.table("manifests").select(F.col("mhash").alias("hash"), "chunks", F.col("size").alias("_n")), "hash")
        full = content.read_files(found.select("path", F.col("_n").alias("size"), "chunks"), self.chunks.all().select("hash", "len", "bytes"))
        return full.unionByName(own.where("hash IS NULL").select("path", F.unhex(F.lit("")).alias("data")))

    def remove(self, root: str, actor: int, session: int, now: int) -> None:
        gone = settle(workspace.removal_plan(self.table("working"), root))
        self.store.write("working", self.table("working").join(gone.select("path"), "path", "left_anti"))
        self.emit(gone.select("path"), "remove", actor, session, now)

    def rename(self, source: str, target: str, actor: int, session: int, now: int) -> None:
        self.store.write("working", workspace.rename(self.table("working"), source, target))
        self.emit(self.spark.range(1).select(F.lit(source).alias("path")), "rename", actor, session, now, target)

    def emit(self, paths: DataFrame, kind: str, actor: int, session: int, now: int, detail: str | None = None) -> None:
        """Feed rows behind the newest one, in the order of paths."""
        from pyspark.sql.window import Window

        old = self.table("events")
        head = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        seq = F.row_number().over(Window.orderBy("path")) + F.lit(head)
        new = paths.select(
            seq.cast("long").alias("seq"), F.lit(actor).cast("long").alias("actor_id"), F.lit(session).cast("long").alias("session_id"), F.lit(kind).alias("kind"),
            "path", F.lit(detail).cast("string").alias("detail"), F.lit(now).cast("long").alias("ts"), F.lit(None).cast("string").alias("branch"),
        )
        self.store.write("events", old.unionByName(new))

    # versions

    def head(self, branch: str = "main") -> str | None:
        row = history.resolve_name(self.table("refs"), self.table("commits"), branch).first()
        return row.id if row else None

    def set_ref(self, name: str, value: str) -> None:
        old = self.table("refs").where(F.col("name") != name)
        self.store.write("refs", old.unionByName(self.spark.range(1).select(F.lit(name).alias("name"), F.lit(value).alias("value"))))

    def create_branch(self, name: str, at: str) -> None:
        if self.head(name):
            raise ValueError(f"branch {name} exists")
        self.set_ref(name, at)

    def commit(self, author: str, message: str, now: int, branch: str = "main", others: tuple[str, ...] = ()) -> str:
        """The new commit's hash; its tree is built from the working files."""
        built = settle(tree.build_tree(self.table("working").select("path", "mode", "kind", "hash"), EMPTY))
        top = built.where("path = ''").select("tree_hash").first()
        root = top.tree_hash if top else EMPTY
        self.append("trees", built.select("tree_hash", "name", "mode", "kind", "hash").distinct(), ["tree_hash", "name"])
        parents = [p for p in (self.head(branch), *others) if p]
        told = F.concat_ws("\n", F.lit(root), F.lit(",".join(parents)), F.lit(author), F.lit(message), F.lit(str(now)))
        listed = F.array(*map(F.lit, parents)) if parents else F.array().cast("array<string>")
        row = self.spark.range(1).select(
            F.sha2(told, 256).alias("hash"), F.lit(root).alias("tree"), listed.alias("parents"), F.lit(author).alias("author"), F.lit(message).alias("message"), F.lit(now).cast("long").alias("ts")
        )
        made = row.first().hash
        self.append("commits", row, ["hash"])
        self.set_ref(branch, made)
        return made

    def files_of(self, commit: str) -> DataFrame:
        """path, kind, hash of a commit's files."""
        (root,) = self.table("commits").where(F.col("hash") == commit).select("tree").first()
        return tree.flatten_tree(self.table("trees"), root)

    def status(self, branch: str = "main") -> DataFrame:
        """Working files against the branch's head."""
        now = self.table("working").select("path", F.coalesce("hash", F.lit(EMPTY)).alias("hash"))
        at = self.head(branch)
        return tree.diff(self.files_of(at) if at else now.limit(0), now)

    def diff(self, a: str, b: str) -> DataFrame:
        return tree.diff(self.files_of(a), self.files_of(b))

    def log(self, branch: str = "main") -> DataFrame:
        ids = self.spark.range(1).select(F.lit(self.head(branch)).alias("id"))
        own = history.first_parent_log(self.table("commits"), ids)
        return own.join(self.table("commits"), own.id == F.col("hash")).orderBy("depth").select("hash", "author", "message", "ts")

    def checkout(self, commit: str) -> None:
        """The working files become the commit's."""
        own = self.files_of(commit).withColumn("hash", F.when(F.col("hash") != EMPTY, F.col("hash")))
        sizes = self.table("manifests").select(F.col("mhash").alias("hash"), "size")
        rows = own.join(sizes, "hash", "left").select("path", F.lit(FILE_MODE).cast("long").alias("mode"), "kind", "hash", F.coalesce("size", F.lit(0)).alias("size"))
        self.store.write("working", rows)

    def merge(self, theirs: str, author: str, now: int, branch: str = "main") -> tuple[str, list[tuple[str, str]]]:
        """(outcome, conflicts) of merging another branch; up_to_date, fast_forward, merged or conflicts.

        With conflicts nothing is committed: files keep ours, and theirs stands beside them where bytes can't merge.
        """
        commits, o, t = self.table("commits"), self.head(branch), self.head(theirs)
        ids = lambda x: self.spark.range(1).select(F.lit(x).alias("id"))
        outcome = history.merge_outcome(commits, ids(o), ids(t))
        if outcome == "up_to_date":
            return outcome, []
        if outcome == "fast_forward":
            self.set_ref(branch, t)
            self.checkout(t)
            return outcome, []
        base = history.merge_base(commits, ids(o), ids(t)).first()
        root = lambda c: self.top_level(c)
        rows = settle(merge.merge_trees(root(base.id) if base else root(o).limit(0), root(o), root(t), self.table("trees")))
        conflicts = [(r.path, r.conflict) for r in rows.where("conflict IS NOT NULL").select(F.regexp_replace(F.concat_ws("/", "dir", "name"), "^//", "/").alias("path"), "conflict").orderBy("path").collect()]
        changed = rows.where("action = 'merge_file'").select(F.regexp_replace(F.concat_ws("/", "dir", "name"), "^//", "/").alias("path"), F.col("b.hash").alias("b"), F.col("o.hash").alias("o"), F.col("t.hash").alias("t"))
        bodies = {k: self.bodies(changed.select("path", F.col(k).alias("hash"))) for k in "bot"}
        both = changed.select("path")
        for k, name in (("b", "base"), ("o", "ours"), ("t", "theirs")):
            both = both.join(bodies[k].withColumnRenamed("data", name), "path", "left")
        made = settle(merge.merge_files(both))
        conflicts += [(r.path, "content") for r in made.where("conflict").orderBy("path").collect()]
        self.take(rows)
        beside = made.where("theirs IS NOT NULL").select(F.concat("path", F.lit(".theirs")).alias("path"), F.col("theirs").alias("data"))
        merged = made.select("path", "data").unionByName(beside)
        if not merged.isEmpty():
            self.write(merged, 0, 0, now)
        if conflicts:
            self.set_ref("MERGE_HEAD", t)
            return "conflicts", conflicts
        self.commit(author, f"merge {theirs}", now, branch, (t,))
        return "merged", []

    def top_level(self, commit: str) -> DataFrame:
        (root,) = self.table("commits").where(F.col("hash") == commit).select("tree").first()
        return self.table("trees").where(F.col("tree_hash") == root).select(F.lit("/").alias("dir"), "name", "mode", "kind", "hash")

    def bodies(self, wanted: DataFrame) -> DataFrame:
        """path, data of rows of path and manifest hash."""
        own = wanted.where("hash IS NOT NULL").join(self.table("manifests").select(F.col("mhash").alias("hash"), "size", "chunks"), "hash")
        return content.read_files(own.select("path", "size", "chunks"), self.chunks.all().select("hash", "len", "bytes"))

    def take(self, rows: DataFrame) -> None:
        """The working files become what a tree merge keeps; whole directories that one side has are entered."""
        path = F.regexp_replace(F.concat_ws("/", "dir", "name"), "^//", "/")
        kept = rows.where("action IN ('keep', 'merge_file')").select(path.alias("path"), F.col("entry.kind").alias("kind"), F.col("entry.hash").alias("hash"))
        flat = kept.where("kind <> 'dir'")
        level = kept.where("kind = 'dir'")
        while not level.isEmpty():
            below = self.table("trees").join(level.select(F.col("path").alias("_up"), F.col("hash").alias("tree_hash")), "tree_hash")
            level = settle(below.select(F.concat("_up", F.lit("/"), "name").alias("path"), "kind", "hash"))
            flat = flat.union(level.where("kind <> 'dir'"))
            level = level.where("kind = 'dir'")
        sizes = self.table("manifests").select(F.col("mhash").alias("hash"), "size")
        own = flat.withColumn("hash", F.when(F.col("hash") != EMPTY, F.col("hash"))).join(sizes, "hash", "left")
        self.store.write("working", own.select("path", F.lit(FILE_MODE).cast("long").alias("mode"), "kind", "hash", F.coalesce("size", F.lit(0)).alias("size")))

    # collection

    def collect_garbage(self, now: int, grace: int) -> DataFrame:
        """hash, size, state of every chunk; chunks that nothing reaches and that are old enough are what may go."""
        refs = self.table("refs").select(F.col("value").alias("id"))
        roots = history.gc_roots(refs, self.table("working").select(F.col("hash").alias("id")))
        trees = self.table("trees").where(F.col("hash") != EMPTY)
        edges = history.object_edges(self.table("commits"), trees, self.table("manifests")).where(F.col("dst") != EMPTY)
        marked = history.closure(roots, edges).select("id")
        own = self.chunks.all().select("hash", F.col("len").alias("size"), F.lit(0).cast("long").alias("mtime"))
        return history.sweep(own, marked, now, grace)
