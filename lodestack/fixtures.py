"""Projections of the driver's star-schema tables onto the workspace model. The SQL of plans/ states the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"signup": "mkdir", "purchase": "commit", "view": "write", "click": "rename", "error": "remove"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change feed: seq, actor_id, session_id, kind, path, detail, ts, branch."""
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for own, k in KINDS.items():
        kind = F.when(F.col("event_type") == own, F.lit(k)).otherwise(kind)
    k = F.regexp_extract("props", "([0-9]+)", 1)
    path = F.concat(F.lit("/u"), F.col("user_id") % 10, F.lit("/f"), k)
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("actor_id"),
        (F.col("user_id") % 7).alias("session_id"),
        kind.alias("kind"),
        F.when(kind == "commit", F.lit("/")).otherwise(path).alias("path"),
        F.when(kind == "rename", F.concat(path, F.lit("r"))).alias("detail"),
        F.unix_timestamp("ts").alias("ts"),
        F.when(F.col("user_id") % 3 == 0, F.lit("main")).otherwise(F.lit("dev")).alias("branch"),
    )


FEED_SQL = """feed AS (
  SELECT event_id AS seq, user_id AS actor_id, user_id % 7 AS session_id, kind,
         CASE WHEN kind = 'commit' THEN '/' ELSE p END AS path, CASE WHEN kind = 'rename' THEN p || 'r' END AS detail,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN user_id % 3 = 0 THEN 'main' ELSE 'dev' END AS branch
  FROM (SELECT *, '/u' || (user_id % 10) || '/f' || regexp_extract(props, '([0-9]+)', 1) AS p,
               CASE event_type WHEN 'signup' THEN 'mkdir' WHEN 'purchase' THEN 'commit' WHEN 'view' THEN 'write'
                               WHEN 'click' THEN 'rename' WHEN 'error' THEN 'remove' END AS kind FROM events))"""

EXTENSIONS = ("md", "txt", "bin", "HTML")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: ino, path, text, data (bytes), size, content_hash (null where empty)."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), ext)
    own = d.select(F.col("doc_id").alias("ino"), path.alias("path"), "text", "lang", data.alias("data"))
    return own.withColumn("size", F.octet_length("data").cast("long")).withColumn("content_hash", F.when(F.col("size") > 0, F.sha2("data", 256)))


FILES_SQL = """files AS (
  SELECT doc_id AS ino, '/' || source || '/' || doc_id || '.' || (['md', 'txt', 'bin', 'HTML'])[doc_id % 4 + 1] AS path, text, lang,
         encode(coalesce(text, '')) AS data, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
         CASE WHEN strlen(text) > 0 THEN sha256(text) END AS content_hash FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as attributed files: a turn is a run of bytes by its role's actor (1 human, 2 agent, 3 system)."""
    c = table(spark, sf_dir, "conversations")
    actor = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).cast("long")
    return c.select(
        F.concat(F.lit("/c/"), F.col("conv_id"), F.lit(".md")).alias("path"),
        "conv_id",
        F.col("turn").alias("ordinal"),
        actor.alias("actor"),
        (F.col("conv_id") % 3).alias("session"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("len"),
    )


TURNS_SQL = """turns AS (
  SELECT '/c/' || conv_id || '.md' AS path, conv_id, turn AS ordinal,
         CAST(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS BIGINT) AS actor, conv_id % 3 AS session,
         coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS len FROM conversations)"""


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as actors: id, kind, display_name, write_policy, auth_subject."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("human")).otherwise(F.lit("agent")).alias("kind"),
        F.col("c_name").alias("display_name"),
        (F.col("c_custkey") % 3).cast("int").alias("write_policy"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("sub:"), F.col("c_custkey"))).alias("auth_subject"),
    )


ACTORS_SQL = """actors AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'agent' END AS kind, c_name AS display_name,
         CAST(c_custkey % 3 AS INTEGER) AS write_policy, CASE WHEN c_custkey % 5 <> 0 THEN 'sub:' || c_custkey END AS auth_subject
  FROM customer)"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dentry, inode) of region / nation / customer / orders; the root is 1."""
    r, n, c, o = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))

    def level(df: DataFrame, parent, name, ino) -> DataFrame:
        return df.select(parent.cast("long").alias("parent_ino"), name.alias("name"), ino.cast("long").alias("ino"))

    dentry = (
        level(r, F.lit(1), F.col("r_name"), F.col("r_regionkey") + 10)
        .union(level(n, F.col("n_regionkey") + 10, F.col("n_name"), F.col("n_nationkey") + 100))
        .union(level(c, F.col("c_nationkey") + 100, F.col("c_name"), F.col("c_custkey") + 1_000))
        .union(level(o, F.col("o_custkey") + 1_000, F.concat(F.lit("o"), F.col("o_orderkey")), F.col("o_orderkey") + 1_000_000))
    )
    inode = dentry.select(
        "ino",
        F.when(F.col("ino") >= 1_000_000, F.lit("file")).otherwise(F.lit("dir")).alias("kind"),
        F.when(F.col("ino") >= 1_000_000, F.col("ino") % 977).otherwise(F.lit(0)).alias("size"),
    )
    return dentry, inode.union(spark.range(1).select(F.lit(1).cast("long"), F.lit("dir"), F.lit(0).cast("long")))


TREE_SQL = """dentry AS (
  SELECT CAST(1 AS BIGINT) AS parent_ino, r_name AS name, CAST(r_regionkey + 10 AS BIGINT) AS ino FROM region
  UNION ALL SELECT n_regionkey + 10, n_name, n_nationkey + 100 FROM nation
  UNION ALL SELECT c_nationkey + 100, c_name, c_custkey + 1000 FROM customer
  UNION ALL SELECT o_custkey + 1000, 'o' || o_orderkey, o_orderkey + 1000000 FROM orders),
inode AS (SELECT ino, CASE WHEN ino >= 1000000 THEN 'file' ELSE 'dir' END AS kind, CASE WHEN ino >= 1000000 THEN ino % 977 ELSE 0 END AS size FROM dentry
  UNION ALL SELECT 1, 'dir', 0)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, ours, theirs): path -> (mode, kind, hash) maps derived from orders; each side edits, adds and deletes."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/o/"), F.col("o_orderkey") % 97, F.lit("/"), F.col("o_orderkey"))
    own = o.select(F.col("o_orderkey").alias("k"), path.alias("path"), F.lit("file").alias("kind"), F.col("o_orderstatus").alias("v"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("path", "kind", F.sha2(F.concat("v", F.lit(tag)), 256).alias("hash"), "k")

    base = side(own.where("k % 10 <> 9"), "")

    def edited(edit: int, drop: int, add: int) -> DataFrame:
        kept = own.where((F.col("k") % 10 != 9) | (F.col("k") % 20 == add)).where(F.col("k") % 11 != drop)
        v = F.when(F.col("k") % 7 == edit, F.concat("v", F.lit(str(edit)))).otherwise(F.col("v"))
        return kept.select("path", "kind", F.sha2(v, 256).alias("hash"), "k")

    return base.drop("k"), edited(1, 2, 9).drop("k"), edited(2, 3, 19).drop("k")


SNAPSHOTS_SQL = """own AS (SELECT o_orderkey AS k, '/o/' || (o_orderkey % 97) || '/' || o_orderkey AS path, 'file' AS kind, o_orderstatus AS v FROM orders),
base AS (SELECT path, kind, sha256(v) AS hash FROM own WHERE k % 10 <> 9),
ours AS (SELECT path, kind, sha256(CASE WHEN k % 7 = 1 THEN v || '1' ELSE v END) AS hash FROM own WHERE (k % 10 <> 9 OR k % 20 = 9) AND k % 11 <> 2),
theirs AS (SELECT path, kind, sha256(CASE WHEN k % 7 = 2 THEN v || '2' ELSE v END) AS hash FROM own WHERE (k % 10 <> 9 OR k % 20 = 19) AND k % 11 <> 3)"""

#: Commits of one of the histories that orders are dealt to. Each begins at the first commit of the history with half
#: its number, so the whole graph is connected and its depth grows with the logarithm of the orders.
LANE = 16


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit graph over all orders: within a history j's first parent is j - 1 or j - 2, every fifth merges j // 2."""
    o = table(spark, sf_dir, "orders")
    i, lane, j = F.col("o_orderkey"), F.expr(f"o_orderkey div {LANE}"), F.col("o_orderkey") % LANE
    first = F.when((j == 0) & (lane > 0), F.expr(f"(o_orderkey div {2 * LANE}) * {LANE}")).when((j % 3 == 0) & (j > 0), i - 2).when(j > 0, i - 1)
    second = F.when((j % 5 == 0) & (j > 4), lane * LANE + F.expr(f"(o_orderkey % {LANE}) div 2"))
    parents = F.filter(F.array(first.cast("long"), second.cast("long")), lambda p: p.isNotNull())
    return o.select(commit_hash(i).alias("hash"), F.transform(parents, commit_hash).alias("parents"), i.alias("ts"))


def commit_hash(i):
    return F.sha2(F.concat(F.lit("c"), i.cast("string")), 256)


COMMITS_SQL = f"""numbered AS (SELECT o_orderkey AS i, list_filter([CASE WHEN o_orderkey % {LANE} = 0 THEN CASE WHEN o_orderkey >= {LANE} THEN o_orderkey // {2 * LANE} * {LANE} END WHEN o_orderkey % {LANE} % 3 = 0 THEN o_orderkey - 2 ELSE o_orderkey - 1 END,
    CASE WHEN o_orderkey % {LANE} % 5 = 0 AND o_orderkey % {LANE} > 4 THEN o_orderkey // {LANE} * {LANE} + o_orderkey % {LANE} // 2 END], lambda p: p IS NOT NULL) AS ps FROM orders),
commits AS (SELECT sha256('c' || i) AS hash, list_transform(ps, lambda p: sha256('c' || p)) AS parents, i AS ts FROM numbered)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, ours, theirs): path, mode, kind, hash of nested trees; each side edits, adds, deletes, changes modes and
    kinds in some directories and leaves others as they are."""
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderkey") % 97

    def side(edit: int, drop: int, add: int, dirs: int) -> DataFrame:
        """edit 0: the base."""
        touched = (d % 6).isin(dirs, 4, 5) if edit else F.lit(False)
        own = o.where((k % 10 != 9) | (touched & (k % 20 == add))).where(~(touched & (k % 11 == drop)))
        kind = F.when(touched & (k % 37 == edit), "file").when((k % 13 == 0) | (touched & (k % 17 == edit)), "symlink").otherwise("file")
        mode = F.when(touched & (k % 19 == edit), 493).otherwise(420).cast("long")
        value = F.when(touched & ((k % 7 == edit) | (k % 23 == 0)), F.concat("o_orderstatus", F.when(k % 46 == 0, F.lit("x")).otherwise(F.lit(str(edit))))).otherwise(F.col("o_orderstatus"))
        path = F.concat(F.lit("/o/"), d % 6, F.lit("/"), d, F.lit("/"), k)
        return own.select(path.alias("path"), mode.alias("mode"), kind.alias("kind"), F.sha2(value, 256).alias("hash"))

    return side(0, -1, -1, -1), side(1, 2, 9, 1), side(2, 3, 19, 2)


def version_sql(name: str, edit: int, drop: int, add: int, dirs: int) -> str:
    touched = f"(k % 97 % 6 IN ({dirs}, 4, 5))" if edit else "false"
    return f"""{name} AS (SELECT '/o/' || (k % 97 % 6) || '/' || (k % 97) || '/' || k AS path, CASE WHEN {touched} AND k % 19 = {edit} THEN 493 ELSE 420 END AS mode,
    CASE WHEN {touched} AND k % 37 = {edit} THEN 'file' WHEN k % 13 = 0 OR ({touched} AND k % 17 = {edit}) THEN 'symlink' ELSE 'file' END AS kind,
    sha256(CASE WHEN {touched} AND (k % 7 = {edit} OR k % 23 = 0) THEN v || CASE WHEN k % 46 = 0 THEN 'x' ELSE '{edit}' END ELSE v END) AS hash
    FROM ord WHERE (k % 10 <> 9 OR ({touched} AND k % 20 = {add})) AND NOT ({touched} AND k % 11 = {drop}))"""


VERSIONS_SQL = ",\n".join(["ord AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders)", version_sql("base", 0, -1, -1, -1), version_sql("ours", 1, 2, 9, 1), version_sql("theirs", 2, 3, 19, 2)])
