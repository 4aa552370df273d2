"""Named queries over the driver's tables: each is an operator of this engine, with the SQL that says the same.

Queries over fixtures of lodestack.fixtures; ``SQL`` is run by DuckDB on the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import fixtures as X
from lodestack.functions import expressions as E
from lodestack.operators import attribution, content, feed, history, merge, tree, workspace
from lodestack.plans.storage import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name, with its SQL where there is one."""

    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


# the feed ----------------------------------------------------------------------------------------------------------

OPS_SQL = f"""{X.FEED_SQL},
ops AS (SELECT seq, 0 AS sub, CASE kind WHEN 'write' THEN 'upsert' WHEN 'commit' THEN 'commit' WHEN 'remove' THEN 'delete' WHEN 'rename' THEN 'delete' ELSE 'other' END AS op,
               path, kind, ts, actor_id, branch FROM feed
        UNION ALL SELECT seq, 1, 'upsert', detail, kind, ts, actor_id, branch FROM feed WHERE kind = 'rename' AND coalesce(detail, '') <> '')"""


@query(f"WITH {X.FEED_SQL} SELECT seq, kind, path, detail, branch FROM feed WHERE seq > 500 AND branch = 'main' ORDER BY seq LIMIT 1000")
def feed_since_cursor(spark, sf_dir):
    return feed.since(X.feed(spark, sf_dir), 500, "main").select("seq", "kind", "path", "detail", "branch")


@query(f"WITH {X.FEED_SQL} SELECT coalesce(max(seq), 0) AS head FROM feed")
def feed_head(spark, sf_dir):
    return feed.head(X.feed(spark, sf_dir))


@query(f"WITH {OPS_SQL} SELECT seq, sub, op, path FROM ops")
def feed_dispatched(spark, sf_dir):
    return feed.dispatch(X.feed(spark, sf_dir)).select("seq", "sub", "op", "path")


@query(
    f"""WITH {OPS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC, sub DESC) AS l, row_number() OVER (PARTITION BY path ORDER BY seq, sub) AS f
    FROM ops WHERE op IN ('upsert', 'delete'))
    SELECT a.path, a.op, a.seq, b.seq AS first_seq, b.sub AS first_sub FROM c a JOIN c b ON a.path = b.path AND a.l = 1 AND b.f = 1"""
)
def feed_coalesced(spark, sf_dir):
    return feed.coalesced(X.feed(spark, sf_dir))


def with_content(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sink rows whose upserts name a document's text by its hash, and that content."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "text")
    count = docs.count()
    rows = feed.sink_rows(X.feed(spark, sf_dir)).withColumn("_d", F.when(F.col("kind") == "upsert", F.col("seq") % F.lit(count)))
    return rows.join(docs.select("_d", "sha256"), "_d", "left"), feed.distinct_content(docs.select("sha256", "size", "text"))


CURRENT_SQL = f"""WITH {OPS_SQL}, docs AS (SELECT doc_id, sha256(text) AS sha256, text FROM documents),
rows AS (SELECT o.seq, o.sub, o.actor_id, CASE op WHEN 'commit' THEN 'commit' ELSE op END AS kind, CASE op WHEN 'commit' THEN '/' ELSE path END AS path, branch, d.sha256
         FROM ops o LEFT JOIN docs d ON o.op = 'upsert' AND d.doc_id = o.seq % (SELECT count(*) FROM documents) WHERE op <> 'other'),
content AS (SELECT DISTINCT sha256, CAST(strlen(text) AS BIGINT) AS size, text FROM docs),
latest AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC, sub DESC) AS rn FROM rows)
SELECT path, seq, actor_id, branch, size, text FROM latest LEFT JOIN content USING (sha256) WHERE rn = 1 AND kind <> 'delete'"""


@query(CURRENT_SQL)
def feed_current_state(spark, sf_dir):
    rows, text = with_content(spark, sf_dir)
    return feed.current_state(rows, text, ["sub"])


@query(CURRENT_SQL + " AND kind <> 'commit'")
def feed_current_state_cleaned(spark, sf_dir):
    rows, text = with_content(spark, sf_dir)
    return feed.current_state(rows, text, ["sub"], cleaned=True)


PRESENCE_SQL = f"""{X.FEED_SQL}, {X.ACTORS_SQL}, now AS (SELECT max(ts) AS now FROM feed), beats AS (SELECT actor_id AS session_id, actor_id, path, ts AS last_seen FROM feed),
latest AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, path DESC, actor_id DESC) AS rn FROM beats),
present AS (SELECT session_id, actor_id, path, last_seen FROM latest WHERE rn = 1)"""


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.feed(spark, sf_dir).select(F.col("actor_id").alias("session_id"), "actor_id", "path", F.col("ts").alias("last_seen"))


def newest(spark: SparkSession, sf_dir: str) -> int:
    """The time that presence is asked for: an argument, never the clock."""
    return X.feed(spark, sf_dir).agg(F.max("ts")).first()[0]


@query(f"WITH {PRESENCE_SQL} SELECT p.session_id, p.actor_id, p.path, p.last_seen, a.kind, a.display_name FROM present p JOIN actors a ON a.id = p.actor_id WHERE last_seen >= (SELECT now FROM now) - 43200")
def presence_active(spark, sf_dir):
    rows = workspace.active(workspace.presence(beats(spark, sf_dir)), X.actors(spark, sf_dir), newest(spark, sf_dir), 43_200)
    return rows.select("session_id", "actor_id", "path", "last_seen", "kind", "display_name")


@query(f"WITH {PRESENCE_SQL} SELECT session_id, actor_id, path, last_seen FROM present WHERE last_seen >= (SELECT now FROM now) - 7200")
def presence_reaped(spark, sf_dir):
    return workspace.reaped(workspace.presence(beats(spark, sf_dir)), newest(spark, sf_dir), 7_200).select("session_id", "actor_id", "path", "last_seen")


@query(
    f"""WITH {X.FEED_SQL}, r AS (SELECT path, CAST(actor_id AS VARCHAR) AS owner, seq AS acquired_at, row_number() OVER (PARTITION BY path ORDER BY seq, CAST(actor_id AS VARCHAR)) AS rn FROM feed WHERE kind = 'write')
    SELECT path, owner, acquired_at FROM r WHERE rn = 1"""
)
def lock_winner(spark, sf_dir):
    own = X.feed(spark, sf_dir).where("kind = 'write'").select("path", F.col("actor_id").cast("string").alias("owner"), F.col("seq").alias("acquired_at"))
    return merge.lock_holders(own)


@query(
    f"""WITH {X.FEED_SQL}, w AS (SELECT path, seq, ts, session_id, actor_id, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn, min(ts) OVER (PARTITION BY path) AS since FROM feed WHERE kind = 'write')
    SELECT path, since, session_id, actor_id, sha256('v' || seq) AS content_hash FROM w WHERE rn = 1"""
)
def live_doc_since(spark, sf_dir):
    own = X.feed(spark, sf_dir).where("kind = 'write'")
    return workspace.live_documents(own.select("path", F.col("ts").alias("at"), "seq", "session_id", "actor_id", F.sha2(F.concat(F.lit("v"), "seq"), 256).alias("content_hash")))


@query(
    f"""WITH {X.FEED_SQL}, l AS (SELECT DISTINCT path FROM feed WHERE kind = 'write' AND seq % 2 = 0), c AS (SELECT DISTINCT path FROM feed WHERE kind = 'remove')
    SELECT l.path FROM l WHERE path IN (SELECT path FROM c)"""
)
def live_touched(spark, sf_dir):
    own = X.feed(spark, sf_dir)
    return tree.live_touched(own.where("kind = 'write' AND seq % 2 = 0").select("path").distinct(), own.where("kind = 'remove'"))


# content -----------------------------------------------------------------------------------------------------------


def hashed(passages: DataFrame) -> DataFrame:
    return passages.select("path", F.col("ordinal").cast("long").alias("ordinal"), "byte_start", "byte_end", "hash")


def fixed_sql(size: int, overlap: int, files: str = "files") -> str:
    step = size - min(overlap, size - 1)
    return f"""SELECT path, CAST(k AS BIGINT) AS ordinal, CAST(k * {step} AS BIGINT) AS byte_start, least(k * {step} + {size}, size) AS byte_end,
        sha256(data[k * {step} + 1 : least(k * {step} + {size}, size)]) AS hash
        FROM (SELECT path, data, size, unnest(range(0, greatest(0, CAST(ceil((size - {size}) / {step}) AS BIGINT)) + 1)) AS k FROM {files} WHERE size > 0)"""


@query(f"WITH {X.FILES_SQL} SELECT path, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS byte_start, size AS byte_end, sha256(text) AS hash FROM files WHERE size > 0")
def passages_whole(spark, sf_dir):
    return hashed(content.cut_passages(X.files(spark, sf_dir), "whole"))


@query(f"WITH {X.FILES_SQL} {fixed_sql(1024, 128)}")
def passages_fixed(spark, sf_dir):
    return hashed(content.cut_passages(X.files(spark, sf_dir), "fixed", 1_024, 128))


LINES_SQL = f"""{X.FILES_SQL}, l AS (SELECT path, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), 1) - 1 AS i FROM files WHERE size > 0),
lines AS (SELECT path, i, line, sum(strlen(line)) OVER (PARTITION BY path ORDER BY i) - strlen(line) AS a, max(i) OVER (PARTITION BY path) + 1 AS n FROM l)"""


@query(
    f"""WITH {LINES_SQL} SELECT path, CAST(k AS BIGINT) AS ordinal, CAST(min(a) AS BIGINT) AS byte_start, CAST(max(a + strlen(line)) AS BIGINT) AS byte_end, sha256(string_agg(line, '' ORDER BY i)) AS hash
    FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 9) / 8.0) AS BIGINT)), least(i // 8, greatest(0, CAST(ceil((n - 10) / 8.0) AS BIGINT))) + 1)) AS k FROM lines) GROUP BY path, k"""
)
def passages_lines(spark, sf_dir):
    return hashed(content.cut_passages(X.files(spark, sf_dir), "lines", 10, 2))


@query()
def passages_cdc(spark, sf_dir):
    return hashed(content.cut_passages(X.files(spark, sf_dir), "content_defined", 1_024))


@query(f"WITH {X.FILES_SQL}, p AS ({fixed_sql(256, 0)}) SELECT hash, count(*) AS n, min(path) AS first_path FROM p GROUP BY hash")
def passage_dedup(spark, sf_dir):
    own = content.cut_passages(X.files(spark, sf_dir), "fixed", 256).select("hash", "path")
    return own.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query(
    f"""WITH {X.FILES_SQL}, p AS ({fixed_sql(256, 0)}), b AS (SELECT hash, count(*) AS n, max(byte_end - byte_start) AS len FROM p GROUP BY hash)
    SELECT count(*) AS objects, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS total_objects, CAST(sum(n * len) AS BIGINT) AS total_bytes FROM b"""
)
def dedup_stats(spark, sf_dir):
    return content.dedup_stats(content.cut_passages(X.files(spark, sf_dir), "fixed", 256))


@query(f"WITH {X.FILES_SQL}, p AS ({fixed_sql(512, 0)}) SELECT DISTINCT hash FROM p WHERE hash NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL) AND hash NOT IN (SELECT hash FROM p WHERE path LIKE '/src0/%')")
def incremental_hashes(spark, sf_dir):
    own = content.cut_passages(X.files(spark, sf_dir), "fixed", 512)
    done = X.table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("hash")).union(own.where("path LIKE '/src0/%'").select("hash"))
    return content.new_passages(own, done)


@query(f"WITH {X.FILES_SQL}, p AS ({fixed_sql(512, 0)}), q AS ({fixed_sql(512, 0, '(SELECT path, data[1 : size - 1] AS data, size - 1 AS size FROM files)')}) SELECT DISTINCT hash FROM p WHERE hash IN (SELECT hash FROM q)")
def passage_overlap(spark, sf_dir):
    files = X.files(spark, sf_dir)
    cut = files.withColumn("data", F.substring(F.col("data"), F.lit(1), F.greatest(F.col("size") - 1, F.lit(0)).cast("int")))
    return content.cut_passages(files, "fixed", 512).select("hash").intersect(content.cut_passages(cut, "fixed", 512).select("hash"))


@query(
    f"WITH {X.FILES_SQL} SELECT path, size FROM files WHERE (path LIKE '/src0/%' OR path = '/src0') AND regexp_matches(path, '\\.[^./]*$') AND lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('md', 'html') AND size > 0 AND size <= 4096 ORDER BY path"
)
def corpus_filtered(spark, sf_dir):
    own = X.files(spark, sf_dir)
    return own.where(E.under(F.col("path"), "/src0/") & E.has_extension(F.col("path"), [".MD", "html"]) & E.within_size(F.col("size"), 4_096)).select("path", "size").orderBy("path")


@query(
    f"""WITH {X.FILES_SQL}, p AS ({fixed_sql(700, 0)}) SELECT path, sha256(string_agg(hash || ':' || (byte_end - byte_start), chr(10) ORDER BY ordinal)) AS mhash,
    CAST(sum(byte_end - byte_start) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n_chunks FROM p GROUP BY path"""
)
def manifest_build(spark, sf_dir):
    own = content.check_manifests(content.build_manifests(content.cut_passages(X.files(spark, sf_dir), "fixed", 700)))
    return own.select("path", "mhash", "size", F.size("chunks").cast("long").alias("n_chunks"))


def requests(files: DataFrame) -> DataFrame:
    """A byte range of every file: by Python's slices, some from the end."""
    start = F.when(F.col("ino") % 3 == 0, F.lit(-900)).otherwise(F.col("ino") % 500)
    end = F.when(F.col("ino") % 4 == 0, F.lit(None)).otherwise(F.lit(1_500))
    a, b = E.slice_bounds(start.cast("long"), end.cast("long"), F.col("size"))
    return files.select("path", F.lit(0).alias("request"), a.alias("start"), b.alias("end")).where("start < end")


REQUEST_SQL = f"""{X.FILES_SQL}, rq AS (SELECT path, data, size, CASE WHEN ino % 3 = 0 THEN greatest(size - 900, 0) ELSE least(ino % 500, size) END AS a, CASE WHEN ino % 4 = 0 THEN size ELSE least(1500, size) END AS b FROM files),
requests AS (SELECT path, data, a, b FROM rq WHERE a < b)"""


@query(
    f"""WITH {REQUEST_SQL}, p AS ({fixed_sql(700, 0)}) SELECT p.path, ordinal, hash, CAST(greatest(a - byte_start, 0) AS BIGINT) AS chunk_from, CAST(least(b - byte_start, byte_end - byte_start) AS BIGINT) AS chunk_to
    FROM p JOIN requests r ON r.path = p.path AND byte_start < b AND byte_end > a"""
)
def range_read_plan(spark, sf_dir):
    files = X.files(spark, sf_dir)
    extents = content.extents(content.build_manifests(content.cut_passages(files, "fixed", 700)))
    own = content.range_plan(extents, requests(files))
    return own.select("path", F.col("ordinal").cast("long").alias("ordinal"), "hash", "chunk_from", "chunk_to")


@query(f"WITH {REQUEST_SQL} SELECT path, sha256(data[a + 1 : b]) AS hash, CAST(b - a AS BIGINT) AS n FROM requests")
def range_read(spark, sf_dir):
    files = X.files(spark, sf_dir)
    cut = content.cut_passages(files, "fixed", 700)
    got = content.read_ranges(content.range_plan(content.extents(content.build_manifests(cut)), requests(files)), content.distinct_chunks(cut))
    return got.select("path", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("n"))


@query(f"WITH {X.FILES_SQL} SELECT path, sha256(text) AS hash FROM files WHERE size > 0")
def read_whole(spark, sf_dir):
    cut = content.cut_passages(X.files(spark, sf_dir), "content_defined", 2_048)
    return content.read_files(content.build_manifests(cut), content.distinct_chunks(cut)).select("path", F.sha2("data", 256).alias("hash"))


@query(f"WITH {X.FILES_SQL} SELECT sha256(text) AS stored, upper(sha256(text)) AS hash FROM files WHERE size > 0 AND ino % 10 = 3")
def integrity_check(spark, sf_dir):
    own = X.files(spark, sf_dir).where("size > 0")
    broken = F.when(F.col("ino") % 10 == 3, F.upper("content_hash")).otherwise(F.col("content_hash"))
    bad = content.integrity_failures(own.select(broken.alias("hash"), F.col("size").alias("len"), F.col("data").alias("bytes")))
    return bad.select(F.sha2("bytes", 256).alias("stored"), "hash")


@query(f"WITH {X.FILES_SQL}, p AS ({fixed_sql(4096, 0)}) SELECT hash, CAST(max(byte_end - byte_start) AS BIGINT) AS len FROM p WHERE hash NOT IN (SELECT content_hash FROM files WHERE content_hash IS NOT NULL AND ino % 2 = 0) GROUP BY hash")
def write_new_chunks(spark, sf_dir):
    files = X.files(spark, sf_dir)
    stored = files.where("ino % 2 = 0").select(F.col("content_hash").alias("hash")).where("hash IS NOT NULL")
    return content.write_new(content.cut_passages(files, "fixed", 4_096), stored).select("hash", "len")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.files(spark, sf_dir).where("size > 0").groupBy(F.col("content_hash").alias("hash")).agg(F.min("ino").alias("i"), F.min("size").alias("len"))
    return own.select(F.concat(F.lit("pack"), F.col("i") % 37).alias("pack"), "hash", "len", "i")


PACK_SQL = f"""{X.FILES_SQL}, m AS (SELECT 'pack' || (i % 37) AS pack, hash, len, i FROM (SELECT content_hash AS hash, min(ino) AS i, min(size) AS len FROM files WHERE size > 0 GROUP BY 1)),
live AS (SELECT hash FROM m WHERE (i % 37) % 3 = 0 OR ((i % 37) % 3 = 1 AND i % 2 = 0)),
packs AS (SELECT pack, count(*) AS total, count(*) FILTER (hash IN (SELECT hash FROM live)) AS live, CAST(coalesce(sum(len) FILTER (hash IN (SELECT hash FROM live)), 0) AS BIGINT) AS live_bytes FROM m GROUP BY pack),
states AS (SELECT *, CASE WHEN live = 0 THEN 'dead' WHEN live < total THEN 'partial' ELSE 'full' END AS state FROM packs)"""
LIVE = "(i % 37) % 3 = 0 OR ((i % 37) % 3 = 1 AND i % 2 = 0)"


@query(f"WITH {PACK_SQL} SELECT pack, total, live, live_bytes, state FROM states")
def pack_liveness(spark, sf_dir):
    own = members(spark, sf_dir)
    return content.pack_liveness(own, own.where(LIVE))


@query(f"WITH {PACK_SQL} SELECT m.pack, m.hash, m.len FROM m JOIN states s USING (pack) WHERE s.state = 'partial' AND m.hash IN (SELECT hash FROM live)")
def repack_plan(spark, sf_dir):
    own = members(spark, sf_dir)
    return content.repack_plan(own, own.where(LIVE)).select("pack", "hash", "len")


@query()
def pack_assignment(spark, sf_dir):
    return content.assign_packs(content.distinct_chunks(content.cut_passages(X.files(spark, sf_dir), "fixed", 2_048)), 1 << 16, 8)


def plain_text(path: str, data: bytes, mime: str | None) -> str | None:
    """A small converter: the text of an HTML page, without scripts, styles and tags."""
    import html
    import re

    text = data.decode("utf-8", "replace")
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", text)
    text = html.unescape(re.sub(r"(?s)<[^>]*>", "\n", text))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x) or None


@query()
def converted_pages(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("data"))
    return hashed(content.cut_passages(content.convert(pages, plain_text), "fixed", 1_024))


@query(
    f"""WITH {X.FILES_SQL} SELECT path, sha256(CASE WHEN size >= 700 THEN data[1:700] || encode('NEW') || data[704:size] ELSE data || unhex(repeat('00', CAST(700 - size AS INTEGER))) || encode('NEW') END) AS spliced,
    sha256(CASE WHEN size >= 900 THEN data[1:900] ELSE data || unhex(repeat('00', CAST(900 - size AS INTEGER))) END) AS cut FROM files"""
)
def byte_splice(spark, sf_dir):
    new = F.lit("NEW").cast("binary")
    spliced, cut = E.splice(F.col("data"), F.lit(700), new), E.truncated(F.col("data"), F.lit(900))
    return X.files(spark, sf_dir).select("path", F.sha2(spliced, 256).alias("spliced"), F.sha2(cut, 256).alias("cut"))


RANGE_HEADER = "CASE ino % 6 WHEN 0 THEN 'bytes=0-99' WHEN 1 THEN 'bytes=500-' WHEN 2 THEN 'bytes=-200' WHEN 3 THEN 'bytes=0-1,5-9' WHEN 4 THEN 'bytes=9000-9999' ELSE 'bytes=-0' END"


@query(
    f"""WITH {X.FILES_SQL} SELECT path, CASE ino % 6 WHEN 3 THEN 'full' WHEN 5 THEN 'unsatisfiable' WHEN 2 THEN CASE WHEN size = 0 THEN 'unsatisfiable' ELSE 'partial' END
      WHEN 0 THEN CASE WHEN size = 0 THEN 'unsatisfiable' ELSE 'partial' END WHEN 1 THEN CASE WHEN size <= 500 THEN 'unsatisfiable' ELSE 'partial' END ELSE CASE WHEN size <= 9000 THEN 'unsatisfiable' ELSE 'partial' END END AS status,
    CAST(CASE ino % 6 WHEN 3 THEN 0 WHEN 0 THEN CASE WHEN size > 0 THEN 0 END WHEN 1 THEN CASE WHEN size > 500 THEN 500 END WHEN 2 THEN CASE WHEN size > 0 THEN greatest(size - 200, 0) END WHEN 4 THEN CASE WHEN size > 9000 THEN 9000 END END AS BIGINT) AS start,
    CAST(CASE ino % 6 WHEN 3 THEN size WHEN 0 THEN CASE WHEN size > 0 THEN least(100, size) END WHEN 1 THEN CASE WHEN size > 500 THEN size END WHEN 2 THEN CASE WHEN size > 0 THEN size END WHEN 4 THEN CASE WHEN size > 9000 THEN least(10000, size) END END AS BIGINT) AS "end" FROM files"""
)
def http_range(spark, sf_dir):
    own = X.files(spark, sf_dir)
    return own.select("path", E.http_range(F.expr(RANGE_HEADER), F.col("size")).alias("r")).select("path", "r.status", "r.start", "r.end")


@query(
    f"""WITH {X.FILES_SQL} SELECT path, sha1(encode('blob ' || size) || unhex('00') || data) AS oid, CASE WHEN size >= 2000 THEN sha256('version https://git-lfs.github.com/spec/v1' || chr(10) || 'oid sha256:' || sha256(text) || chr(10) || 'size ' || size || chr(10))
    ELSE sha256(coalesce(text, '')) END AS exported FROM files"""
)
def git_export(spark, sf_dir):
    return X.files(spark, sf_dir).select("path", E.git_oid("blob", F.col("data")).alias("oid"), F.sha2(E.export_body(F.col("data"), 2_000), 256).alias("exported"))


# attribution -------------------------------------------------------------------------------------------------------

RUNS_SQL = f"""{X.TURNS_SQL}, filled AS (SELECT *, lag(actor) OVER w IS NOT DISTINCT FROM actor AND lag(session) OVER w IS NOT DISTINCT FROM session AS same FROM turns WHERE len > 0 WINDOW w AS (PARTITION BY path ORDER BY ordinal)),
numbered AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ordinal) - 1 AS run FROM filled)"""


@query(f"WITH {RUNS_SQL} SELECT path, CAST(run AS BIGINT) AS run, any_value(actor) AS actor, any_value(session) AS session, CAST(sum(len) AS BIGINT) AS len FROM numbered GROUP BY path, run")
def blame_runs(spark, sf_dir):
    return attribution.coalesce_runs(X.turns(spark, sf_dir)).select("path", F.col("run").cast("long").alias("run"), "actor", "session", "len")


SPANS_SQL = f"""{X.TURNS_SQL}, f AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS feeds FROM turns WHERE len > 0),
s AS (SELECT *, sum(len) OVER w - len AS b0, sum(feeds) OVER w - feeds AS l0 FROM f WINDOW w AS (PARTITION BY path ORDER BY ordinal)),
spans AS (SELECT path, ordinal, actor, session, CAST(b0 AS BIGINT) AS byte_start, CAST(b0 + len AS BIGINT) AS byte_end, CAST(l0 + 1 AS BIGINT) AS line_start,
          CAST(l0 + feeds + 1 - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_end FROM s)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = attribution.blame_spans(X.turns(spark, sf_dir))
    return own.select("path", "ordinal", "actor", "session", *[F.col(c).cast("long").alias(c) for c in ("byte_start", "byte_end", "line_start", "line_end")])


@query(f"WITH {SPANS_SQL} SELECT * FROM spans")
def blame_lines(spark, sf_dir):
    return spans(spark, sf_dir)


@query(f"WITH {SPANS_SQL}, {X.ACTORS_SQL} SELECT s.path, s.ordinal, s.actor, a.kind AS actor_kind, a.display_name FROM spans s JOIN actors a ON a.id = s.actor")
def blame_with_actors(spark, sf_dir):
    return attribution.with_actors(spans(spark, sf_dir), X.actors(spark, sf_dir)).select("path", "ordinal", "actor", "actor_kind", "display_name")


@query(
    f"""WITH {SPANS_SQL}, whole AS (SELECT path, CAST(sum(len) AS BIGINT) AS n FROM turns GROUP BY path), p AS (SELECT path, k * 512 AS p0, least(k * 512 + 512, n) AS p1 FROM (SELECT path, n, unnest(range(0, CAST(ceil(n / 512.0) AS BIGINT))) AS k FROM whole))
    SELECT s.path, CAST(p0 AS BIGINT) AS passage_start, actor, session, CAST(greatest(byte_start, p0) AS BIGINT) AS byte_start, CAST(least(byte_end, p1) AS BIGINT) AS byte_end, line_start, line_end
    FROM p JOIN spans s ON s.path = p.path AND byte_start < p1 AND byte_end > p0"""
)
def blame_clip(spark, sf_dir):
    whole = X.turns(spark, sf_dir).groupBy("path").agg(F.sum("len").alias("n"))
    starts = content.windows(F.col("n"), 512, 0)
    p = whole.select("path", "n", F.explode(starts).alias("byte_start")).select("path", "byte_start", F.least(F.col("byte_start") + 512, F.col("n")).alias("byte_end"))
    return attribution.clip(spans(spark, sf_dir), p).select("path", "passage_start", "actor", "session", "byte_start", "byte_end", "line_start", "line_end")


@query(f"WITH {X.TURNS_SQL}, f AS (SELECT path, actor, min(ordinal) AS seen FROM turns WHERE len > 0 GROUP BY path, actor) SELECT path, string_agg(CAST(actor AS VARCHAR), ',' ORDER BY seen, actor) AS authors FROM f GROUP BY path")
def authors_first_seen(spark, sf_dir):
    own = attribution.authors_first_seen(X.turns(spark, sf_dir))
    return own.select("path", F.array_join(F.transform("authors", lambda a: a.cast("string")), ",").alias("authors"))


@query(
    f"""WITH {X.TURNS_SQL}, c AS (SELECT path, ordinal, actor, session, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) AS part, generate_subscripts(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), 1) AS k FROM turns WHERE len > 0),
    n AS (SELECT *, coalesce(sum(CASE WHEN ends_with(part, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ordinal, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM c),
    l AS (SELECT path, line, bool_and(actor = 2 AND session = 1) AS gone, string_agg(part, '' ORDER BY ordinal, k) AS body FROM n GROUP BY path, line)
    SELECT path, coalesce(string_agg(body, '' ORDER BY line) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS dropped FROM l GROUP BY path HAVING count(*) FILTER (gone) > 0"""
)
def revert_session(spark, sf_dir):
    return attribution.revert_session(X.turns(spark, sf_dir), 2, 1)


@query(f"WITH {X.FEED_SQL} SELECT seq AS id, actor_id, session_id, path, kind AS op FROM feed WHERE kind IN ('write', 'remove', 'rename', 'mkdir') AND actor_id = 8 AND session_id = 1 ORDER BY id")
def op_log(spark, sf_dir):
    ops = X.feed(spark, sf_dir).where("kind IN ('write', 'remove', 'rename', 'mkdir')").select(F.col("seq").alias("id"), "actor_id", "session_id", "path", F.col("kind").alias("op"))
    return attribution.op_log(ops, 8, 1)


@query(
    f"""WITH {X.TURNS_SQL}, {X.ACTORS_SQL}, blobs AS (SELECT sha256(path) AS content_hash, conv_id, string_agg((actor + conv_id % 4) || ',' || session || ',' || len, ';' ORDER BY ordinal) || CASE WHEN conv_id % 11 = 0 THEN ';x,1' ELSE '' END AS runs, any_value(conv_id % 4) AS o FROM turns GROUP BY path, conv_id),
    mapped AS (SELECT t.path, t.conv_id, bool_and(a.auth_subject IS NOT NULL) AS fine, string_agg((a.id + 5000) || ',' || session || ',' || len, ';' ORDER BY ordinal) AS runs FROM turns t LEFT JOIN actors a ON a.id = t.actor + t.conv_id % 4 GROUP BY t.path, t.conv_id)
    SELECT sha256(path) AS content_hash, runs FROM mapped WHERE fine AND conv_id % 11 <> 0 AND conv_id % 13 <> 0"""
)
def carry_blame(spark, sf_dir):
    t = X.turns(spark, sf_dir)
    part = F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(",", F.col("actor") + F.col("conv_id") % 4, "session", "len").alias("s"))))
    by = t.groupBy("path", "conv_id").agg(F.array_join(F.transform(part, lambda x: x["s"]), ";").alias("runs"))
    blame = by.select(F.sha2("path", 256).alias("content_hash"), "conv_id", F.when(F.col("conv_id") % 11 == 0, F.concat("runs", F.lit(";x,1"))).otherwise(F.col("runs")).alias("runs"))
    source = X.actors(spark, sf_dir)
    target = source.where("auth_subject IS NOT NULL").select((F.col("id") + 5_000).alias("id"), "auth_subject")
    mapping = attribution.identity_map(source.withColumn("display_name", F.lit("none")), target, "client")
    return attribution.carry_blame(blame, mapping, blame.where("conv_id % 13 = 0").select("content_hash"))


@query()
def attributed_history(spark, sf_dir):
    from pyspark.sql.window import Window

    t = X.turns(spark, sf_dir)
    upto = F.collect_list("text").over(Window.partitionBy("path").orderBy("ordinal"))
    revisions = t.select("path", F.col("ordinal").alias("rev"), "actor", "session", F.encode(F.array_join(upto, "\n"), "UTF-8").alias("data"))
    own = attribution.attributed_history(revisions)
    return own.select("path", F.octet_length("data").cast("long").alias("size"), E.encode_runs(F.col("runs")).alias("runs"))


@query()
def inserted_text(spark, sf_dir):
    own = X.turns(spark, sf_dir)
    new = F.concat(F.substring("text", 1, 10), F.lit("<\U0001f600>"), F.expr("substring(text, 15)"))
    return attribution.insertions(own.select(F.concat_ws("#", "path", "ordinal").alias("path"), F.col("text").alias("old"), new.alias("new")))


@query(
    f"""WITH {X.FEED_SQL}, {X.FILES_SQL}, p AS ({fixed_sql(512, 0)}), b AS (SELECT hash, count(*) AS n, max(byte_end - byte_start) AS len FROM p GROUP BY hash),
    o AS (SELECT count(*) FILTER (kind = 'write') AS writes, count(*) FILTER (kind = 'remove') AS removes, count(*) FILTER (kind = 'rename') AS renames FROM feed)
    SELECT o.*, (SELECT count(*) FROM b) AS chunks_put, CAST((SELECT sum(n - 1) FROM b) AS BIGINT) AS chunks_deduped, CAST((SELECT sum(n * len) FROM b) AS BIGINT) AS bytes FROM o"""
)
def service_counters(spark, sf_dir):
    return attribution.service_counters(X.feed(spark, sf_dir).withColumnRenamed("kind", "op"), content.cut_passages(X.files(spark, sf_dir), "fixed", 512))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS actor, c_custkey // 3 AS controller FROM customer WHERE c_custkey % 4 <> 0),
    r AS (SELECT actor, controller, 1 AS distance FROM e UNION ALL SELECT r.actor, e.controller, distance + 1 FROM r JOIN e ON e.actor = r.controller WHERE distance < 8)
    SELECT actor, controller, min(distance) AS distance FROM r GROUP BY actor, controller"""
)
def controller_chains(spark, sf_dir):
    own = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.floor(F.col("c_custkey") / 3)).alias("controller_actor_id"))
    return attribution.controller_chains(own)


# trees -------------------------------------------------------------------------------------------------------------

PATHS_SQL = f"""RECURSIVE {X.TREE_SQL}, p AS (SELECT d.ino, i.kind, i.size, '/' || d.name AS path, 1 AS depth FROM dentry d JOIN inode i USING (ino) WHERE parent_ino = 1
  UNION ALL SELECT d.ino, i.kind, i.size, p.path || '/' || d.name, p.depth + 1 FROM p JOIN dentry d ON d.parent_ino = p.ino JOIN inode i ON i.ino = d.ino)"""


@query(f"WITH {PATHS_SQL} SELECT ino, kind, CAST(size AS BIGINT) AS size, path, depth FROM p")
def tree_paths(spark, sf_dir):
    return tree.tree_paths(*X.tree(spark, sf_dir)).select("ino", "kind", F.col("size").cast("long").alias("size"), "path", "depth")


@query(f"WITH {X.TREE_SQL} SELECT name, ino, kind, CAST(size AS BIGINT) AS size FROM dentry JOIN inode USING (ino) WHERE parent_ino = 12 ORDER BY name")
def list_dir(spark, sf_dir):
    return tree.list_dir(*X.tree(spark, sf_dir), 12).withColumn("size", F.col("size").cast("long"))


@query(f"WITH {X.TREE_SQL} SELECT name, ino, kind, CAST(size AS BIGINT) AS size FROM dentry JOIN inode USING (ino) WHERE parent_ino = 103 AND name > 'Customer#000000020' ORDER BY name LIMIT 10")
def list_dir_page(spark, sf_dir):
    return tree.list_dir_page(*X.tree(spark, sf_dir), 103, "Customer#000000020", 10).withColumn("size", F.col("size").cast("long"))


@query(f"WITH {X.TREE_SQL}, g AS (SELECT name FROM dentry JOIN inode USING (ino) WHERE parent_ino = 103 AND name > 'Customer#000000020' ORDER BY name LIMIT 10) SELECT max(name) AS next_after, count(*) < 10 AS \"end\" FROM g")
def list_dir_page_state(spark, sf_dir):
    return tree.page_state(tree.list_dir_page(*X.tree(spark, sf_dir), 103, "Customer#000000020", 10), 10)


@query(f"WITH {X.TREE_SQL} SELECT parent_ino, count(*) AS children FROM dentry GROUP BY parent_ino")
def child_count(spark, sf_dir):
    return tree.child_count(X.tree(spark, sf_dir)[0])


@query(f"WITH {X.TREE_SQL} SELECT ino, kind, CAST(size AS BIGINT) AS size FROM inode WHERE ino IN (SELECT o_orderkey * 3 + 1000000 FROM orders)")
def get_inodes(spark, sf_dir):
    ids = X.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3 + 1_000_000).alias("ino"))
    return tree.get_inodes(X.tree(spark, sf_dir)[1], ids).withColumn("size", F.col("size").cast("long"))


@query(f"WITH {X.SNAPSHOTS_SQL} SELECT path, CASE WHEN b.hash IS NULL THEN 'A' WHEN o.hash IS NULL THEN 'D' ELSE 'M' END AS status FROM base b FULL JOIN ours o USING (path) WHERE b.hash IS DISTINCT FROM o.hash ORDER BY path")
def snapshot_diff(spark, sf_dir):
    base, ours, _ = X.snapshots(spark, sf_dir)
    return tree.diff(base, ours)


@query(f"WITH {X.SNAPSHOTS_SQL}, d AS (SELECT CASE WHEN o.hash IS NULL THEN 'A' WHEN t.hash IS NULL THEN 'D' ELSE 'M' END AS status FROM ours o FULL JOIN theirs t USING (path) WHERE o.hash IS DISTINCT FROM t.hash) SELECT status, count(*) AS n FROM d GROUP BY status")
def snapshot_status(spark, sf_dir):
    _, ours, theirs = X.snapshots(spark, sf_dir)
    return tree.diff(ours, theirs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


MERGE_SQL = f"""WITH {X.SNAPSHOTS_SQL}, names AS (SELECT path FROM ours UNION SELECT path FROM theirs)
SELECT path, CASE WHEN o.hash IS NULL OR t.hash IS NULL THEN CASE WHEN b.hash IS NULL THEN 'keep' WHEN b.hash = coalesce(o.hash, t.hash) THEN 'drop' ELSE 'keep' END
    WHEN o.hash = t.hash OR b.hash IS NOT DISTINCT FROM o.hash OR b.hash IS NOT DISTINCT FROM t.hash THEN 'keep' ELSE 'merge_file' END AS action,
  CASE WHEN o.hash IS NULL OR t.hash IS NULL THEN coalesce(o.hash, t.hash) WHEN o.hash = t.hash OR b.hash IS NOT DISTINCT FROM t.hash THEN o.hash WHEN b.hash IS NOT DISTINCT FROM o.hash THEN t.hash ELSE o.hash END AS hash,
  CASE WHEN t.hash IS NULL AND b.hash IS NOT NULL AND b.hash <> o.hash THEN 'modify/delete' WHEN o.hash IS NULL AND b.hash IS NOT NULL AND b.hash <> t.hash THEN 'delete/modify' END AS conflict
FROM names LEFT JOIN base b USING (path) LEFT JOIN ours o USING (path) LEFT JOIN theirs t USING (path)"""


@query(MERGE_SQL)
def three_way_merge(spark, sf_dir):
    def flat(df: DataFrame) -> DataFrame:
        return df.select(E.parent_path(F.col("path")).alias("dir"), E.base_name(F.col("path")).alias("name"), F.lit(0o644).alias("mode"), "kind", "hash")

    own = merge.merge_level(*map(flat, X.snapshots(spark, sf_dir)))
    return own.select(F.concat_ws("/", "dir", "name").alias("path"), "action", "entry.hash", "conflict")


@query()
def text_merge(spark, sf_dir):
    own = X.files(spark, sf_dir).where("size > 0")
    lines = E.lines(F.col("text"))
    ours = F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, F.upper(x)).otherwise(x)), "")
    theirs = F.concat("text", F.lit("\nadded"))
    done = merge.merge_files(own.select("path", "data", F.encode(ours, "UTF-8").alias("ours"), F.encode(theirs, "UTF-8").alias("theirs")).withColumnRenamed("data", "base"))
    return done.select("path", F.sha2("data", 256).alias("hash"), "conflict")


def built_sql(name: str, levels: int) -> str:
    """Trees of paths of so many directories, from the deepest up: {name}0 is the root's entries."""
    out = [f"{name}{levels} AS (SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, regexp_extract(path, '([^/]+)$', 1) AS name, mode, kind, hash FROM {name})"]
    for k in range(levels - 1, -1, -1):
        out.append(f"{name}_t{k + 1} AS (SELECT dir, sha256(string_agg(mode || ' ' || kind || ' ' || hash || ' ' || name, chr(10) ORDER BY name)) AS tree_hash FROM {name}{k + 1} GROUP BY dir)")
        out.append(f"{name}{k} AS (SELECT regexp_extract(dir, '^(.*)/[^/]+$', 1) AS dir, regexp_extract(dir, '([^/]+)$', 1) AS name, 16384 AS mode, 'dir' AS kind, tree_hash AS hash FROM {name}_t{k + 1})")
    return ",\n".join([*out, f"{name}_t0 AS (SELECT dir, sha256(string_agg(mode || ' ' || kind || ' ' || hash || ' ' || name, chr(10) ORDER BY name)) AS tree_hash FROM {name}0 GROUP BY dir)"])


@query(
    f"WITH {X.VERSIONS_SQL}, {built_sql('base', 3)} "
    + " UNION ALL ".join(f"SELECT tree_hash, dir AS path, name, CAST(mode AS BIGINT) AS mode, kind, hash FROM base{k} JOIN base_t{k} USING (dir)" for k in range(4))
)
def tree_build(spark, sf_dir):
    return tree.build_tree(X.versions(spark, sf_dir)[0], "0" * 64)


def merged_sql(levels: int) -> str:
    """Level by level: names of the directories that the level above enters, decided by the table of tree merges."""
    out = []
    for k in range(levels + 1):
        entered = "SELECT '' AS dir" if k == 0 else f"SELECT dir || '/' || name AS dir FROM merged{k - 1} WHERE action = 'recurse'"
        sides = {x: f"(SELECT dir, name, {{'mode': mode, 'kind': kind, 'hash': hash}} AS {x[0]} FROM {x}{k} WHERE dir IN (SELECT dir FROM enter{k}))" for x in ("base", "ours", "theirs")}
        out.append(f"enter{k} AS ({entered})")
        out.append(f"names{k} AS (SELECT dir, name FROM {sides['ours']} UNION SELECT dir, name FROM {sides['theirs']})")
        changed = "o IS NOT NULL AND t IS NOT NULL AND o <> t AND b IS DISTINCT FROM o AND b IS DISTINCT FROM t"
        out.append(
            f"""merged{k} AS (SELECT dir, name, CASE WHEN o IS NULL OR t IS NULL THEN CASE WHEN b IS NOT NULL AND b = coalesce(o, t) THEN 'drop' ELSE 'keep' END
              WHEN NOT ({changed}) THEN 'keep' WHEN o.kind = 'dir' AND t.kind = 'dir' THEN 'recurse' WHEN o.kind = 'file' AND t.kind = 'file' THEN 'merge_file' ELSE 'keep' END AS action,
            CASE WHEN o IS NULL OR t IS NULL THEN coalesce(o, t) WHEN o = t OR b IS NOT DISTINCT FROM t THEN o WHEN b IS NOT DISTINCT FROM o THEN t ELSE o END AS entry,
            CASE WHEN o IS NOT NULL AND t IS NULL AND b IS NOT NULL AND b <> o THEN 'modify/delete' WHEN o IS NULL AND t IS NOT NULL AND b IS NOT NULL AND b <> t THEN 'delete/modify'
              WHEN {changed} AND o.kind <> t.kind THEN 'type' WHEN {changed} AND o.kind = 'symlink' THEN 'symlink' END AS conflict
            FROM names{k} LEFT JOIN {sides['base']} USING (dir, name) LEFT JOIN {sides['ours']} USING (dir, name) LEFT JOIN {sides['theirs']} USING (dir, name))"""
        )
    return ",\n".join(out)


@query(
    f"WITH {X.VERSIONS_SQL}, {', '.join(built_sql(x, 3) for x in ('base', 'ours', 'theirs'))}, {merged_sql(3)} "
    + " UNION ALL ".join(f"SELECT dir || '/' || name AS path, action, CAST(entry.mode AS BIGINT) AS mode, entry.kind AS kind, entry.hash AS hash, conflict FROM merged{k}" for k in range(4))
)
def tree_merge(spark, sf_dir):
    sides = [settle(tree.build_tree(x, "0" * 64)) for x in X.versions(spark, sf_dir)]
    entries = settle(sides[0].unionByName(sides[1]).unionByName(sides[2]).select("tree_hash", "name", "mode", "kind", "hash").distinct())
    roots = [x.where("path = ''").select(F.lit("/").alias("dir"), "name", "mode", "kind", "hash") for x in sides]
    own = merge.merge_trees(*roots, entries)
    path = F.regexp_replace(F.concat_ws("/", "dir", "name"), "^//", "/")
    return own.select(path.alias("path"), "action", "entry.mode", "entry.kind", "entry.hash", "conflict")


# history -----------------------------------------------------------------------------------------------------------

EDGES_SQL = f"{X.COMMITS_SQL}, edges AS (SELECT hash AS src, unnest(parents) AS dst FROM commits)"


def reach_sql(name: str, start: str) -> str:
    """The distances at which start (SQL of rows id) reaches each commit."""
    return f"{name} AS (SELECT id, 0 AS depth FROM ({start}) UNION SELECT dst, depth + 1 FROM {name} JOIN edges ON src = id)"


HEADS_SQL = "SELECT hash AS id FROM commits WHERE hash NOT IN (SELECT dst FROM edges)"


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('r', HEADS_SQL)} SELECT id, min(depth) AS depth FROM r GROUP BY id")
def ancestors(spark, sf_dir):
    commits = X.commits(spark, sf_dir)
    return history.ancestors(commits, history.infer_heads(commits).select(F.col("hash").alias("id")))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, pairs AS (SELECT i // {2 * X.LANE} AS pair, sha256('c' || i) AS a, sha256('c' || (i - {X.LANE + 3})) AS b FROM numbered WHERE i % {2 * X.LANE} = {2 * X.LANE - 1}),
    r AS (SELECT pair, 0 AS side, a AS id, 0 AS depth FROM pairs UNION SELECT pair, 1, b, 0 FROM pairs UNION SELECT pair, side, dst, depth + 1 FROM r JOIN edges ON src = id),
    common AS (SELECT pair, id, min(depth) FILTER (side = 0) AS depth FROM r GROUP BY pair, id HAVING count(DISTINCT side) = 2),
    above AS (SELECT pair, dst AS id FROM edges JOIN common ON src = id UNION SELECT pair, dst FROM above JOIN edges ON src = id),
    best AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY depth, id) AS rn FROM common ANTI JOIN above USING (pair, id))
    SELECT pair, id FROM best WHERE rn = 1"""
)
def merge_base(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").where(F.col("o_orderkey") % (2 * X.LANE) == 2 * X.LANE - 1)
    i = F.col("o_orderkey")
    pairs = o.select(F.expr(f"o_orderkey div {2 * X.LANE}").alias("pair"), X.commit_hash(i).alias("a"), X.commit_hash(i - (X.LANE + 3)).alias("b"))
    return history.merge_bases(X.commits(spark, sf_dir), pairs)


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT id, 0 AS depth FROM ({HEADS_SQL}) UNION SELECT parents[1], depth + 1 FROM r JOIN commits ON hash = id WHERE len(parents) > 0)
    SELECT id, min(depth) AS depth FROM r GROUP BY id"""
)
def first_parent_log(spark, sf_dir):
    commits = X.commits(spark, sf_dir)
    return history.first_parent_log(commits, history.infer_heads(commits).select(F.col("hash").alias("id")))


@query(f"WITH {EDGES_SQL}, h AS (SELECT hash FROM commits WHERE hash NOT IN (SELECT dst FROM edges)) SELECT CASE WHEN count(*) OVER () = 1 THEN 'main' ELSE 'recovered-' || (row_number() OVER (ORDER BY hash) - 1) END AS name, hash FROM h")
def infer_heads(spark, sf_dir):
    return history.recovered_names(history.infer_heads(X.commits(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT hash AS id, 0 AS level FROM commits WHERE len(parents) = 0 UNION SELECT src, level + 1 FROM r JOIN edges ON dst = id)
    SELECT id AS hash, max(level) AS level FROM r GROUP BY id"""
)
def commit_post_order(spark, sf_dir):
    return history.post_order(X.commits(spark, sf_dir))


#: The commits that branches name: the last of every third history.
REFS = f"% {3 * X.LANE} = {X.LANE - 1}"


def stored_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, edges, objects): commits own documents' contents, contents own 4 KiB chunks."""
    files = X.files(spark, sf_dir).where("size > 0")
    commits = X.commits(spark, sf_dir)
    cut = content.cut_passages(files, "fixed", 4_096, keep=["ino", "content_hash"])
    whole = files.select(X.commit_hash(F.col("ino") * 7).alias("src"), F.concat(F.lit("m"), "content_hash").alias("dst"))
    edges = history.parent_edges(commits).select(F.col("hash").alias("src"), F.col("parent").alias("dst")).union(whole).union(cut.select(F.concat(F.lit("m"), "content_hash"), "hash"))
    objects = (
        commits.select("hash", F.lit("commit").alias("kind"), F.lit(100).cast("long").alias("size"))
        .union(files.select(F.concat(F.lit("m"), "content_hash").alias("hash"), F.lit("manifest"), F.lit(36).cast("long")).distinct())
        .union(cut.select("hash", F.lit("chunk"), F.col("byte_end") - F.col("byte_start")).distinct())
    )
    tail = F.conv(F.substring("hash", -3, 3), 16, 10).cast("long")
    dated = objects.withColumn("mtime", F.when(tail % 7 != 0, F.lit(1_000_000) - tail % 1_000))
    return commits.where(f"ts {REFS}").select(F.col("hash").alias("id")), edges, dated


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges, objects = stored_objects(spark, sf_dir)
    return history.sweep(objects, history.mark(roots, edges, objects), 1_000_000, 500)


REACH_SQL = f"""{EDGES_SQL}, {X.FILES_SQL}, cut AS ({fixed_sql(4096, 0)}), all_edges AS (SELECT src, dst FROM edges UNION SELECT sha256('c' || (ino * 7)), 'm' || content_hash FROM files WHERE size > 0
    UNION SELECT 'm' || content_hash, hash FROM cut JOIN files USING (path)),
objects AS (SELECT hash, 'commit' AS kind, CAST(100 AS BIGINT) AS size FROM commits UNION SELECT 'm' || content_hash, 'manifest', 36 FROM files WHERE size > 0 UNION SELECT hash, 'chunk', byte_end - byte_start FROM cut),
marked AS (SELECT sha256('c' || i) AS id FROM numbered WHERE i {REFS} UNION SELECT dst FROM marked JOIN all_edges ON src = id)"""
SWEPT_SQL = f"""{REACH_SQL}, aged AS (SELECT *, CAST('0x' || right(hash, 3) AS BIGINT) AS tail FROM objects),
swept AS (SELECT hash, size, CASE WHEN hash IN (SELECT id FROM marked) THEN 'reachable' WHEN tail % 7 = 0 THEN 'skipped_undated' WHEN tail % 1000 >= 500 THEN 'deleted' ELSE 'skipped_young' END AS state FROM aged)"""


@query(f"WITH RECURSIVE {SWEPT_SQL} SELECT hash, size, state FROM swept")
def gc_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {SWEPT_SQL} SELECT count(*) FILTER (state = 'reachable') AS reachable, count(*) FILTER (state = 'deleted') AS deleted, CAST(coalesce(sum(size) FILTER (state = 'deleted'), 0) AS BIGINT) AS bytes_freed,
    count(*) FILTER (state = 'skipped_young') AS skipped_young, count(*) FILTER (state = 'skipped_undated') AS skipped_undated FROM swept"""
)
def gc_stats(spark, sf_dir):
    return history.gc_stats(swept(spark, sf_dir))


@query(f"WITH RECURSIVE {REACH_SQL} SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM objects WHERE hash IN (SELECT id FROM marked) GROUP BY kind")
def gc_marked(spark, sf_dir):
    roots, edges, objects = stored_objects(spark, sf_dir)
    own = objects.join(history.mark(roots, edges, objects).select(F.col("id").alias("hash")), "hash", "left_semi")
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    f"""WITH RECURSIVE {REACH_SQL}, there AS (SELECT sha256('c' || i) AS id FROM numbered WHERE i % {2 * X.LANE} = 3 UNION SELECT 'm' || content_hash FROM files WHERE size > 0 AND ino % 5 = 0),
    missing AS (SELECT sha256('c' || i) AS id, 0 AS depth FROM numbered WHERE i {REFS} AND sha256('c' || i) NOT IN (SELECT id FROM there) UNION SELECT dst, depth + 1 FROM missing JOIN all_edges ON src = id WHERE dst NOT IN (SELECT id FROM there)),
    wanted AS (SELECT id, min(depth) AS depth FROM missing GROUP BY id),
    own AS (SELECT hash, kind, size, depth, CASE kind WHEN 'chunk' THEN 0 WHEN 'manifest' THEN 1 WHEN 'tree' THEN 2 ELSE 3 END AS rank FROM objects JOIN wanted ON id = hash)
    SELECT hash, kind, size, rank, row_number() OVER (ORDER BY rank, depth DESC, hash) AS place FROM own"""
)
def transfer_missing(spark, sf_dir):
    roots, edges, objects = stored_objects(spark, sf_dir)
    files = X.files(spark, sf_dir).where("size > 0 AND ino % 5 = 0")
    there = X.commits(spark, sf_dir).where(f"ts % {2 * X.LANE} = 3").select("hash").union(files.select(F.concat(F.lit("m"), "content_hash"))).distinct()
    return history.transfer(roots, edges, objects, there).select("hash", "kind", "size", "rank", "place")


@query(
    """WITH s AS (SELECT 'w' || (o_custkey % 50) AS workspace, o_orderkey // 40 AS generation, 'b' || (o_orderkey % 4) AS name, min(sha256('' || o_orderkey)) AS value FROM orders GROUP BY 1, 2, 3),
    g AS (SELECT workspace, max(generation) AS generation FROM s GROUP BY workspace) SELECT workspace, generation, string_agg(name || '=' || value, ',' ORDER BY name) AS refs FROM s JOIN g USING (workspace, generation) GROUP BY workspace, generation"""
)
def ref_mirror_latest(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("w"), F.col("o_custkey") % 50).alias("workspace"), F.floor(F.col("o_orderkey") / 40).alias("generation"),
        F.concat(F.lit("b"), F.col("o_orderkey") % 4).alias("name"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("value"),
    )
    newest = history.newest_mirror(o.groupBy("workspace", "generation", "name").agg(F.min("value").alias("value")))
    return newest.select("workspace", "generation", F.array_join(F.transform("refs", lambda r: F.concat_ws("=", r["name"], r["value"])), ",").alias("refs"))


# review and namespace ----------------------------------------------------------------------------------------------

SUGGESTIONS_SQL = f"""{X.TURNS_SQL}, {X.ACTORS_SQL}, current AS (SELECT path, CASE WHEN conv_id % 9 <> 0 THEN sha256('v' || conv_id) END AS content_hash FROM turns GROUP BY path, conv_id),
suggestions AS (SELECT conv_id * 100 + ordinal AS id, actor AS actor_id, path, CASE WHEN (conv_id + ordinal) % 4 = 0 THEN sha256('old') WHEN conv_id % 9 <> 0 THEN sha256('v' || conv_id) END AS base_hash,
    CASE WHEN ordinal % 5 = 4 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN ordinal % 3 = 2 THEN 'delete' ELSE 'bytes' END AS kind, ordinal, conv_id FROM turns)"""


def suggestions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(suggestions, current contents) from conversation turns."""
    t = X.turns(spark, sf_dir)
    version = F.when(F.col("conv_id") % 9 != 0, F.sha2(F.concat(F.lit("v"), F.col("conv_id")), 256))
    own = t.select(
        (F.col("conv_id") * 100 + F.col("ordinal")).alias("id"), F.col("actor").alias("actor_id"), "path", "ordinal", "conv_id",
        F.when((F.col("conv_id") + F.col("ordinal")) % 4 == 0, F.sha2(F.lit("old"), 256)).otherwise(version).alias("base_hash"),
        F.when(F.col("ordinal") % 5 == 4, "rejected").otherwise("pending").alias("status"), F.when(F.col("ordinal") % 3 == 2, "delete").otherwise("bytes").alias("kind"),
    )
    return own, t.select("path", version.alias("content_hash")).distinct()


@query(f"WITH {SUGGESTIONS_SQL} SELECT s.id FROM suggestions s LEFT JOIN current c USING (path) WHERE status = 'pending' AND kind = 'bytes' AND id <> 300 AND base_hash IS DISTINCT FROM content_hash")
def suggestions_stale(spark, sf_dir):
    return workspace.stale_suggestions(*suggestions(spark, sf_dir), excepted=300)


@query(f"WITH {SUGGESTIONS_SQL} SELECT s.id, s.actor_id AS actor, CASE WHEN a.write_policy = 0 THEN 'wrote' ELSE 'proposed' END AS outcome FROM suggestions s LEFT JOIN actors a ON a.id = s.actor_id")
def write_or_propose(spark, sf_dir):
    own, _ = suggestions(spark, sf_dir)
    return workspace.route_writes(own.select("id", F.col("actor_id").alias("actor")), X.actors(spark, sf_dir)).select("id", "actor", "outcome")


@query(
    f"""WITH {SUGGESTIONS_SQL} SELECT s.id, s.conv_id % 7 AS reviewer, CASE WHEN status <> 'pending' THEN 'not_pending' WHEN a.write_policy IS DISTINCT FROM 0 THEN 'not_allowed' WHEN s.conv_id % 7 = s.actor_id THEN 'own'
    WHEN ordinal % 6 = 5 THEN 'rejected' WHEN s.kind = 'bytes' AND base_hash IS DISTINCT FROM content_hash THEN 'conflict' ELSE 'accepted' END AS decision
    FROM suggestions s LEFT JOIN current c USING (path) LEFT JOIN actors a ON a.id = s.conv_id % 7"""
)
def review_decisions(spark, sf_dir):
    own, current = suggestions(spark, sf_dir)
    reviews = own.select("id", (F.col("conv_id") % 7).alias("reviewer"), (F.col("ordinal") % 6 != 5).alias("accept"))
    return workspace.review(own, reviews, X.actors(spark, sf_dir), current)


def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_paths(*X.tree(spark, sf_dir)).select("path", "kind")


@query(
    f"""WITH {PATHS_SQL}, w AS (SELECT '/' || r_name || '/new/' || n_name || '/' || n_nationkey % 3 AS path FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT string_split(path, '/') AS x FROM w),
    a AS (SELECT DISTINCT array_to_string(x[1 : k], '/') AS path FROM (SELECT x, unnest(range(2, len(x) + 1)) AS k FROM s)) SELECT path, 'dir' AS kind FROM a WHERE path NOT IN (SELECT path FROM p)"""
)
def mkdir_missing(spark, sf_dir):
    r, n = X.table(spark, sf_dir, "region"), X.table(spark, sf_dir, "nation")
    wanted = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("/"), "r_name", F.lit("/new/"), "n_name", F.lit("/"), F.col("n_nationkey") % 3).alias("path"))
    return workspace.mkdir_missing(path_tree(spark, sf_dir), wanted)


@query(f"WITH {PATHS_SQL} SELECT CASE WHEN path = '/ASIA' OR path LIKE '/ASIA/%' THEN '/EUROPE/moved' || substr(path, 6) ELSE path END AS path, kind FROM p")
def rename_subtree(spark, sf_dir):
    return workspace.rename(path_tree(spark, sf_dir), "/ASIA", "/EUROPE/moved")


@query(
    f"""WITH {PATHS_SQL} SELECT path, kind, row_number() OVER (ORDER BY CASE WHEN kind = 'dir' THEN 1 ELSE 0 END, length(path) - length(replace(path, '/', '')) DESC, path) AS step FROM p WHERE path = '/AFRICA' OR path LIKE '/AFRICA/%'"""
)
def recursive_remove_plan(spark, sf_dir):
    return workspace.removal_plan(path_tree(spark, sf_dir), "/AFRICA")


# scalar functions --------------------------------------------------------------------------------------------------


@query(
    """WITH u AS (SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'main' WHEN 2 THEN 'a..b' WHEN 3 THEN '-x' WHEN 4 THEN 'x.lock' WHEN 5 THEN 'feature/' || page_id WHEN 6 THEN 'a b' ELSE 'v1.' || page_id END AS ref,
      CASE page_id % 5 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN '' WHEN 3 THEN 'a/b' ELSE 'ok' END AS part FROM pages)
    SELECT page_id, part = 'ok' AS part_ok, page_id % 8 IN (1, 5, 7) AS ref_ok FROM u"""
)
def name_rules(spark, sf_dir):
    i = F.col("page_id")
    ref = F.expr("CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'main' WHEN 2 THEN 'a..b' WHEN 3 THEN '-x' WHEN 4 THEN 'x.lock' WHEN 5 THEN concat('feature/', page_id) WHEN 6 THEN 'a b' ELSE concat('v1.', page_id) END")
    part = F.expr("CASE page_id % 5 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN '' WHEN 3 THEN 'a/b' ELSE 'ok' END")
    return X.table(spark, sf_dir, "pages").select(i, E.component_ok(part).alias("part_ok"), E.ref_name_ok(ref).alias("ref_ok"))


@query(
    """SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS INTEGER) AS n, CASE WHEN length(text) - length(replace(text, 'zq', '')) = 2 THEN sha256(replace(text, 'zq', 'Q')) END AS once, CASE WHEN text LIKE '%the%' THEN sha256(replace(text, 'the', 'THE')) END AS every,
    trim(regexp_extract(text, '^[^\\n]*'), ' ' || chr(9) || chr(10) || chr(13)) AS first_line FROM documents"""
)
def text_edits(spark, sf_dir):
    t = F.col("text")
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", E.occurrences(t, F.lit("the")).alias("n"), F.sha2(E.replaced(t, F.lit("zq"), F.lit("Q")), 256).alias("once"),
        F.sha2(E.replaced(t, F.lit("the"), F.lit("THE"), every=True), 256).alias("every"), E.trimmed_line(F.regexp_extract(t, "^[^\n]*", 0)).alias("first_line"),
    )


@query(
    f"""WITH {X.FILES_SQL} SELECT ino, regexp_replace(path, '/[^/]+$', '') AS parent, string_split(path, '/')[-1] AS name, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth,
    lower(string_split(path, '.')[-1]) AS ext, CASE lower(string_split(path, '.')[-1]) WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' END AS mime,
    '/.coedit/' || lower(hex(encode(path))) AS sidecar, path || '.theirs' AS theirs, ino % 3 <> 0 AS lock_ok FROM files"""
)
def path_forms(spark, sf_dir):
    p = F.col("path")
    lock = F.when(F.col("ino") % 3 == 0, F.ltrim(p, F.lit("/"))).otherwise(p)
    return X.files(spark, sf_dir).select(
        "ino", E.parent_path(p).alias("parent"), E.base_name(p).alias("name"), F.size(E.path_parts(p)).alias("depth"), E.document_extension(p).alias("ext"),
        E.mime_type(p).alias("mime"), E.sidecar_path(p).alias("sidecar"), E.theirs_path(p).alias("theirs"), E.lock_path_ok(lock).alias("lock_ok"),
    )


@query(
    f"""WITH {X.FILES_SQL} SELECT ino, ino % 7 <> 0 AS valid, CASE WHEN ino % 7 = 0 THEN sha256(coalesce(text, '') || chr(65533)) ELSE sha256(coalesce(text, '')) END AS lossy,
    CAST(length(text) + length(regexp_replace(text, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) AS INTEGER) AS units, size > 0 AND ino % 2 = 0 AS hash_ok,
    CASE WHEN ino % 2 = 0 THEN lang || ' <' || lang || '@workspace.local>' ELSE lang || ' <x@y>' END AS ident,
    CASE ino % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' WHEN 3 THEN 'superseded' END AS status FROM files"""
)
def text_forms(spark, sf_dir):
    data = F.when(F.col("ino") % 7 == 0, F.concat("data", F.unhex(F.lit("FF")))).otherwise(F.col("data"))
    told = F.when(F.col("ino") % 2 == 0, F.col("content_hash")).otherwise(F.upper(F.concat(F.lit("A"), F.substring("content_hash", 2, 63))))
    author = F.when(F.col("ino") % 2 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit(" <x@y>")))
    status = F.element_at(F.array(*map(F.lit, ("pending", "accepted", "rejected", "superseded", "Pending"))), (F.col("ino") % 5 + 1).cast("int"))
    return X.files(spark, sf_dir).select(
        "ino", E.is_text(data).alias("valid"), F.sha2(E.lossy_text(data), 256).alias("lossy"), E.utf16_length(F.col("text")).alias("units"), E.is_hash(told).alias("hash_ok"),
        E.git_ident(author).alias("ident"), E.suggestion_status(status).alias("status"),
    )


# trees, transfers and the feed: further rows -------------------------------------------------------------------------


@query(
    f"""WITH {PATHS_SQL}, x AS (SELECT kind, size, string_split(path, '/') AS x FROM p), u AS (SELECT kind, size, array_to_string(x[1 : k], '/') AS path FROM (SELECT *, unnest(range(2, len(x))) AS k FROM x)),
    g AS (SELECT path, count(*) FILTER (kind <> 'dir') AS files, count(*) FILTER (kind = 'dir') AS dirs, sum(size) FILTER (kind <> 'dir') AS bytes FROM u GROUP BY path)
    SELECT p.path, coalesce(files, 0) AS files, coalesce(dirs, 0) AS dirs, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM p LEFT JOIN g USING (path) WHERE p.kind = 'dir'"""
)
def file_tally(spark, sf_dir):
    return tree.tally(tree.tree_paths(*X.tree(spark, sf_dir)))


@query(f"WITH {X.TREE_SQL}, links AS (SELECT * FROM dentry UNION ALL SELECT parent_ino, 'a-' || name, ino FROM dentry WHERE ino % 3 = 0) SELECT parent_ino, ino, min(name) AS name FROM links GROUP BY parent_ino, ino")
def first_names(spark, sf_dir):
    dentry, _ = X.tree(spark, sf_dir)
    links = dentry.where("ino % 3 = 0").select("parent_ino", F.concat(F.lit("a-"), "name").alias("name"), "ino")
    return tree.first_name(dentry.unionByName(links)).select("parent_ino", "ino", "name")


@query(f"WITH {X.TREE_SQL} SELECT parent_ino, name, row_number() OVER (PARTITION BY parent_ino ORDER BY CASE WHEN kind = 'dir' THEN name || '/' ELSE name END) AS place FROM dentry JOIN inode USING (ino)")
def git_tree_order(spark, sf_dir):
    dentry, inode = X.tree(spark, sf_dir)
    own = tree.git_order(dentry.join(inode.select("ino", "kind"), "ino").withColumn("tree_hash", F.col("parent_ino")))
    return own.select("parent_ino", "name", F.col("place").cast("long").alias("place"))


@query(f"WITH {X.SNAPSHOTS_SQL}, w AS (SELECT DISTINCT hash, path FROM ours), m AS (SELECT DISTINCT hash FROM ours WHERE hash NOT IN (SELECT hash FROM base)) SELECT count(*) FILTER (hash IN (SELECT hash FROM m)) AS objects, CAST(coalesce(sum(strlen(path)) FILTER (hash IN (SELECT hash FROM m)), 0) AS BIGINT) AS bytes, count(*) FILTER (hash NOT IN (SELECT hash FROM m)) AS skipped FROM w")
def transfer_totals(spark, sf_dir):
    base, ours, _ = X.snapshots(spark, sf_dir)
    wanted = ours.select("hash", F.octet_length("path").cast("long").alias("size"))
    return history.transfer_stats(wanted, ours.select("hash").distinct().join(base.select("hash"), "hash", "left_anti"))


@query(f"WITH {OPS_SQL}, c AS (SELECT path, op, seq FROM ops WHERE op IN ('upsert', 'delete')), t AS (SELECT DISTINCT path FROM feed WHERE kind = 'write') SELECT path, op, seq FROM c WHERE op = 'delete' OR path IN (SELECT path FROM t)")
def feed_superseded(spark, sf_dir):
    own = X.feed(spark, sf_dir)
    ops = feed.dispatch(own).where("op IN ('upsert', 'delete')").select("path", "op", "seq")
    return feed.superseded_dropped(ops, own.where("kind = 'write'").select("path").distinct())


@query(f"WITH {X.TREE_SQL} SELECT name, ino FROM dentry WHERE ino IN (SELECT ino FROM inode WHERE ino % 4 = 2)")
def workspace_scoped(spark, sf_dir):
    dentry, inode = X.tree(spark, sf_dir)
    return workspace.scoped(dentry, inode.select("ino", (F.col("ino") % 4).alias("workspace_id")), 2).select("name", "ino")


# passages and proposals end to end ------------------------------------------------------------------------------------


@query(
    f"""WITH {X.FILES_SQL}, own AS (SELECT path, data, size FROM files WHERE size > 0 AND size <= 65536 AND lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('md', 'txt', 'bin')),
    p AS ({fixed_sql(1024, 64, "own")}) SELECT path, ordinal, byte_start, byte_end, hash, CASE WHEN path LIKE '%.bin' AND path LIKE '%1_.bin' THEN 'upper_text' END AS converter FROM p"""
)
def passages_extracted(spark, sf_dir):
    def upper_text(path: str, data: bytes, mime: str | None) -> str | None:
        return data.decode() if path[-6:-5] == "1" else None

    own = content.extract_passages(X.files(spark, sf_dir), "fixed", 1_024, 64, "/", ("md", ".TXT", "bin"), 65_536, upper_text)
    return own.select("path", F.col("ordinal").cast("long").alias("ordinal"), "byte_start", "byte_end", "hash", "converter")


@query(
    f"""WITH {SPANS_SQL}, whole AS (SELECT path, string_agg(text, '' ORDER BY ordinal) AS text FROM turns GROUP BY path), own AS (SELECT path, encode(text) AS data, CAST(strlen(text) AS BIGINT) AS size FROM whole),
    p AS ({fixed_sql(512, 0, "own")}), a AS (SELECT p.path, p.ordinal, s.actor, min(s.byte_start) AS seen FROM p JOIN spans s ON s.path = p.path AND s.byte_start < p.byte_end AND s.byte_end > p.byte_start GROUP BY 1, 2, 3),
    g AS (SELECT path, ordinal, string_agg(CAST(actor AS VARCHAR), ',' ORDER BY seen, actor) AS authors FROM a GROUP BY path, ordinal)
    SELECT p.path || '#' || ordinal AS id, p.path, p.hash, CAST(byte_start AS VARCHAR) AS byte_start, CAST(byte_end AS VARCHAR) AS byte_end, coalesce(authors, '') AS authors FROM p LEFT JOIN g USING (path, ordinal)"""
)
def passage_records(spark, sf_dir):
    t = X.turns(spark, sf_dir)
    files = t.groupBy("path").agg(F.encode(F.expr("listagg(text) WITHIN GROUP (ORDER BY ordinal)"), "UTF-8").alias("data"))
    own = content.passage_records(content.extract_passages(files, "fixed", 512), spans(spark, sf_dir), "store")
    m = F.col("metadata")
    return own.select("id", m["path"].alias("path"), m["content_hash"].alias("hash"), m["byte_start"].alias("byte_start"), m["byte_end"].alias("byte_end"), m["authors"].alias("authors"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending proposals of conversation turns: of their text, or where the path has content every third of its deletion."""
    own, current = suggestions(spark, sf_dir)
    text = X.turns(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("ordinal")).alias("id"), "text")
    data = F.when(F.col("ordinal") % 3 != 2, F.encode("text", "UTF-8"))
    return workspace.propose(own.join(text, "id").select("id", "actor_id", "path", data.alias("data")), current, 1_000)


PROPOSALS_SQL = f"""{SUGGESTIONS_SQL}, proposed AS (SELECT s.id, s.actor_id, s.path, c.content_hash AS base_hash, s.kind, CASE WHEN s.kind = 'bytes' THEN sha256(t.text) END AS content_hash, 'pending' AS status, CAST(1000 AS BIGINT) AS created_at
    FROM suggestions s JOIN turns t ON t.conv_id * 100 + t.ordinal = s.id LEFT JOIN current c ON c.path = s.path)"""


@query(f"WITH {PROPOSALS_SQL} SELECT * FROM proposed")
def proposals_made(spark, sf_dir):
    return proposals(spark, sf_dir)


@query(f"WITH {SUGGESTIONS_SQL} SELECT id, actor_id, path FROM suggestions WHERE status = 'pending' ORDER BY id DESC")
def suggestions_newest(spark, sf_dir):
    return workspace.listed(suggestions(spark, sf_dir)[0], "pending").select("id", "actor_id", "path")


@query()
def proposal_diffs(spark, sf_dir):
    t = X.turns(spark, sf_dir).select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    own = proposals(spark, sf_dir).withColumn("base_hash", F.lit(None).cast("string"))
    return workspace.proposal_diff(own, t)
