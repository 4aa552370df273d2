"""Streams equal batches; repeated batches replace themselves; the Python feed source pages and resumes."""

import json

from pyspark.sql import functions as F

from lodestack import fixtures
from lodestack.operators import feed
from lodestack.schema import FS_EVENT, TABLES
from lodestack.sources.feed_source import ChangeFeed
from lodestack.sources.sinks import JsonlSink, WarehouseSink
from lodestack.sources.stores import ChunkStore
from lodestack.streaming import consumer

EVENTS = [{"seq": k, "kind": "write" if k % 3 else "remove", "path": f"/f{k % 5}", "ts": k, "workspace_id": 1, "branch": "main" if k % 2 else "dev"} for k in range(1, 2_501)]


class Pages:
    """A feed behind an API."""

    def head(self):
        return EVENTS[-1]["seq"]

    def events(self, since, limit, branch):
        return [e for e in EVENTS if e["seq"] > since and branch in (None, e["branch"])][:limit]


def test_schemas():
    assert TABLES["fs_event"].names[0] == "seq" and len(TABLES) == 25


def as_events(spark, sf_dir):
    f = fixtures.feed(spark, sf_dir).withColumn("workspace_id", F.lit(1).cast("long"))
    return f.select(*[F.col(x.name).cast(x.dataType).alias(x.name) for x in FS_EVENT.fields])


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = as_events(spark, sf_dir)
    rows.repartition(3, "seq").write.parquet(f"{tmp_path}/in")
    seen = []

    def handler(changes, others, batch_id):
        seen.append((sorted(tuple(r) for r in changes.collect()), others.count()))

    stream = consumer.read_feed(spark, f"{tmp_path}/in")
    consumer.consume(stream, handler, f"{tmp_path}/at").awaitTermination()
    want = sorted(tuple(r) for r in feed.coalesced(rows).select("path", "op", "seq").collect())
    assert [s[0] for s in seen] == [want]
    consumer.consume(consumer.read_feed(spark, f"{tmp_path}/in"), handler, f"{tmp_path}/at").awaitTermination()
    assert len(seen) == 1  # the checkpoint is the cursor


def test_snapshot_and_tail_have_no_gap(spark, sf_dir, tmp_path):
    rows = as_events(spark, sf_dir)
    rows.write.parquet(f"{tmp_path}/in")
    head, got = 400, []
    q = consumer.consume(consumer.read_feed(spark, f"{tmp_path}/in"), lambda c, o, b: got.extend(r.seq for r in c.collect()), f"{tmp_path}/at", coalesce=False, since=head)
    q.awaitTermination()
    want = feed.dispatch(rows.where(F.col("seq") > head)).where("op IN ('upsert', 'delete')")
    assert sorted(got) == sorted(r.seq for r in want.collect())


def test_jsonl_sink_is_idempotent(spark, tmp_path):
    sink = JsonlSink(str(tmp_path / "out"))
    changes = spark.createDataFrame([("/a", "upsert", 1)], "path string, op string, seq long")
    others = spark.createDataFrame([(2, "commit", "commit", "/")], "seq long, op string, kind string, path string")
    for _ in range(2):
        sink(changes, others, 0)
    lines = [json.loads(x) for f in (tmp_path / "out").rglob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["seq"] for x in lines) == [1, 2]


def test_warehouse_sink(spark, sf_dir, tmp_path):
    rows = as_events(spark, sf_dir)
    text = lambda p: p.where("path NOT LIKE '%f1%'").select("path", F.sha2(F.col("path"), 256).alias("sha256"), F.length("path").cast("long").alias("size"), F.col("path").alias("text"))
    sink = WarehouseSink(str(tmp_path / "wh"), text)
    for batch, part in ((0, rows.where("seq < 500")), (1, rows.where("seq >= 500")), (1, rows.where("seq >= 500"))):
        sink(part, batch)
    content = spark.read.parquet(f"{tmp_path}/wh/content")
    assert content.count() == content.select("sha256").distinct().count() > 0
    events = spark.read.parquet(f"{tmp_path}/wh/events")
    assert events.groupBy("seq", "sub").count().where("count > 1").count() == 0
    current = sink.current(spark)
    assert current.groupBy("path").count().where("count > 1").count() == 0 and current.where("text = path").count() > 0


def test_feed_source(spark):
    spark.dataSource.register(ChangeFeed)
    source = "test_streaming:Pages"
    got = spark.read.format("change_feed").option("source", source).option("span", "700").load()
    assert got.count() == 2_500 and got.agg(F.max("seq")).first()[0] == 2_500
    half = spark.read.format("change_feed").option("source", source).option("branch", "main").option("since", "2000").load()
    assert half.count() == 250


def test_presence_stream(spark, tmp_path):
    rows = [(1, 7, "/a", "2024-01-01 00:00:00"), (2, 8, "/b", "2024-01-01 00:00:10"), (1, 7, "/c", "2024-01-01 00:01:00")]
    later = [(3, 9, "/z", "2024-01-01 02:00:00")]
    schema = "session_id long, actor_id long, path string, at string"
    for k, r in enumerate((rows, later, later)):
        spark.createDataFrame(r, schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("session_id long, actor_id long, path string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = consumer.presence_stream(stream.withWatermark("at", "10 seconds"))
    out.writeStream.format("memory").queryName("present").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    got = {(r.session_id, r.path, r.state) for r in spark.table("present").collect()}
    assert (1, "/c", "active") in got and (1, "/c", "gone") in got and (2, "/b", "gone") in got and (3, "/z", "active") in got


def test_relay_log(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06")]
    spark.createDataFrame(rows, "id long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = consumer.relayed(spark.readStream.schema("id long, at timestamp").parquet(f"{tmp_path}/in"))
    out.writeStream.format("memory").queryName("relay").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("relay").collect()) == [1, 2]


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "cas"))
    chunks = spark.range(20).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.length(F.col("id").cast("string")).cast("long").alias("len"), F.col("id").cast("string").cast("binary").alias("bytes"))
    for _ in range(2):
        store.put(chunks)
    assert store.all().count() == 20 and store.failures().count() == 0
    assert store.get(chunks.limit(3), verify=True).count() == 3


def test_snapshot_store(spark, tmp_path):
    from lodestack.plans.storage import SnapshotStore

    store = SnapshotStore(spark, str(tmp_path / "meta"))
    assert store.write("t", spark.range(3)) == 1 and store.write("t", spark.range(5)) == 2
    assert store.read("t").count() == 5
    store.backup(str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy" / "t")).count() == 5
