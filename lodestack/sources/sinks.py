"""Sinks of the change feed: JSON lines, and a warehouse of events and distinct content. Both write by batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import feed
from lodestack.plans.storage import is_missing


class JsonlSink:
    """A folder of JSON lines for each batch; a repeated batch replaces its folder."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, changes: DataFrame, others: DataFrame, batch_id: int) -> None:
        both = changes.select("seq", "op", "path").unionByName(others.select("seq", "op", "path"))
        both.write.mode("overwrite").json(f"{self.path}/batch={batch_id}")


class WarehouseSink:
    """events (seq, ts, actor_id, kind, path, sha256, branch) and content (sha256, size, text), by batch.

    ``content_of(rows)`` gives path, sha256, size, text of upserted paths; a path that is gone is left out, and its
    upsert with it. Content is written once for each hash: what earlier batches have is not written again.
    """

    def __init__(self, path: str, content_of: Callable[[DataFrame], DataFrame]):
        self.path, self.content_of = path.rstrip("/"), content_of

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = feed.sink_rows(batch)
        found = self.content_of(rows.where("kind = 'upsert'").select("path").distinct())
        upserts = rows.where("kind = 'upsert'").join(found.select("path", "sha256"), "path")
        rest = rows.where("kind <> 'upsert'").withColumn("sha256", F.lit(None).cast("string"))
        columns = ["seq", "sub", "ts", "actor_id", "kind", "path", "sha256", "branch"]
        new = found.select("sha256", "size", F.make_valid_utf8("text").alias("text")).dropDuplicates(["sha256"])
        try:
            old = spark.read.parquet(f"{self.path}/content").where(F.col("batch") != batch_id).select("sha256")
            new = new.join(old, "sha256", "left_anti")
        except AnalysisException as e:
            if not is_missing(e):
                raise
        new.write.mode("overwrite").parquet(f"{self.path}/content/batch={batch_id}")
        upserts.select(*columns).unionByName(rest.select(*columns)).write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")

    def current(self, spark) -> DataFrame:
        """The current-state view over what has been written."""
        return feed.current_state(spark.read.parquet(f"{self.path}/events"), spark.read.parquet(f"{self.path}/content").drop("batch"), ["sub"])
