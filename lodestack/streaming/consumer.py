"""The change feed as a stream: a consumer over foreachBatch, presence as keyed state, a relay log with bounded state.

Spark's checkpoint is the cursor: a batch that fails is delivered again under the same batch id, and the sinks write by
batch id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators import feed
from lodestack.schema import FS_EVENT

Handler = Callable[[DataFrame, DataFrame, int], None]


def read_feed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """fs_event rows that arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(FS_EVENT)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def consume(events: DataFrame, handler: Handler, checkpoint: str, coalesce: bool = True, since: int | None = None, **trigger) -> StreamingQuery:
    """Delivers each batch to ``handler(changes, others, batch_id)``.

    changes: path, op, seq (each path's last operation; every one in order of seq and sub where not coalesced). others:
    commits and other events, each. ``since``: events up to a snapshot's head are left out, so a snapshot and the
    stream behind it have neither gap nor overlap.
    """
    own = events.where(F.col("seq") > since) if since is not None else events

    def deliver(batch: DataFrame, batch_id: int) -> None:
        ops = feed.dispatch(batch)
        changes = feed.coalesced(batch).select("path", "op", "seq") if coalesce else ops.where("op IN ('upsert', 'delete')").select("path", "op", "seq", "sub").orderBy("seq", "sub")
        handler(changes, ops.where("op IN ('commit', 'other')").select("seq", "op", "kind", "path"), batch_id)

    return own.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def presence_stream(heartbeats: DataFrame, grace_seconds: int = 300) -> DataFrame:
    """session_id, actor_id, path, last_seen, state (active, gone): each session's newest heartbeat as it changes, and
    its end when it has been silent for the grace period (by event time).

    heartbeats: session_id, actor_id, path, at (timestamp), with a watermark set by the caller.
    """
    columns = ["session_id", "actor_id", "path", "last_seen", "state"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            actor, path, seen = state.get
            state.remove()
            yield pd.DataFrame([[key[0], actor, path, seen, "gone"]], columns=columns)
            return
        newest = state.get if state.exists else None
        for frame in frames:
            for row in frame.itertuples(index=False):
                seen = int(row.at.timestamp())
                if newest is None or (seen, row.path) > (newest[2], newest[1]):
                    newest = (int(row.actor_id), row.path, seen)
        state.update(newest)
        state.setTimeoutTimestamp(max(newest[2] * 1_000 + grace_seconds * 1_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], *newest, "active"]], columns=columns)

    out = "session_id long, actor_id long, path string, last_seen long, state string"
    return heartbeats.groupBy("session_id").applyInPandasWithState(step, out, "actor_id long, path string, last_seen long", "append", "EventTimeTimeout")


def relayed(operations: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """Co-edit operations (id, at and more) once each; ids are remembered for the time to live only."""
    return operations.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["id"])
