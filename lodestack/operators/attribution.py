"""Byte-range authorship: runs, spans with byte and line ranges, clipping, revert, attributed writes, carrying."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.expressions import decode_runs, runs_well_formed
from lodestack.operators.content import overlapping
from lodestack.plans.storage import ranked

Run = tuple[int, int, int]


def coalesce_runs(runs: DataFrame, by: str = "path") -> DataFrame:
    """path, run, actor, session, len: adjacent runs of one author joined, empty ones dropped first.

    runs: path, ordinal, actor, session, len (other columns are dropped). Gaps and islands over each file's runs.
    """
    order = Window.partitionBy(by).orderBy("ordinal")
    own = runs.where("len > 0").select(by, "ordinal", "actor", F.coalesce("session", F.lit(0)).cast("long").alias("session"), "len")
    new = ~(F.lag("actor").over(order).eqNullSafe(F.col("actor")) & F.lag("session").over(order).eqNullSafe(F.col("session")))
    marked = own.withColumn("_new", new.cast("int"))
    numbered = marked.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(by, "run").agg(F.first("actor").alias("actor"), F.first("session").alias("session"), F.sum("len").alias("len"))


def blame_spans(runs: DataFrame, by: str = "path", order: str = "ordinal") -> DataFrame:
    """path, ordinal, actor, session, byte_start, byte_end, line_start, line_end of runs that carry their own ``text``.

    Lines are counted from 1; a line end that is a run's last byte does not reach into the next line.
    """
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    own = runs.where("len > 0").withColumn("_feeds", feeds)
    own = own.withColumn("byte_start", F.coalesce(F.sum("len").over(upto), F.lit(0))).withColumn("_before", F.coalesce(F.sum("_feeds").over(upto), F.lit(0)))
    last = F.col("_before") + F.col("_feeds") - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    return own.select(
        by, order, "actor", "session", "byte_start", (F.col("byte_start") + F.col("len")).alias("byte_end"),
        (F.col("_before") + 1).alias("line_start"), (last + 1).alias("line_end"),
    )


def with_actors(spans: DataFrame, actors: DataFrame) -> DataFrame:
    """spans with their actor's kind and display_name; an actor that is missing is an error, never a dropped span."""
    names = actors.select(F.col("id").alias("actor"), F.col("kind").alias("actor_kind"), "display_name")
    kind = F.when(F.col("actor_kind").isNull(), F.raise_error(F.concat(F.lit("no actor "), F.col("actor").cast("string"))).cast("string")).otherwise(F.col("actor_kind"))
    return spans.join(names, "actor", "left").withColumn("actor_kind", kind)


def check_lengths(blame: DataFrame, files: DataFrame) -> DataFrame:
    """path, runs of maps whose lengths add up to their file's size; another is corrupt and an error."""
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["len"])
    both = blame.join(files.select("path", "size"), "path")
    wrong = F.raise_error(F.concat(F.lit("corrupt blame of "), F.col("path")))
    return both.select("path", F.when(total == F.col("size"), F.col("runs")).otherwise(wrong.cast(blame.schema["runs"].dataType)).alias("runs"))


def clip(spans: DataFrame, passages: DataFrame, width: int = 1 << 16) -> DataFrame:
    """spans clipped to the passages (path, byte_start, byte_end and more) that they overlap; line ranges stay whole."""
    p = passages.withColumnsRenamed({"byte_start": "_p0", "byte_end": "_p1"})
    both = overlapping(p, spans, "path", ("_p0", "_p1"), ("byte_start", "byte_end"), width)
    start, end = F.greatest("byte_start", "_p0"), F.least("byte_end", "_p1")
    return both.withColumns({"byte_start": start, "byte_end": end}).withColumnsRenamed({"_p0": "passage_start", "_p1": "passage_end"})


def authors_first_seen(runs: DataFrame, by: str = "path") -> DataFrame:
    """path, authors: each author once, in the order of first appearance."""
    first = runs.where("len > 0").groupBy(by, "actor").agg(F.min("ordinal").alias("_at"))
    seen = F.array_sort(F.collect_list(F.struct("_at", "actor")))
    return first.groupBy(by).agg(F.transform(seen, lambda x: x["actor"]).alias("authors"))


def lines_of_runs(runs: DataFrame) -> DataFrame:
    """path, line (from 0), ordinal, actor, session, part (the run's bytes in the line), whole_line parts in order.

    Runs carry their text; a run is split behind its line ends, and the running number of line ends numbers the lines.
    """
    parts = F.filter(F.split("text", "(?<=\n)"), lambda x: x != "")
    cut = runs.where("len > 0").select("path", "ordinal", "actor", "session", F.posexplode(parts).alias("k", "part"))
    ends = F.when(F.col("part").endswith("\n"), 1).otherwise(0)
    upto = Window.partitionBy("path").orderBy("ordinal", "k").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("line", F.coalesce(F.sum(ends).over(upto), F.lit(0)))


def revert_session(runs: DataFrame, actor: int, session: int) -> DataFrame:
    """path, text, dropped: the files without the lines whose every span is the actor's in the session.

    Lines of several authors stay. Only files that lose a line are returned.
    """
    lines = lines_of_runs(runs)
    own = (F.col("actor") == actor) & (F.coalesce("session", F.lit(0)) == session)
    part = F.array_sort(F.collect_list(F.struct("ordinal", "k", "part")))
    by = lines.groupBy("path", "line").agg(F.bool_and(own).alias("gone"), F.array_join(F.transform(part, lambda x: x["part"]), "").alias("body"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("line", "body"))))
    files = by.groupBy("path").agg(F.array_join(F.transform(kept, lambda x: x["body"]), "").alias("text"), F.count_if("gone").alias("dropped"))
    return files.where("dropped > 0")


def op_log(ops: DataFrame, actor: int | None = None, session: int | None = None) -> DataFrame:
    """Edit operations of an actor and a session, where given, by id."""
    for column, value in (("actor_id", actor), ("session_id", session)):
        if value is not None:
            ops = ops.where(F.col(column) == value)
    return ops.orderBy("id")


def namespace_op(changes: DataFrame, op: str, now: int) -> DataFrame:
    """Op-log rows of a namespace change (remove, rename, mkdir, symlink): no bytes."""
    zero = F.lit(0).cast("long")
    return changes.select("actor_id", "session_id", "path", F.lit(op).alias("op"), zero.alias("byte_start"), zero.alias("byte_len"), F.lit(now).cast("long").alias("ts"))


# attributed writes --------------------------------------------------------------------------------------------------


def split_lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a shortest edit script (Myers, linear space by meeting in the middle)."""
    out: list[tuple[int, int]] = []
    work = [(0, len(old), 0, len(new))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and old[a0] == new[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and old[a1 - 1] == new[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        x, y, u, v = middle_snake(old, new, a0, a1, b0, b1)
        out += [(x + k, y + k) for k in range(u - x)]
        if (x, y) != (a1, b1):
            work.append((a0, x, b0, y))
        if (u, v) != (a0, b0):
            work.append((u, a1, v, b1))
    return sorted(out)


def middle_snake(old: list[str], new: list[str], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A run of equal lines (may be empty) on a shortest path between the corners, where both searches meet."""
    n, m = a1 - a0, b1 - b0
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and old[a0 + x] == new[b0 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and -(d - 1) <= delta - k <= d - 1 and x + back[delta - k] >= n:
                return a0 + x0, b0 + y0, a0 + x, b0 + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and old[a1 - 1 - x] == new[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return a1 - x, b1 - y, a1 - x0, b1 - y0
    raise AssertionError("the searches always meet")


def join_runs(runs: list[Run]) -> list[Run]:
    out: list[Run] = []
    for actor, session, n in runs:
        if n and out and out[-1][:2] == (actor, session):
            out[-1] = (actor, session, out[-1][2] + n)
        elif n:
            out.append((actor, session, n))
    return out


def window_of(runs: list[Run], start: int, n: int) -> list[Run]:
    """The runs within [start, start + n)."""
    out, at = [], 0
    for actor, session, size in runs:
        low, high = max(at, start), min(at + size, start + n)
        if low < high:
            out.append((actor, session, high - low))
        at += size
    return out


def attribute(old: bytes, runs: list[Run], new: bytes, writer: tuple[int, int]) -> list[Run]:
    """The new bytes' runs: kept and moved lines keep their authors, the rest is the writer's.

    Binary content on either side is the writer's whole. A moved line is found by its trimmed text, first deleted first
    taken; of the same length it keeps its spans, of another it goes to the old line's first author.
    """
    try:
        before, after = split_lines(old.decode()), split_lines(new.decode())
    except UnicodeDecodeError:
        return join_runs([(*writer, len(new))])
    sizes = [len(x.encode()) for x in before]
    starts = [0]
    for n in sizes:
        starts.append(starts[-1] + n)
    kept = {j: i for i, j in common_lines(before, after)}
    moved: dict[str, deque[int]] = {}
    for i in sorted(set(range(len(before))) - set(kept.values())):
        moved.setdefault(before[i].strip(), deque()).append(i)
    out: list[Run] = []
    for j, line in enumerate(after):
        n = len(line.encode())
        i = kept.get(j)
        if i is None and (queue := moved.get(line.strip())):
            i = queue.popleft()
        if i is None:
            out.append((*writer, n))
            continue
        own = window_of(runs, starts[i], sizes[i])
        if sizes[i] == n:
            out += own
            out.append((*writer, n - sum(x[2] for x in own)))
        else:
            first = own[0][:2] if own else writer
            out.append((*first, n))
    return join_runs(out)


RUNS = "array<struct<actor: bigint, session: bigint, len: bigint>>"


def attributed_history(revisions: DataFrame) -> DataFrame:
    """path, data, runs after folding each path's revisions (path, rev, actor, session, data) in order.

    A file's history is a fold, so a path's revisions meet in one task, one at a time: rows are sorted by path and
    revision and only the current body is held.
    """
    own = revisions.select("path", "rev", "actor", F.coalesce("session", F.lit(0)).cast("long").alias("session"), "data")
    dealt = own.repartition("path").sortWithinPartitions("path", "rev")
    kind = pa.list_(pa.struct([("actor", pa.int64()), ("session", pa.int64()), ("len", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(path: str, data: bytes, runs: list[Run]) -> pa.RecordBatch:
            told = [{"actor": a, "session": s, "len": n} for a, s, n in runs]
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([told], kind)], names=["path", "data", "runs"])

        now, body, runs = None, b"", []
        for batch in batches:
            for path, actor, session, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if path != now:
                    if now is not None:
                        yield made(now, body, runs)
                    now, body, runs = path, b"", []
                runs = attribute(body, runs, data, (actor, session))
                body = data
        if now is not None:
            yield made(now, body, runs)

    return dealt.mapInArrow(run, f"path string, data binary, runs {RUNS}")


def explicit_spans(writes: DataFrame) -> DataFrame:
    """path, data, runs of writes that state their own runs: text only, and the runs must cover the bytes exactly."""
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["len"])
    fine = F.is_valid_utf8(F.col("data")) & (total == F.octet_length("data"))
    return writes.withColumn("data", F.when(fine, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("spans do not fit "), F.col("path"))).cast("binary")))


def whole_file_runs(writes: DataFrame) -> DataFrame:
    """path, data, runs of streamed or binary writes: one run by the writer."""
    one = F.array(F.struct(F.col("actor").cast("long").alias("actor"), F.coalesce("session", F.lit(0)).cast("long").alias("session"), F.octet_length("data").cast("long").alias("len")))
    return writes.select("path", "data", F.filter(one, lambda r: r["len"] > 0).alias("runs"))


# carrying between stores -------------------------------------------------------------------------------------------


def identity_map(actors: DataFrame, target: DataFrame, client: str) -> DataFrame:
    """actor, target (null: to be made), subject: a store's actors in another, by subject or a synthetic one."""
    subject = F.coalesce("auth_subject", F.concat_ws(":", F.lit(client), "kind", "display_name"))
    own = actors.select(F.col("id").alias("actor"), subject.alias("subject"))
    return own.join(target.select(F.col("auth_subject").alias("subject"), F.col("id").alias("target")), "subject", "left")


def carry_blame(blame: DataFrame, mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """content_hash, runs with actors mapped; blame: content_hash, runs as encoded text.

    A blob is left out as a whole where a segment is malformed or an actor has no target, and where the target has it.
    """
    own = blame.where(runs_well_formed(F.col("runs"))).join(existing.select("content_hash"), "content_hash", "left_anti")
    runs = own.select("content_hash", F.posexplode(decode_runs(F.col("runs"))).alias("k", "r"))
    mapped = runs.select("content_hash", "k", F.col("r.actor").alias("actor"), F.col("r.session").alias("session"), F.col("r.len").alias("len")).join(mapping.select("actor", "target"), "actor", "left")
    part = F.struct("k", F.concat_ws(",", F.col("target"), F.col("session"), F.col("len")).alias("s"))
    by = mapped.groupBy("content_hash").agg(F.bool_and(F.col("target").isNotNull()).alias("_fine"), F.array_sort(F.collect_list(part)).alias("_p"))
    return by.where("_fine").select("content_hash", F.array_join(F.transform("_p", lambda x: x["s"]), ";").alias("runs"))


def find_or_create_actor(actors: DataFrame, wanted: DataFrame, first_id: int) -> DataFrame:
    """subject, id: the actor of each wanted subject, with new ids in the order of subjects for those that have none."""
    got = wanted.select(F.col("auth_subject").alias("subject")).distinct().join(actors.select(F.col("auth_subject").alias("subject"), "id"), "subject", "left")
    made = ranked(got.where("id IS NULL").select("subject"), [F.col("subject")], "id").withColumn("id", F.col("id") + F.lit(first_id) - 1)
    return got.where("id IS NOT NULL").unionByName(made.withColumn("id", F.col("id").cast("long")))


def controller_chains(actors: DataFrame, most: int = 8) -> DataFrame:
    """actor, controller, distance: who controls an actor, through at most ``most`` steps (a cycle ends there)."""
    edges = actors.where("controller_actor_id IS NOT NULL").select(F.col("id").alias("actor"), F.col("controller_actor_id").alias("controller"))
    step = edges.withColumn("distance", F.lit(1))
    out = step
    up = edges.select(F.col("actor").alias("controller"), F.col("controller").alias("_next"))
    for k in range(2, most + 1):
        step = step.join(up, "controller").select("actor", F.col("_next").alias("controller"), F.lit(k).alias("distance"))
        out = out.union(step)
    return out.groupBy("actor", "controller").agg(F.min("distance").alias("distance"))


# co-edited text ------------------------------------------------------------------------------------------------------


def units(text: str) -> int:
    """UTF-16 code units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def inserted_ranges(old: str, new: str) -> list[tuple[int, int]]:
    """(start, length) in UTF-16 units of the new text's stretches that a character difference inserts."""
    kept = {j for _, j in common_lines(list(old), list(new))}
    out: list[tuple[int, int]] = []
    at = 0
    for j, c in enumerate(new):
        n = units(c)
        if j not in kept:
            if out and out[-1][0] + out[-1][1] == at:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                out.append((at, n))
        at += n
    return out


def spans_of_blame(text: str, runs: list[Run], fallback: tuple[int, int] = (0, 0)) -> list[tuple[str, int, int]]:
    """(text, actor, session) stretches of a document for a co-editor: each character belongs to the run that holds its
    first byte, and to the fallback author where none does."""
    edges, at = [], 0
    for actor, session, n in runs:
        edges.append((at, at + n, actor, session))
        at += n
    out: list[tuple[str, int, int]] = []
    at = k = 0
    for c in text:
        while k < len(edges) and edges[k][1] <= at:
            k += 1
        author = edges[k][2:] if k < len(edges) else fallback
        if out and out[-1][1:] == author:
            out[-1] = (out[-1][0] + c, *author)
        else:
            out.append((c, *author))
        at += len(c.encode())
    return out


def insertions(pairs: DataFrame) -> DataFrame:
    """path, start, length of the inserted stretches of pairs (path, old, new)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, a, n) for p, old, new in zip(*(batch.column(k).to_pylist() for k in range(3))) for a, n in inserted_ranges(old or "", new or "")]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "start", "length"])

    return pairs.select("path", "old", "new").mapInArrow(run, "path string, start long, length long")


def service_counters(ops: DataFrame, passages: DataFrame) -> DataFrame:
    """writes, removes, renames of the op log, chunks put and deduplicated, bytes written: one row."""
    kinds = ops.agg(*[F.count_if(F.col("op") == k).alias(name) for k, name in (("write", "writes"), ("remove", "removes"), ("rename", "renames"))])
    by = passages.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("byte_end") - F.col("byte_start")).alias("len"))
    put = by.agg(F.count(F.lit(1)).alias("chunks_put"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("chunks_deduped"), F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).alias("bytes"))
    return kinds.crossJoin(F.broadcast(put))  # one row each


def derived_runs(rows: DataFrame, writer: tuple[int, int]) -> DataFrame:
    """content_hash, runs of writes: rows of content_hash, _old (bytes before, null: none), data, runs (before, or null)."""
    kind = pa.list_(pa.struct([("actor", pa.int64()), ("session", pa.int64()), ("len", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for old, data, runs in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                before = [(r["actor"], r["session"] or 0, r["len"]) for r in runs or []]
                out.append([{"actor": a, "session": s, "len": n} for a, s, n in attribute(old or b"", before, data, writer)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["content_hash", "runs"])

    return rows.select("content_hash", "_old", "data", "runs").mapInArrow(run, f"content_hash string, runs {RUNS}")
