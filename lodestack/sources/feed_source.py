"""A Python data source for change feeds behind an API: ``spark.read.format("change_feed")``, also as a stream.

Options: ``source``, a ``module:factory`` whose object has ``head() -> int`` and ``events(since, limit, branch)`` (rows of
fs_event in order of seq, at most ``limit``), and ``branch``. The offset is the seq; the branch is the source's to apply
before it cuts the page, so an empty page means the end.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestack.operators.feed import PAGE
from lodestack.schema import FS_EVENT

COLUMNS = FS_EVENT.names


def opened(options: dict[str, str]):
    module, _, factory = options["source"].partition(":")
    return getattr(importlib.import_module(module), factory)()


def pages(options: dict[str, str], first: int, last: int) -> Iterator[tuple]:
    """Events with first < seq <= last, page by page."""
    source, cursor = opened(options), first
    while cursor < last:
        page = source.events(cursor, PAGE, options.get("branch"))
        for event in page:
            if event["seq"] > last:
                return
            yield tuple(event.get(c) for c in COLUMNS)
        if not page:
            return
        cursor = page[-1]["seq"]


@dataclass
class Span(InputPartition):
    first: int
    last: int


def spans(first: int, last: int, size: int) -> list[Span]:
    return [Span(a, min(a + size, last)) for a in range(first, last, size)] or [Span(first, first)]


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return spans(int(self.options.get("since", 0)), opened(self.options).head(), int(self.options.get("span", 100_000)))

    def read(self, partition: Span):
        yield from pages(self.options, partition.first, partition.last)


class FeedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self):
        return {"seq": int(self.options.get("since", 0))}

    def latestOffset(self):
        return {"seq": opened(self.options).head()}

    def partitions(self, start, end):
        return spans(start["seq"], end["seq"], int(self.options.get("span", 100_000)))

    def read(self, partition: Span):
        yield from pages(self.options, partition.first, partition.last)

    def commit(self, end):
        pass


class ChangeFeed(DataSource):
    @classmethod
    def name(cls):
        return "change_feed"

    def schema(self):
        return FS_EVENT

    def reader(self, schema):
        return FeedReader(self.options)

    def streamReader(self, schema):
        return FeedStream(self.options)
