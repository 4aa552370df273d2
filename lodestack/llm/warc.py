"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans a partition for each group of files, takes predicates on record type and on header columns, and parses
a record's headers before anything else: where they fail the predicates, or the payload isn't asked for, the payload is
not decoded (a compressed member with its length in its extra field is passed over without inflating it). Writing
gives each task files of a bounded size, each record a gzip member of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from lodestack.llm.common import shared_dir

#: Smaller payloads are always stored.
LEAST_SHARED = 100
#: A task's file is closed at this size; small files are read together up to it.
FILE_BYTES = 64_000_000
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: The header of each column that predicates may use.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
    "page_id": "x-page-id",
    "refers_to": "x-refers-to-page",
}
WHOLE = {"payload_length", "page_id", "refers_to"}


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(row: dict) -> bytes:
    """One record. row: page_id, url, record_type, payload_digest, payload_length, refers_to, payload, date."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": record_id(row["page_id"]),
        "WARC-Date": row["date"],
        "WARC-Target-URI": None if row["url"] is None else quote(row["url"], safe="%/:?#[]@!$&'()*+,;=-._~"),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(row["refers_to"]) if revisit else None,
        "X-Page-Id": row["page_id"],
        "X-Refers-To-Page": row["refers_to"] if revisit else None,
        "X-Payload-Length": row["payload_length"],
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(http) + len(payload),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", http, payload, b"\r\n\r\n"))


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field 'sl' holds the member's whole length and the data's (where they fit 32 bits)."""
    own = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = own.compress(data) + own.flush()
    size = 24 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size & 0xFFFFFFFF if size < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return b"".join((b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H", len(extra)), extra, body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)))


def parse_headers(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line is under ''."""
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    out, last = {"": first}, ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class Stream:
    """Records of one open file, one at a time: ``headers()``, then ``block()`` or ``skip()``."""

    STEP = 4_096
    LARGE = 1 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0
        self.inflated = 0
        file.seek(0)
        self.zipped = file.read(2) == b"\x1f\x8b"

    def headers(self) -> dict[str, str] | None:
        """The next record's headers; None at the end of the file."""
        if self.at >= self.size:
            return None
        self.file.seek(self.at)
        self.end, self.ready, self.over = None, b"", b""
        if self.zipped:
            start = self.file.read(24)
            if len(start) >= 24 and start[3] == 4 and start[12:14] == b"sl":
                length = struct.unpack_from("<I", start, 16)[0]
                self.end = self.at + length if length else None
            self.file.seek(self.at)
            self.inflate = zlib.decompressobj(31)
        while (cut := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.ready.strip():
                    raise ValueError("a record's headers are cut")
                return None
        found = parse_headers(self.ready[:cut].lstrip(b"\r\n"))
        self.body = cut + 4
        self.length = int(found.get("content-length", 0))
        return found

    def more(self, most: int = STEP) -> bool:
        """Reads a step further in this record; inflates at most so many bytes."""
        if self.zipped and self.inflate.eof:
            return False
        data = (self.zipped and self.inflate.unconsumed_tail) or self.file.read(max(most, self.STEP))
        if not data:
            return False
        if self.zipped:
            got = self.inflate.decompress(data, most)
            self.inflated += len(got)
            self.over = self.inflate.unused_data
            self.ready += got
        else:
            self.ready += data
        return True

    def block(self) -> bytes:
        """The record's whole content."""
        parts, have = [self.ready], len(self.ready)
        while have < self.body + self.length:
            self.ready = b""
            if not self.more(self.body + self.length + 4 - have if self.zipped else self.LARGE):
                raise ValueError("a record is cut")
            parts.append(self.ready)
            have += len(self.ready)
        self.ready = b"".join(parts)
        out = self.ready[self.body : self.body + self.length]
        self.skip()
        return out

    def skip(self) -> None:
        """Goes to the next record; the rest of this one is inflated only where nothing tells its length."""
        if not self.zipped:
            self.at += self.body + self.length + 4
        elif self.end is not None:
            self.at = self.end
        else:
            while not self.inflate.eof:
                self.ready = b""
                if not self.more(self.LARGE):
                    break
            self.at = self.file.tell() - len(self.over)


def field(headers: dict[str, str], column: str):
    value = headers.get(HEADERS[column])
    if value is not None and column == "payload_digest":
        return value.partition(":")[2] or value
    return int(value) if value is not None and column in WHOLE else value


@dataclass
class Files(InputPartition):
    uris: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.payload = options.get("payload", "true").lower() != "false" and "payload" in schema.names
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in HEADERS and isinstance(f, EqualTo | EqualNullSafe):
                self.tests.append((column, "in", {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull | IsNull):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            own = field(headers, column)
            if (own not in value) if kind == "in" else ((own is None) != value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = store.get_file_info(path) if not path.endswith("/") else None
        if found is not None and found.type == fs.FileType.File:
            files = [found]
        else:
            files = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        out, size = [[]], 0
        for x in sorted(files, key=lambda x: x.path):
            if out[-1] and size + x.size > FILE_BYTES:
                out.append([])
                size = 0
            out[-1].append(scheme + x.path)
            size += x.size
        return [Files(u) for u in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = self.schema.names
        kinds = {"payload": pa.binary(), **{c: pa.int64() if c in WHOLE else pa.string() for c in HEADERS}}
        rows: dict[str, list] = {c: [] for c in names}
        size = n = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in names], names=names)

        for uri in partition.uris:
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                records = Stream(f, f.size())
                while (headers := records.headers()) is not None:
                    if not self.wanted(headers):
                        records.skip()
                        continue
                    payload = None
                    if self.payload and headers.get("warc-type") != "revisit":
                        block = records.block()
                        http = headers.get("content-type", "").startswith("application/http")
                        payload = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else block
                    else:
                        records.skip()
                    for c in names:
                        rows[c].append(payload if c == "payload" else field(headers, c))
                    n, size = n + 1, size + len(payload or b"")
                    if n >= 4_096 or size > 8_000_000:
                        yield batch()
                        rows, n, size = {c: [] for c in names}, 0, 0
        yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Tasks write into a folder of the job, which readers pass over; commit moves the files of the attempts that
    count, so a repeated or failed attempt leaves no record."""

    def __init__(self, options: dict[str, str]):
        import uuid

        self.path, self.date = options["path"], options.get("date", "2000-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex

    def place(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        return store, path, f"{path}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from pyspark import TaskContext

        store, _, folder = self.place()
        store.create_dir(folder, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        files: list[str] = []
        records = size = 0
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{part:06d}-{len(files):04d}-{attempt}")
                    out, size = store.open_output_stream(f"{folder}/{files[-1]}.tmp"), 0
                data = member(record(row | {"date": self.date}))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files, records)

    def commit(self, messages: list[Written | None]) -> None:
        store, path, folder = self.place()
        for told in messages:
            for name in told.files if told else []:
                store.move(f"{folder}/{name}.tmp", f"{path}/{name}.warc.gz")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, _, folder = self.place()
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class WarcDataSource(DataSource):
    """Format ``warc``; options: path, payload (false: leave payloads undecoded and null), date (of written records)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark) -> None:
    """Makes the format known to the session and lets predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records_of(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_length, refers_to, payload of each page.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is the response (all rows of
    that id, where it is repeated); the others revisit it and carry no payload. Null html is empty; rows with a null id
    are responses.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # ids and digests find the revisits; bodies are dealt by page id, never by digest, which many pages may share
    keys = own.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).where((F.col("payload_length") >= least) & F.col("page_id").isNotNull())
    first = keys.groupBy("_digest").agg(F.min("_id").alias("_first"))
    shared = keys.join(first, "_digest").where("_id > _first").distinct()
    named = own.where("page_id IS NOT NULL")
    both = named.join(shared, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    both = both.select(*own.columns, "_first").union(own.where("page_id IS NULL").withColumn("_first", F.lit(None).cast("long")))
    revisit = F.col("_first").isNotNull()
    return both.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "payload_digest",
        "payload_length",
        F.col("_first").alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """The query's whole way: a record per page is written to the shared folder, and the archives are read back.

    A response's digest and length come from the payload that was read, a revisit's from its headers. An empty table
    writes no record and gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    path = f"{shared_dir(spark)}/warc"
    records_of(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    own = F.col("record_type") != "revisit"
    return read.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
