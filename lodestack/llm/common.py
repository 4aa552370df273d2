"""Helpers that the training-data operators share: shared storage, gapless numbering, word expressions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space between words, as a Java character class body: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
#: Shuffle files of a written table are removed at the end of its execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that one rank window holds at most on average (see gapless_rank).
RANK_BUCKET_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir. Where that is unset, a local master (tests, one machine) gets a
    temporary folder; on a cluster no folder is shared by itself, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestack/{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files are removed at its end: what is read again is a written table."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read again: later stages do not recompute it, lost executors cost nothing.

    Its shuffle files go when the table is there; ``drop_tables`` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Removes tables that write_table made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to.rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: a number from 0 without gaps among the rows of equal ``keys``.

    A key may hold any share of the rows: rows are dealt by (keys, bucket), buckets are hashes of ``order``, and a
    bucket's first number is the running sum of the counts of the buckets before it. ``df`` must be a written table
    (it is read twice). Ties in ``order`` get different numbers, in no defined order.
    """
    buckets = 1 + df.count() // RANK_BUCKET_ROWS
    by = [*keys, "_bucket"]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    counts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_base"))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    return local.join(base, on).withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).select(*df.columns, name)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")

