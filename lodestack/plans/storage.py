"""Where long plans are cut, and snapshots are kept: written tables in the shared folder, swapped by a pointer."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a temporary folder that is set as such, and any
    other is refused: a machine's own folder is not seen by the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as a written table: the plan behind it is not run again, and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: a row's place from 1 in the given order, without one task that holds all rows: ranges are sorted and
    counted each for itself, and what is broadcast is a row for each range. Ties get different places."""
    own = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    local = own.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    counts = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    return local.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_local")).select(*df.columns, name)


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed as nothing has been written there yet; any other failure must not pass for that."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class SnapshotStore:
    """Named tables of immutable snapshots: each version is a folder, and one small table names the newest.

    One writer at a time. A version is written whole before the pointer names it, so readers never see a part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def pointer(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("name string, version long, folder string").json(f"{self.root}/pointer")
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return None

    def version(self, name: str) -> tuple[int, str | None]:
        rows = self.pointer()
        found = rows.where(rows.name == name).orderBy(rows.version.desc()).first() if rows is not None else None
        return (found.version, found.folder) if found else (0, None)

    def write(self, name: str, df: DataFrame) -> int:
        version = self.version(name)[0] + 1
        folder = f"{self.root}/{name}/{version:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        self.spark.range(1).selectExpr(f"'{name}' AS name", f"{version}L AS version", f"'{folder}' AS folder").write.mode("append").json(f"{self.root}/pointer")
        return version

    def read(self, name: str) -> DataFrame:
        version, folder = self.version(name)
        if folder is None:
            raise KeyError(name)
        return self.spark.read.parquet(folder)

    def backup(self, target: str) -> None:
        """The newest version of every table, copied."""
        rows = self.pointer()
        for (name,) in rows.select("name").distinct().collect() if rows is not None else []:
            self.read(name).write.parquet(f"{target.rstrip('/')}/{name}")
