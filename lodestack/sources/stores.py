"""Content stores as Parquet: chunks sharded by the first two digits of their hash, and files from disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.content import integrity_failures
from lodestack.plans.storage import is_missing
from lodestack.schema import CHUNKS


class ChunkStore:
    """put writes what is new; get reads by hash, opening only the shards that the hashes lie in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def all(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], CHUNKS).withColumn("shard", F.substring("hash", 1, 2))

    def put(self, chunks: DataFrame) -> None:
        new = chunks.select("hash", "len", "bytes").dropDuplicates(["hash"]).join(self.all().select("hash"), "hash", "left_anti")
        new.withColumn("shard", F.substring("hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(self.path)

    def get(self, hashes: DataFrame, verify: bool = False) -> DataFrame:
        """hash, len, bytes; verified reads fail where bytes don't have their hash."""
        own = hashes.select("hash", F.substring("hash", 1, 2).alias("shard")).distinct()
        got = self.all().join(own, ["shard", "hash"], "left_semi").select("hash", "len", "bytes")
        if verify:
            bad = F.sha2("bytes", 256) != F.col("hash")
            got = got.withColumn("hash", F.when(bad, F.raise_error(F.concat(F.lit("corrupt chunk "), "hash")).cast("string")).otherwise(F.col("hash")))
        return got

    def failures(self) -> DataFrame:
        return integrity_failures(self.all())


def files_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """path, data, size, mtime (seconds) of files in a folder, with their ages for a sweep."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select("path", F.col("content").alias("data"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def jdbc_tables(spark: SparkSession, url: str, names: list[str], **options: str) -> dict[str, DataFrame]:
    """Metadata tables of a relational store by JDBC (its driver has to be on the class path)."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}
