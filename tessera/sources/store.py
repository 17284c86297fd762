"""Histories and content-addressed nodes as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 1000  # versions in a partition


def write_history(delta: DataFrame, path: str, span: int = SPAN) -> None:
    """A history partitioned by ranges of versions and sorted by key within, so that scans are pruned both ways."""
    rows = delta.withColumn("span", F.floor(F.col("seq") / span).cast("int"))
    rows.repartition("span", F.substring("key", 1, 2)).sortWithinPartitions("key", "seq").write.partitionBy("span").parquet(path)


def read_history(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, span: int = SPAN) -> DataFrame:
    """The rows of [start, end]; partitions outside are not read."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("span") >= start // span) & (F.col("seq") >= start))
    if end is not None:
        rows = rows.where((F.col("span") <= end // span) & (F.col("seq") <= end))
    return rows.drop("span")


def insert_nodes(spark: SparkSession, path: str, nodes: DataFrame) -> int:
    """Appends nodes (hash, node_type, payload) that the store lacks; returns how many. Equal hashes come once."""
    new, before = nodes.dropDuplicates(["hash"]), 0
    if _there(spark, path):
        store = spark.read.parquet(path)
        before = store.count()
        new = new.join(store.select("hash"), "hash", "left_anti")
    new.withColumn("bucket", F.substring("hash", 1, 1)).write.mode("append").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).count() - before


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fetch_node(spark: SparkSession, path: str, node_hash: str) -> DataFrame:
    """One node; only its bucket is read."""
    return spark.read.parquet(path).where((F.col("bucket") == node_hash[0]) & (F.col("hash") == node_hash)).drop("bucket")


def settled(df: DataFrame) -> DataFrame:
    """df, made once for plans that read it many times: written to spark.checkpoint.dir, or cached where that is not set.

    Both survive a lost executor: what was written is shared, what was cached is made again.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
