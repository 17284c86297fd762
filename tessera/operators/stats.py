"""Field, key, blob and bucket statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def field_usage(fields: DataFrame) -> DataFrame:
    return fields.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 6).alias("avg_size"), F.max("depth").alias("max_depth"))


def top_per(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values in each group (ties: smaller value first): group, value, uses, rank."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("uses"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("uses"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def frequency(df: DataFrame, value: str) -> DataFrame:
    """value, uses and its percentage of all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("uses"))
    return counts.withColumn("pct", F.round(100 * F.col("uses") / F.sum("uses").over(Window.partitionBy(F.lit(1))), 6))


def field_combinations(fields: DataFrame) -> DataFrame:
    """The sets of fields that occur together in a record, and how often."""
    sets = fields.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("combination"))
    return sets.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


def field_pairs(fields: DataFrame) -> DataFrame:
    """Pairs of fields in one record (a record has few fields), and how often."""
    sets = fields.groupBy("record_id").agg(F.array_sort(F.collect_set("field")).alias("f"))
    pairs = sets.select(F.explode(F.expr("flatten(transform(f, (a, i) -> transform(slice(f, i + 2, size(f)), b -> struct(a AS field_a, b AS field_b))))")).alias("p"))
    return pairs.groupBy("p.field_a", "p.field_b").agg(F.count(F.lit(1)).alias("n"))


def array_stats(df: DataFrame, owner: str) -> DataFrame:
    """Count, average, least and most of the rows each owner has; zeros when there is none."""
    per = df.groupBy(owner).agg(F.count(F.lit(1)).alias("length"))
    zero = F.lit(0).cast("long")
    return per.agg(F.count(F.lit(1)).alias("arrays"), F.coalesce(F.round(F.avg("length"), 6), F.lit(0.0)).alias("avg_length"), F.coalesce(F.min("length"), zero).alias("min_length"), F.coalesce(F.max("length"), zero).alias("max_length"))


def key_access(delta: DataFrame) -> DataFrame:
    return delta.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("op") == 254).alias("deletions"))


def compression_opportunity(fields: DataFrame, least: dict[str, tuple[int, int]]) -> DataFrame:
    """field, candidates, saved: bytes saved by references to values used over `least` times; least: field -> (uses, bytes each)."""
    rule = F.create_map(*(F.lit(x) for f, (n, b) in least.items() for x in (f, n)))
    saves = F.create_map(*(F.lit(x) for f, (n, b) in least.items() for x in (f, b)))
    used = fields.where(F.col("field").isin(list(least))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("uses"))
    over = used.where(F.col("uses") > rule[F.col("field")])
    return over.groupBy("field").agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col("uses") * saves[F.col("field")]).alias("saved"))


def summary(fields: DataFrame) -> DataFrame:
    return fields.agg(F.count(F.lit(1)).alias("total_fields"), F.sum("size").alias("bytes"), F.countDistinct("field").alias("unique_fields"), F.max("depth").alias("max_depth"), F.countDistinct("record_id").alias("records"))


def repetition(df: DataFrame, key: str, width: int = 32) -> DataFrame:
    """total, unique, average repetitions, and the size ratio of a dictionary with references of 1, 2 or 4 bytes."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"))
    ref = F.when(F.col("unique") <= 256, 1).when(F.col("unique") <= 65536, 2).otherwise(4)
    return one.withColumn("avg_reps", F.round(F.col("total") / F.col("unique"), 6)).withColumn("ratio", F.round(F.col("total") * width / (F.col("unique") * width + F.col("total") * ref), 6))


# ---- content-addressed nodes ----------------------------------------------------------------------


def dedup(blobs: DataFrame, keep: tuple[str, ...] = ("tx_leaf",), skip: tuple[str, ...] = ()) -> DataFrame:
    """One row for each hash (of the least type), but every row of the types in keep; none of the types in skip."""
    rows = blobs.where(~F.col("node_type").isin(list(skip))) if skip else blobs
    once = rows.where(~F.col("node_type").isin(list(keep))).groupBy("hash").agg(F.min(F.struct("node_type", "bytes")).alias("m")).select("hash", "m.node_type", "m.bytes")
    return once.unionByName(rows.where(F.col("node_type").isin(list(keep))).select("hash", "node_type", "bytes"))


def dedup_stats(blobs: DataFrame) -> DataFrame:
    per = blobs.groupBy("node_type", "hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("node_type").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"), F.sum(F.col("n") - 1).alias("duplicates"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def buckets(df: DataFrame, key: str, n: int) -> DataFrame:
    """bucket, entries, distinct_keys: rows dealt by the first 8 hex digits of a key."""
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n
    return df.groupBy(place.alias("bucket")).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct(key).alias("distinct_keys"))


def bucket_histogram(df: DataFrame, key: str, n: int) -> DataFrame:
    """entries, buckets, collisions (rows beyond each bucket's different keys); empty buckets count as 0 entries."""
    full = buckets(df, key, n)
    found = full.groupBy("entries").agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.col("entries") - F.col("distinct_keys")).alias("collisions"))
    empty = full.agg((F.lit(n) - F.count(F.lit(1))).alias("buckets")).select(F.lit(0).cast("long").alias("entries"), F.col("buckets").cast("long"), F.lit(0).cast("long").alias("collisions"))
    return found.unionByName(empty.where("buckets > 0"))


def orphans(values: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """What is in one table but not the other: key, problem (orphaned_value or missing_value)."""
    a, b = values.select(key).distinct(), keys.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("orphaned_value")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("missing_value")))
