"""Versioned keyed state: as-of folds, classification, validity, slices, diffs and their algebra.

A history is delta(seq, key, op, data); a state is (key, data, seq); a diff is (key, change, old_data,
new_data). Everything is a grouped fold, a window within a key or an equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REMOVE = 254


def state_asof(delta: DataFrame, seq: int) -> DataFrame:
    """The last write of each key up to seq, without removed keys. One shuffle, combined on the map side."""
    last = delta.where(F.col("seq") <= seq).groupBy("key").agg(F.max_by(F.struct("op", "data", "seq"), "seq").alias("w"))
    return last.where(F.col("w.op") != REMOVE).select("key", "w.data", "w.seq")


def lookup(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def classify(delta: DataFrame) -> DataFrame:
    """What each row does to its key: ADD, UPDATE, REMOVE, or MISSING (a removal of nothing)."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    live = before.isNotNull() & (before != REMOVE)
    kind = F.when(F.col("op") == REMOVE, F.when(live, "REMOVE").otherwise("MISSING")).otherwise(F.when(live, "UPDATE").otherwise("ADD"))
    return delta.select("seq", "key", kind.alias("action"))


def set_items(delta: DataFrame, mode: str) -> DataFrame:
    """The outcome of each upsert under a mode: add_only, update_only or add_or_update; FAILED if it forbids it."""
    allowed = {"add_only": ["ADD"], "update_only": ["UPDATE"], "add_or_update": ["ADD", "UPDATE"]}[mode]
    upserts = classify(delta).where(F.col("action").isin("ADD", "UPDATE"))
    return upserts.select("seq", "key", F.when(F.col("action").isin(allowed), F.col("action")).otherwise("FAILED").alias("outcome"))


def operation_counts(delta: DataFrame) -> DataFrame:
    """seq, added, updated, deleted, missing, processed."""
    kinds = (("added", "ADD"), ("updated", "UPDATE"), ("deleted", "REMOVE"), ("missing", "MISSING"))
    return classify(delta).groupBy("seq").agg(*(F.count_if(F.col("action") == k).alias(n) for n, k in kinds), F.count(F.lit(1)).alias("processed"))


def validity(delta: DataFrame) -> DataFrame:
    """key, data, valid_from, valid_to (null while current) of every written value."""
    until = F.lead("seq").over(Window.partitionBy("key").orderBy("seq"))
    return delta.withColumn("valid_to", until).where(F.col("op") != REMOVE).select("key", "data", F.col("seq").alias("valid_from"), "valid_to")


def checked_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of the closed range; an empty or reversed range is an error."""
    if start > end:
        raise ValueError(f"the range {start}..{end} is reversed")
    return df.where(F.col("seq").between(start, end))


def slice_history(delta: DataFrame, start: int, end: int) -> DataFrame:
    """A history of its own for [start, end]: the whole state at start, then the later rows."""
    first = state_asof(delta, start).select(F.lit(start).alias("seq"), "key", F.lit(4).alias("op"), "data")
    return first.unionByName(checked_range(delta, start + 1, end).select("seq", "key", "op", "data"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change (added, modified, deleted), old_data, new_data."""
    a, b = old.select("key", F.col("data").alias("old_data"), F.lit(1).alias("a")), new.select("key", F.col("data").alias("new_data"), F.lit(1).alias("b"))
    both = a.join(b, "key", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("old_data").eqNullSafe(F.col("new_data")), "modified")
    return both.select("key", change.alias("change"), "old_data", "new_data").where("change is not null")


def apply_diff(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after a diff: key, data."""
    kept = state.select("key", "data").join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(changes.where("change <> 'deleted'").select("key", F.col("new_data").alias("data")))


def invert_diff(changes: DataFrame) -> DataFrame:
    flip = F.when(F.col("change") == "added", "deleted").when(F.col("change") == "deleted", "added").otherwise("modified")
    return changes.select("key", flip.alias("change"), F.col("new_data").alias("old_data"), F.col("old_data").alias("new_data"))


def overlay(base: DataFrame, edits: DataFrame) -> DataFrame:
    """An immutable base under edits (key, op, data): what a reader of both sees."""
    both = base.select("key", F.col("data").alias("base_data")).join(edits.select("key", "op", "data"), "key", "full_outer")
    return both.where("op is null or op <> 254").select("key", F.when(F.col("op").isNull(), F.col("base_data")).otherwise(F.col("data")).alias("data"))


def new_in(delta: DataFrame, seq: int) -> DataFrame:
    """Keys written in a version."""
    return delta.where((F.col("seq") == seq) & (F.col("op") != REMOVE)).select("key", "data")


def gaps(df: DataFrame, by: str, order: str) -> DataFrame:
    """by, previous, order, gap: places where consecutive numbers of a key are more than one apart."""
    before = F.lag(order).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("previous", before).withColumn("gap", F.col(order) - F.col("previous")).where("gap > 1").select(by, "previous", order, "gap")


def numbered(df: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """df with record_no, its place (from 0) by an integer key, without putting all rows in one task.

    Rows are counted in ranges of `width` keys; a range's first number is the sum of those before, which is
    a window over one row for each range.
    """
    ranged = df.withColumn("_r", F.floor(F.col(key) / width))
    sizes = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1
    return ranged.join(sizes.drop("_n"), "_r").withColumn("record_no", (F.col("_before") + inside).cast("long")).drop("_r", "_before")


def floor_of(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (n) the largest seq of index up to it. index is a table of versions, probes of numbers."""
    tagged = index.select(F.col("seq").alias("x"), F.col("seq"), F.lit(0).alias("probe")).unionByName(probes.select(F.col("n").alias("x"), F.lit(None).cast("int").alias("seq"), F.lit(1).alias("probe")))
    last = F.last("seq", ignorenulls=True).over(Window.orderBy("x", "probe").rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("found", last).where("probe = 1").select(F.col("x").alias("n"), F.col("found").alias("seq"))


def probable_members(rows: DataFrame, known: DataFrame, bucket: int = 3, mark: int = 2) -> DataFrame:
    """rows with probable: whether a fingerprint of their key (hex) is among those of known, never false for a member.

    A key's first digits are its bucket, the next ones its fingerprint there; only those are kept and moved.
    """
    parts = lambda df: df.withColumns({"_bucket": F.substring("key", 1, bucket), "_mark": F.substring("key", bucket + 1, mark)})
    marks = parts(known.select("key")).select("_bucket", "_mark").distinct().withColumn("_there", F.lit(True))
    found = parts(rows).join(marks, ["_bucket", "_mark"], "left")
    return found.withColumn("probable", F.col("_there").isNotNull()).drop("_bucket", "_mark", "_there")


def rekeyed(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with the keys that a mapping (old_key, new_key) replaces put right, once a mapping comes after its rows.

    Of several new keys for an old one the largest counts. Keys that are not mapped stay.
    """
    last = mapping.groupBy(F.col("old_key").alias(key)).agg(F.max("new_key").alias("_new"))
    return rows.join(last, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of the smallest hash of their key and a seed (a top-k, the same for every partitioning; all, if fewer)."""
    place = F.sha2(F.concat(F.lit(f"sample {seed} "), F.col(key).cast("string")).cast("binary"), 256)
    return rows.orderBy(place, key).limit(n)
