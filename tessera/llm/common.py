"""Reading, shared scratch tables and array helpers used by the llm operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once by the array code; longer texts are cut into overlapping segments.
SEGMENT = 1 << 18
BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one only where none is set and all runs on one machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/tessera"


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage.

    free: also asks for the driver's garbage to be collected, upon which Spark removes the shuffle files
    of plans that are done with.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def distinct_texts(docs: DataFrame, *aggs) -> DataFrame:
    """One row for each different text (null counts as empty): t1, t2 (128 hash bits), text and aggs."""
    keyed = with_text_key(docs)
    return keyed.groupBy("t1", "t2").agg(F.first("text").alias("text"), *aggs)


def with_text_key(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, text (null as empty), t1 and t2 (128 hash bits of it) and the named others of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), *others, F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


#: A key with over one in HOT rows is dealt to SPREAD tasks; there are fewer than HOT such keys.
HOT, SPREAD, FEW = 1000, 128, 256


def hot_keys(rows: DataFrame, *keys: str) -> list[int]:
    """Hashes of the keys that hold more than one in HOT of the rows: fewer than HOT, whatever the table's size."""
    most = max(rows.count() // HOT, FEW)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(f"_rows > {most}")
    return [r["h"] for r in found.select(F.xxhash64(*keys).alias("h")).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """left joined with right, whose keys are unique and of the same types; hot keys of left go to several tasks by its columns `by`.

    left is read twice if hot is not given, so it should be a written table.
    """
    hot = hot_keys(left, *keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")).otherwise(0))
    copied = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


# ---- arrays -----------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column without nulls, and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def segments(offsets: np.ndarray, reach: int, size: int = SEGMENT):
    """Cuts a column into pieces of about size bytes.

    Yields (rows, starts, stops, firsts): one or more whole texts, or one segment of a long text whose
    bytes overlap the next by reach - 1. firsts is what to add to a position to get it in its text.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > size:
            for a in range(int(offsets[i]), int(offsets[i + 1]) - reach + 1, size):
                b = min(a + size + reach - 1, int(offsets[i + 1]))
                yield np.array([i]), np.array([a]), np.array([b]), np.array([a - offsets[i]])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1], np.zeros(j - i, np.int64)
        i = j


_TABLES: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of random values for bytes, and the base's powers and their inverses modulo 2**64."""
    if "byte" not in _TABLES:
        _TABLES["byte"] = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
    if len(_TABLES.get("pw", ())) < n:
        with np.errstate(over="ignore"):
            for key, base in (("pw", BASE), ("ipw", _BASE_INV)):
                a = np.full(n + 1024, base, dtype=np.uint64)
                a[0] = 1
                _TABLES[key] = np.cumprod(a)
    return _TABLES["byte"], _TABLES["pw"], _TABLES["ipw"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Polynomial hashes of any substring of data in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        table, pw, self.ipw = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * pw[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.ipw[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.ipw[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by running minima within blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def window_runs(grams: np.ndarray, starts: np.ndarray, stops: np.ndarray, k: int, window: int):
    """Groups the windows of each unit (document) by the gram of least hash in them.

    grams[i] is the hash of items i..i+k-1; a unit holds items starts[u]..stops[u]-1. Equal windows choose
    the same gram at the same place, wherever they are. Returns unit, first window, number of windows and
    the gram's hash of each maximal run of windows with one choice.
    """
    w = window - k + 1
    where = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)  # pieces hold fewer than 2**24 items
    chosen = sliding_min((grams & ~low) | where, w) & low
    count = np.maximum(stops - starts - window + 1, 0)
    unit = np.repeat(np.arange(len(starts)), count)
    if not len(unit):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count) + starts[unit]
    chosen = chosen[at]
    head = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (unit[1:] != unit[:-1])])
    size = np.diff(np.r_[head, len(unit)])
    return unit[head], at[head], size, grams[chosen[head].astype(np.int64)]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind))


def cut(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The byte strings data[starts[i]:stops[i]] as a binary column."""
    size = stops - starts
    ends = np.cumsum(size)
    pick = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(starts, size)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[pick]))])


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]
