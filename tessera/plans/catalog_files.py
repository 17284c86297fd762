"""Registered queries over catalogue files and number formats: files are built on the executors and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.plans import ledger_model as m
from tessera.plans.catalog import query
from tessera.sources import catalogue

SPAN = 16


def _files(spark, d, level: int = 0):
    return catalogue.write_files(m.delta(spark, d), m.ledgers(spark, d), SPAN, level)


@query(" SELECT seq, key, op, data FROM delta")
def q_catalogue_items(spark, d):
    """A history written to deflated files and read back."""
    found = catalogue.as_delta(catalogue.items_of(_files(spark, d, 6)))
    return found.select("seq", "key", "op", F.col("data").cast("string").alias("data"))


@query(" SELECT CAST(seq AS BIGINT) AS seq, hash, coalesce(parent_hash, repeat('0', 64)) AS parent_hash, close_time, (seq // 16) || '.catalogue' AS file FROM ledgers")
def q_catalogue_ledgers(spark, d):
    found = catalogue.ledgers_of(_files(spark, d))
    return found.select("seq", F.lower(F.hex("hash")).alias("hash"), F.lower(F.hex("parent_hash")).alias("parent_hash"), "close_time", "file")


@query(" SELECT (seq // 16) || '.catalogue' AS path, (seq // 16) % 2 = 0 AS valid FROM ledgers GROUP BY ALL")
def q_catalogue_hashes(spark, d):
    """Each second file has a byte changed behind its header."""
    damaged = F.concat(F.substring("content", 1, 100), F.lit(b"\x07"), F.expr("substring(content, 102)"))
    files = _files(spark, d).withColumn("content", F.when(F.split("path", "[.]")[0].cast("int") % 2 == 1, damaged).otherwise(F.col("content")))
    return catalogue.hashes_of(files).select("path", "valid")


@query(" SELECT (seq // 16) || '.catalogue' AS path, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (op = 254) AS BIGINT) AS removals, min(key) AS first_key FROM delta GROUP BY 1")
def q_catalogue_summary(spark, d):
    items = catalogue.items_of(_files(spark, d), with_data=False)
    return items.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("type") == catalogue.REMOVE).alias("removals"), F.lower(F.hex(F.min("key"))).alias("first_key"))


def _hex_of(encode):
    """A column function: the hex of a number's encoding."""

    @F.pandas_udf("string")
    def run(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda n: encode(int(n)).hex())

    return run


def _back(decode):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: decode(bytes.fromhex(t), 0)[0])

    return run


def _varint_sql(base: int) -> str:
    digit = f"((n // CAST(power({base}, i) AS BIGINT)) % {base})"
    return f"w_n AS (SELECT o_orderkey, o_orderkey * 1000003 AS n FROM orders), w_k AS (SELECT *, greatest(1, len(list_filter(range(0, 9), lambda i: n >= CAST(power({base}, i) AS BIGINT)))) AS k FROM w_n) SELECT o_orderkey, n, array_to_string(list_transform(range(0, k), lambda i: printf('%02x', {digit} + CASE WHEN i < k - 1 THEN 128 ELSE 0 END)), '') AS code, n AS back FROM w_k"


def _varints(spark, d, encode, decode):
    rows = m.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1_000_003).alias("n"))
    return rows.withColumn("code", _hex_of(encode)("n")).withColumn("back", _back(decode)("code"))


@query(_varint_sql(128))
def q_leb128(spark, d):
    return _varints(spark, d, codec.leb128, codec.read_leb128)


@query(_varint_sql(127))
def q_base127(spark, d):
    return _varints(spark, d, codec.base127, codec.read_base127)


@query("w_n AS (SELECT o_orderkey, o_orderkey * 7919 % 918745 AS n FROM orders) SELECT o_orderkey, n, CASE WHEN n <= 192 THEN printf('%02x', n) WHEN n <= 12480 THEN printf('%02x%02x', 193 + (n - 193) // 256, (n - 193) % 256) ELSE printf('%02x%02x%02x', 241 + (n - 12481) // 65536, (n - 12481) // 256 % 256, (n - 12481) % 256) END AS code, n AS back FROM w_n")
def q_length_prefix(spark, d):
    rows = m.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 918745).alias("n"))
    return rows.withColumn("code", _hex_of(codec.vl_prefix)("n")).withColumn("back", _back(codec.read_vl)("code"))
