"""The canonical relations of a ledger history, derived from the driver's tables.

ledgers, delta, tx, packets, validations, proposals, fields, blobs and peers, each as a DataFrame and as
SQL (PRELUDE, for checking). A version (seq) is a month of orders; a key is a customer; a delta row is the
customer's last order of the month, a removal if its priority is low.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPSERT, REMOVE = 4, 254


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_seq(orders: DataFrame) -> DataFrame:
    month = F.date_trunc("month", F.col("o_orderdate"))
    # Versions are numbered on the table of different months, not on all orders.
    months = orders.select(month.alias("month")).distinct()
    months = months.withColumn("seq", F.row_number().over(Window.orderBy("month")))
    return orders.withColumn("month", month).join(months, "month")


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, op, data: a row for each key that a version changes."""
    orders = _with_seq(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"))
    last = orders.groupBy("seq", "o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey").alias("o"))
    removed = F.col("o.o_orderpriority") == "5-LOW"
    return last.select(
        "seq",
        F.sha2(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).cast("binary"), 256).alias("key"),
        F.when(removed, REMOVE).otherwise(UPSERT).alias("op"),
        F.when(~removed, F.concat_ws("|", "o.o_orderstatus", F.col("o.o_orderkey").cast("string"))).alias("data"),
    )


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, close_time (unix seconds), n_tx, hash, parent_hash: a header for each version."""
    orders = _with_seq(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    rows = orders.groupBy("seq").agg(F.unix_micros(F.min("month").cast("timestamp")).alias("us"), F.count(F.lit(1)).alias("n_tx"), F.sum("o_orderkey").alias("check"))
    own = F.sha2(F.concat_ws(":", F.col("seq").cast("string"), F.col("n_tx").cast("string"), F.col("check").cast("string")).cast("binary"), 256)
    rows = rows.select("seq", (F.col("us") / 1_000_000).cast("long").alias("close_time"), "n_tx", own.alias("hash"))
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("parent_hash"))
    return rows.join(before, "seq", "left")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, tx_id, type, bytes: a row for each order line (ids repeat by construction)."""
    orders = _with_seq(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", "seq")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    ident = F.sha2(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).cast("binary"), 256)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("seq", ident.alias("tx_id"), F.concat("l_returnflag", "l_linestatus").alias("type"), F.col("l_quantity").cast("long").alias("bytes"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us (unix microseconds), peer_id, type, bytes."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts", F.col("user_id").alias("peer_id"), F.col("event_type").alias("type"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ledger_seq, validator, us."""
    rows = packets(spark, sf_dir).where(F.col("type").isin("purchase", "click"))
    return rows.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("ledger_seq"), F.col("peer_id").alias("validator"), "us")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, validator, propose_seq, tx_set, us, event_id."""
    rows = packets(spark, sf_dir).withColumn("round", F.datediff(F.to_date("ts"), F.lit("2024-01-01")))
    order = Window.partitionBy("round", "peer_id").orderBy("us", "event_id")
    return rows.select("round", F.col("peer_id").alias("validator"), F.row_number().over(order).alias("propose_seq"), F.col("type").alias("tx_set"), "us", "event_id")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, field, size, depth, value: the columns of customers and orders as decoded fields."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parts = [
        (customers, "c", "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"], 1),
        (orders, "o", "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], 2),
    ]
    out = None
    for df, tag, ident, names, depth in parts:
        pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
        own = df.select(F.concat(F.lit(tag), F.col(ident).cast("string")).alias("record_id"), F.explode(pairs).alias("f"))
        own = own.select("record_id", "f.field", F.length("f.value").cast("long").alias("size"), F.lit(depth).alias("depth"), "f.value")
        out = own if out is None else out.unionByName(own)
    return out


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, node_type, bytes: content-addressed nodes; transaction leaves are tx_leaf."""
    state = delta(spark, sf_dir).where("op = 4").select(F.sha2(F.col("data").cast("binary"), 256).alias("hash"), F.lit("state_leaf").alias("node_type"), F.octet_length("data").cast("long").alias("bytes"))
    leaves = tx(spark, sf_dir).select(F.col("tx_id").alias("hash"), F.lit("tx_leaf").alias("node_type"), "bytes")
    lines = table(spark, sf_dir, "part").select(F.sha2(F.col("p_brand").cast("binary"), 256).alias("hash"), F.lit("state_inner").alias("node_type"), F.octet_length("p_brand").cast("long").alias("bytes"))
    return state.unionByName(leaves).unionByName(lines)


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """endpoint, first_seq, last_seq, success_count, failure_count, connected_ok, last_seen_at, last_success_at, last_failure_at, seen_*."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("10.0."), (F.col("s_suppkey") % 250).cast("string"), F.lit(":"), (F.lit(50000) + F.col("s_suppkey")).cast("string")).alias("endpoint"),
        F.col("s_nationkey").cast("long").alias("first_seq"),
        (F.col("s_nationkey") + F.col("s_suppkey") % 40).alias("last_seq"),
        (F.col("s_suppkey") % 7).alias("success_count"),
        (F.col("s_suppkey") % 5).alias("failure_count"),
        (F.col("s_suppkey") % 3 == 0).alias("connected_ok"),
        (F.lit(1_700_000_000) + F.col("s_suppkey") * 37 % 5000).alias("last_seen_at"),
        F.when(F.col("s_suppkey") % 7 == 0, 0).otherwise(F.lit(1_700_000_000) + F.col("s_suppkey") * 53 % 11).alias("last_success_at"),
        F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(F.lit(1_700_000_000) + F.col("s_suppkey") * 59 % 13).alias("last_failure_at"),
        (F.col("s_suppkey") % 2 == 0).alias("seen_crawl"),
        (F.col("s_suppkey") % 3 == 1).alias("seen_endpoints"),
        (F.col("s_suppkey") % 4 == 1).alias("seen_redirect"),
    )


#: The same relations for DuckDB, to stand before a SELECT.
PRELUDE = """
WITH o_ AS (SELECT *, dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate)) AS seq FROM orders),
delta AS (SELECT CAST(seq AS INTEGER) AS seq, sha256('k' || o_custkey) AS key, CASE WHEN o_orderpriority = '5-LOW' THEN 254 ELSE 4 END AS op,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus || '|' || o_orderkey END AS data
          FROM o_ QUALIFY row_number() OVER (PARTITION BY seq, o_custkey ORDER BY o_orderkey DESC) = 1),
l_ AS (SELECT CAST(seq AS INTEGER) AS seq, CAST(epoch(min(date_trunc('month', o_orderdate))) AS BIGINT) AS close_time, count(*) AS n_tx,
              sha256(seq || ':' || count(*) || ':' || CAST(sum(o_orderkey) AS BIGINT)) AS hash FROM o_ GROUP BY seq),
ledgers AS (SELECT a.*, b.hash AS parent_hash FROM l_ a LEFT JOIN l_ b ON a.seq = b.seq + 1),
tx AS (SELECT CAST(seq AS INTEGER) AS seq, sha256(l_orderkey || '-' || l_linenumber) AS tx_id, l_returnflag || l_linestatus AS type, CAST(l_quantity AS BIGINT) AS bytes
       FROM lineitem JOIN o_ ON l_orderkey = o_orderkey),
packets AS (SELECT event_id, epoch_us(ts) AS us, ts, user_id AS peer_id, event_type AS type, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events),
validations AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS ledger_seq, peer_id AS validator, us FROM packets WHERE type IN ('purchase', 'click')),
proposals AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS round, peer_id AS validator,
                     CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE), peer_id ORDER BY us, event_id) AS INTEGER) AS propose_seq, type AS tx_set, us, event_id FROM packets),
fields AS (SELECT 'c' || c_custkey AS record_id, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS field, unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value, 1 AS depth FROM customer
           UNION ALL
           SELECT 'o' || o_orderkey, unnest(['o_custkey', 'o_orderstatus', 'o_orderpriority']), unnest([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]), 2 FROM orders),
fields_ AS (SELECT record_id, field, CAST(length(value) AS BIGINT) AS size, depth, value FROM fields),
blobs AS (SELECT sha256(data) AS hash, 'state_leaf' AS node_type, CAST(strlen(data) AS BIGINT) AS bytes FROM delta WHERE op = 4
          UNION ALL SELECT tx_id, 'tx_leaf', bytes FROM tx
          UNION ALL SELECT sha256(p_brand), 'state_inner', CAST(strlen(p_brand) AS BIGINT) FROM part),
peers AS (SELECT '10.0.' || (s_suppkey % 250) || ':' || (50000 + s_suppkey) AS endpoint, CAST(s_nationkey AS BIGINT) AS first_seq, s_nationkey + s_suppkey % 40 AS last_seq,
                 s_suppkey % 7 AS success_count, s_suppkey % 5 AS failure_count, s_suppkey % 3 = 0 AS connected_ok, 1700000000 + s_suppkey * 37 % 5000 AS last_seen_at,
                 CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1700000000 + s_suppkey * 53 % 11 END AS last_success_at, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1700000000 + s_suppkey * 59 % 13 END AS last_failure_at,
                 s_suppkey % 2 = 0 AS seen_crawl, s_suppkey % 3 = 1 AS seen_endpoints, s_suppkey % 4 = 1 AS seen_redirect FROM supplier)
"""
