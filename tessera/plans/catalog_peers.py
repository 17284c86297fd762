"""Registered queries over peers: candidates, ranges, choice for versions, eviction, rates over counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import peering
from tessera.plans import ledger_model as m
from tessera.plans.catalog import query

WANTED = [3, 17, 41]
_ASKED = "w_l AS (SELECT CAST(seq AS BIGINT) AS ledger_seq FROM ledgers)"
_PREFER = """CASE WHEN last_failure_at > 0 AND (last_success_at = 0 OR last_failure_at > last_success_at) THEN 1 ELSE 0 END, connected_ok DESC, last_success_at > 0 DESC, (first_seq <> 0 AND last_seq <> 0) DESC,
 last_success_at DESC, failure_count, last_failure_at, success_count DESC, current_seq DESC, last_seen_at DESC, endpoint"""
_COVERS = "(first_seq <> 0 AND last_seq <> 0 AND (3 BETWEEN first_seq AND last_seq OR 17 BETWEEN first_seq AND last_seq OR 41 BETWEEN first_seq AND last_seq))"


def _known(spark, d):
    return m.peers(spark, d).withColumn("current_seq", F.col("last_seq") + F.col("success_count"))


def _asked(spark, d):
    return m.ledgers(spark, d).select(F.col("seq").cast("long").alias("ledger_seq"))


@query(f"w_p AS (SELECT *, last_seq + success_count AS current_seq FROM peers) SELECT endpoint, CAST(r AS INTEGER) AS rank FROM (SELECT endpoint, row_number() OVER (ORDER BY {_COVERS} DESC, {_PREFER}) AS r FROM w_p) WHERE r <= 60")
def q_peer_candidates(spark, d):
    return peering.best_candidates(_known(spark, d), WANTED, 60).select("endpoint", "rank")


@query(""" SELECT endpoint, first, last FROM (SELECT endpoint, first, last, row_number() OVER (PARTITION BY endpoint ORDER BY (3 BETWEEN first AND last OR 17 BETWEEN first AND last OR 41 BETWEEN first AND last) DESC, last DESC, last - first DESC) AS r
 FROM (SELECT endpoint, unnest([1, first_seq + 1, 50]) AS first, unnest([1 + success_count, last_seq + 1, 50 + failure_count]) AS last FROM peers)) WHERE r = 1""")
def q_crawl_range(spark, d):
    """Of three ranges an endpoint shows."""
    three = F.array(
        F.struct(F.lit(1).cast("long").alias("first"), (1 + F.col("success_count")).alias("last")), F.struct((F.col("first_seq") + 1).alias("first"), (F.col("last_seq") + 1).alias("last")),
        F.struct(F.lit(50).cast("long").alias("first"), (50 + F.col("failure_count")).alias("last")),
    )
    return peering.best_range(m.peers(spark, d).select("endpoint", F.inline(three)), WANTED)


_FAILED = "w_f AS (SELECT ledger_seq, endpoint FROM w_l, peers WHERE (ledger_seq * 7 + last_seen_at) % 11 = 0 AND failure_count > 2)"


@query(_ASKED + "," + _FAILED + """, w_c AS (SELECT ledger_seq, endpoint, row_number() OVER (PARTITION BY ledger_seq ORDER BY (ledger_seq BETWEEN first_seq AND last_seq) DESC, greatest(last_seq - first_seq, 0) DESC, endpoint) AS r
 FROM w_l, peers WHERE NOT EXISTS (SELECT 1 FROM w_f WHERE w_f.ledger_seq = w_l.ledger_seq AND w_f.endpoint = peers.endpoint)) SELECT ledger_seq, endpoint, CAST(r AS INTEGER) AS rank FROM w_c WHERE r <= (SELECT least(6, greatest(1, count(*) // 3), 4) FROM peers)""")
def q_peers_for_ledger(spark, d):
    peers, asked = m.peers(spark, d), _asked(spark, d)
    some = F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda s: F.when((s * 7 + F.col("last_seen_at")) % 11 == 0, s.cast("long"))))
    failed = peers.where("failure_count > 2").select("endpoint", F.explode(some).alias("ledger_seq"))
    return peering.select_for(peers, asked, failed.join(asked, "ledger_seq", "left_semi"), 6)


@query(_ASKED + f""", w_p AS (SELECT *, last_seq + success_count AS current_seq, success_count % 3 AS selection_count, failure_count % 2 AS last_selected FROM peers) SELECT ledger_seq, endpoint FROM (
 SELECT ledger_seq, endpoint, row_number() OVER (PARTITION BY ledger_seq ORDER BY last_seq - first_seq, failure_count, selection_count, last_selected, {_PREFER}) AS r FROM w_l JOIN w_p ON first_seq <> 0 AND last_seq <> 0 AND ledger_seq BETWEEN first_seq AND last_seq) WHERE r = 1""")
def q_peer_for_ledger(spark, d):
    peers = _known(spark, d).withColumn("selection_count", F.col("success_count") % 3).withColumn("last_selected", F.col("failure_count") % 2)
    return peering.choose_for(peers, _asked(spark, d))


@query(" SELECT endpoint, CASE WHEN first_seq <> 0 AND last_seq <> 0 THEN last_seq - first_seq ELSE 0 END AS span FROM peers WHERE success_count <> 1 AND NOT (first_seq <> 0 AND last_seq <> 0 AND 20 BETWEEN first_seq AND last_seq) AND NOT (first_seq <> 0 AND last_seq <> 0 AND last_seq - first_seq > 30) ORDER BY 2, 1 LIMIT 1")
def q_peer_evict(spark, d):
    return peering.to_evict(m.peers(spark, d).withColumn("pending", F.when(F.col("success_count") == 1, 1).otherwise(0)), 20, 30).select("endpoint", "span")


@query(" SELECT name, CAST(row_number() OVER (ORDER BY CAST(substr(name, 6) AS BIGINT)) AS INTEGER) AS place FROM (SELECT DISTINCT 'peer-' || (s_suppkey * 7 % 120) AS name FROM supplier)")
def q_peer_names(spark, d):
    from pyspark.sql import Window

    names = m.table(spark, d, "supplier").select(F.concat(F.lit("peer-"), (F.col("s_suppkey") * 7 % 120).cast("string")).alias("name")).distinct()  # at most 120
    return names.select("name", F.row_number().over(Window.orderBy(*peering.natural_order(F.col("name")))).alias("place"))


_SAMPLES = """w_s AS (SELECT peer_id, us, event_id AS n, row_number() OVER w % 97 AS packets, CAST(sum(bytes) OVER w AS BIGINT) AS bytes, event_id % 53 <> 0 AS connected FROM packets WINDOW w AS (PARTITION BY peer_id ORDER BY us, event_id)),
w_b AS (SELECT *, CASE WHEN NOT connected OR packets < lag(packets) OVER w OR bytes < lag(bytes) OVER w THEN 1 ELSE 0 END AS b FROM w_s WINDOW w AS (PARTITION BY peer_id ORDER BY us, n)),
w_r AS (SELECT *, sum(b) OVER (PARTITION BY peer_id ORDER BY us, n) AS run, row_number() OVER (PARTITION BY peer_id ORDER BY us, n) AS i FROM w_b),
w_f AS (SELECT a.peer_id, a.n, min(b.i) AS i FROM w_r a JOIN w_r b ON a.peer_id = b.peer_id AND a.run = b.run AND b.connected AND a.connected AND b.i <= a.i AND b.i > a.i - 200 AND b.us >= a.us - 7200000000 GROUP BY 1, 2)"""


@query(_SAMPLES + """ SELECT a.peer_id, a.us, a.n, CASE WHEN a.us // 1000 > b.us // 1000 AND (a.us - b.us) // 1000 > 0 THEN round((a.packets - b.packets) * 1000 / ((a.us - b.us) // 1000), 6) ELSE 0.0 END AS packets_per_s,
 CASE WHEN (a.us - b.us) // 1000 > 0 THEN round((a.bytes - b.bytes) * 1000 / ((a.us - b.us) // 1000), 6) ELSE 0.0 END AS bytes_per_s FROM w_r a LEFT JOIN w_f f ON a.peer_id = f.peer_id AND a.n = f.n LEFT JOIN w_r b ON b.peer_id = f.peer_id AND b.i = f.i""")
def q_counter_rates(spark, d):
    """Counters that fall every 97 packets and connections that break; two hours, as the test events lie far apart."""
    from pyspark.sql import Window

    order = Window.partitionBy("peer_id").orderBy("us", "event_id")
    rows = m.packets(spark, d)
    samples = rows.select("peer_id", "us", F.col("event_id").alias("n"), (F.row_number().over(order) % 97).alias("packets"), F.sum("bytes").over(order).alias("bytes"), (F.col("event_id") % 53 != 0).alias("connected"))
    return peering.counter_rates(samples, 7200, 200)


@query("""w_v AS (SELECT validator, us, CASE WHEN us // 1000000 % 40 = 0 THEN 1 ELSE ledger_seq END AS seq, us // 1000 % 3 = 0 AS validated, row_number() OVER (PARTITION BY validator ORDER BY us, ledger_seq) AS i FROM validations)
 SELECT validator, us, seq, epoch FROM (SELECT *, CAST(sum(fell) OVER (PARTITION BY validator ORDER BY i) AS BIGINT) AS epoch FROM (SELECT *, CASE WHEN seq < last_value(CASE WHEN validated THEN seq END IGNORE NULLS) OVER (PARTITION BY validator ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fell FROM w_v))""")
def q_restart_epochs(spark, d):
    rows = m.validations(spark, d).select("validator", "us", "ledger_seq", F.when(F.floor(F.col("us") / 1_000_000) % 40 == 0, 1).otherwise(F.col("ledger_seq")).alias("seq"), (F.floor(F.col("us") / 1000) % 3 == 0).alias("validated"))
    return peering.restart_epochs(rows, ["validator"], "seq", ["us", "ledger_seq"]).select("validator", "us", "seq", "epoch")
