"""More registered queries: endpoints, ranges, routes, membership, rollups and proof checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import consensus, merkle, network, state, stats
from tessera.plans import ledger_model as m
from tessera.plans.catalog import _state, query


# Addresses and whether each is not public.
_HOSTS = (
    ("8.8.8.8", False), ("10.1.2.3", True), ("0.1.2.3", True), ("127.0.0.1", True), ("169.254.1.1", True), ("169.253.1.1", False), ("172.16.0.1", True), ("172.32.0.1", False),
    ("192.168.4.4", True), ("100.64.0.1", True), ("100.128.0.1", False), ("198.18.7.7", True), ("198.20.7.7", False), ("192.0.2.9", True), ("192.0.3.9", False), ("198.51.100.1", True),
    ("203.0.113.5", True), ("203.0.114.5", False), ("224.0.0.1", True), ("255.255.255.255", True), ("223.255.0.1", False), ("::1", True), ("::", True), ("fe80::1", True), ("fd00::1", True),
    ("ff02::1", True), ("2001:db8::1", True), ("2001:4860::8", False), ("::ffff:10.0.0.1", True), ("::ffff:8.8.4.4", False),
)


@query("w_h AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{host}', {str(private).lower()})" for i, (host, private) in enumerate(_HOSTS)) + f") v(i, host, private)) SELECT CASE WHEN strpos(host, ':') > 0 THEN '[' || host || ']' ELSE host END || ':' || (50000 + s_suppkey) AS endpoint, host, CAST(50000 + s_suppkey AS INTEGER) AS port, private FROM supplier JOIN w_h ON s_suppkey % {len(_HOSTS)} = i")
def q_endpoint_class(spark, d):
    host = F.array(*(F.lit(h) for h, _ in _HOSTS))[(F.col("s_suppkey") % len(_HOSTS)).cast("int")]
    text = F.concat(F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.lit(":"), (50000 + F.col("s_suppkey")).cast("string"))
    endpoints = m.table(spark, d, "supplier").select(text.alias("endpoint"))
    host, port = network.host_and_port(F.col("endpoint"))
    return endpoints.select("endpoint", host.alias("host"), port.alias("port")).withColumn("private", network.is_private(F.col("host")))


@query(" SELECT endpoint, unnest([first_seq, last_seq + 100]) AS first, unnest([last_seq, last_seq + 100]) AS last FROM peers")
def q_ledger_ranges(spark, d):
    text = F.concat(F.col("first_seq").cast("string"), F.lit("-"), F.col("last_seq").cast("string"), F.lit(", "), (F.col("last_seq") + 100).cast("string"), F.lit(",empty"))
    return m.peers(spark, d).select("endpoint", F.explode(network.ledger_ranges(text)).alias("r")).select("endpoint", "r.first", "r.last")


@query(" SELECT seq, CASE WHEN seq % 2 = 0 THEN 'xahau' END AS network, CASE WHEN seq % 2 = 0 THEN hash END AS tx_hash FROM ledgers")
def q_route(spark, d):
    target = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("/network/xahau/tx/"), F.upper("hash"), F.lit("?full=1"))).otherwise(F.concat(F.lit("/net/"), "hash"))
    name, tx_hash = network.route(target)
    return m.ledgers(spark, d).select("seq", name.alias("network"), tx_hash.alias("tx_hash"))


@query("w_k AS (SELECT DISTINCT key FROM delta WHERE seq <= 20), w_m AS (SELECT DISTINCT substr(key, 1, 5) AS mark FROM w_k), w_r AS (SELECT substr(key, 1, 5) IN (SELECT mark FROM w_m) AS probable, key IN (SELECT key FROM w_k) AS present FROM delta WHERE seq <= 40) SELECT count(*) FILTER (probable) AS probable, count(*) FILTER (present) AS present, count(*) FILTER (probable AND NOT present) AS mistaken, count(*) FILTER (present AND NOT probable) AS missed FROM w_r")
def q_membership(spark, d):
    """Keys that an earlier set probably holds, by fingerprints in buckets, and how often that is mistaken."""
    delta = m.delta(spark, d)
    known = delta.where("seq <= 20").select("key").distinct()
    rows = state.probable_members(delta.where("seq <= 40").select("key"), known).join(known.withColumn("known", F.lit(True)), "key", "left")
    rows = rows.withColumn("present", F.col("known").isNotNull())
    return rows.agg(F.count_if(F.col("probable")).alias("probable"), F.count_if(F.col("present")).alias("present"), F.count_if(F.expr("probable and not present")).alias("mistaken"), F.count_if(F.expr("present and not probable")).alias("missed"))


@query(" SELECT seq, key FROM (SELECT seq, key, dense_rank() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM delta) WHERE r <= 2")
def q_newest_versions(spark, d):
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return m.delta(spark, d).withColumn("r", rank).where("r <= 2").select("seq", "key")


@query("""w_v AS (SELECT validator, (validator + us // 1000000) % 7 AS peer_id, count(*) AS votes FROM validations WHERE validator <= 40 GROUP BY 1, 2),
w_o AS (SELECT *, row_number() OVER (ORDER BY votes DESC, validator, peer_id) AS r FROM w_v),
w_g AS (WITH RECURSIVE g(r, vs, ps, v, p, n) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL SELECT o.r, CASE WHEN ok THEN list_append(vs, validator) ELSE vs END, CASE WHEN ok THEN list_append(ps, peer_id) ELSE ps END, CASE WHEN ok THEN validator END, CASE WHEN ok THEN peer_id END, CASE WHEN ok THEN votes END
  FROM (SELECT o.*, g.vs, g.ps, NOT list_contains(g.vs, o.validator) AND NOT list_contains(g.ps, o.peer_id) AS ok FROM g JOIN w_o o ON o.r = g.r + 1) o) SELECT * FROM g)
SELECT v AS validator, p AS peer_id, n AS votes FROM w_g WHERE v IS NOT NULL""")
def q_first_delivery_assignment(spark, d):
    """Forty validators compete for seven peers."""
    rows = m.validations(spark, d).where("validator <= 40").withColumn("peer_id", (F.col("validator") + F.floor(F.col("us") / 1_000_000)) % 7)
    return network.greedy_assignment(rows.groupBy("validator", "peer_id").agg(F.count(F.lit(1)).alias("votes")))


@query(" SELECT endpoint, bool_or(crawl) AS seen_crawl, bool_or(redirect) AS seen_redirect FROM (SELECT endpoint, true AS crawl, false AS redirect FROM peers WHERE success_count > 2 UNION ALL SELECT endpoint, false, true FROM peers WHERE failure_count > 2) GROUP BY 1")
def q_discovery_union(spark, d):
    peers = m.peers(spark, d)
    return network.union_sources(crawl=peers.where("success_count > 2"), redirect=peers.where("failure_count > 2"))


@query(" SELECT endpoint FROM peers WHERE success_count > 2 EXCEPT SELECT endpoint FROM peers WHERE failure_count > 2")
def q_undiscovered(spark, d):
    peers = m.peers(spark, d)
    return peers.where("success_count > 2").select("endpoint").join(peers.where("failure_count > 2"), "endpoint", "left_anti")


@query(" SELECT seq, CAST(CASE op WHEN 4 THEN 'upsert' ELSE 'remove' END AS VARCHAR) AS kind, count(*) AS n FROM delta GROUP BY CUBE (seq, 2)")
def q_node_type_cube(spark, d):
    return m.delta(spark, d).cube("seq", F.when(F.col("op") == 4, "upsert").otherwise("remove").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("w_p AS (SELECT type, bytes, row_number() OVER (PARTITION BY type ORDER BY bytes DESC, event_id) AS r FROM packets) SELECT type, bytes, CAST(r AS INTEGER) AS rank FROM w_p WHERE r <= 5")
def q_largest_packets(spark, d):
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("bytes"), "event_id"))
    return m.packets(spark, d).withColumn("rank", rank).where("rank <= 5").select("type", "bytes", "rank")


@query(" SELECT type, CAST(us // 60000000 AS BIGINT) AS minute, count(*) AS n, round(count(*) / max(count(*)) OVER (PARTITION BY type), 6) AS level FROM packets GROUP BY 1, 2")
def q_throughput_graph(spark, d):
    minutes = m.packets(spark, d).groupBy("type", F.floor(F.col("us") / 60_000_000).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return minutes.withColumn("level", F.round(F.col("n") / F.max("n").over(Window.partitionBy("type")), 6))


@query(" SELECT record_id, count(*) AS n, string_agg(field, ',' ORDER BY field) AS names FROM fields_ WHERE depth = 1 GROUP BY 1")
def q_top_level_fields(spark, d):
    top = m.fields(spark, d).where("depth = 1")
    return top.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("names"))


@query(_state(40, "state_b") + " SELECT count(*) AS leaves, CAST(sum(strlen(data)) AS BIGINT) AS bytes, min(seq) AS oldest, max(seq) AS newest FROM state_b")
def q_state_health(spark, d):
    return state.state_asof(m.delta(spark, d), 40).agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.octet_length("data")).alias("bytes"), F.min("seq").alias("oldest"), F.max("seq").alias("newest"))


@query(" SELECT type, uses, rank FROM (SELECT type, count(*) AS uses, CAST(row_number() OVER (ORDER BY count(*) DESC, type) AS INTEGER) AS rank FROM tx GROUP BY 1) WHERE rank <= 3")
def q_top_types(spark, d):
    return stats.top_per(m.tx(spark, d).withColumn("g", F.lit(1)), ["g"], "type", 3).drop("g")


@query(" SELECT ledger_seq, validators, validators >= (n * 80 + 99) // 100 AS reached FROM (SELECT ledger_seq, count(DISTINCT validator) AS validators FROM validations GROUP BY 1), (SELECT count(DISTINCT validator) AS n FROM validations)")
def q_quorum_of_known(spark, d):
    votes = m.validations(spark, d)
    known = votes.agg(F.countDistinct("validator").alias("n")).withColumn("one", F.lit(1))
    per = votes.groupBy("ledger_seq").agg(F.countDistinct("validator").alias("validators")).withColumn("one", F.lit(1))
    return per.join(F.broadcast(known), "one").select("ledger_seq", "validators", (F.col("validators") >= consensus.threshold_for(F.col("n"), 80)).alias("reached"))  # one row


@query(_state(40, "state_b") + " SELECT substr(key, 1, 1) AS branch, count(*) AS leaves FROM state_b GROUP BY 1")
def q_branch_sizes(spark, d):
    return merkle.branch_hashes(state.state_asof(m.delta(spark, d), 40), 1).select(F.col("path").alias("branch"), F.col("n").alias("leaves"))
