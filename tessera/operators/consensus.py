"""Quorums, proposal rounds, packet statistics and peer ranking over packet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_for(n, pct: int):
    """ceil(n * pct / 100), pct between 1 and 100."""
    return F.floor((n * max(1, min(100, pct)) + 99) / 100)


def quorum(validations: DataFrame, trusted: int, pct: int) -> DataFrame:
    """ledger_seq, validators of ledgers that enough different validators vouch for."""
    votes = validations.groupBy("ledger_seq").agg(F.countDistinct("validator").alias("validators"))
    return votes.where(F.col("validators") >= threshold_for(F.lit(trusted), pct))


def latest_positions(proposals: DataFrame) -> DataFrame:
    """Each validator's last proposal of a round (ties: the later row)."""
    last = proposals.groupBy("round", "validator").agg(F.max_by(F.struct("propose_seq", "tx_set"), F.struct("propose_seq", "us", "event_id")).alias("p"))
    return last.select("round", "validator", "p.propose_seq", "p.tx_set")


def winners(proposals: DataFrame) -> DataFrame:
    """round, tx_set, votes: the set with most latest positions (ties: smaller set)."""
    votes = latest_positions(proposals).groupBy("round", "tx_set").agg(F.count(F.lit(1)).alias("votes"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("votes"), "tx_set"))).where("r = 1").drop("r")


def converged(proposals: DataFrame) -> DataFrame:
    """Rounds in which all validators' last positions are one set."""
    per = latest_positions(proposals).groupBy("round").agg(F.min("tx_set").alias("tx_set"), F.max("tx_set").alias("top"), F.count(F.lit(1)).alias("validators"))
    return per.where("tx_set = top").select("round", "tx_set", "validators")


def set_to_acquire(proposals: DataFrame) -> DataFrame:
    """round, tx_set, validators of the last round but one, by first proposal, if it has converged; else no row."""
    begun = proposals.groupBy("round").agg(F.min(F.struct("us", "event_id")).alias("begun"))
    newest = begun.orderBy(F.desc("begun")).limit(2).agg(F.sort_array(F.collect_list(F.struct("begun", "round"))).alias("two"))
    asked = newest.where("size(two) = 2").select(F.col("two")[0]["round"].alias("round"))  # one row
    return converged(proposals.join(F.broadcast(asked), "round"))


def tx_set_summary(proposals: DataFrame) -> DataFrame:
    who = F.struct("us", "event_id")
    return proposals.groupBy("round", "tx_set").agg(
        F.countDistinct("validator").alias("validators"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("validator", who).alias("first_by"), F.max_by("validator", who).alias("last_by"),
    ).withColumn("delta_ms", ((F.col("last_us") - F.col("first_us")) / 1000).cast("long"))


def conflicts(proposals: DataFrame) -> DataFrame:
    """round, validator, propose_seq, sets: validators that sent different sets under one number of one round."""
    return proposals.groupBy("round", "validator", "propose_seq").agg(F.countDistinct("tx_set").alias("sets")).where("sets > 1")


def packet_stats(packets: DataFrame) -> DataFrame:
    return packets.groupBy("peer_id", "type").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))


def packet_rollup(packets: DataFrame) -> DataFrame:
    """By peer and type, by peer, and in all (nulls mark totals)."""
    return packets.rollup("peer_id", "type").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))


def rate(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """Packets a second in the time up to each packet: (last - first) counts over their time, 0 for one sample."""
    own = Window.partitionBy("peer_id").orderBy("us", "event_id")
    counted = packets.withColumn("n", F.row_number().over(own))
    back = Window.partitionBy("peer_id").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    first_n, first_us = F.min("n").over(back), F.min("us").over(back)
    rated = counted.withColumn("dn", F.col("n") - first_n).withColumn("dt", F.col("us") - first_us)
    return rated.select("event_id", "peer_id", F.when(F.col("dt") > 0, F.round(F.col("dn") * 1_000_000 / F.col("dt"), 6)).otherwise(F.lit(0.0)).alias("rate"))


def changes(packets: DataFrame) -> DataFrame:
    """Packets whose type differs from the peer's packet before."""
    before = F.lag("type").over(Window.partitionBy("peer_id").orderBy("us", "event_id"))
    return packets.withColumn("before", before).where(~F.col("type").eqNullSafe(F.col("before"))).select("event_id", "peer_id", "before", "type")


def time_gaps(packets: DataFrame, seconds: int) -> DataFrame:
    """Places where a peer is silent for longer than `seconds`."""
    before = F.lag("us").over(Window.partitionBy("peer_id").orderBy("us", "event_id"))
    return packets.withColumn("gap_us", F.col("us") - before).where(F.col("gap_us") > seconds * 1_000_000).select("event_id", "peer_id", "gap_us")


def first_deliveries(validations: DataFrame) -> DataFrame:
    """validator, first, n: how often each validator was the first to vouch for a ledger."""
    first = validations.groupBy("ledger_seq").agg(F.min(F.struct("us", "validator")).alias("f"))
    return first.groupBy(F.col("f.validator").alias("validator")).agg(F.count(F.lit(1)).alias("firsts"))


def newest_rounds(proposals: DataFrame, n: int = 2) -> DataFrame:
    """Rows of the n newest rounds, found on the table of different rounds."""
    rounds = proposals.select("round").distinct().orderBy(F.desc("round")).limit(n)
    return proposals.join(F.broadcast(rounds), "round")  # n rows


def sessions(packets: DataFrame, gap_seconds: int) -> DataFrame:
    """peer_id, session, start_us, end_us, packets: runs of packets with no longer silence."""
    own = Window.partitionBy("peer_id").orderBy("us", "event_id")
    new = F.when(F.col("us") - F.lag("us").over(own) <= gap_seconds * 1_000_000, 0).otherwise(1)
    marked = packets.withColumn("new", new).withColumn("session", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("peer_id", "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("packets"))


def latest_mapping(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key -> the value of highest order (as manifests map ephemeral to master keys)."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order))


def trusted_only(validations: DataFrame, trusted: DataFrame) -> DataFrame:
    return validations.join(trusted, "validator", "left_semi").groupBy("ledger_seq", "validator").agg(F.min("us").alias("us"))


# ---- peers ----------------------------------------------------------------------------------------


def bootstrap(peers: DataFrame, limit: int) -> DataFrame:
    """The peers to try first: those that did not fail last, then connected ones, with a known range, with any
    success, found by most sources, by last success, fewest failures, last seen, most successes, endpoint."""
    failed_last = F.when((F.col("last_failure_at") > 0) & ((F.col("last_success_at") == 0) | (F.col("last_failure_at") > F.col("last_success_at"))), 1).otherwise(0)
    known_range = (F.col("first_seq") > 0) & (F.col("last_seq") > 0)
    sources = F.col("seen_crawl").cast("int") + F.col("seen_endpoints").cast("int") + F.col("seen_redirect").cast("int")
    order = [failed_last.asc(), F.desc("connected_ok"), known_range.desc(), (F.col("last_success_at") > 0).desc(), sources.desc(), F.desc("last_success_at"), F.asc("failure_count"), F.desc("last_seen_at"), F.desc("success_count"), F.asc("endpoint")]
    return peers.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def pick_for(peers: DataFrame, ledgers: DataFrame, budget: int, excluded: DataFrame) -> DataFrame:
    """ledger_seq, endpoint, rank: the best peers whose range covers each ledger, without those excluded.

    Peers are unrolled over their range and met by equality, which splits by ledger; a peer's span is bounded by its range.
    """
    able = peers.join(excluded, "endpoint", "left_anti").withColumn("ledger_seq", F.explode(F.sequence("first_seq", "last_seq")))
    ready = able.join(ledgers.select(F.col("seq").cast("long").alias("ledger_seq")), "ledger_seq")
    order = Window.partitionBy("ledger_seq").orderBy((F.col("last_seq") - F.col("first_seq")).desc(), F.desc("success_count"), "endpoint")
    return ready.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("ledger_seq", "endpoint", "rank")


def upsert_peers(peers: DataFrame, events: DataFrame) -> DataFrame:
    """Counters after events (endpoint, ok, at), as an insert-or-update would leave them."""
    seen = events.groupBy("endpoint").agg(F.count_if("ok").alias("s"), F.count_if(~F.col("ok")).alias("f"), F.max("at").alias("at"))
    both = peers.join(seen, "endpoint", "full_outer")
    zero = F.lit(0).cast("long")
    return both.select("endpoint", (F.coalesce("success_count", zero) + F.coalesce("s", zero)).alias("success_count"), (F.coalesce("failure_count", zero) + F.coalesce("f", zero)).alias("failure_count"), F.greatest("last_seen_at", "at").alias("last_seen_at"))


# What a failure's text holds, in order of the tests.
FAILURES = (
    ("403", ("status=403", "status: 403", "forbidden")),
    ("503", ("status=503", "status: 503", "service unavailable")),
    ("no-route", ("no route to host",)),
    ("timeout", ("timeout",)),
    ("truncated", ("stream truncated",)),
    ("eof", ("end of stream",)),
    ("tls", ("tls handshake",)),
    ("dns", ("resolve", "host not found")),
    ("disconnect", ("disconnected",)),
)


def failure_kind(text, crawl):
    """The bucket of a failure's text (null as empty); the first match counts, and an empty text is a disconnect."""
    lowered, kind = F.lower(F.coalesce(text, F.lit(""))), F.when(F.coalesce(text, F.lit("")) == "", "disconnect").otherwise("other")
    for name, parts in reversed(FAILURES):
        kind = F.when(F.greatest(F.lit(0), *(F.instr(lowered, part) for part in parts)) > 0, name).otherwise(kind)
    return F.concat(F.when(crawl, "crawl-").otherwise("connect-"), kind)


def recent_failures(events: DataFrame, now: int, seconds: int, endpoints: int) -> DataFrame:
    """kind, n, top: failures (endpoint, kind, at) of the last seconds by kind, with the endpoints that fail most."""
    kept = events.where((F.col("at") <= now) & (F.col("at") > now - seconds))
    each = kept.groupBy("kind", "endpoint").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "endpoint"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= endpoints).groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "endpoint"))), lambda r: r["endpoint"]), ",").alias("top"))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(top, "kind").select("kind", "n", "top")


def retry_backoff(failures, base: int = 5, cap: int = 300):
    """Seconds to wait: none without failures, then doubling up to the cap."""
    waits = F.least(base * F.pow(F.lit(2), F.least(failures - 1, F.lit(6))), F.lit(cap))
    return F.when(failures == 0, F.lit(0)).otherwise(waits).cast("long")


def evict(rows: DataFrame, key: str, used: str, cap: int, group: str) -> DataFrame:
    """What a cache of `cap` entries a group drops: all but the last used."""
    order = Window.partitionBy(group).orderBy(F.desc(used), key)
    return rows.withColumn("age", F.row_number().over(order)).where(F.col("age") > cap)
