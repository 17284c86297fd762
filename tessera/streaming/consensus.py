"""Structured Streaming forms of the packet and consensus queries.

Inputs are streams with an event time ts (TIMESTAMP). Late rows within the watermark count; what a
watermark would drop is available from `late`, since a restart may bring old sequence numbers again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETENTION = "120 seconds"


def events_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A folder of event files as a stream of packets (event_id, ts, peer_id, type, bytes)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("peer_id"), F.col("event_type").alias("type"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))


def of_type(packets: DataFrame, *types: str, hide: bool = False) -> DataFrame:
    """Packets of the given types, or all others."""
    chosen = F.col("type").isin(*types)
    return packets.where(~chosen if hide else chosen)


def windowed(packets: DataFrame, length: str, slide: str | None = None, delay: str = RETENTION) -> DataFrame:
    """start, type, packets, bytes for tumbling or sliding windows."""
    own = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = packets.withWatermark("ts", delay).groupBy(own.alias("w"), "type").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))
    return rows.select(F.col("w.start").alias("start"), "type", "packets", "bytes")


def sessions(packets: DataFrame, gap: str, delay: str = RETENTION) -> DataFrame:
    """peer_id, start, end, packets of sessions."""
    rows = packets.withWatermark("ts", delay).groupBy("peer_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("packets"))
    return rows.select("peer_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets")


def distinct_validations(packets: DataFrame, trusted: DataFrame | None = None, delay: str = RETENTION) -> DataFrame:
    """ledger_seq, validator, ts: one row for each validator and ledger, of trusted validators only."""
    votes = of_type(packets, "purchase", "click").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("ledger_seq"), F.col("peer_id").alias("validator"), "ts")
    if trusted is not None:
        votes = votes.join(trusted, "validator", "left_semi")
    return votes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ledger_seq", "validator"])


def quorum_events(packets: DataFrame, threshold: int, idle_ms: int = 30_000, delay: str = RETENTION) -> DataFrame:
    """ledger_seq, validators, outcome: a row when a ledger first has enough validators, or goes idle (in event time) without."""

    def step(key, frames, state: GroupState):
        seen, done, last = (set(state.get[0]), state.get[1], state.get[2]) if state.exists else (set(), False, 0)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"ledger_seq": [key[0]], "validators": [len(seen)], "outcome": ["timeout"]})
            return
        for frame in frames:
            seen |= set(frame["validator"].tolist())
            last = max(last, int(frame["ms"].max()))
        if len(seen) >= threshold and not done:
            done = True
            yield pd.DataFrame({"ledger_seq": [key[0]], "validators": [len(seen)], "outcome": ["quorum"]})
        state.update((sorted(seen), done, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)

    votes = of_type(packets, "purchase", "click").withWatermark("ts", delay)
    votes = votes.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("ledger_seq"), F.col("peer_id").alias("validator"), "ts", F.unix_millis("ts").alias("ms"))
    return votes.groupBy("ledger_seq").applyInPandasWithState(step, "ledger_seq int, validators long, outcome string", "seen array<long>, done boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


def proposal_rounds(packets: DataFrame) -> DataFrame:
    """round, validator, proposals, last_event: running state of each validator's positions."""

    def step(key, frames, state: GroupState):
        n, last = state.get if state.exists else (0, -1)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({"round": [key[0]], "validator": [key[1]], "proposals": [n], "last_event": [last]})

    rows = packets.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("round"), F.col("peer_id").alias("validator"), "event_id")
    return rows.groupBy("round", "validator").applyInPandasWithState(step, "round int, validator long, proposals long, last_event long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def round_trips(pings: DataFrame, pongs: DataFrame, within: str = "60 seconds") -> DataFrame:
    """peer_id, n, rtt_ms: pongs met with their pings by an interval join."""
    a = pings.withWatermark("ts", within).select("peer_id", "n", F.col("ts").alias("sent"))
    b = pongs.withWatermark("ts", within).select(F.col("peer_id").alias("p"), F.col("n").alias("m"), F.col("ts").alias("got"))
    met = a.join(b, F.expr(f"peer_id = p and n = m and got >= sent and got <= sent + interval {within}"))
    return met.select("peer_id", "n", (F.unix_millis("got") - F.unix_millis("sent")).alias("rtt_ms"))


def late(packets: DataFrame, newest: str) -> DataFrame:
    """Rows older than a stated time: kept, not dropped."""
    return packets.where(F.col("ts") < F.lit(newest).cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is and returns its result."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
