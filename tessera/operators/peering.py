"""Which peers to connect to, ask and drop, and peers' rates over counters that start anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 32  # versions are below 2**32


def penalised():
    """Whether an endpoint's last attempt failed (0: never)."""
    failed, worked = F.col("last_failure_at"), F.col("last_success_at")
    return (failed > 0) & ((worked == 0) | (failed > worked))


def covers(wanted: list[int], first_name: str = "first_seq", last_name: str = "last_seq"):
    """Whether a range holds any of a few wanted versions (a range with an end of 0 is unknown)."""
    first, last = F.col(first_name), F.col(last_name)
    known = (first != 0) & (last != 0)
    return known & F.exists(F.array(*(F.lit(w).cast("long") for w in wanted)), lambda w: w.between(first, last)) if wanted else F.lit(False)


def preference(wanted: list[int]) -> list:
    """Sort keys of endpoints to connect to, best first."""
    return [
        covers(wanted).desc(), penalised().asc(), F.desc("connected_ok"), (F.col("last_success_at") > 0).desc(), ((F.col("first_seq") != 0) & (F.col("last_seq") != 0)).desc(),
        F.desc("last_success_at"), F.asc("failure_count"), F.asc("last_failure_at"), F.desc("success_count"), F.desc("current_seq"), F.desc("last_seen_at"), F.asc("endpoint"),
    ]


def best_candidates(peers: DataFrame, wanted: list[int], limit: int) -> DataFrame:
    """peers' rows with a rank, the best `limit` (a top-k; the ranks are given to those alone)."""
    order = preference(wanted)
    return peers.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_range(ranges: DataFrame, wanted: list[int]) -> DataFrame:
    """endpoint, first, last: of each endpoint's ranges, one that holds a wanted version, then the highest end, then the widest."""
    key = F.struct(covers(wanted, "first", "last").alias("c"), F.col("last").alias("l"), (-F.col("first")).alias("w"))
    found = ranges.groupBy("endpoint").agg(F.max(key).alias("k"))
    return found.select("endpoint", (-F.col("k.w")).alias("first"), F.col("k.l").alias("last"))


# ---- peers for versions ---------------------------------------------------------------------------


def _unit(level):
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _blocks(first, last):
    """A range as at most two aligned blocks of 2**level versions a level: an array of (level, block)."""

    def at(level):
        unit = _unit(level)
        low, high = F.floor((first + unit - 1) / unit).cast("long"), F.floor((last + 1) / unit).cast("long")
        there = low < high
        return F.array(F.when(there & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block"))), F.when(there & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)))


def _widest_first(*before):
    return [*before, F.desc("span"), F.asc("endpoint")]


def covering(peers: DataFrame, ledgers: DataFrame, depth: DataFrame) -> DataFrame:
    """ledger_seq and the columns of peers: for each version at least the widest n (depth's one row) that hold it.

    Ranges become aligned blocks, of which a block keeps its widest n, and a version looks itself up in the 32
    blocks around it: rows grow with the peers and the versions, not with ranges' lengths or the product of both.
    """
    own = peers.withColumn("b", F.explode(_blocks(F.col("first_seq"), F.col("last_seq")))).select("*", "b.level", "b.block").drop("b")
    rank = F.row_number().over(Window.partitionBy("level", "block").orderBy(*_widest_first()))
    short = own.withColumn("r", rank).join(F.broadcast(depth)).where("r <= n").drop("r", "n")  # depth is one row
    at = ledgers.select("ledger_seq", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    at = at.withColumn("block", F.floor(F.col("ledger_seq") / _unit(F.col("level"))).cast("long"))
    return at.join(short, ["level", "block"]).drop("level", "block")


def select_for(peers: DataFrame, ledgers: DataFrame, failures: DataFrame, max_count: int) -> DataFrame:
    """ledger_seq, endpoint, rank: the peers to ask for each version, all of peers being ready.

    At most max_count, a third of the peers (but one) and 4; those whose range holds the version first, each of both
    kinds widest first (ties: smaller endpoint). failures (endpoint, ledger_seq) are the peers lately without a version.
    """
    ready = peers.select("endpoint", "first_seq", "last_seq", F.greatest(F.col("last_seq") - F.col("first_seq"), F.lit(0)).alias("span"))
    failed = failures.select("ledger_seq", "endpoint").distinct()
    budget = ready.agg(F.least(F.lit(max_count), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 3)), F.lit(4)).cast("int").alias("budget"))
    most = failed.groupBy("ledger_seq").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    depth = budget.join(most).select((2 * F.col("budget") + F.col("most")).alias("n"))  # one row and one row
    inside = covering(ready, ledgers, depth).withColumn("inside", F.lit(1))
    # The widest of all, from the widest of 64 parts: enough to fill up any version's list.
    part = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("endpoint"), F.lit(64))).orderBy(*_widest_first()))
    wide = ready.withColumn("r", part).join(F.broadcast(depth)).where("r <= n")
    wide = wide.withColumn("r", F.row_number().over(Window.orderBy(*_widest_first()))).where("r <= n")
    wide = wide.groupBy().agg(F.collect_list(F.struct("endpoint", "first_seq", "last_seq", "span")).alias("list"))  # one row of n
    filler = ledgers.select("ledger_seq").join(F.broadcast(wide)).select("ledger_seq", F.inline("list"))
    holds = F.col("ledger_seq").between(F.col("first_seq"), F.col("last_seq"))
    both = inside.unionByName(filler.where(~holds).withColumn("inside", F.lit(0))).join(failed, ["ledger_seq", "endpoint"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("ledger_seq").orderBy(*_widest_first(F.desc("inside"))))
    return both.withColumn("rank", rank).join(F.broadcast(budget)).where("rank <= budget").select("ledger_seq", "endpoint", "rank")


def choose_for(peers: DataFrame, ledgers: DataFrame) -> DataFrame:
    """ledger_seq, endpoint: the one peer for each version: the narrowest range that holds it, then fewest failures,
    least often and least lately selected, then the better candidate."""
    key = [F.asc("span"), F.asc("failure_count"), F.asc("selection_count"), F.asc("last_selected"), *preference([])]
    own = peers.where((F.col("first_seq") != 0) & (F.col("last_seq") != 0)).withColumn("span", F.col("last_seq") - F.col("first_seq"))
    blocks = own.withColumn("b", F.explode(_blocks(F.col("first_seq"), F.col("last_seq")))).select("*", "b.level", "b.block").drop("b")
    best = blocks.withColumn("r", F.row_number().over(Window.partitionBy("level", "block").orderBy(*key))).where("r = 1").drop("r")
    at = ledgers.select("ledger_seq", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    at = at.withColumn("block", F.floor(F.col("ledger_seq") / _unit(F.col("level"))).cast("long"))
    met = at.join(best, ["level", "block"]).withColumn("r", F.row_number().over(Window.partitionBy("ledger_seq").orderBy(*key)))
    return met.where("r = 1").select("ledger_seq", "endpoint")


def to_evict(peers: DataFrame, target: int, archival: int) -> DataFrame:
    """At most one row: the idle peer of narrowest range that neither holds the target nor is archival (ties: smaller endpoint)."""
    known = (F.col("first_seq") != 0) & (F.col("last_seq") != 0)
    span = F.when(known, F.col("last_seq") - F.col("first_seq")).otherwise(F.lit(0))
    idle = peers.where(F.col("pending") == 0).withColumn("span", span)
    kept = idle.where(~(known & F.lit(target).between(F.col("first_seq"), F.col("last_seq")) & F.lit(target != 0)) & (F.col("span") <= archival))
    return kept.orderBy("span", "endpoint").limit(1)


def natural_order(name):
    """Sort keys by which peer-9 comes before peer-10."""
    return [F.regexp_replace(name, r"\d+$", ""), F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long"), F.lit(-1)), name]


# ---- rates ----------------------------------------------------------------------------------------


def counter_rates(samples: DataFrame, seconds: int = 60, rows: int = 200) -> DataFrame:
    """peer_id, us, n, packets_per_s, bytes_per_s of samples (peer_id, us, n, packets, bytes, connected) of running counters.

    A sample is set against the oldest of its run within the time and the number of rows; a run ends where a
    counter falls or the peer is not connected. A single sample's rates are 0.
    """
    order = Window.partitionBy("peer_id").orderBy("us", "n")
    fell = (F.col("packets") < F.lag("packets").over(order)) | (F.col("bytes") < F.lag("bytes").over(order))
    begins = F.when(~F.col("connected") | F.coalesce(fell, F.lit(False)), 1).otherwise(0)
    runs = samples.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sample = F.when(F.col("connected"), F.struct("us", "n", "packets", "bytes"))
    own = Window.partitionBy("peer_id", "run")
    first = F.greatest(
        F.min(sample).over(own.orderBy("us").rangeBetween(-seconds * 1_000_000, 0)),
        F.min(sample).over(own.orderBy("us", "n").rowsBetween(1 - rows, 0)),
    )
    found = runs.withColumn("first", first).withColumn("ms", F.floor((F.col("us") - F.col("first.us")) / 1000))

    def rate(name):
        return F.when(F.col("connected") & (F.col("ms") > 0), F.round((F.col(name) - F.col(f"first.{name}")) * 1000 / F.col("ms"), 6)).otherwise(F.lit(0.0))

    return found.select("peer_id", "us", "n", rate("packets").alias("packets_per_s"), rate("bytes").alias("bytes_per_s"))


def restart_epochs(rows: DataFrame, by: list[str], seq: str, order: list[str]) -> DataFrame:
    """rows with an epoch: how often, up to a row, a sequence has fallen below one that counts (column validated) before it."""
    own = Window.partitionBy(*by).orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("validated"), F.col(seq)), ignorenulls=True).over(before)
    return rows.withColumn("fell", F.when(F.col(seq) < last, 1).otherwise(0)).withColumn("epoch", F.sum("fell").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("fell")
