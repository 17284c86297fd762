"""Merkle roots, proofs and prefix-pruned comparison of keyed state.

Keys are hex strings of equal length; branch d of a key is its digit d. A leaf sits just under the deepest
prefix it shares with another key; the root is always an inner node, all zeros if there is no key. Levels
are grouped bottom-up, one aggregation a level, and only as deep as random keys need to differ.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZERO = "0" * 64


def _hash(algo: str, *parts):
    """Of text for sha256; of bytes with prefixes for sha512half (parts: a tag, then hex strings)."""
    if algo == "sha256":
        return F.sha2(F.concat(*parts).cast("binary"), 256)
    tag, *rest = parts
    return F.substring(F.sha2(F.concat(F.concat(tag.cast("binary"), F.lit(b"\0")), *(F.unhex(r) for r in rest)), 512), 1, 64)


def leaves(state: DataFrame, algo: str = "sha256") -> DataFrame:
    """key, hash. For sha512half data is hex."""
    return state.select("key", _hash(algo, F.lit("MLN"), F.col("data"), F.col("key")).alias("hash"))


def depth_for(state: DataFrame) -> int:
    """A depth at which all keys differ; raises if they do not (keys repeat, or are far from random)."""
    n = state.count()
    depth = min(64, 2 + math.ceil(2 * math.log(max(n, 1), 16)) + 2)
    while state.select(F.substring("key", 1, depth).alias("p")).groupBy("p").count().where("count > 1").limit(1).count():
        if depth == 64:
            raise ValueError("a key is there twice")
        depth = min(64, depth + 4)
    return depth


def levels(state: DataFrame, depth: int, algo: str = "sha256", deal: int = 2, children: bool = False) -> list[DataFrame]:
    """For each level from `depth` up to 0: path (of that length), hash, leaf (the key of a single leaf, or null).

    With children, levels above the first also have slots: an inner node's 16 hashes, null for a single leaf.

    Rows are dealt once by their first `deal` digits. All levels below group by those digits and the path,
    for which that is already the right distribution, so only the top levels (16**deal rows) move again.
    """
    own = leaves(state, algo)
    nodes = own.select(F.substring("key", 1, depth).alias("path"), "hash", F.col("key").alias("leaf"), F.substring("key", 1, deal).alias("part")).repartition("part")
    out = [nodes.drop("part")]
    digits = "0123456789abcdef"
    for d in range(depth - 1, -1, -1):
        keys = ["part"] if d >= deal else []
        grouped = nodes.groupBy(*keys, F.substring("path", 1, d).alias("parent")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.substring("path", d + 1, 1), "hash"))).alias("at"),  # at most 16
            F.count(F.lit(1)).alias("n"),
            F.min("leaf").alias("leaf"),
            F.min("hash").alias("only"),
        )
        slots = [F.coalesce(F.try_element_at("at", F.lit(c)), F.lit(ZERO)) for c in digits]
        single = (F.col("n") == 1) & F.col("leaf").isNotNull() & F.lit(d > 0)
        nodes = grouped.select(*keys, F.col("parent").alias("path"), F.when(single, F.col("only")).otherwise(_hash(algo, F.lit("MIN"), *slots)).alias("hash"), F.when(single, F.col("leaf")).alias("leaf"), *([F.when(~single, F.array(*slots)).alias("slots")] if children else []))
        out.append(nodes.drop("part"))
    return out


def root(state: DataFrame, depth: int | None = None, algo: str = "sha256") -> DataFrame:
    """One row: hash."""
    depth = depth_for(state) if depth is None else depth
    top = levels(state, depth, algo)[-1]
    return top.agg(F.coalesce(F.max("hash"), F.lit(ZERO)).alias("hash"))


def root_history(validity: DataFrame, depth: int | None = None, algo: str = "sha256") -> DataFrame:
    """valid_from, valid_to (null: still), hash: the root of every version, from the values' times of validity.

    A node is made anew only in versions in which a node under it changes, so the work follows the changes and
    not the versions times the keys. Versions without any key have no row: their root is ZERO.
    """
    last = (1 << 31) - 1
    if depth is None:
        depth = depth_for(validity.select("key").distinct())
    nodes = validity.select(
        F.substring("key", 1, depth).alias("path"), F.col("valid_from").cast("long").alias("since"), F.coalesce(F.col("valid_to").cast("long"), F.lit(last)).alias("until"),
        _hash(algo, F.lit("MLN"), F.col("data"), F.col("key")).alias("hash"), F.col("key").alias("leaf"),
    )
    digits = "0123456789abcdef"
    for d in range(depth - 1, -1, -1):
        # A child's beginnings and ends, in order, leave the children that are there after each version.
        moment = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("on")), F.struct(F.col("until").alias("at"), F.lit(0).alias("on")))).alias("m")
        events = nodes.select(F.substring("path", 1, d).alias("parent"), F.substring("path", d + 1, 1).alias("digit"), "hash", "leaf", moment).select("parent", "digit", "hash", "leaf", "m.at", "m.on")
        order = Window.partitionBy("parent").orderBy("at", "on")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        child = F.struct(F.when(F.col("on") == 1, F.col("hash")).alias("hash"), F.when(F.col("on") == 1, F.col("leaf")).alias("leaf"))
        states = events.select("parent", "at", F.lead("at").over(order).alias("next"), *(F.last(F.when(F.col("digit") == c, child), ignorenulls=True).over(so_far).alias(f"at_{c}") for c in digits))
        states = states.where("next > at")  # the last event of a version
        hashes = [F.col(f"at_{c}.hash") for c in digits]
        states = states.select("parent", "at", "next", F.array(*hashes).alias("slots"), F.coalesce(*(F.col(f"at_{c}.leaf") for c in digits)).alias("leaf"))
        states = states.withColumn("many", F.size(F.array_compact("slots"))).where("many > 0")
        single = (F.col("many") == 1) & F.col("leaf").isNotNull() & F.lit(d > 0)
        inner = _hash(algo, F.lit("MIN"), *(F.coalesce(F.col("slots")[i], F.lit(ZERO)) for i in range(16)))
        nodes = states.select(F.col("parent").alias("path"), F.col("at").alias("since"), F.col("next").alias("until"), F.when(single, F.array_compact("slots")[0]).otherwise(inner).alias("hash"), F.when(single, F.col("leaf")).alias("leaf"))
    return nodes.select(F.col("since").alias("valid_from"), F.when(F.col("until") < last, F.col("until")).alias("valid_to"), "hash")


def verified(headers: DataFrame, roots: DataFrame) -> DataFrame:
    """seq, stated, computed, valid: the root that each header (seq, stated) gives against that of its state.

    roots (of root_history) has at most a row for each version.
    """
    at = roots.select("valid_from", "valid_to", F.col("hash").alias("computed"))
    inside = (F.col("seq") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("seq") < F.col("valid_to")))
    found = headers.select("seq", "stated").join(at, inside, "left")
    found = found.select("seq", "stated", F.coalesce("computed", F.lit(ZERO)).alias("computed"))
    return found.withColumn("valid", F.col("stated") == F.col("computed"))


def branch_hashes(state: DataFrame, prefix: int, algo: str = "sha256") -> DataFrame:
    """path, hash: a digest of each subtree under prefix digits, by its leaves in key order."""
    return leaves(state, algo).groupBy(F.substring("key", 1, prefix).alias("path")).agg(F.bit_xor(F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")).alias("digest"), F.count(F.lit(1)).alias("n"))


def proof(state: DataFrame, key: str, depth: int) -> DataFrame:
    """d, path, hash: the siblings that, with the key's own leaf, give the root."""
    found, wanted = None, levels(state, depth)
    for d in range(1, depth + 1):
        at = wanted[depth - d]
        siblings = at.where((F.length("path") == d) & (F.substring("path", 1, d - 1) == key[: d - 1]) & (F.col("path") != key[:d])).select(F.lit(d).alias("d"), "path", "hash")
        found = siblings if found is None else found.unionByName(siblings)
    return found


def rebuilt_root(siblings: DataFrame, key: str, leaf_hash, algo: str = "sha256") -> DataFrame:
    """One row: hash, the root that a key's proof (d, path, hash, as of proof) and its leaf's hash give.

    From the deepest sibling up, each level's node is made of the hash so far in the key's place and the
    siblings in theirs. A proof has at most 16 rows a digit of the key.
    """
    rows = siblings.groupBy().agg(F.max("d").alias("deep"), F.map_from_entries(F.collect_list(F.struct("path", "hash"))).alias("held"))
    digits = F.array(*(F.lit(c) for c in "0123456789abcdef"))

    def up(so_far, d):
        above = F.substring(F.lit(key), F.lit(1), d - 1)
        own = F.substring(F.lit(key), d, F.lit(1))
        slots = F.transform(digits, lambda c: F.when(c == own, so_far).otherwise(F.coalesce(F.try_element_at("held", F.concat(above, c)), F.lit(ZERO))))
        if algo == "sha256":
            return F.sha2(F.concat(F.lit("MIN"), F.array_join(slots, "")).cast("binary"), 256)
        return F.substring(F.sha2(F.concat(F.lit(b"MIN\0"), F.unhex(F.array_join(slots, ""))), 512), 1, 64)

    levels_up = F.when(F.col("deep") >= 1, F.reverse(F.sequence(F.lit(1), F.col("deep")))).otherwise(F.array(F.lit(1)))  # the root is an inner node even of one leaf
    return rows.select(F.aggregate(levels_up, leaf_hash, up).alias("hash"))


def flag_ledger(target):
    """The next multiple of 256 above a version: where a skip list covers it."""
    up = F.floor((target + 255) / 256) * 256
    return F.when(up == target, up + 256).otherwise(up).cast("long")
