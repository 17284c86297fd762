"""Trees as content-addressed nodes: making them, walking them by hash joins, and finding those that do not fit their hash.

A node is hash (hex), kind (inner, leaf) and payload: an inner node's 16 hashes, a leaf's data and then its key. Its
hash is half of SHA-512 over the kind's prefix and the payload, so a store can be checked without anything else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.operators import merkle

NODE = ["hash", "kind", "payload"]


def tree_nodes(state: DataFrame, depth: int | None = None) -> DataFrame:
    """The nodes of a state (key, data: hex), once each; a root of nothing is not among them."""
    depth = merkle.depth_for(state) if depth is None else depth
    data, key = F.unhex("data"), F.unhex("key")
    found = state.select(F.lower(F.substring(F.sha2(F.concat(F.lit(b"MLN\0"), data, key), 512), 1, 64)).alias("hash"), F.lit("leaf").alias("kind"), F.concat(data, key).alias("payload"))
    for level in merkle.levels(state, depth, "sha512half", children=True)[1:]:
        inner = level.where("slots is not null")
        found = found.unionByName(inner.select(F.lower("hash").alias("hash"), F.lit("inner").alias("kind"), F.unhex(F.array_join("slots", "")).alias("payload")))
    return found


def node_hash(kind, payload):
    """The hash (hex) that a node's payload gives."""
    prefix = F.when(kind == "inner", F.lit(codec.HASH_PREFIX["inner"])).when(kind == "tx", F.lit(codec.HASH_PREFIX["tx"])).otherwise(F.lit(codec.HASH_PREFIX["leaf"]))
    return F.lower(F.substring(F.sha2(F.concat(prefix, payload), 512), 1, 64))


def mismatched(nodes: DataFrame) -> DataFrame:
    """Nodes whose payload does not give their hash, with the hash that it gives."""
    return nodes.withColumn("computed", node_hash(F.col("kind"), F.col("payload"))).where("computed is null or computed <> hash")


def walk(nodes: DataFrame, probes: DataFrame, most: int = 64) -> DataFrame:
    """key, depth, status (found, absent, missing) and data, for probes (root, key: hex) into nodes.

    A step is a join of the probes still on their way with the nodes by hash; probes move only with their key and the
    next hash. `most` bounds the steps (a tree of n random keys is about log16(n) + 4 deep). absent: the path ends at
    nothing or at another key's leaf; missing: a node on the path is not in the store, or deeper than `most`.
    """
    zero, own = F.lit(merkle.ZERO), F.substring("payload", F.octet_length("payload") - 31, F.lit(32))
    short = nodes.select(F.col("hash").alias("at"), "kind", "payload")
    going = probes.select("root", "key", F.col("root").alias("at"), *(F.lit(None).cast(t).alias(n) for n, t in (("depth", "int"), ("status", "string"), ("data", "binary"))))
    for d in range(most + 1):
        met = going.join(short, "at", "left")
        status = (
            F.when(F.col("at") == zero, "absent").when(F.col("kind").isNull(), "missing")
            .when(F.col("kind") != "inner", F.when(F.lower(F.hex(own)) == F.col("key"), "found").otherwise("absent"))
        )
        met = met.withColumn("now", F.when(F.col("status").isNull(), status))
        branch = F.conv(F.substring("key", d + 1, 1), 16, 10).cast("int")
        below = F.lower(F.hex(F.substring(F.col("payload"), branch * 32 + 1, F.lit(32))))
        going = met.select(
            "root", "key",
            F.when(F.col("status").isNull() & F.col("now").isNull(), below).otherwise(F.concat(F.lit("end of "), "key")).alias("at"),  # ended ones spread by key and meet nothing
            F.coalesce("depth", F.when(F.col("now").isNotNull(), F.lit(d))).alias("depth"), F.coalesce("status", "now").alias("status"),
            F.coalesce("data", F.when(F.col("now") == "found", F.expr("substring(payload, 1, octet_length(payload) - 32)"))).alias("data"),
        )
    return going.select("root", "key", F.coalesce("depth", F.lit(most + 1)).alias("depth"), F.coalesce("status", F.lit("missing")).alias("status"), "data")


def packed(nodes: DataFrame) -> DataFrame:
    """hash, kind, blob: nodes as a store keeps them: inner ones without empty places, leaves under lz4."""

    @F.pandas_udf("binary")
    def run(kinds: pd.Series, payloads: pd.Series) -> pd.Series:
        def one(kind, raw):
            if kind != "inner":
                return codec.wrap_blob("transaction" if kind == "tx" else "account", raw, lz4=True)
            parts = [raw[i : i + 32] for i in range(0, 512, 32)]
            return codec.wrap_inner("account", [p if any(p) else None for p in parts])

        return pd.Series([one(k, bytes(p)) for k, p in zip(kinds, payloads, strict=True)])

    return nodes.select("hash", "kind", run("kind", "payload").alias("blob"))


def unpacked(blobs: DataFrame) -> DataFrame:
    """hash, kind, payload: the nodes of packed (hash, kind, blob)."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: codec.unwrap_blob(bytes(b))[1])

    return blobs.select("hash", "kind", run("blob").alias("payload"))


def packing_report(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """kind, nodes, raw, stored, ratio, share (of all stored bytes)."""
    raw = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.octet_length("payload")).alias("raw"))
    kept = blobs.groupBy("kind").agg(F.sum(F.octet_length("blob")).alias("stored"))
    total = kept.agg(F.sum("stored").alias("total"))
    rows = raw.join(kept, "kind").join(F.broadcast(total))  # one row
    return rows.select("kind", "nodes", "raw", "stored", F.round(F.col("stored") / F.col("raw"), 6).alias("ratio"), F.round(F.col("stored") / F.col("total"), 6).alias("share"))
