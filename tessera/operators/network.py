"""Endpoints, ledger ranges, routes and the assignment of validators to peers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# IPv4 ranges that are not public.
PRIVATE = r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|198\.1[89]\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|22[4-9]\.|2[3-5][0-9]\.)"


def host_and_port(endpoint):
    """host and port of a.b.c.d:port or [v6]:port; nulls where it is neither."""
    host = F.regexp_extract(endpoint, r"^\[?(.*?)\]?:(\d+)$", 1)
    port = F.regexp_extract(endpoint, r"^\[?(.*?)\]?:(\d+)$", 2)
    return F.when(host != "", host), F.when(port != "", port.cast("int"))


def is_private(host):
    """Whether an address is not public; an IPv4 address in IPv6 form (::ffff:a.b.c.d) counts as the former."""
    plain = F.regexp_replace(F.lower(host), r"^::ffff:(?=\d+\.)", "")
    v6 = plain.rlike(r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:0?db8:)")
    return F.when(plain.contains(":"), v6).otherwise(plain.rlike(PRIVATE))


def ledger_ranges(text):
    """'1-5,9' as an array of (first, last); parts that are neither are left out."""
    part = F.split(F.regexp_replace(text, r"\s", ""), ",")
    ends = F.transform(part, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)(-\d+)?$", 1).alias("a"), F.regexp_extract(p, r"^\d+-(\d+)$", 1).alias("b")))
    good = F.filter(ends, lambda e: e["a"] != "")
    return F.transform(good, lambda e: F.struct(e["a"].cast("long").alias("first"), F.when(e["b"] != "", e["b"]).otherwise(e["a"]).cast("long").alias("last")))


def route(target):
    """network and tx_hash of /network/<name>/tx/<64 hex digits>."""
    pattern = r"^/network/([a-z0-9-]+)/tx/([0-9A-Fa-f]{64})/?(?:\?.*)?$"
    return F.nullif(F.regexp_extract(target, pattern, 1), F.lit("")), F.nullif(F.lower(F.regexp_extract(target, pattern, 2)), F.lit(""))


def greedy_assignment(votes: DataFrame) -> DataFrame:
    """validator, peer_id, votes: each validator at most one peer and back, most votes first (ties: smaller ids).

    votes (validator, peer_id, votes) is an aggregate over validators and peers, of which networks have
    hundreds; assigning is sequential and is one task's work.
    """

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["votes", "validator", "peer_id"], ascending=[False, True, True])
        used_v, used_p, rows = set(), set(), []
        for v, p, n in zip(frame["validator"], frame["peer_id"], frame["votes"], strict=True):
            if v not in used_v and p not in used_p:
                used_v.add(v)
                used_p.add(p)
                rows.append((v, p, n))
        return pd.DataFrame(rows, columns=["validator", "peer_id", "votes"])

    return votes.groupBy().applyInPandas(assign, "validator long, peer_id long, votes long")


def union_sources(**sources: DataFrame) -> DataFrame:
    """endpoint and a flag seen_<name> for each source of endpoints."""
    out = None
    for name, df in sources.items():
        own = df.select("endpoint", *((F.lit(n == name)).alias(f"seen_{n}") for n in sources))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("endpoint").agg(*(F.max(f"seen_{n}").alias(f"seen_{n}") for n in sources))
