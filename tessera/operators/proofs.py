"""Proofs: from signed validations of a ledger, by its header, trees and skip lists, to a transaction's tree.

Everything is joins on (proof, hash): a step makes hashes trusted, and a later step has to come to one of them. Python
runs for signatures and for taking abbreviated trees apart; a proof's rows are never brought together otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import signatures, tries
from tessera.operators.consensus import threshold_for

_MANIFEST = "sequence long, master_key binary, signing_key binary, signature binary, master_signature binary, domain binary, message binary"
_VALIDATION = "ledger_hash binary, signing_key binary, signature binary, message binary"
_TRIE = "root binary, inners int, leaves int, placeholders int, max_depth int, hashes array<binary>, error string"


def _bytes(value) -> bytes:
    return b"" if value is None else bytes(value)


def verified(key, signature, message):
    """Whether a signature of a message is good (nulls: not)."""

    @F.pandas_udf("boolean")
    def run(keys: pd.Series, signed: pd.Series, messages: pd.Series) -> pd.Series:
        return pd.Series([signatures.verify_message(_bytes(k), _bytes(s), _bytes(m)) for k, s, m in zip(keys, signed, messages, strict=True)], dtype=bool)

    return run(key, signature, message)


def manifest(raw):
    """A manifest's fields as a struct; fields that are not there are null."""

    @F.pandas_udf(_MANIFEST)
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tries.read_manifest(_bytes(r)) for r in rows], columns=[c.split()[0] for c in _MANIFEST.split(", ")]).astype({"sequence": "Int64"})

    return run(raw)


def validation(raw):
    """A validation's fields as a struct, all null if it has no key or signature."""
    names = [c.split()[0] for c in _VALIDATION.split(", ")]

    @F.pandas_udf(_VALIDATION)
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tries.read_validation(_bytes(r)) or dict.fromkeys(names) for r in rows], columns=names)

    return run(raw)


def opened(raw, is_state):
    """A trie's root, counts, depth and, of a state tree, the hashes its leaves list; error where it is damaged."""
    names = [c.split()[0] for c in _TRIE.split(", ")]

    def one(data, state) -> tuple:
        try:
            nodes = list(tries.read_trie(_bytes(data)))
            listed = [h for _, kind, _, value in nodes if kind == "leaf" and state for h in tries.listed_hashes(value)]
            kinds = [kind for _, kind, _, _ in nodes]
            return tries.trie_root(nodes, "leaf" if state else "tx"), kinds.count("inner"), kinds.count("leaf"), kinds.count("hash"), max(len(p) for p, *_ in nodes), listed, None
        except ValueError as e:
            return None, 0, 0, 0, 0, [], str(e)

    @F.pandas_udf(_TRIE)
    def run(rows: pd.Series, states: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(r, s) for r, s in zip(rows, states, strict=True)], columns=names)

    return run(raw, is_state)


def trie_nodes(rows: DataFrame, ident: str, raw: str) -> DataFrame:
    """ident, path, kind, key, value: every node of each trie, inner ones without value; damaged tries up to the damage."""
    kept = rows.select(ident, raw)
    head = kept.schema[ident].simpleString().replace(":", " ", 1)

    def run(batches):
        for batch in batches:
            out = []
            for name, data in zip(batch[ident], batch[raw], strict=True):
                try:
                    for path, kind, key, value in tries.read_trie(_bytes(data)):
                        out.append((name, path, kind, key, value))
                except ValueError:
                    pass
            yield pd.DataFrame(out, columns=[ident, "path", "kind", "key", "value"])

    return kept.mapInPandas(run, f"{head}, path string, kind string, key binary, value binary")


def _big_endian(value, size: int):
    """The last bytes of a whole number's 8."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def header_hash(seq, drops, parent, tx, account, parent_close, close, resolution, flags):
    """A header's hash (binary): half of SHA-512 over its 118 bytes."""
    body = F.concat(
        F.lit(b"LWR\0"), _big_endian(seq, 4), _big_endian(drops, 8), parent, tx, account, _big_endian(parent_close, 4), _big_endian(close, 4),
        _big_endian(resolution, 1), _big_endian(flags, 1),
    )
    return F.unhex(F.substring(F.sha2(body, 512), 1, 64))


def skip_list_key(seq=None):
    """The key (binary) of the record of the last 256 hashes, or of the flag ledgers' around a version."""
    body = F.lit(b"\0s") if seq is None else F.concat(F.lit(b"\0s"), _big_endian(F.floor(seq / 65536), 4))
    return F.unhex(F.substring(F.sha2(body, 512), 1, 64))


# ---- anchors --------------------------------------------------------------------------------------


def verify_anchors(anchors: DataFrame, validations: DataFrame, trusted_key: str) -> DataFrame:
    """anchor_id, error, listed, validations, verified, matched, trusted.

    anchors (anchor_id, ledger_hash, public_key as hex, manifest, blob, signature): the publisher's key has to be the
    trusted one, its manifest signed by its master key (and by the signing key, if that signed), the blob by the
    signing key. Then each validator listed in the blob whose manifest is good counts once if one of validations
    (anchor_id, data) for the ledger's hash has its signature; 80 % of them have to.
    """
    own = anchors.withColumn("m", manifest("manifest"))
    own = own.select(
        "anchor_id", "ledger_hash", "blob", F.col("m.signing_key").alias("signing_key"),
        F.coalesce(F.lower("public_key") != trusted_key.lower(), F.lit(True)).alias("foreign"),
        (F.col("m.master_key").isNull() | F.col("m.signing_key").isNull()).alias("unreadable"),
        F.col("m.master_signature").isNull().alias("unsigned"),
        verified(F.col("m.master_key"), F.col("m.master_signature"), F.col("m.message")).alias("by_master"),
        (F.col("m.signature").isNull() | verified(F.col("m.signing_key"), F.col("m.signature"), F.col("m.message"))).alias("by_signing"),
        verified(F.col("m.signing_key"), F.col("signature"), F.col("blob")).alias("blob_good"),
    )
    parsed = own.withColumn("list", F.from_json(F.col("blob").cast("string"), "validators array<struct<manifest: string>>")["validators"])
    listed = parsed.select("anchor_id", F.explode("list.manifest").alias("text")).where("text is not null")
    listed = listed.withColumn("m", manifest(F.try_to_binary("text", F.lit("base64")))).where("m.signing_key is not null")
    listed = listed.where(F.col("m.master_signature").isNull() | verified(F.col("m.master_key"), F.col("m.master_signature"), F.col("m.message")))
    listed = listed.select("anchor_id", F.col("m.signing_key").alias("key")).distinct()
    votes = validations.select("anchor_id", validation("data").alias("v")).join(own.select("anchor_id", "ledger_hash"), "anchor_id")
    same = F.coalesce(F.col("v.ledger_hash") == F.col("ledger_hash"), F.lit(False))
    votes = votes.select("anchor_id", F.col("v.signing_key").alias("key"), (same & verified(F.col("v.signing_key"), F.col("v.signature"), F.col("v.message"))).alias("good"))
    counted = votes.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("validations"), F.count_if("good").alias("verified"))
    matched = votes.where("good").join(listed, ["anchor_id", "key"], "left_semi").groupBy("anchor_id").agg(F.countDistinct("key").alias("matched"))
    sizes = listed.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("listed"))
    zero = F.lit(0).cast("long")
    rows = parsed.join(sizes, "anchor_id", "left").join(counted, "anchor_id", "left").join(matched, "anchor_id", "left")
    rows = rows.select("*", *(F.coalesce(c, zero).alias(f"{c}_n") for c in ("listed", "validations", "verified", "matched")))
    error = (
        F.when(F.col("foreign"), "another publisher").when(F.col("unreadable"), "no manifest").when(F.col("unsigned") | ~F.col("by_master"), "manifest not signed by its master key")
        .when(~F.col("by_signing"), "manifest not signed by its signing key").when(~F.col("blob_good"), "list not signed").when(F.col("list").isNull(), "no validators")
        .when(F.col("matched_n") < threshold_for(F.col("listed_n"), 80), "no quorum")
    )
    reached = ~F.coalesce(error.isin("another publisher", "no manifest", "manifest not signed by its master key", "manifest not signed by its signing key", "list not signed", "no validators"), F.lit(False))
    counts = [F.when(reached, F.col(f"{c}_n")).otherwise(zero).alias(c) for c in ("listed", "validations", "verified", "matched")]
    return rows.select("anchor_id", error.alias("error"), *counts, error.isNull().alias("trusted"))


# ---- chains ---------------------------------------------------------------------------------------


def verify_steps(steps: DataFrame) -> DataFrame:
    """proof_id, step, kind, hash, ok, method, source: each step of proofs, and what earlier step stands for its hash.

    steps: proof_id, step (from 1), kind (anchor, header, state, tx), hash (an anchor's), trusted (of an anchor; null:
    not examined), header (a struct of seq, drops, parent_hash, tx_hash, account_hash, parent_close_time, close_time,
    close_resolution, close_flags), trie (binary). An anchor is the first step and the only one of its kind. It makes
    its ledger's hash trusted; a header its parent's and its trees' roots; a state tree that is itself good, the
    hashes that its leaves list. Only steps before one count for it.
    """
    h = [F.col(f"header.{n}") for n in ("seq", "drops", "parent_hash", "tx_hash", "account_hash", "parent_close_time", "close_time", "close_resolution", "close_flags")]
    tree = F.col("kind").isin("state", "tx")
    rows = steps.select("proof_id", "step", "kind", "trusted", "header", F.when(F.col("kind") == "header", header_hash(*h)).otherwise(F.col("hash")).alias("hash"), "trie")
    plain = rows.where(~tree).drop("trie")
    trees = rows.where(tree).select("proof_id", "step", "kind", opened("trie", F.col("kind") == "state").alias("t")).select("proof_id", "step", "kind", F.col("t.root").alias("hash"), "t.hashes")
    granted = plain.select("proof_id", "step", F.inline(F.when(F.col("kind") == "anchor", F.array(_grant("header", "anchor", F.col("hash")))).otherwise(F.array(
        _grant("header", "parent", F.col("header.parent_hash")), _grant("tx", "header", F.col("header.tx_hash")), _grant("state", "header", F.col("header.account_hash"))))))
    trees = _supported(trees, granted)
    listed = trees.where("kind = 'state' and source is not null").select("proof_id", "step", F.explode("hashes").alias("hash"))
    listed = listed.select("proof_id", "step", F.lit("header").alias("kind"), F.lit("skip list").alias("method"), "hash")
    headers = _supported(plain.where("kind = 'header'").select("proof_id", "step", "kind", "hash"), granted.where("kind = 'header'").unionByName(listed))
    shown = ["proof_id", "step", "kind", "hash", "ok", "method", "source"]
    checked = trees.drop("hashes").unionByName(headers).withColumn("ok", F.col("source").isNotNull()).select(*shown)
    anchors = plain.where("kind = 'anchor'").select("proof_id", "step", "kind", "hash", ((F.col("step") == 1) & F.coalesce("trusted", F.lit(True))).alias("ok"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("source"))
    return checked.unionByName(anchors)


def _grant(kind: str, method: str, value):
    return F.struct(F.lit(kind).alias("kind"), F.lit(method).alias("method"), value.alias("hash"))


def _supported(rows: DataFrame, granted: DataFrame) -> DataFrame:
    """rows with the method and step of the first grant of their hash, if that comes before them."""
    first = granted.groupBy("proof_id", "kind", "hash").agg(F.min(F.struct(F.col("step").alias("source"), "method")).alias("g"))
    met = rows.join(first, ["proof_id", "kind", "hash"], "left").withColumn("g", F.when(F.col("g.source") < F.col("step"), F.col("g")))
    return met.select(*rows.columns, "g.method", "g.source")


def verify_chains(steps: DataFrame) -> DataFrame:
    """proof_id, steps, failed (the first step that is not good, or null), valid."""
    found = verify_steps(steps).groupBy("proof_id").agg(F.count(F.lit(1)).alias("steps"), F.min(F.when(~F.col("ok"), F.col("step"))).alias("failed"))
    return found.withColumn("valid", F.col("failed").isNull())


def narrative(checked: DataFrame) -> DataFrame:
    """proof_id, step, line: what each step of verify_steps shows, in words."""
    how = (
        F.when(F.col("kind") == "anchor", "the ledger whose hash the validators signed")
        .when(F.col("kind") == "header", F.concat(F.lit("a ledger's header, its hash given by "), F.coalesce(F.concat(F.col("method"), F.lit(" of step "), F.col("source").cast("string")), F.lit("no earlier step"))))
        .otherwise(F.concat(F.lit("a "), F.col("kind"), F.lit(" tree, its root given by "), F.coalesce(F.concat(F.lit("the header in step "), F.col("source").cast("string")), F.lit("no earlier step"))))
    )
    return checked.select("proof_id", "step", F.format_string("Step %d: %s %s... %s", "step", how, F.coalesce(F.substring(F.hex("hash"), 1, 16), F.lit("damaged")), F.when(F.col("ok"), "good").otherwise("NOT GOOD")).alias("line"))
