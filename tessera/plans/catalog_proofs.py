"""Registered queries over proofs that are made for each version, every few of them damaged in another way."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import codec, signatures, tries
from tessera.operators import proofs
from tessera.plans import ledger_model as m
from tessera.plans.catalog import query

VALIDATORS = 5


def _vl(type_code: int, nth: int, body: bytes) -> bytes:
    head = bytes([type_code << 4 | nth]) if nth < 16 else bytes([type_code << 4, nth])
    return head + codec.vl_prefix(len(body)) + body


def signed_manifest(master: bytes, signing: int) -> bytes:
    """Of an ed25519 seed as the master key and a secp256k1 secret as the signing key."""
    body = b"\x24" + (1).to_bytes(4, "big") + _vl(7, 1, b"\xed" + signatures.public_ed25519(master)) + _vl(7, 3, signatures.public_secp256k1(signing))
    message = b"MAN\0" + body
    return body + _vl(7, 6, signatures.sign_secp256k1(signing, codec.sha512_half(message))) + _vl(7, 18, signatures.sign_ed25519(master, message))


def signed_validation(secret: int, ledger_hash: bytes) -> bytes:
    body = b"\x22" + (1).to_bytes(4, "big") + b"\x51" + ledger_hash + _vl(7, 3, signatures.public_secp256k1(secret))
    return body + _vl(7, 6, signatures.sign_secp256k1(secret, codec.sha512_half(b"VAL\0" + body)))


def _publisher() -> tuple[str, bytes, bytes, bytes]:
    """Key, manifest, list of validators and its signature."""
    master, signing = b"p" * 32, 4242
    listed = [{"manifest": base64.b64encode(signed_manifest(bytes([v]) * 32, 1000 + v)).decode()} for v in range(1, VALIDATORS + 1)]
    forged = signed_manifest(b"\x63" * 32, 99)
    listed.append({"manifest": base64.b64encode(forged[:-1] + bytes([forged[-1] ^ 1])).decode()})  # is not counted
    blob = json.dumps({"sequence": 1, "validators": listed}).encode()
    return "ed" + signatures.public_ed25519(master).hex(), signed_manifest(master, signing), blob, signatures.sign_secp256k1(signing, codec.sha512_half(blob))


@query(""" SELECT seq AS anchor_id, CASE seq % 6 WHEN 1 THEN 'another publisher' WHEN 2 THEN 'list not signed' WHEN 3 THEN 'no quorum' WHEN 5 THEN 'no quorum' END AS error,
 CASE WHEN seq % 6 IN (1, 2) THEN 0 ELSE 5 END AS listed, CASE seq % 6 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 6 END AS validations,
 CASE seq % 6 WHEN 0 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 0 END AS verified, CASE seq % 6 WHEN 0 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS matched, seq % 6 IN (0, 4) AS trusted FROM ledgers""")
def q_anchor_verify(spark, d):
    """Five listed validators and a stranger. By seq % 6: all is good; another publisher; a changed list; three validations only; a changed signature; another ledger."""
    key, manifest, blob, signature = _publisher()

    @F.pandas_udf("array<binary>")
    def votes(seqs: pd.Series, hashes: pd.Series) -> pd.Series:
        def one(seq, ledger_hash):
            case = seq % 6
            asked = codec.sha512_half(ledger_hash) if case == 5 else ledger_hash
            out = [signed_validation(1000 + v, asked) for v in range(1, VALIDATORS + 1)] + [signed_validation(7, asked)]
            if case == 4:
                out[0] = out[0][:-1] + bytes([out[0][-1] ^ 1])
            return out[:3] if case == 3 else out

        return pd.Series([one(s, bytes(h)) for s, h in zip(seqs, hashes, strict=True)])

    rows = m.ledgers(spark, d).select(F.col("seq").alias("anchor_id"), F.unhex("hash").alias("ledger_hash"), (F.col("seq") % 6).alias("case"))
    own = rows.select(
        "anchor_id", "ledger_hash", F.when(F.col("case") == 1, "ed" + "00" * 32).otherwise(F.lit(key.upper())).alias("public_key"), F.lit(manifest).alias("manifest"),
        F.when(F.col("case") == 2, F.lit(blob + b" ")).otherwise(F.lit(blob)).alias("blob"), F.lit(signature).alias("signature"),
    )
    return proofs.verify_anchors(own, rows.select("anchor_id", F.explode(votes("anchor_id", "ledger_hash")).alias("data")), key)


_HEADER = "struct<seq: long, drops: long, parent_hash: binary, tx_hash: binary, account_hash: binary, parent_close_time: long, close_time: long, close_resolution: int, close_flags: int>"
_STEP = f"struct<step: int, kind: string, hash: binary, header: {_HEADER}, trie: binary>"


def _header(seq: int, parent: bytes, tx: bytes, account: bytes) -> tuple[dict, bytes]:
    own = {"seq": seq, "drops": 100_000_000_000_000_000 - seq, "parent_hash": parent, "tx_hash": tx, "account_hash": account, "parent_close_time": 10 * seq, "close_time": 10 * seq + 10, "close_resolution": 10, "close_flags": seq % 2}
    return own, codec.header_hash(*own.values())


def _tree(kind: str, leaf: tuple[str, bytes]) -> tuple[bytes, bytes]:
    """A trie of a leaf and two placeholders beside it, and its root."""
    first = leaf[0][0]
    hashes = {f"{(int(first, 16) + 3) % 16:x}": codec.sha512_half(b"beside"), leaf[0][0] + f"{(int(leaf[0][1], 16) + 1) % 16:x}": codec.sha512_half(b"below")}
    raw = tries.write_trie({leaf[0]: leaf[1]}, hashes)
    return raw, tries.trie_root(list(tries.read_trie(raw)), kind)


def chain(seq: int, ledger_hash: bytes) -> list[dict]:
    """Anchor, its header, its skip list, the target's header, the transaction's tree; by seq % 5: good, another closing
    time in the target, a changed placeholder, a changed skip list, the target before the list that names it."""
    case, key = seq % 5, codec.sha512_half(ledger_hash).hex()
    tx_raw, tx_root = _tree("tx", (key, b"transaction %d" % seq))
    target, target_hash = _header(seq, ledger_hash, tx_root, codec.sha512_half(b"state"))
    record = b"\x11\0h\x22" + bytes(4) + b"\x02\x13" + codec.vl_prefix(96) + codec.sha512_half(b"a") + target_hash + codec.sha512_half(b"b")
    state_raw, state_root = _tree("leaf", (codec.sha512_half(b"\0s").hex(), record))
    anchor, anchor_hash = _header(seq + 200, codec.sha512_half(b"parent"), codec.sha512_half(b"tx"), state_root)
    if case == 1:
        target = target | {"close_time": 1}
    if case == 2:
        tx_raw = tx_raw[:-1] + bytes([tx_raw[-1] ^ 1])
    if case == 3:
        state_raw = state_raw.replace(target_hash, codec.sha512_half(target_hash))
    empty = {"hash": None, "header": None, "trie": None}
    out = [{"kind": "anchor", "hash": anchor_hash}, {"kind": "header", "header": anchor}, {"kind": "state", "trie": state_raw}, {"kind": "header", "header": target}, {"kind": "tx", "trie": tx_raw}]
    if case == 4:
        out[2], out[3] = out[3], out[2]
    return [empty | s | {"step": i + 1} for i, s in enumerate(out)]


def _steps(spark, d):
    @F.pandas_udf(f"array<{_STEP}>")
    def made(seqs: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([chain(int(s), bytes(h)) for s, h in zip(seqs, hashes, strict=True)])

    rows = m.ledgers(spark, d).select(F.col("seq").alias("proof_id"), F.inline(made("seq", F.unhex("hash"))))
    return rows.withColumn("trusted", F.lit(None).cast("boolean"))


_MADE = """w_s AS (SELECT seq AS proof_id, unnest([1, 2, 3, 4, 5]) AS step FROM ledgers),
w_k AS (SELECT proof_id, step, CASE step WHEN 1 THEN 'anchor' WHEN 2 THEN 'header' WHEN 3 THEN CASE proof_id % 5 WHEN 4 THEN 'header' ELSE 'state' END WHEN 4 THEN CASE proof_id % 5 WHEN 4 THEN 'state' ELSE 'header' END ELSE 'tx' END AS kind,
 NOT (proof_id % 5 = 1 AND step = 4 OR proof_id % 5 = 2 AND step = 5 OR proof_id % 5 = 3 AND step IN (3, 4) OR proof_id % 5 = 4 AND step = 3) AS ok FROM w_s)"""


@query(_MADE + """ SELECT proof_id, step, kind, ok, CASE WHEN ok AND step = 2 THEN 'anchor' WHEN ok AND kind = 'header' THEN 'skip list' WHEN ok AND kind <> 'anchor' THEN 'header' END AS method,
 CASE WHEN NOT ok OR step = 1 THEN NULL WHEN step = 2 THEN 1 WHEN kind = 'state' THEN 2 WHEN kind = 'header' THEN 3 WHEN proof_id % 5 = 4 THEN 3 ELSE 4 END AS source FROM w_k""")
def q_proof_steps(spark, d):
    return proofs.verify_steps(_steps(spark, d)).drop("hash")


@query(_MADE + " SELECT proof_id, count(*) AS steps, min(step) FILTER (NOT ok) AS failed, bool_and(ok) AS valid FROM w_k GROUP BY 1")
def q_proof_chains(spark, d):
    return proofs.verify_chains(_steps(spark, d))


@query("w_t AS (SELECT seq AS proof_id, 'state' AS kind FROM ledgers UNION ALL SELECT seq, 'tx' FROM ledgers) SELECT proof_id, kind, CAST(2 AS BIGINT) AS inners, CAST(1 AS BIGINT) AS leaves, CAST(2 AS BIGINT) AS placeholders, 2 AS max_depth FROM w_t")
def q_trie_stats(spark, d):
    """Nodes of the proofs' trees, taken apart."""
    rows = _steps(spark, d).where("trie is not null").withColumn("name", F.concat_ws(" ", F.col("proof_id").cast("string"), "kind"))
    nodes = proofs.trie_nodes(rows, "name", "trie").groupBy("name").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("inner", "inners"), ("leaf", "leaves"), ("hash", "placeholders"))), F.max(F.length("path")).alias("max_depth"))
    return nodes.select(F.split("name", " ")[0].cast("int").alias("proof_id"), F.split("name", " ")[1].alias("kind"), "inners", "leaves", "placeholders", "max_depth")


@query(" SELECT seq, seq % 2 = 1 AS edwards, seq % 3 <> 0 AS good FROM ledgers")
def q_signatures(spark, d):
    """Ed25519 and secp256k1 signatures by turns; of each third version the message is another one."""

    @F.pandas_udf("key binary, signature binary")
    def made(seqs: pd.Series) -> pd.DataFrame:
        out = []
        for s in seqs:
            message = b"%d" % s
            if s % 2:
                out.append((b"\xed" + signatures.public_ed25519(bytes([s]) * 32), signatures.sign_ed25519(bytes([s]) * 32, message)))
            else:
                out.append((signatures.public_secp256k1(int(s)), signatures.sign_secp256k1(int(s), codec.sha512_half(message))))
        return pd.DataFrame(out, columns=["key", "signature"])

    rows = m.ledgers(spark, d).select("seq", made("seq").alias("m"), F.when(F.col("seq") % 3 == 0, F.concat(F.col("seq").cast("string"), F.lit("!"))).otherwise(F.col("seq").cast("string")).cast("binary").alias("message"))
    return rows.select("seq", (F.substring(F.hex("m.key"), 1, 2) == "ED").alias("edwards"), proofs.verified(F.col("m.key"), F.col("m.signature"), F.col("message")).alias("good"))
