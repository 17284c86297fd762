"""Registered queries over content-addressed nodes, identifiers, and look-ups between relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.operators import merkle, nodes, state
from tessera.plans import ledger_model as m
from tessera.plans.catalog import NEW, _state, query
from tessera.sources import store


def _tree(spark, d):
    rows = state.state_asof(m.delta(spark, d), NEW).select("key", F.lower(F.hex(F.col("data").cast("binary"))).alias("data"))
    return rows, store.settled(nodes.tree_nodes(rows))


# A leaf hangs below the longest run of digits that its key shares with a neighbour in key order.
_SHARED = "len(list_filter(range(1, 65), lambda i: {a}[1:i] = {b}[1:i]))"
_PLACES = _state(NEW, "state_b") + f""", w_n AS (SELECT key, data, lag(key) OVER (ORDER BY key) AS a, lead(key) OVER (ORDER BY key) AS b FROM state_b),
w_d AS (SELECT key, data, 1 + greatest(CASE WHEN a IS NULL THEN 0 ELSE {_SHARED.format(a='key', b='a')} END, CASE WHEN b IS NULL THEN 0 ELSE {_SHARED.format(a='key', b='b')} END) AS depth FROM w_n)"""


@query(_PLACES + " SELECT key, CAST(depth AS INTEGER) AS depth, 'found' AS status, data FROM w_d")
def q_node_walk(spark, d):
    """Every key's path from the root, by hash joins."""
    rows, tree = _tree(spark, d)
    depth = merkle.depth_for(rows)
    root = merkle.root(rows, depth, "sha512half").select(F.lower("hash").alias("root"))
    probes = rows.select("key").join(F.broadcast(root))  # one row
    return nodes.walk(tree, probes, depth).select("key", "depth", "status", F.col("data").cast("string").alias("data"))


@query(_PLACES + """, w_p AS (SELECT DISTINCT key[1:i] AS path FROM w_d, unnest(range(0, 64)) r(i) WHERE i < depth)
SELECT 'leaf' AS kind, count(*) AS n, CAST(sum(strlen(data) + 32) AS BIGINT) AS bytes FROM w_d UNION ALL SELECT 'inner', count(*), count(*) * 512 FROM w_p""")
def q_tree_nodes(spark, d):
    _, tree = _tree(spark, d)
    return tree.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@query(_PLACES + """, w_p AS (SELECT DISTINCT key[1:i] AS path FROM w_d, unnest(range(0, 64)) r(i) WHERE i < depth),
w_c AS (SELECT path, count(DISTINCT c) AS k FROM (SELECT DISTINCT key[1:i] AS path, key[i + 1] AS c FROM w_d, unnest(range(0, 64)) r(i) WHERE i < depth) GROUP BY 1)
SELECT 'inner' AS kind, count(*) AS n, CAST(sum(CASE WHEN k = 16 THEN 522 ELSE 12 + 32 * k END) AS BIGINT) AS stored, CAST(0 AS BIGINT) AS changed FROM w_c UNION ALL SELECT 'leaf', count(*), NULL, CAST(0 AS BIGINT) FROM w_d""")
def q_node_blobs(spark, d):
    """Nodes packed for a store and unpacked again: how many do not come back as they were, and the inner ones' bytes."""
    _, tree = _tree(spark, d)
    blobs = nodes.packed(tree)
    back = nodes.unpacked(blobs).join(tree.select("hash", F.col("payload").alias("was")), "hash").groupBy("kind").agg(F.count_if(~F.col("payload").eqNullSafe(F.col("was"))).alias("changed"))
    sizes = blobs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "inner", F.octet_length("blob"))).cast("long").alias("stored"))
    return sizes.join(back, "kind").select("kind", "n", "stored", "changed")


@query(_state(NEW, "state_b") + " SELECT key FROM state_b WHERE key[1] = '7'")
def q_node_mismatch(spark, d):
    """Leaves of a branch have a byte put before their payload; a check of the store finds just these."""
    _, tree = _tree(spark, d)
    own = F.expr("lower(hex(substring(payload, octet_length(payload) - 31)))")
    damaged = tree.withColumn("payload", F.when((F.col("kind") == "leaf") & (F.substring(own, 1, 1) == "7"), F.concat(F.lit(b"x"), F.col("payload"))).otherwise(F.col("payload")))
    return nodes.mismatched(damaged).select(own.alias("key"))


@query(_PLACES + ", w_q AS (SELECT sha256('absent' || s_suppkey) AS key FROM supplier) SELECT q.key, 'absent' AS status FROM w_q q WHERE q.key NOT IN (SELECT key FROM state_b)")
def q_node_walk_absent(spark, d):
    rows, tree = _tree(spark, d)
    depth = merkle.depth_for(rows)
    root = merkle.root(rows, depth, "sha512half").select(F.lower("hash").alias("root"))
    probes = m.table(spark, d, "supplier").select(F.sha2(F.concat(F.lit("absent"), F.col("s_suppkey").cast("string")).cast("binary"), 256).alias("key")).join(F.broadcast(root))  # one row
    return nodes.walk(tree, probes, depth).select("key", "status")


@query(" SELECT DISTINCT key, key[1:40] AS account, CASE WHEN key[1] < '8' THEN CAST(('0x' || key[41:47]) AS BIGINT) END AS tag, key[2] < '8' AS test, true AS account_back, true AS key_back, false AS damaged_read FROM delta")
def q_identifiers(spark, d):
    """Accounts, addresses with a tag and node keys in text and back; a changed character is found out."""

    @F.pandas_udf("account string, tag long, test boolean, account_back boolean, key_back boolean, damaged_read boolean")
    def run(keys: pd.Series) -> pd.DataFrame:
        out = []
        for key in keys:
            raw = bytes.fromhex(key)
            account, tag = raw[:20], int(key[40:47], 16) if key[0] < "8" else None
            own, back, test = codec.read_x_address(codec.x_address(account, tag, key[1] < "8"))
            text = codec.identifier("account", account)
            node = codec.identifier("node_public", b"\xed" + raw)
            swapped = text[:-1] + ("r" if text[-1] != "r" else "p")
            out.append((own.hex(), back, test, codec.read_identifier(text) == ("account", account), codec.read_identifier(node, "node_public") == ("node_public", b"\xed" + raw), codec.read_identifier(swapped) is not None))
        return pd.DataFrame(out, columns=["account", "tag", "test", "account_back", "key_back", "damaged_read"]).astype({"tag": "Int64"})

    return m.delta(spark, d).select("key").distinct().select("key", run("key").alias("r")).select("key", "r.*")


@query("w_m AS (SELECT validator AS old_key, validator + 100000 AS new_key FROM validations WHERE validator % 3 = 0 GROUP BY 1) SELECT coalesce(new_key, validator) AS validator, ledger_seq, min(us) AS us, count(*) AS n FROM validations LEFT JOIN w_m ON validator = old_key GROUP BY 1, 2")
def q_rekeyed(spark, d):
    """Validations under keys that a mapping, come later, replaces."""
    rows = m.validations(spark, d)
    mapping = rows.where("validator % 3 = 0").select(F.col("validator").alias("old_key"), (F.col("validator") + 100_000).alias("new_key")).distinct()
    return state.rekeyed(rows, mapping, "validator").groupBy("validator", "ledger_seq").agg(F.min("us").alias("us"), F.count(F.lit(1)).alias("n"))


@query(" SELECT l.seq, p.validator, p.tx_set, count(*) AS n FROM proposals p JOIN ledgers l ON l.seq = p.round + 1 WHERE p.round > 0 GROUP BY 1, 2, 3")
def q_proposals_for_ledger(spark, d):
    """Proposals name the ledger before the one that they are for, by its hash."""
    heads = m.ledgers(spark, d)
    named = m.proposals(spark, d).join(heads.select(F.col("seq").alias("round"), F.col("hash").alias("prev_hash")), "round")
    return named.join(heads.select("seq", F.col("parent_hash").alias("prev_hash")), "prev_hash").groupBy("seq", "validator", "tx_set").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT t.tx_id, t.seq, l.hash FROM tx t JOIN ledgers l USING (seq) WHERE t.bytes > 45 GROUP BY ALL")
def q_tx_ledger(spark, d):
    """The ledger of each asked transaction."""
    rows = m.tx(spark, d)
    asked = rows.where("bytes > 45").select("tx_id").distinct()
    return rows.join(asked, "tx_id", "left_semi").where("bytes > 45").join(m.ledgers(spark, d).select("seq", "hash"), "seq").select("tx_id", "seq", "hash").distinct()


@query(" SELECT seq, hash FROM ledgers ORDER BY sha256('sample 7 ' || seq), seq LIMIT 25")
def q_ledger_sample(spark, d):
    """A seeded sample to verify: the same for every partitioning of the ledgers."""
    return state.seeded_sample(m.ledgers(spark, d), "seq", 25, 7).select("seq", "hash")


@query(" SELECT node_type, hash, bytes FROM (SELECT DISTINCT node_type, hash, bytes, row_number() OVER (PARTITION BY node_type ORDER BY hash, bytes) AS r FROM (SELECT DISTINCT node_type, hash, bytes FROM blobs WHERE bytes BETWEEN 5 AND 30)) WHERE r <= 50")
def q_samples_by_size(spark, d):
    """At most fifty samples of each kind of node, of a middling size."""
    from pyspark.sql import Window

    fit = m.blobs(spark, d).where("bytes between 5 and 30").distinct()
    rank = F.row_number().over(Window.partitionBy("node_type").orderBy("hash", "bytes"))
    return fit.withColumn("r", rank).where("r <= 50").drop("r")
