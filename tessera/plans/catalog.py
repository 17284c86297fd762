"""All registered queries over ledger history, with equivalent SQL for checking.

Each entry applies operators to the canonical relations of ledger_model. The SQL is written on its own
over the same relations (PRELUDE).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import consensus, merkle, state, stats
from tessera.plans import ledger_model as m
from tessera.plans.ledger_model import PRELUDE

OLD, NEW = 20, 40
DEPTH = 10
POINT = "sha2(CAST('k7' AS BINARY), 256)"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name, with SQL (without the prelude)."""

    def add(f):
        _QUERIES[f.__name__] = f
        text = sql.strip()
        _SQL[f.__name__] = PRELUDE + ("," + text if text.startswith(("state_", "diff_", "w_")) else text)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import catalog_files, catalog_more, catalog_nodes, catalog_peers, catalog_proofs  # noqa: F401  (register their own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _state(n: int, name: str) -> str:
    return f"{name} AS (SELECT key, data, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM delta WHERE seq <= {n}) WHERE r = 1 AND op = 4)"


_DIFF = _state(OLD, "state_a") + "," + _state(NEW, "state_b") + """,
diff_ AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.data AS old_data, b.data AS new_data
          FROM state_a a FULL JOIN state_b b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.data IS DISTINCT FROM b.data)"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return state.diff(state.state_asof(m.delta(spark, d), OLD), state.state_asof(m.delta(spark, d), NEW))


# ---- state ----------------------------------------------------------------------------------------


@query(_state(NEW, "state_b") + " SELECT * FROM state_b")
def q_state_asof(spark, d):
    return state.state_asof(m.delta(spark, d), NEW)


@query(_state(NEW, "state_b") + " SELECT * FROM state_b WHERE key = sha256('k7')")
def q_state_point(spark, d):
    return state.state_asof(m.delta(spark, d), NEW).where(f"key = {POINT}")


_ACTIONS = "w_ AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS p FROM delta), w_a AS (SELECT seq, key, CASE WHEN op = 254 THEN CASE WHEN p = 4 THEN 'REMOVE' ELSE 'MISSING' END ELSE CASE WHEN p = 4 THEN 'UPDATE' ELSE 'ADD' END END AS action FROM w_)"


@query(_ACTIONS + " SELECT * FROM w_a")
def q_op_classify(spark, d):
    return state.classify(m.delta(spark, d))


@query(_ACTIONS + " SELECT seq, count(*) FILTER (action = 'ADD') AS added, count(*) FILTER (action = 'UPDATE') AS updated, count(*) FILTER (action = 'REMOVE') AS deleted, count(*) FILTER (action = 'MISSING') AS missing, count(*) AS processed FROM w_a GROUP BY seq")
def q_op_counts(spark, d):
    return state.operation_counts(m.delta(spark, d))


@query(_ACTIONS + " SELECT seq, key, CASE WHEN action = 'ADD' THEN 'ADD' ELSE 'FAILED' END AS outcome FROM w_a WHERE action IN ('ADD', 'UPDATE')")
def q_add_only(spark, d):
    return state.set_items(m.delta(spark, d), "add_only")


@query(" SELECT key, data, seq AS valid_from, valid_to FROM (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS valid_to FROM delta) WHERE op = 4")
def q_validity(spark, d):
    return state.validity(m.delta(spark, d))


@query(_state(30, "state_a") + f" SELECT 30 AS seq, key, 4 AS op, data FROM state_a UNION ALL SELECT seq, key, op, data FROM delta WHERE seq BETWEEN 31 AND {NEW}")
def q_slice(spark, d):
    return state.slice_history(m.delta(spark, d), 30, NEW)


@query(_DIFF + " SELECT * FROM diff_")
def q_diff(spark, d):
    return _diff(spark, d)


@query(_state(NEW, "state_b") + " SELECT key, data FROM state_b")
def q_diff_apply(spark, d):
    return state.apply_diff(state.state_asof(m.delta(spark, d), OLD), _diff(spark, d))


@query(_DIFF + " SELECT key, CASE change WHEN 'added' THEN 'deleted' WHEN 'deleted' THEN 'added' ELSE change END AS change, new_data AS old_data, old_data AS new_data FROM diff_")
def q_diff_invert(spark, d):
    return state.invert_diff(_diff(spark, d))


@query(_state(OLD, "state_a") + f" SELECT coalesce(a.key, e.key) AS key, CASE WHEN e.key IS NULL THEN a.data ELSE e.data END AS data FROM state_a a FULL JOIN (SELECT * FROM delta WHERE seq = {OLD + 1}) e ON a.key = e.key WHERE e.op IS NULL OR e.op = 4")
def q_overlay(spark, d):
    return state.overlay(state.state_asof(m.delta(spark, d), OLD), m.delta(spark, d).where(F.col("seq") == OLD + 1))


@query(f" SELECT key, data FROM delta WHERE seq = {NEW} AND op = 4")
def q_new_nodes(spark, d):
    return state.new_in(m.delta(spark, d), NEW)


@query(_DIFF.replace("diff_ AS", "diff_x AS") + " SELECT key FROM state_a EXCEPT SELECT key FROM state_b")
def q_keys_except(spark, d):
    delta = m.delta(spark, d)
    return state.state_asof(delta, OLD).select("key").exceptAll(state.state_asof(delta, NEW).select("key"))


@query(_state(OLD, "state_a") + "," + _state(NEW, "state_b") + " SELECT key FROM state_a INTERSECT SELECT key FROM state_b")
def q_keys_intersect(spark, d):
    delta = m.delta(spark, d)
    return state.state_asof(delta, OLD).select("key").intersect(state.state_asof(delta, NEW).select("key"))


@query(" SELECT key, previous, seq, seq - previous AS gap FROM (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS previous FROM delta) WHERE seq - previous > 1")
def q_seq_gaps(spark, d):
    return state.gaps(m.delta(spark, d), "key", "seq")


@query(" SELECT n, CAST((SELECT max(seq) FROM ledgers WHERE seq <= n) AS INTEGER) AS seq FROM (VALUES (0), (1), (17), (80), (1000)) v(n)")
def q_floor_ledger(spark, d):
    probes = spark.range(1).select(F.explode(F.array(*map(F.lit, (0, 1, 17, 80, 1000)))).alias("n"))
    return state.floor_of(m.ledgers(spark, d).select("seq"), probes)


@query(" SELECT min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, count(*) FILTER (seq = 17) > 0 AS has_17 FROM ledgers")
def q_index_range(spark, d):
    return m.ledgers(spark, d).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), (F.count_if(F.col("seq") == 17) > 0).alias("has_17"))


_NUMBERED = "w_n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_no FROM orders)"


@query(_NUMBERED + " SELECT o_orderkey, record_no FROM w_n WHERE record_no % 64 = 0")
def q_every_nth(spark, d):
    return state.numbered(m.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").where("record_no % 64 = 0")


@query(_NUMBERED + " SELECT o_orderkey, record_no FROM w_n WHERE record_no = 1000")
def q_record_n(spark, d):
    return state.numbered(m.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").where("record_no = 1000")


@query(" SELECT a.seq, a.hash, a.parent_hash, a.parent_hash IS NOT DISTINCT FROM b.hash AS linked FROM ledgers a LEFT JOIN ledgers b ON a.seq = b.seq + 1")
def q_header_chain(spark, d):
    headers = m.ledgers(spark, d)
    before = headers.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("was"))
    return headers.join(before, "seq", "left").select("seq", "hash", "parent_hash", F.col("parent_hash").eqNullSafe(F.col("was")).alias("linked"))


@query(" SELECT a.hash, CAST(coalesce(b.seq + 1, 0) AS INTEGER) AS inferred FROM ledgers a LEFT JOIN ledgers b ON a.parent_hash = b.hash")
def q_infer_seq(spark, d):
    headers = m.ledgers(spark, d)
    known = headers.select(F.col("hash").alias("parent_hash"), "seq")
    return headers.select("hash", "parent_hash").join(known, "parent_hash", "left").select("hash", F.coalesce((F.col("seq") + 1).cast("int"), F.lit(0)).alias("inferred"))


@query(" SELECT seq, CAST(CASE WHEN (seq * 37 + 255) // 256 * 256 = seq * 37 THEN seq * 37 + 256 ELSE (seq * 37 + 255) // 256 * 256 END AS BIGINT) AS flag FROM ledgers")
def q_skip_flag(spark, d):
    return m.ledgers(spark, d).select("seq", merkle.flag_ledger(F.col("seq") * 37).alias("flag"))


# ---- trees ----------------------------------------------------------------------------------------


def _tree_sql(name: str) -> str:
    """The levels of a tree over the state `name`, as tables w_<name>_<depth>."""
    zero = "0" * 64
    parts = [f"w_{name}_{DEPTH} AS (SELECT substr(key, 1, {DEPTH}) AS path, sha256('MLN' || data || key) AS hash, key AS leaf FROM {name})"]
    for level in range(DEPTH - 1, -1, -1):
        slots = " || ".join(f"coalesce(max(hash) FILTER (substr(path, {level + 1}, 1) = '{c}'), '{zero}')" for c in "0123456789abcdef")
        single = f"count(*) = 1 AND max(leaf) IS NOT NULL AND {level} > 0"
        parts.append(f"w_{name}_{level} AS (SELECT substr(path, 1, {level}) AS path, CASE WHEN {single} THEN max(hash) ELSE sha256('MIN' || {slots}) END AS hash, CASE WHEN {single} THEN max(leaf) END AS leaf FROM w_{name}_{level + 1} GROUP BY 1)")
    return ", ".join(parts)


@query(_state(NEW, "state_b") + " SELECT key, sha256('MLN' || data || key) AS hash FROM state_b")
def q_merkle_leaf(spark, d):
    return merkle.leaves(state.state_asof(m.delta(spark, d), NEW))


@query(_state(NEW, "state_b") + ", " + _tree_sql("state_b") + " SELECT hash FROM w_state_b_0")
def q_merkle_root(spark, d):
    return merkle.root(state.state_asof(m.delta(spark, d), NEW))


def _versions_tree_sql() -> str:
    """The root of every version's whole state, each tree built on its own, as w_roots (seq, hash)."""
    zero = "0" * 64
    parts = [f"""w_i AS (SELECT key, op, data, seq AS since, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until FROM delta),
w_{DEPTH} AS (SELECT l.seq, substr(key, 1, {DEPTH}) AS path, sha256('MLN' || data || key) AS hash, key AS leaf FROM w_i JOIN ledgers l ON l.seq >= since AND (until IS NULL OR l.seq < until) WHERE op = 4)"""]
    for level in range(DEPTH - 1, -1, -1):
        slots = " || ".join(f"coalesce(max(hash) FILTER (substr(path, {level + 1}, 1) = '{c}'), '{zero}')" for c in "0123456789abcdef")
        single = f"count(*) = 1 AND max(leaf) IS NOT NULL AND {level} > 0"
        parts.append(f"w_{level} AS (SELECT seq, substr(path, 1, {level}) AS path, CASE WHEN {single} THEN max(hash) ELSE sha256('MIN' || {slots}) END AS hash, CASE WHEN {single} THEN max(leaf) END AS leaf FROM w_{level + 1} GROUP BY 1, 2)")
    return ", ".join(parts) + f", w_roots AS (SELECT l.seq, coalesce(r.hash, '{zero}') AS hash FROM ledgers l LEFT JOIN w_0 r ON l.seq = r.seq)"


@query(_versions_tree_sql() + " SELECT seq, hash FROM w_roots")
def q_roots(spark, d):
    """The root of every version, from what changed."""
    roots = merkle.root_history(state.validity(m.delta(spark, d)))
    return merkle.verified(m.ledgers(spark, d).withColumn("stated", F.lit("")), roots).select("seq", F.col("computed").alias("hash"))


@query(_versions_tree_sql() + ", w_s AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN lag(hash) OVER (ORDER BY seq) ELSE hash END AS stated, hash AS computed FROM w_roots) SELECT seq, stated, computed, stated = computed AS valid FROM w_s")
def q_merkle_verify(spark, d):
    """Every header's root against that of its state; each seventh header states its parent's root, as a damaged one may."""
    ledgers, roots = m.ledgers(spark, d).select("seq"), merkle.root_history(state.validity(m.delta(spark, d)))
    own = merkle.verified(ledgers.withColumn("stated", F.lit("")), roots).select(F.col("seq").alias("of"), F.col("computed").alias("stated"))
    headers = ledgers.withColumn("of", F.col("seq") - F.when(F.col("seq") % 7 == 0, 1).otherwise(0)).join(own, "of", "left")
    return merkle.verified(headers.select("seq", "stated"), roots)


@query(_state(NEW, "state_b") + ", " + _tree_sql("state_b") + " SELECT path AS branch, hash FROM w_state_b_1")
def q_top_branch(spark, d):
    """The sixteen subtrees that work on a tree is dealt by."""
    s = state.state_asof(m.delta(spark, d), NEW)
    return merkle.levels(s, merkle.depth_for(s))[-2].select(F.col("path").alias("branch"), "hash")


@query(_DIFF + " SELECT * FROM diff_")
def q_prefix_diff(spark, d):
    """The difference of two states, looked for only under prefixes whose digests differ."""
    a, b = state.state_asof(m.delta(spark, d), OLD), state.state_asof(m.delta(spark, d), NEW)
    da, db = merkle.branch_hashes(a, 3), merkle.branch_hashes(b, 3).select("path", F.col("digest").alias("digest_b"), F.col("n").alias("n_b"))
    differ = da.join(db, "path", "full_outer").where("not (digest <=> digest_b and n <=> n_b)").select("path")
    under = lambda s: s.withColumn("path", F.substring("key", 1, 3)).join(differ, "path", "left_semi").drop("path")
    return state.diff(under(a), under(b))


@query(_state(NEW, "state_b") + ", " + _tree_sql("state_b") + ", w_k AS (SELECT min(key) AS key FROM state_b) " + " UNION ALL ".join(f"SELECT {i} AS d, path, hash FROM w_state_b_{i}, w_k WHERE length(path) = {i} AND substr(path, 1, {i - 1}) = substr(key, 1, {i - 1}) AND path <> substr(key, 1, {i})" for i in range(1, DEPTH + 1)))
def q_proof_siblings(spark, d):
    s = state.state_asof(m.delta(spark, d), NEW)
    return merkle.proof(s, s.agg(F.min("key")).first()[0], merkle.depth_for(s))


@query(_state(NEW, "state_b") + ", " + _tree_sql("state_b") + " SELECT hash FROM w_state_b_0")
def q_proof_root(spark, d):
    """The root that the proof of the smallest key gives."""
    s = state.state_asof(m.delta(spark, d), NEW)
    key, data = s.agg(F.min(F.struct("key", "data"))).first()[0]
    return merkle.rebuilt_root(merkle.proof(s, key, merkle.depth_for(s)), key, F.sha2(F.lit("MLN" + data + key).cast("binary"), 256))


# ---- statistics -----------------------------------------------------------------------------------


@query(" SELECT seq, CASE op WHEN 4 THEN 'upsert' ELSE 'remove' END AS kind, count(*) AS n FROM delta GROUP BY ALL")
def q_node_types(spark, d):
    return m.delta(spark, d).groupBy("seq", F.when(F.col("op") == 4, "upsert").otherwise("remove").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT field, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, round(avg(size), 6) AS avg_size, max(depth) AS max_depth FROM fields_ GROUP BY field")
def q_field_usage(spark, d):
    return stats.field_usage(m.fields(spark, d))


@query(" SELECT field, size, uses, rank FROM (SELECT field, size, count(*) AS uses, CAST(row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, size) AS INTEGER) AS rank FROM fields_ GROUP BY field, size) WHERE rank <= 3")
def q_field_top_sizes(spark, d):
    return stats.top_per(m.fields(spark, d), ["field"], "size", 3)


@query(" SELECT o_orderpriority, count(*) AS uses, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def q_value_freq_pct(spark, d):
    return stats.frequency(m.table(spark, d, "orders"), "o_orderpriority")


@query(" SELECT combination, count(*) AS n FROM (SELECT record_id, string_agg(DISTINCT field, ',' ORDER BY field) AS combination FROM fields_ GROUP BY record_id) GROUP BY 1")
def q_field_combinations(spark, d):
    return stats.field_combinations(m.fields(spark, d))


@query(" SELECT a.field AS field_a, b.field AS field_b, count(*) AS n FROM fields_ a JOIN fields_ b ON a.record_id = b.record_id AND a.field < b.field GROUP BY 1, 2")
def q_field_pairs(spark, d):
    return stats.field_pairs(m.fields(spark, d))


@query(" SELECT count(*) AS arrays, coalesce(round(avg(n), 6), 0) AS avg_length, coalesce(min(n), 0) AS min_length, coalesce(max(n), 0) AS max_length FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def q_array_stats(spark, d):
    return stats.array_stats(m.table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query(" SELECT key, count(*) AS uses, count(*) FILTER (op = 254) AS deletions FROM delta GROUP BY key")
def q_key_access(spark, d):
    return stats.key_access(m.delta(spark, d))


@query(" SELECT field, count(*) AS candidates, CAST(sum(uses * CASE field WHEN 'o_custkey' THEN 18 ELSE 19 END) AS BIGINT) AS saved FROM (SELECT field, value, count(*) AS uses FROM fields_ WHERE field IN ('o_custkey', 'c_mktsegment') GROUP BY 1, 2) WHERE uses > CASE field WHEN 'o_custkey' THEN 10 ELSE 20 END GROUP BY field")
def q_compress_opp(spark, d):
    return stats.compression_opportunity(m.fields(spark, d), {"o_custkey": (10, 18), "c_mktsegment": (20, 19)})


@query(" SELECT count(*) AS total_fields, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT field) AS unique_fields, max(depth) AS max_depth, count(DISTINCT record_id) AS records FROM fields_")
def q_field_summary(spark, d):
    return stats.summary(m.fields(spark, d))


@query(" SELECT *, round(total / uniq, 6) AS avg_reps, round(total * 32 / (uniq * 32 + total * CASE WHEN uniq <= 256 THEN 1 WHEN uniq <= 65536 THEN 2 ELSE 4 END), 6) AS ratio FROM (SELECT count(*) AS total, count(DISTINCT key) AS uniq FROM delta)")
def q_key_repetition(spark, d):
    return stats.repetition(m.delta(spark, d), "key").withColumnRenamed("unique", "uniq")


@query(" SELECT hash, min(node_type) AS node_type, arg_min(bytes, (node_type, bytes)) AS bytes FROM blobs WHERE node_type <> 'tx_leaf' GROUP BY hash UNION ALL SELECT hash, node_type, bytes FROM blobs WHERE node_type = 'tx_leaf'")
def q_dedup_exact(spark, d):
    return stats.dedup(m.blobs(spark, d))


@query(" SELECT hash, min(node_type) AS node_type, arg_min(bytes, (node_type, bytes)) AS bytes FROM blobs WHERE node_type <> 'tx_leaf' GROUP BY hash")
def q_dedup_skip_mask(spark, d):
    return stats.dedup(m.blobs(spark, d), keep=(), skip=("tx_leaf",))


@query(" SELECT node_type, count(*) AS total, count(DISTINCT hash) AS uniq, count(*) - count(DISTINCT hash) AS duplicates FROM blobs GROUP BY node_type")
def q_dedup_by_type(spark, d):
    return stats.dedup_stats(m.blobs(spark, d)).withColumnRenamed("unique", "uniq")


@query(" SELECT tx_id, count(*) AS n FROM tx GROUP BY tx_id HAVING count(*) > 1")
def q_dup_ids(spark, d):
    return stats.repeated(m.tx(spark, d), "tx_id")


_BUCKETS = "w_b AS (SELECT CAST(('0x' || substr(key, 1, 8)) AS BIGINT) % 97 AS bucket, count(*) AS entries, count(DISTINCT key) AS distinct_keys FROM delta GROUP BY 1)"


@query(_BUCKETS + " SELECT entries, count(*) AS buckets, CAST(sum(entries - distinct_keys) AS BIGINT) AS collisions FROM w_b GROUP BY 1 UNION ALL SELECT 0, 97 - count(*), 0 FROM w_b HAVING count(*) < 97")
def q_bucket_hist(spark, d):
    return stats.bucket_histogram(m.delta(spark, d), "key", 97)


@query(_BUCKETS + " SELECT bucket, entries FROM w_b WHERE entries >= 20")
def q_bucket_collisions(spark, d):
    return stats.buckets(m.delta(spark, d), "key", 97).where("entries >= 20").select("bucket", "entries")


@query(" SELECT c_custkey AS k, 'orphaned_value' AS problem FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 7 <> 0) UNION ALL SELECT DISTINCT o_custkey, 'missing_value' FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def q_orphans(spark, d):
    """Values of some customers without a key among the orders, and the other way; each side lacks some on purpose."""
    values, keys = m.table(spark, d, "customer").where("c_custkey % 10 <> 0"), m.table(spark, d, "orders").where("o_custkey % 7 <> 0")
    return stats.orphans(values.select(F.col("c_custkey").alias("k")), keys.select(F.col("o_custkey").alias("k")), "k")


@query(" SELECT count(*) AS keys, count(*) FILTER (op = 254) AS removals, CAST(sum(coalesce(strlen(data), 0)) AS BIGINT) AS bytes FROM delta")
def q_key_count(spark, d):
    return m.delta(spark, d).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("op") == 254).alias("removals"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).alias("bytes"))


# ---- consensus and peers --------------------------------------------------------------------------


@query(" SELECT ledger_seq, count(DISTINCT validator) AS validators FROM validations GROUP BY 1 HAVING count(DISTINCT validator) >= (20 * 30 + 99) // 100")
def q_quorum(spark, d):
    return consensus.quorum(m.validations(spark, d), 20, 30)


@query(" SELECT ledger_seq, count(DISTINCT validator) AS validators FROM validations GROUP BY 1 HAVING count(DISTINCT validator) >= (20 * 30 + 99) // 100 ORDER BY ledger_seq DESC, validators DESC LIMIT 1")
def q_latest_quorum(spark, d):
    return consensus.quorum(m.validations(spark, d), 20, 30).orderBy(F.desc("ledger_seq"), F.desc("validators")).limit(1)


_LATEST = "w_l AS (SELECT round, validator, propose_seq, tx_set FROM proposals QUALIFY row_number() OVER (PARTITION BY round, validator ORDER BY propose_seq DESC, us DESC, event_id DESC) = 1)"


@query(_LATEST + " SELECT round, tx_set, votes FROM (SELECT round, tx_set, count(*) AS votes, row_number() OVER (PARTITION BY round ORDER BY count(*) DESC, tx_set) AS r FROM w_l GROUP BY 1, 2) WHERE r = 1")
def q_winner(spark, d):
    return consensus.winners(m.proposals(spark, d))


def _agreeing(spark, d, when: str) -> DataFrame:
    """Proposals whose validators all name one set in some rounds."""
    return m.proposals(spark, d).withColumn("tx_set", F.expr(f"if({when}, 'same', tx_set)"))


_AGREED = "w_p AS (SELECT round, validator, propose_seq, us, event_id, CASE WHEN {} THEN 'same' ELSE tx_set END AS tx_set FROM proposals), w_l AS (SELECT round, validator, tx_set FROM w_p QUALIFY row_number() OVER (PARTITION BY round, validator ORDER BY propose_seq DESC, us DESC, event_id DESC) = 1)"


@query(_AGREED.format("round % 3 = 0") + " SELECT round, min(tx_set) AS tx_set, count(*) AS validators FROM w_l GROUP BY round HAVING count(DISTINCT tx_set) = 1")
def q_converged(spark, d):
    return consensus.converged(_agreeing(spark, d, "round % 3 = 0"))


@query(_AGREED.format("round % 7 <> 3") + ", w_r AS (SELECT round FROM w_p GROUP BY round ORDER BY min((us, event_id)) DESC LIMIT 1 OFFSET 1) SELECT round, min(tx_set) AS tx_set, count(*) AS validators FROM w_l WHERE round IN (SELECT round FROM w_r) GROUP BY round HAVING count(DISTINCT tx_set) = 1")
def q_set_to_acquire(spark, d):
    return consensus.set_to_acquire(_agreeing(spark, d, "round % 7 <> 3"))


@query(" SELECT round, tx_set, count(DISTINCT validator) AS validators, min(us) AS first_us, max(us) AS last_us, arg_min(validator, (us, event_id)) AS first_by, arg_max(validator, (us, event_id)) AS last_by, (max(us) - min(us)) // 1000 AS delta_ms FROM proposals GROUP BY 1, 2")
def q_txset_summary(spark, d):
    return consensus.tx_set_summary(m.proposals(spark, d))


@query(" SELECT round, validator, (propose_seq + 3) // 4 AS propose_seq, count(DISTINCT tx_set) AS sets FROM proposals GROUP BY 1, 2, 3 HAVING count(DISTINCT tx_set) > 1")
def q_conflicts(spark, d):
    """Four proposals in a row are given one number, so that some numbers stand for different sets."""
    return consensus.conflicts(m.proposals(spark, d).withColumn("propose_seq", F.floor((F.col("propose_seq") + 3) / 4)))


@query(" SELECT seq, type, count(*) AS n FROM tx GROUP BY 1, 2")
def q_type_hist(spark, d):
    return m.tx(spark, d).groupBy("seq", "type").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT validator, arg_max(tx_set, (event_id, tx_set)) AS tx_set, max(event_id) AS event_id FROM proposals GROUP BY 1")
def q_key_map_latest(spark, d):
    return consensus.latest_mapping(m.proposals(spark, d), "validator", "tx_set", "event_id")


@query(" SELECT ledger_seq, validator, min(us) AS us FROM validations WHERE validator IN (SELECT c_custkey FROM customer WHERE c_nationkey < 13) GROUP BY 1, 2")
def q_trusted_only(spark, d):
    trusted = m.table(spark, d, "customer").where("c_nationkey < 13").select(F.col("c_custkey").alias("validator"))
    return consensus.trusted_only(m.validations(spark, d), trusted)


@query(" SELECT peer_id, type, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2")
def q_packet_stats(spark, d):
    return consensus.packet_stats(m.packets(spark, d))


@query(" SELECT peer_id, type, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM packets GROUP BY ROLLUP (peer_id, type)")
def q_packet_rollup(spark, d):
    return consensus.packet_rollup(m.packets(spark, d))


@query("w_c AS (SELECT event_id, peer_id, us, row_number() OVER (PARTITION BY peer_id ORDER BY us, event_id) AS n FROM packets), w_d AS (SELECT event_id, peer_id, n - min(n) OVER w AS dn, us - min(us) OVER w AS dt FROM w_c WINDOW w AS (PARTITION BY peer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) SELECT event_id, peer_id, CASE WHEN dt > 0 THEN round(dn * 1000000 / dt, 6) ELSE 0 END AS rate FROM w_d")
def q_rate_window(spark, d):
    return consensus.rate(m.packets(spark, d), 86400)


@query(" SELECT event_id, peer_id, before, type FROM (SELECT *, lag(type) OVER (PARTITION BY peer_id ORDER BY us, event_id) AS before FROM packets) WHERE type IS DISTINCT FROM before")
def q_status_changes(spark, d):
    return consensus.changes(m.packets(spark, d))


@query(" SELECT event_id, peer_id, gap_us FROM (SELECT event_id, peer_id, us - lag(us) OVER (PARTITION BY peer_id ORDER BY us, event_id) AS gap_us FROM packets) WHERE gap_us > 3600000000")
def q_log_gaps(spark, d):
    return consensus.time_gaps(m.packets(spark, d), 3600)


@query(" SELECT validator, count(*) AS firsts FROM (SELECT ledger_seq, arg_min(validator, (us, validator)) AS validator FROM validations GROUP BY 1) GROUP BY 1")
def q_first_delivery(spark, d):
    return consensus.first_deliveries(m.validations(spark, d))


@query(" SELECT round, validator, propose_seq, tx_set FROM proposals WHERE round IN (SELECT DISTINCT round FROM proposals ORDER BY round DESC LIMIT 2)")
def q_two_newest(spark, d):
    return consensus.newest_rounds(m.proposals(spark, d)).select("round", "validator", "propose_seq", "tx_set")


@query("w_m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY peer_id ORDER BY us, event_id) <= 7200000000 THEN 0 ELSE 1 END AS n FROM packets), w_s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY peer_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM w_m) SELECT peer_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS packets FROM w_s GROUP BY 1, 2")
def q_session(spark, d):
    return consensus.sessions(m.packets(spark, d), 7200)


@query(" SELECT CAST(us // 3600000000 AS BIGINT) AS hour, type, count(*) AS packets FROM packets GROUP BY 1, 2")
def q_tumbling(spark, d):
    hours = m.packets(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "type").agg(F.count(F.lit(1)).alias("packets"))
    return hours.select((F.unix_micros(F.col("w.start").cast("timestamp")) / 3_600_000_000).cast("long").alias("hour"), "type", "packets")


@query(" SELECT CAST(us // 3600000000 - k AS BIGINT) AS hour, count(*) AS packets FROM packets, (VALUES (0), (1), (2)) v(k) GROUP BY 1")
def q_sliding(spark, d):
    hours = m.packets(spark, d).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("packets"))
    return hours.select((F.unix_micros(F.col("w.start").cast("timestamp")) / 3_600_000_000).cast("long").alias("hour"), "packets")


_PEER_ORDER = """CASE WHEN last_failure_at > 0 AND (last_success_at = 0 OR last_failure_at > last_success_at) THEN 1 ELSE 0 END, connected_ok DESC,
CASE WHEN first_seq > 0 AND last_seq > 0 THEN 1 ELSE 0 END DESC, CASE WHEN last_success_at > 0 THEN 1 ELSE 0 END DESC,
(CAST(seen_crawl AS INTEGER) + CAST(seen_endpoints AS INTEGER) + CAST(seen_redirect AS INTEGER)) DESC, last_success_at DESC, failure_count, last_seen_at DESC, success_count DESC, endpoint"""


@query(f" SELECT *, CAST(row_number() OVER (ORDER BY {_PEER_ORDER}) AS INTEGER) AS rank FROM peers ORDER BY {_PEER_ORDER} LIMIT 25")
def q_peer_bootstrap(spark, d):
    return consensus.bootstrap(m.peers(spark, d), 25)


@query(" SELECT ledger_seq, endpoint, rank FROM (SELECT CAST(l.seq AS BIGINT) AS ledger_seq, p.endpoint, CAST(row_number() OVER (PARTITION BY l.seq ORDER BY p.last_seq - p.first_seq DESC, p.success_count DESC, p.endpoint) AS INTEGER) AS rank FROM peers p JOIN ledgers l ON l.seq BETWEEN p.first_seq AND p.last_seq WHERE p.failure_count < 4) WHERE rank <= 4")
def q_peer_pick(spark, d):
    peers = m.peers(spark, d)
    return consensus.pick_for(peers, m.ledgers(spark, d), 4, peers.where("failure_count >= 4").select("endpoint"))


@query("w_e AS (SELECT '10.0.' || (peer_id % 250) || ':' || (50000 + peer_id) AS endpoint, type <> 'error' AS ok, us // 1000000 AS seen FROM packets), w_u AS (SELECT endpoint, count(*) FILTER (ok) AS s, count(*) FILTER (NOT ok) AS f, max(seen) AS seen FROM w_e GROUP BY 1) SELECT coalesce(p.endpoint, u.endpoint) AS endpoint, coalesce(success_count, 0) + coalesce(s, 0) AS success_count, coalesce(failure_count, 0) + coalesce(f, 0) AS failure_count, greatest(last_seen_at, seen) AS last_seen_at FROM peers p FULL JOIN w_u u ON p.endpoint = u.endpoint")
def q_peer_upsert(spark, d):
    e = m.packets(spark, d).select(F.concat(F.lit("10.0."), (F.col("peer_id") % 250).cast("string"), F.lit(":"), (F.lit(50000) + F.col("peer_id")).cast("string")).alias("endpoint"), (F.col("type") != "error").alias("ok"), F.floor(F.col("us") / 1_000_000).cast("long").alias("at"))
    return consensus.upsert_peers(m.peers(spark, d), e)


# Texts of failures and the kind that each of them is.
_TEXTS = (
    ("HTTP status=403 status=503", "403"), ("Forbidden", "403"), ("status: 503 timeout", "503"), ("HTTP 503", "other"), ("503 Service Unavailable", "503"),
    ("No route to host", "no-route"), ("connect timeout", "timeout"), ("timed out", "other"), ("stream truncated", "truncated"), ("End of stream", "eof"),
    ("end of file", "other"), ("TLS handshake failed", "tls"), ("TLS alert", "other"), ("could not resolve", "dns"), ("Host not found", "dns"), ("", "disconnect"),
    ("peer disconnected", "disconnect"), ("connection reset", "other"),
)
_TEXTS_SQL = "w_v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(_TEXTS)) + f") v(i, kind)), w_t AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'crawl-' ELSE 'connect-' END || kind AS kind, user_id % 50 AS endpoint, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seen FROM events JOIN w_v ON event_id % {len(_TEXTS)} = i)"


def _failures(spark, d) -> DataFrame:
    text = F.array(*(F.lit(t) for t, _ in _TEXTS))[(F.col("event_id") % len(_TEXTS)).cast("int")]
    kind = consensus.failure_kind(F.nullif(text, F.lit("")), F.col("user_id") % 2 == 0)
    return m.table(spark, d, "events").select(kind.alias("kind"), (F.col("user_id") % 50).alias("endpoint"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"))


@query(_TEXTS_SQL + " SELECT kind, count(*) AS n FROM w_t GROUP BY 1")
def q_failure_buckets(spark, d):
    return _failures(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_TEXTS_SQL + ", w_k AS (SELECT * FROM w_t WHERE seen <= 1706745600 AND seen > 1706745600 - 1209600), w_e AS (SELECT kind, endpoint, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, endpoint) AS r FROM w_k GROUP BY 1, 2) SELECT kind, CAST(sum(n) AS BIGINT) AS n, string_agg(endpoint, ',' ORDER BY r) FILTER (r <= 3) AS top FROM w_e GROUP BY 1")
def q_recent_failures(spark, d):
    """The failures of two weeks by kind, with the three endpoints that fail most."""
    return consensus.recent_failures(_failures(spark, d), 1_706_745_600, 14 * 86_400, 3)


@query(" SELECT endpoint, failure_count, CASE failure_count WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 20 WHEN 4 THEN 40 END AS backoff FROM peers")
def q_retry_backoff(spark, d):
    return m.peers(spark, d).select("endpoint", "failure_count", consensus.retry_backoff(F.col("failure_count")).alias("backoff"))


@query(" SELECT peer_id, type, us, CAST(age AS INTEGER) AS age FROM (SELECT peer_id, type, us, row_number() OVER (PARTITION BY peer_id ORDER BY us DESC, event_id) AS age FROM packets) WHERE age > 10")
def q_lru_evict(spark, d):
    return consensus.evict(m.packets(spark, d), "event_id", "us", 10, "peer_id").select("peer_id", "type", "us", "age")


# ---- scalars --------------------------------------------------------------------------------------


@query(" SELECT seq, CAST(close_time - 946684800 AS BIGINT) AS ledger_time, strftime(to_timestamp(close_time) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS text FROM ledgers")
def q_epoch_ts(spark, d):
    return m.ledgers(spark, d).select("seq", (F.col("close_time") - 946684800).alias("ledger_time"), F.date_format(F.timestamp_seconds("close_time"), "yyyy-MM-dd HH:mm:ss").alias("text"))


@query(" SELECT c_custkey, lower(hex(c_name)) AS hex, base64(encode(c_name)) AS b64, c_name AS back FROM customer")
def q_hex_b64(spark, d):
    b = F.col("c_name").cast("binary")
    return m.table(spark, d, "customer").select("c_custkey", F.lower(F.hex(b)).alias("hex"), F.base64(b).alias("b64"), F.unbase64(F.base64(b)).cast("string").alias("back"))


@query(" SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, CAST((o_orderkey >> 3) & 15 AS BIGINT) AS nibble FROM orders")
def q_bits(spark, d):
    return m.table(spark, d, "orders").select("o_orderkey", F.bit_count("o_orderkey").alias("ones"), F.shiftright("o_orderkey", 3).bitwiseAND(F.lit(15)).alias("nibble"))


