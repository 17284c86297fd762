import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.codec import inner_hash
from tessera.operators import consensus, merkle, state, stats


def history(spark, seed=1, n=300, keys=20):
    rng = random.Random(seed)
    rows = {(rng.randrange(1, 30), f"{rng.randrange(keys):02x}" * 32): None for _ in range(n)}
    data = [(s, k, 254 if rng.random() < 0.3 else 4, f"{rng.randrange(3):02x}") for s, k in rows]
    return spark.createDataFrame(data, "seq int, key string, op int, data string"), data


def folded(data, seq):
    out = {}
    for s, k, op, v in sorted(data):
        if s <= seq:
            out.pop(k, None)
            if op == 4:
                out[k] = v
    return out


def as_dict(df):
    return {r["key"]: r["data"] for r in df.collect()}


def test_state_and_diffs(spark):
    delta, data = history(spark)
    a, b = state.state_asof(delta, 10), state.state_asof(delta, 25)
    assert as_dict(a) == folded(data, 10) and as_dict(b) == folded(data, 25)
    d = state.diff(a, b)
    assert as_dict(state.apply_diff(a, d)) == folded(data, 25)
    assert as_dict(state.apply_diff(b, state.invert_diff(d))) == folded(data, 10)
    assert sorted(state.invert_diff(state.invert_diff(d)).collect()) == sorted(d.collect())
    assert as_dict(state.state_asof(state.slice_history(delta, 10, 25), 25)) == folded(data, 25)
    assert as_dict(state.overlay(a, delta.where("seq = 11"))) == folded(data, 11)
    with pytest.raises(ValueError):
        state.checked_range(delta, 5, 4)


def test_modes(spark):
    delta = spark.createDataFrame([(1, "a", 4, "x"), (2, "a", 4, "y"), (3, "a", 254, None), (4, "a", 4, "z")], "seq int, key string, op int, data string")
    outcome = lambda mode: [r["outcome"] for r in state.set_items(delta, mode).orderBy("seq").collect()]
    assert outcome("add_only") == ["ADD", "FAILED", "ADD"]
    assert outcome("update_only") == ["FAILED", "UPDATE", "FAILED"]
    assert outcome("add_or_update") == ["ADD", "UPDATE", "ADD"]


def tree_root(items, depth=0):
    """The root by plain recursion."""
    if not items and depth:
        return None
    if len(items) == 1 and depth:
        (k, v), = items.items()
        return hashlib.sha512(b"MLN\0" + bytes.fromhex(v) + bytes.fromhex(k)).digest()[:32]
    return inner_hash([tree_root({k: v for k, v in items.items() if k[depth] == c}, depth + 1) for c in "0123456789abcdef"])


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_roots(spark, n):
    items = {hashlib.sha256(str(i).encode()).hexdigest(): f"{i:04x}" for i in range(n)}
    if n == 2:  # a long shared prefix: a chain of inner nodes
        items = {"ab" * 5 + "0" * 54: "01", "ab" * 5 + "1" + "0" * 53: "02"}
    df = spark.createDataFrame(list(items.items()) or [], "key string, data string")
    depth = 12
    assert merkle.root(df, depth, "sha512half").first()["hash"] == tree_root(items).hex()


def test_depth_and_repeated_keys(spark):
    df = spark.createDataFrame([("ab" * 32, "01"), ("ab" * 32, "02")], "key string, data string")
    with pytest.raises(ValueError):
        merkle.depth_for(df)


def test_proof_rebuilds_the_root(spark):
    items = {hashlib.sha256(str(i).encode()).hexdigest(): str(i) for i in range(30)}
    df = spark.createDataFrame(list(items.items()), "key string, data string")
    key = min(items)
    steps = {}
    for r in merkle.proof(df, key, 6).collect():
        steps.setdefault(r["d"], {})[r["path"][-1]] = r["hash"]
    top = max(steps)
    own = hashlib.sha256(("MLN" + items[key] + key).encode()).hexdigest()
    for d in range(top, 0, -1):
        slots = {**steps.get(d, {}), key[d - 1]: own}
        own = hashlib.sha256(("MIN" + "".join(slots.get(c, "0" * 64) for c in "0123456789abcdef")).encode()).hexdigest()
    assert own == merkle.root(df, 6).first()["hash"]


def test_flags(spark):
    rows = spark.createDataFrame([(1,), (255,), (256,), (257,)], "t int").select(merkle.flag_ledger(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in rows] == [256, 256, 512, 512]


def test_numbers_without_one_task(spark):
    df = spark.range(0, 30000, 3).withColumnRenamed("id", "k")
    got = [r["record_no"] for r in state.numbered(df, "k", 1000).orderBy("k").collect()]
    assert got == list(range(10000))


def test_empty_inputs(spark):
    delta = spark.createDataFrame([], "seq int, key string, op int, data string")
    assert state.state_asof(delta, 5).count() == 0 and state.diff(state.state_asof(delta, 1), state.state_asof(delta, 2)).count() == 0
    assert stats.array_stats(delta, "key").first()["max_length"] == 0


def test_failure_buckets(spark):
    texts = [("Status=503 and status: 403", False), ("HTTP 503 timeout", True), ("timed out", True), ("TLS handshake", False), (None, False), ("", True)]
    rows = spark.createDataFrame(texts, "t string, c boolean")
    got = [r["k"] for r in rows.select(consensus.failure_kind(F.col("t"), F.col("c")).alias("k")).collect()]
    assert got == ["connect-403", "crawl-timeout", "crawl-other", "connect-tls", "connect-disconnect", "crawl-disconnect"]


def test_backoff(spark):
    rows = spark.range(0, 10).select(consensus.retry_backoff(F.col("id")).alias("b")).collect()
    assert [r["b"] for r in rows] == [0, 5, 10, 20, 40, 80, 160, 300, 300, 300]


def test_roots_of_every_version(spark):
    import random

    rng = random.Random(1)
    keys = [f"{i:x}".rjust(2, "0") + f"{rng.randrange(16**10):010x}" for i in range(40)]
    keys[1] = keys[0][:11] + ("1" if keys[0][11] != "1" else "2")  # eleven digits in common
    rows = {(seq, k): (4, str(rng.random())) if rng.random() < 0.7 else (254, None) for seq in range(2, 20) for k in rng.sample(keys, 5)}
    delta = spark.createDataFrame([(s, k, *v) for (s, k), v in rows.items()], "seq int, key string, op int, data string")
    roots = merkle.root_history(state.validity(delta))
    found = {r["seq"]: r["computed"] for r in merkle.verified(spark.range(0, 25).selectExpr("cast(id as int) AS seq", "'' AS stated"), roots).collect()}
    for seq in (0, 1, 2, 5, 11, 19, 24):
        assert found[seq] == merkle.root(state.state_asof(delta, seq)).first()["hash"], seq


def test_nothing_is_missed_by_fingerprints(spark):
    rows = spark.range(5000).selectExpr("sha2(cast(id as string), 256) AS key", "id")
    got = state.probable_members(rows, rows.where("id % 3 = 0"))
    assert got.where("id % 3 = 0 and not probable").count() == 0 and got.count() == 5000 and 0 < got.where("id % 3 > 0 and probable").count() < 50


def test_proofs_give_the_root(spark):
    import hashlib

    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), f"v{i}", 1) for i in range(60)]
    rows.append((rows[0][0][:6] + ("0" if rows[0][0][6] != "0" else "1") * 58, "deep", 1))
    for n in (1, 61):
        s = spark.createDataFrame(rows[:n], "key string, data string, seq int")
        want = merkle.root(s).first()["hash"]
        for key, data, _ in {rows[0], rows[n - 1]}:
            leaf = F.sha2(F.lit("MLN" + data + key).cast("binary"), 256)
            proof = merkle.proof(s, key, merkle.depth_for(s))
            assert merkle.rebuilt_root(proof, key, leaf).first()["hash"] == want
            assert merkle.rebuilt_root(proof, key, F.sha2(F.lit("other").cast("binary"), 256)).first()["hash"] != want
            if n > 1:
                changed = proof.withColumn("hash", F.when(F.col("d") == 1, F.sha2("hash", 256)).otherwise(F.col("hash")))
                assert merkle.rebuilt_root(changed, key, leaf).first()["hash"] != want
