"""Content-addressed trees, walks in damaged stores, blobs and identifiers."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.operators import merkle, nodes, state


def half(raw):
    return hashlib.sha512(raw).digest()[:32]


@pytest.fixture(scope="module")
def tree(spark):
    keys = [half(b"%d" % i).hex() for i in range(60)]
    keys.append(keys[0][:8] + ("0" if keys[0][8] != "0" else "1") + "0" * 55)  # shares eight digits
    rows = spark.createDataFrame([(k, f"{i:04x}") for i, k in enumerate(keys)], "key string, data string")
    root = merkle.root(rows, algo="sha512half").first().hash.lower()
    made = nodes.tree_nodes(rows)
    return keys, root, spark.createDataFrame(made.collect(), made.schema)


def test_nodes_fit_their_hashes(tree):
    keys, root, made = tree
    assert nodes.mismatched(made).count() == 0
    assert made.where(F.col("hash") == root).count() == 1 and made.where("kind = 'leaf'").count() == len(keys)
    assert made.count() == made.select("hash").distinct().count()


def test_walk_finds_every_key_and_says_what_is_missing(spark, tree):
    keys, root, made = tree
    probes = spark.createDataFrame([(root, k) for k in [*keys, "f" * 64]] + [("ab" * 32, keys[0]), (merkle.ZERO, keys[1])], "root string, key string")
    found = {(r.root, r.key): r for r in nodes.walk(made, probes, 9).collect()}
    assert len(found) == len(keys) + 3
    for i, k in enumerate(keys):
        assert found[root, k].status == "found" and bytes(found[root, k].data) == i.to_bytes(2, "big")
    assert found[root, keys[0]].depth == 9 and found[root, "f" * 64].status == "absent"
    assert (found["ab" * 32, keys[0]].status, found[merkle.ZERO, keys[1]].status) == ("missing", "absent")
    gone = made.where(F.lower(F.hex(F.expr("substring(payload, octet_length(payload) - 31)"))) != keys[5])
    assert nodes.walk(gone, probes.where(F.col("key") == keys[5]), 9).first().status == "missing"
    assert nodes.walk(made, probes.where(F.col("key") == keys[0]), 5).orderBy("root").collect()[-1].status == "missing"  # deeper than asked
    assert nodes.walk(made.limit(0), probes.limit(0), 2).count() == 0


def test_packed_nodes_come_back(tree):
    _, _, made = tree
    blobs = nodes.packed(made)
    assert nodes.unpacked(blobs).exceptAll(made.select("hash", "kind", "payload")).count() == 0
    report = {r.kind: r for r in nodes.packing_report(made, blobs).collect()}
    assert report["inner"].stored < report["inner"].raw and abs(sum(r.share for r in report.values()) - 1) < 1e-5


@given(st.binary(max_size=5000), st.booleans())
def test_blobs(payload, lz4):
    assert codec.unwrap_blob(codec.wrap_blob("transaction", payload, lz4)) == ("transaction", payload)


def test_blob_forms():
    children = [half(bytes([i])) if i % 2 else None for i in range(16)]
    assert codec.unwrap_blob(codec.wrap_inner("account", children)) == ("account", b"".join(c or bytes(32) for c in children))
    for bad in (b"", bytes(9), bytes(8) + b"\3\x07x", bytes(8) + b"\3\1\0x"):
        with pytest.raises(ValueError):
            codec.unwrap_blob(bad)


def test_identifiers():
    # Published values: the account and seed of the passphrase "masterpassphrase".
    assert codec.read_identifier("rHb9CJAWyB4rj91VRWn96DkukG4bwdtyTh") == ("account", bytes.fromhex("b5f762798a53d543a014caf8b297cff8f2f937e8"))
    assert codec.identifier("seed", bytes.fromhex("dedce9ce67b451d852fd4e846fcde31c")) == "snoPBrXtMeMyMHUVTgbuqAfg1SUTb"
    assert codec.read_identifier("snoPBrXtMeMyMHUVTgbuqAfg1SUTb", "account") is None
    account = bytes(range(20))
    assert codec.x_address(account)[0] == "X" and codec.x_address(account, 7, True)[0] == "T"
    for tag in (None, 0, 2**32 - 1):
        assert codec.read_x_address(codec.x_address(account, tag)) == (account, tag, False)
    body = account + b"\0\1" + bytes(7)  # a tag without its flag
    assert codec.read_x_address(codec.base58check(body, codec.X_MAIN)) is None and codec.read_x_address("X") is None
    with pytest.raises(ValueError):
        codec.identifier("account", b"short")


def test_rekeyed_and_sample(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    mapping = spark.createDataFrame([(1, 9), (1, 8)], "old_key int, new_key int")
    assert sorted((r.k or 0, r.v) for r in state.rekeyed(rows, mapping, "k").collect()) == [(0, "d"), (2, "c"), (9, "a"), (9, "b")]
    numbers = spark.range(100)
    one = [r.id for r in state.seeded_sample(numbers, "id", 10, 1).collect()]
    assert sorted(one) == sorted(r.id for r in state.seeded_sample(numbers.repartition(7), "id", 10, 1).collect()) and len(one) == 10
    assert state.seeded_sample(numbers, "id", 500, 2).count() == 100
