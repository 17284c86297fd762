"""Tries, signed records and proof chains, by hand and under damage."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codec, tries
from tessera.operators import merkle, proofs
from tessera.plans import catalog_proofs as made


def half(raw):
    return hashlib.sha512(raw).digest()[:32]


def plain_root(leaves, depth=0):
    """The root of a whole tree, from its definition."""
    slots = []
    for digit in "0123456789abcdef":
        here = {k: v for k, v in leaves.items() if k[depth] == digit}
        if len(here) == 1:
            ((key, data),) = here.items()
            slots.append(half(b"MLN\0" + data + bytes.fromhex(key)))
        else:
            slots.append(plain_root(here, depth + 1) if here else bytes(32))
    return half(b"MIN\0" + b"".join(slots))


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=32, max_size=32).map(bytes.hex), st.binary(max_size=200), min_size=1, max_size=30))
def test_whole_tries_have_the_trees_root(leaves):
    nodes = list(tries.read_trie(tries.write_trie(leaves, {})))
    assert {k.hex(): v for _, kind, k, v in nodes if kind == "leaf"} == leaves
    assert tries.trie_root(nodes, "leaf") == plain_root(leaves)


def test_abbreviated_trie_has_the_whole_root(spark):
    leaves = {half(b"%d" % i).hex(): b"v%d" % i for i in range(200)}
    key = min(leaves)
    state = spark.createDataFrame([(k, v.hex()) for k, v in leaves.items()], "key string, data string")
    beside = {r.path: bytes.fromhex(r.hash) for r in siblings(state, key)}
    raw = tries.write_trie({key: leaves[key]}, beside)
    assert tries.trie_root(list(tries.read_trie(raw)), "leaf") == plain_root(leaves) and len(raw) < 2500
    assert merkle.root(state, algo="sha512half").first().hash.lower() == plain_root(leaves).hex()


def siblings(state, key):
    """Rows (path, hash) beside a key's path, of the levels that have more than its own leaf."""
    depth, found = 8, []
    levels = merkle.levels(state, depth, "sha512half")
    for d in range(1, depth + 1):
        at = [r for r in levels[depth - d].collect() if len(r.path) == d and r.path[: d - 1] == key[: d - 1]]
        if [r.leaf for r in at] == [key]:
            break
        found += [r for r in at if r.path != key[:d]]
    return found


def test_damaged_tries():
    raw = tries.write_trie({"ab" + "0" * 62: b"data"}, {"1": bytes(32)})
    for cut in range(len(raw)):
        with pytest.raises(ValueError):
            list(tries.read_trie(raw[:cut]))
    with pytest.raises(ValueError, match="deep"):
        list(tries.read_trie((2).to_bytes(4, "little") * 65))
    assert tries.trie_root(list(tries.read_trie(bytes(4))), "tx") == bytes(32)


def test_signed_records():
    raw = made.signed_validation(5, half(b"x"))
    own = tries.read_validation(raw)
    assert own["ledger_hash"] == half(b"x") and own["message"].startswith(b"VAL\0") and len(own["message"]) == 4 + len(raw) - len(own["signature"]) - 2
    assert tries.read_validation(b"") is None and tries.read_validation(raw[:60]) is None
    own = tries.read_manifest(made.signed_manifest(b"m" * 32, 9))
    assert own["sequence"] == 1 and own["master_key"][0] == 0xED and own["domain"] is None and own["master_signature"]
    assert tries.read_manifest(b"")["master_key"] is None


def test_wire_nodes():
    hashes = [half(bytes([i])) if i % 3 else None for i in range(16)]
    whole = b"".join(h or bytes(32) for h in hashes) + b"\2"
    short = b"".join(h + bytes([i]) for i, h in enumerate(hashes) if h) + b"\3"
    assert tries.read_wire_node(whole) == tries.read_wire_node(short) == ("inner", [(i, h) for i, h in enumerate(hashes) if h])
    assert tries.read_wire_node(b"abc\0") == ("transaction", b"abc") and tries.read_wire_node(b"abc\4")[0] == "transaction_with_meta"
    for bad in (b"", b"\5", b"abc\3", bytes(32) + b"\x10\3", b"abc\2"):
        with pytest.raises(ValueError):
            tries.read_wire_node(bad)
    assert tries.wire_id("a1") == b"\xa1" + bytes(31) + b"\2" and len(tries.wire_id("")) == 33


def test_header_hash_and_keys(spark):
    args = (2**32 - 1, 99_999_999_999_999_999, half(b"p"), half(b"t"), half(b"a"), 5, 700_000_000, 10, 1)
    row = spark.range(1).select(proofs.header_hash(*map(F.lit, args)).alias("h"), proofs.skip_list_key().alias("k"), proofs.skip_list_key(F.lit(70_000)).alias("f")).first()
    assert bytes(row.h) == codec.header_hash(*args) and bytes(row.k) == half(b"\0s") and bytes(row.f) == half(b"\0s\0\0\0\1")


STEPS = "proof_id string, step int, kind string, hash binary, trusted boolean, header struct<seq: long, drops: long, parent_hash: binary, tx_hash: binary, account_hash: binary, parent_close_time: long, close_time: long, close_resolution: int, close_flags: int>, trie binary"


def steps_of(spark, **chains):
    rows = [(name, s["step"], s["kind"], s["hash"], s.get("trusted"), s["header"], s["trie"]) for name, chain in chains.items() for s in chain]
    return spark.createDataFrame(rows, STEPS)


def test_chains(spark):
    good = made.chain(10, half(b"x"))
    twice = [*good, good[0] | {"step": 6}]
    no_anchor = [s | {"step": s["step"] - 1} for s in good[1:]]
    parent = good[:1] + [good[1] | {"header": good[1]["header"] | {"close_time": None}}]
    broken = [*good[:4], good[4] | {"trie": b"\1"}]
    refused = [good[0] | {"trusted": False}, *good[1:]]
    found = proofs.verify_chains(steps_of(spark, good=good, twice=twice, no_anchor=no_anchor, parent=parent, broken=broken, refused=refused, other=made.chain(11, half(b"x"))))
    assert {r.proof_id: r.failed for r in found.collect()} == {"good": None, "twice": 6, "no_anchor": 1, "parent": 2, "broken": 5, "refused": 1, "other": 4}
    assert proofs.verify_chains(steps_of(spark, good=good).limit(0)).count() == 0
    lines = [r.line for r in proofs.narrative(proofs.verify_steps(steps_of(spark, good=good, broken=broken))).orderBy("proof_id", "step").collect()]
    assert len(lines) == 10 and "damaged" in lines[4] and lines[4].endswith("NOT GOOD") and "skip list of step 3" in lines[8]


def test_anchors_without_validations_or_list(spark):
    key, manifest, blob, signature = made._publisher()
    rows = [(1, half(b"x"), key, manifest, blob, signature), (2, half(b"x"), key, None, blob, signature), (3, None, None, manifest, None, None), (4, half(b"x"), key, manifest, b"{}", signature), (5, half(b"x"), key, manifest[:-1] + bytes([manifest[-1] ^ 1]), blob, signature)]
    anchors = spark.createDataFrame(rows, "anchor_id int, ledger_hash binary, public_key string, manifest binary, blob binary, signature binary")
    votes = spark.createDataFrame([(1, None), (1, b"abc"), (1, made.signed_validation(1001, half(b"x"))), (1, made.signed_validation(1001, half(b"x")))], "anchor_id int, data binary")
    found = {r.anchor_id: (r.error, r.listed, r.validations, r.verified, r.matched) for r in proofs.verify_anchors(anchors, votes, key).collect()}
    assert found == {1: ("no quorum", 5, 4, 2, 1), 2: ("no manifest", 0, 0, 0, 0), 3: ("another publisher", 0, 0, 0, 0), 4: ("list not signed", 0, 0, 0, 0), 5: ("manifest not signed by its master key", 0, 0, 0, 0)}
