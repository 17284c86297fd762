import hashlib

import pytest

from tessera.operators import state
from tessera.sources import catalogue as c
from tessera.sources import store

KEY = [bytes([i]) * 32 for i in range(5)]


def ledger(seq):
    return (seq, bytes(32), bytes(32), bytes(32), bytes(32), 2**64 - 1 - seq, 0, 10, 100 + seq, 90 + seq)


LEDGERS = [
    (ledger(1), [(4, KEY[2], b"c"), (4, KEY[0], b"")], [(3, KEY[4], b"tx")]),
    (ledger(2), c.delta_items([KEY[0]], [(KEY[2], b"c2")], [(KEY[1], b"b")]), []),
    (ledger(3), [(254, KEY[3], None)], []),
]


@pytest.mark.parametrize("level", [0, 9])
def test_round_trip(spark, tmp_path, level):
    data = c.build(LEDGERS, network=7, level=level)
    (tmp_path / "a.catalogue").write_bytes(data)
    head = c.parse_header(data)
    assert (head["min"], head["max"], head["level"], head["network"]) == (1, 3, level, 7)
    assert head["digest"] == hashlib.sha512(data[:24] + bytes(64) + data[88:]).digest()
    got = c.read_ledgers(spark, str(tmp_path)).orderBy("seq").collect()
    assert [int(g["drops"]) for g in got] == [2**64 - 2, 2**64 - 3, 2**64 - 4]
    delta = c.as_delta(c.read_items(spark, str(tmp_path)))
    final = {r["key"]: bytes(r["data"]) for r in state.state_asof(delta, 3).collect()}
    assert final == {KEY[1].hex(): b"b", KEY[2].hex(): b"c2"}
    kinds = {(r["seq"], r["action"]) for r in state.classify(delta).collect()}
    assert (3, "MISSING") in kinds and (2, "REMOVE") in kinds and (2, "UPDATE") in kinds
    assert c.file_hashes(spark, str(tmp_path)).first()["valid"]
    assert c.validate(spark, str(tmp_path)).first()["problem"] is None
    assert c.read_items(spark, str(tmp_path), with_data=False).where("data is not null").count() == 0


def test_recompress():
    plain = c.build(LEDGERS)
    assert c.recompress(c.recompress(plain, 9), 0) == plain


def test_order_of_a_delta():
    items = c.delta_items([KEY[3], KEY[1]], [(KEY[2], b"m")], [(KEY[4], b"a"), (KEY[0], b"a")])
    assert [i[1] for i in items] == [KEY[1], KEY[3], KEY[2], KEY[0], KEY[4]]


def test_damage(spark, tmp_path):
    data = c.build(LEDGERS)
    with pytest.raises(ValueError, match="not a catalogue"):
        c.parse_header(b"XXXX" + data[4:])
    with pytest.raises(ValueError, match="bytes"):
        c.parse_header(data + b"x")
    with pytest.raises(ValueError):
        list(c.scan(data[:16] + (len(data) - 3).to_bytes(8, "little") + data[24:-3]))
    (tmp_path / "bad").write_bytes(data[:60])
    assert c.validate(spark, str(tmp_path)).first()["problem"]
    (tmp_path / "bad").write_bytes(data[:100] + b"!" + data[101:])
    assert not c.file_hashes(spark, str(tmp_path)).first()["valid"]


def test_dat_records_stop_at_a_partial_tail(spark, tmp_path):
    record = lambda k, v: len(v).to_bytes(6, "big") + k + v
    body = bytes(92) + record(KEY[0], b"one") + bytes(6) + (4).to_bytes(2, "big") + b"spil" + record(KEY[1], b"two")
    (tmp_path / "x.dat").write_bytes(body + record(KEY[2], b"cut")[:-1])
    rows = c.read_dat(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [(r["record_no"], r["size"], r["value"] and bytes(r["value"])) for r in rows] == [(0, 3, b"one"), (1, 0, b"spil"), (2, 3, b"two")]


def test_stores(spark, tmp_path):
    delta = spark.createDataFrame([(s, k, 4, f"{k}{s}") for s in (1, 999, 1000, 2500) for k in ("aa", "bb")], "seq int, key string, op int, data string")
    store.write_history(delta, f"{tmp_path}/h")
    part = store.read_history(spark, f"{tmp_path}/h", 900, 1000)
    assert sorted({r["seq"] for r in part.collect()}) == [999, 1000]
    nodes = spark.createDataFrame([("aa", 1, b"x"), ("aa", 1, b"x"), ("bb", 1, b"y")], "hash string, node_type int, payload binary")
    assert store.insert_nodes(spark, f"{tmp_path}/n", nodes) == 2
    assert store.insert_nodes(spark, f"{tmp_path}/n", nodes) == 0
    assert store.fetch_node(spark, f"{tmp_path}/n", "bb").count() == 1
