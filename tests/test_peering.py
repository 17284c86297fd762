"""Choice of peers and rates over counters on written-out rows."""

from pyspark.sql import functions as F

from tessera.operators import peering

PEERS = "endpoint string, first_seq long, last_seq long, connected_ok boolean, last_success_at long, failure_count long, last_failure_at long, success_count long, current_seq long, last_seen_at long"


def test_candidates_by_each_level(spark):
    rows = [
        ("covers", 5, 9, False, 0, 9, 9, 0, 0, 0), ("ok", 50, 60, True, 5, 0, 0, 1, 60, 1), ("ok-more", 50, 60, True, 5, 0, 0, 2, 60, 1),
        ("failed", 50, 60, True, 5, 0, 6, 9, 60, 9), ("new", 0, 0, False, 0, 0, 0, 0, 0, 0),
    ]
    found = peering.best_candidates(spark.createDataFrame(rows, PEERS), [7], 9).orderBy("rank")
    assert [r.endpoint for r in found.collect()] == ["covers", "ok-more", "ok", "new", "failed"]
    assert peering.best_candidates(spark.createDataFrame([], PEERS), [], 9).count() == 0


def test_blocks_cover_each_range_once(spark):
    ranges = [(0, 0), (1, 1), (3, 17), (0, 255), (1, 256), (90_000_000, 99_000_000), (5, 4), (7, 4_294_967_294)]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", F.explode(peering._blocks(F.col("a"), F.col("b"))).alias("x"))
    held = {}
    for r in rows.select("a", "b", "x.level", "x.block").collect():
        held.setdefault((r.a, r.b), []).append((r.block << r.level, (r.block + 1 << r.level) - 1))
    for a, b in ranges:
        spans = sorted(held.get((a, b), []))
        if a > b:
            assert not spans
            continue
        assert spans[0][0] == a and spans[-1][1] == b and len(spans) <= 62
        assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_selection_skips_failed_and_fills_up(spark):
    rows = [(f"p{i:02d}", i * 10, i * 10 + 25 + i) for i in range(1, 13)]
    peers = spark.createDataFrame(rows, "endpoint string, first_seq long, last_seq long")
    asked = spark.createDataFrame([(30,), (5,)], "ledger_seq long")
    failed = spark.createDataFrame([("p03", 30), ("p12", 5), ("p12", 5), ("p11", 5)], "endpoint string, ledger_seq long")
    found = {}
    for r in peering.select_for(peers, asked, failed, 9).orderBy("ledger_seq", "rank").collect():
        found.setdefault(r.ledger_seq, []).append(r.endpoint)
    assert found == {30: ["p02", "p01", "p12", "p11"], 5: ["p10", "p09", "p08", "p07"]}
    assert peering.select_for(peers.limit(0), asked, failed, 9).count() == 0


def test_counters_that_fall_begin_anew(spark):
    rows = [("a", s * 1_000_000, s, p, p * 10, True) for s, p in enumerate([0, 10, 20, 5, 25])] + [("a", 9_000_000, 9, 30, 300, False), ("a", 10_000_000, 10, 40, 400, True)]
    samples = spark.createDataFrame(rows, "peer_id string, us long, n long, packets long, bytes long, connected boolean")
    assert [r.packets_per_s for r in peering.counter_rates(samples, 60, 200).orderBy("n").collect()] == [0.0, 10.0, 10.0, 0.0, 20.0, 0.0, 0.0]
    assert {r.packets_per_s for r in peering.counter_rates(samples, 60, 1).collect()} == {0.0}  # a sample with itself


def test_names_in_natural_order(spark):
    names = spark.createDataFrame([("peer-10",), ("peer-9",), ("peer-100",), ("other",)], "name string")
    assert [r.name for r in names.orderBy(*peering.natural_order(F.col("name"))).collect()] == ["other", "peer-9", "peer-10", "peer-100"]
