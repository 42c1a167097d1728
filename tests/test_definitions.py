"""Hand-worked rows of the definitions, branch by branch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimelake.functions import ema as E
from regimelake.functions.quantiles import histogram, quantiles
from regimelake.operators import regimes as R
from regimelake.operators import windows as W
from regimelake.plans import composite as C
from regimelake.plans import sweeps as S
from regimelake.sources import views as V

H = V.HOUR
BLOCK = "chain string, number long, us long, size double, tx long, gas_used double, blob double, basefee double"


def test_composite_has_every_branch(spark):
    l1 = spark.createDataFrame([(h, "S1D1", 1.0, 1.0, 1.0, 10.0 if h < 6 else 10.1) for h in range(8)] + [(9, None, None, None, None, None)], "hour long, l1_state string, sigma double, interval_r double, blob_r double, basefee_avg double")
    bridge = spark.createDataFrame([(h, b, 1.0, 2.0) for h, b in enumerate(["BS2", "BS2", "BS2", "BS1", "BS1", "BS1", "BS1", None, None, "BS2"])], "hour long, bs string, age_min double, baseline double")
    l2 = spark.createDataFrame([(h, x, 1.0, 1.0, 1.0) for h, x in [(0, "S1D2"), (1, "S1D1"), (3, "S1D2"), (4, "S2D1"), (5, "S1D1")]], "hour long, l2_state string, sigma double, count_r double, basefee_avg double")
    rows = C.composite(l1, bridge, l2).orderBy("window_start").collect()
    assert len(rows[0]) == 16 and rows[4].window_start == "1970-01-01 04:00:00"
    assert [(r.l2_regime, r.composite, r.alert, r.fee_monitor_visible) for r in rows] == [
        ("S1D2", "MULTI_LAYER", True, False), ("S1D1", "BRIDGE_ONLY", True, False), ("N/A", "BRIDGE_ONLY", True, False), ("S1D2", "L2_ONLY", False, False),
        ("S2D1", "L2_ONLY", True, False), ("S1D1", "NORMAL", False, False), ("N/A", "NORMAL", False, True),
    ]


def test_base_layer_skips_thin_hours(spark):
    """Two blocks an hour, but one in hour 21: it has no state and leaves the baselines alone; a tall hour 22 is D2."""
    rows, n = [], 0
    for h in range(24):
        for k in range(1 if h == 21 else 2):
            size = 1000.0 if h == 21 else 2.0 if h == 22 else 1.0
            rows.append(("a", n, h * H + k * 20_000_000, size, int(size), 1.0, size, 1.0))
            n += 1
    got = {r.hour: r for r in C.base_layer(spark.createDataFrame(rows, BLOCK), 0, 25).collect()}
    assert [h for h in range(25) if got[h].l1_state is None] == [*range(20), 21, 24]
    assert (got[20].l1_state, got[22].l1_state, got[23].l1_state) == ("S1D1", "S1D2", "S1D1")
    assert got[22].sigma == pytest.approx(2.0) and got[23].sigma == pytest.approx(1 / 1.1)


def test_rollup_layer_states_and_missing_hours(spark):
    base = [(h, 100, 1.0, 1.0, 1.0) for h in range(20)]
    more = [(20, 80, 2.0, 2.0, 1.0), (21, 80, 1.0, 1.0, 1.0), (23, 100, 2.0, 2.0, 1.0), (24, 100, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame([("r", *x) for x in base + more], "chain string, hour long, block_count long, size_avg double, gas_avg double, basefee_avg double")
    got = {r.hour: r.l2_state for r in C.rollup_layer(d, 0, 25).collect()}
    assert [got[h] for h in range(20, 25)] == ["S2D2", "S2D1", None, "S1D2", "S1D1"] and got[19] is None


def test_bridge_layer_warms_up_and_ages(spark):
    rows = [("a", i, i * 600_000_000) for i in range(6 * 22)]  # ten minutes apart, none from hour 22 on
    spine = spark.createDataFrame([("a", h, h) for h in range(25)], "chain string, hour long, idx long")
    got = {r.hour: r for r in C.bridge_layer(spine, spark.createDataFrame(rows, "chain string, number long, us long")).collect()}
    assert [got[h].bs for h in (19, 20, 21, 22)] == [None, "BS1", "BS1", "BS2"]
    assert got[22].age_min == pytest.approx(70.0) and got[22].baseline == pytest.approx(10.0)


def test_gaps_of_one_time_and_over_hours(spark):
    rows = [(1, 0), (2, 60_000_000), (3, 60_000_000), (4, 5 * H), (5, 5 * H + 120_000_000)]
    d = spark.createDataFrame([("a", *x) for x in rows], "chain string, number long, us long")
    assert {r.number: r.gap for r in C.batch_gaps(d).collect()} == {1: None, 2: 0.0, 3: 0.0, 4: pytest.approx(299.0), 5: pytest.approx(2.0)}


def test_bridge_grid_and_causal_lookup(spark):
    d = spark.createDataFrame([("S1D1", 1.0, 10.0, 1.0, 2.0), ("S1D2", 1.0, 1.0, 3.0, 1.0), ("S2D1", 5.0, 1.0, 3.0, 1.0), ("S2D2", 5.0, 1.0, None, 1.0), ("S2D1", None, 1.0, 1.0, 1.0), ("S2D2", 1.0, 1.0, 1.0, 1.0), ("S1D2", 1.0, 1.0, 1.0, 1.0)], "l1_state string, t_relay double, expected double, pending double, throughput double")
    out = C.causal(C.bridge_grid(C.bridge_ratios(d))).collect()
    assert sorted((r.l1_state, r.grid, r.reading) for r in out if r.reading) == sorted([
        ("S1D1", "BS1L1", "overall calm"), ("S2D1", "BS2L2", "bridge congested, the rollup answers alone"), ("S2D2", "BS2L1", "bridge congested, the rollup answers alone"),
        ("S2D1", "BS1L1", "structural stress that prices do not show"), ("S2D2", "BS1L1", "systemic congestion"), ("S1D2", "BS1L1", "healthy adoption"),
    ])
    assert [(r.l1_state, r.grid) for r in out if not r.reading] == [("S1D2", "BS1L2")]


def test_adapter_signals(spark):
    d = spark.createDataFrame([(10_000_000, 7_000_000, 99, 5, 10), (10_000_000, None, 99, 0, 0)], "us long, last_us long, input_bytes int, blobs int, tx long")
    a, b = C.adapter_signals(d).collect()
    assert (a.publish_latency, a.calldata_bytes, round(a.blob_usage, 3), a.calldata_per_tx) == (3.0, 655_360, 0.833, 65_536.0)
    assert (b.publish_latency, b.calldata_bytes, b.blob_usage, b.calldata_per_tx) == (None, 99, 0.0, None)


def test_confidence(spark):
    d = spark.createDataFrame([(1.0, 0.1, 3, 31.0), (1.0, 0.1, 3, 30.0), (1.0, 0.2, 3, 31.0), (None, None, 0, 30.0), (None, None, 0, 29.0)], "tpr double, fpr double, n int, days double")
    got = [r[0] for r in d.select(R.confidence(F.col("tpr"), F.col("fpr"), F.col("n"), F.col("days"), F.col("days"))).collect()]
    assert got == ["HIGH", "MEDIUM event-based", "MEDIUM event-based", "MEDIUM statistical", "LOW"]


def test_continuity_check_and_latest(spark):
    w = spark.createDataFrame([("a", i, 1.0, 2.0) for i in range(5)] + [("b", i, 0.5 + i / 10, 3.0) for i in range(5)], "chain string, window_id long, c_s double, rho_ts double")
    got = {r.chain: (r.p50, r.disabled, r.continuity_p10) for r in R.continuity_check(w).collect()}
    assert got == {"a": (1.0, True, None), "b": (0.7, False, 0.54)}
    assert {r.chain: r.valid for r in R.latest_valid(w).collect()} == {"a": True, "b": False}


@pytest.mark.parametrize(("rows", "want"), [
    ([(1.1, 4, 0.04), (1.2, 4, 0.03), (1.3, 3, 0.01)], 1.2),
    ([(1.1, 4, 0.09), (1.2, 2, 0.04), (1.3, 3, 0.04), (1.4, 3, 0.01)], 1.3),
    ([(1.1, 4, 0.09), (1.2, 4, 0.08), (1.3, 3, 0.07), (1.4, 3, 0.06)], 1.3),
])
def test_slot_threshold_and_its_fallbacks(spark, rows, want):
    assert S.select_slot_threshold(spark.createDataFrame(rows, "s2 double, n_detected int, fpr double"), 4).first().s2 == want


def test_sweep_cells_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    w = [(51 + i, i, *(None if rng.random() < 0.1 else round(1 + rng.normal() / 5, 2) for _ in range(4))) for i in range(300)]
    incidents = [("one", 20, 60, ["S2D1"]), ("two", 50, 90, ["S1D2", "S2D2"]), ("none", 1000, 1001, ["S2D1"])]
    grid = [(a, b, 1.1, None) for a in (1.0, 1.12) for b in (1.05, 1.2)]
    got = S.sweep(spark.createDataFrame(w, "idx long, start_us long, rhythm double, sigma double, size_r double, tx_r double"), spark.createDataFrame(grid, "s2 double, d2_sigma double, d2_size double, d2_tx double"), spark.createDataFrame(incidents, "event string, onset long, until long, expected array<string>"), 2)
    for r in got.collect():
        state = {}
        for idx, at, rhythm, *demand in w:
            dims = sum(x is not None and t is not None and x >= t for x, t in zip(demand, (r.d2_sigma, r.d2_size, r.d2_tx), strict=True))
            state[at] = ("S2" if rhythm is not None and rhythm >= r.s2 else "S1") + ("D2" if dims >= 2 else "D1")
        outside = [s for at, s in state.items() if not any(a <= at <= b for _, a, b, _ in incidents)]
        assert r.fpr == pytest.approx(sum(s != "S1D1" for s in outside) / len(outside), abs=6e-5)
        assert (r.n_s2, r.n_d2) == (sum(s[:2] == "S2" for s in state.values()), sum(s[2:] == "D2" for s in state.values()))
        first = {e: min((at for at, s in state.items() if a <= at <= b and s in x), default=None) for e, a, b, x in incidents}
        assert r.latency == {e: round((at - dict((n, a) for n, a, _, _ in incidents)[e]) / 3.6e9, 4) for e, at in first.items() if at is not None}


def test_quantiles_and_histogram_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = {k: np.round(rng.normal(size=n), 2) for k, n in (("a", 1), ("b", 700), ("c", 90))}
    d = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [("a", None), ("z", None)], "chain string, x double").repartition(3)
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p97": 0.97, "p100": 1.0}
    got = {r.chain: r for r in quantiles(d, "x", points, ["chain"]).collect()}
    assert set(got) == set(x)
    for k, vs in x.items():
        assert [got[k][n] for n in points] == pytest.approx(np.quantile(vs, list(points.values())).tolist())
    whole = np.concatenate(list(x.values()))
    assert quantiles(d, "x", {"m": 0.5}).first().m == pytest.approx(np.median(whole))
    assert quantiles(d.filter("x is null"), "x", {"m": 0.5}).collect() == [(None,)]
    count, edges = np.histogram(whole, 20)
    assert sum(r.n for r in histogram(d, "x", 20).collect()) == len(whole)
    assert {r.bin: r.n for r in histogram(spark.range(11), "id", 10).collect()} == dict(enumerate(np.histogram(np.arange(11), 10)[0].tolist()))
    assert [(r.bin, r.n) for r in histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()] == [(50, 2)]


def test_last_before_is_strict_and_carries(spark):
    rows = spark.createDataFrame([("a", 10), ("a", 5 * H), ("a", 5 * H + 7), ("b", 9)], "chain string, us long")
    others = spark.createDataFrame([("a", 10), ("a", 4), ("a", 5 * H), ("c", 1)], "chain string, us long")
    assert {(r.chain, r.us): r.last_us for r in E.last_before(rows, others, H).collect()} == {("a", 10): 4, ("a", 5 * H): 10, ("a", 5 * H + 7): 5 * H, ("b", 9): None}


def test_distribution_shares(spark):
    d = spark.createDataFrame([(i, "S1D1" if i < 58 else "S2D1") for i in range(60)], "idx long, state string")
    assert {r.state: (r.n, r.percent) for r in R.distribution(d).collect()} == {"S1D1": (58, 580.0), "S2D1": (2, 20.0)}
    assert {r.state: (r.n, r.percent) for r in R.distribution(d, valid_only=True).collect()} == {"S1D1": (7, 77.7778), "S2D1": (2, 22.2222)}


def test_single_block_windows_and_rounding(spark):
    w = W.slot_invariants(W.key_windows(spark.createDataFrame([("a", 3, 5), ("a", 11, 2_000_000), ("a", 12, 4_500_000)], "chain string, slot long, us long"), 10), 10, min_blocks=1)
    assert {r.window_id: r.rho_ts for r in w.collect()} == {0: 0.4, 1: 2.5}
    p = W.published(spark.createDataFrame([(1.23456789, 0.123456789, 10.126, 1.00006)], "rho_ts double, rho_s double, size_avg double, tx_count_avg double")).first()
    assert tuple(p) == (1.234568, 0.123457, 10.13, 1.0001)


def test_spine_over_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "SPREAD", 4)
    d = spark.createDataFrame([("a", -6), ("a", 13), ("b", 5)], "chain string, window_id long")
    assert sorted((r.chain, r.window_id) for r in W.spine(d).collect()) == [("a", i) for i in range(-6, 14)] + [("b", 5)]


def test_sources(spark, tmp_path):
    def csv(name, head, *rows):
        (tmp_path / name).write_text("\n".join([head, *rows]) + "\n")
        return str(tmp_path / name)

    t = "2024-06-20 16:47:00.000000 UTC"
    us = 1_718_902_020_000_000
    r = V.read_blocks(spark, csv("a.csv", "number,timestamp,gas_used,gas_limit,transaction_count,size", f"7,{t},1,2,3,4"), "x").first()
    assert (r.chain, r.number, r.us, r.tx, r.size) == ("x", 7, us, 3, 4)
    r = V.read_base(spark, csv("b.csv", "block_number,timestamp,size,transaction_count,gas_used,basefee_gwei,blob_gas_used", "8,2024-06-20 16:47:00 UTC,1,2,3,4.5,5")).first()
    assert (r.number, r.us, r.basefee, r.blob) == (8, us, 4.5, 5.0)
    r = V.read_bridge(spark, csv("c.csv", "block_number,block_timestamp,blob_count", f"9,{t},6")).first()
    assert (r.number, r.us, r.blobs) == (9, us, 6)
    r = V.read_rollup_hours(spark, csv("d.csv", "window_start,block_count,avg_size,avg_gas_used,avg_basefee_gwei", "2024-06-20 16:00:00 UTC,10,1.5,2.5,3.5")).first()
    assert (r.hour, r.block_count, r.basefee_avg) == (us // H, 10, 3.5)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        V.read_blocks(spark, str(tmp_path / "none.csv"))
    assert V.optional(spark, str(tmp_path / "none.parquet"), V.BRIDGE_SCHEMA).count() == 0
    kind = "chain string, hour long, block_count long, size_avg double, gas_avg double, basefee_avg double"
    kind = spark.createDataFrame([], kind).schema
    assert V.optional(spark, str(tmp_path / "none.csv"), kind, V.read_rollup_hours).columns == kind.fieldNames()
    (tmp_path / "hours.csv").write_text("window_start,block_count,avg_size,avg_gas_used,avg_basefee_gwei\n2024-06-20 16:00:00 UTC,3,1.0,2.0,3.0\n")
    there = V.optional(spark, str(tmp_path / "hours.csv"), kind, V.read_rollup_hours)
    assert there.columns == kind.fieldNames() and there.count() == 1
    V.write_csv(spark.range(2), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    V.write_csv(spark.range(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists()
    spark.range(1).createOrReplaceTempView("some_view")
    assert ("some_view", True) in [tuple(r) for r in V.tables_of(spark, "some*").collect()]
    b = spark.createDataFrame([(0, 5), (1, 5), (2, 9), (3, None)], "number long, us long")
    assert [r.number for r in V.in_range(b, 5, 8).collect()] == [1]


def test_first_plan_reads_written_windows(spark):
    from regimelake import suite

    plan = suite.QUERIES["state_distribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "CartesianProduct" not in plan and "events.parquet" not in plan
