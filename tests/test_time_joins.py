"""Interval and as-of joins, validity ranges, the ledger and rolling sketches against loops over all rows."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimelake.functions.intervals import as_of, interval_join, valid_at
from regimelake.operators import regimes as R
from regimelake.operators import windows as W
from regimelake.plans.ledger import Ledger
from regimelake.plans.rolling import RANK_ERROR, daily_sketches, rolling_quantile, rolling_threshold
from regimelake.sources import views as V

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), k, rng.choice([rng.randint(0, 900), None])) for k in range(200)]
    spans = [(rng.choice("ab"), f"e{k}", a := rng.randint(0, 900), a + rng.choice([0, 3, 250, -5])) for k in range(60)]
    return points, spans, spark.createDataFrame(points, "chain string, id long, start_us long"), spark.createDataFrame(spans, "chain string, event string, onset long, until long")


@pytest.mark.parametrize("on", [(), ("chain",)])
def test_interval_join_equals_loop(made, on):
    points, spans, p, i = made
    p = p if on else p.drop("chain")
    want = {(k, e) for c, k, t in points for d, e, a, b in spans if t is not None and a <= t <= b and (not on or c == d)}
    inner = interval_join(p, i, on, bucket=50)
    assert sorted(inner.select("id", "event").collect()) == sorted(want)
    assert {r.id for r in interval_join(p, i, on, how="left_anti", bucket=50).collect()} == {k for _, k, _ in points} - {k for k, _ in want}
    assert sorted(r.id for r in interval_join(p, i, on, how="left_semi", bucket=50).collect()) == sorted({k for k, _ in want})
    left = interval_join(p, i, on, how="left", bucket=50).select("id", "event").collect()
    assert len(left) == len(want) + len(points) - len({k for k, _ in want})
    assert inner.columns == p.columns + ([] if on else ["chain"]) + ["event", "onset", "until"]


def test_a_million_intervals_without_a_nested_loop(spark):
    i = spark.range(1_000_000).select((F.col("id") * 1000).alias("onset"), (F.col("id") * 1000 + 10).alias("until"))
    p = spark.range(100_000).select((F.col("id") * 9999).alias("start_us"))
    inner, anti = interval_join(p, i, bucket=10_000), interval_join(p, i, how="left_anti", bucket=10_000)
    for df in (inner, anti):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    want = sum(9999 * k % 1000 <= 10 and 9999 * k < 1_000_000_000 for k in range(100_000))
    assert inner.count() == want and anti.count() == 100_000 - want


def test_as_of_equals_loop(spark, made):
    points, _, p, _ = made
    rng = random.Random(5)
    log = [(rng.choice("abc"), rng.randint(0, 900), rng.randint(0, 99)) for _ in range(80)] + [("a", None, 1)]
    got = as_of(p, spark.createDataFrame(log, "chain string, since long, x long"), {"x": F.col("x")}, since="since", bucket=70)
    assert got.columns == [*p.columns, "x"]
    want = {k: max(((s, x) for d, s, x in log if s is not None and t is not None and d == c and s <= t), default=(0, None))[1] for c, k, t in points}
    assert {r.id: r.x for r in got.collect()} == want


RANGE = "chain string, version string, valid_from long, valid_to long"


def test_ranges_in_force(spark, made):
    points, _, p, _ = made
    ranges = [("a", "v1", 0, 300), ("a", "v2", 300, 500), ("a", "none", 320, 320), ("a", "v3", 600, None), ("b", "w1", 100, 101)]
    got = {r.id: r.version for r in valid_at(p, spark.createDataFrame(ranges, RANGE), ["version"]).collect()}
    want = {k: next((v for d, v, a, b in ranges if t is not None and d == c and a <= t and (b is None or t < b)), None) for c, k, t in points}
    assert got == want and len(set(want.values())) >= 4


@pytest.mark.parametrize("bad", [[("a", "x", 0, 10), ("a", "y", 9, 20)], [("a", "x", 0, None), ("a", "y", 5, 6)], [("a", "x", None, 6)], [("a", "x", 3, 9), ("a", "y", 3, 9)]])
def test_overlapping_ranges_are_an_error(spark, made, bad):
    with pytest.raises(ValueError, match="overlap"):
        valid_at(made[2], spark.createDataFrame(bad, RANGE), ["version"])


def test_validity_of_the_published_signals(spark):
    """Means and deviations as published, by chain; what is used there is Valid, what is left out is not."""
    rows = [
        ("polygon", "rho_ts", 354, 2.000, 0.005, "Dormant"), ("polygon", "rho_s", 354, 0.6244, 0.0610, "Valid"), ("polygon", "c_s", 354, 0.9999, 0.0006, "Dormant"),
        ("ethereum", "rho_ts", 349, 12.0155, 0.0548, "Valid"), ("ethereum", "rho_s", 349, 0.5076, 0.0081, "Dormant"), ("ethereum", "c_s", 349, 1.0, 0.0, "Dormant"),
        ("solana", "rho_ts", 339, 0.3937, 0.0044, "Valid"), ("solana", "rho_s", 338, 0.7293, 0.1149, "Valid"), ("solana", "c_s", 338, 0.9985, 0.0033, "Dormant"),
        ("avalanche", "rho_ts", 354, 1.0719, 0.0660, "Valid"), ("avalanche", "rho_s", 354, 0.1294, 0.0283, "Valid"), ("avalanche", "c_s", 354, 0.9999, 0.0006, "Dormant"),
        ("arbitrum", "rho_s", 19, 0.0, 0.0, "Broken"), ("arbitrum", "rho_ts", 19, 0.2521, 0.0058, "Dormant"), ("base", "rho_ts", 14, 4.679, 4.135, "Dormant"), ("base", "c_s", 14, 0.7, 0.3, "Redundant"),
        ("base", "rho_s", 14, 0.1392, 0.0112, "Observational"), ("optimism", "rho_s", 15, 0.4421, 0.0223, "Observational"), ("other", "rho_s", 40, None, None, "Broken"), ("other", "unknown", 40, 1.0, 1.0, None),
    ]
    d = spark.createDataFrame([r[:5] for r in rows], "chain string, signal string, n long, mean double, deviation double")
    got = {(r.chain, r.signal): (r.status, r.reason) for r in R.validity(d, spark.createDataFrame(R.VALIDITY, R.VALIDITY_SCHEMA)).collect()}
    assert {k: v[0] for k, v in got.items()} == {(c, s): x for c, s, *_, x in rows}
    assert got["arbitrum", "rho_s"][1] == "mean" and got["base", "c_s"][1] == "by design" and got["polygon", "rho_ts"][1] == "variation" and got["solana", "rho_ts"][1] is None


def rounded(rows):
    return sorted([x if not isinstance(x, float) else round(x, 6) for x in r] for r in rows.select("chain", "window_id", "epoch", "start_us", "rho_ts", "e_rho", "slow_rho", "e_sigma").collect())


def test_appended_runs_equal_one_run(spark, tmp_path):
    b = V.blocks(spark, SF, True)
    resets = spark.createDataFrame([("click", V._JANUARY + 9 * V.DAY), ("click", V._JANUARY + 20 * V.DAY), ("view", V._JANUARY)], "chain string, at_us long")
    whole = Ledger(spark, f"{tmp_path}/whole", 7)
    assert whole.append(b, resets) == 1
    parts = Ledger(spark, f"{tmp_path}/parts", 7)
    late = b.filter("chain = 'purchase' and number > 500")  # a chain that comes later than the others
    assert parts.append(b.filter("number < 301 and chain <> 'purchase'"), resets) == 1
    # What the first run closed is gone: the next one does not read it.
    shutil.move(f"{tmp_path}/parts/windows/version=1", f"{tmp_path}/aside")
    assert parts.append(b.filter("number between 301 and 640 and chain <> 'purchase' or number <= 500 and chain = 'purchase'"), resets) == 2
    # A run that failed before its mark counts as none, and one that comes twice adds nothing.
    shutil.rmtree(f"{tmp_path}/parts/marks/version=2")
    assert parts.version() == 1
    assert parts.append(b.filter("number between 200 and 640 and chain <> 'purchase' or number <= 500 and chain = 'purchase'"), resets) == 2
    assert parts.append(b.filter("number between 301 and 640 and chain <> 'purchase'"), resets) == 3
    assert parts.append(b.filter("number > 640 and chain <> 'purchase'").unionByName(late), resets) == 4
    shutil.move(f"{tmp_path}/aside", f"{tmp_path}/parts/windows/version=1")
    assert rounded(parts.windows()) == rounded(whole.windows())
    assert spark.read.parquet(f"{tmp_path}/parts/open/version=4").groupBy("chain").count().agg(F.max("count")).first()[0] < 7
    epochs = {r.chain: r.m for r in whole.windows().groupBy("chain").agg(F.max("epoch").alias("m")).collect()}
    assert epochs["click"] == 2 and epochs["view"] == 1 and epochs["error"] == 0
    one = W.invariants(W.count_windows(b, 7), 7).filter("block_count = 7")
    assert one.count() == whole.windows().count()


def test_ledger_of_nothing(spark, tmp_path):
    b = V.blocks(spark, SF, True)
    x = Ledger(spark, str(tmp_path), 10)
    assert x.version() == 0 and x.append(b.limit(0)) == 1 and x.windows().count() == 0
    x.append(b.limit(25).unionByName(b.limit(3).withColumn("number", F.lit(None).cast("long"))))
    assert x.carry().agg(F.sum("next_window")).first()[0] == x.windows().count()


def test_rolling_quantiles_within_the_rank_error(spark, tmp_path):
    day, rng = V.DAY, np.random.default_rng(3)
    x = {d: rng.lognormal(size=9000) for d in (0, 1, 2, 5)}
    rows = [("a", int(d * day + k), float(v)) for d, values in x.items() for k, v in enumerate(values)] + [("a", 3 * day, None), ("b", 0, 2.0)]
    w = spark.createDataFrame(rows, "chain string, start_us long, v double")
    for d in range(6):  # a day at a time: a new day writes its own sketches, and no earlier day is read
        daily_sketches(w.filter(F.expr(f"start_us div {day} = {d}")), "v").write.mode("append").parquet(str(tmp_path / "sketches"))
    kept = spark.read.parquet(str(tmp_path / "sketches"))
    assert kept.count() == 5
    got = {(r.chain, r.day): r for r in rolling_quantile(kept, 0.97, days=3).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("a", 5), ("b", 0)] and got["b", 0].value == 2.0
    for d, n in ((0, 1), (1, 2), (2, 3), (5, 1)):
        values = np.concatenate([x[k] for k in range(d - 2, d + 1) if k in x])
        assert got["a", d].days == n and got["a", d].n == len(values)
        assert abs(np.mean(values <= got["a", d].value) - 0.97) <= RANK_ERROR + 1 / len(values)
    limits = {(r.chain, r.day): r.threshold for r in rolling_threshold(kept, days=3, least=3).collect()}
    assert limits["a", 1] is None and limits["a", 2] == pytest.approx(got["a", 2].value, rel=0.05)  # sketches draw lots
