"""Streams of blocks and batches: disorder, lateness, restarts and silence."""

import math
import random
import time

import compare
import pytest
from pyspark.sql import functions as F

from regimelake import suite
from regimelake.plans import composite as C
from regimelake.sources import views as V
from regimelake.streaming.bridge import Clock, Watch, watch_bridges
from regimelake.streaming.online import state_store, stream_classify, tick

SF = "/root/testdata/sf0.001"
COLUMNS = ("chain", "idx", "start_us", "end_us", "rho_ts", "rho_s", "rhythm", "rhythm_slow", "sigma", "state")


def blocks(spark):
    return V.blocks(spark, SF, True).select("chain", "number", "us", F.try_divide("gas_used", "gas_limit").alias("load"))


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def follow(spark, tmp_path, schema, make, name="rows"):
    """Run the stream over what is new in `in`, from its checkpoint; all that it has ever said."""
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    with state_store(spark, 2):
        out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}").collect()


def batch_rows(spark, rows, tmp_path):
    """The stream's rows from SQL over a batch of blocks."""
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/sql/events.parquet")
    with compare.duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/sql/events.parquet/*.parquet')")
        found = con.execute(suite.ORACLE_SQL["stream_ema"])
        return compare.rows_of([c[0] for c in found.description], found.fetchall())[1]


def plain(rows):
    rounded = [[round(r[c], 6) if isinstance(r[c], float) else r[c] for c in COLUMNS] for r in rows if r.kind == "window"]
    return compare.rows_of(list(COLUMNS), rounded)[1]


def test_disorder_lateness_and_restarts(spark, tmp_path):
    """Shuffled files with rows up to some 20 hours out of order, a restart after each; five early blocks come last of all."""
    source = blocks(spark).collect()
    events = {r.event_id: tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    schema = blocks(spark).schema
    rng = random.Random(1)
    late = {10, 11, 200, 333, 500}
    rows = sorted((r for r in source if r.number not in late), key=lambda r: r.number + rng.random() * 25)
    counts = []
    for k in range(0, len(rows), 250):
        write(spark, rows[k : k + 250], schema, tmp_path / "in")
        got = follow(spark, tmp_path, schema, lambda b: stream_classify(b, 10, "2 days"))
        counts.append(sum(r.kind == "window" for r in got))
    # Windows come out along the way: what is held is the last two days, not the stream.
    assert counts[0] >= 10 and counts == sorted(counts) and counts[-1] >= 80
    write(spark, [r for r in source if r.number in late], schema, tmp_path / "in")
    follow(spark, tmp_path, schema, lambda b: stream_classify(b, 10, "2 days"))
    tick(spark, f"{tmp_path}/in", suite._END, schema)
    got = follow(spark, tmp_path, schema, lambda b: stream_classify(b, 10, "2 days"))
    assert sorted(r.number for r in got if r.kind == "late") == sorted(late)
    assert plain(got) == batch_rows(spark, [e for k, e in events.items() if k not in late], tmp_path)


def test_early_numbers_wait_and_rows_without_number_are_no_blocks(spark, tmp_path):
    schema = blocks(spark).schema
    H = V.HOUR
    # Block 2 has a later time than block 3: 3 waits for it. Equal numbers fold in order of time.
    write(spark, [("a", 3, 3 * H, 1.0), ("a", 2, 5 * H, None), ("a", 1, H, 3.0), ("a", 1, 2 * H, 5.0), ("a", None, 4 * H, 9.0), ("a", 9, None, 9.0), (None, 1, 4 * H, 7.0)], schema, tmp_path / "in")
    make = lambda b: stream_classify(b, 2, "2 hours")
    got = [r for r in follow(spark, tmp_path, schema, make) if r.chain]
    assert [(r.kind, r.idx, r.start_us, r.end_us, r.rho_s) for r in got] == [("window", 0, H, 2 * H, 4.0)]
    tick(spark, f"{tmp_path}/in", 9 * H, schema)
    got = [r for r in follow(spark, tmp_path, schema, make) if r.chain]
    assert sorted((r.idx, r.start_us, r.end_us, r.rho_s) for r in got) == [(0, H, 2 * H, 4.0), (1, 3 * H, 5 * H, 1.0)]


def _events_in_parts(spark, folder, parts, name):
    e = spark.read.parquet(f"{SF}/events.parquet")
    for condition in parts:
        e.filter(condition).coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    with compare.duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
        return compare.same(suite.QUERIES[name](spark, str(folder)), con, suite.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["stream_ema", "bridge_alarm"])
@pytest.mark.parametrize("parts", [["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], ["event_id >= 600", "event_id between 300 and 599", "event_id < 300"]])
def test_queries_over_interleaved_and_reversed_files(spark, tmp_path, parts, name):
    got, want = _events_in_parts(spark, tmp_path, parts, name)
    assert want[1] and got == want


def _run(clock, batches, steps):
    """The log of a watch whose clock is moved by hand, step by step."""
    w, said, left = Watch(), [], sorted(batches)
    for now in steps:
        ready = [us for us in left if us <= now]
        left = left[len(ready) :]
        said += clock.advance(w, ready, now)
    return said


@pytest.mark.parametrize("seed", range(3))
def test_manual_clock_equals_hourly_states(spark, seed):
    H, rng = V.HOUR, random.Random(seed)
    batches, us = [], 5 * 60_000_000
    while us < 60 * H:
        batches += [us] * rng.choice([1, 1, 1, 2])
        us += int(rng.choice([3, 5, 8, 8, 70, 300]) * 60_000_000 * (0.9 + rng.random() / 5))
    rows = spark.createDataFrame([("a", i, us) for i, us in enumerate(batches)], "chain string, number long, us long")
    spine = spark.createDataFrame([("a", h, h) for h in range(62)], "chain string, hour long, idx long")
    want = {r.hour: r.bs for r in C.bridge_layer(spine, rows).collect()}
    whole = _run(Clock(first=0), batches, [62 * H])
    small = _run(Clock(first=0), batches, range(0, 62 * H + 1, 7 * 60_000_000))
    assert whole == small
    for h, bs in want.items():
        before = [x[2] for x in whole if x[0] < (h + 1) * H]
        assert (before[-1] if before else None) == bs, h
    assert {"BS1", "BS2"} <= set(want.values())


def test_silent_bridge_raises_the_alarm_without_input(spark, tmp_path):
    """Hours of a second, batches 200 ms apart, an alarm after 40 gaps: it comes by the machine's clock."""
    now = time.time_ns() // 1000
    last = now - now % 200_000
    times = [last - 200_000 * k for k in range(25)][::-1]
    write(spark, [("a", us) for us in times], "chain string, us long", tmp_path / "in")
    log = watch_bridges(spark.readStream.schema("chain string, us long").parquet(f"{tmp_path}/in"), Clock(span=1_000_000, warm_up=1, times=60.0))
    with state_store(spark, 1):
        q = log.writeStream.format("memory").queryName("silence").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not [r for r in spark.table("silence").collect() if r.bs == "BS2"]:
            time.sleep(0.5)
        rows = sorted(tuple(r)[1:5] for r in spark.table("silence").collect())
        assert [r[2] for r in rows] == ["BS1", "BS2"] and rows[1][3] == last
        assert rows[1][0] == pytest.approx(last + 60 * 200_000, abs=2) and math.isfinite(rows[1][0])
        write(spark, [("a", time.time_ns() // 1000)], "chain string, us long", tmp_path / "in")
        while time.time() < until and len(spark.table("silence").collect()) < 3:
            time.sleep(0.5)
        assert sorted(tuple(r)[1:5] for r in spark.table("silence").collect())[2][2] == "BS1"
    finally:
        q.stop()
