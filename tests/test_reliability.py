"""Episodes against a loop, quarantine of bad rows, and states that are published once."""

import random

import pytest
from pyspark.sql import functions as F

from regimelake.functions.intervals import carried
from regimelake.operators.episodes import episodes
from regimelake.sources import views as V
from regimelake.sources.quarantine import checked_csv, keep
from regimelake.streaming import publish

ROW = "chain string, idx long, start_us long, rhythm double, fast double, slow double"


def loop(rows, s2, tolerance):
    """Episodes of one chain's rows, one row after the other."""
    out, e = [], None
    for c, idx, us, rhythm, fast, slow in rows:
        hot = rhythm is not None and rhythm >= s2
        if hot and (e is None or e["closed"]):
            e = {"chain": c, "episode": idx, "end_idx": idx, "n": 0, "start_us": us, "end_us": us, "peak": 0.0, "insensitive": 0, "met_us": None, "needed": None, "closed": False, "met": False}
            out.append(e)
        if hot:
            e.update(end_idx=idx, end_us=us, n=e["n"] + 1, peak=max(e["peak"], rhythm))
        elif e is not None:
            e["closed"] = True
            if not e["met"] and slow is not None and fast <= (1 + tolerance) * slow:
                e.update(met=True, met_us=us)
            if not e["met"]:
                needed = None if slow is None else s2 * fast / slow
                e.update(insensitive=e["insensitive"] + 1, needed=max(filter(None, (e["needed"], needed)), default=None))
    return [tuple(x for k, x in e.items() if k not in ("closed", "met")) for e in out]


@pytest.mark.parametrize("bucket", [4, 7, 4096])
def test_episodes_equal_a_loop(spark, bucket):
    rng, rows = random.Random(4), []
    for chain in "abc":
        hot = False
        for idx in range(120):
            hot = rng.random() < (0.8 if hot else 0.15)
            rows.append((chain, idx, idx * 1000 + 7, rng.choice([1.12, 1.2, 1.5]) if hot else rng.choice([1.0, 1.11, None]), rng.choice([1.0, 1.019, 1.05, 1.3]), rng.choice([1.0, 1.0, 1.0, None])))
    got = sorted(tuple(r) for r in episodes(spark.createDataFrame(rows, ROW), bucket=bucket).collect())
    want = sorted(x for chain in "abc" for x in loop([r for r in rows if r[0] == chain], 1.12, 0.02))
    assert [g[:-1] for g in got] == [w[:-1] for w in want] and len(want) > 20
    assert [g[-1] for g in got] == [w[-1] if w[-1] is None else pytest.approx(w[-1]) for w in want]
    assert episodes(spark.createDataFrame([], ROW)).count() == 0


def test_carried_over_empty_buckets(spark):
    rows = [("a", i, x) for i, x in enumerate([None, 1, None, None, None, None, None, None, 2, None])]
    got = carried(spark.createDataFrame(rows, "chain string, idx long, x int"), F.col("x"), "y", bucket=2)
    assert [r.y for r in got.orderBy("idx").collect()] == [None, 1, 1, 1, 1, 1, 1, 1, 2, 2]


def test_bad_rows_go_to_quarantine_once(spark, tmp_path):
    good = [f"{i},2024-06-20 16:{i:02d}:00.000000 UTC,{i * 10}.5,30.0,{i},{i * 100}" for i in range(50)]
    bad = {"x7,2024-06-20 16:00:00 UTC,1.0,30.0,1,1": "unparsed", "8,2024-06-20 16:00:00 UTC,much,30.0,1,1": "unparsed", ",2024-06-20 16:00:00 UTC,1.0,30.0,1,1": "no_number", "9,20 June,1.0,30.0,1,1": "no_time", "10,2024-06-20 16:00:00 UTC,99.0,30.0,1,1": "over_limit"}
    header = ",".join(V.BLOCK_SCHEMA.fieldNames())
    (tmp_path / "in").mkdir()
    lines = good[:20] + list(bad) + good[20:] + [""]
    (tmp_path / "in" / "a.csv").write_text("\n".join([header, *lines]))
    (tmp_path / "in" / "b.csv").write_text(header + "\n" + "10,2024-06-20 16:00:00 UTC,99.0,30.0,1,1")
    (tmp_path / "clean.csv").write_text("\n".join([header, *good]))
    rules = {"no_number": F.col("number").isNotNull(), "no_time": F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"), "over_limit": F.col("gas_used") == F.col("number") * 10 + 0.5}
    rows, quarantine, counts = checked_csv(spark, str(tmp_path / "in"), V.BLOCK_SCHEMA, rules)
    assert sorted(rows.collect()) == sorted(spark.read.schema(V.BLOCK_SCHEMA).option("header", True).csv(str(tmp_path / "clean.csv")).collect())
    assert counts.get == {"rows": 56, "bad_unparsed": 2, "bad_no_number": 1, "bad_no_time": 1, "bad_over_limit": 2}
    for _ in range(2):  # the same load twice is there once
        keep(quarantine, str(tmp_path / "q"), "first")
    kept = spark.read.parquet(str(tmp_path / "q")).collect()
    assert sorted((r.line, r.reason) for r in kept) == sorted([*bad.items(), ("10,2024-06-20 16:00:00 UTC,99.0,30.0,1,1", "over_limit")])
    assert {r.file.rsplit("/", 1)[1] for r in kept} == {"a.csv", "b.csv"} and {r.load for r in kept} == {"first"}


def test_a_batch_that_fails_before_its_manifest_is_published_once(spark, tmp_path, monkeypatch):
    schema = "chain string, idx long, state string"
    for k in range(3):
        spark.createDataFrame([("a", k * 10 + i, "S1D1") for i in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path, real, failed = f"{tmp_path}/out", publish.commit, []

    def once(spark_, path_, place, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost between write and commit")
        real(spark_, path_, place, number)

    monkeypatch.setattr(publish, "commit", once)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(publish.publisher(path)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="lost between"):
        run()
    assert publish.published(spark, path).count() == 10  # the batch without a manifest does not count
    run()
    rows = publish.published(spark, path).collect()
    assert sorted(r.idx for r in rows) == list(range(30)) and sorted({r.batch for r in rows}) == [0, 1, 2] and publish.broken(spark, path) == []
    # A batch that is whole is not written again; one whose rows were changed is found.
    publish.publisher(path)(spark.createDataFrame([("a", 0, "S2D2")], schema), 1)
    assert publish.published(spark, path).filter("state = 'S2D2'").count() == 0
    spark.createDataFrame([("a", 0, "S2D2")], schema).write.mode("append").parquet(f"{path}/rows/batch=2")
    assert publish.broken(spark, path) == [2]
    # Of equal keys the latest batch's row holds.
    assert publish.published(spark, path).filter("idx = 0").select("state").collect() == [("S2D2",)]


@pytest.mark.parametrize(("master", "warehouse", "fails"), [("yarn", "file:/tmp/warehouse", True), ("local-cluster[2,1,1024]", "/tmp/warehouse", True), ("yarn", "hdfs://n/warehouse", False)])
def test_a_warehouse_on_own_disks_is_an_error_on_a_cluster(master, warehouse, fails):
    from types import SimpleNamespace

    from regimelake.sources.shared import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, *default: {"spark.sql.warehouse.dir": warehouse}.get(k, *default)), sparkContext=SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session)
    else:
        assert shared_folder(session) == warehouse
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, *default: "file:/shared"), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(named) == "file:/shared"
