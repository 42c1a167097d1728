"""The store of blocks as a stream: restarts repeat and lose nothing, gaps hold back what follows."""

from pyspark.sql import functions as F

from regimelake.sources.block_store import BlockReader, read_store, store_blocks


def made(spark, chain, numbers):
    return spark.createDataFrame([(chain, n, n * 10, 1.0, 2.0, 3.0, n) for n in numbers], "chain string, number long, us long, gas_used double, gas_limit double, size double, tx long")


def follow(spark, tmp_path, **options):
    q = read_store(spark, f"{tmp_path}/store", **options).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.chain, r.number) for r in spark.read.parquet(f"{tmp_path}/rows").collect())


def test_restarts_repeat_and_lose_nothing(spark, tmp_path):
    store_blocks(made(spark, "a", range(5, 70)).unionByName(made(spark, "b/c", range(3))), f"{tmp_path}/store", span=20)
    assert follow(spark, tmp_path) == [("a", n) for n in range(5, 70)] + [("b/c", n) for n in range(3)]
    assert len(follow(spark, tmp_path)) == 68  # nothing new
    # 80 to 84 are missing: what follows waits for them. A chain appears later.
    store_blocks(made(spark, "a", [*range(70, 80), *range(85, 130)]).unionByName(made(spark, "d", [7])), f"{tmp_path}/store", span=20)
    assert follow(spark, tmp_path) == [("a", n) for n in range(5, 80)] + [("b/c", n) for n in range(3)] + [("d", 7)]
    store_blocks(made(spark, "a", range(80, 85)), f"{tmp_path}/store", span=20)
    assert follow(spark, tmp_path) == [("a", n) for n in range(5, 130)] + [("b/c", n) for n in range(3)] + [("d", 7)]


def test_ranges_of_a_scan_and_blocks_that_are_not_final(spark, tmp_path):
    store_blocks(made(spark, "a", range(100)), f"{tmp_path}/store", span=30)
    r = BlockReader({"path": f"{tmp_path}/store", "span": "25", "behind": "10"})
    end = r.latestOffset()
    parts = r.partitions(r.initialOffset(), end)
    assert [(p.first, p.end) for p in parts] == [(0, 25), (25, 50), (50, 75), (75, 90)]
    assert [x[1] for p in parts for x in r.read(p)] == list(range(90))
    assert r.partitions(end, end) == [] and all(len(p.files) <= 2 for p in parts)
    # A new reader goes on from any offset.
    again = BlockReader({"path": f"{tmp_path}/store"})
    assert [x[1] for p in again.partitions(end, again.latestOffset()) for x in again.read(p)] == list(range(90, 100))


def test_store_that_is_empty(spark, tmp_path):
    (tmp_path / "store").mkdir()
    assert BlockReader({"path": str(tmp_path / "store")}).latestOffset() == {"chains": "{}"}
    store_blocks(made(spark, "a", [1]).withColumn("number", F.lit(None).cast("long")), f"{tmp_path}/store")
    assert BlockReader({"path": str(tmp_path / "store")}).latestOffset() == {"chains": "{}"}
