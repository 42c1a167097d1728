"""States published exactly once: a batch counts from its manifest on, and a batch that comes again takes its own place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _batches(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def _digest(rows: DataFrame) -> DataFrame:
    """(n, digest): how many rows, and a hash of them that does not depend on their order."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(rows.columns))), F.lit(0)).cast("long").alias("digest"))


def publisher(path: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: writes a batch's rows under its number, and then, last of all, its manifest with their count and digest.

    A stream that fails in between gives the batch again, under the same number: it overwrites what was left. A batch
    with a manifest is whole and is not written again.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number in _batches(spark, path):
            return
        place = f"{path}/rows/batch={number}"
        rows.write.mode("overwrite").parquet(place)
        commit(spark, path, place, number)

    return write


def commit(spark: SparkSession, path: str, place: str, number: int) -> None:
    """The manifest of a batch that is written."""
    _digest(spark.read.parquet(place)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")


def published(spark: SparkSession, path: str, keys: tuple[str, ...] = ("chain", "idx")) -> DataFrame:
    """The rows of all whole batches with their `batch`; of rows with equal `keys` the latest batch's."""
    parts = [f"{path}/rows/batch={k}" for k in _batches(spark, path)]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*parts)
    latest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [*keys, "batch"])


def broken(spark: SparkSession, path: str) -> list[int]:
    """Batches whose rows are not what their manifest says."""
    out = []
    for k in _batches(spark, path):
        said = spark.read.parquet(f"{path}/manifest/batch={k}").first()
        if tuple(_digest(spark.read.parquet(f"{path}/rows/batch={k}")).first()) != tuple(said):
            out.append(k)
    return out
