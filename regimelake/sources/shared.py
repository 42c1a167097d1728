"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, the warehouse, or in local mode a temporary folder.

    A warehouse on a machine's own disk is none that executors share: on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is on each machine's own disk")
        return warehouse
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that is removed when the interpreter ends."""
    path = f"{shared_folder(spark)}/regimelake-{kind}-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, for all executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table behind what `materialize` returned, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path in _folders:
        _drop(path, _folders.pop(path))


def _drop(path: str, spark: SparkSession) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the cluster cleans its own scratch space
        return


@atexit.register
def _drop_all() -> None:
    for path, spark in _folders.items():
        _drop(path, spark)
