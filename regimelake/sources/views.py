"""Inputs: blocks, slots, bridge batches and incident intervals as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _schema(**kinds) -> StructType:
    return StructType([StructField(n, k()) for n, k in kinds.items()])


#: Sources as CSV: explicit types, never inferred.
BLOCK_SCHEMA = _schema(number=LongType, timestamp=StringType, gas_used=DoubleType, gas_limit=DoubleType, transaction_count=LongType, size=LongType)
BASE_SCHEMA = _schema(block_number=LongType, timestamp=StringType, size=DoubleType, transaction_count=LongType, gas_used=DoubleType, basefee_gwei=DoubleType, blob_gas_used=DoubleType)
BRIDGE_SCHEMA = _schema(block_number=LongType, block_timestamp=StringType, blob_count=LongType)
ROLLUP_SCHEMA = _schema(window_start=StringType, block_count=LongType, avg_size=DoubleType, avg_gas_used=DoubleType, avg_basefee_gwei=DoubleType)

_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
HOUR = 3_600_000_000


def _csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed CSV rows; a missing path raises Spark's own error."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_blocks(spark: SparkSession, path: str, chain: str = "evt") -> DataFrame:
    """Blocks of one chain: chain, number, us, gas_used, gas_limit, tx, size."""
    raw = _csv(spark, path, BLOCK_SCHEMA)
    return raw.select(F.lit(chain).alias("chain"), "number", micros(parse_time("timestamp")).alias("us"), "gas_used", "gas_limit", F.col("transaction_count").alias("tx"), "size")


def read_base(spark: SparkSession, path: str, chain: str = "base") -> DataFrame:
    """Base-layer blocks with fee and blob gas: chain, number, us, size, tx, gas_used, basefee, blob."""
    raw = _csv(spark, path, BASE_SCHEMA)
    return raw.select(F.lit(chain).alias("chain"), F.col("block_number").alias("number"), micros(parse_time("timestamp")).alias("us"), "size", F.col("transaction_count").alias("tx"), "gas_used", F.col("basefee_gwei").alias("basefee"), F.col("blob_gas_used").alias("blob"))


def read_bridge(spark: SparkSession, path: str, chain: str = "base") -> DataFrame:
    """Bridge batches: chain, number, us, blobs."""
    raw = _csv(spark, path, BRIDGE_SCHEMA)
    return raw.select(F.lit(chain).alias("chain"), F.col("block_number").alias("number"), micros(parse_time("block_timestamp")).alias("us"), F.col("blob_count").alias("blobs"))


def read_rollup_hours(spark: SparkSession, path: str, chain: str = "rollup") -> DataFrame:
    """Pre-aggregated rollup hours: chain, hour, block_count, size_avg, gas_avg, basefee_avg."""
    raw = _csv(spark, path, ROLLUP_SCHEMA)
    hour = F.floor(micros(parse_time("window_start")) / HOUR)
    return raw.select(F.lit(chain).alias("chain"), hour.alias("hour"), "block_count", F.col("avg_size").alias("size_avg"), F.col("avg_gas_used").alias("gas_avg"), F.col("avg_basefee_gwei").alias("basefee_avg"))


def parse_time(column: str):
    """Timestamps such as `2024-06-20 16:47:00.000000 UTC`, without their fraction and zone."""
    return F.to_timestamp_ntz(F.trim(F.regexp_replace(column, r"(\.0+)? UTC$", "")), F.lit("yyyy-MM-dd HH:mm:ss"))


def micros(column):
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column)


def in_range(blocks: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Blocks with a time from `start` to `end` (both included) and a number over 0: a first block's time means nothing.

    A start cut drops early rows that are not clean, one at a fork those of the regime before.
    """
    b = blocks.filter("number > 0 and us is not null")
    b = b if start is None else b.filter(F.col("us") >= start)
    return b if end is None else b.filter(F.col("us") <= end)


def write_csv(rows: DataFrame, path: str) -> None:
    """Result rows as CSV with a header; without rows, nothing is written."""
    if not rows.isEmpty():
        rows.write.option("header", True).csv(path)


def stream_of(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The Parquet files at `path`, a folder or one file, as a stream of `files` a micro-batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    # A stream lists a folder or a pattern: the pattern of one file is its name with a letter in brackets.
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]" if single else path)


def optional(spark: SparkSession, path: str, schema: StructType, read=None) -> DataFrame:
    """A source that may be missing: then an empty table of `schema`, so that its layer is null everywhere. read: a loader of this module, such as
    read_rollup_hours, whose rows have that schema; without it, Parquet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return read(spark, path) if read else spark.read.schema(schema).parquet(path)


def columns_of(rows: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, ordinal_position, is_nullable) of a table's columns."""
    found = [(table, f.name, i, f.nullable) for i, f in enumerate(rows.schema.fields, 1)]
    return rows.sparkSession.createDataFrame(found, "table_name string, column_name string, ordinal_position int, is_nullable boolean")


def tables_of(spark: SparkSession, pattern: str = "*", most: int = 30) -> DataFrame:
    """(table_name, is_temporary) of the session catalog's tables, `most` of them by name."""
    found = sorted((t.name, t.isTemporary) for t in spark.catalog.listTables(pattern=pattern))
    return spark.createDataFrame(found[:most], "table_name string, is_temporary boolean")


def blocks(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """events as blocks: chain, number, us (epoch microseconds), gas_used, gas_limit, tx, size, basefee, blob."""
    return as_blocks(spark.read.parquet(f"{sf_dir}/events.parquet"), by_type)


def as_blocks(e: DataFrame, by_type: bool = False) -> DataFrame:
    """Rows of events, of a table or a stream, as blocks."""
    chain = F.col("event_type") if by_type else F.lit("evt")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return e.select(
        chain.alias("chain"), F.col("event_id").alias("number"), F.expr(_MICROS).alias("us"), F.col("value").alias("gas_used"), F.lit(600.0).alias("gas_limit"),
        k.alias("tx"), (F.col("value") * F.length("event_type")).alias("size"), F.col("value").alias("basefee"), k.cast("double").alias("blob"),
        F.length("props").alias("input_bytes"), F.expr("cast(regexp_extract(props, '([0-9]+)', 1) as int) % 7").alias("blobs"), "event_type",
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """error events as slot blocks, one slot a minute."""
    return blocks(spark, sf_dir).filter("event_type = 'error'").select("chain", F.expr("us div 60000000").alias("slot"), "us")


#: Labelled intervals: name, onset, end (days of January 2024), states that count as detection.
EVENTS = [("alpha", 6, 9, ["S2D1", "S2D2"]), ("beta", 12, 17, ["S1D2", "S2D2"]), ("gamma", 19, 22, ["S2D1", "S2D2"]), ("delta", 25, 28, ["S2D1", "S1D2", "S2D2"])]
_JANUARY, DAY = 1_704_067_200_000_000, 86_400_000_000

#: The hours that the layers are followed over: 30 days from the first of January 2024.
FIRST_HOUR = _JANUARY // HOUR
LAST_HOUR = FIRST_HOUR + 720


def incidents(spark: SparkSession) -> DataFrame:
    """Incident intervals (event, onset, until, expected); closed, in epoch microseconds."""
    rows = [(n, _JANUARY + (a - 1) * DAY, _JANUARY + (b - 1) * DAY, x) for n, a, b, x in EVENTS]
    return spark.createDataFrame(rows, "event string, onset long, until long, expected array<string>")
