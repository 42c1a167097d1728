"""CSV rows that do not parse, or break a rule, go to quarantine with their reason; the others pass unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_BAD = "_unparsed"


def checked_csv(spark: SparkSession, path: str, schema: StructType, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, Observation]:
    """(good rows, quarantine, counts) of CSV files with a header line.

    A line that does not fit the schema has the reason `unparsed`; else the first rule (a condition over the columns, by the name of its
    reason) that it breaks or leaves null. Quarantine rows are (file, line, reason): the text as it came. Blank lines are none, and a line
    equal to the header is taken for one. Fields hold no line breaks. A bad row is in quarantine once for each time it came, a good row never. counts is observed
    while good rows are read: `rows`, and `bad` by reason as `bad_<reason>`.
    """
    rules = rules or {}
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    header = ",".join(schema.fieldNames())
    lines = lines.filter((F.trim("line") != "") & (F.trim("line") != header))
    parsed = F.from_csv("line", StructType([*schema.fields]).add(_BAD, StringType()).simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = lines.withColumn("_row", parsed).select("file", "line", "_row.*")
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    rows = rows.withColumn("reason", F.when(F.col(_BAD).isNotNull(), "unparsed").otherwise(reason))
    counts = Observation("checked_csv")
    seen = rows.observe(counts, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("reason") == n).alias(f"bad_{n}") for n in ("unparsed", *rules)])
    good = seen.filter("reason is null").select(*schema.fieldNames())
    return good, rows.filter("reason is not null").select("file", "line", "reason"), counts


def keep(quarantine: DataFrame, path: str, load: str) -> None:
    """Write the quarantine of one load; the same load again takes its place."""
    quarantine.write.mode("overwrite").parquet(f"{path}/load={load}")
