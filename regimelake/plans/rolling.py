"""Rolling thresholds from daily sketches: a new day costs one sketch, any span of days a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000

#: Size of a quantile sketch. The rank of what it returns is off by RANK_ERROR at most, with a confidence of 99 %; up to SIZE values it is exact.
SIZE, RANK_ERROR = 4096, 0.0015


def daily_sketches(windows: DataFrame, value: str, at: str = "start_us", size: int = SIZE) -> DataFrame:
    """(chain, day, n, sketch) of the windows' values; null values do not count, days without any have no row.

    Map tasks sketch and shuffle sketches, so a chain of any length is a few rows. Write them by day:
    sketches of days merge into those of longer spans, and windows that were sketched are never read again.
    """
    w = windows.filter(F.col(value).isNotNull() & F.col(at).isNotNull()).select("chain", F.expr(f"`{at}` div {DAY}").alias("day"), F.col(value).cast("double").alias("_x"))
    return w.groupBy("chain", "day").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_x", F.lit(size)).alias("sketch"))


def rolling_quantile(sketches: DataFrame, q: float, days: int = 30, size: int = SIZE) -> DataFrame:
    """(chain, day, days, n, value): the quantile over the `days` days up to each day that has a sketch.

    Each sketch is dealt to the days that it counts for, and spans merge in map tasks first. days: how many days of
    the span have data. The value is one of the windows' values, of rank `q` within RANK_ERROR.
    """
    ends = sketches.select("chain", F.col("day").alias("_end")).distinct()
    dealt = sketches.withColumn("_end", F.explode(F.sequence(F.col("day"), F.col("day") + days - 1))).join(ends, ["chain", "_end"])
    merged = dealt.groupBy("chain", F.col("_end").alias("day")).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_sketch"))
    return merged.select("chain", "day", "days", "n", F.kll_sketch_get_quantile_double("_sketch", F.lit(q)).alias("value"))


def rolling_threshold(sketches: DataFrame, days: int = 30, q: float = 0.97, least: int = 30) -> DataFrame:
    """rolling_quantile, and as `threshold` its value where `least` days of the span have data."""
    return rolling_quantile(sketches, q, days).withColumn("threshold", F.when(F.col("days") >= least, F.col("value")))
