"""Exact quantiles and histograms without holding a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Ranges that the values of one group are cut into.
RANGES = 128


def quantiles(rows: DataFrame, column: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and one column for each of `points`: exact quantiles, interpolated linearly; nulls take no part.

    Distinct values with their counts are cut into ranges by approximate quantiles; places come from the
    ranges' counts and the place within a range, so each task sorts one range. Without `by` there is one
    row, of nulls if there is no value.
    """
    spark = rows.sparkSession
    keys = by or ["_all"]
    r = rows if by else rows.withColumn("_all", F.lit(0))
    values = materialize(r.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    splits = values.groupBy(*keys).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("_splits"), F.sum("_n").alias("_total"))
    ranged = values.join(splits, keys).withColumn("_range", F.size(F.filter("_splits", lambda s: s < F.col("_v")))).drop("_splits")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum")).select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_cum", F.sum("_n").over(inside)).join(sums, [*keys, "_range"]).withColumn("_end", F.col("_before") + F.col("_cum")).withColumn("_begin", F.col("_end") - F.col("_n"))

    def value(place):
        return F.max(F.when((F.col("_begin") <= place) & (place < F.col("_end")), F.col("_v")))

    out = []
    for i, p in enumerate(points.values()):
        at = F.lit(p) * (F.col("_total") - 1)
        out += [value(F.floor(at)).alias(f"_l{i}"), value(F.ceil(at)).alias(f"_h{i}"), F.max(at - F.floor(at)).alias(f"_f{i}")]
    found = placed.groupBy(*keys).agg(*out).select(*keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(points)])
    if by:
        return found
    return spark.range(1).select(F.lit(0).alias("_all")).join(found, "_all", "left").drop("_all")


def histogram(rows: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, n): counts in `bins` equal bins over the range of the values; the last bin holds the largest one.

    A range of no width counts as one of width 1 around it. Bins without values have no row.
    """
    v = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    ends = v.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wide = F.col("_high") > F.col("_low")
    low, width = F.when(wide, F.col("_low")).otherwise(F.col("_low") - 0.5), F.when(wide, F.col("_high") - F.col("_low")).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("_v") - low) / width * bins), F.lit(bins - 1)).cast("int")
    return v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of bounds
