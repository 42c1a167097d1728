"""Joins on time: points in intervals, and the latest entry of a log, in buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def interval_join(points: DataFrame, intervals: DataFrame, on: tuple = (), at: str = "start_us", start: str = "onset", end: str = "until", how: str = "inner", bucket: int = DAY) -> DataFrame:
    """Points with the intervals that hold them, `start` <= `at` <= `end`; `how`: inner, left, left_semi or left_anti.

    An interval is listed in each bucket of time that it touches, a point lies in one, so an equi-join on
    `on` and the bucket finds each pair once, whatever the number of intervals: nothing is broadcast
    that Spark has not measured, and nothing meets in a nested loop. Make `bucket` some mean length of an interval.
    A null time lies in no interval; intervals that end before they start hold nothing.
    """
    p = points.withColumn("_bucket", F.expr(f"`{at}` div {bucket}"))
    i = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.expr(f"`{start}` div {bucket}"), F.expr(f"`{end}` div {bucket}"))))
    inside = (p[at] >= i[start]) & (p[at] <= i[end]) & (p["_bucket"] == i["_bucket"])
    for c in on:
        inside = inside & (p[c] == i[c])
    out = p.join(i, inside, how).drop(p["_bucket"])
    return out if how in ("left_semi", "left_anti") else out.drop(i["_bucket"], *(i[c] for c in on))


def as_of(rows: DataFrame, log: DataFrame, found: dict[str, Column], at: str = "start_us", since: str = "valid_from", part: str = "chain", bucket: int = DAY) -> DataFrame:
    """Rows with what the log says at their time: `found` of its latest entry with `since` <= `at` on the row's chain; null without any.

    Entries of one time are ordered by what they say. Rows meet entries within buckets of time; of earlier
    buckets only the latest entry is carried on, a row a bucket, so no task sorts a chain.
    """
    names = list(found)
    entry = log.filter(F.col(since).isNotNull()).select(part, F.struct(F.col(since).alias("_since"), *[c.alias(n) for n, c in found.items()]).alias("_said"))
    entry = entry.withColumn("_bucket", F.expr(f"_said._since div {bucket}"))
    latest = entry.groupBy(part, "_bucket").agg(F.max("_said").alias("_latest"))
    r = rows.withColumn("_bucket", F.expr(f"`{at}` div {bucket}")).withColumn("_kind", F.lit(1)).withColumn("_when", F.col(at))
    both = r.unionByName(entry.withColumn("_kind", F.lit(0)).withColumn("_when", F.col("_said._since")), allowMissingColumns=True)
    # Entries come before rows of the same time, which they hold for.
    inside = Window.partitionBy(part, "_bucket").orderBy("_when", "_kind", "_said").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_in", F.last("_said", ignorenulls=True).over(inside)).filter("_kind = 1")
    buckets = met.select(part, "_bucket").unionByName(latest.select(part, "_bucket")).distinct().join(latest, [part, "_bucket"], "left")
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(part, "_bucket", F.last("_latest", ignorenulls=True).over(before).alias("_carried"))
    known = F.coalesce("_in", "_carried")
    return met.join(carried, [part, "_bucket"], "left").select(*rows.columns, *[known[n].alias(n) for n in names])


def valid_at(rows: DataFrame, ranges: DataFrame, names: list[str], at: str = "start_us", part: str = "chain") -> DataFrame:
    """Rows with the columns `names` of the range that is in force at their time: valid_from <= `at` < valid_to (null: for ever).

    A row outside of all its chain's ranges gets nulls. Ranges of a chain that overlap are an error, as are those
    without a start; the parameter table is read once for that. An empty range holds nothing.
    """
    ranges = ranges.filter(F.col("valid_from").isNull() | F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
    own = Window.partitionBy(part).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    seen = F.row_number().over(own) > 1
    ends = F.lag("valid_to").over(own)
    wrong = ranges.withColumn("_wrong", F.col("valid_from").isNull() | seen & (ends.isNull() | (ends > F.col("valid_from")))).filter("_wrong").select(part, "valid_from").limit(1).collect()
    if wrong:
        raise ValueError(f"ranges of {wrong[0][0]} overlap at {wrong[0][1]}")
    out = as_of(rows, ranges, {"_to": F.col("valid_to"), **{n: F.col(n) for n in names}}, at, "valid_from", part)
    there = F.col("_to").isNull() | (F.col(at) < F.col("_to"))
    return out.select(*rows.columns, *[F.when(there, F.col(n)).alias(n) for n in names])


def carried(rows: DataFrame, value: Column, name: str, part: str = "chain", order: str = "idx", bucket: int = 4096) -> DataFrame:
    """Add `name`, the latest non-null `value` of the chain's rows up to each, itself included; null before the first.

    Rows are filled within buckets of `order`, which is null nowhere and numbers them; of earlier buckets one row each is carried on.
    """
    r = rows.withColumn("_value", value).withColumn("_bucket", F.expr(f"`{order}` div {bucket}"))
    inside = Window.partitionBy(part, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    latest = r.groupBy(part, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_latest"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = latest.select(part, "_bucket", F.last("_latest", ignorenulls=True).over(before).alias("_before"))
    filled = r.withColumn("_in", F.last("_value", ignorenulls=True).over(inside)).join(ends, [part, "_bucket"])
    return filled.select(*rows.columns, F.coalesce("_in", "_before").alias(name))
