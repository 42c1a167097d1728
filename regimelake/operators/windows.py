"""Blocks to windows (invariants), and gaps filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ema import numbered
from ..sources.views import HOUR

#: Window numbers that one row of a spine is spread to.
SPREAD = 65_536


def count_windows(blocks: DataFrame, phi: int, bucket: int = 65_536) -> DataFrame:
    """Add window_id: `phi` consecutive blocks of a chain by number."""
    out = numbered(blocks.filter("number is not null"), "chain", "number", F.expr(f"number div {bucket}"))
    return out.withColumn("window_id", F.expr(f"idx div {phi}"))


def key_windows(slots: DataFrame, phi: int) -> DataFrame:
    """Add window_id: `phi` consecutive slot numbers, present or not."""
    return slots.withColumn("window_id", F.expr(f"slot div {phi}"))


def invariants(windowed: DataFrame, phi: int) -> DataFrame:
    """One row for each window of two blocks or more: times, block numbers, cadence, saturation, means, continuity.

    Values stay unrounded; `published` rounds them as they are exported.
    """
    w = windowed.groupBy("chain", "window_id").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("block_count"), F.min("number").alias("first_block"), F.max("number").alias("last_block"),
        F.avg(F.try_divide("gas_used", "gas_limit")).alias("rho_s"), F.avg("size").alias("size_avg"), F.avg("tx").alias("tx_count_avg"), F.avg("gas_used").alias("gas_used_avg"),
    ).filter("block_count >= 2")
    return w.select(
        "chain", "window_id", "start_us", "end_us", "block_count", "first_block", "last_block",
        F.expr("((end_us - start_us) div 1000) / 1000D / (block_count - 1)").alias("rho_ts"), "rho_s", "size_avg", "tx_count_avg", "gas_used_avg", (F.col("block_count") / phi).alias("c_s"),
    )


def published(windows: DataFrame) -> DataFrame:
    """Windows with the digits of the exported tables: cadence and saturation 6, size 2, transactions 4."""
    return windows.withColumns({c: F.round(c, n) for c, n in (("rho_ts", 6), ("rho_s", 6), ("size_avg", 2), ("tx_count_avg", 4))})


def trim_edges(windows: DataFrame) -> DataFrame:
    """Without each chain's first and last window, which may be partial; idx renumbers the rest from 0.

    `windows` is read four times: pass a written table.
    """
    ends = windows.groupBy("chain").agg(F.min("window_id").alias("_low"), F.max("window_id").alias("_high"))
    kept = windows.join(ends, "chain").filter("window_id > _low and window_id < _high").drop("_low", "_high")
    return numbered(kept, "chain", "window_id", F.expr("window_id div 65536"))


def slot_invariants(windowed: DataFrame, phi: int, min_blocks: int = 2) -> DataFrame:
    """Windows of slot blocks: cadence in seconds and continuity; windows of fewer than `min_blocks` are left out.

    A window of one block, where it is let in, has the nominal cadence of 400 ms.
    """
    w = windowed.groupBy("chain", "window_id").agg(F.count(F.lit(1)).alias("block_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us")).filter(F.col("block_count") >= min_blocks)
    cadence = F.when(F.col("block_count") >= 2, F.round(F.expr("((end_us - start_us) div 1000) / 1000D / nullif(block_count - 1, 0)"), 6)).otherwise(0.4)
    return w.withColumn("rho_ts", cadence).withColumn("c_s", F.round(F.col("block_count") / phi, 6))


def spine(windows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(chain, window_id, _low): every window number of a chain from `low` to `high`, both included; by default its first and last.

    Long ranges are spread in two steps, so no row holds a chain's whole range.
    """
    if low is None:
        ends = windows.groupBy("chain").agg(F.min("window_id").alias("_low"), F.max("window_id").alias("_high"))
    else:
        ends = windows.select("chain").distinct().select("chain", F.lit(low).cast("long").alias("_low"), F.lit(high).cast("long").alias("_high"))
    parts = ends.withColumn("_part", F.explode(F.expr(f"sequence(_low div {SPREAD} - 1, _high div {SPREAD} + 1)")))
    a, b = F.greatest("_low", F.col("_part") * SPREAD), F.least("_high", F.col("_part") * SPREAD + SPREAD - 1)
    return parts.withColumn("_a", a).withColumn("_b", b).filter("_a <= _b").select("chain", F.explode(F.sequence("_a", "_b")).alias("window_id"), "_low")


def gap_fill(windows: DataFrame, fill: bool = True) -> DataFrame:
    """All windows of the spine with idx from 0: missing ones with no blocks, cadence 999, continuity 0 and the
    nominal start of their number; or, with fill off, nulls."""
    s = spine(windows)
    out = s.join(windows, ["chain", "window_id"], "left").withColumn("idx", F.col("window_id") - F.col("_low")).drop("_low")
    if not fill:
        return out
    return out.withColumns({
        "block_count": F.coalesce("block_count", F.lit(0)), "rho_ts": F.coalesce("rho_ts", F.lit(999.0)), "c_s": F.coalesce("c_s", F.lit(0.0)),
        "start_us": F.coalesce("start_us", (F.col("window_id") * 320 * 1_000_000).cast("long")),
    })


def on_spine(hourly: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Hourly rows on all hours from `first` up to before `last` (by default the rows' own range), idx from 0; missing ones are null, with no blocks."""
    h = hourly.withColumnRenamed("hour", "window_id")
    s = spine(h, first, None if last is None else last - 1)
    out = s.join(h, ["chain", "window_id"], "left").withColumn("idx", F.col("window_id") - F.col("_low")).drop("_low")
    return out.withColumnRenamed("window_id", "hour").withColumn("block_count", F.coalesce("block_count", F.lit(0)))


def hour_means(blocks: DataFrame) -> DataFrame:
    """Hourly counts and means of the hours that have blocks, keyed by the hour's number since the epoch."""
    means = [F.avg(c).alias(n) for c, n in (("size", "size_avg"), ("tx", "tx_avg"), ("gas_used", "gas_avg"), ("blob", "blob_avg"), ("basefee", "basefee_avg")) if c in blocks.columns]
    return blocks.groupBy("chain", F.expr(f"us div {HOUR}").alias("hour")).agg(F.count(F.lit(1)).alias("block_count"), *means)


def hours(blocks: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Hourly means on a dense spine of hours: interval is the mean of gaps of 0 to 60 s inside the hour, 12 s
    without any, null with fewer than two blocks. With `first` and `last` the spine is [first, last), and blocks outside take no part."""
    b = blocks.withColumn("hour", F.expr(f"us div {HOUR}"))
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("chain", "hour").orderBy("us", "number"))) / 1e6
    gaps = b.withColumn("gap", gap).groupBy("chain", "hour").agg(
        F.count(F.lit(1)).alias("block_count"), F.avg(F.when((F.col("gap") > 0) & (F.col("gap") < 60), F.col("gap"))).alias("gap"),
        *[F.avg(c).alias(n) for c, n in (("size", "size_avg"), ("tx", "tx_avg"), ("gas_used", "gas_avg"), ("blob", "blob_avg"), ("basefee", "basefee_avg")) if c in blocks.columns],
    )
    h = gaps.withColumn("interval", F.when(F.col("block_count") >= 2, F.coalesce("gap", F.lit(12.0)))).drop("gap")
    return on_spine(h, first, last)
