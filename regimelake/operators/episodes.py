"""Episodes of structural stress, and how long a chain is less sensitive after each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import carried
from ..sources.shared import materialize

#: Windows of a chain in one bucket.
BUCKET = 4096


def episodes(rows: DataFrame, s2: float = 1.12, tolerance: float = 0.02, bucket: int = BUCKET) -> DataFrame:
    """One row for each run of windows with a rhythm of `s2` or more: (chain, episode, end_idx, n, start_us, end_us, peak, insensitive, met_us, needed).

    rows: (chain, idx, start_us, rhythm, fast, slow), idx from 0 without gaps, fast and slow the two baselines of the cadence.
    After an episode the fast baseline is still high, so that a second one needs a stronger deviation. That lasts until it is
    back within `tolerance` of the slow one: `insensitive` windows, up to the one that starts at `met_us`; null where the next
    episode begins or the data end before. `needed` is the deviation over the slow baseline that would have been an alarm in these windows,
    at its largest. episode is the idx of the first window. A null rhythm is no stress, a null baseline has not met.

    Runs are found in buckets of windows with a row a bucket carried on: no chain is sorted in one task, and a run over a bucket's end is one.
    """
    r = rows.withColumn("_hot", F.coalesce(F.col("rhythm") >= s2, F.lit(False))).withColumn("_bucket", F.expr(f"idx div {bucket}"))
    ends = r.groupBy("chain", "_bucket").agg(F.max_by("_hot", "idx").alias("_end"))
    ends = ends.select("chain", "_bucket", F.lag("_end").over(Window.partitionBy("chain").orderBy("_bucket")).alias("_end"))
    before = F.lag("_hot").over(Window.partitionBy("chain", "_bucket").orderBy("idx"))
    r = r.withColumn("_was", before).join(ends, ["chain", "_bucket"]).withColumn("_was", F.coalesce("_was", "_end", F.lit(False))).drop("_bucket", "_end")
    starts = F.when(F.col("_hot") & ~F.col("_was"), F.col("idx"))
    r = materialize(carried(r, starts, "episode", bucket=bucket).filter("episode is not null"))
    cold = ~F.col("_hot")
    met = cold & F.coalesce(F.col("fast") <= (1 + tolerance) * F.col("slow"), F.lit(False))
    found = r.groupBy("chain", "episode").agg(
        F.max(F.when(F.col("_hot"), F.col("idx"))).alias("end_idx"), F.count_if("_hot").alias("n"), F.min(F.when(F.col("_hot"), F.col("start_us"))).alias("start_us"),
        F.max(F.when(F.col("_hot"), F.col("start_us"))).alias("end_us"), F.max(F.when(F.col("_hot"), F.col("rhythm"))).alias("peak"),
        F.min(F.when(met, F.col("idx"))).alias("_met"), F.min_by("start_us", F.when(met, F.col("idx"))).alias("met_us"), F.max("idx").alias("_last"),
    )
    dull = r.join(found.select("chain", "episode", "end_idx", "_met"), ["chain", "episode"]).filter(F.col("idx") > F.col("end_idx")).filter(F.col("_met").isNull() | (F.col("idx") < F.col("_met")))
    needed = dull.groupBy("chain", "episode").agg(F.max(s2 * F.try_divide("fast", "slow")).alias("needed"))
    insensitive = F.coalesce(F.col("_met") - 1, F.col("_last")) - F.col("end_idx")
    return found.join(needed, ["chain", "episode"], "left").select("chain", "episode", "end_idx", "n", "start_us", "end_us", "peak", insensitive.alias("insensitive"), "met_us", "needed")
