"""Three layers by the hour: base layer, bridge, rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ema import ema, lagged
from ..operators.regimes import HOURLY, hourly_ratio
from ..operators.windows import HOUR, hours, on_spine

#: Age in minutes of a last batch that was never seen.
NEVER = 9999.0

#: Hours that only feed the baselines.
WARM_UP = 20

#: Bytes of a blob, and blobs of a block.
BLOB_BYTES, BLOBS = 131_072, 6

#: What the base layer's and the bridge's states say together; null stands for every state. Fixed values.
CAUSAL = [
    ("S1D1", "BS1L1", "overall calm", "demand down, composition down, adaptation down"),
    ("S1D2", "BS1L1", "healthy adoption", "demand up, composition stable, adaptation stable"),
    ("S2D1", "BS1L1", "structural stress that prices do not show", "demand down, composition up, adaptation up"),
    ("S2D2", "BS1L1", "systemic congestion", "demand up, composition up, adaptation up"),
    (None, "BS2L1", "bridge congested, the rollup answers alone", "adaptation up"),
    (None, "BS2L2", "bridge congested, the rollup answers alone", "adaptation up"),
]


def _over(c: str, t: float):
    return F.coalesce(F.col(c) > t, F.lit(False))


def _state(structure, demand):
    return F.concat(F.when(structure, "S2").otherwise("S1"), F.when(demand, "D2").otherwise("D1"))


def base_layer(blocks: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Hourly base layer on all hours: interval ratio over 1.10 is S2, mean of size, tx and blob ratios over 1.10 is D2.

    Hours of fewer than two blocks are missing: they update no baseline and have no state, nor have the first 20 hours.
    """
    h = hours(blocks, first, last)
    h = h.withColumns({c: F.when(F.col("block_count") >= 2, F.col(c)) for c in ("size_avg", "tx_avg", "gas_avg", "blob_avg", "basefee_avg")})
    h = hourly_ratio(h, {"interval_r": "interval", "size_r": "size_avg", "tx_r": "tx_avg", "blob_r": "blob_avg"}, WARM_UP)
    h = h.withColumn("sigma", (F.col("size_r") + F.col("tx_r") + F.col("blob_r")) / 3)
    seen = (F.col("idx") >= WARM_UP) & (F.col("block_count") >= 2)
    return h.withColumn("l1_state", F.when(seen, _state(_over("interval_r", 1.10), _over("sigma", 1.10))))


def rollup_layer(hourly: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Hourly rollup from pre-aggregated hours: a block count under 0.90 of its baseline is S2, mean of size and gas ratios over 1.10 is D2.

    Absent hours are missing: they update no baseline and have no state, nor have the first 20 hours.
    """
    h = on_spine(hourly, first, last).withColumn("n", F.when(F.col("block_count") > 0, F.col("block_count").cast("double")))
    h = hourly_ratio(h, {"count_r": "n", "size_r": "size_avg", "gas_r": "gas_avg"}, WARM_UP).withColumn("sigma", (F.col("size_r") + F.col("gas_r")) / 2)
    low = F.coalesce(F.col("count_r") < 0.90, F.lit(False))
    return h.withColumn("l2_state", F.when((F.col("idx") >= WARM_UP) & F.col("n").isNotNull(), _state(low, _over("sigma", 1.10))))


def batch_gaps(batches: DataFrame) -> DataFrame:
    """Minutes since the batch before; batches of one time all show the last one's gap, which is zero.

    Gaps are taken within hours; an hour's first batch looks back to the latest of the hours before, one row an hour.
    """
    b = batches.withColumn("_hour", F.expr(f"us div {HOUR}"))
    latest = b.groupBy("chain", "_hour").agg(F.max("us").alias("_latest")).withColumn("_carried", F.lag("_latest").over(Window.partitionBy("chain").orderBy("_hour"))).drop("_latest")
    own = Window.partitionBy("chain", "_hour").orderBy("us", "number")
    same = F.count(F.lit(1)).over(Window.partitionBy("chain", "_hour", "us"))
    b = b.withColumn("_last", F.lag("us").over(own)).withColumn("_same", same).join(latest, ["chain", "_hour"])
    gap = F.when(F.col("_same") > 1, 0.0).otherwise((F.col("us") - F.coalesce("_last", "_carried")) / 6e7)
    return b.withColumn("gap", gap).select(*batches.columns, "gap")


def last_batch(hourly: DataFrame, batches: DataFrame) -> DataFrame:
    """Add last_us: the last batch strictly before the hour's end, carried over hours from each hour's latest one."""
    latest = batches.groupBy("chain", F.expr(f"us div {HOUR}").alias("hour")).agg(F.max("us").alias("latest"))
    keys = hourly.select("chain", "hour").unionByName(latest.select("chain", "hour")).distinct().join(latest, ["chain", "hour"], "left")
    carried = keys.select("chain", "hour", F.last("latest", ignorenulls=True).over(Window.partitionBy("chain").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)).alias("last_us"))
    return hourly.join(carried, ["chain", "hour"])


def bridge_layer(hourly: DataFrame, batches: DataFrame) -> DataFrame:
    """BS2 where the last batch is older than twice the baseline of hourly mean gaps (those under 60 minutes).

    `hourly` is a spine of hours (chain, hour, idx). The first 20 hours only feed the baseline: they have no state.
    """
    gaps = batch_gaps(batches).filter("gap < 60").groupBy("chain", F.expr(f"us div {HOUR}").alias("hour")).agg(F.avg("gap").alias("gap"))
    h = last_batch(hourly.select("chain", "hour", "idx"), batches).join(gaps, ["chain", "hour"], "left").withColumn("gap", F.nullif("gap", F.lit(0.0)))
    h = ema(h, {"_e": ("gap", HOURLY)})
    h = h.withColumn("baseline", lagged("_e"))
    age = F.coalesce(((F.col("hour") + 1) * HOUR - F.col("last_us")) / 6e7, F.lit(NEVER))
    late = F.coalesce(F.col("age_min") > 2 * F.col("baseline"), F.lit(False))
    return h.withColumn("age_min", age).withColumn("bs", F.when(F.col("idx") >= WARM_UP, F.when(late, "BS2").otherwise("BS1"))).drop("_e")


def adapter_signals(batches: DataFrame) -> DataFrame:
    """Publication of each batch: latency since the rollup's last block, bytes, share of a block's blobs, bytes a transaction.

    batches: us, last_us (the rollup's last time), input_bytes, blobs, tx. A batch without blobs publishes its input bytes.
    """
    size = F.when(F.col("blobs") > 0, F.col("blobs") * BLOB_BYTES).otherwise(F.col("input_bytes")).cast("long")
    return batches.withColumns({
        "publish_latency": (F.col("us") - F.col("last_us")) / 1e6, "calldata_bytes": size,
        "blob_usage": F.coalesce(F.col("blobs"), F.lit(0)) / BLOBS, "calldata_per_tx": F.try_divide(size, F.col("tx")),
    })


def bridge_ratios(rows: DataFrame) -> DataFrame:
    """latency_ratio = relay time over the expected one; backlog_ratio = pending messages over throughput."""
    return rows.withColumn("latency_ratio", F.try_divide("t_relay", "expected")).withColumn("backlog_ratio", F.try_divide("pending", "throughput"))


def bridge_grid(rows: DataFrame, latency: float = 2.0, backlog: float = 1.0) -> DataFrame:
    """grid: BS2 over the latency threshold, L2 over the backlog one; a missing ratio is nominal."""
    return rows.withColumn("grid", F.concat(F.when(_over("latency_ratio", latency), "BS2").otherwise("BS1"), F.when(_over("backlog_ratio", backlog), "L2").otherwise("L1")))


def causal(rows: DataFrame, state: str = "l1_state", grid: str = "grid") -> DataFrame:
    """Add reading and response by the lookup CAUSAL, an exact row before one for every state; others are null."""
    known = rows.sparkSession.createDataFrame(CAUSAL, "_state string, _grid string, _reading string, _response string")
    exact = F.broadcast(known.filter("_state is not null"))  # CAUSAL's rows
    every = F.broadcast(known.filter("_state is null").select(F.col("_grid").alias("_any"), F.col("_reading").alias("_r"), F.col("_response").alias("_s")))
    j = rows.join(exact, (F.col(state) == F.col("_state")) & (F.col(grid) == F.col("_grid")), "left").join(every, F.col(grid) == F.col("_any"), "left")
    return j.select(*rows.columns, F.coalesce("_reading", "_r").alias("reading"), F.coalesce("_response", "_s").alias("response"))


def composite(l1: DataFrame, bridge: DataFrame, l2: DataFrame, visible: float = 10.0) -> DataFrame:
    """One row for each hour that has a base and a bridge state: the layers' signals and what they say together.

    A missing rollup hour is N/A. Every rollup state but S1D1 counts towards the label; S1D2 alone raises no alert.
    A fee monitor sees hours whose base fee is over `visible`. Figures are rounded to six digits.
    """
    r = lambda c, n: F.round(c, 6).alias(n)
    a = l1.filter("l1_state is not null").select("hour", F.col("l1_state").alias("l1_regime"), r("sigma", "l1_sigma_ratio"), r("interval_r", "l1_interval_ratio"), r("blob_r", "l1_blob_ratio"), r("basefee_avg", "l1_basefee_gwei"))
    b = bridge.filter("bs is not null").select("hour", F.col("bs").alias("bridge_regime"), r("age_min", "bridge_last_age_min"), r(F.nullif("baseline", F.lit(0.0)), "bridge_ema_min"))
    c = l2.filter("l2_state is not null").select("hour", "l2_state", r("sigma", "l2_sigma_ratio"), r("count_r", "l2_count_ratio"), r("basefee_avg", "l2_basefee_gwei"))
    j = a.join(b, "hour").join(c, "hour", "left")
    late = F.col("bridge_regime") == "BS2"
    odd = F.coalesce(F.col("l2_state") != "S1D1", F.lit(False))
    bad = F.coalesce(~F.col("l2_state").isin("S1D1", "S1D2"), F.lit(False))
    kind = F.when(late & odd, "MULTI_LAYER").when(late, "BRIDGE_ONLY").when(odd, "L2_ONLY").otherwise("NORMAL")
    return j.select(
        F.date_format(F.timestamp_seconds(F.col("hour") * 3600), "yyyy-MM-dd HH:mm:ss").alias("window_start"), *a.columns[1:], *b.columns[1:], F.coalesce("l2_state", F.lit("N/A")).alias("l2_regime"), *c.columns[2:],
        kind.alias("composite"), F.coalesce(F.col("l1_basefee_gwei") > visible, F.lit(False)).alias("fee_monitor_visible"), (late | bad).alias("alert"),
    )
