"""Threshold sweeps: windows are counted in cells between thresholds once, grid points are sums of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regimes import ALERTS, WARM_UP
from ..sources.shared import materialize

#: Which ratio meets which threshold of the grid, and how. Fixed by the two kinds of chains.
BLOCK_AXES = (("rhythm", "s2", ">="), ("sigma", "d2_sigma", ">="), ("size_r", "d2_size", ">="), ("tx_r", "d2_tx", ">="))
SLOT_AXES = (("rhythm", "s2", ">"), ("c_s", "continuity", "<"))


def _block_state(need: int):
    def rule(flags):
        structure, *demand = flags
        return F.concat(F.when(structure, "S2").otherwise("S1"), F.when(sum(f.cast("int") for f in demand) >= need, "D2").otherwise("D1"))

    return rule


def _slot_state(flags):
    return F.when(flags[0] | flags[1], "S2D1").otherwise("S1D1")


def _reached(i: int, column: str, how: str):
    """How many of the axis' thresholds the ratio reaches."""
    return F.size(F.filter(F.col(f"_t{i}"), (lambda t: F.col(column) > t) if how == ">" else (lambda t: F.col(column) >= t)))


def _cells(scored: DataFrame, bounds: DataFrame, incidents: DataFrame, axes) -> DataFrame:
    """(b0, b1, .., normal, event, onset, expected, once, first_us): windows between the same thresholds and in the same incident.

    bounds is one row: for each axis its sorted thresholds, and the incidents. A window in two incidents is in two cells and counts `once`.
    """
    w = scored.filter(F.col("idx") > WARM_UP).crossJoin(F.broadcast(bounds))  # one row, the caller's parameters
    reached = []
    for i, (column, _, how) in enumerate(axes):
        # A missing ratio lies in a cell of its own, -1, and meets no threshold.
        reached.append(F.when(F.col(column).isNull(), F.lit(-1)).otherwise(_reached(i, column, how)).alias(f"b{i}"))
    inside = F.filter("_incidents", lambda x: (F.col("start_us") >= x["onset"]) & (F.col("start_us") <= x["until"]))
    w = w.select(*reached, "start_us", inside.alias("_in")).withColumn("normal", F.size("_in") == 0)
    w = w.select("*", F.posexplode_outer("_in").alias("_at", "_x"))
    keys = [*(f"b{i}" for i in range(len(axes))), "normal"]
    return w.groupBy(*keys, F.col("_x.event").alias("event"), F.col("_x.onset").alias("onset"), F.col("_x.expected").alias("expected")).agg(F.count_if(F.coalesce(F.col("_at"), F.lit(0)) == 0).alias("once"), F.min("start_us").alias("first_us"))


def _flag(i: int, threshold: str, how: str):
    place = F.array_position(F.col(f"_t{i}"), F.col(threshold))
    meets = (F.col(f"b{i}") >= place) if how != "<" else (F.col(f"b{i}") >= 0) & (F.col(f"b{i}") < place)
    return F.coalesce(meets, F.lit(False))


def sweep(scored: DataFrame, grid: DataFrame, incidents: DataFrame, need: int = 1, axes=BLOCK_AXES, rule=None) -> DataFrame:
    """Per grid point: fpr on normal windows, S2 and D2 windows, detected incidents, and of each incident the hours to its first detection.

    `latency` maps every incident to these hours, null where it is not detected. Windows are summed once into
    cells between neighbouring thresholds (their product bounds the cells, whatever the windows), and the
    grid meets the cells. A null threshold is switched off.
    """
    rule = rule or _block_state(need)
    thresholds = [F.array_sort(F.collect_set(t)).alias(f"_t{i}") for i, (_, t, _) in enumerate(axes)]
    listed = incidents.agg(F.array_sort(F.collect_list(F.struct("event", "onset", "until", "expected"))).alias("_incidents"))
    bounds = grid.agg(*thresholds).crossJoin(listed)  # two single rows
    cells = materialize(_cells(scored, bounds, incidents, axes))
    points = cells.crossJoin(F.broadcast(grid.crossJoin(bounds)))  # the grid's rows on the bounded cells
    points = points.withColumn("state", rule([_flag(i, t, how) for i, (_, t, how) in enumerate(axes)]))
    keys = grid.columns
    alert = F.col("state").isin(*ALERTS)
    hit = F.array_contains("expected", F.col("state"))
    by_event = points.groupBy(*keys, "event", "onset").agg(
        F.sum(F.when(F.col("normal"), F.col("once")).otherwise(0)).alias("normal"), F.sum(F.when(F.col("normal") & alert, F.col("once")).otherwise(0)).alias("false"),
        F.sum(F.when(F.col("state").startswith("S2"), F.col("once")).otherwise(0)).alias("s2_"), F.sum(F.when(F.col("state").endswith("D2"), F.col("once")).otherwise(0)).alias("d2_"),
        F.min(F.when(hit, F.col("first_us"))).alias("first_us"),
    )
    latency = F.collect_list(F.when(F.col("first_us").isNotNull(), F.struct("event", F.round((F.col("first_us") - F.col("onset")) / 3.6e9, 4).alias("h"))))
    swept = by_event.groupBy(*keys).agg(F.round(F.try_divide(F.sum("false"), F.sum("normal")), 4).alias("fpr"), F.sum("s2_").alias("n_s2"), F.sum("d2_").alias("n_d2"), F.map_from_entries(latency).alias("latency"))
    return swept.withColumn("n_detected", F.size("latency"))


def sweep_slots(scored: DataFrame, grid: DataFrame, incidents: DataFrame) -> DataFrame:
    """Slot chains: rhythm and continuity thresholds."""
    return sweep(scored, grid, incidents, axes=SLOT_AXES, rule=_slot_state)


def event_columns(swept: DataFrame, events: list[str], latency: bool = True) -> DataFrame:
    """`latency` spread into a boolean, and if asked the hours, for each named incident."""
    out = [F.col("latency")[e].isNotNull().alias(f"{e}_detected") for e in events]
    out += [F.col("latency")[e].alias(f"{e}_latency_h") for e in events] if latency else []
    return swept.select(*[c for c in swept.columns if c != "latency"], *out)


def select_threshold(swept: DataFrame, full: int) -> DataFrame:
    """The best grid point: all incidents detected before others, then more detected, then the lower fpr, then grid order."""
    good = F.col("n_detected") >= full
    return swept.orderBy(F.desc(good), F.desc("n_detected"), "fpr", *[c for c in swept.columns if c not in ("fpr", "n_detected", "latency")]).limit(1)


def select_slot_threshold(swept: DataFrame, full: int, worst: float = 0.05) -> DataFrame:
    """(s2): of the rhythm thresholds under `worst`, the lowest fpr with all incidents detected; else most detected; else the middle of the list.

    Ties go to the smaller threshold. `swept` has one row for each threshold: a list of parameters.
    """
    row = F.struct((F.col("n_detected") >= full).alias("full"), "n_detected", "fpr", "s2")
    listed = swept.agg(F.sort_array(F.collect_list("s2")).alias("all"), F.collect_list(F.when(F.col("fpr") < worst, row)).alias("good"))
    # Sorted ascending: lowest fpr of the full ones, or most detected, then the smaller threshold.
    full_ = F.array_sort(F.transform(F.filter("good", lambda x: x["full"]), lambda x: F.struct(x["fpr"].alias("a"), x["s2"].alias("s2"))))
    most = F.array_sort(F.transform("good", lambda x: F.struct((-x["n_detected"]).alias("a"), x["s2"].alias("s2"))))
    middle = F.expr("get(all, cast(size(all) div 2 as int))")
    return listed.select(F.coalesce(F.get(full_, F.lit(0))["s2"], F.get(most, F.lit(0))["s2"], middle).alias("s2"))


def highest_full(swept: DataFrame, full: int) -> DataFrame:
    """(s2): the highest threshold that still detects all incidents."""
    return swept.agg(F.max(F.when(F.col("n_detected") == full, F.col("s2"))).alias("s2"))
