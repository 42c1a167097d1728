"""Queries of the chain-regime operators over the test tables, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.ema import ema, last_before
from .functions.intervals import valid_at
from .functions.quantiles import histogram, quantiles
from .operators import regimes as R
from .operators import windows as W
from .operators.episodes import episodes
from .plans import composite as C
from .plans import sweeps as S
from .plans.ledger import Ledger
from .plans.rolling import daily_sketches, rolling_threshold
from .sources import views as V
from .sources.shared import materialize, new_folder
from .streaming.bridge import Clock, watch_bridges
from .streaming.online import state_store, stream_classify, tick

PHI, SLOT_PHI = 10, 10
_TWO = {"s2": 1.12, "sigma": 1.10, "size": 1.20, "tx": 1.10, "need": 2}

#: The fixture's base fees lie around this; the library's own threshold is 10.
VISIBLE_FEE = 250.0


def _windows(s: SparkSession, d: str, by_type: bool = False) -> DataFrame:
    """Windows of all blocks, written once: there is one for PHI blocks."""
    return materialize(W.invariants(W.count_windows(V.blocks(s, d, by_type), PHI), PHI))


def _inv(s: SparkSession, d: str, by_type: bool = False) -> DataFrame:
    return W.trim_edges(_windows(s, d, by_type))


def _ratios(s, d):
    return R.ratios(_inv(s, d))


def _scored(s, d):
    return R.classify(_ratios(s, d), **_TWO)


def _slot_windows(s, d):
    w = W.slot_invariants(W.key_windows(V.slots(s, d), SLOT_PHI), SLOT_PHI)
    return W.trim_edges(materialize(w)).drop("idx")


def _slot_filled(s, d, fill=True):
    return W.gap_fill(materialize(_slot_windows(s, d)), fill)


def _slot_scored(s, d):
    return R.classify_slots(R.slot_scores(_slot_filled(s, d)))


def _layer(s, d, kind=None):
    b = V.blocks(s, d)
    return b.filter(F.col("event_type") == kind) if kind else b


def _hours(s, d, kind=None):
    return W.hours(_layer(s, d, kind), V.FIRST_HOUR, V.LAST_HOUR)


def _base(s, d):
    return C.base_layer(_layer(s, d), V.FIRST_HOUR, V.LAST_HOUR)


def _spine(s, d):
    return W.on_spine(W.hour_means(_layer(s, d)), V.FIRST_HOUR, V.LAST_HOUR).select("chain", "hour", "idx")


def _bridge(s, d):
    return C.bridge_layer(_spine(s, d), _layer(s, d, "purchase"))


def _rollup(s, d):
    return C.rollup_layer(W.hour_means(_layer(s, d, "click")), V.FIRST_HOUR, V.LAST_HOUR)


def _composite(s, d):
    return C.composite(_base(s, d), _bridge(s, d), _rollup(s, d), VISIBLE_FEE)


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def _grid(s, rows):
    return s.createDataFrame([tuple(map(float, r)) for r in rows], "s2 double, d2_sigma double, d2_size double, d2_tx double")


# Threshold lists: fixed values, as published.
_NEVER = 1e9
S2_VALUES = (1.05, 1.08, 1.10, 1.12, 1.15, 1.18, 1.20, 1.25)
D2_VALUES = (1.02, 1.03, 1.05, 1.08, 1.10, 1.12, 1.15, 1.20)
SIZE_VALUES = TX_VALUES = (1.05, 1.10, 1.15, 1.20, 1.25)
CUBE = (1.05, 1.10, 1.15, 1.20, 1.25, 1.30, 1.40)
SLOT_VALUES = (1.01, 1.03, 1.05, 1.08, 1.10, 1.12, 1.15, 1.18, 1.20, 1.25, 1.30)
CONTINUITY = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
GRIDS = {
    "sweep_s2": ([(x, 1.05, _NEVER, _NEVER) for x in S2_VALUES], 1),
    "sweep_d2": ([(1.12, x, _NEVER, _NEVER) for x in D2_VALUES], 1),
    "sweep_grid2d": ([(1.12, 1.10, x, y) for x in SIZE_VALUES for y in TX_VALUES], 2),
    "sweep_pol_s2": ([(x, 1.14, 1.18, 1.23) for x in (1.02, 1.03, 1.04, 1.05, 1.06, 1.08, 1.10, 1.12, 1.15, 1.18, 1.20)], 2),
    "sweep_grid3d": ([(1.04, x, y, z) for x in CUBE for y in CUBE for z in CUBE], 2),
}
EVENT_NAMES = [e[0] for e in V.EVENTS]
#: Sweeps that report the hours to the first detection; the others say only whether there is one.
WITH_LATENCY = ("sweep_s2", "sweep_pol_s2")


def _swept(s, d, name):
    rows, need = GRIDS[name]
    return S.sweep(_ratios(s, d), _grid(s, rows), V.incidents(s), need)


def _sweep(name):
    return lambda s, d: S.event_columns(_swept(s, d, name), EVENT_NAMES, name in WITH_LATENCY)


def _slot_phases(s, d):
    """(A, B): rhythm thresholds at a fixed continuity, and continuity thresholds at the rhythm threshold that A selects."""
    scored = materialize(R.slot_scores(_slot_filled(s, d)))
    grid = s.createDataFrame([(float(x), 0.5) for x in SLOT_VALUES], "s2 double, continuity double")
    a = materialize(S.sweep_slots(scored, grid, V.incidents(s)))
    chosen = S.select_slot_threshold(a, len(V.EVENTS))
    b = chosen.crossJoin(s.createDataFrame([(float(x),) for x in CONTINUITY], "continuity double"))  # one row chosen
    return a, S.sweep_slots(scored, b, V.incidents(s))


def _slot_union(s, d):
    a, b = _slot_phases(s, d)
    a, b = S.event_columns(a, EVENT_NAMES), S.event_columns(b, EVENT_NAMES, latency=False)
    return a.withColumn("phase", F.lit("A")).unionByName(b.withColumn("phase", F.lit("B")), allowMissingColumns=True)


def _pivot(s, d):
    p = S.event_columns(_swept(s, d, "sweep_grid2d"), []).groupBy("d2_size").pivot("d2_tx", list(TX_VALUES)).agg(F.first("fpr").alias("fpr"), F.first("n_d2").alias("n_d2"))
    return p.select("d2_size", *[F.col(f"`{v}_{c}`").alias(f"{c}_tx_{round(v * 100)}") for v in TX_VALUES for c in ("fpr", "n_d2")])


def _emas(s, d, alpha):
    return ema(_inv(s, d), {"e_rho": ("rho_ts", alpha), "e_sigma": ("rho_s", alpha)}).select("idx", *_r("e_rho", "e_sigma"))


def _adapter(s, d):
    """Each purchase as a batch that a base block takes up, each click as a block of the rollup."""
    batches = last_before(_layer(s, d, "purchase").select("chain", "number", "us", "input_bytes", "blobs", "tx"), _layer(s, d, "click"), V.HOUR)
    return C.adapter_signals(batches).select("number", F.round("publish_latency", 3).alias("publish_latency"), "calldata_bytes", *_r("blob_usage", "calldata_per_tx"))


def _derived(s, d, value, clamp):
    w = _inv(s, d).withColumn("x", value)
    ratio = F.try_divide(F.col("x"), F.col("e"))
    return ema(w, {"e": ("x", R.FAST)}).select("idx", F.round(F.greatest(F.lit(0.01), F.least(F.lit(20.0), ratio)) if clamp else F.coalesce(ratio, F.lit(1.0)), 6).alias("ratio"))


def _continuity(s, d):
    """Continuity of slot windows over its baseline."""
    w = ema(_slot_filled(s, d), {"e": ("c_s", R.FAST)})
    return w.select("idx", F.round(F.try_divide(F.col("c_s"), F.col("e")), 6).alias("continuity_ratio"))


def _reset(s, d):
    """Baselines begin anew at every epoch of 100 windows."""
    w = _inv(s, d).withColumn("epoch", F.expr("idx div 100")).withColumn("key", F.concat_ws("/", "chain", F.col("epoch").cast("string"))).withColumn("at", F.expr("idx % 100"))
    return ema(w, {"e": ("rho_ts", R.FAST)}, part="key", order="at").select("idx", "epoch", *_r("e"))


#: A time after all others: 2100.
_END = 4_102_444_800_000_000


def _stream(s, d):
    """The online engine over the unsorted files of events, a chain for each type; what it emits is read back."""
    out = new_folder(s, "stream")
    columns = V.as_blocks(s.read.parquet(f"{d}/events.parquet").limit(0), True).select("chain", "number", "us", F.try_divide("gas_used", "gas_limit").alias("load"))
    ticks = columns.schema
    s.createDataFrame([], ticks).write.parquet(f"{out}/ticks")
    events = V.as_blocks(V.stream_of(s, f"{d}/events.parquet", files=8), True).select("chain", "number", "us", F.try_divide("gas_used", "gas_limit").alias("load"))
    both = events.unionByName(s.readStream.schema(ticks).parquet(f"{out}/ticks"))
    stream = stream_classify(both, PHI)

    def follow():
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    with state_store(s, 8):  # five chains
        follow()
        tick(s, f"{out}/ticks", _END, ticks)
        follow()
    return s.read.schema(stream.schema).parquet(f"{out}/rows").filter("kind = 'window'").select("chain", "idx", "start_us", "end_us", *_r("rho_ts", "rho_s", "rhythm", "rhythm_slow", "sigma"), "state")


def _bridge_alarm(s, d):
    """The bridge's states at the ends of hours, from the log of the streamed watch: its alarms come from timers, not from batches."""
    out = new_folder(s, "stream")
    kind = s.createDataFrame([], "chain string, us long").schema
    tick(s, f"{out}/ticks", V.FIRST_HOUR * V.HOUR, kind)
    batches = V.as_blocks(V.stream_of(s, f"{d}/events.parquet", files=8), True).filter("event_type = 'purchase'").select(F.lit("evt").alias("chain"), "us")
    both = batches.unionByName(s.readStream.schema(kind).parquet(f"{out}/ticks"))
    log = watch_bridges(both, Clock(first=V.FIRST_HOUR), "10 minutes")

    def follow():
        log.writeStream.format("parquet").option("path", f"{out}/log").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    with state_store(s, 2):  # one bridge
        follow()
        tick(s, f"{out}/ticks", (V.LAST_HOUR + 1) * V.HOUR, kind)
        follow()
    said = s.read.schema(log.schema).parquet(f"{out}/log")
    latest = said.groupBy("chain", F.expr(f"at_us div {V.HOUR}").alias("hour")).agg(F.max_by("bs", F.struct("at_us", "seq")).alias("said"), F.count(F.lit(1)).alias("block_count"))
    h = W.on_spine(latest, V.FIRST_HOUR, V.LAST_HOUR)
    carried = F.last("said", ignorenulls=True).over(Window.partitionBy("chain").orderBy("hour"))  # a row an hour
    return h.select("hour", carried.alias("bs")).filter("bs is not null")


#: Chain thresholds of two versions; chains without a row, and null thresholds, are switched off.
CHAIN_PARAMS = [("click", "v2", 1.05, 1.10), ("click", "v3", 1.05, 1.20), ("purchase", "v2", 1.15, None), ("purchase", "v3", 1.15, None), ("error", "v2", 1.05, 1.06), ("error", "v3", 1.05, 1.12)]


def _per_chain(s, d):
    """Chain thresholds from a parameter table, one row a chain; a chain without one is S1D1 throughout."""
    params = s.createDataFrame(CHAIN_PARAMS, "chain string, version string, p_s2 double, p_sigma double").filter("version = 'v3'").drop("version")
    w = R.ratios(_inv(s, d, True), warm_up=5).join(F.broadcast(params), "chain", "left")
    return R.classify(w, F.col("p_s2"), F.col("p_sigma")).select("chain", "idx", "state")


def _d2_percent(s, d):
    w = materialize(R.ratios(_inv(s, d, True), warm_up=5).filter("sigma is not null").select("chain", "sigma"))
    q = quantiles(w, "sigma", {"p90": 0.90, "p95": 0.95, "p97": 0.97, "p98": 0.98, "p99": 0.99}, ["chain"])
    counts = w.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.count_if(F.col("sigma") >= 1.10) / F.count(F.lit(1)), 4).alias("d2_percent"), F.round(F.avg("sigma"), 6).alias("avg_sigma"))
    return counts.join(q, "chain").select("chain", "n", "d2_percent", "avg_sigma", *_r("p90", "p95", "p97", "p98", "p99"))


def _calibrate(s, d):
    """P97 of each chain's demand ratio; it is a threshold with 30 days of data at least."""
    w = materialize(R.ratios(_inv(s, d, True), warm_up=5).select("chain", "sigma", "start_us", "end_us"))
    days = w.groupBy("chain").agg(((F.max("end_us") - F.min("start_us")) / V.DAY).alias("days"))
    q = days.join(quantiles(w, "sigma", {"p97": 0.97}, ["chain"]), "chain")
    return q.select("chain", *_r("days", "p97"), F.round(F.when(F.col("days") >= 30, F.col("p97")), 6).alias("threshold"), F.round(F.when(F.col("days") >= 29, F.col("p97")), 6).alias("threshold_29d"))


def _profile(s, d):
    w = materialize(R.normal(_scored(s, d), V.incidents(s)).select("rhythm"))
    q = quantiles(w, "rhythm", {"p50": 0.5, "p85": 0.85, "p90": 0.90, "p95": 0.95, "p99": 0.99})
    one = w.agg(F.count("rhythm").alias("n"), F.avg("rhythm").alias("avg"), F.stddev_samp("rhythm").alias("std")).crossJoin(q)  # single rows
    return one.select("n", *_r("avg", "std", "p50", "p85", "p90", "p95", "p99"), F.round(F.col("std") / F.col("avg"), 6).alias("cv"), F.round(F.col("p99") / F.col("p50"), 6).alias("p99_p50"))


def _quantiles_normal(s, d):
    w = materialize(R.normal(_scored(s, d), V.incidents(s)).select("rhythm", "sigma"))
    points = (0.1, 0.5, 0.9, 0.95, 0.99)
    a, b = (quantiles(w, c, {f"{c}_p{int(p * 100)}": p for p in points}) for c in ("rhythm", "sigma"))
    return a.crossJoin(b).select(*_r(*a.columns, *b.columns))  # single rows


def _millionths(c):
    return F.round(F.col(c) * 1_000_000).cast("long")


def _hash(s, d):
    """Hashes of blocks over all their fields, of windows over their blocks' hashes, and of windows over their own fields."""
    b = W.count_windows(V.blocks(s, d), PHI)
    h = b.withColumn("h", F.sha2(F.concat_ws(":", "chain", "number", "us", _millionths("gas_used"), _millionths("gas_limit"), _millionths("size"), "tx"), 256))
    return h.groupBy("window_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "h"))), lambda x: x["h"]), ""), 256).alias("batch_hash"))


def _window_hash(s, d):
    fields = F.concat_ws(":", "chain", "window_id", "start_us", "end_us", "block_count", "first_block", "last_block", *[_millionths(c) for c in ("rho_ts", "rho_s", "size_avg", "tx_count_avg", "c_s")])
    return _windows(s, d).select("window_id", F.sha2(fields, 256).alias("l1_hash"))


def _relays(s, d):
    """Hourly relay figures of the fixture: gaps of batches against their baseline, rollup blocks against batches."""
    gaps = C.batch_gaps(_layer(s, d, "purchase")).groupBy("chain", F.expr(f"us div {V.HOUR}").alias("hour")).agg(F.avg("gap").alias("t_relay"), F.count(F.lit(1)).alias("throughput"))
    sent = _layer(s, d, "click").groupBy("chain", F.expr(f"us div {V.HOUR}").alias("hour")).agg(F.count(F.lit(1)).alias("pending"))
    h = _spine(s, d).join(gaps, ["chain", "hour"], "left").join(sent, ["chain", "hour"], "left")
    h = ema(h, {"_e": ("t_relay", R.HOURLY)})
    return C.bridge_ratios(h.withColumn("expected", R.lagged("_e")))


def _bridge_grid(s, d):
    return C.bridge_grid(_relays(s, d)).select("hour", *_r("latency_ratio", "backlog_ratio"), "grid")


def _causal(s, d):
    g = C.bridge_grid(_relays(s, d)).select("hour", "grid")
    return C.causal(_base(s, d).filter("l1_state is not null").select("hour", "l1_state").join(g, "hour")).select("hour", "l1_state", "grid", "reading", "response")


def _confidence(s, d):
    """The chain of all events, measured on the incidents, and each event type's chain, which has none."""
    sc, e = _scored(s, d), V.incidents(s)
    span = sc.agg(((F.max("end_us") - F.min("start_us")) / V.DAY).alias("days"))
    t = R.detect(sc, e).agg(F.avg(F.col("tp").cast("double")).alias("tpr"), F.count(F.lit(1)).alias("n"))
    whole = t.crossJoin(R.false_positive_rate(sc, e).select("fpr")).crossJoin(span).select(F.lit("evt").alias("chain"), "tpr", "fpr", "n", "days")  # single rows
    types = _windows(s, d, True).groupBy("chain").agg(((F.max("end_us") - F.min("start_us")) / V.DAY).alias("days")).select("chain", F.lit(None).cast("double").alias("tpr"), F.lit(None).cast("double").alias("fpr"), F.lit(0).cast("long").alias("n"), "days")
    return whole.unionByName(types).select("chain", *_r("tpr", "fpr"), "n", R.confidence(F.col("tpr"), F.col("fpr"), F.col("n"), F.col("days"), F.col("days")).alias("level"))


#: The library's parameters, and two of the fixture's chains that have their own.
VALIDITY = [*R.VALIDITY, ("click", "rho_s", 30, 0.0001, 0.9, None), ("error", "c_s", 30, 0.0, 0.0, "Redundant")]


def _validity(s, d):
    """Whether each chain's cadence, load and continuity can be used, and why not."""
    w = _windows(s, d, True)
    long_ = w.select("chain", F.explode(F.create_map(*[x for c in ("rho_ts", "rho_s", "c_s") for x in (F.lit(c), F.col(c))])).alias("signal", "x"))
    g = long_.groupBy("chain", "signal").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
    return R.validity(g, s.createDataFrame(VALIDITY, R.VALIDITY_SCHEMA)).select("chain", "signal", "n", *_r("mean", "deviation"), "status", "reason")


#: Thresholds by validity: a new version on the fifteenth, a fork of the purchase chain that leaves two days without any.
_DATE = lambda day: V._JANUARY + (day - 1) * V.DAY
RANGES = [("click", "v2", _DATE(1), _DATE(15), 1.05, 1.10), ("click", "v3", _DATE(15), None, 1.05, 1.20), ("purchase", "v2", _DATE(1), _DATE(10), 1.15, None), ("purchase", "v3", _DATE(12), None, 1.10, 1.15), ("error", "v2", _DATE(5), None, 1.05, 1.06)]


def _in_force(s, d):
    """States by the thresholds in force when a window starts; without any the window is S1D1 and has no version."""
    ranges = s.createDataFrame(RANGES, "chain string, version string, valid_from long, valid_to long, p_s2 double, p_sigma double")
    w = valid_at(R.ratios(_inv(s, d, True), warm_up=5), ranges, ["version", "p_s2", "p_sigma"])
    return R.classify(w, F.col("p_s2"), F.col("p_sigma")).select("chain", "idx", "version", "state")


#: Resets of the baselines: the click chain's instrument changes on the eighth and the twentieth.
RESETS = [("click", _DATE(8)), ("click", _DATE(20)), ("error", _DATE(16))]


def _append(s, d):
    """Windows and baselines in two runs, of the month's first and second half; the second goes on from what the first left."""
    ledger = Ledger(s, new_folder(s, "ledger"), PHI)
    resets = s.createDataFrame(RESETS, "chain string, at_us long")
    blocks, half = V.blocks(s, d, True), _DATE(16)
    ledger.append(blocks.filter(F.col("us") < half), resets)
    ledger.append(blocks.filter(F.col("us") >= half), resets)
    return ledger.windows().select("chain", "window_id", "epoch", "start_us", *_r("rho_ts", "e_rho", "slow_rho", "e_sigma"))


def _rolling(s, d):
    """P97 of each chain's demand ratio over the ten days up to each day, from stored daily sketches."""
    w = R.ratios(_inv(s, d, True), warm_up=5)
    sketches = materialize(daily_sketches(w, "sigma"))
    return rolling_threshold(sketches, days=10, least=8).select("chain", "day", "days", "n", F.round("value", 6).alias("p97"), F.round("threshold", 6).alias("threshold"))


def _insensitive(s, d):
    """Runs of structural stress on each chain, and how long the baseline hides a second one."""
    w = ema(R.ratios(_inv(s, d, True), warm_up=5), {"slow": ("rho_ts", R.SLOW)}).select("chain", "idx", "start_us", "rhythm", F.col("ema_rhythm").alias("fast"), "slow")
    e = episodes(w)
    return e.select("chain", "episode", "end_idx", "n", "start_us", "end_us", F.round("peak", 6).alias("peak"), "insensitive", "met_us", F.round("needed", 6).alias("needed"))


def _incidents_of(s, d, rows):
    return R.in_incident(rows, V.incidents(s))


def _cut(s, d):
    """Windows of clean blocks from the tenth of January on, less those after a fork on the twentieth."""
    b = V.in_range(V.blocks(s, d), V._JANUARY + 9 * V.DAY, V._JANUARY + 19 * V.DAY)
    return W.invariants(W.count_windows(b, PHI), PHI).select("window_id", "first_block", "last_block", "block_count")


QUERIES = {
    "catalog_columns": lambda s, d: V.columns_of(s.read.parquet(f"{d}/events.parquet"), "events").select("table_name", "column_name", "ordinal_position"),
    "range_cut": _cut,
    "row_windows": lambda s, d: W.count_windows(V.blocks(s, d), PHI).select("number", "window_id"),
    "slot_windows": lambda s, d: W.key_windows(V.slots(s, d), SLOT_PHI).select("slot", "window_id"),
    "hour_windows": lambda s, d: _hours(s, d, "purchase").select("hour", "block_count", *_r("size_avg", "tx_avg", "gas_avg", "blob_avg", "basefee_avg")),
    "interblock_interval": lambda s, d: _hours(s, d, "purchase").select("hour", *_r("interval")),
    "hourly_rollup": lambda s, d: W.hour_means(_layer(s, d, "click")).select("hour", "block_count", *_r("size_avg", "gas_avg", "basefee_avg")),
    "invariants": lambda s, d: W.invariants(W.count_windows(V.blocks(s, d), PHI), PHI).select("window_id", "block_count", "first_block", "last_block", *_r("rho_ts", "rho_s"), "c_s"),
    "trim_edges": lambda s, d: _inv(s, d).select("idx", "window_id"),
    "gap_fill": lambda s, d: _slot_filled(s, d).select("idx", "window_id", "block_count", "rho_ts", "c_s", "start_us"),
    "ema_fast": lambda s, d: _emas(s, d, R.FAST),
    "ema_slow": lambda s, d: _emas(s, d, R.SLOW),
    "ema_nullsafe": lambda s, d: ema(_slot_filled(s, d, False), {"e": ("rho_ts", R.FAST)}, first=1.0).select("idx", *_r("e")),
    "ema_lagged": lambda s, d: R.hourly_ratio(_hours(s, d, "purchase"), {"ratio": "size_avg"}).select("hour", *_r("ratio")),
    "ema_reset": _reset,
    "stream_ema": _stream,
    "ratios": lambda s, d: _ratios(s, d).select("idx", *_r("rhythm", "sigma", "size_r", "tx_r")),
    "warmup_null": lambda s, d: _ratios(s, d).agg(F.count_if(F.col("rhythm").isNull()).alias("n_null"), F.min(F.when(F.col("rhythm").isNotNull(), F.col("idx"))).alias("first_idx")),
    "slow_drift": lambda s, d: R.ratios(_inv(s, d), alpha=R.SLOW).select("idx", *_r("rhythm")),
    "continuity_ratio": _continuity,
    "complexity_ratio": lambda s, d: _derived(s, d, F.try_divide("size_avg", "tx_count_avg"), True),
    "gas_complexity_ratio": lambda s, d: _derived(s, d, F.col("gas_used_avg") / F.nullif("tx_count_avg", F.lit(0.0)), False),
    "adapter_signals": _adapter,
    "classify_1d": lambda s, d: R.classify(_ratios(s, d)).select("idx", "state"),
    "classify_2of3": lambda s, d: _scored(s, d).select("idx", "d2_dims", "state"),
    "classify_slot": lambda s, d: _slot_scored(s, d).select("idx", *_r("rhythm"), "state"),
    "classify_l1_hour": lambda s, d: _base(s, d).select("hour", *_r("interval_r", "size_r", "tx_r", "blob_r", "sigma"), "l1_state"),
    "classify_l2_hour": lambda s, d: _rollup(s, d).select("hour", *_r("count_r", "size_r", "gas_r", "sigma"), "l2_state"),
    "bridge_intervals": lambda s, d: C.batch_gaps(_layer(s, d, "purchase")).select("number", *_r("gap")),
    "asof_last_blob": lambda s, d: C.last_batch(_spine(s, d), _layer(s, d, "purchase")).select("hour", "last_us"),
    "bridge_bs": lambda s, d: _bridge(s, d).filter("bs is not null").select("hour", *_r("age_min", "baseline"), "bs"),
    "bridge_alarm": _bridge_alarm,
    "bridge_grid": _bridge_grid,
    "composite": _composite,
    "composite_summary": lambda s, d: _composite(s, d).agg(F.count(F.lit(1)).alias("hours"), F.count_if(F.col("bridge_regime") == "BS2").alias("bs2"), F.count_if(~F.col("l2_regime").isin("S1D1", "N/A")).alias("l2_degraded"), F.count_if(F.col("composite") == "MULTI_LAYER").alias("multi"), F.count_if("alert").alias("alerts"), F.count_if("fee_monitor_visible").alias("fee")),
    "first_alert": lambda s, d: _composite(s, d).filter("alert").agg(F.min("window_start").alias("window_start"), F.min_by("composite", "window_start").alias("composite")),
    "causal_grid": _causal,
    "event_window": lambda s, d: _incidents_of(s, d, _scored(s, d)).groupBy("event").agg(F.count(F.lit(1)).alias("n")),
    "event_join": lambda s, d: _incidents_of(s, d, _scored(s, d)).select("event", "idx", "state"),
    "normal_windows": lambda s, d: R.normal(_scored(s, d), V.incidents(s)).select("idx", "state"),
    "state_distribution": lambda s, d: R.distribution(_scored(s, d)),
    "slot_distribution": lambda s, d: R.distribution(_slot_scored(s, d), valid_only=True),
    "fpr": lambda s, d: R.false_positive_rate(_scored(s, d), V.incidents(s)),
    "event_detection": lambda s, d: R.detect(_scored(s, d), V.incidents(s)),
    "undetected": lambda s, d: R.undetected(R.classify_slots(_slot_scored(s, d).drop("state"), 1.5, 0.2).select("idx", "start_us", "rhythm", "c_s", "tx_r", "state"), V.incidents(s)).select("event", *_r("max_rhythm", "min_c_s", "max_tx")),
    "tpr": lambda s, d: R.detect(_scored(s, d), V.incidents(s)).agg(F.round(F.avg(F.col("tp").cast("double")), 6).alias("tpr")),
    "quantiles_normal": _quantiles_normal,
    "m1": lambda s, d: R.stability(materialize(_scored(s, d)), V.incidents(s), "rhythm"),
    "m1_level": lambda s, d: R.stability(materialize(_scored(s, d)), V.incidents(s), "sigma").select("signal", "level"),
    "signal_profile": _profile,
    "signal_validity": _validity,
    "confidence_level": _confidence,
    "continuity_check": lambda s, d: R.continuity_check(_slot_windows(s, d)),
    "latest_valid": lambda s, d: R.latest_valid(_windows(s, d, True)).select("chain", "window_id", *_r("c_s", "rho_ts"), "valid"),
    "histogram": lambda s, d: histogram(_scored(s, d), "rhythm"),
    "l2_state_per_chain": _per_chain,
    "state_in_force": _in_force,
    "append_baselines": _append,
    "rolling_p97": _rolling,
    "insensitive_periods": _insensitive,
    "l2_d2_percent": _d2_percent,
    "calibrate_p97": _calibrate,
    "l0_hash": _hash,
    "l1_hash": _window_hash,
    **{n: _sweep(n) for n in GRIDS},
    "sweep_slot_a": lambda s, d: S.event_columns(_slot_phases(s, d)[0], EVENT_NAMES),
    "sweep_slot_b": lambda s, d: S.event_columns(_slot_phases(s, d)[1], EVENT_NAMES, latency=False),
    "sweep_union": _slot_union,
    "select_slot_threshold": lambda s, d: S.select_slot_threshold(_slot_phases(s, d)[0], len(V.EVENTS)),
    "pivot_fpr": _pivot,
    "highest_full_tpr": lambda s, d: S.highest_full(_swept(s, d, "sweep_s2"), len(V.EVENTS)),
    "select_threshold": lambda s, d: S.event_columns(S.select_threshold(_swept(s, d, "sweep_pol_s2"), len(V.EVENTS)), EVENT_NAMES),
}

from .oracles import ORACLE_SQL  # noqa: E402, F401  (its grids come from above)
