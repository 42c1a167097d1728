"""Ratios, states, incidents and stability scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ema import ema, lagged
from ..functions.intervals import interval_join
from ..functions.quantiles import quantiles

FAST, SLOW, HOURLY, WARM_UP = 2 / 11, 2 / 721, 0.1, 50
ALERTS = ("S2D1", "S2D2", "S1D2")


def ratios(windows: DataFrame, warm_up: int = WARM_UP, alpha: float = FAST) -> DataFrame:
    """rhythm, sigma, size_r, tx_r: values over their baselines (which include the row); null through the warm-up."""
    of = {"rhythm": "rho_ts", "sigma": "rho_s", "size_r": "size_avg", "tx_r": "tx_count_avg"}
    e = ema(windows, {f"ema_{n}": (c, alpha) for n, c in of.items()})
    return e.withColumns({n: F.when(F.col("idx") > warm_up, F.try_divide(F.col(c), F.col(f"ema_{n}"))) for n, c in of.items()})


def at_least(column: str, threshold) -> F.Column:
    """Whether a ratio reaches its threshold; null does not, and a null threshold is switched off."""
    return F.coalesce(F.col(column) >= threshold, F.lit(False))


def classify(rows: DataFrame, s2=1.12, sigma=1.10, size=None, tx=None, need: int = 1) -> DataFrame:
    """state: S2 at a rhythm of s2, D2 where `need` of the demand ratios reach their thresholds."""
    s2, sigma, size, tx = (F.lit(x).cast("double") if not isinstance(x, F.Column) else x for x in (s2, sigma, size, tx))
    dims = at_least("sigma", sigma).cast("int") + at_least("size_r", size).cast("int") + at_least("tx_r", tx).cast("int")
    return rows.withColumn("d2_dims", dims).withColumn("state", F.concat(F.when(at_least("rhythm", s2), "S2").otherwise("S1"), F.when(dims >= need, "D2").otherwise("D1")))


def classify_slots(rows: DataFrame, rhythm: float = 1.12, continuity: float | None = 0.5, demand: float = 1.10) -> DataFrame:
    """Slot chains: strict thresholds; a structural alarm with exactly one demand alarm is S1D2 (kept from the definition)."""
    over = lambda c, t: F.coalesce(F.col(c) > t, F.lit(False))
    low = F.lit(False) if continuity is None else F.coalesce(F.col("c_s") < continuity, F.lit(False))
    dims = sum(over(c, demand).cast("int") for c in ("sigma", "size_r", "tx_r"))
    struct = over("rhythm", rhythm) | low
    state = F.when(struct & (dims >= 2), "S2D2").when(dims >= 1, "S1D2").when(struct, "S2D1").otherwise("S1D1")
    return rows.withColumn("state", state)


def slot_scores(filled: DataFrame, warm_up: int = WARM_UP) -> DataFrame:
    """rhythm of slot windows: baseline of cadence up to 5, ratio of cadence up to 20; demand ratios are 1."""
    z = filled.withColumn("_z", F.least("rho_ts", F.lit(5.0)))
    e = ema(z, {"ema_rhythm": ("_z", FAST)}, first=1.0)
    rhythm = F.when(F.col("idx") > warm_up, F.least("rho_ts", F.lit(20.0)) / F.col("ema_rhythm"))
    return e.withColumn("rhythm", rhythm).withColumns({c: F.lit(1.0) for c in ("sigma", "size_r", "tx_r")}).drop("_z")


def in_incident(scored: DataFrame, incidents: DataFrame) -> DataFrame:
    """Window and incident pairs: onset <= start <= until."""
    return interval_join(scored, incidents)


def normal(scored: DataFrame, incidents: DataFrame, warm_up: int = WARM_UP) -> DataFrame:
    """Windows after the warm-up that lie in no incident."""
    return interval_join(scored.filter(F.col("idx") > warm_up), incidents, how="left_anti")


def distribution(scored: DataFrame, warm_up: int = WARM_UP, valid_only: bool = False) -> DataFrame:
    """state, n, percent. All windows are counted, warm-up ones too, and the share is of their number less `warm_up`.

    With `valid_only` (slot chains) only windows after the warm-up are counted, and the share is of these.
    """
    rows = scored.filter(F.col("idx") > warm_up) if valid_only else scored
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    less = F.col("whole") - (0 if valid_only else warm_up)
    return counts.crossJoin(F.broadcast(whole)).select("state", "n", F.round(F.try_divide(100.0 * F.col("n"), less), 4).alias("percent"))  # one row


def detect(scored: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident: detected, hours to the first detection, windows, detecting windows and their share."""
    hit = F.array_contains("expected", F.col("state"))
    found = in_incident(scored, incidents).groupBy("event").agg(F.count("start_us").alias("n_window"), F.count_if(hit).alias("n_detected"), F.min(F.when(hit, F.col("start_us"))).alias("first_us"))
    j = incidents.select("event", "onset").join(found, "event", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_window", "n_detected")})
    return j.select(
        "event", (F.col("n_detected") > 0).alias("tp"), F.round((F.col("first_us") - F.col("onset")) / 3.6e9, 1).alias("latency_h"), "n_window", "n_detected",
        F.round(F.coalesce(F.try_divide("n_detected", "n_window"), F.lit(0.0)), 3).alias("detect_ratio"),
    )


def undetected(scored: DataFrame, incidents: DataFrame) -> DataFrame:
    """What came nearest in the incidents that have windows and no detection: largest rhythm and tx ratio, smallest continuity."""
    hit = F.array_contains("expected", F.col("state"))
    j = in_incident(scored, incidents).groupBy("event").agg(F.count_if(hit).alias("hits"), F.max("rhythm").alias("max_rhythm"), F.min("c_s").alias("min_c_s"), F.max("tx_r").alias("max_tx"))
    return j.filter("hits = 0").drop("hits")


def false_positive_rate(scored: DataFrame, incidents: DataFrame, states=ALERTS) -> DataFrame:
    """Share and number of normal windows in one of `states`, the share of structural (S2) states and of demand alone."""
    def share(of):
        return F.round(F.avg(F.when(F.col("state").isin(*of), 1.0).otherwise(0.0)), 6)

    tau = [s for s in states if s.startswith("S2")]
    pi = [s for s in states if not s.startswith("S2")]
    return normal(scored, incidents).agg(share(states).alias("fpr"), share(tau).alias("fpr_tau"), share(pi).alias("fpr_pi"), F.count_if(F.col("state").isin(*states)).alias("n_fp"), F.count(F.lit(1)).alias("n_normal"))


def stability(scored: DataFrame, incidents: DataFrame, signal: str, cap: float = 1.05) -> DataFrame:
    """M1: the largest incident ratio over the normal median, relative to the variation of nominal ratios."""
    n = normal(scored, incidents).filter(F.col(signal).isNotNull())
    base = n.agg((F.stddev_samp(F.when(F.col(signal) < cap, F.col(signal))) / F.avg(F.when(F.col(signal) < cap, F.col(signal)))).alias("cv"))
    base = base.crossJoin(quantiles(n, signal, {"p50": 0.5}))
    top = in_incident(scored, incidents).filter(F.col(signal).isNotNull()).agg(F.max(signal).alias("max_event"), F.max_by("event", signal).alias("best_event"))
    m1 = ((F.col("max_event") - F.col("p50")) / F.col("p50")) / F.col("cv")
    return base.crossJoin(top).select(F.lit(signal).alias("signal"), "best_event", F.round("max_event", 6).alias("max_event"), F.round("p50", 6).alias("p50"), F.round("cv", 6).alias("cv"), F.round(m1, 4).alias("m1"), level(m1).alias("level"))  # single rows


def level(m1) -> F.Column:
    return F.when(m1 >= 2, "Excellent").when(m1 >= 1, "Certified").when(m1 >= 0.5, "Operational").otherwise("Provisional")


def confidence(tpr, fpr, incidents, deployed_days, data_days) -> F.Column:
    """How far a set of thresholds can be trusted. HIGH: tpr of 0.80, fpr of 0.10 at most, three incidents, over 30 days in use.
    MEDIUM (events): measured on incidents. MEDIUM (statistics): no incidents, 30 days of data at least. Else LOW."""
    measured = (incidents > 0) & tpr.isNotNull() & fpr.isNotNull()
    high = measured & (tpr >= 0.80) & (fpr <= 0.10) & (incidents >= 3) & (deployed_days > 30)
    return F.when(F.coalesce(high, F.lit(False)), "HIGH").when(measured, "MEDIUM event-based").when((incidents == 0) & (data_days >= 30), "MEDIUM statistical").otherwise("LOW")


#: What signals need to be used, by signal, and by chain where that differs (chain null: all others): windows, mean and relative deviation at
#: least, or a status that holds by design. A cadence set by governance or a sequencer says nothing, a load held at its target little.
VALIDITY = [
    (None, "rho_ts", 30, 0.0, 0.003, None), (None, "rho_s", 30, 0.0001, 0.02, None), (None, "c_s", 30, 0.0, 0.01, None),
    ("arbitrum", "rho_ts", 30, 0.0, 0.0, "Dormant"), ("base", "rho_ts", 30, 0.0, 0.0, "Dormant"), ("optimism", "rho_ts", 30, 0.0, 0.0, "Dormant"),
    ("base", "c_s", 30, 0.0, 0.0, "Redundant"), ("optimism", "c_s", 30, 0.0, 0.0, "Redundant"),
]
VALIDITY_SCHEMA = "chain string, signal string, least_n long, least_mean double, least_variation double, fixed string"


def validity(statistics: DataFrame, params: DataFrame) -> DataFrame:
    """Add status and reason to statistics (chain, signal, n, mean, deviation) of signals, by a parameter table as VALIDITY.

    Broken: the mean does not reach the least one (a load over a limit without end is zero). Then what holds by design; Observational: too few
    windows; Dormant: a deviation under the least share of the mean. Else Valid. Signals without parameters have neither. The row of a chain goes before that of
    all chains.
    """
    own = params.filter("chain is not null").withColumnRenamed("chain", "_chain")
    every = params.filter("chain is null").drop("chain")
    columns = ("least_n", "least_mean", "least_variation", "fixed")
    s = statistics.join(own.select(F.col("_chain").alias("chain"), "signal", F.struct(*columns).alias("_own")), ["chain", "signal"], "left")
    s = s.join(every.select("signal", F.struct(*columns).alias("_every")), "signal", "left").withColumn("_p", F.coalesce("_own", "_every"))
    least, p = F.coalesce("mean", F.lit(0.0)), F.col("_p")
    cases = [
        (F.abs(least) <= p["least_mean"], "Broken", "mean"), (p["fixed"].isNotNull(), None, "by design"), (F.col("n") < p["least_n"], "Observational", "windows"),
        (F.coalesce(F.try_divide("deviation", F.abs(least)), F.lit(0.0)) < p["least_variation"], "Dormant", "variation"),
    ]
    status, reason = F.lit("Valid"), F.lit(None).cast("string")
    for holds, name, why in reversed(cases):
        status, reason = F.when(holds, p["fixed"] if name is None else F.lit(name)).otherwise(status), F.when(holds, why).otherwise(reason)
    known = p.isNotNull()
    return s.select(*statistics.columns, F.when(known, status).alias("status"), F.when(known, reason).alias("reason"))


def continuity_check(windows: DataFrame, bound: float = 0.99) -> DataFrame:
    """Per chain nine quantiles of c_s, and whether its 10 % quantile is over `bound`: then the continuity threshold is switched off (null)."""
    points = {f"p{round(100 * p):02d}": p for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)}
    q = quantiles(windows, "c_s", points, ["chain"])
    off = F.col("p10") > bound
    return q.select("chain", *[F.round(n, 6).alias(n) for n in points], off.alias("disabled"), F.round(F.when(~off, F.col("p10")), 6).alias("continuity_p10"))


def latest_valid(windows: DataFrame, continuity: float = 0.90, cadence: float = 2.5) -> DataFrame:
    """Per chain the latest window, and whether its continuity is over `continuity` and its cadence under `cadence`."""
    last = windows.groupBy("chain").agg(F.max_by(F.struct("window_id", "c_s", "rho_ts"), "window_id").alias("w")).select("chain", "w.*")
    return last.withColumn("valid", F.coalesce((F.col("c_s") > continuity) & (F.col("rho_ts") < cadence), F.lit(False)))


def hourly_ratio(hourly: DataFrame, columns: dict[str, str], warm_up: int = 20) -> DataFrame:
    """Ratios over the baseline before the hour; hours without a value neither count nor update; none in the first 20 hours."""
    e = ema(hourly, {f"_e_{n}": (c, HOURLY) for n, c in columns.items()})
    e = e.withColumns({f"_l_{n}": lagged(f"_e_{n}") for n in columns})
    ratio = {n: F.when((F.col("idx") >= warm_up) & F.col(c).isNotNull(), F.when(F.coalesce(F.col(f"_l_{n}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c) / F.col(f"_l_{n}"))) for n, c in columns.items()}
    return e.withColumns(ratio).drop(*(f"_{k}_{n}" for n in columns for k in "el"))
