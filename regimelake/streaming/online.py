"""The online engine: blocks arrive as micro-batches in any order, windows and baselines are state."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.ema import affine

#: What comes out: closed windows, and blocks that came after a later one had been folded (kind `late`: number, start_us and rho_s, which is their load).
OUT = "kind string, chain string, idx long, number long, start_us long, end_us long, rho_ts double, rho_s double, rhythm double, rhythm_slow double, sigma double, state string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]

#: The open window and the baselines of a chain, and the time that its timer is set to (milliseconds, -1: none).
_OPEN = "n long, start_us long, last_us long, count long, load double, loads long, e double, slow double, e_load double, idx long, timer long"
_FRESH = (-1, 0, 0, 0, 0.0, 0, float("nan"), float("nan"), float("nan"), 0, -1)

#: Blocks on hold, packed: a few large values are read and written faster than many rows.
_HELD = np.dtype([("number", "<i8"), ("us", "<i8"), ("load", "<f8")])


@contextlib.contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Streams that are started within keep their state in RocksDB, dealt over `partitions` tasks; the session's settings come back afterwards."""
    put = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        put["spark.sql.shuffle.partitions"] = str(partitions)
    was = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _baseline(values: np.ndarray, before: float, alpha: float) -> np.ndarray:
    """The EMA after each value, from `before` (NaN: none yet)."""
    if before != before:
        known = np.flatnonzero(~np.isnan(values))
        if not len(known):
            return np.full(len(values), np.nan)
        before = values[known[0]]
        a, b = affine(values, alpha)
        return np.where(np.arange(len(values)) < known[0], np.nan, a * before + b)
    a, b = affine(values, alpha)
    return a * before + b


class Fold:
    """A chain's blocks in order of their numbers, folded into windows of `phi`, their ratios and states."""

    def __init__(self, phi: int, alpha: float, slow: float, s2: float, d2: float, warm_up: int):
        self.phi, self.alpha, self.slow, self.s2, self.d2, self.warm_up = phi, alpha, slow, s2, d2, warm_up

    def __call__(self, chain: str, state: tuple, number: np.ndarray, us: np.ndarray, loaded: np.ndarray) -> tuple[tuple, pd.DataFrame | None]:
        """(state after the blocks, windows that they close or None)"""
        n, start, last, count, load, loads, e, e_slow, e_load, idx, timer = state
        phi, size = self.phi, len(number)
        window = (count + np.arange(size)) // phi
        begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        starts, ends = np.minimum.reduceat(us, begin), np.maximum.reduceat(us, begin)
        there = ~np.isnan(loaded)
        total, known = np.add.reduceat(np.where(there, loaded, 0.0), begin), np.add.reduceat(there.astype(np.int64), begin)
        if count:
            starts[0], ends[0] = min(start, starts[0]), max(last, ends[0])
            total[0], known[0] = total[0] + load, known[0] + loads
        whole = (count + size) // phi
        n, count, rows = int(number[-1]), (count + size) % phi, None
        if count:
            start, last, load, loads = int(starts[-1]), int(ends[-1]), float(total[-1]), int(known[-1])
        if whole:
            rho = (ends[:whole] - starts[:whole]) // 1000 / 1000 / max(phi - 1, 1)
            mean = np.divide(total[:whole], known[:whole], out=np.full(whole, np.nan), where=known[:whole] > 0)
            fast, long_, demand = _baseline(rho, e, self.alpha), _baseline(rho, e_slow, self.slow), _baseline(mean, e_load, self.alpha)
            e, e_slow, e_load = float(fast[-1]), float(long_[-1]), float(demand[-1])
            at = idx + np.arange(whole)

            def ratio(values, base):
                return np.where((at > self.warm_up) & (base != 0), np.divide(values, base, out=np.full(whole, np.nan), where=base != 0), np.nan)

            rhythm, drift, sigma = ratio(rho, fast), ratio(rho, long_), ratio(mean, demand)
            said = np.char.add(np.where(rhythm >= self.s2, "S2", "S1"), np.where(sigma >= self.d2, "D2", "D1"))
            rows = pd.DataFrame({"kind": "window", "chain": chain, "idx": at, "number": n, "start_us": starts[:whole], "end_us": ends[:whole], "rho_ts": rho, "rho_s": mean, "rhythm": rhythm, "rhythm_slow": drift, "sigma": sigma, "state": said})
            idx += whole
        return (n, int(start), int(last), int(count), float(load), int(loads), e, e_slow, e_load, int(idx), timer), rows


def _late(chain: str, blocks: np.ndarray) -> pd.DataFrame:
    """Blocks that came too late, as rows of the output."""
    out = pd.DataFrame({c: np.full(len(blocks), None, object) for c in _COLUMNS})
    out["kind"], out["chain"] = np.full(len(blocks), "late", object), np.full(len(blocks), chain, object)
    for c, of in (("number", "number"), ("start_us", "us"), ("rho_s", "load")):
        out[c] = blocks[of]
    return out


class Sequencer(StatefulProcessor):
    """Holds a chain's blocks until the watermark has passed their time, then folds them by number."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.held = handle.getListState("held", "blocks binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.open.get() or _FRESH)
        for pdf in rows:
            pdf = pdf[pdf["number"].notna() & pdf["us"].notna()]  # rows without a number only move the watermark
            if not len(pdf):
                continue
            blocks = np.empty(len(pdf), _HELD)
            for c in _HELD.names:
                blocks[c] = pdf[c].to_numpy(_HELD[c], na_value=np.nan) if c == "load" else pdf[c].to_numpy(np.int64)
            passed = blocks["number"] <= state[0]
            late, blocks = blocks[passed], blocks[~passed]
            if len(late):
                yield _late(key[0], late)
            if len(blocks):
                self.held.appendValue((blocks.tobytes(),))
                state = self._wake(state, int(blocks["us"].min()))
        self.open.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = (*tuple(self.open.get() or _FRESH)[:-1], -1)
        parts = [np.frombuffer(bytes(x[0]), _HELD) for x in self.held.get()]
        blocks = np.concatenate(parts) if parts else np.empty(0, _HELD)
        blocks = blocks[np.lexsort((blocks["us"], blocks["number"]))]
        # A block waits for those of smaller numbers, whatever their times.
        waiting = np.flatnonzero(blocks["us"] > now)
        ready = int(waiting[0]) if len(waiting) else len(blocks)
        out = None
        if ready:
            state, out = self.fold(key[0], state, *(np.ascontiguousarray(blocks[c][:ready]) for c in _HELD.names))
            self.held.clear()
            if ready < len(blocks):
                self.held.appendValue((blocks[ready:].tobytes(),))
        if ready < len(blocks):
            state = self._wake(state, int(blocks["us"][ready]))
        self.open.update(state)
        if out is not None:
            yield out[_COLUMNS]

    def _wake(self, state: tuple, us: int) -> tuple:
        """One timer a chain, at the earliest time that the watermark has to pass."""
        at = us // 1000 + 1
        if 0 <= state[-1] <= at:
            return state
        if state[-1] >= 0:
            self.handle.deleteTimer(state[-1])
        self.handle.registerTimer(at)
        return (*state[:-1], at)


def stream_classify(blocks: DataFrame, phi: int, delay: str = "10 minutes", alpha: float = 2 / 11, slow: float = 2 / 721, s2: float = 1.12, d2: float = 1.10, warm_up: int = 50) -> DataFrame:
    """Windows of `phi` blocks of each chain with cadence, load, their ratios to baselines and the state, and the blocks that came too late.

    blocks: a stream of (chain, number, us) and, for demand, load, in any order. A block is held until the watermark, the
    latest time seen less `delay`, has passed its time; then the chain's blocks fold in the order of their numbers, equal ones by time.
    Whatever order files come in, rows at most `delay` behind the latest give the windows of a batch. A block whose number has
    been passed is not folded: it comes out once, of kind `late`. The state of a chain is its open window, three
    baselines and the blocks of the last `delay`. Rows without a number or time are no blocks; those with a time move the
    watermark (`tick`), which is how a stream that ends is brought to its end. Null loads do not enter a window's mean. Windows
    are numbered from 0, nothing is trimmed. The stream has to be started within `state_store`.
    """
    if "load" not in blocks.columns:
        blocks = blocks.withColumn("load", F.lit(None).cast("double"))
    timed = blocks.withColumn("_time", F.timestamp_micros("us")).withWatermark("_time", delay)
    # Without its time column no row is dropped for the watermark: the processor sees the late ones.
    out = timed.select("chain", "number", "us", "load").groupBy("chain").transformWithStateInPandas(Sequencer(Fold(phi, alpha, slow, s2, d2, warm_up)), OUT, "Append", "EventTime")
    # Arrow may carry a missing ratio as NaN, which would reach every threshold downstream.
    doubles = ("rho_ts", "rho_s", "rhythm", "rhythm_slow", "sigma")
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in out.columns])


def tick(spark: SparkSession, path: str, us: int, schema) -> None:
    """Add a row to the table at `path` that has a time and nothing else: read with the blocks, it moves the watermark on."""
    spark.createDataFrame([tuple(us if f.name == "us" else None for f in schema.fields)], schema).coalesce(1).write.mode("append").parquet(path)
