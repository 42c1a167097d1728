"""The bridge watched by the clock: a silent bridge is an alarm without any new batch."""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

HOUR = 3_600_000_000

#: The log: from `at_us` on the bridge is in state `bs`; `seq` orders entries of one time.
OUT = "chain string, at_us long, seq long, bs string, last_us long, baseline double"


@dataclass
class Watch:
    """What is known of a bridge: the hour that is open and its gaps, the baseline of the hours before, the last batch, the state."""

    first: int = -1
    hour: int = -1
    total: float = 0.0
    gaps: int = 0
    e: float = math.nan
    last_us: int = -1
    last_gap: float = math.nan
    now: int = -1
    bs: str = ""
    seq: int = 0
    timer: int = -1


_STATE = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'string' if f.type == 'str' else 'long'}" for f in fields(Watch))


@dataclass(frozen=True)
class Clock:
    """The rules: an hour's mean gap (of those under `longest` minutes) moves the baseline by `alpha` when the hour ends, and
    a bridge whose last batch is older than `times` that baseline is BS2. Nothing is said in the first `warm_up` hours."""

    alpha: float = 0.1
    times: float = 2.0
    warm_up: int = 20
    longest: float = 60.0
    span: int = HOUR
    first: int | None = None

    def due(self, w: Watch) -> float:
        """The next time at which something changes without a batch, infinity for none."""
        out = math.inf
        if w.first >= 0 and not w.bs:
            out = (w.first + self.warm_up) * self.span
        if w.gaps:
            out = min(out, (w.hour + 1) * self.span)
        if w.bs == "BS1":
            out = min(out, max(self._alarm(w), w.now))
        return out

    def _alarm(self, w: Watch) -> float:
        return math.inf if math.isnan(w.e) or w.last_us < 0 else w.last_us + self.times * w.e * 6e7

    def advance(self, w: Watch, batches: list[int], now: int) -> list[tuple]:
        """Let the clock run to `now` over batches in order of time, all up to then; what it says are (at_us, seq, bs, last_us, baseline)."""
        said: list[tuple] = []
        for us in batches:
            if w.first < 0:
                w.first = us // self.span if self.first is None else self.first
                w.hour, w.now = w.first, w.first * self.span
            if us < w.last_us:
                continue
            self._run(w, us, said)
            self._batch(w, us)
            self._say(w, us, said)
        if w.first >= 0:
            self._run(w, now, said)
        return said

    def _run(self, w: Watch, until: int, said: list) -> None:
        while (at := self.due(w)) <= until:
            w.now = at = math.ceil(at)
            hour = at // self.span
            if hour > w.hour:
                mean = w.total / w.gaps if w.gaps else 0.0
                if mean:
                    w.e = mean if math.isnan(w.e) else self.alpha * mean + (1 - self.alpha) * w.e
                w.hour, w.total, w.gaps = hour, 0.0, 0
            alarm = w.bs == "BS1" and self._alarm(w) <= at
            self._say(w, at, said, alarm)
        w.now = max(w.now, until)
        if not w.gaps:
            w.hour = max(w.hour, until // self.span)

    def _say(self, w: Watch, at: int, said: list, alarm: bool = False) -> None:
        if at < (w.first + self.warm_up) * self.span:
            return
        bs = "BS2" if alarm or at > self._alarm(w) else "BS1"
        if bs != w.bs:
            w.bs, w.seq = bs, w.seq + 1
            said.append((at, w.seq, bs, w.last_us, None if math.isnan(w.e) else w.e))

    def _batch(self, w: Watch, us: int) -> None:
        """Batches of one time all show a gap of zero, the first of them too."""
        if us == w.last_us:
            counted = w.last_gap < self.longest  # not: NaN, the very first batch
            w.total -= w.last_gap if counted else 0.0
            w.gaps += 1 if counted else 2
            w.last_gap = 0.0
            return
        w.last_gap = math.nan if w.last_us < 0 else (us - w.last_us) / 6e7
        if w.last_gap < self.longest:
            w.total, w.gaps = w.total + w.last_gap, w.gaps + 1
        w.last_us = us


class Watcher(StatefulProcessor):
    """A watch for each chain, woken by the timer of its next change."""

    def __init__(self, clock: Clock, by_watermark: bool):
        self.clock, self.by_watermark = clock, by_watermark

    def init(self, handle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", _STATE)
        self.held = handle.getListState("held", "times binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        w = Watch(*(self.watch.get() or ()))
        times = np.sort(np.concatenate([p["us"].dropna().to_numpy(np.int64) for p in rows if p["us"].notna().any()] or [np.empty(0, np.int64)]))
        if not len(times) or key[0] is None:
            return
        if self.by_watermark:
            self.held.appendValue((times.tobytes(),))
            self._wake(w, int(times[0]))
            self.watch.update(astuple(w))
        else:
            now = max(timerValues.getCurrentProcessingTimeInMs() * 1000, int(times[-1]))
            yield from self._advance(key, w, times.tolist(), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        w = Watch(*(self.watch.get() or ()))
        w.timer = -1
        if not self.by_watermark:
            yield from self._advance(key, w, [], timerValues.getCurrentProcessingTimeInMs() * 1000)
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        times = np.sort(np.concatenate([np.frombuffer(bytes(x[0]), np.int64) for x in self.held.get()] or [np.empty(0, np.int64)]))
        ready, left = times[times <= now], times[times > now]
        self.held.clear()
        if len(left):
            self.held.appendValue((left.tobytes(),))
            self._wake(w, int(left[0]))
        yield from self._advance(key, w, ready.tolist(), now)

    def _advance(self, key, w: Watch, times: list, now: int):
        said = self.clock.advance(w, times, now)
        due = self.clock.due(w)
        if due < math.inf:
            self._wake(w, max(math.ceil(due), now + 1))
        self.watch.update(astuple(w))
        if said:
            out = pd.DataFrame(said, columns=["at_us", "seq", "bs", "last_us", "baseline"])
            out.insert(0, "chain", key[0])
            yield out

    def _wake(self, w: Watch, us: int) -> None:
        at = -(-us // 1000)
        if 0 <= w.timer <= at:
            return
        if w.timer >= 0:
            self.handle.deleteTimer(w.timer)
        self.handle.registerTimer(at)
        w.timer = at


def watch_bridges(batches: DataFrame, clock: Clock = Clock(), delay: str | None = None) -> DataFrame:
    """The log of bridge states of a stream of batches (chain, us): an entry where a chain's state changes.

    With `delay` time is what the batches tell: the watermark is the clock, batches up to `delay` behind may come in any
    order, and rows of time alone (chain null) let it run on. Without, the machine's clock runs: a timer raises BS2
    as soon as the last batch is too old, in a micro-batch without any row, and batches older than the last one are
    passed over. A chain's state is its open hour, a baseline and, with `delay`, the batches on hold. To be started within `state_store`.
    """
    rows = batches.select("chain", "us")
    if delay:
        rows = rows.withColumn("_time", F.timestamp_micros("us")).withWatermark("_time", delay).select("chain", "us")
    return rows.groupBy("chain").transformWithStateInPandas(Watcher(clock, delay is not None), OUT, "Append", "EventTime" if delay else "ProcessingTime")
