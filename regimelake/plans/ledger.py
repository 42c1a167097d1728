"""Baselines that go on: each run appends windows and leaves what the next one needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ema import ema, numbered
from ..functions.intervals import as_of
from ..operators.regimes import FAST, SLOW
from ..operators.windows import invariants
from ..sources.shared import discard, materialize

#: Baselines by name: the window's value and the factor.
BASELINES = {"e_rho": ("rho_ts", FAST), "slow_rho": ("rho_ts", SLOW), "e_sigma": ("rho_s", FAST)}


class Ledger:
    """Windows and baselines of chains as a table that grows, in versions under `path`.

    A version holds the windows that its run closed, the blocks of each chain's open window (fewer than `phi`) and one row a
    chain to go on from: the last block's number, the next window's number, the reset epoch and the baselines. A run
    reads these and its own blocks, never the windows or blocks before. A version counts from the moment its mark is
    written, last of all: a run that fails leaves none, and the next one writes the same version anew.
    """

    def __init__(self, spark: SparkSession, path: str, phi: int, baselines: dict[str, tuple[str, float]] = BASELINES):
        self.spark, self.path, self.phi, self.baselines = spark, path, phi, baselines

    def _place(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def version(self) -> int:
        """The latest whole version, 0 before the first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=0)

    def _read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self._place(kind, version))

    def windows(self) -> DataFrame:
        """All windows of whole versions."""
        return self.spark.read.parquet(*[self._place("windows", v) for v in range(1, self.version() + 1)])

    def carry(self, version: int | None = None) -> DataFrame:
        """What the next run goes on from, as a version left it."""
        return self._read("carry", self.version() if version is None else version)

    def append(self, blocks: DataFrame, resets: DataFrame | None = None) -> int:
        """Close the windows that `blocks` complete, carry the baselines on, and return the new version.

        blocks: (chain, number, us, gas_used, gas_limit, size, tx); numbers at or before a chain's last one are in the
        ledger already and are passed over, so a repeated run adds nothing; blocks without a number are left out. resets: the log (chain, at_us) of
        changes of the instrument; windows that start at or after one begin a new epoch with fresh baselines. A reset has to be in
        the log before the first window that it touches is closed.
        """
        was = self.version()
        kept = blocks.filter("number is not null").select("chain", "number", "us", "gas_used", "gas_limit", "size", "tx")
        if was:
            last = self.carry(was)
            new = kept.join(last.select("chain", "last_number"), "chain", "left").filter("last_number is null or number > last_number").drop("last_number")
            rows = self._read("open", was).unionByName(new).join(last.select("chain", "next_window"), "chain", "left").withColumn("next_window", F.coalesce("next_window", F.lit(0)))
        else:
            rows = kept.withColumn("next_window", F.lit(0).cast("long"))
        placed = materialize(numbered(rows, "chain", "number", F.expr("number div 65536")))
        sizes = placed.groupBy("chain").agg(F.expr(f"count(1) div {self.phi}").alias("closed"), F.max("number").alias("last_number"), F.first("next_window").alias("next_window"))
        closed = placed.join(sizes.select("chain", "closed"), "chain").withColumn("window_id", F.col("next_window") + F.expr(f"idx div {self.phi}"))
        whole = F.expr(f"idx div {self.phi}") < F.col("closed")
        windows = invariants(closed.filter(whole).drop("next_window", "closed", "idx"), self.phi)
        version = was + 1
        self._write(closed.filter(~whole).select(*kept.columns), "open", version)
        scored = self._scored(windows, was, resets)
        self._write(scored, "windows", version)
        ends = self._read("windows", version).groupBy("chain").agg(*[F.max_by(c, "window_id").alias(c) for c in ("epoch", *self.baselines)])
        if was:
            names = ("epoch", *self.baselines)
            older = self.carry(was).select("chain", F.struct("last_number", "next_window").alias("_at"), F.struct(*names).alias("_e"))
            ends = ends.select("chain", F.struct(*names).alias("_new"))
            both = older.join(ends, "chain", "full").join(sizes, "chain", "full")
            e = F.coalesce("_new", "_e")
            carry = both.select("chain", F.coalesce("last_number", "_at.last_number").alias("last_number"), (F.coalesce("next_window", "_at.next_window") + F.coalesce("closed", F.lit(0))).alias("next_window"), *[e[n].alias(n) for n in names])
        else:
            carry = sizes.join(ends, "chain", "left").select("chain", "last_number", (F.col("next_window") + F.col("closed")).alias("next_window"), "epoch", *self.baselines)
        self._write(carry, "carry", version)
        self._write(self.spark.range(1), "marks", version)
        discard(placed)
        return version

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(self._place(kind, version))

    def _scored(self, windows: DataFrame, was: int, resets: DataFrame | None) -> DataFrame:
        """New windows with their epoch and baselines; an epoch that goes on starts from the carried values."""
        if resets is None:
            w = windows.withColumn("epoch", F.lit(0).cast("long"))
        else:
            log = resets.withColumn("_epoch", F.row_number().over(Window.partitionBy("chain").orderBy("at_us")).cast("long"))  # a log of few entries a chain
            w = as_of(windows, log, {"epoch": F.col("_epoch")}, since="at_us").withColumn("epoch", F.coalesce("epoch", F.lit(0)))
        w = w.withColumn("_key", F.concat_ws("/", "chain", F.col("epoch").cast("string")))
        before = {n: f"_{n}" for n in self.baselines}
        if was:
            carried = self.carry(was).select("chain", "epoch", *[F.col(n).alias(f"_{n}") for n in self.baselines])
            w = w.join(carried, ["chain", "epoch"], "left")
        else:
            w = w.withColumns({c: F.lit(None).cast("double") for c in before.values()})
        w = numbered(materialize(w), "_key", "window_id", F.expr("window_id div 65536"), "_at")
        return ema(w, self.baselines, part="_key", order="_at", before=before).drop("_key", "_at", *before.values())
