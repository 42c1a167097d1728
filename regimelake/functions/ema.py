"""Exponential baselines over long ordered series, in chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Rows of a chain that one task folds; chains of any length are cut into such chunks.
CHUNK = 4096


def affine(values: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) after each value: e = A * (e before the first) + B, where e = alpha * x + (1 - alpha) * e; NaN holds e.

    Maps of one value are composed by doubling, so that a chunk takes a logarithm of its length in array steps.
    """
    there = ~np.isnan(values)
    a, b = np.where(there, 1 - alpha, 1.0), np.where(there, alpha * np.nan_to_num(values), 0.0)
    step = 1
    while step < len(values):
        b = np.r_[b[:step], a[step:] * b[:-step] + b[step:]]
        a = np.r_[a[:step], a[step:] * a[:-step]]
        step *= 2
    return a, b


def ema(rows: DataFrame, specs: dict[str, tuple[str, float]], part: str = "chain", order: str = "idx", first: float | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """Add for each output name of `specs` the EMA of (column, alpha): e = alpha * x + (1 - alpha) * e before.

    It starts at the first value; null values hold it. `first` stands in for a null first value. `order`
    numbers a chain's rows from 0. An EMA is a chain of affine maps, so each chunk is folded alone into
    (A, B) per row, the chunks' last maps are chained (one row a chunk), and e = A * carry + B. The folded
    rows are written once to the shared folder, as both of these read them. `before` names, for outputs, columns
    with the baseline that a chain's rows go on from, the same in all its rows; null: none.
    """
    names = list(specs)
    chunk = F.expr(f"{order} div {CHUNK}")
    added = ", ".join(f"_a{i} double, _b{i} double" for i in range(len(names)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", _chunk long, {added}"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        for i, name in enumerate(names):
            column, alpha = specs[name]
            pdf[f"_a{i}"], pdf[f"_b{i}"] = affine(pdf[column].to_numpy(np.float64, na_value=np.nan), alpha)
        return pdf

    folded = materialize(rows.withColumn("_chunk", chunk).groupBy(part, "_chunk").applyInPandas(fold, schema))
    start = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_x{i}") if first is None else F.coalesce(F.min_by(c, order), F.lit(first)).alias(f"_x{i}") for i, (c, _) in enumerate(specs.values())]
    going = [F.col(before[n]) if before and n in before else F.lit(None).cast("double") for n in names]
    start = [F.coalesce(F.max(g), s).alias(f"_x{i}") for i, (g, s) in enumerate(zip(going, start, strict=True))] if before else start
    last = [F.max_by(f"_{k}{i}", order).alias(f"_{k}{i}") for i in range(len(names)) for k in "ab"]
    ends = folded.groupBy(part, "_chunk").agg(*last, *start)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        for i in range(len(names)):
            known = pdf[f"_x{i}"].dropna()
            e, out = (float(known.iloc[0]) if first is None else float(pdf[f"_x{i}"].iloc[0])) if len(known) else np.nan, []
            for a, b in zip(pdf[f"_a{i}"], pdf[f"_b{i}"], strict=True):
                out.append(e)
                e = a * e + b
            pdf[f"_c{i}"] = out
        return pdf[[part, "_chunk", *(f"_c{i}" for i in range(len(names)))]]

    kind = rows.schema[part].dataType.simpleString()
    carried = ends.groupBy(part).applyInPandas(carry, f"`{part}` {kind}, _chunk long, " + ", ".join(f"_c{i} double" for i in range(len(names))))
    out = folded.join(carried, [part, "_chunk"])
    # Before the first value there is no baseline, unless `first` stands in for it.
    value = [F.when(F.lit(first is not None) | (F.col(f"_a{i}") < 1) | (F.col("_chunk") > 0) | going[i].isNotNull(), F.nanvl(F.col(f"_a{i}") * F.col(f"_c{i}") + F.col(f"_b{i}"), F.lit(None).cast("double"))).alias(n) for i, n in enumerate(names)]
    return out.select(*rows.columns, *value)


def lagged(baseline: str, part: str = "chain", order: str = "idx"):
    """The baseline before the current row entered it; rows are hours or fewer, one small partition a chain."""
    return F.lag(baseline).over(Window.partitionBy(part).orderBy(order))


def numbered(rows: DataFrame, part: str, key: str, bucket, name: str = "idx") -> DataFrame:
    """Add `name`, a chain's row number from 0 by `key`, without sorting a whole chain in one task.

    `bucket` is an expression that never falls as the key grows. Rows are numbered within their bucket;
    what lies before comes from the buckets' counts, one row a bucket.
    """
    r = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = r.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(part, "_bucket").orderBy(key))
    return r.withColumn("_inside", inside).join(counts, [part, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_before", "_inside")


def last_before(rows: DataFrame, others: DataFrame, bucket: int, name: str = "last_us") -> DataFrame:
    """As-of join: add `name`, the latest `us` of `others` strictly before the row's `us` on its chain; null without any.

    Rows meet others within buckets of `bucket` microseconds; what lies in earlier buckets is their
    latest time, one row a bucket, carried on. So no task sorts a chain.
    """
    at = F.expr(f"us div {bucket}")
    latest = others.groupBy("chain", at.alias("_bucket")).agg(F.max("us").alias("_latest"))
    both = rows.withColumn("_kind", F.lit(0)).unionByName(others.select("chain", "us", F.lit(1).alias("_kind")), allowMissingColumns=True).withColumn("_bucket", at)
    # Rows come before others of the same time, which are not strictly before them.
    inside = Window.partitionBy("chain", "_bucket").orderBy("us", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("_in", F.last(F.when(F.col("_kind") == 1, F.col("us")), ignorenulls=True).over(inside)).filter("_kind = 0")
    buckets = met.select("chain", "_bucket").unionByName(latest.select("chain", "_bucket")).distinct().join(latest, ["chain", "_bucket"], "left")
    carried = buckets.select("chain", "_bucket", F.last("_latest", ignorenulls=True).over(Window.partitionBy("chain").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return met.join(carried, ["chain", "_bucket"], "left").select(*rows.columns, F.coalesce("_in", "_carried").alias(name))
