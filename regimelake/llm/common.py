"""Helpers shared by the operators: shared tables, Arrow slices, word and window hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

#: Bytes of text that one vectorised step holds at most, unless a single row is longer.
SLICE_BYTES = 1 << 18

#: Bytes between words: space, tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of letters and digits, and all beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: A-Z to a-z, all other bytes unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names for temporary columns, each with as many underscores in front as keep it from any column's name."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Rows of one Arrow batch: texts are long, so that few rows bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_slices(batches, column: str, limit: int = SLICE_BYTES):
    """Yield (rows, bytes, offsets) with at most `limit` bytes of `column`, or one row; null counts as empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def parts_of(batch, column: str, limit: int = SLICE_BYTES):
    """Slices of a batch with at most `limit` bytes of `column`, or one row."""
    for rows, _, _ in text_slices([batch], column, limit):
        yield rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, key: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))


_BYTES = seeds(256, 17)
_BASE = np.uint64(0xD1342543DE82EF95)


@functools.lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(max(10, int(n).bit_length()), base)[:n]


class Words:
    """The words of some texts: byte positions, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False, stem: int = 0):
        """letters: only ASCII letters, digits and bytes beyond ASCII make words. stem: hash so many first bytes as well."""
        data = _LOWER[data] if lower else data
        inside = _LETTER[data] if letters else ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        size = self.end - self.start
        #: Text i has the words first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        if len(size):
            where = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(where, size)
            value = _BYTES[data[inside]] * powers(int(size.max()), int(_BASE))[at]
            self.hash = mix(np.add.reduceat(value, where) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            self.stem = mix(np.add.reduceat(np.where(at < stem, value, np.uint64(0)), where) + np.uint64(stem)) if stem else None
        else:
            self.hash = self.stem = np.zeros(0, np.uint64)


def window_hashes(values: np.ndarray, size: int, key: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` consecutive values; callers drop the runs that cross texts."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    base = int(seeds(1, 1000 + key)[0] | np.uint64(1))
    inverse = pow(base, -1, 1 << 64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(key)) * powers(len(values), base))])
    return mix((total[size:] - total[:-size]) * powers(len(values) - size + 1, inverse) + np.uint64(size))


def group_of(parts, *columns):
    """A group number below `parts` for each row, from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts))


def likely(rows: DataFrame, keys: DataFrame, column: str, buckets: int = 1 << 20) -> DataFrame:
    """Rows whose `column` may be among `keys`, before an exact join shuffles them: a filter of `buckets` hash buckets.

    Broadcasts half as many numbers at most, whatever the keys. Where these fill more buckets, the filter is
    not worth its cost and all rows pass. `keys` is read twice: pass a written table.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    there = keys.select(bucket.alias("_bucket")).distinct()
    if there.count() > buckets // 2:
        return rows
    return rows.withColumn("_bucket", bucket).join(F.broadcast(there), "_bucket", "left_semi").drop("_bucket")


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], spread: list[str], how: str = "inner", per_task: int = 1 << 14, buckets: int = 1 << 20) -> DataFrame:
    """`rows` joined with `keyed` (one row for each key, `n` rows of the key), hot keys dealt over many tasks.

    Keys fall into hash buckets; a bucket of more than `per_task` rows, or four times the mean where that
    is more, is cut into salts: its rows take one by a hash of `spread`, its keys are repeated for each. At
    most a quarter of the buckets are hot, so what is broadcast has at most buckets / 4 rows of two numbers.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(buckets)).cast("int")
    loads = materialize(keyed.groupBy(bucket.alias("_bucket")).agg(F.sum("n").alias("load")))
    limit = max(per_task, 4 * (loads.agg(F.sum("load")).first()[0] or 0) // buckets)
    hot = F.broadcast(loads.filter(F.col("load") > limit).select("_bucket", F.ceil(F.col("load") / limit).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.withColumn("_bucket", bucket).join(hot, "_bucket", "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_bucket", "_salts")
    right = keyed.drop("n").withColumn("_bucket", bucket).join(hot, "_bucket", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_bucket", "_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every end of an edge; the component is its smallest id.

    Labels spread along the edges and jump to their label's own label in each round, so the number of
    rounds follows the logarithm of the longest path. Every round is a table in the shared folder, removed
    after the next; only a count of changes reaches the driver.
    """
    both = materialize(edges.select(F.col(a).alias("s"), F.col(b).alias("t")).unionByName(edges.select(F.col(b).alias("s"), F.col(a).alias("t"))).distinct())
    labels = materialize(both.groupBy("s").agg(F.least(F.first("s"), F.min("t")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("s").alias("t"), F.col("l").alias("m")), "t").groupBy("s").agg(F.min("m").alias("m"))
        spread = materialize(labels.join(near, "s").select("s", F.col("l").alias("was"), F.least("l", "m").alias("l")))
        jump = spread.select(F.col("s").alias("l"), F.col("l").alias("m"))
        jumped = materialize(spread.join(jump, "l").select("s", "was", F.least("l", "m").alias("l")))
        # Each round's tables are whole in the next one's.
        discard(labels)
        discard(spread)
        labels = jumped
        if not labels.filter("was <> l").limit(1).count():
            discard(both)
            return labels.select(F.col("s").alias("id"), F.col("l").alias("component"))
