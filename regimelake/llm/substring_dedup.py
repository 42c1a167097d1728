"""Substring dedup by level-wise doubling (operator 4)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, free_names, likely, materialize, small_batches, spread_join, table, text_slices, window_hashes

#: What names a document: 64 bits of a hash alone would meet by chance in a large corpus.
ID = ["key", "doc_id"]

LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def levels(window: int) -> list[int]:
    """Lengths that end at `window`, each at most twice the one before; the first is about a quarter of it."""
    half = -(-window // 2)
    return [-(-half // 2), half, window]


def minimal_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` consecutive values the place of its smallest (rightmost of ties).

    Equal runs choose equal places, so each repeated run has one anchor that all its copies share.
    """
    if len(values) < span:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(values[::-1], span)
    return (len(values) - 1 - (np.argmin(views, 1) + np.arange(len(views))))[::-1]


def _slice(parts: list[np.ndarray], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, parts[0].dtype)]) if parts else np.zeros(0, np.int64), kind.value_type))


def _first_level(batches, window: int):
    """For each document its word count, the digest of all its words, and its anchors: sampled base windows."""
    base = levels(window)[0]
    for batch in batches:
        for rows, data, offsets in text_slices([batch], "text"):
            words = Words(data, offsets)
            raw = data.tobytes()
            grams = window_hashes(words.hash, base)
            count, digest, anchors, places = [], [], [], []
            for i in range(rows.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                count.append(b - a)
                digest.append(hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() if b > a else hashlib.sha256(b"").hexdigest())
                at = np.unique(minimal_places(grams[a : b - base + 1], window - base + 1)) if b - a >= window else np.zeros(0, np.int64)
                anchors.append(grams[a + at].view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "key": rows.column("key"), "doc_id": rows.column("doc_id"), "n_words": pa.array(count, pa.int64()),
                "whole_sha256": pa.array(digest, pa.string()), "anchors": _slice(anchors, LONGS), "places": _slice(places, INTS),
            })


def _next_level(batches, window: int, last: bool):
    """Windows whose base anchor survived, extended to twice its length.

    Below the full window they are again sampled to anchors; full windows all go on, each named by the
    hashes of its two halves.
    """
    base, half, _ = levels(window)
    shorter = half if last else base
    for batch in batches:
        for rows, data, offsets in text_slices([batch], "text"):
            words = Words(data, offsets)
            halves = window_hashes(words.hash, half)
            grams = halves if last else window_hashes(words.hash, base)
            first, second, places = [], [], []
            for i, hot in enumerate(rows.column("hot").to_pylist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                at = minimal_places(grams[a : b - shorter + 1], window - shorter + 1)
                ok = np.flatnonzero(np.isin(at, np.array(hot, np.int64)))
                if not last:
                    ok = np.unique(minimal_places(halves[a : b - half + 1], window - half + 1)[ok])
                first.append(halves[a + ok].view(np.int64))
                second.append((halves[a + ok + window - half] if last else halves[a + ok]).view(np.int64))
                places.append(ok.astype(np.int32))
            yield pa.RecordBatch.from_pydict({"key": rows.column("key"), "doc_id": rows.column("doc_id"), "first": _slice(first, LONGS), "second": _slice(second, LONGS), "places": _slice(places, INTS)})


def _spans(batches, window: int):
    """What is left of the documents that lose words."""
    for batch in batches:
        for rows, data, offsets in text_slices([batch], "text"):
            words = Words(data, offsets)
            raw = data.tobytes()
            kept_text, removed, spans = [], [], []
            for i, starts in enumerate(rows.column("starts").to_pylist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                gone = np.zeros(b - a + 1, np.int64)
                starts = np.array(starts, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.minimum(starts + window, b - a), -1)
                gone = np.cumsum(gone)[:-1] > 0
                own = raw[offsets[i] : offsets[i + 1]].split()
                kept_text.append(b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g]).decode())
                removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                spans.append(edge.astype(np.int32))
            yield pa.RecordBatch.from_pydict({"key": rows.column("key"), "doc_id": rows.column("doc_id"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept_text, pa.string()), "removed": _slice(spans, INTS)})


def _shared(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of which another document has the same names, with the smallest such doc_id."""
    least = rows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    return spread_join(rows, materialize(least.drop("most")), names, ["key"])


def repeated_spans(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): word counts and digests of all rows, and what the shortened ones keep.

    Documents: key, doc_id, n_words, whole_sha256. Cuts: key, n_removed, kept, removed (word numbers
    where removed runs begin and end, in turn). The key is a hash of doc_id and text, and with doc_id it names
    a document: rows that repeat both are one, and rows that share only the doc_id keep their own cuts; equal doc_ids never
    count as smaller. An empty table gives empty ones; long texts are whole, and are cut only into their words. Rows of null doc_id take no part and lose nothing; a null text has no words.

    Documents of equal words are one from the start: all but the smallest doc_id lose all their words
    if they have a full window, and only that one is searched. The levels: base windows (13 words of 50)
    are sampled where their hash is the smallest within a full window, so that equal windows sample
    equal anchors, and posted; only anchors of two documents survive. Full windows with such an anchor
    are extended to half windows (25), sampled in the same way, and where those are repeated to full
    windows, named by 128 bits. Each level is one aggregation with map-side combining and one join in
    which names of many documents are dealt over many tasks; only texts that may hold a shared anchor are shuffled.
    """
    d = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialize(d.mapInArrow(lambda it: _first_level(it, window), "key long, doc_id long, n_words long, whole_sha256 string, anchors array<long>, places array<int>"))
    long_ = first.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    copies = materialize(_shared(long_.select("key", "doc_id", "n_words", "whole_sha256"), ["whole_sha256"]).filter("least < doc_id").select(*ID, F.col("n_words").alias("n_removed")).distinct())
    single = long_.select(*ID, "anchors", "places").join(copies.select(*ID), ID, "left_anti")
    anchors = single.select("key", "doc_id", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("key", "doc_id", F.col("x.anchors").alias("hash"), F.col("x.places").alias("place"))
    hot = materialize(_shared(materialize(anchors), ["hash"]).groupBy(*ID).agg(F.collect_set("place").alias("hot")))
    some = materialize(likely(d, hot, "key").join(hot, ID))
    level = materialize(_windows(some, window, False))
    hot = _shared(level, ["first"]).groupBy(*ID).agg(F.collect_set("place").alias("hot"))
    some = some.drop("hot")
    full = materialize(_windows(some.join(hot, ID), window, True))
    starts = _shared(full, ["first", "second"]).filter("least < doc_id").groupBy(*ID).agg(F.collect_set("place").alias("starts"))
    cuts = some.select(*ID, "text").join(starts, ID).mapInArrow(lambda it: _spans(it, window), "key long, doc_id long, n_removed long, kept string, removed array<int>")
    whole = copies.select(*ID, "n_removed", F.lit("").alias("kept"), F.array(F.lit(0), F.col("n_removed").cast("int")).alias("removed"))
    return first.select("key", "doc_id", "n_words", "whole_sha256"), materialize(cuts.dropDuplicates(ID).unionByName(whole))


def _windows(texts: DataFrame, window: int, last: bool) -> DataFrame:
    rows = texts.select("key", "doc_id", "text", "hot").mapInArrow(lambda it: _next_level(it, window, last), "key long, doc_id long, first array<long>, second array<long>, places array<int>")
    x = rows.select("key", "doc_id", F.explode(F.arrays_zip("first", "second", "places")).alias("x"))
    return x.select("key", "doc_id", F.col("x.first").alias("first"), F.col("x.places").alias("place"), *([F.col("x.second").alias("second")] if last else []))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """`docs` with its texts shortened: repeated windows go, the words that stay are joined by one space.

    Texts that lose nothing stay as they are, byte for byte; all other columns pass unchanged, whatever their
    names. Rows of null doc_id and null or empty texts lose nothing; an empty table gives an empty one.
    """
    _, cuts = repeated_spans(docs, window)
    key, kept, own = free_names(docs.columns, "_key", "_kept", "_own")
    cuts = cuts.select(F.col("key").alias(key), F.col("doc_id").alias(own), F.col("kept").alias(kept))
    out = docs.withColumn(key, F.xxhash64("doc_id", "text")).withColumn(own, F.col("doc_id").cast("long")).join(cuts, [key, own], "left")
    return out.withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str, window: int = 50) -> DataFrame:
    """What every document keeps when windows that a smaller doc_id has too are removed."""
    small_batches(spark)
    whole, cuts = repeated_spans(table(spark, sf_dir, "documents"), window)
    out = whole.join(cuts.select(*ID, "n_removed", F.sha2("kept", 256).alias("sha")), ID, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole_sha256").alias("kept_sha256"))
