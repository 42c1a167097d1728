"""Toxicity by class-conditional Kneser-Ney models (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, free_names, small_batches, table, text_slices

#: Labelled rows that the models are fitted on at most, those of the smallest hash of doc_id.
TRAINING_ROWS = 20_000

#: First bytes of a word that make its stem, the level that rare words back off to.
STEM = 5

#: Without rows to weigh evidence by, one text in so many counts as toxic.
PRIOR = 10

#: Leanings of up to so many nats are a difference of topic or language, not of toxicity.
MILD = 1.0


def _words(data, offsets) -> Words:
    return Words(data, offsets, lower=True, letters=True, stem=STEM)


def _count(batches):
    """(word, stem, toxic, ordinary) sums of each slice of texts."""
    for batch in batches:
        for rows, data, offsets in text_slices([batch], "text"):
            words = _words(data, offsets)
            toxic = np.repeat(np.array(rows.column("toxic").to_pylist(), np.int64), np.diff(words.first))
            if len(words.hash):
                word, first, at = np.unique(words.hash, return_index=True, return_inverse=True)
                n1 = np.bincount(at, toxic, len(word)).astype(np.int64)
                n0 = np.bincount(at, 1 - toxic, len(word)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"word": word.view(np.int64), "stem": words.stem[first].view(np.int64), "toxic": n1, "ordinary": n0})


class Model:
    """Log-likelihood ratios of expressions, toxic to ordinary, in sorted arrays."""

    def __init__(self, words: tuple, stems: tuple):
        self.words, self.stems = words, stems
        self.weights = np.zeros(4)

    @staticmethod
    def look_up(level, keys):
        known, ratio = level
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        return found, np.where(found, ratio[at] if len(known) else 0.0, 0.0)

    def features(self, data, offsets) -> np.ndarray:
        """Evidence of each text: the length-normalised toxic part on a log scale, the ordinary part, and how much toxic evidence the mean rests on."""
        words = _words(data, offsets)
        found, ratio = self.look_up(self.words, words.hash)
        ratio = np.where(found, ratio, self.look_up(self.stems, words.stem)[1] if len(words.hash) else 0.0)
        n = np.diff(words.first)
        total = np.vstack([np.zeros((1, 2)), np.cumsum(np.c_[np.maximum(ratio - MILD, 0), np.minimum(ratio + MILD, 0)], axis=0)])
        whole = total[words.first[1:]] - total[words.first[:-1]]
        mean = whole / np.maximum(n, 1)[:, None]
        return np.c_[np.log(np.maximum(mean[:, 0], 0) / 0.05 + 0.1), mean[:, 1], np.log1p(np.maximum(whole[:, 0], 0)), np.ones(len(n))]

    def scores(self, data, offsets) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, offsets) @ self.weights, -30, 30)))


def _kneser_ney(toxic, ordinary, sums, backoff):
    """Log ratio of interpolated Kneser-Ney probabilities; sums: per class tokens and types, and the discount.

    Each class discounts its counts and gives the discounted mass to `backoff` (its toxic and ordinary
    probabilities), which rests on counts of both classes.
    """
    (n1, t1), (n0, t0), d = sums
    p1 = np.maximum(toxic - d, 0) / max(n1, 1) + d * max(t1, 1) / max(n1, 1) * backoff[0]
    p0 = np.maximum(ordinary - d, 0) / max(n0, 1) + d * max(t0, 1) / max(n0, 1) * backoff[1]
    return np.log(p1) - np.log(p0)


def _level(counts: DataFrame, key: str):
    """Class sums over all expressions, and the rows of the model: those seen twice at least."""
    one, both = F.count_if((F.col("toxic") + F.col("ordinary")) == 1), F.count_if((F.col("toxic") + F.col("ordinary")) == 2)
    s = counts.agg(F.sum("toxic"), F.count_if(F.col("toxic") > 0), F.sum("ordinary"), F.count_if(F.col("ordinary") > 0), one, both).first()
    s = [x or 0 for x in s]
    sums = ((s[0], s[1]), (s[2], s[3]), s[4] / (s[4] + 2 * s[5]) if s[4] else 0.5)
    return sums, counts.filter("toxic + ordinary > 1").orderBy(key).toPandas()


def fit(labelled: DataFrame, spare: DataFrame) -> Model:
    """Models of the labelled texts (text, toxic), and the weights of their evidence from the `spare` ones.

    Words are counted by class; the stem level counts in how many different words of a class a stem
    occurs (continuation counts) and is itself smoothed by the counts that the classes share. So a rare
    word is judged by its stem, and an unknown stem not at all. Without labels of both classes every
    text scores the share of label 1 among the spare rows, smoothed by one row that is toxic to 1 / PRIOR;
    so it scores under 0.5 where there is none.
    """
    counted = labelled.mapInArrow(_count, "word long, stem long, toxic long, ordinary long")
    counts = counted.groupBy("word", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).persist()
    (sums, words) = _level(counts, "word")
    stems = counts.groupBy("stem").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary"), F.sum(F.col("toxic") + F.col("ordinary")).alias("all"))
    (stem_sums, stem_rows) = _level(stems, "stem")
    counts.unpersist()
    t, o = (stem_rows[c].to_numpy(np.float64) for c in ("toxic", "ordinary"))
    (n1, t1), (n0, t0), d = stem_sums
    shared = (t + o) / max(n1 + n0, 1)
    stem_ratio = _kneser_ney(t, o, stem_sums, (shared, shared)) if len(t) else t
    order = np.argsort(stem_rows["stem"].to_numpy(np.int64).view(np.uint64))
    stem_key = stem_rows["stem"].to_numpy(np.int64).view(np.uint64)[order]
    p1 = (np.maximum(t - d, 0) / max(n1, 1) + d * max(t1, 1) / max(n1, 1) * shared)[order]
    p0 = (np.maximum(o - d, 0) / max(n0, 1) + d * max(t0, 1) / max(n0, 1) * shared)[order]
    stem_all = stem_rows["all"].to_numpy(np.float64)[order]
    key = words["word"].to_numpy(np.int64).view(np.uint64)
    wt, wo = (words[c].to_numpy(np.float64) for c in ("toxic", "ordinary"))
    of = words["stem"].to_numpy(np.int64).view(np.uint64)
    at = np.minimum(np.searchsorted(stem_key, of), max(len(stem_key) - 1, 0))
    known = stem_key[at] == of if len(stem_key) else np.zeros(len(of), bool)
    pooled = (wt + wo) / max(sums[0][0] + sums[1][0], 1)
    share = np.where(known, (wt + wo) / np.maximum(stem_all[at] if len(stem_key) else 1.0, 1), 0)
    backoff = tuple(np.where(known, p[at] * share, pooled) if len(stem_key) else pooled for p in (p1, p0))
    ratio = _kneser_ney(wt, wo, sums, backoff) if len(wt) else wt
    order_w = np.argsort(key)
    model = Model((key[order_w], ratio[order_w]), (stem_key, stem_ratio[order] if len(order) else stem_ratio))
    model.weights = _weights(model, spare)
    return model


def _weights(model: Model, spare: DataFrame) -> np.ndarray:
    """Logistic weights of the evidence, by Newton's method with a small ridge."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices([batch], "text"):
                f = model.features(data, offsets)
                yield pa.RecordBatch.from_pydict({"a": f[:, 0], "b": f[:, 1], "c": f[:, 2], "toxic": rows.column("toxic").cast(pa.int64())})

    seen = spare.mapInArrow(run, "a double, b double, c double, toxic long").toPandas()
    x, y = np.c_[seen[["a", "b", "c"]].to_numpy(np.float64), np.ones(len(seen))], seen["toxic"].to_numpy(np.float64)
    w = np.zeros(4)
    if not len(y) or y.min() == y.max():
        # A prior of one toxic row in PRIOR: without evidence a text is not toxic.
        w[3] = np.log((y.sum() + 1 / PRIOR) / (len(y) - y.sum() + 1 - 1 / PRIOR))
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(4)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-4 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with score (0 to 1), held_out and predicted added; other columns pass, those names are replaced.

    Labels are learnt from rows with crc32(doc_id) mod 5 not 0: remainders 2 to 4 fit the models, 1 fits
    their weights, TRAINING_ROWS in all at most. Null or empty texts have no evidence and score by the
    base rate; null labels and labels without a document are ignored; repeated rows are each scored. A
    null doc_id is not held out and never learnt from. An empty table gives an empty one; long texts are whole. Scoring is one narrow pass with the fitted
    arrays, two numbers a word or stem of the TRAINING_ROWS texts, in the closure. As the evidence is a mean over a text's
    words, a short toxic passage within a long clean text weighs little: score its parts to find it.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    sample = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(fold.alias("fold"), "text", "toxic")
    model = fit(texts.filter("fold > 1").select("text", "toxic"), texts.filter("fold = 1").select("text", "toxic"))
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    own = free_names([*names, "held_out", "score", "predicted"], "_score")[0]
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices([batch], "text"):
                yield pa.RecordBatch.from_pydict({n: rows.column(n) for n in names} | {own: model.scores(data, offsets)})

    out = docs.select(names).mapInArrow(run, StructType([docs.schema[n] for n in names] + [StructField(own, DoubleType())]))
    return out.select(*names, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(own).alias("score"), (F.col(own) >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    small_batches(spark)
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
