"""Quality by a sparse ensemble of rules (operator 13).

Texts become a few statistics, which are Spark columns. Trees over the statistics of a bounded sample of
labelled texts give paths, each a conjunction of bounds; a logistic model with a lasso penalty over these
rules keeps few of them. What it keeps is compiled into one Spark column, so that scoring is a scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_names, materialize, table

#: Labelled rows that the ensemble is fitted on at most, those of the smallest hash of doc_id.
TRAINING_ROWS = 20_000

#: Trees, conditions of a rule at most, and the weight of the lasso penalty.
TREES, DEPTH, PENALTY = 30, 3, 0.002

#: Names of the statistics; `statistics` has them in this order.
STATISTICS = "word_length upper symbols pipes exclamations digits ends commas lines distinct_words repeated_words distinct_lines short_words beyond_ascii log_words".split()


def statistics(text, words, lines) -> list:
    """Columns of a text's statistics, from the text, its words and its lines; counts are shares of its words or characters, 0 for an empty text.

    repeated_words is the share of words equal to the one before; short_words of at most three characters.
    """
    n, chars = F.size(words), F.length(text)

    def share(count, of):
        return F.coalesce(F.try_divide(count.cast("double"), of), F.lit(0.0))

    def found(pattern):
        return F.regexp_count(text, F.lit(pattern))

    before = F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    after = F.slice(words, 2, F.greatest(n - 1, F.lit(0)))
    repeated = F.size(F.filter(F.zip_with(before, after, lambda a, b: a == b), lambda same: same))
    ascii_ = F.octet_length(text) - chars
    return [
        share(chars - found("[\\x20\\x09-\\x0D]"), n), share(found("[A-ZÀ-ÖØ-Þ]"), chars), share(found("[#$%&*<>=_~^@+{}\\[\\]\\\\]"), n), share(found("\\|"), n), share(found("!"), n), share(found("[0-9]"), chars),
        share(found("[.!?]"), n), share(found(","), n), share(F.size(lines), n), share(F.size(F.array_distinct(words)), n), share(repeated, n), share(F.size(F.array_distinct(lines)), F.size(lines)),
        share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n), share(ascii_, chars), F.log1p(n.cast("double")),
    ]


def with_statistics(docs: DataFrame, names: list[str]) -> DataFrame:
    """Add the statistics of `text` (null: empty) under `names`."""
    text, words, lines = free_names([*docs.columns, *names], "_text", "_words", "_lines")
    d = docs.withColumn(text, F.coalesce("text", F.lit("")))
    d = d.withColumn(words, F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return d.withColumns(dict(zip(names, statistics(F.col(text), F.col(words), F.col(lines)), strict=True))).drop(text, words, lines)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic by its place, over `low` (None: any) and up to `high`."""

    bounds: tuple[tuple[int, float | None, float | None], ...]

    def holds(self, columns: list) -> F.Column:
        out = F.lit(True)
        for at, low, high in self.bounds:
            out = out if low is None else out & (columns[at] > low)
            out = out if high is None else out & (columns[at] <= high)
        return out

    def __str__(self) -> str:
        return " and ".join(" ".join(filter(None, [low is not None and f"{low:.6g} <", STATISTICS[at], high is not None and f"<= {high:.6g}"])) for at, low, high in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights, and the log odds where none holds."""

    rules: tuple[tuple[Rule, float], ...]
    base: float

    def score(self, columns: list) -> F.Column:
        """The probability of label 1 as one Spark column over the statistics' columns."""
        odds = F.lit(self.base)
        for rule, weight in self.rules:
            odds = odds + F.when(rule.holds(columns), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


_STEP = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def paths(trees: str) -> list[Rule]:
    """The rules of all paths from a root to a node below it, in a forest's printed form; each rule once, bounds of one statistic merged."""
    found, way = {}, []
    for line in trees.splitlines():
        if line.lstrip().startswith("Tree "):
            way = []
        m = _STEP.match(line)
        if not m:
            continue
        depth = len(m[1])
        way = [w for w in way if w[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
        bounds = {}
        for _, at, sign, x in way:
            low, high = bounds.get(at, (None, None))
            bounds[at] = (low, x if high is None else min(high, x)) if sign == "<=" else (x if low is None else max(low, x), high)
        found[Rule(tuple((at, *b) for at, b in sorted(bounds.items())))] = None
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """An ensemble from the texts of at most `rows` labelled documents (label 0 or 1, doc_id not null).

    The sample is a written table in one order, so that fits are equal. Without both labels there is no rule, and the
    score of all is the smoothed share of label 1. Repeated rows count each; empty tables have no labelled row.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("label")).filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    names = [f"s{i}" for i in range(len(STATISTICS))]
    # The sample has `rows` ids at most, a bound that does not grow.
    known = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), names).drop("text")
    sample = materialize(materialize(known).coalesce(1).sortWithinPartitions("doc_id", "label", *names))
    ones, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
    if not 0 < ones < n:
        discard(sample)
        share = (ones + 1) / (n + 2)
        return Ensemble((), float(_log(share / (1 - share))))
    rows_ = sample.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.5, featureSubsetStrategy="onethird", maxBins=64, seed=13).fit(rows_)
    rules = paths(forest.toDebugString)
    columns = [F.col(c) for c in names]
    held = materialize(sample.select("label", array_to_vector(F.array(*[F.when(r.holds(columns), 1.0).otherwise(0.0) for r in rules])).alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(held)
    discard(sample)
    discard(held)
    kept = sorted(((r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w), key=lambda x: -abs(x[1]))
    return Ensemble(tuple(kept), float(lasso.intercept))


def _log(x: float) -> float:
    import math

    return math.log(x)


def score(docs: DataFrame, model: Ensemble, label: str = "quality") -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on); columns of these names are replaced.

    Only `text` matters; null counts as empty. Equal texts get equal scores. No shuffle and no Python: the model is a column.
    """
    names = free_names(docs.columns, *(f"_s{i}" for i in range(len(STATISTICS))))
    s = with_statistics(docs, names)
    out = s.withColumn("score", model.score([F.col(c) for c in names])).drop(*names)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; learnt from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = fit(docs, labels.filter(~held_out))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
