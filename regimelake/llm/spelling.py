"""Spelling variants (operator 12): words one edit apart, found by an even-partition pigeonhole join.

A word of length l is cut into two halves. One edit leaves one half whole, so a word of the same length has
that half in its place, and a word of one more letter has the first half in front or the second one shifted
by one. Words are posted under each half with its place; words that meet are candidates, verified in full.
A half that too many words share is not joined: as it is equal, the edit lies in the rest, and the same
argument cuts the rest again, down to single letters, where all that still meet are near. So a hot half is
spread over the halves of its rest, and no list of it is ever paired with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Pairs that one posting list makes at most before its words are posted under halves of the rest.
PAIRS = 2048

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the lower-cased runs of letters of whole texts, with an occasional letter lost.

    A run whose crc32 with its doc_id is a multiple of `every` loses the letter at that crc32 modulo its length.
    Null and empty texts have no runs, a null doc_id counts as empty; repeated rows count each. Runs of any
    length are words. An empty table gives an empty one. Counts are combined within map tasks before the shuffle.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("_run"))
    h = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = F.col("_h") % F.length("_run")
    word = F.when(F.col("_h") % every == 0, F.concat(F.substr("_run", F.lit(1), at.cast("int")), F.substr("_run", at.cast("int") + 2))).otherwise(F.col("_run"))
    return h.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _posted(regions: DataFrame) -> DataFrame:
    """Postings (word, more, lo, hi, key) of words whose edit lies within [lo, hi): one for each half of it that is left when the other is equal.

    `more` words are probes of one letter more than the words they look for, so what follows the rest is shifted by one.
    """
    mid = F.expr("lo + (hi - lo) div 2")
    halves = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    p = regions.withColumn("_half", halves).filter("_half.lo < _half.hi").select("word", "more", "_half.lo", "_half.hi")
    shift = F.col("more").cast("int")
    length = F.length("word") - shift
    return p.withColumn("key", F.xxhash64(length, "lo", "hi", F.substr("word", F.lit(1), F.col("lo")), F.substr("word", F.col("hi") + shift + 1)))


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, b) of all words one inserted, deleted or replaced code point apart, b as long as a or one longer; each pair once.

    words: distinct values of `word`; null and words of one letter or none are near nothing. Lists that make more than `pairs` pairs go on to the
    next level; each level is a table in the shared folder, and there are as many as halvings of the longest word at most.
    """
    w = words.filter("length(word) > 0").select("word", F.explode(F.array(F.lit(False), F.lit(True))).alias("more"))
    level = w.withColumn("lo", F.lit(0)).withColumn("hi", F.length("word") - F.col("more").cast("int")).filter("hi > 1")
    found, tables = None, []
    while True:
        posted = materialize(_posted(level))
        own, longer = F.expr("count_if(not more)"), F.expr("count_if(more)")
        made = own * (own - 1) / 2 + own * longer
        lists = posted.groupBy("key").agg(made.alias("made"), F.max(F.col("hi") - F.col("lo")).alias("rest")).filter("made > 0")
        met = materialize(posted.join(lists, "key").withColumn("hot", (F.col("made") > pairs) & (F.col("rest") > 1)).drop("made", "rest"))
        tables.append(met)
        discard(posted)
        light = met.filter("not hot").select("key", "word", "more")
        a, b = light.filter("not more").select("key", F.col("word").alias("a")), light.select("key", F.col("word").alias("b"), "more")
        near = a.join(b, "key").filter("(more or a < b) and levenshtein(a, b, 1) = 1").select("a", "b")
        found = near if found is None else found.unionByName(near)
        level = met.filter("hot").select("word", "more", "lo", "hi")
        if not level.limit(1).count():
            break
    out = materialize(found.distinct())
    for t in tables:
        discard(t)
    return out


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n).

    form: the near word of largest n, the smallest in code-point order among equal ones, if its n is `times`
    the word's at least; else null. root: where following forms ends, the word itself without one. As n grows
    `times`-fold with each step, roots are found in a few rounds of jumps. Words are distinct; an empty table gives an empty one.
    """
    words = materialize(words)
    near = near_words(words)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    # The least of (-n, word) is the largest n and, among equals, the smallest word.
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    up = -F.col("best.less") >= times * F.col("n")
    formed = materialize(words.join(best, "word", "left").select("word", F.when(up, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(up, -F.col("best.less")).alias("form_n")))
    roots = materialize(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(roots)
        roots = jumped.drop("moved")
        roots._shared_path = jumped._shared_path
        if not jumped.filter("moved").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with the word it is a variant of."""
    return spelling_groups(word_counts(table(spark, sf_dir, "documents")))
