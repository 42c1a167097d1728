"""The rule ensemble against plain Python, on held-out rows and on odd tables."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from regimelake.llm import quality as Q

ODD = [None, "", " \n\t", "x", "ONE!! TWO!! | | 12,5 a_b #tag", "so so so\nso so\n\nso so", "Ärger 漢字 🙂 don't. Why? No!", "word " * 50_000]


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" ")]
    n, chars = len(words), len(t)

    def share(a, b):
        return a / b if b else 0.0

    def found(p):
        return len(re.findall(p, t))

    return [
        share(chars - found(r"[\x20\x09-\x0D]"), n), share(found("[A-ZÀ-ÖØ-Þ]"), chars), share(found(r"[#$%&*<>=_~^@+{}\[\]\\]"), n), share(found(r"\|"), n), share(found("!"), n), share(found("[0-9]"), chars),
        share(found("[.!?]"), n), share(found(","), n), share(len(lines), n), share(len(set(words)), n), share(sum(a == b for a, b in zip(words, words[1:])), n), share(len(set(lines)), len(lines)),
        share(sum(len(w) <= 3 for w in words), n), share(len(t.encode()) - chars, chars), math.log1p(n),
    ]


def plain_score(model, s):
    odds = model.base
    for rule, weight in model.rules:
        if all((low is None or s[at] > low) and (high is None or s[at] <= high) for at, low, high in rule.bounds):
            odds += weight
    return 1 / (1 + math.exp(-odds))


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    return Q.fit(docs, labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


def test_scores_equal_plain_python(spark, tables, model):
    texts = ODD + [r.text for r in tables[0].orderBy("doc_id").limit(60).collect()]
    d = spark.createDataFrame([(i, t, "mine", "mine") for i, t in enumerate(texts)], "doc_id long, text string, _s0 string, _words string")
    for r in Q.score(d, model).collect():
        assert r.score == pytest.approx(plain_score(model, plain_statistics(texts[r.doc_id])), abs=1e-9)
        assert (r._s0, r._words, r.predicted) == ("mine", "mine", int(r.score >= 0.5))


def test_rules_are_sparse_conjunctions(model):
    assert 3 <= len(model.rules) <= 120 and all(w for _, w in model.rules)
    assert all(1 <= len(r.bounds) <= Q.DEPTH and all(low is None or high is None or low < high for _, low, high in r.bounds) for r, _ in model.rules)
    assert len({r for r, _ in model.rules}) == len(model.rules) and any(s in str(model.rules[0][0]) for s in Q.STATISTICS)


def test_paths_of_a_tree():
    printed = """Forest
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 1 > 2.0)
      Predict: 0.0
     Else (feature 1 <= 2.0)
      Predict: 1.0
    Else (feature 3 > 0.5)
     If (feature 3 <= 0.75)
      Predict: 1.0
     Else (feature 3 > 0.75)
      Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    assert [r.bounds for r in Q.paths(printed)] == [((3, None, 0.5),), ((1, 2.0, None), (3, None, 0.5)), ((1, None, 2.0), (3, None, 0.5)), ((3, 0.5, None),), ((3, 0.5, 0.75),), ((3, 0.75, None),)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = Q.op13_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    low, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(low) > 150 and sum(r.predicted == 0 for r in low) >= 0.95 * len(low)
    assert len(good) > 900 and sum(r.predicted == 1 for r in good) >= 0.99 * len(good)


def test_labels_of_one_kind_none_and_empty_tables(spark, tables):
    docs, labels = tables
    for few, score in ((labels.limit(0), 0.5), (labels.filter("quality = 1").limit(8), 0.9)):
        m = Q.fit(docs, few)
        assert m.rules == () and Q.score(docs, m).select("score").distinct().first()[0] == pytest.approx(score)
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 2), (1, 1), (1, 1)], "doc_id long, quality int")
    assert Q.fit(docs, odd).base == pytest.approx(math.log(3))
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), labels)).count() == 0


def test_query_columns_and_held_out_rows(spark, tmp_path):
    spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, "nobody's", 0.5), (3, "x", 0.5)], "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (5, 1), (6, 0), (7, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.op13_quality(spark, str(tmp_path))
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(ODD) + 2
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
