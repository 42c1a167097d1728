"""Spelling variants against brute force over all pairs of words, hot segments included."""

import random
import re
import zlib

from pyspark.sql import functions as F

from regimelake.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def brute_counts(rows):
    out = {}
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            if len(w) >= 5:
                out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if n >= 3}


def brute_groups(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(((-counts[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if best[1] and -best[0] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def test_near_words_equal_all_pairs(spark):
    """Short words of few letters share every segment, so that lists are hot at all levels."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abÿ🙂", k=rng.randint(1, 9))) for _ in range(500)} | {"a" * n for n in range(1, 70)}
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if one_edit(a, b) and min(len(a), len(b)) > 1}
    for pairs in (S.PAIRS, 3, 0):
        got = [tuple(r) for r in S.near_words(spark.createDataFrame([(w,) for w in words], "word string"), pairs).collect()]
        assert len(got) == len(set(got)) and {tuple(sorted(p, key=lambda w: (len(w), w))) for p in got if min(map(len, p)) > 1} == want


def test_roots_of_long_chains(spark):
    counts = {"zzzzz" + "a" * k: 3 * 2**k for k in range(14)} | {"zzzzzb": 3, "yzzzz": 5, "lonely": 9}
    got = {tuple(r) for r in S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == brute_groups(counts)
    assert next(r[2] for r in got if r[0] == "zzzzz") == "zzzzz" + "a" * 13


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(8)
    base = ["".join(rng.choices("etaoÉn", k=rng.randint(4, 12))) for _ in range(40)]
    texts = [" ".join(rng.choice(base) if rng.random() < 0.8 else rng.choice(base)[1:] for _ in range(200)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5]), (30, None), (31, ""), (32, "x" * 100_000), (33, "1×2÷3 Straße STRASSE ÀÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÀ ààààà")]
    spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op12_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in out.collect()} == brute_groups(brute_counts(rows))
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op12_spelling_variants(spark, str(tmp_path / "none")).count() == 0


def test_no_list_meets_itself_in_full(spark):
    """2,000 words that share their first half and their last: the pairs that are verified stay in proportion."""
    rng = random.Random(1)
    words = list({"prefix" + "".join(rng.choices("abcdefghijkl", k=6)) for _ in range(2000)})
    w = spark.createDataFrame([(x,) for x in words], "word string")
    first = S._posted(w.select("word", F.lit(False).alias("more"), F.lit(0).alias("lo"), F.length("word").alias("hi")))
    assert first.groupBy("key").count().agg(F.max("count")).first()[0] == len(words)
    got = {frozenset(r) for r in S.near_words(w).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
