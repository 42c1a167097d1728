"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regimelake.llm import bpe, common, html_extraction, near_dedup, packing, sharding, substring_dedup, token_counts, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "a\tb\r\n\n c  ", "<|endoftext|> x<|endoftext|>", "Été ﬁ 12345 漢字 🙂🙂", "aaaa" * 700, "x  y\n z", "l'été's don't"]


def _words(rng, n):
    return " ".join(rng.choice(["the", "of", "tion", "hend", "Anor,", "er.", "êau", "zzz" + str(rng.randint(0, 40))]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [_words(rng, rng.choice([3, 60, 200])) for _ in range(40)]
    shared = _words(rng, 70)
    near = base[1].split()
    near[30 % len(near)] = "other"
    more = [base[0], base[0], shared + " " + base[2], base[3] + "\n" + shared, " ".join(near), _words(rng, 9000)]
    return ODD + base + more


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (5, texts[5], None, "s", None), (None, texts[20], None, None, None)], SCHEMA).withColumn("key", F.lit(1)).repartition(3)


def test_bpe(docs, texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.digest(docs, path, P.PATTERN).filter("doc_id is not null").collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_bpe_append_and_edit():
    e = bpe.PrefixEncoder(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    table = e.extend(b"theon", [])
    longer = e.extend(b"theonation", list(table))
    assert longer == e.extend(b"theonation", []) and e.reencode(b"theonation", longer, b"theoxx") == e.extend(b"theoxx", [])


def test_token_counts(docs, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids), r.text


def test_packing(docs, texts, spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = packing.packed_documents(docs, P.path("word_bpe_49k.json"), capacity=256).collect()
    bins = {}
    for r in out:
        if r.doc_id is not None:
            ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    n = np.array([r.length for r in out])
    assert packing.lower_bound(n, 256) <= len(bins) <= packing.best_fit_decreasing(n, 256).max() + 1
    many = spark.createDataFrame([(i, random.Random(i).randint(1, 100)) for i in range(500)], "id long, length long")
    small = packing.pack(many, capacity=100, per_partition=40)
    assert small.count() == 500 and small.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 100").count() == 0


def test_substring_dedup(docs, texts):
    w = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(texts)}
    first = {}
    for i in sorted(w):
        for p in range(len(w[i]) - 49):
            first.setdefault(tuple(w[i][p : p + 50]), i)
    whole, cuts = substring_dedup.repeated_spans(docs)
    out = whole.join(cuts, "key", "left").collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id is None:
            assert r.n_removed is None
            continue
        mine = w[r.doc_id]
        gone = [any(first[tuple(mine[p : p + 50])] < r.doc_id for p in range(max(0, k - 49), min(k, len(mine) - 50) + 1)) for k in range(len(mine))]
        assert (r.n_words, r.n_removed or 0) == (len(mine), sum(gone))
        if any(gone):
            assert r.kept == " ".join(x for x, g in zip(mine, gone, strict=True) if not g)
    assert substring_dedup.remove_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(docs, texts, size):
    sets = {}
    for i, t in enumerate(texts):
        x = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if len(x) >= size else {tuple(x)} if x else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = near_dedup.near_duplicates(docs, size).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))


def test_long_lists_and_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        x = list(base)
        x[rng.randrange(120)] = f"u{i}"
        rows.append((i, " ".join(x), None, None, None))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in out} == {0}


def test_sharding(spark, docs):
    d = docs.select("doc_id", F.lit(1).alias("size"))
    m = sharding.first_map(spark, 40)
    out = sharding.shard(d, m).collect()
    places = {}
    for r in out:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(out) == docs.count()
    grown = sharding.grow_map(m, 40).groupBy("shard").count().collect()
    assert len(grown) == 41 and max(r["count"] for r in grown) - min(r["count"] for r in grown) < 12
    uneven = spark.range(sharding.SLOTS).select(F.col("id").cast("int").alias("vslot"), (F.when(F.col("id") % 40 == 0, 50).otherwise(10)).alias("bytes"))
    better = sharding.rebalance_map(m, uneven, 40).join(uneven, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.max("b") / F.avg("b")).first()[0]
    assert better < 1.3


def test_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[7] = v[8] = v[9]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 16), (902, [0.0] * 16), (None, [1.0] * 16)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.filter("vec_id % 20 = 0")
    whole = np.vstack([np.floor(v.astype(float) * 64), np.zeros((1, 16))])
    ids = np.r_[np.arange(600), 902]
    got = {}
    for r in vectors.exact_top_k(e, q).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for i in range(0, 600, 20):
        s = whole @ whole[i]
        want = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        assert got[i] == {k + 1: (ids[j], int(s[j])) for k, j in enumerate(want)}
    hits, found = 0, vectors.nearest_neighbours(e, q).collect()
    for i in range(0, 600, 20):
        s = v.astype(float) @ v[i].astype(float)
        want = set([j for j in np.lexsort((np.arange(600), -s)) if j != i][:20])
        hits += len(want & {r.vec_id for r in found if r.query_id == i})
    assert hits >= 0.9 * 20 * 30 and not {r.vec_id for r in found} & {900, 901, 902}


def test_nearest_neighbours_of_small_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TARGET", 0.0)
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(size=(1000, 8)), 50 + rng.normal(size=(3, 8))]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = vectors.nearest_neighbours(e, e.filter("vec_id % 100 = 0")).groupBy("query_id").count().collect()
    assert len(found) == 11 and {r["count"] for r in found} == {20}


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    more = docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (None, "", None, None, None)], SCHEMA))
    out = toxicity.score(more, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(out) == docs.count() + 2 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) >= 0.8 * len(held)
    assert sum(r.predicted for r in held if r.toxic) >= 0.8 * sum(r.toxic for r in held)


def test_html(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</ul></nav>{0}<div class="ad">Buy</div><article><h1>A&amp;B</h1><p><b>one\n two<br><p>th&#114;ee<div class="comments">nice</div></article><footer>f</footer>'
    bare = "<body><div>Our site</div><div><p>{0}</p></div><div>All rights</div>"
    rows = [(1, "http://h/a", page.format("")), (2, "http://h/b", None), (3, None, "plain"), (4, "http://g/1", bare.format("alpha is here")), (5, "http://g/2", bare.format("beta is there"))]
    out = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "A&B\none two\nthree", 2: "", 3: "plain", 4: "alpha is here", 5: "beta is there"}
    joined = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=-1)
    assert {r.page_id: r.text for r in joined.collect()} == out


def test_toxicity_without_labels(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(["a clean text", "", None])], SCHEMA)
    for labels in ([], [(77, 1)], [(0, 0)]):
        d = str(tmp_path / "-".join(map(str, [n for x in labels for n in x])))
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, d).count() == 3


def test_toxicity_keeps_all_repeated_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EXPRESSIONS", 1, raising=False)
    t = spark.createDataFrame([("vile common", 1), ("vile kind common", 0), ("kind common", 0)], "text string, toxic int")
    model = toxicity.fit(t, t)
    words = toxicity._words(np.frombuffer(b"vilekind", np.uint8), np.array([0, 4, 8]))
    assert model.look_up(model.words, words.hash)[0].all()


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_html_wrapper_of_all_pages(spark, broadcast_bytes):
    bare = "<body><div class=l{0}>Site of layout {0}</div><p>{1}</p><div class=l{0}>End {0}</div>"
    art = "<article><p>{0}</p><p>Subscribe to our letter</p><p>{1}</p></article>"
    words = ["".join(random.Random(i).sample("abcdefghij", 8)) for i in range(60)]
    rows = [(i, "http://h/x", bare.format(i % 10, words[i] * 3)) for i in range(30)]
    rows += [(100 + i, "http://h/copy", bare.format(0, "copied")) for i in range(40)]
    rows += [(200 + i, "http://a/x", art.format(words[i] * 3, words[30 + i] * 3)) for i in range(6)]
    near = "<article><p>A passage that near copies share</p><p>{0}</p><p>Another passage of theirs</p></article>"
    rows += [(300 + i, "http://n/x", near.format(words[i])) for i in range(6)]
    out = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=broadcast_bytes).collect()}
    want = {i: words[i] * 3 for i in range(30)} | {100 + i: "copied" for i in range(40)}
    # What an article says on every page is the article's own.
    want |= {200 + i: f"{words[i] * 3}\nSubscribe to our letter\n{words[30 + i] * 3}" for i in range(6)}
    assert out == want | {300 + i: f"A passage that near copies share\n{words[i]}\nAnother passage of theirs" for i in range(6)}


def test_spread_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 7 <> 3").withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        got = common.spread_join(rows, keyed, ["k"], ["id"], how, per_task=100)
        assert sorted((r.id, r.k, r.v or 0) for r in got.collect()) == sorted((r.id, r.k, r.v or 0) for r in rows.join(keyed, "k", how).collect())


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(d).count() == 0
    assert substring_dedup.remove_repeats(d).count() == 0
    assert packing.packed_documents(d, P.path("word_bpe_49k.json")).count() == 0
    assert bpe.digest(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert toxicity.score(d, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.exact_top_k(e, e).count() == 0 and vectors.nearest_neighbours(e, e).count() == 0
    assert html_extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, d)
    assert out.select("doc_id").distinct().count() == kept.count() <= docs.count()
