"""Every registered query and pipeline stage on odd tables, and the operators' edges against brute force."""

import hashlib
import random
import re
import time
import zlib

import compare
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regimelake.llm import near_dedup, packing, queries, sharding, substring_dedup, token_counts, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG_RUN = "ab" * 50_000
ODD = [None, "", " \n\t", "x", LONG_RUN, "same text here " * 30, "same text here " * 30, "Ärger 漢字 🙂 don't", "a b c d e f g " * 2000]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empties, long runs, ties, repeated rows and columns that clash with the operators' own."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(ODD)] + [(6, ODD[6], None, "s", len(ODD[6])), (None, "nobody's text", None, None, None)]
    clash = {n: F.lit(f"mine-{n}") for n in ("_key", "_kept", "_g", "_bin", "_open", "key", "_part", "offset", "sequence_id", "_score", "_bucket")}
    docs = spark.createDataFrame(rows, DOCS).withColumns(clash)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(None, 1, 1), (77, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(20, [1.0] * 8), (20, [1.0] * 8), (61, [1.0] * 8), (62, None), (63, []), (64, [float("inf")] + [0.0] * 7), (65, [0.0] * 8), (None, [1.0] * 8), (66, [1.0] * 4), (67, [None] + [1.0] * 7)]
    spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("id", F.lit(3)).withColumn("v", F.lit("v")).write.parquet(f"{d}/embeddings.parquet")
    pages = [(i, f"http://h{i % 2}/x", f"<nav>m</nav><article><p>t{i}</article>") for i in range(5)] + [(5, None, None), (6, "", ""), (6, "", "")]
    turns = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "So."), (1, 1, "assistant", "So."), (2, None, None, None), (None, 3, "system", "x"), (3, 0, "user", LONG_RUN), (3, 0, "tool", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("code", F.lit("c")).withColumn("rows", F.lit("r")).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y")).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for n in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{odd}/{n}.parquet").limit(0).write.parquet(f"{d}/{n}.parquet")
    return d


#: The first columns of each query's result, with their types.
CONTRACT = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query_on_odd_and_empty_tables(spark, odd, empty, name):
    out = queries.QUERIES[name](spark, odd)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields]
    assert ", ".join(kinds).startswith(CONTRACT[name])
    rows = out.collect()
    if name not in ("op2_best_fit_packing", "op3_exact_top_k", "op6_nearest_neighbours", "op12_spelling_variants"):
        assert len(rows) == {"op10_html_extraction": 8, "op11_conversation_repair": 4}.get(name, len(ODD) + 2)
    else:
        assert rows or name == "op12_spelling_variants"
    assert queries.QUERIES[name](spark, empty).count() == 0
    by = {r[0]: r for r in rows}
    if name == "op1_byte_bpe":
        assert all(r.decoded_sha256 == hashlib.sha256((ODD[i] or "").encode()).hexdigest() for i, r in by.items() if i is not None)
    if name == "op2_best_fit_packing":
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False)) and sum(n for _, n in p) <= 4096 and min(p)[0] == 0 for p in places.values())
        assert by[0].length == by[1].length == 1 and len([r for r in rows if r.doc_id == 6]) == 2
    if name == "op4_substring_dedup":
        assert (by[5].n_removed, by[6].n_removed, by[6].kept_sha256, by[0].n_words) == (0, 90, hashlib.sha256(b"").hexdigest(), 0)
    if name == "op5_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    if name == "op10_html_extraction":
        assert {k: r.text for k, r in by.items()} == {**{i: f"t{i}" for i in range(5)}, 5: "", 6: ""}
    if name == "op12_spelling_variants":
        assert rows == []  # no word of five letters comes three times
    if name == "op13_quality":
        assert all(0 <= r.score <= 1 for r in rows) and by[0].score == by[1].score
    if name == "op7_token_counts":
        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        assert all(r.n_tokens == len(t.encode(ODD[i] or "", add_special_tokens=False).ids) for i, r in by.items() if i is not None)
    if name == "op8_minhash_near_dedup":
        assert (by[6].component_id, by[6].kept, by[0].n_shingles, by[3].n_shingles, by[4].n_shingles) == (5, False, 0, 1, 1)
    if name == "op9_sharding":
        places = {}
        for r in rows:
            places.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 40)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    if name in ("op3_exact_top_k", "op6_nearest_neighbours"):
        assert not {r.vec_id for r in rows} & {62, 63, 64, 67, None} and all(r.query_id != r.vec_id for r in rows)
        rng = np.random.default_rng(1)
        v = [(i, rng.normal(size=8)) for i in range(60)] + [(k, np.ones(8)) for k in (20, 20, 61)] + [(65, np.zeros(8))]
        v = [(i, np.floor(64 * x) if name.startswith("op3") else x) for i, x in v]
        q = next(x for i, x in v if i == 40)
        want = sorted(((-float(x @ q), i) for i, x in v if i != 40 and (name.startswith("op3") or x.any())))[:20]
        mine = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 40]
        if name.startswith("op3"):
            assert mine == [(i, int(-s)) for s, i in want]
        else:  # what is found is in order, with exact scores; ties come by the smaller id
            scores = {(i, round(-s, 9)) for s, i in sorted((-float(x @ q), i) for i, x in v)}
            assert len(mine) == 20 and all((i, round(s, 9)) in scores for i, s in mine) and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
            assert len({(i, round(s, 9)) for i, s in mine} & {(i, round(-s, 9)) for s, i in want}) >= 17


def _brute_groups(texts, size):
    """Components of documents by full Jaccard similarity of 0.8."""
    sets = {}
    for i, t in texts.items():
        x = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if len(x) >= size else {tuple(x)} if x else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _brute_repeats(texts, window=50):
    first, out = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, t in texts.items():
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t
    return out


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got, want = compare.same(queries.QUERIES[name](spark, sf), compare.duck(sf), queries.ORACLE_SQL[name])
    assert got == want


def test_pipeline_equals_brute_force(spark):
    """All stages over whole documents; the toxic ones that go are taken from the scores, all else is brute force."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = corpus_pipeline.STAGES[0][1](spark, docs, d)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    group = _brute_groups(texts, 5)
    left = _brute_repeats({i: t for i, t in texts.items() if group[i] == i})
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, x in left.items():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want[i, k] = (at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    out = corpus_pipeline.run(spark, d).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)


def test_pipeline_stages_keep_odd_columns(spark, odd, empty):
    import corpus_pipeline

    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema.simpleString() == docs.schema.simpleString()
            assert out.filter("_key <> 'mine-_key' or _g <> 'mine-_g' or offset <> 'mine-offset' or key <> 'mine-key'").count() == 0
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns[:2] == ["doc_id", "piece"]


def test_pack_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, 5, f"m{i}", 7) for i in range(40)], "id long, length long, _g string, _bin int")
    out = packing.pack(d, capacity=20, per_partition=10)
    assert {(r.id, r._g, r._bin) for r in out.collect()} == {(i, f"m{i}", 7) for i in range(40)} and 10 <= out.select("sequence_id").distinct().count() <= 13


def test_packing_ids_equal_the_library_and_pieces_are_encoded_once(monkeypatch):
    path = P.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(8)
    letters = [*"abtheinsrlTHEÀÉßüñÿ", *"'!?.,$*<|>-_0123456789", "'s", "'LL", "e\u0301", "\u0130", "\u03a3", "²", "×", "\u00aa", "字", "\t", "\x0b", "\x00", "\u00a0", "<|endoftext|>", "<|", "😀"]
    texts = [None, "", " ", "\n\n", "x" * 5000, *("".join(rng.choice([" ", "\n", "", "", ""]) + rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(3000))]
    assert packing.token_bytes(path, texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]

    given = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, batch, **options):
            given.extend(batch)
            return self.inner.encode_batch_fast(batch, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", Counting)
    packing._tokens.cache_clear()
    stems = ["".join(rng.choices("etaoinshr", k=9)) for _ in range(700)]
    shapes = [" ".join(f(w) for w in stems) for f in (str, str.title, str.upper, "{}.".format, "{},".format, "({})".format, "{}!!".format)]
    got = packing.token_bytes(path, shapes)
    packing._tokens.cache_clear()
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in shapes]
    assert sum(map(len, given)) < 1.2 * sum(map(len, stems))  # each shape as a word of its own would give 7 times as much


def test_equal_rows_spread_over_partitions(spark, monkeypatch):
    sizes = []
    real = packing._packer

    def packer(*args):
        run = real(*args)
        return lambda key, rows: run(key, rows).assign(offset=len(rows))

    monkeypatch.setattr(packing, "_packer", packer)
    out = packing.pack(spark.range(2000).select(F.lit(1).alias("length")), capacity=1, per_partition=200)
    sizes = [r.offset for r in out.select("offset").collect()]
    assert max(sizes) < 300 and len(sizes) == 2000


def test_one_long_run_of_letters():
    path = P.path("byte_bpe_50k.json")
    t, run = Tokenizer.from_file(path), "".join(random.Random(2).choices("etaoinshr", k=20_000))
    assert token_counts.count_texts(path, P.PATTERN, [run, "aa" * 1500, "x" + run]) == [len(t.encode(x, add_special_tokens=False).ids) for x in (run, "aa" * 1500, "x" + run)]
    began = time.time()
    token_counts.count_texts(path, P.PATTERN, [run * 50])
    assert time.time() - began < 60


def test_large_ids_and_scores_stay_exact(spark):
    big = (1 << 53) + 3
    e = spark.createDataFrame([(20 * (1 << 53), [1.0, 0.0]), (big, [2.0, 0.0]), (big + 2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = vectors.exact_top_k(e, e.filter("vec_id % 20 = 0")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(big, 8192), (big + 2, 4096)]
    x, y = float(1 << 27), float(1 << 24)
    e = spark.createDataFrame([(0, [y, 1.0]), (1, [y, 2.0]), (2, [y, 1.0])], "vec_id long, embedding array<double>")
    got = vectors.exact_top_k(e, e.filter("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, (1 << 60) + 8192), (2, (1 << 60) + 4096)]
    e = spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no long"):
        vectors.exact_top_k(e, e.filter("vec_id = 0")).collect()
    e = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*62"):
        vectors.exact_top_k(e, e.filter("vec_id = 0")).collect()


def test_top_k_of_many_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, size=(300, 4)) / 64
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.exact_top_k(e, e.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    w = np.floor(v * 64).astype(int)
    for i in range(0, 300, 20):
        s = w @ w[i]
        want = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:20]
        assert got[i] == {k + 1: (j, s[j]) for k, j in enumerate(want)}


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    v = np.floor(64 * rng.normal(size=(4000, 16)))
    q = v[:40] * np.where(rng.random((40, 16)) < 0.25, 1, 0)
    found = vectors.SortedLists(np.arange(4000), v).top(q, np.full(40, -1), 20)
    assert np.mean([share for _, _, _, share, _ in found]) < 1
    for i, ids, scores, _, _ in found:
        s = v @ q[i]
        assert scores.tolist() == np.sort(s)[::-1][:20].tolist() and set(ids) == set(np.lexsort((np.arange(4000), -s))[:20])


def test_neighbours_over_shards_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 8))
    v[100:140] = v[100]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(101, v[100].tolist())], "vec_id long, embedding array<double>")
    found = vectors.nearest_neighbours(e, e.filter("vec_id % 20 = 0")).collect()
    hits = 0
    for i in range(0, 500, 20):
        s = v @ v[i]
        mine = [r for r in found if r.query_id == i]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == list(range(1, 21))
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in mine)
        bar = np.sort(np.delete(s, i))[::-1][19]
        hits += sum(r.score >= bar - 1e-12 for r in mine)
    assert hits >= 0.9 * 20 * 25


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["near copies", "queries apart", "odd dimensions", "huge and tiny", "two lengths"])
def test_no_neighbour_is_missed_on_other_rows(spark, kind):
    rng = np.random.default_rng(6)
    n, dims = 2000, 13 if kind == "odd dimensions" else 24
    v = rng.normal(size=(n, dims))
    if kind in ("near copies", "queries apart"):
        tight = _unit(_unit(rng.normal(size=(4, dims)))[rng.integers(0, 4, n)] + 0.001 * v)
        v = tight if kind == "near copies" else np.where((np.arange(n) % 50 == 0)[:, None], _unit(v), tight)
    if kind == "huge and tiny":
        v *= 10.0 ** rng.integers(-200, 150, (n, 1))
    rows = [(i, x[: 10 if kind == "two lengths" and i % 3 else dims].tolist()) for i, x in enumerate(v)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in vectors.nearest_neighbours(e, e.filter("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for i in range(0, n, 50):
        others = [(-float((np.array(x) * rows[i][1]).sum()), j) for j, x in rows if j != i and len(x) == len(rows[i][1])]
        want = sorted(others)[:20]
        assert [found[i][k + 1][1] for k in range(20)] == pytest.approx([-s for s, _ in want], rel=1e-12)
        assert {found[i][k + 1][0] for k in range(20)} == {j for _, j in want}


def test_sharding_moves_only_into_the_new_shard_and_cuts_hot_slots(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit(20).alias("size"), F.lit("x").alias("_part")).repartition(6)
    path = str(tmp_path / "map")
    sharding.write_version(sharding.first_map(spark, 40), path)
    sharding.write_version(sharding.grow_map(sharding.read_version(spark, path), 40), path)
    assert sharding.read_version(spark, path).first().version == 2 and sharding.read_version(spark, path, 1).count() == sharding.SLOTS
    now, grown = (sharding.shard(docs, sharding.read_version(spark, path, v), per_task=100).collect() for v in (1, 2))
    for rows in (now, grown):
        places = {}
        for r in rows:
            places.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == 3000 and all(sorted(p) == list(range(len(p))) for p in places.values())
    before, after = ({r.doc_id: r.shard for r in rows} for rows in (now, grown))
    assert all(after[k] in (before[k], 40) for k in before) and 40 in after.values() and 40 not in before.values()
    assert sum(r.slot_bytes for r in {r.vslot: r for r in now}.values()) == 60_000
    sums = sharding.slot_sums(spark.createDataFrame(now, "doc_id long, size int, _part string, vslot int, slot_bytes long, shard int, slot long"))
    sharding.write_version(sharding.rebalance_map(sharding.read_version(spark, path), sums, 41), path)
    latest = sharding.read_version(spark, path)
    assert latest.first().version == 3 and latest.count() == sharding.SLOTS


def test_documents_that_share_an_id_keep_their_own_cuts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    d = spark.createDataFrame([(1, passage, "a"), (2, "one " + passage, "b"), (2, "two two " + passage, "c"), (None, passage, "d")], "doc_id long, text string, _key string")
    assert {(r._key, r.text) for r in substring_dedup.remove_repeats(d).collect()} == {("a", passage), ("b", "one"), ("c", "two two"), ("d", passage)}


def test_near_duplicates_of_odd_rows(spark):
    d = spark.createDataFrame([(3, "A b c d e f"), (3, "a B c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()), key=str) == sorted([(3, 1, False), (3, 1, False), (1, 1, True), (None, None, True), (9, 9, True), (8, 8, True)], key=str)


def _kneser_ney_by_hand(texts):
    """Log ratios of words seen twice, by the formulas, in plain Python: words discounted by class, backing off to the
    share of their stem's continuation probability, which is itself smoothed by the counts of both classes."""
    counts, stems = [{}, {}], {}
    for text, toxic in texts:
        for w in re.findall("[0-9a-z]+", text.lower()):
            counts[toxic][w] = counts[toxic].get(w, 0) + 1
    every = set(counts[0]) | set(counts[1])

    def discount(of):
        once, twice = of.count(1), of.count(2)
        return once / (once + 2 * twice) if once else 0.5

    for w in every:
        s = stems.setdefault(w[:5], [0, 0, 0])
        s[0] += counts[0].get(w, 0) > 0
        s[1] += counts[1].get(w, 0) > 0
        s[2] += counts[0].get(w, 0) + counts[1].get(w, 0)
    n = [sum(c.values()) for c in counts]
    d = discount([counts[0].get(w, 0) + counts[1].get(w, 0) for w in every])
    ns = [sum(s[c] for s in stems.values()) for c in (0, 1)]
    ts = [sum(s[c] > 0 for s in stems.values()) for c in (0, 1)]
    ds = discount([s[0] + s[1] for s in stems.values()])
    out = {}
    for w in every:
        both = counts[0].get(w, 0) + counts[1].get(w, 0)
        if both < 2:
            continue
        s = stems[w[:5]]
        p = []
        for c in (0, 1):
            shared = (s[0] + s[1]) / sum(ns)
            stem = max(s[c] - ds, 0) / ns[c] + ds * ts[c] / ns[c] * shared
            # A stem of one word has no row of its own: its words back off to the pooled counts.
            back = stem * both / s[2] if s[0] + s[1] > 1 else both / sum(n)
            p.append(max(counts[c].get(w, 0) - d, 0) / n[c] + d * len(counts[c]) / n[c] * back)
        out[w] = np.log(p[1]) - np.log(p[0])
    return out


def test_kneser_ney_equals_hand_counts(spark):
    from regimelake.llm import toxicity

    rng = random.Random(6)
    texts = [(" ".join(rng.choice(["vile", "vileness", "common", "commons", "kinder", "kind", "word" + str(rng.randint(0, 9))]) for _ in range(12)), i % 2) for i in range(30)]
    model = toxicity.fit(spark.createDataFrame(texts, "text string, toxic int"), spark.createDataFrame(texts, "text string, toxic int"))
    want = _kneser_ney_by_hand(texts)
    for w, ratio in want.items():
        words_ = toxicity._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
        found, got = model.look_up(model.words, words_.hash)
        assert found[0] and got[0] == pytest.approx(ratio), w
    assert len(want) == len(model.words[0])


def test_toxicity_scores_equal_plain_python(spark):
    """Scores of whole texts from the fitted ratios: means over words in plain Python, then the logistic weights."""
    from regimelake.llm import toxicity as T

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    texts = docs.join(labels, "doc_id").select(fold.alias("fold"), "text", "toxic")
    model = T.fit(texts.filter("fold > 1").select("text", "toxic"), texts.filter("fold = 1").select("text", "toxic"))
    known = [dict(zip(level[0].tolist(), level[1].tolist(), strict=True)) for level in (model.words, model.stems)]

    def plain(text):
        ratios = []
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or "")):
            x = T._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
            ratios.append(known[0].get(int(x.hash[0]), known[1].get(int(x.stem[0]), 0.0)))
        toxic, ordinary = sum(max(r - T.MILD, 0) for r in ratios), sum(min(r + T.MILD, 0) for r in ratios)
        n = max(len(ratios), 1)
        odds = np.dot(model.weights, [np.log(toxic / n / 0.05 + 0.1), ordinary / n, np.log1p(toxic), 1.0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    some = docs.orderBy("doc_id").limit(30).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Ärger 漢字 don't")], "doc_id long, text string"))
    got = T.score(docs.select("doc_id", "text").unionByName(some.filter("doc_id < 0")), labels).collect()
    want = {r.doc_id: plain(r.text) for r in some.collect()}
    assert len(want) == 33
    for r in got:
        if r.doc_id in want:
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == int(r.score >= 0.5)
