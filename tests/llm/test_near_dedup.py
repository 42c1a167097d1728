"""Collisions merged along lists, and large groups that no one member links, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimelake.llm import near_dedup


def _components(n, links):
    parent = {i: i for i in range(n)}
    near_dedup._grow(parent, links)
    return [near_dedup._root(parent, i) for i in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_merging_with_skips_finds_the_components_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
    sig = rng.integers(0, 1 << 60, (k, 32))[rng.integers(0, k, n)].copy()
    other = rng.random(sig.shape) < rng.choice([0.3, 0.6, 0.8, 0.9])
    sig[other] = rng.integers(0, 1 << 60, other.sum())
    if seed % 2:
        # Values that many unrelated members have.
        common = rng.random(sig.shape) < 0.2
        sig[common] = np.broadcast_to(np.arange(32), sig.shape)[common]
    size = rng.integers(50, 80, n)
    meet = (sig[:, None] == sig[None]).sum(2) >= near_dedup.MATCHES
    near = meet & (100 * np.minimum(size[:, None], size) >= 80 * np.maximum(size[:, None], size))
    want = _components(n, zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    assert _components(n, near_dedup._colliding(sig, size, 80)) == want
    lists = [np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False)) for _ in range(2)]
    assert _components(n, near_dedup._colliding(sig, size, 80, lists)) == want
    side = rng.integers(0, 2, n)
    out = near_dedup._agreeing(None, pd.DataFrame({"id": np.arange(n), "signature": list(sig), "side": side}))
    crossing = meet & (side[:, None] == 0) & (side[None] == 1)
    assert _components(n, zip(out["a"].tolist(), out["b"].tolist(), strict=True)) == _components(n, zip(*(x.tolist() for x in np.nonzero(crossing)), strict=True))


def test_a_query_skips_the_members_of_a_tree_it_is_linked_with():
    sig = np.tile(np.arange(32), (500, 1))
    links = near_dedup._colliding(sig, np.full(500, 9), 80, [np.arange(500)])
    assert len(links) == 499
    # Without lists to lead, each member meets all later ones.
    assert len(near_dedup._colliding(sig[:20], np.full(20, 9), 80)) == 190


def test_reach_rules_out_only_rows_that_are_linked_with_none(spark):
    def of(*shingles):
        return np.array(sorted(shingles), np.uint64).tobytes()

    common = range(100)
    rows = [
        (1, 7, 5, of(*common), 1, True),
        # 20 own shingles of 120 leave 100 of 120, 83 %: enough beside row 1, whose size is 100.
        (2, 7, 5, of(*common, *range(1000, 1020)), 1, True),
        (3, 7, 5, of(*common, *range(2000, 2040)), 1, False),
        (4, 7, 5, of(*common, *range(3000, 3020)), 1, False),
        (5, 7, 5, of(*common, *range(3000, 3020), 1000), 1, False),
        (6, 8, 2, of(1, 2, 3), 6, True),
        (7, 8, 2, of(1, 2, 3, 4), 6, True),
    ]
    d = spark.createDataFrame(rows, "id long, cluster long, members long, shingles binary, first_id long, linked boolean")
    out = near_dedup._within_reach(d, 80)
    assert out.columns == d.columns
    assert sorted(r.id for r in out.collect()) == [1, 2, 4, 5]
    assert near_dedup._within_reach(d.limit(0), 80).count() == 0


def test_twenty_thousand_members_without_a_common_leader(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = rng.sample(words, 120)
    families = []
    for f in range(8):
        # Families share 100 of 120 words: candidates of one another, but not similar on pairs of words.
        own = base[:100] + [f"f{f}x{i}" for i in range(20)]
        families.append(own)
    rows = []
    for i in range(20_000):
        text = families[i % 8].copy()
        text[rng.randrange(100)] = f"u{i}"
        rows.append((i, " ".join(text)))
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(8)
    out = near_dedup.near_duplicates(d, 2).agg(F.count_if(F.col("component_id") == F.col("doc_id") % 8), F.count_if("kept"), F.count(F.lit(1))).first()
    assert tuple(out) == (20_000, 8, 20_000)


def test_near_misses_of_a_template_stay_apart(spark):
    common = [f"c{i}" for i in range(100)]
    rows = [(i, " ".join([*common, *(f"u{i}x{j}" for j in range(20))])) for i in range(5_000)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(8)
    assert near_dedup.near_duplicates(d, 2).filter("kept and component_id = doc_id").count() == 5_000
