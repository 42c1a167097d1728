"""MinHash near-dedup by a signature-coordinate inverted join (operator 8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, group_of, likely, materialize, mix, parts_of, seeds, small_batches, spread_join, table, text_slices

#: A signature has COORDINATES values, each of ROWS minhashes together; pairs that agree in MATCHES go on.
#: At similarity s one coordinate agrees with probability s**3; at 0.8 a pair has fewer than 4 of 32
#: with probability 7e-7. Documents of similarity 0.05 agree in one with probability 1.3e-4.
COORDINATES, ROWS, MATCHES = 32, 3, 4

#: Members of a posting list, or of a candidate cluster, that one task compares at a time.
BLOCK = 2048

#: Rows of short posting lists that one group compares.
LISTED = 4096

#: Members that all others of a list or cluster are held against first, before what is then left meets all.
LEADERS = 32


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `size` words; of all its words, if it has fewer; none without words."""
    runs = words.hash
    for k in range(1, size):
        runs = mix(runs[:-1] * np.uint64(0x9E3779B97F4A7C15) + words.hash[k:]) if len(runs) > 1 else runs[:0]
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in words.hash[a:b]:
                short = mix(np.array([short * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    begin = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    keys, out = seeds(COORDINATES * ROWS, 4242), np.zeros((len(sets), COORDINATES), np.uint64)
    for c in range(COORDINATES):
        value = np.full(len(sets), c, np.uint64)
        for r in range(ROWS):
            key = keys[c * ROWS + r]
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat((flat ^ key) * (key | np.uint64(1)), begin))
        out[:, c] = value
    return out


def _sign(batches, size: int):
    for batch in batches:
        for rows, data, offsets in text_slices([batch], "text"):
            with np.errstate(over="ignore"):
                sets = shingles(Words(data, offsets, lower=True), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                found: list = [None] * len(sets)
                one: list = [None] * len(sets)
                two: list = [None] * len(sets)
                if full:
                    for i, s in zip(full, signatures([sets[i] for i in full]).view(np.int64), strict=True):
                        found[i] = s
                        one[i], two[i] = int(np.bitwise_xor.reduce(mix(sets[i])).view(np.int64)), int(mix(sets[i] + np.uint64(7)).sum(dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "signature": pa.array(found, pa.list_(pa.int64())),
            })


def _root(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _grow(parent: dict[int, int], pairs) -> None:
    """Join the trees of `parent` that the pairs link; the smallest number is the root."""
    for i, j in pairs:
        parent.setdefault(i, i)
        parent.setdefault(j, j)
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)


def _stars(parent: dict[int, int]) -> list[tuple[int, int]]:
    """Each tree as links from its root: lists of much the same members give the same links."""
    return [(r, x) for x in parent if (r := _root(parent, x)) != x]


def _span(pairs, ids) -> list[tuple[int, int]]:
    """A forest with the same components as the pairs (of places in ids): links from the smallest id of each."""
    parent: dict[int, int] = {}
    _grow(parent, ((int(ids[i]), int(ids[j])) for i, j in pairs))
    return _stars(parent)


def _led(n: int, one, many) -> list[tuple[int, int]]:
    """Links with the same components as all links of n members.

    one(i, js): whether i is linked with each of js; many(left, right): the links (i, j) of two sets of members.
    LEADERS members in turn take all that are linked with them and not yet taken. A link between two groups
    has an end outside the largest one, so only these members meet all: none, if the first leader takes all.
    """
    group, left, links = np.full(n, -1), np.arange(n), []
    for _ in range(LEADERS):
        if not len(left):
            break
        hit = one(left[0], left)
        hit[0] = True
        group[left[hit]] = left[0]
        links += [(int(left[0]), j) for j in left[hit][1:].tolist()]
        left = left[~hit]
    taken = group[group >= 0]
    largest = np.bincount(taken).argmax() if len(taken) else -1
    return links + many(np.flatnonzero(group != largest), np.arange(n))


class Postings:
    """Members posted under each coordinate and value of their signatures, in one sorted array; members are numbers below n."""

    def __init__(self, sig: np.ndarray):
        self.n = len(sig)
        self.lists = np.unique(sig, return_inverse=True)[1].reshape(sig.shape).astype(np.int64)
        self.entries = np.sort((self.lists * self.n + np.arange(self.n)[:, None]).ravel())

    def seek(self, lists: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first member from `target` on in each list, found by binary search; n at a list's end."""
        base = lists * self.n
        at = np.searchsorted(self.entries, base + target)
        found = self.entries[np.minimum(at, len(self.entries) - 1)] - base
        return np.where((at < len(self.entries)) & (found < self.n), found, self.n)

    def count(self, member: int) -> np.ndarray:
        """How often each member stands in the lists of one of them: its collisions, itself included."""
        base = self.lists[member] * self.n
        begin, end = np.searchsorted(self.entries, base), np.searchsorted(self.entries, base + self.n)
        return np.bincount(np.concatenate([self.entries[i:j] - k for i, j, k in zip(begin, end, base, strict=True)]), minlength=self.n)

    def merge(self, queries: np.ndarray, start: np.ndarray, close, skip: np.ndarray):
        """Pairs of a query and a member from its `start` on that meet in MATCHES lists of the query and are close(i, j).

        The lists are read in step. A member below the MATCHES-th smallest front stands in fewer lists than
        MATCHES, so all lists skip to that front; where MATCHES fronts are equal, their member is a pair,
        and the query goes on at skip[member]: the members before that are linked with it.
        """
        left, right = [], []
        lists, target = self.lists[queries], start.astype(np.int64)
        front = self.seek(lists, target[:, None])
        while len(queries):
            low = np.partition(front, MATCHES - 1, axis=1)[:, :MATCHES]
            least = low[:, MATCHES - 1]
            on = least < self.n
            queries, lists, target, front, low, least = (x[on] for x in (queries, lists, target, front, low, least))
            if not len(queries):
                break
            met = low.min(axis=1) == least
            linked = met & close(queries, least)
            left.append(queries[linked])
            right.append(least[linked])
            target = np.where(linked, skip[least], np.where(met, least + 1, least))
            row, column = np.nonzero(front < target[:, None])
            front[row, column] = self.seek(lists[row, column], target[row])
        return np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)


def _colliding(sig: np.ndarray, size: np.ndarray, percent: int, long_lists=()) -> list[tuple[int, int]]:
    """Links with the same components as all pairs of MATCHES collisions whose sizes can be similar.

    Members of `long_lists` are led first: a leader's lists are counted, and its tree takes what collides
    with it. Members are then ordered by tree, so that a query skips its own tree and, once it is linked with
    a member of another, the rest of that one.
    """
    if not len(sig):
        return []
    everyone = np.arange(len(sig))
    tree, taken, links, posted = everyone.copy(), np.zeros(len(sig), bool), [], Postings(sig)

    def close(i, j):
        return 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])

    for members in long_lists:
        for _ in range(LEADERS):
            free = members[~taken[members]]
            if not len(free):
                break
            mine = np.flatnonzero((posted.count(free[0]) >= MATCHES) & close(free[0], everyone) & ~taken)
            taken[mine], tree[mine] = True, free[0]
            links += [(int(free[0]), j) for j in mine.tolist() if j != free[0]]
    order = np.argsort(tree, kind="stable")
    in_order = tree[order]
    end = np.searchsorted(in_order, in_order, "right")
    if links:
        posted, size = Postings(sig[order]), size[order]
    i, j = posted.merge(everyone, end, close, end)
    return links + list(zip(order[i].tolist(), order[j].tolist(), strict=True))


def _agreeing(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a part of a long posting list: rows of `side` 0 with all, as a spanning forest."""
    if not len(rows):
        return pd.DataFrame([], columns=["a", "b"], dtype="int64")
    # Rows of side 0 come first, so that each of them is merged with all of side 1.
    rows = rows.sort_values("side", kind="stable")
    n = int((rows["side"] == 0).sum())
    posted = Postings(np.stack(rows["signature"].to_numpy()))
    i, j = posted.merge(np.arange(n), np.full(n, n), lambda i, j: np.ones(len(i), bool), np.arange(1, len(rows) + 1))
    return pd.DataFrame(_span(zip(i.tolist(), j.tolist(), strict=True), rows["id"].to_numpy()), columns=["a", "b"], dtype="int64")


def _agreeing_lists(percent: int):
    """Pairs that meet in posting lists and collide often enough, as one spanning forest of all lists of the group.

    The lists of the group bring the members together; their collisions are counted along the lists of all
    coordinates of these members.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["value", "id"])
        ids, first, place = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
        if not len(ids):
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        sig = np.stack(rows["signature"].to_numpy()[first])
        size = rows["n_shingles"].to_numpy()[first]
        value = rows["value"].to_numpy()
        begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        lists = [m for m in np.split(place, begin[1:]) if len(m) > 64]
        links = _colliding(sig, size, percent, sorted(lists, key=len, reverse=True))
        return pd.DataFrame(_span(links, ids), columns=["a", "b"], dtype="int64")

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a product of 0/1 matrices over the elements that both sides have."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for begin in range(0, len(common), 4096):
        part = common[begin : begin + 4096]
        sides = []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for k, s in enumerate(side):
                at = np.searchsorted(part, s)
                at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == s)]
                m[k, at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _similar(sets: list[np.ndarray], percent: int):
    """(one, many) of `_led` for similarities of full sets."""
    size = np.array([len(x) for x in sets], np.float64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    begin = np.r_[0, np.cumsum([len(x) for x in sets])[:-1]].astype(np.int64)

    def one(i, js):
        own = sets[i]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat(own[at] == flat, begin)[js].astype(np.float64)
        return 100 * both >= percent * (size[i] + size[js] - both)

    def many(left, right):
        pairs, others = [], [sets[j] for j in right]
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            both = _intersections([sets[i] for i in some], others)
            i, j = np.nonzero(100 * both >= percent * (size[some][:, None] + size[right][None, :] - both))
            i, j = some[i], right[j]
            keep = i != j
            pairs += _span(zip(i[keep].tolist(), j[keep].tolist(), strict=True), np.arange(len(sets)))
        return pairs

    return one, many


def _confirm(percent: int):
    """Links of candidate clusters, confirmed on full sets, as a spanning forest of each."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("cluster", sort=False):
            part = part.sort_values("id", kind="stable")
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            out += _span(_led(len(sets), *_similar(sets, percent)), part["id"].to_numpy())
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _confirm_rest(percent: int):
    """Links of a part of a large cluster: rows of `side` 0 with those of side 1, as a spanning forest."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        side = rows["side"].to_numpy()
        pairs = _similar(sets, percent)[1](np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if len(rows) else []
        return pd.DataFrame(_span(pairs, rows["id"].to_numpy()), columns=["a", "b"], dtype="int64")

    return run


def _with_first(batches, percent: int):
    """Whether each row's set is similar to `first_shingles`, its cluster's first member's."""
    for batch in batches:
        flags = []
        for x, y in zip(batch.column("shingles").to_pylist(), batch.column("first_shingles").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            flags.append(100 * both >= percent * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != "first_shingles"} | {"linked": pa.array(flags, pa.bool_())})


def _sets(batches, size: int):
    for batch in batches:
        for rows, data, offsets in text_slices([batch], "text"):
            sets = shingles(Words(data, offsets, lower=True), size)
            yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "cluster": rows.column("cluster"), "members": rows.column("members"), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def _entries(batches):
    for batch in batches:
        for rows in parts_of(batch, "shingles"):
            sets = [np.frombuffer(x, np.int64) for x in rows.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            own, cluster = (np.repeat(rows.column(c).to_numpy(), n) for c in ("own", "cluster"))
            yield pa.RecordBatch.from_pydict({"own": own, "cluster": cluster, "shingle": np.concatenate(sets)})


def _within_reach(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of those clusters that have unlinked rows, without unlinked rows that no other row can be similar to.

    Shingles that no other row of the cluster has can't be common to two: what is left of a set bounds its
    intersections, and a partner has at least percent/100 of its size and that of the cluster's smallest
    set. Only shingles that one row alone has go by row, so common ones are counted where they are.
    """
    partly = materialize(rows.groupBy("cluster").agg(F.count_if(~F.col("linked")).alias("rest"), F.count(F.lit(1)).alias("n")).filter("rest > 0").drop("rest"))
    met = materialize(spread_join(rows, partly, ["cluster"], ["id"]).withColumn("own", F.xxhash64("id", "shingles")))
    least = met.groupBy("cluster").agg(F.min(F.length("shingles") / 8).cast("long").alias("least"), F.count(F.lit(1)).alias("n"))
    held = met.select("own", "cluster", "shingles").mapInArrow(_entries, "own long, cluster long, shingle long").groupBy("cluster", "shingle")
    alone = held.agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own")).filter("n = 1").groupBy("own").agg(F.count(F.lit(1)).alias("alone"))
    sized = spread_join(met.join(alone, "own", "left"), materialize(least), ["cluster"], ["id"]).withColumn("size", (F.length("shingles") / 8).cast("long"))
    shared = F.col("size") - F.coalesce("alone", F.lit(0))
    enough = 100 * (100 + percent) * shared >= percent * (100 * F.col("size") + F.greatest(100 * F.col("least"), percent * F.col("size")))
    return sized.filter(F.col("linked") | enough).select(rows.columns)


def _rest_with_all(rows: DataFrame, key: str) -> DataFrame:
    """Blocks (key, i, j, side) in which the rows that are not `linked` meet all rows of their key; nothing where all are linked.

    rows: id, key, `members` of the key, first_id (linked, too). A row is copied once for each BLOCK unlinked rows of its key.
    """
    # Keys with unlinked rows grow with the data, so they are joined by shuffle, hot ones dealt over many tasks.
    n = materialize(rows.groupBy(key).agg(F.count_if(~F.col("linked")).alias("_rest"), F.count(F.lit(1)).alias("n")).filter("_rest > 0"))
    met = materialize(spread_join(rows, n, [key], ["id"]))
    mine, theirs = F.ceil(F.col("_rest") / BLOCK).cast("int"), F.ceil(F.col("members") / BLOCK).cast("int")
    names = [c for c in rows.columns if c not in ("linked", "first_id")]
    left = met.filter("not linked").select(*names, F.pmod(F.xxhash64("id"), mine).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), theirs - 1)).alias("j"), F.lit(0).alias("side"))
    right = met.select(*names, F.explode(F.sequence(F.lit(0), mine - 1)).alias("i"), F.pmod(F.xxhash64("id"), theirs).cast("int").alias("j"), F.lit(1).alias("side"))
    return left.unionByName(right)


def _from_first(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of large keys beside `first_id` and first_`value`, those of the key's smallest id; hot keys are dealt over many tasks."""
    first = materialize(rows.groupBy(key).agg(F.min("id").alias("first_id"), F.min_by(value, "id").alias(f"first_{value}"), F.count(F.lit(1)).alias("n")))
    return spread_join(rows, first, [key], ["id"])


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Two texts are linked if their sets of `shingle_words`-word shingles (A-Z lower-cased) have a Jaccard
    similarity of percent/100; links are confirmed on full sets. component_id is the smallest doc_id that
    links lead to. Rows of null doc_id take no part and have a null component_id and kept true; texts
    without words are linked with nothing. Repeated rows are each returned.

    Equal sets become one representative first, so a group of copies of any size is one row in what
    follows. Representatives are posted under each coordinate and value; values that only one has are
    skipped, a document with fewer than MATCHES other ones too. Of what is left, ordered from rare to
    frequent, all but the last MATCHES - 1 form its prefix: pairs with MATCHES agreements meet in their
    prefixes. Prefix lists deal members to tasks, many lists to each. There a member's lists, of all its
    coordinates, are merged in step: they skip by binary search to the first member that MATCHES of them can
    still hold, and beyond trees of members that are linked already. In lists of over 64, and in candidate
    clusters when links are confirmed, members are held against a few leaders first, and only what these
    leave meets all; lists and clusters of over BLOCK do so with their first member, and in blocks, clusters
    after rows with too many shingles of their own are ruled out. All return spanning forests of their
    links, never all pairs. Only a convergence flag reaches the driver. An empty table gives an empty one; long texts are
    whole; columns beside doc_id and text take no part.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(d.mapInArrow(lambda it: _sign(it, shingle_words), "doc_id long, n_shingles long, one long, two long, signature array<long>"))
    part = signed.filter("doc_id is not null and n_shingles > 0")
    reps = materialize(part.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))
    posted = reps.select("id", F.explode("signature").alias("value"))
    frequent = posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = posted.join(frequent, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values")).filter(F.size("values") >= MATCHES)
    prefix = materialize(kept.select("id", F.explode(F.expr(f"slice(values, 1, size(values) - {MATCHES - 1})")).alias("v")).select("id", "v.value"))
    lists = prefix.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("n > 1")
    # Lists of the same members say the same: one of them is enough.
    lists = lists.groupBy("n", "who").agg(F.min("value").alias("value"))
    members = materialize(prefix.join(lists.select("value", "n"), "value").join(reps.select("id", "signature", "n_shingles"), "id"))
    parts = max(1, members.count() // LISTED)
    short = members.filter(F.col("n") <= BLOCK).select(group_of(parts, "value").alias("g"), "value", "id", "signature", "n_shingles")
    joined = short.groupBy("g").applyInPandas(_agreeing_lists(percent), "a long, b long")
    long_ = _from_first(members.filter(F.col("n") > BLOCK).select("value", "id", "signature", F.col("n").alias("members")), "value", "signature")
    collisions = F.aggregate(F.zip_with("signature", "first_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    long_ = materialize(long_.withColumn("linked", collisions >= MATCHES).drop("first_signature"))
    joined = joined.unionByName(long_.filter("linked and id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b")))
    long_ = _rest_with_all(long_, "value").groupBy("value", "i", "j").applyInPandas(_agreeing, "a long, b long")
    candidates = components(materialize(joined.unionByName(long_)))
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    clusters = candidates.join(sizes, "component").select("id", F.col("component").alias("cluster"), "members")
    clusters = materialize(clusters)
    texts = likely(d.withColumnRenamed("doc_id", "id"), clusters, "id").join(clusters, "id").select("id", "cluster", "members", "text")
    sets = materialize(texts.mapInArrow(lambda it: _sets(it, shingle_words), "id long, cluster long, members long, shingles binary"))
    small = sets.filter(F.col("members") <= BLOCK)
    groups = max(1, sets.count() // 512)
    links = small.groupBy(group_of(groups, "cluster").alias("g")).applyInPandas(_confirm(percent), "a long, b long")
    large = _from_first(sets.filter(F.col("members") > BLOCK), "cluster", "shingles")
    large = materialize(large.select("id", "cluster", "members", "shingles", "first_id", "first_shingles").mapInArrow(lambda it: _with_first(it, percent), "id long, cluster long, members long, shingles binary, first_id long, linked boolean"))
    links = links.unionByName(large.filter("linked and id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b")))
    links = links.unionByName(_rest_with_all(materialize(_within_reach(large, percent)), "cluster").groupBy("cluster", "i", "j").applyInPandas(_confirm_rest(percent), "a long, b long"))
    linked = components(materialize(links))
    named = reps.join(linked, "id", "left").select("one", "two", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "one", "two").join(named, ["one", "two", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents on two-word shingles at 0.8."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)
