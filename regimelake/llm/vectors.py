"""Vector search: exact top-k by no-random-access aggregation (3), inverted file with product quantisation (6)."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_of, materialize, table

#: Queries and candidates that one task holds.
QUERY_BLOCK, BLOCK = 4096, 8192

#: Of what is unread of the sorted lists, the share that a step leaves once half is read; before, a step reads so many times as far.
LEAVES, FURTHER = 0.8, 4

#: Queries of one product of matrices, and those of them that tell whether a step's bounds exclude anything.
QUERIES_AT_ONCE, SCOUTS = 256, 16

#: Whole numbers that doubles hold exactly.
EXACT = 1 << 53


def _finite(rows: DataFrame, id_: str, vector: str, zero: bool) -> DataFrame:
    """(id, v as doubles) of the rows with an id and finite components, and if asked not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = rows.select(F.col(id_).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return r.filter(F.exists("v", lambda x: x != 0)) if zero else r


def _best(found: DataFrame, k: int, kind: str) -> DataFrame:
    """The k best of each query's partial lists; every list has k rows at most, one for each block."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(kind).alias("score"))


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


# ---- exact top-k -------------------------------------------------------------------------------


class SortedLists:
    """A block of candidates with each one's place in the sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n = len(vectors)
        self.ids, self.vectors = ids, vectors
        up = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, up, 0)
        self.place = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.place, up, np.arange(n, dtype=np.int32)[:, None], 0)

    def prefix(self, read: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """After `read` entries of every list from both ends: the components read (0 where not), which are unread, and the last values read."""
        n = len(self.vectors)
        seen = np.hstack([self.place >= n - read, self.place < read])
        return np.where(seen, np.hstack([self.vectors, self.vectors]), 0).astype(kind), (~seen).astype(kind), self.sorted[n - read], self.sorted[read - 1]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For each query (place, ids, scores, share of the lists that was read, candidates that were resolved).

        Every list is read from its best end in step. After r entries of each an unseen component adds its
        list's last seen contribution at most and its far end's at least, which bounds every score from above
        and below. Candidates whose upper bound is under the k-th lower bound, and all unseen ones with them,
        cannot qualify; a query whose bounds leave few stops there, and these few get their final scores. A
        step of all queries is three products of matrices: positive components read lists from the top,
        negative ones from the bottom. Reading begins at k entries. Where a few scouts among the queries find
        that a step's bounds exclude nothing yet, reading goes on without bounds for the rest.
        """
        n = len(self.vectors)
        reach = np.abs(self.vectors).max(initial=0) * np.abs(queries).sum(1).max(initial=0)
        # Whole numbers whose sums stay under 2**24 are exact in single precision.
        kind = np.float32 if reach < 1 << 23 else np.float64
        signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        worst = (signed * np.r_[self.sorted[0], self.sorted[-1]]).astype(kind)
        out, todo, read = [], np.arange(len(queries)), min(n, k)
        while len(todo):
            values, unseen, high, low = self.prefix(read, kind)
            best = (signed * np.r_[high, low]).astype(kind)

            def bounds(some):
                known = signed[some].astype(kind) @ values.T
                lower = known + worst[some] @ unseen.T
                mine = own[some, None] == self.ids[None, :]
                lower[mine] = -np.inf
                bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf, kind)
                return (known + best[some] @ unseen.T >= bar[:, None]) & ~mine

            few = max(4 * k, n // 16)
            more = []
            if read == n or len(todo) <= SCOUTS or (bounds(todo[:: -(-len(todo) // SCOUTS)]).sum(1) < n - 1).any():
                for at in range(0, len(todo), QUERIES_AT_ONCE):
                    some = todo[at : at + QUERIES_AT_ONCE]
                    left = bounds(some)
                    count = left.sum(1)
                    for i, q in enumerate(some.tolist()):
                        if count[i] <= few or read == n:
                            who = np.flatnonzero(left[i])
                            scores = self.vectors[who] @ queries[q]
                            chosen = _top(self.ids[who], scores, k)
                            out.append((q, self.ids[who][chosen], scores[chosen], read / n, len(who)))
                        else:
                            more.append(q)
                todo = np.array(more, np.int64)
            read = min(n, FURTHER * read, n // 2) if read < n // 2 else n - int((n - read) * LEAVES) if n - read > n // 32 else n
        return out


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest integer inner product with each query.

    Components become floor(scale * x). A query's own row is no candidate; ties go to the smaller id.
    Vectors that are null, empty or hold null or non-finite components take no part on either side;
    repeated ids are separate candidates. Vectors of different lengths never meet; an empty table gives an
    empty result. A component of 2**62 or more after scaling, or a score that a long cannot hold, is an error.
    Queries and candidates meet in blocks (a stated query set against all rows), each pair of blocks in one
    task of bounded size; a block returns k rows a query.
    """
    limit = float(1 << 62)
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is over 2**62")).cast("long")))
    c = _finite(rows, id_, vector, False).select("id", whole.alias("v"))
    q = _finite(queries, id_, vector, False).select("id", whole.alias("v"))
    return _best(_in_blocks(q, c, lambda left, right: _nra(left, right, k), "long"), k, "long")


def _in_blocks(q: DataFrame, c: DataFrame, run, kind: str) -> DataFrame:
    n, m = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-c.count() // BLOCK))
    q = q.withColumn("qb", group_of(n, "id")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    c = c.withColumn("cb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(m)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("qb", F.col("qb").cast("long"))
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, f"query_id long, vec_id long, score {kind}")


def _exact_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """Scores beyond what doubles hold exactly: Python's integers over the whole block."""
    values = vectors.astype(object)
    for q in range(len(queries)):
        who = np.flatnonzero(ids != own[q])
        scores = values[who] @ queries[q].astype(object) if len(who) else np.zeros(0, object)
        chosen = sorted(range(len(who)), key=lambda i: (-scores[i], ids[who[i]]))[:k]
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in chosen):
            raise OverflowError("a score is no long")
        yield q, ids[who][chosen], scores[chosen].astype(np.int64)


def _nra(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    length = left["v"].map(len)
    for dims, part in right.groupby(right["v"].map(len), sort=False):
        mine = left[length == dims]
        if len(mine):
            own, ids = mine["id"].to_numpy(np.int64), part["id"].to_numpy(np.int64)
            queries, vectors = np.stack(mine["v"].to_numpy()), np.stack(part["v"].to_numpy())
            reach = float(np.abs(vectors.astype(np.float64)).max()) * float(np.abs(queries.astype(np.float64)).sum(1).max())
            if reach < EXACT:
                block = SortedLists(ids, vectors.astype(np.float64))
                found += [(own[q], near, scores) for q, near, scores, _, _ in block.top(queries.astype(np.float64), own, k)]
            else:
                found += [(own[q], near, scores) for q, near, scores in _exact_block(ids, vectors, queries, own, k)]
    # Ids stay whole numbers throughout: doubles would round those over 2**53.
    none = np.zeros(0, np.int64)
    query = np.concatenate([none, *(np.full(len(i), q, np.int64) for q, i, _ in found)])
    return pd.DataFrame({"query_id": query, "vec_id": np.concatenate([none, *(i for _, i, _ in found)]), "score": np.concatenate([none, *(s.astype(np.int64) for _, _, s in found)])})


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose vec_id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(e, e.filter("vec_id % 20 = 0"))


# ---- nearest neighbours by an inverted file ----------------------------------------------------

#: Vectors that centroids and codebooks are fitted on at most, and those of them that measure the recall of probing.
SAMPLE, TRIALS = 16_384, 200

#: Share of the sample's true neighbours that the lists probed first must hold. They only set the bar; lists that can reach it follow.
TARGET = 0.97

#: Queries that are scored at a time, and components of the vectors that are multiplied exactly at a time.
TABLES, PRODUCTS = 256, 1 << 20


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow or underflow of squares."""
    most = np.abs(x).max(1, initial=0)
    safe = np.where(most > 0, most, 1)
    return most * np.sqrt(((x / safe[:, None]) ** 2).sum(1))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centroids, codebooks of the residuals' directions, and how many lists to probe first.

    A residual is a length and a direction, whose components are coded two by two, so that tight groups are
    told apart as well as wide ones and any number of dimensions has fine codes.
    """

    def __init__(self, sample: np.ndarray, lists: int, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        with np.errstate(all="ignore"):
            self.coarse = _kmeans(sample, lists, rng)
            self.dims, self.parts = sample.shape[1], -(-sample.shape[1] // 2)
            home = self.nearest(sample)
            ways = self._pairs(sample - self.coarse[home])[1][: max(1024, 8192 * 32 // self.parts)]
            self.books = [_kmeans(ways[:, p], 256, rng) for p in range(self.parts)]
            trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
            near = sample[trial] @ sample.T
            near[np.arange(len(trial)), trial] = -np.inf  # the row itself, wherever it ranks
            true = np.argsort(-near, 1)[:, : min(k, len(sample) - 1)]
            place = np.argsort(np.argsort(-(sample[trial] @ self.coarse.T), 1), 1)
        ranks = np.take_along_axis(place, home[true], 1)
        self.probes = int(np.quantile(ranks, TARGET)) + 1 if ranks.size else 1

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.coarse**2).sum(1) - 2 * x @ self.coarse.T, 1)

    def _pairs(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The residuals' lengths, and their directions in pairs of components."""
        along = _norm(rest)
        ways = np.zeros((len(rest), 2 * self.parts))
        np.divide(rest, along[:, None], out=ways[:, : self.dims], where=along[:, None] > 0)
        return along, ways.reshape(len(rest), self.parts, 2)

    def encode(self, x: np.ndarray):
        """(list, codes, residual's length, distance from the decoded vector at most, distance from the centroid at most) of each row."""
        with np.errstate(all="ignore"):
            home = self.nearest(x)
            along, ways = self._pairs(x - self.coarse[home])
            codes = [np.argmin((b**2).sum(1).astype(np.float32) - 2 * ways[:, p].astype(np.float32) @ b.T.astype(np.float32), 1) for p, b in enumerate(self.books)]
            codes = np.stack(codes, 1).astype(np.uint8)
            close = self.decode(home, codes, along)
            # What doubles round in a vector's products is far under a trillionth of its length.
            slack = 1e-12 * (_norm(x) + _norm(close) + _norm(self.coarse)[home])
            return home, codes, along, _norm(x - close) * (1 + 1e-9) + slack, along * (1 + 1e-9) + slack

    def decode(self, home: np.ndarray, codes: np.ndarray, along: np.ndarray) -> np.ndarray:
        ways = np.stack([b[codes[:, p]] for p, b in enumerate(self.books)], 1).reshape(len(codes), -1)
        return self.coarse[home] + along[:, None] * ways[:, : self.dims]


class _Codes:
    """A shard's rows ordered by list, decoded, and queries' scores of them within bounds."""

    def __init__(self, index: Index, rows: pd.DataFrame):
        self.rows = rows.sort_values(["list", "id"], kind="stable")
        self.ids, self.lists, self.error = self.rows["id"].to_numpy(np.int64), self.rows["list"].to_numpy(np.int64), self.rows["error"].to_numpy(np.float64)
        codes = np.frombuffer(b"".join(self.rows["codes"]), np.uint8).reshape(-1, index.parts)
        with np.errstate(all="ignore"):
            self.close = index.decode(self.lists, codes, self.rows["along"].to_numpy(np.float64))
        self.begin = np.flatnonzero(np.r_[True, self.lists[1:] != self.lists[:-1]])
        self.end = np.r_[self.begin[1:], len(self.lists)]

    def scores(self, left: pd.DataFrame):
        """(first query, queries' vectors, scores of the decoded rows, how far the true ones can be off, which rows are candidates), some queries at a time.

        Candidates are the rows of lists that a query asks for, but for its own.
        """
        asked, own, here = left["lists"].to_numpy(), left["id"].to_numpy(np.int64), self.lists[self.begin]
        for at in range(0, len(left), TABLES):
            q = np.stack(left["v"].iloc[at : at + TABLES].to_numpy())
            wants = np.stack([np.isin(here, x) for x in asked[at : at + TABLES]])
            scores = np.full((len(q), len(self.ids)), -np.inf)
            with np.errstate(all="ignore"):
                for i, (a, b) in enumerate(zip(self.begin.tolist(), self.end.tolist(), strict=True)):
                    some = np.flatnonzero(wants[:, i])
                    if len(some):
                        scores[some, a:b] = q[some] @ self.close[a:b].T
                off = _norm(q)[:, None] * self.error
            there = np.repeat(wants, self.end - self.begin, 1) & (own[at : at + TABLES, None] != self.ids)
            yield at, q, scores, off, there


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, id_: str = "vec_id", vector: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product with each query, found by bounds on codes.

    Centroids and codebooks are fitted on the SAMPLE rows of the smallest hash of their id; every row is
    indexed by its list and the codes of its residual, with its distance from what these decode to. By Cauchy
    and Schwarz a score differs from that of the decoded vector by this distance times the query's length at
    most. First a query probes as many lists as hold TARGET of the true neighbours of TRIALS sample rows, and
    more where these hold fewer than k others; every shard gives the lower bounds at a few ranks, each twice
    the one before, and these are merged for each query into a bar that k rows reach for certain. Then all lists
    whose centroid and radius allow a score at the bar are visited, and the rows whose upper bound is at the bar
    or over it, and only those, are scored on the vectors. So no neighbour is missed whatever the rows are;
    what the fit decides is how many lists and rows the bounds rule out. Small lists share a shard, long ones
    are cut into several, each of about BLOCK rows. `report` is given the number of lists and of those probed first.

    A query's own row is no candidate. Vectors that are null, empty, zero or hold null or non-finite
    components take no part; those of different lengths never meet, each length has an index of its own.
    Repeated ids are separate candidates; of equal vectors the smaller ids come first. No valid row gives an
    empty result.
    """
    c, q = _finite(rows, id_, vector, True), _finite(queries, id_, vector, True)
    lengths = sorted(r["n"] for r in c.select(F.size("v").alias("n")).distinct().collect())  # one row a length of vectors
    found = [_search(c.filter(F.size("v") == n), q.filter(F.size("v") == n), k, report) for n in lengths]
    if not found:
        return _best(rows.sparkSession.createDataFrame([], FOUND), k, "double")
    return _best(functools.reduce(DataFrame.unionByName, found), k, "double")


FOUND = "query_id long, vec_id long, score double"


def _search(c: DataFrame, q: DataFrame, k: int, report: dict | None) -> DataFrame:
    """(query_id, vec_id, score) of each shard's k best at most, among them all of the k best; c and q are (id, v), all of one length."""
    spark = c.sparkSession
    sample = c.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    index = Index(np.stack(sample["v"].to_numpy()), max(1, min(1024, round(c.count() ** 0.5 / 4))), k)
    steps = np.unique(np.minimum(k, np.maximum(1, k // 4) << np.arange(k.bit_length())))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                home, codes, along, error, reach = index.encode(np.stack(pdf["v"].to_numpy()))
                yield pdf.assign(list=home, codes=[x.tobytes() for x in codes], along=along, error=error, reach=reach)

    held = materialize(c.mapInPandas(assign, "id long, v array<double>, list long, codes binary, along double, error double, reach double"))
    sizes, radius = np.zeros(len(index.coarse), np.int64), np.zeros(len(index.coarse))
    for r in held.groupBy("list").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect():  # one row a list, 1,024 at most
        sizes[r["list"]], radius[r["list"]] = r["n"], r["reach"]
    first, parts = _shards(sizes)
    placed = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts, strict=True))], "list long, first int, parts int")
    n = max(1, -(-q.count() // QUERY_BLOCK))
    held = held.join(F.broadcast(placed), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if report is not None:
        report |= {"lists": len(index.coarse), "probes": index.probes, "rows": int(sizes.sum())}

    def by_shard(lists) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for j in lists:
            for part in range(parts[j]):
                out.setdefault(int(first[j]) + part, []).append(j)
        return out

    def probe(batches):
        for pdf in batches:
            out = []
            if len(pdf):
                near = np.argsort(-(np.stack(pdf["v"].to_numpy()) @ index.coarse.T), 1, kind="stable")
                enough = np.maximum((np.cumsum(sizes[near], 1) < k + 1).sum(1) + 1, index.probes)
                for own, qb, v, x, m in zip(pdf["id"], pdf["qb"], pdf["v"], near, enough, strict=True):
                    out += [(own, qb, v, shard, js) for shard, js in by_shard(x[:m].tolist()).items()]
            yield pd.DataFrame(out, columns=["id", "qb", "v", "shard", "lists"])

    def visit(batches):
        for pdf in batches:
            out = []
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                with np.errstate(all="ignore"):
                    highest = v @ index.coarse.T + _norm(v)[:, None] * radius
                can = ~(highest < pdf["bar"].to_numpy()[:, None]) & (sizes > 0)
                for own, qb, x, bar, some in zip(pdf["id"], pdf["qb"], pdf["v"], pdf["bar"], can, strict=True):
                    out += [(own, qb, x, bar, shard, js) for shard, js in by_shard(np.flatnonzero(some).tolist()).items()]
            yield pd.DataFrame(out, columns=["id", "qb", "v", "bar", "shard", "lists"])

    def lows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        query, bounds, times = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            codes, own = _Codes(index, right), left["id"].to_numpy(np.int64)
            for at, _, scores, off, there in codes.scores(left):
                with np.errstate(all="ignore"):
                    low = np.where(there, scores - off, -np.inf)
                low[~np.isfinite(low)] = -np.inf  # no bound
                size = min(k, low.shape[1])
                top = -np.sort(-np.partition(low, low.shape[1] - size, axis=1)[:, low.shape[1] - size :], axis=1)
                # A few ranks tell the shard's counts: so many more rows reach each bound.
                for a, b in zip([0, *steps.tolist()], steps.tolist(), strict=False):
                    many = np.isfinite(top[:, a:b]).sum(1)
                    some = np.flatnonzero(many)
                    query.append(own[at + some])
                    bounds.append(top[some, a + many[some] - 1])
                    times.append(many[some])
        return pd.DataFrame({"query_id": np.concatenate(query), "bound": np.concatenate(bounds), "n": np.concatenate(times)})

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        query, near, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            codes, own, bar = _Codes(index, right), left["id"].to_numpy(np.int64), left["bar"].to_numpy(np.float64)
            vectors = np.stack(codes.rows["v"].to_numpy())
            step = max(1, PRODUCTS // index.dims)
            for at, q, scores, off, there in codes.scores(left):
                with np.errstate(all="ignore"):
                    i, j = np.nonzero(there & ~(scores + off < bar[at : at + len(q), None]))
                    exact = np.concatenate([np.zeros(0), *((vectors[j[a : a + step]] * q[i[a : a + step]]).sum(1) for a in range(0, len(i), step))])
                order = np.lexsort((codes.ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                query.append(own[at + i[best]])
                near.append(codes.ids[j[best]])
                score.append(exact[best])
        return pd.DataFrame({"query_id": np.concatenate(query), "vec_id": np.concatenate(near), "score": np.concatenate(score)})

    q = materialize(q.withColumn("qb", group_of(n, "id").cast("int")))
    codes = held.select("id", "list", "codes", "along", "error", "shard", "qb")
    asked = q.mapInPandas(probe, "id long, qb int, v array<double>, shard int, lists array<long>")
    seen = asked.groupBy("shard", "qb").cogroup(codes.groupBy("shard", "qb")).applyInPandas(lows, "query_id long, bound double, n long")
    above = Window.partitionBy("query_id").orderBy(F.desc("bound")).rowsBetween(Window.unboundedPreceding, 0)
    bars = seen.withColumn("above", F.sum("n").over(above)).filter(F.col("above") >= k).groupBy(F.col("query_id").alias("id")).agg(F.max("bound").alias("bar"))
    # Where fewer than k rows have a bound, every list and row counts.
    asked = q.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))).mapInPandas(visit, "id long, qb int, v array<double>, bar double, shard int, lists array<long>")
    return asked.groupBy("shard", "qb").cogroup(held.select("id", "v", "list", "codes", "along", "error", "shard", "qb").groupBy("shard", "qb")).applyInPandas(rerank, FOUND)


def _shards(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of each list: small lists fill a shard of BLOCK rows together, longer ones take several."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK))
    shard, room = -1, 0
    for i, n in enumerate(sizes.tolist()):
        if parts[i] > 1:
            first[i], shard, room = shard + 1, shard + parts[i], 0
            continue
        if n > room or shard < 0:
            shard, room = shard + 1, BLOCK
        first[i], room = shard, room - n
    return first, parts


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(e, e.filter("vec_id % 20 = 0"))
