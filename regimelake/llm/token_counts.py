"""Token counts by rank-synchronous array merging (operator 7)."""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import Chunks, chunk_of, spaced_chunks
from .common import parts_of, small_batches, table


#: Bytes of a piece from which on its pairs are kept in a heap: rounds over a long array cost its length each. Measured on random
#: letters, the array takes 1.5 s a MB at 24 bytes, 3 at 64 and 29 at 2,000, the heap 1.4 to 2 s throughout.
LONG = 64


class ArrayMerger:
    """Counts the symbols that byte-level BPE leaves of many pre-tokens at once.

    The pre-tokens lie in one ragged array. In each round every sequence finds its lowest-ranked pair
    and merges all its places from left to right; sequences without a pair leave the array.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        # Byte-level vocabularies write each byte as a printable character; fixed by their format.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.symbol = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.width = max(vocabulary.values()) + 1
        pair = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        pair, at = np.unique(pair, return_index=True)
        self.pair, self.rank, self.made = pair, at, made[at]
        self.merges: dict | None = None

    def long_count(self, piece: bytes) -> int:
        """The symbols of one long piece: its pairs in a heap by rank and place, its symbols in a linked list."""
        if self.merges is None:
            self.merges = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        merges, width = self.merges.get, self.width
        symbols = self.symbol[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := merges(a * width + b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two was merged before
            symbols[i], symbols[j] = merges(a * width + b)[1], -1
            after[i] = k = after[j]
            n -= 1
            if k >= 0:
                before[k] = i
                if m := merges(symbols[i] * width + symbols[k]):
                    heapq.heappush(heap, (m[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges(symbols[h] * width + symbols[i])):
                heapq.heappush(heap, (m[0], h, symbols[h], symbols[i]))
        return n

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        if any(len(p) > LONG for p in pieces):
            out = np.zeros(len(pieces), np.int64)
            short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
            out[short] = self.counts([pieces[i] for i in short])
            for i in set(range(len(pieces))) - set(short):
                out[i] = self.long_count(pieces[i])
            return out
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = size.copy()
        symbols, owner = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), size)
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            rank = np.where((self.pair[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], len(self.pair))
            begin = np.flatnonzero(np.r_[True, owner[1:-1] != owner[:-2]])
            best = np.minimum.reduceat(rank, begin)
            lowest = np.repeat(best, np.diff(np.r_[begin, len(rank)]))
            hit = (rank == lowest) & (rank < len(self.pair))
            if not hit.any():
                break
            # Overlapping places of one pair (a run of one symbol): every second from the left.
            run = np.flatnonzero(hit)
            first = np.r_[True, np.diff(run) > 1]
            place = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
            run = run[place % 2 == 0]
            symbols[run] = self.made[at[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            np.subtract.at(out, owner[run], 1)
            active = np.zeros(len(pieces), bool)
            active[owner[run]] = True
            keep &= active[owner]
            symbols, owner = symbols[keep], owner[keep]
        return out


@functools.lru_cache(maxsize=2)
def _worker(path: str, pattern: str):
    import regex

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
    merger, cut = ArrayMerger(said["model"]["vocab"], merges), regex.compile(pattern).findall
    special = sorted((t["content"] for t in said.get("added_tokens", [])), key=len, reverse=True)

    def solve_pieces(pieces: list[str]) -> list[int]:
        return merger.counts([p.encode() for p in pieces]).tolist()

    pieces = Chunks(solve_pieces)

    def solve(keys: list[str]) -> list[int]:
        return [sum(x) for x in pieces.values([cut(chunk_of(k)) for k in keys])]

    return cut, Chunks(solve), regex.compile("|".join(map(regex.escape, special))) if special else None


def count_texts(path: str, pattern: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text; a special token's string counts as that one token, as the library has it."""
    cut, chunks, special = _worker(path, pattern)
    keys, extra = [], []
    for text in texts:
        between = special.split(text) if text and special and special.search(text) else [text or ""]
        extra.append(len(between) - 1)
        keys.append([k for t in between for k in spaced_chunks(t, cut)] if len(between) > 1 else spaced_chunks(between[0], cut))
    return [sum(x) + n for x, n in zip(chunks.values(keys), extra, strict=True)]


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Add the column `count`: the tokens of each whole text.

    A null or empty text has none, an empty table gives an empty one. Repeated rows are counted as they come,
    other columns pass unchanged (one of the name `count` is replaced). A text without a space, however
    long, takes time in proportion to its length and its logarithm. One narrow pass: no shuffle.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    out = StructType([f for f in docs.schema.fields if f.name != count] + [StructField(count, LongType())])

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, text, 1 << 22):
                found = count_texts(path, pattern, part.column(text).to_pylist())
                columns = {n: part.column(n) for n in part.schema.names if n != count}
                yield pa.RecordBatch.from_pydict(columns | {count: pa.array(found, pa.int64())})

    return docs.mapInArrow(run, out)


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than `limit` tokens."""
    import public_tokenizers
    from pyspark.sql import functions as F

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
