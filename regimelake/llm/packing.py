"""Best-fit packing with bound-certified repacking (operator 2)."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .chunks import Chunks
from .common import discard, free_names, group_of, materialize, parts_of, small_batches, table

#: Pieces that one task packs at a time; partitions that exchange documents in one round.
PER_PARTITION, EXCHANGE = 4096, 4


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that these lengths need at least: the best of the dual feasible functions u_p, p to capacity / 2.

    u_p counts items over capacity - p as whole bins and drops those under p; between, lengths stay.
    """
    if not len(lengths):
        return 0
    w = np.sort(lengths)
    total = np.r_[0, np.cumsum(w)]
    p = np.unique(np.r_[0, w[w <= capacity // 2]])
    low, mid, high = (np.searchsorted(w, x, side) for x, side in ((p, "left"), (capacity // 2, "right"), (capacity - p, "right")))
    high = np.maximum(high, mid)
    room = (high - mid) * capacity - (total[high] - total[mid])
    return int((len(w) - mid + np.maximum(0, -((room - (total[mid] - total[low])) // capacity))).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Each item's bin: longest first, into the fullest bin that has room. Ties keep the given order."""
    out = np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        rest = open_ >> n
        if rest:
            left = n + (rest & -rest).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_ ^= 1 << left
        else:
            left, b, bins = capacity, bins, bins + 1
        out[i] = b
        left -= n
        free[left].append(b)
        open_ |= 1 << left
    return out


def _packer(length: str, capacity: int, schema: StructType, level: int, groups: int, names: list[str]):
    group, bin_, open_name = names


    def run(key, rows):
        # Bins of one group have numbers from 0; ids are made unique by level and group.
        rows = rows.reset_index(drop=True)
        n = rows[length].fillna(0).to_numpy(np.int64)
        if len(n) and n.max() > capacity:
            raise ValueError(f"a length of {n.max()} is over {capacity}")
        bound = lower_bound(n[n > 0], capacity)
        bins = best_fit_decreasing(n, capacity)
        if level:
            old = np.unique(rows[bin_].to_numpy(), return_inverse=True)[1]
            bins = bins if bins.max(initial=-1) < old.max(initial=-1) else old
        used = int(bins.max(initial=-1)) + 1
        fill = np.bincount(bins, n, used).astype(np.int64)
        open_ = np.zeros(used, bool)
        if used > bound:  # the emptiest bins are dealt anew
            open_[np.argsort(fill, kind="stable")[: max(2, used // 8)]] = True
            open_ &= fill < capacity
        order = np.lexsort((np.arange(len(n)), bins))
        at = np.cumsum(n[order]) - n[order]
        place = np.empty(len(n), np.int64)
        place[order] = at - np.repeat(at[np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])] if len(n) else at, np.bincount(bins, minlength=used)[np.unique(bins)])
        g = int(key[0])
        rows[bin_], rows[open_name], rows["offset"] = bins + (g << 32), open_[bins].astype(np.int32), place
        rows["sequence_id"] = (level << 56) + (g << 24) + bins
        rows[group] = g % groups
        return rows[[f.name for f in schema.fields]]

    return run


def pack(pieces: DataFrame, length: str = "length", capacity: int = 4096, per_partition: int = PER_PARTITION) -> DataFrame:
    """Add sequence_id and offset: every row's sequence of at most `capacity`, and its place there.

    Rows are numbered as they are written and dealt by a hash of the number into partitions of about
    `per_partition`, so hot keys, repeated rows and ties spread evenly. Each is packed by best-fit decreasing and has a lower bound from dual feasible
    functions: a partition at its bound is certified and final. The others keep their full bins; the
    rows of their emptier bins meet those of EXCHANGE - 1 further partitions and are packed again, and
    the better packing stays, until EXCHANGE partitions or fewer are left; no task ever holds them all. Rows of null or zero length take
    no room; rows over `capacity` raise an error, as cutting is the caller's choice. An empty table
    gives an empty one. All columns pass, but for two of the names that are added.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    group, bin_, open_, number = free_names([*names, "sequence_id", "offset"], "_g", "_bin", "_open", "_number")
    schema = StructType([pieces.schema[c] for c in names] + [StructField(group, LongType()), StructField(bin_, LongType()), StructField(open_, IntegerType()), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    # Written with its number, a row is in the same partition however often a task is run again.
    pieces = materialize(pieces.select(*names, F.monotonically_increasing_id().alias(number)))
    total = pieces.count()
    parts = max(1, -(-total // per_partition))
    state = pieces.select(*names, group_of(parts, number).alias(group), F.lit(-1).cast("long").alias(bin_))
    done = None
    level = 0
    while True:
        packed = materialize(state.groupBy(group).applyInPandas(_packer(length, capacity, schema, level, -(-parts // EXCHANGE), [group, bin_, open_]), schema))
        if not level:
            discard(pieces)  # all its rows are in `packed`
        if parts == 1 or level and parts <= EXCHANGE or not packed.filter(F.col(open_) == 1).limit(1).count():
            final = packed
        else:
            final = packed.filter(F.col(open_) == 0)
        done = final if done is None else done.unionByName(final)
        if final is packed:
            return done.select(*names, "sequence_id", "offset")
        state = packed.filter(F.col(open_) == 1).select(*names, group, bin_)
        parts = -(-parts // EXCHANGE)
        level += 1


#: Words of printable ASCII and letters of Latin-1, which the tokenizer only lower-cases, and its pieces of such words in lower case, one to a line.
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9\n]+")

#: Pieces, and other words, of one call of the library.
AT_ONCE, ODD_AT_ONCE = 500, 2000


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each value first


def _spread(chunks: Chunks, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all keys one after another, where each key's ids end); each distinct key is looked up once."""
    coded = keys.dictionary_encode()
    index = coded.indices.to_numpy()
    values = chunks.values([_strings(coded.dictionary)])[0]
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    data = np.frombuffer(b"".join(values), np.uint32)
    n = size[index]
    end = np.cumsum(n)
    return data[np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[index] - (end - n), n)], end


class _Tokens:
    """Ids of words as little-endian 32-bit numbers.

    Plain words are cut into their pieces, and each distinct piece is encoded once: many to a call, as a
    text with spaces between, where the library's ids tell the end of each piece. All other words, and
    those that may hold a special string, are given to the library as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces, self.words = Chunks(self.of_pieces), Chunks(self.of_words)
        self.pieces.known["\n"] = b""

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), AT_ONCE):
            some = pieces[at : at + AT_ONCE]
            ids = self.encoded([" ".join(some)])[0]
            end = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(end) != len(some) or end[-1] != 4 * len(ids):  # not a tokenizer that marks ends
                out += [x.tobytes() for x in self.encoded(some)]
                continue
            data, end = ids.tobytes(), end.tolist()
            out += [data[a:b] for a, b in zip([0, *end], end, strict=False)]
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        array = pa.array(words, pa.large_string())
        plain = pc.and_not(pc.match_substring_regex(array, _PLAIN), pc.match_substring(array, "<|"))
        found = self.of_plain(_strings(array.filter(plain)))
        if len(found) == len(words):
            return found
        odd = _strings(array.filter(pc.invert(plain)))
        # Few of the library's result objects at a time.
        others = iter([x.tobytes() for at in range(0, len(odd), ODD_AT_ONCE) for x in self.encoded(odd[at : at + ODD_AT_ONCE])])
        found = iter(found)
        return [next(found if p else others) for p in plain.to_pylist()]

    def of_plain(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        pieces = pa.array(_PIECES.findall("\n".join([*words, ""]).lower()), pa.large_string())
        ids, end = _spread(self.pieces, pieces)
        line = (4 * end[np.flatnonzero(pc.equal(pieces, "\n").to_numpy(zero_copy_only=False))]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *line], line, strict=False)]


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> Chunks:
    return _Tokens(path).words


def token_bytes(path: str, texts: list[str | None] | pa.Array) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers.

    This tokenizer drops white space and joins nothing across it, so what lies between spaces and line
    feeds is encoded alone, once for each distinct such word.
    """
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    ids, end = _spread(_tokens(path), words.flatten())
    data, end = ids.tobytes(), (4 * np.r_[0, end][np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())]]).tolist()
    return [data[a:b] for a, b in zip(end, end[1:], strict=False)]


def cut_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of each document's ids and the id `end`.

    Documents of more than `capacity` ids are cut into pieces of that length; the last may be shorter. A
    null or empty text has the end alone.
    """
    kind = docs.schema[key].dataType
    fields = [StructField(key, kind), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    if ids:
        from pyspark.sql.types import BinaryType

        fields.append(StructField("ids", BinaryType()))
    last = int(end).to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, text, 1 << 22):
                rows = []
                for k, found in zip(part.column(key).to_pylist(), token_bytes(path, part.column(text)), strict=True):
                    found += last
                    for i, at in enumerate(range(0, len(found), 4 * capacity)):
                        piece = found[at : at + 4 * capacity]
                        rows.append((k, i, at // 4, len(piece) // 4, zlib.crc32(piece), *((piece,) if ids else ())))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_pydict({f.name: pa.array(c, part.schema.field(key).type if j == 0 else {"piece": pa.int32(), "ids": pa.binary()}.get(f.name, pa.int64())) for j, (f, c) in enumerate(zip(fields, columns, strict=True))})

    return docs.select(key, text).mapInArrow(run, StructType(fields))


def packed_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """Documents cut and packed: one row for each piece."""
    return pack(cut_documents(docs, path, capacity), "length", capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    small_batches(spark)
    out = packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
