"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 1)."""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import Chunks, chunk_of, spaced_chunks
from .common import parts_of, small_batches, table

#: Bytes of the longest piece whose prefixes are stored, and prefixes that a worker stores before it starts again.
LONG, PREFIXES = 64, 500_000

#: Lengths of tokens where no longer one ends in the last four bytes.
SHORT = (3, 2, 1)

#: Pairs of tokens whose validity a worker remembers.
PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes pieces of text, each by the table of its prefixes' last tokens.

    Every byte prefix of a piece has one valid encoding, and so one last token: the longest-known fact
    that makes BPE a one-pass recurrence. Token t may end prefix i if t spells its last bytes and the
    pair (last token of the prefix before t, t) is itself an encoding. The table of a prefix stays
    right when bytes are appended, so `extend` continues it, and after an edit only the table from the
    edited byte on is computed anew (`reencode`).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        #: The last token of stored prefixes.
        self.stored: dict[bytes, int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        #: The tokens that merging makes.
        self.made = {t: r for t, r in ranks.items() if self.split(r)}
        #: By their last four bytes, the lengths of such tokens, longest first; down to single bytes.
        lengths: dict[bytes, set[int]] = {}
        for t in self.made:
            if len(t) > 3:
                lengths.setdefault(t[-4:], {1, 2, 3}).add(len(t))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items()}

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice if it is a byte; None if merging never makes it."""
        if rank not in self.parts:
            piece = self.token[rank]
            symbols = [piece[i : i + 1] for i in range(len(piece))]
            while len(symbols) > 2:
                found = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))), default=(rank, 0))
                if found[0] >= rank:
                    break
                symbols[found[1] : found[1] + 2] = [symbols[found[1]] + symbols[found[1] + 1]]
            if len(piece) == 1:
                self.parts[rank] = (rank, rank)
            else:
                self.parts[rank] = (self.ranks[symbols[0]], self.ranks[symbols[1]]) if len(symbols) == 2 and all(s in self.ranks for s in symbols) else None
        return self.parts[rank]

    def follows(self, left: int, right: int) -> bool:
        """Whether `left right` is the encoding of its own bytes.

        The merges at the seam are undone from the latest on: the pair fails if a merge across the seam
        would have come before the merge that is undone there.
        """
        key = (left, right)
        if key not in self.valid:
            if len(self.valid) > PAIRS:
                self.valid.clear()
            self.valid[key] = self._follows(left, right)
        return self.valid[key]

    def _follows(self, left: int, right: int) -> bool:
        bound, token, ranks = 1 << 62, self.token, self.ranks
        while True:
            joined = ranks.get(token[left] + token[right])
            if joined is not None and joined < bound and self.split(joined) == (left, right):
                return False
            # Undo the later of the two tokens that touch the seam; of equal ones the right one came later.
            undo_left = left > right
            if undo_left and len(token[left]) == 1 or not undo_left and len(token[right]) == 1:
                undo_left = not undo_left
                if len(token[left if undo_left else right]) == 1:
                    return True
            if undo_left:
                bound, left = left, self.split(left)[1]
            else:
                bound, right = right + 1, self.split(right)[0]

    def last_token(self, piece: bytes, end: int, before) -> int:
        """The last token of the prefix of `end` bytes; before(i) is that of the prefix of i bytes."""
        made, valid = self.made.get, self.valid.get
        for size in self.lengths.get(piece[max(0, end - 4) : end], SHORT):
            begin = end - size
            if begin < 0:
                continue
            rank = made(piece[begin:end])
            if rank is not None:
                if not begin:
                    return rank
                left = before(begin)
                fits = valid((left, rank))
                if fits or fits is None and self.follows(left, rank):
                    return rank
        raise ValueError("the ranks lack a single byte")

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Continue the table `last` (of the first len(last) bytes) to all of `piece`: an exact append."""
        for end in range(len(last) + 1, len(piece) + 1):
            last.append(self.last_token(piece, end, lambda i: last[i - 1]))
        return last

    def reencode(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """The table of `new` from that of `old`: what they share at their front is kept."""
        same = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
        return self.extend(new, last[:same])

    def read(self, piece: bytes, last) -> tuple[int, ...]:
        """The encoding, from the last token backwards; last(i) is the last token of the prefix of i bytes."""
        out, end = [], len(piece)
        while end:
            out.append(rank := last(end))
            end -= len(self.token[rank])
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a piece; what is stored of its prefixes, by whatever piece, is used again."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > LONG:
            table = self.extend(piece, [])
            return self.read(piece, lambda i: table[i - 1])
        stored = self.stored
        if len(stored) > PREFIXES:
            stored.clear()
        size = known = len(piece)
        while known and piece[:known] not in stored:
            known -= 1
        token, before = self.token, lambda i: stored[piece[:i]]
        for end in range(known + 1, size + 1):
            stored[piece[:end]] = self.last_token(piece, end, before)
        out = []
        while size:
            out.append(rank := stored[piece[:size]])
            size -= len(token[rank])
        return tuple(out[::-1])


@functools.lru_cache(maxsize=2)
def _worker(path: str, pattern: str):
    import regex

    encoder, cut = PrefixEncoder(load_ranks(path)), regex.compile(pattern).findall

    def pieces(key: str) -> list[str]:
        """The pattern's pieces; Latin letters after one space or one line end need no pattern."""
        chunk = chunk_of(key)
        if chunk[0] in " \n" and chunk[1:].isalpha() and (chunk.isascii() or max(chunk) < "\u0250"):
            return [chunk] if chunk[0] == " " else [chunk[0], chunk[1:]]
        return cut(chunk)

    def solve(keys: list[str]) -> list[tuple[int, ...]]:
        found, encode = [], encoder.encode
        for key in keys:
            x = [encode(p.encode()) for p in pieces(key)]
            found.append(x[0] if len(x) == 1 else tuple(chain.from_iterable(x)))
        return found

    return encoder, cut, Chunks(solve)


def encode_texts(path: str, pattern: str, texts: list[str | None]) -> list[list[int]]:
    """Ids of each text; a null text has none."""
    _, cut, chunks = _worker(path, pattern)
    return [list(chain.from_iterable(x)) for x in chunks.values([spaced_chunks(t or "", cut) for t in texts])]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array column `ids`: the tokens of each whole text.

    A null or empty text has no tokens. Texts of any length are cut only by `pattern`. Repeated rows
    are encoded as they come; other columns pass unchanged. One narrow pass: no shuffle.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    out = StructType([f for f in docs.schema.fields if f.name != ids] + [StructField(ids, ArrayType(IntegerType()))])

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, text, 1 << 22):
                found = encode_texts(path, pattern, part.column(text).to_pylist())
                columns = {n: part.column(n) for n in part.schema.names if n != ids}
                yield pa.RecordBatch.from_pydict(columns | {ids: pa.array(found, pa.list_(pa.int32()))})

    return docs.mapInArrow(run, out)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the binary column `decoded`: the bytes that the tokens of `ids` spell; null ids decode to nothing."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    out = StructType([f for f in docs.schema.fields if f.name != decoded] + [StructField(decoded, BinaryType())])

    def run(batches):
        encoder, _, _ = _worker(path, "")
        spell = encoder.token.__getitem__
        for batch in batches:
            found = [b"".join(map(spell, x or ())) for x in batch.column(ids).to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names if n != decoded}
            yield pa.RecordBatch.from_pydict(columns | {decoded: pa.array(found, pa.binary())})

    return docs.mapInArrow(run, out)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without keeping the ids."""

    def run(batches):
        spell = _worker(path, pattern)[0].token.__getitem__
        name = {r: str(r) for r in _worker(path, pattern)[0].token}.__getitem__
        for batch in batches:
            for part in parts_of(batch, "text", 1 << 22):
                ids = encode_texts(path, pattern, part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(b"".join(map(spell, x))).hexdigest() for x in ids], pa.string()),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the multilingual byte-level vocabulary."""
    import public_tokenizers

    small_batches(spark)
    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
