"""Repair of conversation structure (operator 11): the cheapest edits that make turns alternate.

A repaired conversation is empty, or an optional system turn and then user and assistant in turns. Reading
it is an automaton of four states, so the cheapest edits from any turn on are four costs. Conversations of
like length lie side by side in a tensor (turn, conversation): one NumPy step updates the costs of all of
them, from the last turn to the first, all costs are kept, and the edits are traced forwards the same way.
Python sees a byte for each turn; texts stay in Spark. Conversations of many rows or bytes are cut into
pieces: a piece is a 4 x 4 matrix of costs, the pieces' matrices are chained, and each is traced on its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import materialize, table

#: Rows and bytes of a conversation that is edited in one piece; longer ones are cut into pieces of PIECE rows.
LONG_ROWS, LONG_BYTES, PIECE = 4096, 1 << 22, 4096

#: Cells of one tensor at most, unless a single conversation has more.
CELLS = 1 << 19

SPACES = " \t\n\x0b\x0c\r"

#: A turn's byte: role (0 other, 1 system, 2 user, 3 assistant) + 4 * fault (0 none, 1 truncated, 2 to be deleted). PAD is no turn.
PAD = 255

#: States: nothing yet, after system, after user, after assistant. KEEP[state, role] is the state after a turn that is kept
#: (4: not allowed), OTHER[state] after one that is inserted or takes the role that is due.
KEEP = np.array([[4, 1, 2, 4], [4, 4, 2, 4], [4, 4, 4, 3], [4, 4, 2, 4]])
OTHER = np.array([2, 2, 3, 2])

#: Costs of ending in each state: what is missing is inserted at 2 a turn.
END = [0, 4, 2, 0]
_NEVER = 1 << 40


def tensors(values: np.ndarray, offsets: np.ndarray):
    """(which, codes): conversations by length, in tensors of CELLS cells at most; shorter ones end in PAD."""
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # Lengths up to a quarter over the shortest share a tensor.
        top = size[order[at]] + size[order[at]] // 4
        end = int(np.searchsorted(size[order], top, "right"))
        end = min(end, at + max(1, CELLS // max(1, int(top))))
        which = order[at:end]
        length = int(size[which].max(initial=0))
        steps = np.arange(length)[:, None]
        codes = np.full((length, len(which)), PAD, np.uint8)
        there = steps < size[which]
        codes[there] = values[(offsets[which] + steps)[there]]
        yield which, codes
        at = end


def costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turn, state, conversation): the least cost of all from a turn on in a state; `end` (state, conversation) is that after the last."""
    steps, n = codes.shape
    out = np.empty((steps + 1, 4, n), np.int64)
    out[steps] = end
    column = np.arange(n)
    after = np.full((5, n), _NEVER, np.int64)
    for t in range(steps - 1, -1, -1):
        code = codes[t]
        role, fault = code & 3, code >> 2
        after[:4] = out[t + 1]
        use = np.minimum(after[KEEP[:, role], column], after[OTHER] + 2) + (fault == 1)
        w = np.minimum(after[:4] + 3, np.where(fault < 2, use, _NEVER))
        v = out[t]
        v[:] = np.minimum(w, w[OTHER] + 2)
        v[:2] = np.minimum(v[:2], w[3] + 4)
        v[:] = np.where(code == PAD, after[:4], v)
    return out


def trace(cost: np.ndarray, codes: np.ndarray, state: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, states, last): letters of the cheapest edits, 0 for none, and the state after each; among equals the least letter first.

    Up to two turns are inserted before each, and after the last of those that `finish`.
    """
    steps, n = codes.shape
    edits, states = np.zeros((3 * steps + 2, n), np.uint8), np.zeros((3 * steps + 2, n), np.uint8)
    column, state = np.arange(n), state.copy()
    for t in range(steps):
        code = codes[t]
        role, fault = code & 3, code >> 2
        now, after = cost[t], np.vstack([cost[t + 1], np.full(n, _NEVER)])
        todo = code != PAD
        for k in range(3):
            if not todo.any():
                break
            here, kept, other = now[state, column], KEEP[state, role], OTHER[state]
            drop = here == after[state, column] + 3
            insert = ~drop & (here == now[other, column] + 2)
            keep = ~drop & ~insert & (fault < 2) & (here == after[kept, column] + (fault == 1))
            edits[3 * t + k] = np.where(todo, np.select([drop, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R")), 0)
            state = np.where(todo, np.select([drop, keep], [state, kept], other), state)
            states[3 * t + k] = state
            todo = todo & insert
    for k in range(2):
        todo = finish & (cost[steps][state, column] > 0)
        edits[3 * steps + k] = np.where(todo, ord("I"), 0)
        state = np.where(todo, OTHER[state], state)
        states[3 * steps + k] = state
    return edits, states, state


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = codes.offsets.to_numpy().astype(np.int64)
    return np.asarray(codes.values.to_numpy(zero_copy_only=False), np.uint8), offsets


def _states(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, 4)


_EDIT = StructType().add("cost", LongType()).add("audit", StringType()).add("turns", ArrayType(StructType().add("row", IntegerType()).add("role", StringType())))


@F.arrow_udf(_EDIT)
def _edit(codes: pa.Array, end: pa.Array, entry: pa.Array, finish: pa.Array) -> pa.Array:
    """Cost, edits and resulting turns of whole conversations or pieces: the row that a turn comes from (0: inserted) and its role if that is new."""
    values, offsets = _flat(codes)
    ends, entries, finishes = _states(end), entry.to_numpy(zero_copy_only=False).astype(np.int64), finish.to_numpy(zero_copy_only=False).astype(bool)
    n = len(codes)
    total, letters, rows, roles = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
    for which, block in tensors(values, offsets):
        c = costs(block, ends[which].T)
        total[which] = c[0][entries[which], np.arange(len(which))]
        edits, states, _ = trace(c, block, entries[which], finishes[which])
        for j, i in enumerate(which):
            there = edits[:, j] > 0
            said, state = edits[there, j], states[there, j]
            letters[i] = said.tobytes().decode("ascii")
            row = np.where(said == ord("I"), 0, np.cumsum(said != ord("I")))
            stay = said != ord("D")
            # 0: the row's own role, 1: user, 2: assistant.
            role = np.where(said == ord("K"), 0, np.where(state == 2, 1, 2))
            rows[i], roles[i] = row[stay], role[stay]
    sizes = np.cumsum([0, *map(len, rows)])
    name = pa.array([None, "user", "assistant"]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *roles]).astype(np.int32)))
    turn = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int32)), name], ["row", "role"])
    turns = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), turn)
    return pa.StructArray.from_arrays([pa.array(total), pa.array(letters, pa.string()), turns], ["cost", "audit", "turns"])


@F.arrow_udf(ArrayType(LongType()))
def _matrix(codes: pa.Array) -> pa.Array:
    """Costs of a piece from each state at its start to each at its end, row by row."""
    values, offsets = _flat(codes)
    out = np.zeros((len(codes), 4, 4), np.int64)
    for which, block in tensors(values, offsets):
        for e in range(4):
            end = np.full((4, len(which)), _NEVER)
            end[e] = 0
            out[which, :, e] = costs(block, end)[0].T
    return pa.array(np.minimum(out, _NEVER).reshape(len(codes), 16).tolist(), pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(IntegerType()))
def _exits(codes: pa.Array, end: pa.Array, finish: pa.Array) -> pa.Array:
    """The state in which the cheapest edits of a piece leave it, for each state at its start."""
    values, offsets = _flat(codes)
    ends, finishes = _states(end), finish.to_numpy(zero_copy_only=False).astype(bool)
    out = np.zeros((len(codes), 4), np.int64)
    for which, block in tensors(values, offsets):
        c = costs(block, ends[which].T)
        for q in range(4):
            out[which, q] = trace(c, block, np.full(len(which), q), finishes[which])[2]
    return pa.array(out.tolist(), pa.list_(pa.int32()))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _faults(rows: DataFrame, repeated) -> DataFrame:
    """Add fault and code: blank, then duplicate (`repeated`), then truncated."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", "blank").when(repeated, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    level = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    return rows.withColumn("fault", fault).withColumn("code", (role + 4 * level).cast("smallint"))


def _counts() -> list:
    return [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]


#: Adjacent roles in order: system or assistant, then user; user, then assistant.
_ILLEGAL = "case when size(codes) < 2 then 0 else size(filter(sequence(1, size(codes) - 1), i -> (codes[i - 1] & 3) * 4 + (codes[i] & 3) not in (6, 11, 14))) end"


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that one task holds: their turns in order as an array, counts, and their edits. Texts are shuffled once."""
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    r = _faults(rows.repartition("conv_id").withColumn("again", again), F.col("again"))
    g = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "again", "code"))).alias("rows"), *_counts(), F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    g = g.withColumn("codes", F.transform("rows", lambda x: x["code"])).withColumn("_n", F.size(F.array_distinct(F.filter(F.transform("rows", lambda x: x["turn"]), lambda t: t.isNotNull()))))
    end = F.array(*[F.lit(x).cast("long") for x in END])
    g = g.withColumn("gaps", F.coalesce(F.col("_last") - F.col("_first") + 1 - F.col("_n"), F.lit(0)).cast("long")).withColumn("illegal", F.expr(_ILLEGAL).cast("long"))
    return g.withColumn("edit", _edit("codes", end, F.lit(0), F.lit(True))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "edit", "rows")


def _made(p, rows) -> dict:
    """Role and text of a repaired turn, from the rows' array."""
    row = F.get(rows, p["row"] - 1)
    return {"role": F.coalesce(p["role"], row["role"]), "text": F.coalesce(F.when(p["row"] > 0, row["text"]), F.lit(""))}


class _Cut:
    """Conversations of any length, in pieces: `pieces` has their edits, `turns()` the repaired turns, `repaired()` a row for each."""

    def __init__(self, rows: DataFrame, piece: int):
        keyed = rows.withColumn("key", F.to_json(F.struct("conv_id")))
        order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
        # Range partitions are in order, and so are the numbers of their rows; a piece lies in one of them.
        self.rows = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
        first = self.rows.groupBy("key", F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("said")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
        r = _faults(self.rows.join(first, "at", "left"), F.col("first").isNull())
        p = r.groupBy("key", F.expr(f"at div {piece}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"), F.min("at").alias("from"), *_counts())
        p = materialize(p.withColumn("codes", F.transform("c", lambda x: x["code"])).drop("c").withColumn("in_piece", F.expr(_ILLEGAL)))
        ends = materialize(p.select("key", "piece", _matrix("codes").alias("m")).groupBy("key").applyInPandas(_chain_back, "key string, piece long, end array<bigint>, finish boolean"))
        with_ends = p.join(ends, ["key", "piece"])
        entries = with_ends.select("key", "piece", _exits("codes", "end", "finish").alias("exits")).groupBy("key").applyInPandas(_chain_on, "key string, piece long, entry long")
        self.pieces = materialize(with_ends.join(entries, ["key", "piece"]).withColumn("edit", _edit("codes", "end", "entry", "finish")))
        self.step = 3 * piece + 2

    def turns(self) -> DataFrame:
        """(key, position, role, text)"""
        e = self.pieces.select("key", "piece", "from", F.posexplode("edit.turns").alias("k", "t"))
        e = e.select("key", (F.col("piece") * self.step + F.col("k")).alias("position"), F.when(F.col("t.row") > 0, F.col("from") + F.col("t.row") - 1).alias("at"), F.col("t.role").alias("new"))
        return e.join(self.rows.select("at", "role", "text"), "at", "left").select("key", "position", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def repaired(self) -> DataFrame:
        before = F.lag(F.element_at("codes", -1)).over(Window.partitionBy("key").orderBy("piece"))
        joint = F.col("before").bitwiseAND(F.lit(3)) * 4 + F.col("codes")[0].bitwiseAND(F.lit(3))
        p = self.pieces.withColumn("before", before).withColumn("_illegal", F.col("in_piece") + F.coalesce((~joint.isin(6, 11, 14)).cast("int"), F.lit(0)))
        # `end` of a piece is what is left after it, so the whole cost is that of the first.
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edit.audit"))), lambda x: x["audit"]), "")
        g = p.groupBy("key").agg(*[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("_illegal").cast("long").alias("illegal"), F.min_by("edit.cost", "piece").alias("cost"), audit.alias("audit"))
        spans = self.rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
        lines = self.turns().repartition("key").sortWithinPartitions("key", "position")
        hashes = lines.mapInArrow(_hash_lines, "key string, repaired_sha256 string")
        out = g.join(spans, "key").join(hashes, "key", "left")
        return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _chain_back(pdf: pd.DataFrame) -> pd.DataFrame:
    """The costs after each piece, from the last one's back: a row a piece."""
    pdf = pdf.sort_values("piece", ascending=False)
    end, out = np.array(END, np.int64), []
    for m in pdf["m"]:
        out.append(end)
        end = (np.asarray(m, np.int64).reshape(4, 4) + end).min(axis=1)
    return pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "end": out, "finish": np.arange(len(pdf)) == 0})


def _chain_on(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each piece: a row a piece."""
    pdf = pdf.sort_values("piece")
    state, out = 0, []
    for exits in pdf["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "entry": out})


def _hash_lines(batches):
    """sha256 of each key's lines, which come in order; a hash reads its lines one after the other, so only a row is held."""
    key, h = None, None
    for batch in batches:
        done = {"key": [], "repaired_sha256": []}
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
            if k != key:
                if h:
                    done["key"].append(key)
                    done["repaired_sha256"].append(h.hexdigest())
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done["key"]:
            yield pa.RecordBatch.from_pydict(done)
    if h:
        yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [h.hexdigest()]})


def _split(turns: DataFrame, rows: int, size: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that one task holds, rows of the others or None)."""
    t = _turns(turns)
    sizes = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role") + 16).alias("bytes"))
    long_ = materialize(sizes.filter((F.col("n") > rows) | (F.col("bytes") > size)).select(F.col("conv_id").alias("_long")))
    if not long_.limit(1).count():
        return t, None
    same = t["conv_id"].eqNullSafe(long_["_long"])
    return t.join(long_, same, "left_anti"), t.join(long_, same, "left_semi")


def repair(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece: int = PIECE) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text): its faults, and the cheapest repair.

    Turns are in the order of turn (nulls first), role and text. Null roles and texts count as one space, a null conv_id is a conversation of its own;
    equal rows are each a turn, the later ones duplicates; other columns do not take part; an empty table
    gives an empty one. gaps counts the turn numbers that are missing. The repaired conversation is the `role:text` of its turns, one a line,
    hashed; `repaired_turns` gives the turns themselves. Conversations of over `long_rows` rows or `long_bytes` bytes are cut into pieces of `piece` rows.
    """
    short, long_ = _split(turns, long_rows, long_bytes)
    g = _whole(short)

    def line(p):
        made = _made(p, F.col("rows"))
        return F.concat(made["role"], F.lit(":"), made["text"])

    lines = F.array_join(F.transform("edit.turns", line), "\n")
    out = g.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "edit.cost", "edit.audit", F.sha2(lines, 256).alias("repaired_sha256"))
    return out if long_ is None else out.unionByName(_Cut(long_, piece).repaired())


def repaired_turns(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece: int = PIECE) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations; positions grow along a conversation."""
    short, long_ = _split(turns, long_rows, long_bytes)
    e = _whole(short).select("conv_id", "rows", F.posexplode("edit.turns").alias("position", "t"))
    made = _made(F.col("t"), F.col("rows"))
    out = e.select("conv_id", F.col("position").cast("long").alias("position"), *[c.alias(n) for n, c in made.items()])
    if long_ is None:
        return out
    cut = _Cut(long_, piece)
    ids = cut.rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    return out.unionByName(cut.turns().join(ids, "key").select("conv_id", "position", "role", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by the crc32 of `conv_id:turn` modulo 20: 0 is dropped, 1 emptied, 2 loses its sentence ends, 3 comes twice, 4 is the user's. Nulls are one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    h = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    rows = _turns(conversations).withColumn("_h", h).filter("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; those that lose all their turns are empty."""
    c = table(spark, sf_dir, "conversations")
    ids = c.select(F.col("conv_id").alias("_id")).distinct()
    r = repair(damaged(c))
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(r, ids["_id"].eqNullSafe(r["conv_id"]), "left").select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
