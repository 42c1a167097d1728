"""Conversation repair against a brute-force search, whole and in pieces, and odd rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from regimelake.llm import conversations as C

TURNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            out += [(conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    return out


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation, by a search over all edits."""
    rows = sorted(((-1 << 70 if t is None else t), r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows)
    turns = {t for t, _, _ in rows if t > -1 << 69}
    faults, seen = [], set()
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def ends(state):
        return state in ("", "a")

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if ends(state):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, left = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, left))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                if role[:1] and role[0] in legal[state]:
                    cost, audit, left = best(i + 1, role[0], 0)
                    found.append((cost + extra, "K" + audit, (f"{role}:{text}", *left)))
                for name in ("user", "assistant"):
                    if name[0] in legal[state]:
                        cost, audit, left = best(i + 1, name[0], 0)
                        found.append((cost + extra + 2, "R" + audit, (f"{name}:{text}", *left)))
        if inserted < 4:
            for name in ("user", "assistant"):
                if name[0] in legal[state]:
                    cost, audit, left = best(i, name[0], inserted + 1)
                    found.append((cost + 2, "I" + audit, (f"{name}:", *left)))
        return min(found, default=(1 << 30, "", ()))

    cost, audit, left = best(0, "", 0)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def made(seed, n, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "so so", "", " \t\n", "Ärger 漢字?", None, "x" * rng.randint(1, 9) + "."])
            rows.append((None if conv == 3 else conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "piece": 2}, {"long_bytes": 60, "piece": 4096}])
def test_repair_equals_brute_force(spark, limits):
    rows = made(5, 150)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", code string"), **limits).collect()}
    assert got == {k: brute(v) for k, v in grouped(rows).items()}


def test_one_long_conversation_in_pieces(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", "Well!", ""]) + str(rng.randint(0, 999)) * rng.randint(0, 1)) for i in range(900)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    whole, cut = (sorted(C.repair(spark.createDataFrame(rows, TURNS), **limits).collect()) for limits in ({}, {"long_rows": 100, "piece": 64}))
    assert whole == cut and len(whole) == 2


def test_repaired_turns_are_what_is_hashed(spark):
    rows = made(9, 60)
    for limits in ({}, {"long_rows": 4, "piece": 3}):
        d = spark.createDataFrame(rows, TURNS)
        turns = grouped(sorted(((r.conv_id, r.position, r.role, r.text) for r in C.repaired_turns(d, **limits).collect()), key=lambda r: (str(r[0]), r[1])))
        for r in C.repair(d, **limits).collect():
            mine = turns.get(r.conv_id, [])
            assert hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in mine).encode()).hexdigest() == r.repaired_sha256
            assert re.fullmatch("(s?(ua)+)?", "".join(x[2][:1] for x in mine))


def _query(spark, folder):
    return {r.conv_id: tuple(r)[1:] for r in C.op11_conversation_repair(spark, str(folder)).collect()}


def test_query_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()] + made(2, 40)[-40:]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    left = grouped(damage(rows))
    assert _query(spark, tmp_path) == {k: brute(left.get(k, [])) for k in grouped(rows)}


def test_empty_and_very_long(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert _query(spark, tmp_path / "none") == {}
    text = "word " * 200_000
    rows = [(1, None, None, None), (1, 0, "user", text), (1, 1, "assistant", text + "."), (2, 5, "system", "alone")]
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(spark.createDataFrame(rows, TURNS), long_bytes=1 << 20).collect()}
    assert got == {k: brute(v) for k, v in grouped(rows).items()}
