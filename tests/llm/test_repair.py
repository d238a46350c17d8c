"""Conversation repair against a plain search, on whole and on cut conversations."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from avsync.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """Conversations after damage: {conv: [(turn, role, text)]}."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        tie = (role, text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text, tie)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by a search over edits one by one."""
    faults, seen = [], set()
    for _, role, text, _ in rows:
        body = text.rstrip(SPACE)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("none" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def may(said, name):
        if not said:
            return name in "su"
        return said[-1] + name in ("su", "ua", "au")

    @lru_cache(None)
    def best(at, last, inserted):
        """(cost, audit, lines) from row ``at`` on, the last turn's initial being ``last``."""
        found = []
        if at == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                if may(last, name[0]):
                    c, a, s = best(at, name[0], inserted + 1)
                    found.append((c + 2, "I" + a, (f"{name}:", *s)))
        if at < len(rows):
            _, role, text, _ = rows[at]
            c, a, s = best(at + 1, last, 0)
            found.append((c + 3, "D" + a, s))
            if faults[at] in ("none", "truncated"):
                more = faults[at] == "truncated"
                if role[:1] and role[:1] in "sua" and may(last, role[:1]):
                    c, a, s = best(at + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *s)))
                for name in ("user", "assistant"):
                    if may(last, name[0]):
                        c, a, s = best(at + 1, name[0], 0)
                        found.append((c + 2 + more, "R" + a, (f"{name}:{text}", *s)))
        return min(found) if found else (1 << 40, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        size = rng.choice([0, 1, 2, 5, 8, 30]) if conv != 7 else 70
        turn = rng.randint(-3, 3)
        for _ in range(size):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "Yes.", "no", "", " \n", "What? ", "ünï!", None, f"t{rng.random()}.", f"t{rng.random()}"])
            rows.append((conv, turn if rng.random() > 0.05 else None, role, text))
            turn += rng.choice([1, 1, 1, 2])
    rows += [(100, t, "user", "Again.") for t in range(40)]  # one long run
    rows += [(101, t, "tool", "cut off") for t in range(33)]
    rows += [(102, None, "user", "Same.")] * 9  # one turn, equal rows
    gone = [t for t in range(200) if zlib.crc32(f"103:{t}".encode()) % 20 == 0][:2]
    return rows + [(103, t, "user", "All dropped.") for t in gone]


def in_order(rows):
    """By turn, null first. Rows of one turn are told apart in the test by their turn only where equal."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk_rows", [2048, 3])
def test_repair_equals_search(spark, chunk_rows):
    rows = [r for r in odd_conversations() if r[1] is not None or r[0] == 102]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"symbols": F.lit(1), "conv": F.lit("x"), "part": F.lit(2.5)}).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(df, chunk_rows=chunk_rows).collect()}
    want = {conv: plain(tuple(in_order(kept))) for conv, kept in damage(rows).items()}
    assert got == want
    assert got[103] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_null_turns_come_first(spark):
    rows = [(1, 5, "assistant", "Late."), (1, None, "user", "Early.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = repair.repair_conversations(df).collect()[0]
    assert tuple(got[1:]) == plain(tuple(in_order(damage(rows)[1])))


def test_rows_of_one_turn_have_one_order(spark):
    rows = [(1, 4, "user", f"{k}.") for k in range(12)] + [(1, 5, "assistant", f"{k}.") for k in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = repair.repair_conversations(df.repartition(1)).collect()
    assert one == repair.repair_conversations(df.orderBy(F.desc("text")), chunk_rows=5).collect()


def test_empty_table(spark):
    got = repair.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert got.collect() == []
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_powers_of_runs():
    for symbol in range(10):
        ahead = repair.END
        for length in range(1, 40):
            ahead = repair.before(repair.transition(symbol, 0), ahead)
            assert repair.over_run(symbol, length, repair.END) == ahead


def test_extreme_turns(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    kept = damage(rows)[1]
    want = repair.as_long(max(r[0] for r in kept) - min(r[0] for r in kept) + 1 - len({r[0] for r in kept}))
    assert repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()[0]["gaps"] == want


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 3_000_000 + "!"), (2, 0, "user", "z")]
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {conv: plain(tuple(in_order(kept))) for conv, kept in damage(rows).items()}
