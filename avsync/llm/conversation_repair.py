"""Operator 11: cheapest repair of a conversation's structure, by dynamic programming over runs.

A repaired conversation is empty, or an optional system turn and then user and assistant in
turn. That is an automaton of four states, so what a row may become is a 4 x 4 matrix of
costs; rows of equal role and fault have equal matrices. Equal consecutive rows are one run,
a run of n is passed by the cached powers of two of its matrix in the min-plus algebra, and
the choices are unrolled from the costs behind each row.

Matrices can be multiplied piece by piece, so a conversation of any length is cut into chunks
whose matrices and choices are worked out apart. Only small rows (one per chunk) are walked in
order. The SHA-256 of a conversation is a chain by definition: one task walks its repaired
text, a chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from avsync.llm.common import width
from avsync.session import settle

CHUNK_ROWS = 2048
CHUNK_CHARS = 1 << 20
BATCH_CHARS = 4 << 20

# -- the automaton -----------------------------------------------------------------------------

#: states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; what a further turn leads to
NEXT = (2, 2, 3, 2)
#: cost of the turns to insert before the conversation may end
END = (0, 4, 2, 0)
FAR = 1 << 60
DELETE, CHANGE, INSERT = 3, 2, 2
#: symbols of rows: 2 * role (s, u, a, other) + 1 if truncated; rows that must go
REPEATED, BLANK = 8, 9
ROLES = {"s": 0, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
SPACE = " \t\n\x0b\x0c\r"


def row_edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    yield "D", DELETE, state
    if symbol in (REPEATED, BLANK):
        return
    role, truncated = divmod(symbol, 2)
    after = NEXT[state]
    if role + 1 == after or role == state == 0:
        yield "K", truncated, role + 1
    yield "R", CHANGE + truncated, after


@lru_cache(maxsize=None)
def transition(symbol: int, power: int) -> tuple[tuple[int, ...], ...]:
    """Costs from state to state over 2 ** power rows of one symbol, insertions before rows included."""
    if power:
        half = transition(symbol, power - 1)
        return product(half, half)
    costs = [[FAR] * 4 for _ in range(4)]
    for start in range(4):
        state, paid = start, 0
        for _ in range(4):
            for _, cost, to in row_edits(symbol, state):
                costs[start][to] = min(costs[start][to], paid + cost)
            state, paid = NEXT[state], paid + INSERT
    return tuple(map(tuple, costs))


def product(a, b) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(min(a[q][p] + b[p][r] for p in range(4)) for r in range(4)) for q in range(4))


def before(matrix, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs from each state, given those behind the matrix."""
    return tuple(min(m + c for m, c in zip(row, ahead, strict=True)) for row in matrix)


def over_run(symbol: int, length: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    power = 0
    while length:
        if length & 1:
            ahead = before(transition(symbol, power), ahead)
        length >>= 1
        power += 1
    return ahead


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def chunk_matrix(symbols: bytes) -> list[int]:
    """The min-plus product of a chunk's rows, row by row."""
    whole = None
    for symbol, length in runs_of(symbols):
        power = 0
        run = None
        while length:
            if length & 1:
                step = transition(symbol, power)
                run = step if run is None else product(run, step)
            length >>= 1
            power += 1
        whole = run if whole is None else product(whole, run)
    if whole is None:
        whole = [[0 if q == p else FAR for p in range(4)] for q in range(4)]
    return [min(c, FAR) for row in whole for c in row]


@lru_cache(maxsize=1 << 16)
def choice(symbol: int, state: int, ahead: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest letters up to the edit that uses up the row, and the state then."""
    here = before(transition(symbol, 0), ahead)
    letters = ""
    while True:
        options = [(letter, cost + ahead[to], to) for letter, cost, to in row_edits(symbol, state)]
        options.append(("I", INSERT + here[NEXT[state]], NEXT[state]))
        letter, _, to = min(o for o in options if o[1] == here[state])
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def unroll(symbols: bytes, ahead: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """Letters for each row of a chunk, and the state behind it. ``ahead``: costs behind the chunk."""
    runs = runs_of(symbols)
    behind = []
    for symbol, length in reversed(runs):
        behind.append(ahead)
        ahead = over_run(symbol, length, ahead)
    letters = []
    for (symbol, length), end in zip(runs, reversed(behind), strict=True):
        inside = [end]
        for _ in range(length - 1):
            inside.append(before(transition(symbol, 0), inside[-1]))
        for after in reversed(inside):
            least = min(after)
            edit, state = choice(symbol, state, tuple(min(c - least, FAR) for c in after))
            letters.append(edit)
    return letters, state


def closing(state: int) -> str:
    """Insertions that end a conversation."""
    return "I" * (END[state] // INSERT)


# -- rows of a chunk -------------------------------------------------------------------------------


def row_symbol(role: str, text: str, seen: set) -> int:
    """The symbol of a row by its first fault; ``seen`` gathers the rows before it."""
    stripped = text.rstrip(SPACE)
    if not stripped:
        return BLANK
    if (role, text) in seen:
        return REPEATED
    seen.add((role, text))
    return 2 * ROLES.get(role[:1], 3) + (stripped[-1] not in ".!?")


def illegal_pairs(initials: bytes) -> int:
    return sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))


def repaired_lines(letters: list[str], roles: list[str], texts: list[str], state: int) -> list[str]:
    lines = []
    name = {2: "user", 3: "assistant"}
    for edit, role, text in zip(letters, roles, texts, strict=False):
        for letter in edit:
            if letter == "D":
                continue
            if letter == "K" and role[:1] == "s":
                state = 1
            else:
                state = NEXT[state]
            lines.append(f"{role}:{text}" if letter == "K" else f"{name[state]}:{text if letter == 'R' else ''}")
    return lines


def cost_of(letters: str, symbols: bytes) -> int:
    stay = [x for x in letters if x != "I"]
    cut = sum(x != "D" and symbol < REPEATED and symbol & 1 for x, symbol in zip(stay, symbols, strict=True))
    return DELETE * letters.count("D") + CHANGE * letters.count("R") + INSERT * letters.count("I") + cut


def as_long(value: int) -> int:
    """Wrapped to 64 bits, as long arithmetic does."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


# -- Spark ---------------------------------------------------------------------------------------------


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The damaged rows: conv, turn, role, text, gone (a dropped row), tie (order within a turn).

    A row's damage goes by crc32 of ``conv_id:turn`` modulo 20; nulls are one space there and in
    role and text. Rows of one turn stand in the order of a hash of role and text before damage,
    so that a repeated row is adjacent.
    """
    space = F.lit(" ")
    conv, at = F.col(conv_id), F.col(turn).cast("long")
    who, said = F.coalesce(F.col(role).cast("string"), space), F.coalesce(F.col(text).cast("string"), space)
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rows = df.select(conv.alias("conv"), at.alias("turn"), who.alias("role"), said.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"), F.xxhash64(who, said).alias("tie"))
    kind = F.col("damage")
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    said = F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", "tie", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _mapped(df: DataFrame, schema: T.StructType, each: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows to rows in Python, batches bounded in rows and characters."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        out, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a chunk may hold a million characters
                for given in batch.slice(at, 16).to_pylist():
                    for row in each(given):
                        out.append(row)
                        held += sum(len(v) for v in row.values() if isinstance(v, str | bytes))
                        if len(out) >= 4096 or held > BATCH_CHARS:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def chunks_of(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Conversations in order, cut into chunks: conv, part, no, whole, turns, roles, texts.

    Rows are dealt by ranges of (conversation, turn), so a long conversation lies in several
    parts; equal rows are dealt by a seeded number besides. ``whole``: the chunk is surely all of
    its conversation, being neither the first nor the last of its part. A chunk has at most
    ``chunk_rows`` rows and, but for a single longer row, about a million characters.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(width(rows.sparkSession), *order, F.rand(11)).sortWithinPartitions(*order, "role", "text")
    dealt = dealt.select("conv", F.spark_partition_id().alias("part"), "turn", "role", "text", "gone")
    schema = T.StructType(
        [
            T.StructField("conv", rows.schema["conv"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("no", T.LongType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("turns", T.ArrayType(T.LongType())),
            T.StructField("roles", T.ArrayType(T.StringType())),
            T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]):
        number = 0
        now = None  # the open chunk
        held, out = 0, []
        first = True  # the open conversation is the first of the part
        cut = False  # the open conversation has chunks before

        def chunk(row):
            return {"conv": row[0], "part": row[1], "no": number, "whole": False, "turns": [], "roles": [], "texts": []}

        def flush():
            nonlocal out
            made, out = pa.RecordBatch.from_pylist(out, schema=arrow), []
            return made

        chars = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    now, chars = chunk(row), 0
                elif row[0] != now["conv"]:
                    now["whole"] = not first and not cut
                    out.append(now)
                    held += chars
                    number += 1
                    first = cut = False
                    now, chars = chunk(row), 0
                elif len(now["roles"]) >= chunk_rows or chars > CHUNK_CHARS:
                    out.append(now)
                    held += chars
                    number += 1
                    cut = True
                    now, chars = chunk(row), 0
                if held > BATCH_CHARS or len(out) >= 4096:
                    yield flush()
                    held = 0
                if not row[5]:
                    now["turns"].append(row[2])
                    now["roles"].append(row[3])
                    now["texts"].append(row[4])
                    chars += len(row[4]) + len(row[3])
        if now is not None:
            out.append(now)
        if out:
            yield flush()

    return settle(dealt.mapInArrow(pack, schema), "chunks")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(RESULT).fields])


def _gaps(turns: list[int]) -> tuple:
    """(least, greatest, how many different) of the turns that are not null."""
    known = [t for t in turns if t is not None]
    return (min(known), max(known), len(set(known))) if known else (None, None, 0)


def _initials(roles: list[str]) -> bytes:
    return bytes(ROLES.get(role[:1], 3) for role in roles)


def repair_whole(chunk: dict) -> Iterator[dict]:
    """All of a conversation that is one chunk."""
    roles, texts = chunk["roles"], chunk["texts"]
    seen: set = set()
    symbols = bytes(row_symbol(r, t, seen) for r, t in zip(roles, texts, strict=True))
    letters, state = unroll(symbols, END, 0)
    audit = "".join(letters)
    low, high, different = _gaps(chunk["turns"])
    lines = repaired_lines([*letters, closing(state)], [*roles, ""], [*texts, ""], 0)
    audit += closing(state)
    yield {
        "conv_id": chunk["conv"],
        "gaps": as_long(high - low + 1 - different) if different else 0,
        "blank": symbols.count(BLANK),
        "duplicate": symbols.count(REPEATED),
        "truncated": sum(s < REPEATED and s & 1 for s in symbols),
        "illegal": illegal_pairs(_initials(roles)),
        "cost": cost_of(audit, symbols),
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _first_rows(chunk: dict) -> Iterator[dict]:
    """Digests of the different rows of a chunk, with their first place in it."""
    seen = {}
    for at, (role, text) in enumerate(zip(chunk["roles"], chunk["texts"], strict=True)):
        if text.rstrip(SPACE):
            seen.setdefault(_digest(role, text), at)
    for digest, at in seen.items():
        yield {"conv": chunk["conv"], "part": chunk["part"], "no": chunk["no"], "at": at, "digest": digest}


def _facts(chunk: dict) -> Iterator[dict]:
    seen: set = set()
    symbols = bytearray(row_symbol(r, t, seen) for r, t in zip(chunk["roles"], chunk["texts"], strict=True))
    for at in chunk["earlier"] or []:
        symbols[at] = REPEATED
    low, high, different = _gaps(chunk["turns"])
    yield {
        "conv": chunk["conv"],
        "part": chunk["part"],
        "no": chunk["no"],
        "symbols": bytes(symbols),
        "initials": _initials(chunk["roles"]),
        "low": low,
        "high": high,
        "different": different,
        "matrix": chunk_matrix(bytes(symbols)),
    }


def _in_order(df: DataFrame, schema: T.StructType, start: Callable[[], object], down: bool = False) -> DataFrame:
    """A stream over each conversation's chunks in order (or backwards).

    ``start()`` gives an object with ``add(row)``, which may return a row, and ``end()``, which may
    return a last one. A task holds one object and one batch, whatever the length.
    """
    arrow = to_arrow_schema(schema)
    way = [F.col("part").desc(), F.col("no").desc()] if down else [F.col("part"), F.col("no")]
    dealt = df.repartition(width(df.sparkSession), "conv").sortWithinPartitions(F.col("conv"), *way)

    def run(batches: Iterator[pa.RecordBatch]):
        now, state, out = None, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if state is None or row["conv"] != now:
                    out += [state.end()] if state else []
                    now, state = row["conv"], start()
                out.append(state.add(row))
            out = [r for r in out if r]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        out += [state.end()] if state else []
        out = [r for r in out if r]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


class Backwards:
    """Cheapest costs behind each chunk."""

    def __init__(self):
        self.ahead = END

    def add(self, row: dict) -> dict:
        given = {"part": row["part"], "no": row["no"], "ahead": list(self.ahead)}
        flat = row["matrix"]
        here = before([flat[4 * q : 4 * q + 4] for q in range(4)], self.ahead)
        self.ahead = tuple(min(c, FAR) for c in here)
        return given

    def end(self) -> None:
        return None


class Forwards:
    """The state in which each chunk is entered."""

    def __init__(self):
        self.state = 0

    def add(self, row: dict) -> dict:
        given = {"part": row["part"], "no": row["no"], "state": self.state}
        self.state = row["exits"][self.state]
        return given

    def end(self) -> None:
        return None


class Gathered:
    """One result row from the pieces of a conversation."""

    def __init__(self):
        self.sha = hashlib.sha256()
        self.audit: list[str] = []
        self.some = False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.last = None
        self.different = 0

    def add(self, row: dict) -> None:
        self.conv = row["conv"]
        self.audit.append(row["audit"])
        if row["lines"]:
            self.sha.update((("\n" if self.some else "") + row["repaired"]).encode())
            self.some = True
        symbols, initials = row["symbols"], row["initials"]
        self.sums["blank"] += symbols.count(BLANK)
        self.sums["duplicate"] += symbols.count(REPEATED)
        self.sums["truncated"] += sum(s < REPEATED and s & 1 for s in symbols)
        self.sums["cost"] += row["cost"]
        if initials:
            self.sums["illegal"] += illegal_pairs(initials) + (self.last is not None and (self.last, initials[0]) not in LEGAL)
            self.last = initials[-1]
        if row["different"]:
            self.different += row["different"] - (self.high == row["low"])  # one turn may stand in two chunks
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.state = row["exit"]

    def end(self) -> dict:
        last = closing(self.state)
        lines = repaired_lines([last], [""], [""], self.state)
        self.sha.update((("\n" if self.some and lines else "") + "\n".join(lines)).encode())
        return {
            "conv_id": self.conv,
            "gaps": as_long(self.high - self.low + 1 - self.different) if self.different else 0,
            **self.sums,
            "cost": self.sums["cost"] + INSERT * len(last),
            "audit": "".join(self.audit) + last,
            "repaired_sha256": self.sha.hexdigest(),
        }


def _exits(row: dict) -> Iterator[dict]:
    ahead = tuple(row["ahead"])
    yield {"conv": row["conv"], "part": row["part"], "no": row["no"], "exits": [unroll(row["symbols"], ahead, q)[1] for q in range(4)]}


def _piece(row: dict) -> Iterator[dict]:
    letters, state = unroll(row["symbols"], tuple(row["ahead"]), row["state"])
    lines = repaired_lines(letters, row["roles"], row["texts"], row["state"])
    audit = "".join(letters)
    kept = {k: row[k] for k in ("conv", "part", "no", "symbols", "initials", "low", "high", "different")}
    yield {**kept, "audit": audit, "cost": cost_of(audit, row["symbols"]), "lines": len(lines), "repaired": "\n".join(lines), "exit": state}


def _repair_cut(chunks: DataFrame, kind: T.DataType) -> DataFrame:
    """Conversations of several chunks, or of one that may have more."""
    place = [T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType())]
    fields = lambda text: T.StructType([*place, *T._parse_datatype_string(text).fields])
    rows = settle(_mapped(chunks, fields("at int, digest binary"), _first_rows), "digests")
    first = rows.groupBy("conv", "digest").agg(F.min(F.struct("part", "no")).alias("first")).select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), "first")
    again = rows.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")))
    again = again.filter(F.struct("part", "no") != F.col("first")).groupBy("part", "no").agg(F.collect_list("at").alias("earlier"))
    facts = "symbols binary, initials binary, low long, high long, different long, matrix array<long>"
    facts = settle(_mapped(chunks.join(again, ["part", "no"], "left"), fields(facts), _facts), "facts")
    short = T._parse_datatype_string("part int, no long, ahead array<long>")
    behind = settle(_in_order(facts.select("conv", "part", "no", "matrix"), short, Backwards, down=True), "ahead")
    known = facts.drop("matrix").join(behind, ["part", "no"])
    exits = _mapped(known.select("conv", "part", "no", "symbols", "ahead"), fields("exits array<int>"), _exits)
    entered = _in_order(exits, T._parse_datatype_string("part int, no long, state int"), Forwards)
    told = known.drop("conv").join(entered, ["part", "no"]).join(chunks.select("conv", "part", "no", "roles", "texts"), ["part", "no"])
    pieces = fields("symbols binary, initials binary, low long, high long, different long, audit string, cost long, lines long, repaired string, exit int")
    return _in_order(_mapped(told, pieces, _piece), _result(kind), Gathered)


def repair_rows(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults and cheapest repair of conversations: rows of conv, turn, tie, role, text, gone.

    One row per conv, null included: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit (K keep, R change of role, D delete, I insert, in order), repaired_sha256. Rows are
    taken by turn, nulls first, then by tie. Of cheapest audits the ASCII-least is given. Rows
    that are gone count for nothing; a conversation of none but those has zeros, an empty audit
    and the hash of the empty text. An empty table gives no rows.
    """
    kind = rows.schema["conv"].dataType
    chunks = chunks_of(rows, chunk_rows)
    whole = _mapped(chunks.filter("whole").select("conv", "turns", "roles", "texts"), _result(kind), repair_whole)
    return whole.unionByName(_repair_cut(chunks.filter("not whole").drop("whole"), kind))


def repair_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Damages the rows of conversations by their keys and repairs them; see ``damaged`` and ``repair_rows``.

    Columns but the four named ones are not read. Repeated rows are rows like others: the
    later ones are duplicates. A turn that is null, or several rows of one turn, are allowed.
    """
    return repair_rows(damaged(df, conv_id, turn, role, text), chunk_rows)


#: crc32 by a table of 256 entries made in eight steps, then the cheapest edits row by row
SQL = r"""
WITH RECURSIVE
bits(i, v, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT)),
                         lambda a, c: xor(t[(xor(a, c) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 20 AS damage
  FROM conversations, crc_table
),
after_damage AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, role AS role_was, text AS text_was
  FROM hashed, range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) copies(copy)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role_was, text_was) AS place FROM after_damage
),
judged AS (
  SELECT conv_id, turn, role, text, place,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated'
              ELSE 'none' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
  FROM placed
),
moves(state, initial, letters, cost, ahead, inserted, becomes) AS (
  SELECT p.start, e.initial, p.letters || e.letter, p.cost + e.cost, CASE WHEN e.letter = 'D' THEN p.state ELSE e.ahead END, p.inserted, CASE e.letter WHEN 'D' THEN NULL WHEN 'K' THEN '' ELSE e.becomes END
  FROM (VALUES (0, 0, '', 0, ''), (0, 2, 'I', 2, 'user:' || chr(10)), (0, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
               (1, 1, '', 0, ''), (1, 2, 'I', 2, 'user:' || chr(10)), (1, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
               (2, 2, '', 0, ''), (2, 3, 'I', 2, 'assistant:' || chr(10)),
               (3, 3, '', 0, ''), (3, 2, 'I', 2, 'user:' || chr(10))) p(start, state, letters, cost, inserted)
  JOIN (SELECT 0 AS state, 's' AS initial, 'K' AS letter, 0 AS cost, 1 AS ahead, '' AS becomes
        UNION ALL SELECT s, 'u', 'K', 0, 2, '' FROM (VALUES (0), (1), (3)) x(s)
        UNION ALL SELECT 2, 'a', 'K', 0, 3, ''
        UNION ALL SELECT s, i, 'D', 3, s, '' FROM range(4) x(s), (VALUES ('s'), ('u'), ('a'), ('o')) y(i)
        UNION ALL SELECT s, i, 'R', 2, CASE s WHEN 2 THEN 3 ELSE 2 END, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END
                  FROM range(4) x(s), (VALUES ('s'), ('u'), ('a'), ('o')) y(i)) e ON e.state = p.state
),
walk(conv_id, place, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'said': ''} FROM conversations
  UNION ALL
  SELECT w.conv_id, w.place + 1, m.ahead,
         min({'cost': w.best.cost + m.cost + CASE WHEN j.fault = 'truncated' AND m.becomes IS NOT NULL THEN 1 ELSE 0 END,
              'audit': w.best.audit || m.letters,
              'said': w.best.said || m.inserted || CASE WHEN m.becomes IS NULL THEN '' WHEN m.becomes = '' THEN j.role || ':' || j.text || chr(10) ELSE m.becomes || ':' || j.text || chr(10) END})
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.place + 1
  JOIN moves m ON m.state = w.state AND m.initial = j.initial AND (m.becomes IS NULL OR j.fault IN ('none', 'truncated'))
  GROUP BY w.conv_id, w.place, m.ahead
),
sizes AS (
  SELECT c.conv_id, count(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(place) FILTER (fault = 'blank') AS blank,
         count(place) FILTER (fault = 'duplicate') AS duplicate, count(place) FILTER (fault = 'truncated') AS truncated,
         count(place) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id
),
ended AS (
  SELECT w.conv_id, min({'cost': best.cost + e.cost, 'audit': best.audit || e.letters, 'said': best.said || e.inserted}) AS best
  FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.place
  JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 'I', 'assistant:' || chr(10)), (3, 0, '', '')) e(state, cost, letters, inserted)
    ON e.state = w.state
  GROUP BY w.conv_id
)
SELECT s.conv_id, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, e.best.cost AS cost, e.best.audit AS audit,
       sha256(left(e.best.said, length(e.best.said) - 1)) AS repaired_sha256
FROM sizes s JOIN ended e ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""
