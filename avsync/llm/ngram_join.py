"""Operator 2: n-gram Jaccard join with a count-vector R-tree."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from avsync.llm.common import OddTable, components, free_name, give_back, lower_raw, maybe_in, odd_between, odd_bitmap, only_in, width
from avsync.session import passing, settle

WORDS = 5
#: similarity 3/4 as whole numbers: linked when DEN * |A and B| >= NUM * |A or B|
NUM, DEN = 3, 4
HOT_BOUND = 1 << 20  # entries of the list of frequent shingles, 8 MB
LEAF = 64
LEAST_GROUPS = 16
LEADERS = 4

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SLICE = 1 << 17  # bytes of a text whose words are hashed together
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BREAK = re.compile(rb"[ \t-\r]")
_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])  # a 64-bit number for each byte


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, in 64-bit arithmetic."""
    return tuple(_power_row(base, 2 * SLICE) for base in (int(_ODD[4]), pow(int(_ODD[4]), -1, 1 << 64)))


def _power_row(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


def _hashed(raw: bytes) -> np.ndarray:
    """Polynomial hashes of the words of a slice, as differences of running sums over its bytes."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff((~_SPACE[b]).view(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers()
    if len(b) > len(up):  # a word longer than a slice
        up, down = (_power_row(int(row[1]), len(b)) for row in (up, down))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODES[b] * up[: len(b)], out=sums[1:])
    return _mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _ODD[1])


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in order, without a Python object for a word."""
    parts, at = [], 0
    while at < len(raw):
        stop = _BREAK.search(raw, at + SLICE)
        end = stop.start() if stop else len(raw)
        parts.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending (of at least one)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a whole text as ascending 64-bit hashes.

    Fewer words than a shingle has: the whole sequence is one. No words: none.
    """
    h = word_hashes(lower_raw(text))
    if not len(h):
        return h
    m = min(words, len(h))
    n = len(h) - m + 1
    with np.errstate(over="ignore"):
        s = np.full(n, m, np.uint64)
        for j in range(m):
            s = s * _ODD[4] + h[j : j + n] * _ODD[j % 5]
    return distinct(_mix(s))


def prefix_length(n: int) -> int:
    """Two linked sets share a shingle among the first so many of each, in any common order."""
    return n - -(-NUM * n // DEN) + 1


def groups_of(n: int) -> int:
    """Groups of a count vector: a power of two, so that longer vectors fold onto shorter ones."""
    g = LEAST_GROUPS
    while g * 2 < n:
        g *= 2
    return g


def count_vector(tokens: np.ndarray) -> bytes:
    """How many shingles of the set fall into each hashed group: the point that the tree holds.

    One byte a group, or four where a count needs them.
    """
    g = groups_of(len(tokens))
    return _written(np.bincount((tokens & np.uint64(g - 1)).astype(np.int64), minlength=g))


def _written(counts: np.ndarray) -> bytes:
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def as_vector(raw: bytes, groups: int) -> np.ndarray:
    """A written count vector over so many groups, wide enough to add up."""
    return np.frombuffer(raw, "u1" if len(raw) == groups else "<u4").astype(np.int32)


def corner_groups(n: int) -> int:
    """Groups of the folded vector that goes along with a point into every cell: an eighth."""
    return max(LEAST_GROUPS, groups_of(n) // 8)


def corner_vector(vector: bytes, n: int) -> bytes:
    """The count vector folded to ``corner_groups``: its sums of minima bound those of the whole one."""
    return _written(fold(as_vector(vector, groups_of(n)), corner_groups(n)))


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """Counts over fewer groups (along the last axis)."""
    while vector.shape[-1] > groups:
        half = vector.shape[-1] // 2
        vector = vector[..., :half] + vector[..., half:]
    return vector


def needed(total: np.ndarray) -> np.ndarray:
    """The least overlap of two linked sets whose sizes sum to ``total``."""
    return -(-NUM * total // (NUM + DEN))


def allowed(total: np.ndarray) -> np.ndarray:
    """The most shingles that only one of two linked sets has, of sizes that sum to ``total``."""
    return total - 2 * needed(total)


# -- rows for documents ------------------------------------------------------------------


def _described(docs: DataFrame) -> DataFrame:
    """One pass that gives two kinds of rows: doc_id, n, digest, folded count
    vector and bitmap (``odd_bitmap``) of each document, and token, n of shingles that a task saw again and again (with the number of all it saw, once).

    Each task counts a few million shingles at a time; what it misses only makes the order
    of shingles less good.
    """

    def describe(rows: Iterator[pa.RecordBatch]):
        held, size, kind = [], 0, None
        give_back()

        def batch_of(ids, sizes, digests, tokens, corners=None, odds=None):
            points = [pa.array(v or [None] * len(sizes), pa.binary()) for v in (corners, odds)]
            columns = [pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.int64()), *points]
            return pa.RecordBatch.from_arrays(columns, names)

        def report():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(3, 2 * size // HOT_BOUND)
            tokens, n = found[often].view(np.int64).tolist(), n[often].tolist()
            return batch_of([None] * (len(n) + 1), [*n, size], [None] * (len(n) + 1), [*tokens, None])

        for batch in rows:
            kind = batch.schema.field(0).type
            sizes, digests, corners, odds = [], [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py())
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                corners.append(corner_vector(count_vector(tokens), len(tokens)))
                odds.append(odd_bitmap(tokens))
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 20:
                    yield report()
                    held, size = [], 0
            yield batch_of(batch.column(0), sizes, digests, [None] * len(sizes), corners, odds)
        if size:
            yield report()

    names = ["doc_id", "n", "digest", "token", "corner", "odd"]
    kinds = [T.LongType(), T.BinaryType(), T.LongType(), T.BinaryType(), T.BinaryType()]
    schema = T.StructType([docs.schema["doc_id"], *map(T.StructField, names[1:], kinds)])
    return docs.select("doc_id", "text").mapInArrow(describe, schema)


def _frequent(described: DataFrame) -> np.ndarray:
    """Shingles that make up over 1/HOT_BOUND of all: at most HOT_BOUND, sorted. Any list is right."""
    total = described.filter("digest is null and token is null").agg(F.sum("n")).first()[0] or 0
    counts = described.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    hot = counts.filter(F.col("n") > max(8, total // HOT_BOUND)).select("token")
    return np.sort(hot.toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, digest and the first shingles in the order (frequent last, by hash)."""
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    def describe(rows: Iterator[pa.RecordBatch]):
        table = shipped.value
        for batch in rows:
            digests, prefixes = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text)
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                k = prefix_length(len(tokens)) if len(tokens) else 0
                first = tokens[:k]
                if len(table) and k:
                    at = np.minimum(np.searchsorted(table, tokens), len(table) - 1)
                    frequent = table[at] == tokens
                    first = np.concatenate([tokens[~frequent], tokens[frequent]])[:k]
                prefixes.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names)

    fields = [docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    names = [f.name for f in fields]
    return docs.select("doc_id", "text").mapInArrow(describe, T.StructType(fields))


def _shingled(docs: DataFrame) -> DataFrame:
    """set (the doc_id), n, digest and the shingles themselves."""

    def describe(rows: Iterator[pa.RecordBatch]):
        for batch in rows:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in found], pa.int64()),
                    pa.array([hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in found], pa.binary()),
                    pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64())),
                ],
                ["set", "n", "digest", "shingles"],
            )

    schema = T.StructType([T.StructField("set", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "text").mapInArrow(describe, schema)


# -- pairs ---------------------------------------------------------------------------------


def _verified(pairs: DataFrame, docs: DataFrame, unique: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those pairs (a, b) whose sets are linked, by the sets themselves; only texts of pairs are shingled again."""
    ids = settle(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "ids")
    sets = settle(unique(_shingled(maybe_in(docs, "doc_id", ids))).select("set", "n", "shingles"), "shingled")
    left = sets.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("total"))
    return joined.filter(F.lit(DEN) * F.col("both") >= F.lit(NUM) * (F.col("total") - F.col("both"))).select("a", "b")


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those pairs (a, b) that may be linked by their sizes and bitmaps."""
    told = lambda x, column: points.select(F.col("set").alias(x), F.col(column).alias(f"{column[0]}{x}"))
    # sizes alone first: pairs that they exclude never carry a bitmap through a shuffle
    sized = pairs.select("a", "b").join(told("a", "n"), "a").join(told("b", "n"), "b").filter("least(na, nb) * 4 >= greatest(na, nb) * 3")
    sized = sized.join(told("a", "odd"), "a").join(told("b", "odd"), "b")

    def bound(rows: Iterator[pa.RecordBatch]):
        for batch in rows:
            unlike = [odd_between(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            may = np.array(unlike, np.int64) <= allowed(batch.column(2).to_numpy() + batch.column(3).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(may))

    return sized.select("a", "b", "na", "nb", "oa", "ob").mapInArrow(bound, pairs.select("a", "b").schema)


class Seen(set):
    """Pairs that a task has given, kept while there is room: most pairs come from many cells."""

    ROOM = 1 << 16

    def new(self, pairs: Iterator[tuple]) -> Iterator[tuple]:
        for pair in pairs:
            if pair not in self:
                if len(self) >= self.ROOM:
                    self.clear()
                self.add(pair)
                yield pair


Point = tuple  # set, label, n, corner, odd


class Leaf:
    """Points of a cell, at most LEAF of them: labels, sizes, bitmaps and folded count vectors, with the rectangle round them."""

    def __init__(self, points: list[Point]):
        self.sets = [p[0] for p in points]
        self.labels = np.array([p[1] for p in points])
        self.sizes = np.array([p[2] for p in points], np.int64)
        self.vectors = [as_vector(p[3], corner_groups(p[2])) for p in points]
        self.groups = np.array([len(v) for v in self.vectors])
        self.folded: dict[int, np.ndarray] = {}
        self.odd = OddTable([p[4] for p in points])

    def table(self, groups: int) -> np.ndarray:
        """Vectors over so few groups, a line for each point that has as many."""
        if groups not in self.folded:
            table = np.zeros((len(self.sets), groups), np.int32)
            for i in np.flatnonzero(self.groups >= groups):
                table[i] = fold(self.vectors[i], groups)
            self.folded[groups] = table
        return self.folded[groups]


def matched(x: Leaf, y: Leaf) -> Iterator[tuple]:
    """Pairs of different labels whose bitmaps and sum of coordinate minima allow a link, of one leaf or of two."""
    if x is not y:
        # the upper corners bound all sums between the leaves; folding keeps a corner a corner
        g = int(min(x.groups.min(), y.groups.min()))
        if int(np.minimum(x.table(g).max(0), y.table(g).max(0)).sum()) < needed(x.sizes.min() + y.sizes.min()):
            return
    for i in range(len(x.sets)):
        js = np.arange(i + 1, len(y.sets)) if x is y else np.arange(len(y.sets))
        n = x.sizes[i]
        js = js[(y.labels[js] != x.labels[i]) & (y.sizes[js] * DEN >= n * NUM) & (n * DEN >= y.sizes[js] * NUM)]
        js = js[y.odd.apart(x.odd, i, js) <= allowed(n + y.sizes[js])]
        if not len(js):
            continue
        groups = np.minimum(y.groups[js], x.groups[i])
        for g in np.unique(groups):
            at = js[groups == g]
            overlap = np.minimum(fold(x.vectors[i], int(g))[None, :], y.table(int(g))[at]).sum(1)
            for j in at[overlap >= needed(n + y.sizes[at])]:
                yield (x.sets[i], y.sets[j]) if x.sets[i] < y.sets[j] else (y.sets[j], x.sets[i])


def _tree_pairs(open_cells: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): pairs of different labels that their cells' trees of count vectors let through.

    Rows are sorted by cell, octave of size and label, and packed into leaves. A cell of one
    leaf is done where it is packed. Larger cells, and those at the edge of a partition, which
    may go on in the next, also give their leaves; these are joined by cell, leaf against
    leaf, unless sizes or labels exclude it. A row of a cell holds the bitmap and the folded vector
    only. The rectangles exclude leaves, the bitmaps points: of pairs just below the threshold they
    leave few, so that the pairs of a large group of like texts do not all become rows.
    """
    key = points.schema["set"].dataType
    sized = open_cells.join(points.select("set", "n"), "set")
    by_size = Window.partitionBy("token").orderBy("n", "set")
    near = F.coalesce(F.lag("n").over(by_size) * DEN >= F.col("n") * NUM, F.lit(False)) | F.coalesce(
        F.col("n") * DEN >= F.lead("n").over(by_size) * NUM, F.lit(False)
    )
    # a point without one of like size in its cell has no partner there
    sized = settle(sized.withColumn("near", near).filter("near").select("token", "set", "label"), "sized")
    rows = sized.join(points.select("set", "n", "corner", "odd"), "set").withColumn("octave", F.floor(F.log2("n")))
    order = [F.col(c) for c in ("token", "octave", "label", "n", "set")]
    rows = rows.repartitionByRange(width(points.sparkSession), *order).sortWithinPartitions(*order)
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    fields = [("a", key), ("b", key), ("token", long), ("leaf", long), ("least_n", long), ("most_n", long), ("least_label", key), ("most_label", key)]
    fields += [("sets", T.ArrayType(key)), ("labels", T.ArrayType(key)), ("sizes", longs), ("corners", T.ArrayType(T.BinaryType())), ("odds", T.ArrayType(T.BinaryType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        base, number, out, seen = TaskContext.get().partitionId() << 33, 0, [], Seen()

        def close(token, members, edge):
            nonlocal number
            parts = [members[i : i + LEAF] for i in range(0, len(members), LEAF)]
            for part in parts:
                out.extend({"a": a, "b": b} for a, b in seen.new(matched(*[Leaf(part)] * 2)))
                if edge or len(parts) > 1:
                    number += 1
                    sets, labels, sizes, corners, odds = (list(c) for c in zip(*part, strict=True))
                    out.append({
                        "token": token, "leaf": base + number, "least_n": min(sizes), "most_n": max(sizes), "least_label": min(labels), "most_label": max(labels),
                        "sets": sets, "labels": labels, "sizes": sizes, "corners": corners, "odds": odds,
                    })

        token, members, first = None, [], True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if members and row[0] != token:
                    close(token, members, first)
                    members, first = [], False
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out.clear()
                if len(members) == 64 * LEAF:  # what a task holds of a cell
                    close(token, members, True)
                    members, first = [], True
                token = row[0]
                members.append(row[1:])
        if members:
            close(token, members, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    packed = settle(rows.select("token", "set", "label", "n", "corner", "odd").mapInArrow(pack, schema), "packed")
    inner = packed.filter("a is not null").select("a", "b")
    leaves = packed.filter("leaf is not null").drop("a", "b")
    left = leaves.select(*[F.col(c).alias(f"{c}_") for c in leaves.columns])
    may = (
        (F.col("token") == F.col("token_"))
        & (F.col("leaf") < F.col("leaf_"))
        & (F.col("most_n") * DEN >= F.col("least_n_") * NUM)
        & (F.col("most_n_") * DEN >= F.col("least_n") * NUM)
        & ((F.col("least_label") != F.col("most_label_")) | (F.col("most_label") != F.col("least_label_")))
    )
    columns = ["sets", "labels", "sizes", "corners", "odds"]
    pairs = leaves.join(left, may).select(*columns, *[f"{c}_" for c in columns])

    def search(batches: Iterator[pa.RecordBatch]):
        seen = Seen()
        for batch in batches:
            found = []
            for both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = (Leaf(list(zip(*half, strict=True))) for half in (both[:5], both[5:]))
                found += seen.new(matched(x, y))
            kind = batch.schema.field("sets").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], kind) for k in (0, 1)], ["a", "b"])

    found = inner.union(pairs.mapInArrow(search, inner.schema))
    return found.distinct()


# -- the join ------------------------------------------------------------------------------


def link_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their class of equal sets, links that connect the components, and the component of each class.

    1. Equal sets become one class, named by its smallest doc_id.
    2. Classes are dealt to cells by the shingles of their prefix: any two linked classes
       share a cell. Very frequent shingles come last in the order, so few classes meet in a
       cell only because of a common passage. Cells with the same members are one.
    3. A few rounds link members of a cell with a leader of it: a linear number of pairs,
       bounded by bitmaps and verified by the sets. They join dense groups.
    4. Cells that still hold several components get an R-tree of count vectors; leaves are
       matched by rectangles, points by bitmaps and the sum of coordinate minima; pairs of one
       component are never looked at. What survives is verified by the sets.

    The links given are a subset that connects the components, not all pairs of the join:
    links inside a component that is one already are not looked for, so neither their number
    nor a document's partners can be read from them. No two linked documents end in
    different components. The doc_id tells rows of different texts apart and is not null;
    ``near_duplicates`` and ``one_of_each`` number the rows where it does not.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    described = settle(_described(docs), "described")
    plain = described.filter("digest is not null").select("doc_id", "n", "digest")
    hot = _frequent(described)
    names = settle(plain.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("set")).select("set").filter("set is not null"), "names")
    sets = settle(
        _prefixes(maybe_in(docs, "doc_id", names), hot).filter("size(prefix) > 0").groupBy("digest").agg(F.min("doc_id").alias("set"), F.first("prefix").alias("prefix")).filter("set is not null"),
        "sets",
    )
    # the filter is there for both readers of the rows, which then share one shuffle
    rows = sets.select("set", F.explode("prefix").alias("token")).filter("token is not null").repartition(width(spark), "token")
    marks = rows.groupBy("token").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("set")).alias("mark"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("mark2"), F.min("set").alias("least")
    )
    live = marks.filter("members > 1").groupBy("members", "mark", "mark2", "least").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "weight")
    cells = settle(rows.join(live, "token").select("token", "set", "weight"), "cells")
    live_sets = settle(cells.select("set").distinct(), "live")
    repeated = plain.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").take(1)

    def unique(rows: DataFrame) -> DataFrame:
        """One row per set, where rows share a doc_id: that of the text that the set stands for."""
        if not repeated:
            return rows
        return rows.join(sets.select("set", "digest"), ["set", "digest"], "left_semi").dropDuplicates(["set"])

    told = described.filter("digest is not null").select(F.col("doc_id").alias("set"), "n", "digest", "corner", "odd")
    points = settle(unique(maybe_in(told, "set", live_sets)).drop("digest"), "points")
    pair_schema = T.StructType([T.StructField("a", docs.schema["doc_id"].dataType), T.StructField("b", docs.schema["doc_id"].dataType)])
    links = spark.createDataFrame([], pair_schema)
    labels = live_sets.select("set", F.col("set").alias("label"))
    now = settle(cells.join(labels, "set").select("token", "set", "label", "weight"), "labelled")
    for r in range(rounds):
        leader = now.groupBy("token").agg(F.min(F.struct((F.col("set") if r == 0 else F.xxhash64("set", F.lit(r))).alias("by"), "set", "label")).alias("lead"))
        star = (
            now.join(leader, "token")
            .filter("lead.label != label")
            .groupBy(F.col("set").alias("x"), F.col("lead.set").alias("y"))
            .agg(F.sum("weight").alias("weight"))
            .withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.col("weight").desc(), "y")))
            .filter(F.col("k") <= LEADERS)
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        near = settle(_bounded(settle(star, "stars"), points), "near")
        links = settle(links.union(_verified(near, docs, unique)), "links")
        now = _still_open(cells, links)
    near = settle(_tree_pairs(now.select("token", "set", "label"), points), "near")
    links = settle(links.union(_verified(near, docs, unique)).distinct(), "links")
    return plain.join(sets.select("digest", "set"), "digest", "left").select("doc_id", "n", "set"), links, components(links)


def _still_open(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cells with the components of their members, without cells of one component."""
    found = components(links)
    named = settle(
        cells.join(found, cells["set"] == found["node"], "left").select("token", "set", F.coalesce("component", "set").alias("label"), "weight"), "named"
    )
    several = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("token")
    return settle(named.join(several, "token"), "open")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words stand between ASCII white space, A-Z as a-z; shingles have five; two documents
    link when 100 * |A and B| >= 75 * |A or B|. A null or empty text has no shingles and
    links with nothing. Where doc_ids repeat or are null, the rows are numbered and linked by
    their numbers: each text of one doc_id has its own links, and a row without doc_id links
    others without naming a component (null, if no row of it has a doc_id).
    Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    shared = df.groupBy(F.col(doc_id).alias("id")).agg(F.count("*").alias("k")).filter("k > 1 or id is null")
    if shared.take(1):
        number = F.monotonically_increasing_id().alias("row")
        rows = settle(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), number), "rows")
        classes, _, found = link_classes(rows, "row", "text")
        named = classes.withColumnRenamed("doc_id", "row").join(found, classes["set"] == found["node"], "left")
        named = settle(named.select("row", "n", F.coalesce("component", "set").alias("group")).join(rows.select("row", "doc_id"), "row"), "numbered")
        least = named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
        out = named.join(least, "group", "left")
        return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    classes, _, found = link_classes(df, doc_id, text)
    named = classes.join(found, classes["set"] == found["node"], "left")
    return named.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "set", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay: of each component the row of smallest doc_id, null last.

    Rows are told apart by a number that is written with them: of rows with one text, or
    linked ones, one stays, whether their ids are equal, different or null. Rows without
    shingles link with nothing; of those one stays for each doc_id, null being one.
    """
    row = free_name(df, "_row")
    rows = settle(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    some = F.col("n_shingles") > 0
    with passing(df.sparkSession):
        found = near_duplicates(rows, row, text).select(F.col(row).alias("row"), "n_shingles", "component_id")
        ids = rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"))
        named = ids.join(found, "row").select("row", "doc_id", F.when(some, F.col("component_id")).alias("group"), F.when(~some, F.col("doc_id")).alias("bare"), some.alias("some"))
        named = settle(named, "named", lasting=True)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")
    stay = settle(named.groupBy("some", "group", "bare").agg(first).select("first.row"), "stay")
    gone = named.join(stay, "row", "left_anti").select("row")
    return only_in(rows, row, stay, gone).select(*df.columns)
