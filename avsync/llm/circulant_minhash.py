"""Operator 12: near duplicates by circulant MinHash, bands and exact Jaccard verification.

One permutation spreads the shingles over Z_2^32, a second one gives every coordinate of the
signature: coordinate k is the least value of the second at the spread places shifted by k.
Both are bijections of 32-bit arithmetic, so no table is kept. Texts with equal sets are one
class and enter the bands once. Classes that share a band are candidates; they are first
linked with a leader of their band, and then only members of different components are
compared. Every link is confirmed on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from avsync.llm.common import OddTable, WordHashes, components, free_name, lower_raw, maybe_in, odd_between, odd_bitmap, width, word_slices, worker_cache
from avsync.session import settle

SIZE = 2  # words of a shingle
NUM, DEN = 80, 100
#: bands of six coordinates: a pair at the threshold shares none of 40 with a chance of 5 in a million
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: least equal coordinates of a linked pair: 4.5 standard deviations below the mean at the threshold, a
#: chance of 3 in a million for one pair, like that of the bands
LEAST_EQUAL = int(COORDINATES * NUM / DEN - 4.5 * (COORDINATES * NUM / DEN * (1 - NUM / DEN)) ** 0.5)
PIECE = 1 << 15
BLOCK, FACING = 256, 4096  # signatures that a task compares at a time
SPREAD = np.uint64(0xD6E8FEB86659FD93)
FIRST, SECOND, SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

# -- sets and signatures --------------------------------------------------------------------------


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; none without words."""
    hashes = worker_cache("circulant", WordHashes)
    parts = [hashes.of(words) for words in word_slices(lower_raw(text))]
    words = np.concatenate(parts) if len(parts) > 1 else parts[0]
    if not len(words):
        return words
    if len(words) < SIZE:
        return words * SHORT
    pairs = words[:-1] * FIRST + (words[1:] ^ (words[1:] >> np.uint64(29))) * SECOND
    return np.unique(pairs ^ (pairs >> np.uint64(32)))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of bytes per set: an 8-bit hash of each coordinate. Empty sets have rows of zeros."""
    sizes = np.array([len(s) for s in sets])
    flat = ((np.concatenate(sets) * SPREAD) >> np.uint64(32)).astype(np.uint32) if sizes.sum() else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    least = np.full((coordinates, len(sets)), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(flat), PIECE):
        places, mine = flat[at : at + PIECE], owner[at : at + PIECE]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        whose = mine[starts]
        y, t = np.empty_like(places), np.empty_like(places)
        for k in range(coordinates):
            np.add(places, np.uint32(k), out=y)  # the circular shift
            np.multiply(y, np.uint32(0x7FEB352D), out=y)
            np.right_shift(y, 15, out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x846CA68B), out=y)
            least[k, whose] = np.minimum(least[k, whose], np.minimum.reduceat(y, starts))
    out = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T
    out[sizes == 0] = 0
    return np.ascontiguousarray(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


def allowed(total: np.ndarray) -> np.ndarray:
    """The most shingles that only one of two linked sets has, of sizes that sum to ``total``."""
    return total - 2 * -(-NUM * total // (NUM + DEN))


# -- Spark ---------------------------------------------------------------------------------------------


def described(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, text, n, digest, signature and bitmap (``odd_bitmap``) of every row, from one reading of the texts."""
    given = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*given.schema.fields, T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("odd", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def describe(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()) for t in part.column(2)]
                signed = signatures(sets)
                more = [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([r.tobytes() for r in signed], pa.binary()), pa.array([odd_bitmap(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema=arrow)

    return settle(given.mapInArrow(describe, schema), "described")


def verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: sizes, signatures and bitmaps first, then the whole sets."""
    side = lambda x: reps.select(F.col("node").alias(x), *[F.col(c).alias(f"{c[0]}_{x}") for c in ("n", "signature", "odd")])
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM)

    def likely(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (batch.column(2), batch.column(3)))
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            unlike = np.array([odd_between(*both) for both in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(((x == y).sum(axis=1) >= LEAST_EQUAL) & (unlike <= allowed(total))))

    near = settle(near.select("a", "b", "s_a", "s_b", "n_a", "n_b", "o_a", "o_b").mapInArrow(likely, "a long, b long"), "likely")
    texts = settle(maybe_in(rows.select("row", "text"), "row", near.select("a").union(near.select("b"))), "texts")
    told = near.join(texts.select(F.col("row").alias("b"), F.col("text").alias("t_b")), "b").join(texts.select(F.col("row").alias("a"), F.col("text").alias("t_a")), "a")

    def confirm(batches: Iterator[pa.RecordBatch]):
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node, text):
            if node not in held:
                held[node] = shingle_set(text.as_py())
                if len(held) > 32:
                    held.popitem(last=False)
            held.move_to_end(node)
            return held[node]

        for batch in batches:
            a, b, t_a, t_b = batch.columns
            keep = [linked(of(a[i].as_py(), t_a[i]), of(b[i].as_py(), t_b[i])) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return settle(told.select("a", "b", "t_a", "t_b").mapInArrow(confirm, "a long, b long"), "links")


def _open(members: DataFrame, found: DataFrame | None, turn: int = 0) -> DataFrame:
    """band, key, node, n, label and a first member, for keys with members of several components.

    The first member is one of the key's least component, by a hash that differs between turns.
    """
    at = members.withColumn("label", F.col("node")) if found is None else members.join(found.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = settle(at.select("band", "key", "node", "n", "label"), "at")
    draw = F.xxhash64("node", F.lit(turn)).alias("draw")
    mixed = at.groupBy("key").agg(F.min(F.struct("label", draw, "node", "n")).alias("first"), F.max("label").alias("last")).filter("first.label < last")
    return settle(at.join(mixed.select("key", "first"), "key"), "open")


def _crossed(left: DataFrame, reps: DataFrame, block: int = BLOCK, facing: int = FACING) -> DataFrame:
    """Pairs (a, b) of one key and different components with like signatures and bitmaps, each pair once.

    Members that are not of the key's least component are dealt to blocks, and so are all its
    members; a task compares one block with another, whatever the key's size. A pair that
    shares several keys is given in the first of its bands only. The bitmaps bound the
    shingles that two sets do not share, so of the many pairs of a large group that the
    signatures take for links but are none, few become rows.
    """
    rows = left.join(reps.select("node", "signature", "odd"), "node").withColumn("other", F.col("label") != F.col("first.label"))
    sizes = left.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("label") != F.col("first.label")).alias("k"))
    sizes = sizes.select("key", F.ceil(F.col("k") / block).cast("int").alias("xs"), F.ceil(F.col("m") / facing).cast("int").alias("ys"))
    rows = settle(rows.join(sizes, "key"), "sides")
    spread = lambda n, of: F.explode(F.sequence(F.lit(0), F.col(of) - 1)) if n is None else F.pmod(F.xxhash64("node", F.lit(n)), F.col(of)).cast("int")
    columns = ["key", "band", "x", "y", "other", "node", "n", "label", "signature", "odd"]
    asking = rows.filter("other").withColumn("x", spread(1, "xs")).withColumn("y", spread(None, "ys")).select(*columns)
    asked = rows.withColumn("other", F.lit(False)).withColumn("y", spread(2, "ys")).withColumn("x", spread(None, "xs")).select(*columns)
    dealt = asking.union(asked).repartition(width(left.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compared(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        part = pa.Table.from_batches(group)
        band = part.column("band")[0].as_py()
        other, node, n, label = (part.column(c).to_numpy() for c in ("other", "node", "n", "label"))
        signed = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        odd = OddTable(part.column("odd").to_pylist())
        y = np.flatnonzero(~other)
        a, b = [node[:0]], [node[:0]]
        for i in np.flatnonzero(other):
            fits = y[(label[y] < label[i]) & (np.minimum(n[y], n[i]) * DEN >= np.maximum(n[y], n[i]) * NUM)]
            same = signed[fits] == signed[i]
            fits, same = fits[like := same.sum(axis=1) >= LEAST_EQUAL], same[like]
            fits = fits[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            fits = fits[odd.apart(odd, i, fits) <= allowed(n[fits] + n[i])]
            a.append(node[fits])
            b.append(np.full(len(fits), node[i]))
        return np.concatenate(a), np.concatenate(b)

    def compare(batches: Iterator[pa.RecordBatch]):
        key, group = None, []
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")])
            edges = (np.flatnonzero((np.diff(places) != 0).any(axis=0)) + 1).tolist()
            for at, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if at == end:
                    continue
                now = tuple(places[:, at])
                if now != key and group:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in compared(group)], ["a", "b"])
                    group = []
                key = now
                group.append(batch.slice(at, end - at))
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in compared(group)], ["a", "b"])

    return dealt.select("key", "x", "y", "band", "other", "node", "n", "label", "signature", "odd").mapInArrow(compare, "a long, b long")


def link_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 4, block: int = BLOCK, facing: int = FACING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, found): described rows, classes of equal sets (digest, node, least doc_id),
    and component of each class with a link (node, component).

    In a round each class is compared with a few leaders: in the first with one, the least of
    its bands, and then with one per band, drawn from the band's least component. So a large
    group of near copies needs pairs in number of its rows. What is left is compared in full,
    so that no candidate is left out. Links inside a component are not looked for.
    """
    rows = described(df, doc_id, text)
    classes = settle(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    reps = settle(rows.select("row", "n", "signature", "odd").join(classes.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"), "reps")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", ROWS * k + 1, ROWS)) for k in range(BANDS)])
    bands = reps.select("node", "n", F.posexplode(keys).alias("band", "key"))
    shared = settle(bands.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "shared")
    members = settle(maybe_in(bands, "key", shared).join(shared, "key"), "members")
    links = tried = found = None
    like = F.least("n", "first.n") * DEN >= F.greatest("n", "first.n") * NUM
    for turn in range(rounds):
        wishes = _open(members, found, turn).filter((F.col("label") != F.col("first.label")) & like).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
        wishes = wishes.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if turn == 0 else wishes.distinct()
        if tried is not None:
            wishes = wishes.join(tried, ["a", "b"], "left_anti")
        wishes = settle(wishes, "wishes")
        if wishes.isEmpty():
            break
        tried = wishes if tried is None else tried.union(wishes)
        more = verified(wishes, reps, rows)
        if more.isEmpty():
            break
        links = more if links is None else links.union(more)
        found = components(links)
    pairs = _crossed(_open(members, found), reps, block, facing)
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    pairs = settle(pairs, "pairs")
    if not pairs.isEmpty():
        more = verified(pairs, reps, rows)
        if not more.isEmpty():
            found = components(more if links is None else links.union(more))
    if found is None:
        found = classes.select("node", F.col("node").alias("component")).limit(0)
    return rows, classes, found


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 4, block: int = BLOCK, facing: int = FACING) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs of other characters than ASCII white space, A-Z in lower case; a row's set
    are its distinct pairs of consecutive words, a single word stands for itself. Rows with
    80 % of their united sets in common are linked; component_id is the smallest doc_id that
    links reach, kept tells whether it is the row's own. Rows without words (null, empty) are
    linked with nothing. Rows are rows, also where they share a doc_id: with different texts
    each has its own links. A null doc_id is passed over as a smallest one; a component of none
    but nulls has a null one and its rows are kept. Other columns are not read. Empty tables
    give no rows. Shingles and sets are told apart by 64 and 128-bit hashes.
    """
    rows, classes, found = link_classes(df, doc_id, text, rounds, block, facing)
    named = classes.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    named = settle(named, "named")
    top = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = settle(named.join(top, "component").select("digest", "component_id"), "known")
    some = rows.filter("n > 0").select("doc_id", "n", "digest").join(known, "digest").select("doc_id", "n", "component_id")
    none = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, one of each component: that with the smallest doc_id (nulls last).

    Rows without words all stay. All columns are given as they are.
    """
    number = free_name(df, "row_no")
    held = settle(df.withColumn(number, F.monotonically_increasing_id()), "held")
    order = F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("doc_id"), F.col(number).alias("row_no"))
    rows, classes, found = link_classes(held.select(order.alias("doc_id"), F.col(text).alias("text")))
    named = classes.join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least"))
    stay = named.select(F.col("least.row_no").alias(number)).union(rows.filter("n = 0").select("doc_id.row_no"))
    return held.join(stay, number, "left_semi").drop(number)


#: shared shingles are found by a prefix of each set, rare shingles first: linked sets share one there
SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS s
  FROM words, range(1, greatest(len(w), 2)) places(p) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
spread AS (SELECT s, count(*) AS df FROM shingles GROUP BY s),
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS place FROM shingles JOIN spread USING (s) JOIN sizes USING (doc_id)
),
prefix AS (SELECT doc_id, s, n FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS n_a, y.n AS n_b
  FROM prefix x JOIN prefix y ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
),
links AS (
  SELECT a, b FROM (
    SELECT a, b, n_a, n_b, count(*) AS common FROM candidates JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND x.s = y.s GROUP BY ALL
  ) WHERE 100 * common >= 80 * (n_a + n_b - common)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, node) AS (
  SELECT a, a FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node
),
lowest AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""
