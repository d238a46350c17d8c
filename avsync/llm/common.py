"""What several of the operators share: numbering rows in order, words, word hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avsync.session import settle, tune

#: a word of the contracts is a run of other bytes than these (``bytes.split()`` splits at the same six)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def pick(table: list[int] | list[float], at: Column) -> Column:
    """The entry of a short literal list (one per partition or shard) at a 0-based position."""
    return F.element_at(F.lit(list(table)), at.cast("int") + 1)


def numbered(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """Gapless numbers from 0 in the given order, without a one-task sort.

    Rows are dealt by ranges of the order, sorted there and written; one count per
    partition comes to the driver. The order should end in a key that tells rows apart, so
    that equal keys do not fill one range.
    """
    spark = df.sparkSession
    low = (1 << 33) - 1
    rows = settle(
        df.repartitionByRange(width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for p in range(max(counts, default=0) + 1):
        first.append(total)
        total += counts.get(p, 0)
    return rows.withColumn(name, pick(first, part) + F.col("__id").bitwiseAND(F.lit(low))).drop("__id")


FILTER_BITS = 1 << 26
BLOCK_BITS = 32_768  # bits of one bitmap of bitmap_construct_agg


def bit_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position % 8) == 1


def maybe_in(df: DataFrame, key: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be among ``ids`` (its first column): a one-bit filter of at most
    ``bits`` bits (8 MB), which is what is broadcast. No row whose key is there is lost; a
    join that follows sorts out the rest, which are few unless the ids fill the filter.
    """
    asked = df.withColumn("__at", _place(F.col(key), bits)).withColumn("__block", F.floor(F.col("__at") / BLOCK_BITS))
    found = asked.join(F.broadcast(_bitmaps(ids, bits)), "__block")
    return found.filter(bit_set(F.col("__bitmap"), F.col("__at") % BLOCK_BITS)).select(*df.columns)


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _bitmaps(ids: DataFrame, bits: int) -> DataFrame:
    """The bits set for the first column of ``ids``, in blocks."""
    at = ids.select(_place(F.col(ids.columns[0]), bits).alias("__at"))
    return at.groupBy(F.floor(F.col("__at") / BLOCK_BITS).alias("__block")).agg(F.bitmap_construct_agg(F.col("__at") % BLOCK_BITS).alias("__bitmap"))


def only_in(df: DataFrame, key: str, ids: DataFrame, others: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key, never null, is among ``ids``; those of all other rows are ``others`` (first columns).

    Two one-bit filters of at most ``bits`` bits are what is broadcast. A row that the filter
    of the others excludes stays where it is; only rows that both let through go to a join, so
    wide rows are not shuffled, however many there are.
    """
    asked = df.withColumn("__at", _place(F.col(key), bits)).withColumn("__block", F.floor(F.col("__at") / BLOCK_BITS))
    kinds = {}
    for kind, some in (("__in", ids), ("__out", others)):
        bitmaps = _bitmaps(some, bits).withColumnRenamed("__bitmap", kind)
        asked = asked.join(F.broadcast(bitmaps), "__block", "left")
        kinds[kind] = F.coalesce(bit_set(F.col(kind), F.col("__at") % BLOCK_BITS), F.lit(False))
    sure = asked.filter(kinds["__in"] & ~kinds["__out"]).select(*df.columns)
    unsure = asked.filter(kinds["__in"] & kinds["__out"]).select(*df.columns)
    return sure.union(unsure.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi").select(*df.columns))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach. ``links`` should be written already.

    Each round takes the smallest label of a node's neighbours and then the label of its
    label, so long chains halve; one count a round comes to the driver.
    """
    both = settle(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = settle(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = settle(lower, "lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = lower.join(up, "label").select("node", F.col("higher").alias("label"), (F.col("higher") != F.col("was")).alias("moved"))
        jumped = settle(jumped, "labels")
        moved = jumped.filter("moved").count()
        labels = jumped.drop("moved")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))


# -- sets by the evenness of hashed groups ------------------------------------------------


def odd_bits(n: int) -> int:
    """Bits of the bitmap of a set: a power of two, two to four for each member, or one to two
    in sets of over 256, whose bits that meet by chance are nearer to their mean."""
    bits = 128
    while bits < min(2 * n, max(512, n)):
        bits *= 2
    return bits


def odd_bitmap(members: np.ndarray) -> bytes:
    """Which hashed groups hold an odd number of the set's members (64-bit hashes).

    A member that only one of two sets has changes one bit, so the bits in which two bitmaps
    differ are never more than the members that the sets do not share.
    """
    bits = odd_bits(len(members))
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def as_odd(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def fold_odd(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap over fewer groups, in ``size`` numbers of 64 bits (along the last axis)."""
    while bitmap.shape[-1] > size:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of members that two sets do not share, by bitmaps of one size (along the last axis)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def odd_between(x: bytes, y: bytes) -> int:
    """``apart`` of two written bitmaps of any sizes."""
    x, y = as_odd(x), as_odd(y)
    size = min(len(x), len(y))
    return int(apart(fold_odd(x, size), fold_odd(y, size)))


class OddTable:
    """Bitmaps of many sets, folded to a size when it is asked for."""

    def __init__(self, bitmaps: list[bytes]):
        self.bitmaps = [as_odd(raw) for raw in bitmaps]
        self.sizes = np.array([len(b) for b in self.bitmaps])
        self.folded: dict[int, np.ndarray] = {}

    def of(self, size: int) -> np.ndarray:
        """A line for each set whose bitmap is of that size or larger; the others are zero."""
        if size not in self.folded:
            table = np.zeros((len(self.bitmaps), size), np.uint64)
            for i in np.flatnonzero(self.sizes >= size):
                table[i] = fold_odd(self.bitmaps[i], size)
            self.folded[size] = table
        return self.folded[size]

    def apart(self, other: OddTable, i: int, js: np.ndarray) -> np.ndarray:
        """``apart`` of set i of another table and those of this one numbered js."""
        out = np.zeros(len(js), np.int64)
        sizes = np.minimum(self.sizes[js], other.sizes[i])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            out[at] = apart(self.of(int(size))[js[at]], fold_odd(other.bitmaps[i], int(size)))
        return out


_HELD: dict = {}


def worker_cache(key: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing at a time, so that the caches
    of one operator do not stay while another works."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between stages, beside those of the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only the GNU library has it
        pass


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room (words are bytes)."""

    ROOM = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


AT_ONCE = 1 << 21  # bytes of text whose words are numbered together


def slices(raw: bytes, size: int = AT_ONCE) -> Iterator[list[bytes]]:
    """Parts of a text, each a list of its own, cut at ASCII white space."""
    at = 0
    while len(raw) - at > size:
        end = at + size
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield [raw[at:end]]
        at = end
    yield [raw[at:]]


def word_slices(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII white space, of a slice at a time: a very long text never
    stands in memory as one list of words."""
    for part in slices(raw, size):
        yield part[0].split()


def together(raws: Iterator[bytes], size: int = AT_ONCE) -> Iterator[list[bytes]]:
    """Texts in order, some at a time; one longer than ``size`` stands alone."""
    held, n = [], 0
    for raw in raws:
        if held and n + len(raw) > size:
            yield held
            held, n = [], 0
        held.append(raw)
        n += len(raw)
    if held:
        yield held


def numbered_words(raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of some texts (one may be empty), which of them stands at each place, and
    where each text's words end. A text's first and last word may be the empty one."""
    held = pa.array(raws, pa.large_binary())
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raws), held.buffers()))
    words = lists.flatten().dictionary_encode()
    different = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return different, words.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[1:]


def lower_raw(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case, other letters as they are; null is empty."""
    return text.encode("utf-8").lower() if text else b""
