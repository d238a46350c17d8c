"""First segment that holds a given text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avsync.functions.text import strip
from avsync.session import settle

GRAM = 12
WINDOW = 8
FILTER_BITS = 26  # 8 MB, however many texts are looked up; a fuller filter lets more rows through
MULTIPLIER = np.uint64(6364136223846793005)
MIXER = np.uint64(0x9E3779B97F4A7C15)


def clean(text: Column) -> Column:
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.lower(F.when(ends.rlike(r"(?U)\s"), strip(text)).otherwise(text))


def _key(text: Column) -> Column:
    """128 bits of hash, so that equal keys mean equal texts."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def marks(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and 0-based place of the smallest gram of k characters in every run of w grams.

    The leftmost of equal grams counts. A text shorter than one run has one run.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams = grams * MULTIPLIER + codes[j : j + n]
    grams ^= grams >> np.uint64(29)
    grams *= MIXER
    if w > 1:
        runs = np.lib.stride_tricks.sliding_window_view(grams, min(w, n))
        places = np.unique(np.arange(len(runs)) + runs.argmin(axis=1))
    else:
        places = np.arange(n)
    return grams[places].view(np.int64), places


def _bits(video: np.ndarray, k: np.ndarray, w: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each (video's hash, k, w, hash of a gram)."""
    key = (marks.view(np.uint64) ^ video.view(np.uint64)) + (k.astype(np.uint64) << np.uint64(4)) + w.astype(np.uint64)
    key = (key ^ (key >> np.uint64(31))) * MIXER
    key = (key ^ (key >> np.uint64(29))) * MULTIPLIER
    low = np.uint64((1 << FILTER_BITS) - 1)
    return np.stack([key >> np.uint64(64 - FILTER_BITS), (key >> np.uint64(8)) & low]).astype(np.int64)


def _filter_of(shapes: DataFrame) -> np.ndarray:
    """Words of 64 bits with the bits of all grams looked up set; at most 2^20 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(*[batch[c].to_numpy(zero_copy_only=False) for c in ("_vid", "_k", "_w", "_hash")]))
            masks = np.left_shift(np.int64(1), bits & 63)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(masks)], names=["word", "mask"])

    set_bits = shapes.select("_vid", "_k", "_w", "_hash").mapInArrow(run, "word long, mask long")
    found = set_bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy()
    return words


def _with_marks(rows: DataFrame, text: str, wanted: Broadcast | None = None) -> DataFrame:
    """One row per mark of ``text`` for the row's _k and _w, the text itself left out.

    With a filter of the marks looked up, only those that it holds (and a few others) are given.
    """
    kept = [f for f in rows.schema.fields if f.name != text]
    out = T.StructType([*kept, T.StructField("_hash", T.LongType()), T.StructField("_pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                marks(x, k, w)
                for x, k, w in zip(
                    batch[text].to_pylist(), batch["_k"].to_pylist(), batch["_w"].to_pylist(), strict=True
                )
            ]
            if not found:
                continue
            which = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
            hashes, places = np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found])
            if wanted is not None:
                words = wanted.value
                of = [batch[c].to_numpy(zero_copy_only=False)[which] for c in ("_vid", "_k", "_w")]
                hit = np.ones(len(which), dtype=bool)
                for bits in _bits(*of, hashes):
                    hit &= (words[bits >> 6] >> (bits & 63)) & 1 == 1
                which, hashes, places = which[hit], hashes[hit], places[hit]
            cols = [batch[f.name].take(pa.array(which)) for f in kept]
            cols.append(pa.array(hashes))
            cols.append(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    return rows.mapInArrow(run, out)


def find_segment_by_text(asked: DataFrame, segments: DataFrame, text: str = "text") -> DataFrame:
    """``asked`` (video_id, text) with seg_idx: lowest idx whose text equals or holds it, else 0.

    Texts are compared trimmed and lower-cased. A text is looked up by one of its short
    grams: a segment that holds the text holds that gram at a known offset. Only the
    distinct (gram, offset, length) of a video meet its segments; the part at that place
    is hashed, the lowest idx per part kept, and the texts met by equality. So no text is
    paired with every segment, and equal texts are looked up once. Grams of segments that
    no text is looked up by are left out before they are moved, by a filter that tasks hold.
    """
    asked = asked.withColumn("_raw", _key(F.coalesce(text, F.lit(""))))
    # one text of each kind is cleaned; several steps read them
    texts = asked.groupBy("video_id", "_raw").agg(F.first(F.coalesce(text, F.lit(""))).alias("_clean"))
    wanted = texts.select("video_id", "_raw", clean(F.col("_clean")).alias("_clean"), F.xxhash64("video_id").alias("_vid"))
    wanted = settle(wanted.withColumn("_len", F.length("_clean")), "texts")
    held = segments.select("video_id", F.col("idx").cast("long").alias("idx"), clean(F.col("text")).alias("_text"))

    sized = wanted.where("_len > 0").withColumns(
        {
            "_k": F.least(F.col("_len"), F.lit(GRAM)),
            "_w": F.when(F.col("_len") >= GRAM + WINDOW - 1, F.lit(WINDOW)).otherwise(F.lit(1)),
        }
    )
    head = F.substr(F.col("_clean"), F.lit(1), F.col("_k") + F.col("_w") - 1)
    shapes = (
        _with_marks(sized.select("video_id", "_vid", "_len", "_k", "_w", head.alias("_head")), "_head")
        .withColumnRenamed("_pos", "_off")
        .distinct()
    )
    kinds = sized.select("video_id", "_vid", "_k", "_w").distinct()
    marked = held.join(kinds, "video_id").where(F.length("_text") >= F.col("_k"))
    filled = segments.sparkSession.sparkContext.broadcast(_filter_of(shapes))
    marked = _with_marks(marked.select("video_id", "idx", "_vid", "_k", "_w", "_text"), "_text", filled)
    places = (
        marked.join(shapes.drop("_vid"), ["video_id", "_k", "_w", "_hash"])
        .select("video_id", "idx", (F.col("_pos") - F.col("_off") + 1).alias("_from"), "_len")
        .where("_from >= 1")
        .distinct()
    )
    parts = (
        places.join(held, ["video_id", "idx"])
        .where(F.length("_text") >= F.col("_from") + F.col("_len") - 1)
        .select("video_id", "_len", "idx", _key(F.substr(F.col("_text"), F.col("_from"), F.col("_len"))).alias("_key"))
    )
    first = parts.groupBy("video_id", "_len", "_key").agg(F.min("idx").alias("seg_idx"))
    found = sized.select("video_id", "_raw", "_len", _key(F.col("_clean")).alias("_key")).join(
        first, ["video_id", "_len", "_key"]
    )
    # an empty text is held by the first segment
    empty = wanted.where("_len = 0").join(held.groupBy("video_id").agg(F.min("idx").alias("seg_idx")), "video_id")
    found = found.select("video_id", "_raw", "seg_idx").unionByName(empty.select("video_id", "_raw", "seg_idx"))
    return (
        asked.join(found, ["video_id", "_raw"], "left")
        .withColumn("seg_idx", F.coalesce("seg_idx", F.lit(0)))
        .drop("_raw")
    )
