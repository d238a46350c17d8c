"""Similarity of embeddings: neighbours, per-video thresholds, prototypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avsync.operators import ordered
from avsync.operators.ordered import Cuts, find_cuts
from avsync.session import settle

SIMILARITY_FLOOR = 0.70
STD_WEIGHT = 1.5
NON_EDUCATIONAL = "non-educational"
SENT_BYTES = 64 << 20  # prototypes sent to tasks at a time


def dot(left: str | Column, right: str | Column) -> Column:
    """Dot product in double precision; NULL if a side is NULL."""
    pairs = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def neighbour_similarity(
    frames: DataFrame, order: str = "ord", cuts: Cuts | None = None, max_rows: float | None = None
) -> DataFrame:
    """Frames with the similarity to the frame before; NULL if either embedding is missing."""
    cuts = cuts or find_cuts(frames, ["video_id"], ["t", order], max_rows)
    seen = ordered.scan(frames, cuts, _prev=ordered.lag(F.col("embedding")))
    return seen.withColumn("similarity", dot("embedding", "_prev")).drop("_prev")


def similarity_stats(similar: DataFrame, floor: float = SIMILARITY_FLOOR, weight: float = STD_WEIGHT) -> DataFrame:
    """Mean, population deviation and change threshold per video."""
    return (
        similar.groupBy("video_id")
        .agg(F.avg("similarity").alias("mean_sim"), F.stddev_pop("similarity").alias("std_sim"))
        .withColumn("threshold", F.greatest(F.lit(float(floor)), F.col("mean_sim") - F.lit(weight) * F.col("std_sim")))
    )


def change_flags(similar: DataFrame, floor: float = SIMILARITY_FLOOR, weight: float = STD_WEIGHT) -> DataFrame:
    """Frames with ``changed``: similarity below the video's threshold."""
    stats = similarity_stats(similar, floor, weight).select("video_id", "threshold")
    return similar.join(stats, "video_id").withColumn(
        "changed", F.coalesce(F.col("similarity") < F.col("threshold"), F.lit(False))
    )


def category_means(prototypes: DataFrame) -> DataFrame:
    """(category, embedding): the element-wise mean of each category's prototypes, negatives left out.

    Sums are made in the tasks first, one number per category and element.
    """
    parts = prototypes.where("NOT is_negative").select("category", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("category", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("x"))
    return listed.select("category", F.transform("x", lambda p: p["x"]).alias("embedding"))


def prototype_classify(
    frames: DataFrame, prototypes: DataFrame, categories: list[str] | None = None, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """Frames with is_educational, label, confidence from prototype embeddings.

    ``prototypes`` is (category, prompt_no, is_negative, embedding). A category scores
    the mean of its prototypes; it wins over the largest negative. Equal scores go to the
    category first in ``categories``, or by name. The means, one vector a category, and the
    negatives are sent to tasks ``sent_bytes`` at a time: more of them are more passes over
    the frames, in which the best so far is carried along.
    """
    spark = frames.sparkSession
    means = category_means(prototypes).withColumn("is_negative", F.lit(False))
    if categories:
        means = means.where(F.col("category").isin(categories))
    negatives = prototypes.where("is_negative").select("category", F.col("embedding").cast("array<double>").alias("embedding"), "is_negative")
    known = settle(means.select("category", "embedding", "is_negative").unionByName(negatives), "prototypes")
    held = known.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-held // sent_bytes))
    state = [T.StructField("_top", T.DoubleType()), T.StructField("_label", T.StringType()), T.StructField("_worst", T.DoubleType())]
    schema = T.StructType([*frames.schema.fields, *state])
    rows = frames.withColumns({"_top": F.lit(None).cast("double"), "_label": F.lit(None).cast("string"), "_worst": F.lit(None).cast("double")})
    # equal vectors may be many: the row's number deals them as well
    dealt = known.withColumn("_part", F.pmod(F.xxhash64("category", "embedding", F.monotonically_increasing_id()), F.lit(passes)))
    dealt = settle(dealt, "dealt") if passes > 1 else dealt
    for part in range(passes):
        some = dealt.where(F.col("_part") == part).select("category", "embedding", "is_negative").toLocalIterator()
        sent = spark.sparkContext.broadcast(_matrices(some, categories))
        rows = rows.mapInArrow(_scored(sent), schema)
    wins = F.col("_top") > F.coalesce("_worst", F.lit(float("-inf")))
    seen = F.col("_top").isNotNull() | F.col("_worst").isNotNull()
    wins = F.coalesce(wins, F.lit(False))
    return rows.select(
        *frames.columns,
        F.when(seen, wins).alias("is_educational"),
        F.when(seen, F.when(wins, F.col("_label")).otherwise(NON_EDUCATIONAL)).alias("label"),
        F.when(seen, F.when(wins, F.col("_top")).otherwise(F.col("_worst"))).alias("confidence"),
    )


def _matrices(rows, categories: list[str] | None) -> tuple[list[str], np.ndarray | None, np.ndarray | None]:
    """(names, means, negatives) of some prototypes, names in the order that decides ties."""
    means, negatives = [], []
    for r in rows:
        (negatives if r["is_negative"] else means).append((r["category"], np.asarray(r["embedding"], dtype=np.float64)))
    means.sort(key=lambda m: categories.index(m[0]) if categories else m[0])
    stacked = lambda some: np.stack([v for _, v in some]) if some else None
    return [n for n, _ in means], stacked(means), stacked(negatives)


def _scored(sent):
    """Carries the best category and the largest negative of each frame on over some prototypes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, means, negatives = sent.value
        for batch in batches:
            lists = batch.column("embedding")
            there = np.flatnonzero(np.array(lists.is_valid()))
            top, worst = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_top", "_worst"))
            label = np.array(batch.column("_label").to_pylist(), dtype=object)
            if len(there):
                vec = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), -1)
                if means is not None:
                    # the mean of dot products is the dot product with the mean
                    scores = vec @ means.T
                    best = scores.argmax(axis=1)
                    value, name = scores.max(axis=1), np.array(names, dtype=object)[best]
                    old, was = top[there], label[there]
                    better = np.isnan(old) | (value > old) | ((value == old) & np.array([w is not None and n < w for n, w in zip(name, was, strict=True)]))
                    top[there] = np.where(better, value, old)
                    label[there] = np.where(better, name, was)
                if negatives is not None:
                    worst[there] = np.fmax(worst[there], (vec @ negatives.T).max(axis=1))
            rest = [batch.column(c) for c in batch.schema.names[:-3]]
            state = [pa.array(top, mask=np.isnan(top)), pa.array(label, pa.string()), pa.array(worst, mask=np.isnan(worst))]
            yield pa.RecordBatch.from_arrays([*rest, *state], names=batch.schema.names)

    return score
