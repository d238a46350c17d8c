"""Keyframe selection from scored, embedded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avsync.functions.scoring import frame_targets, is_blank, keyframe_confidence
from avsync.functions.text import format_mmss, frame_name
from avsync.operators import folds, vectors
from avsync.operators.aggregates import sequence_no
from avsync.operators.ordered import find_cuts, row_limit
from avsync.session import settle


def scenes_of(
    frames: DataFrame,
    min_gap: float = folds.MIN_SCENE_GAP,
    floor: float = vectors.SIMILARITY_FLOOR,
    weight: float = vectors.STD_WEIGHT,
    max_rows: float | None = None,
) -> DataFrame:
    """Frames (video_id, t, ord, embedding, ...) with scene_id, the embedding left out.

    Embeddings are read once: what follows works on the narrow rows written here.
    """
    max_rows = row_limit(frames, max_rows=max_rows)
    cuts = find_cuts(frames, ["video_id"], ["t", "ord"], max_rows)
    similar = settle(vectors.neighbour_similarity(frames, cuts=cuts).drop("embedding"), "similar")
    flags = vectors.change_flags(similar.select("video_id", "t", "ord", "similarity"), floor, weight)
    begins = folds.scene_boundaries(flags, min_gap, max_rows=max_rows)
    return settle(folds.assign_scenes(similar.drop("similarity"), begins, cuts=cuts), "scenes")


def select_keyframes(
    frames: DataFrame,
    videos: DataFrame,
    min_gap: float = folds.MIN_SCENE_GAP,
    max_gap: float = folds.MAX_FRAME_GAP,
    floor: float = vectors.SIMILARITY_FLOOR,
    weight: float = vectors.STD_WEIGHT,
    max_rows: float | None = None,
) -> DataFrame:
    """Keyframes (video_id, idx, timestamp, t, frame_path, content_type, complexity, clip_confidence, ord).

    ``frames`` is (video_id, t, ord, embedding, complexity, is_educational, label), blank
    ones already dropped; ``videos`` is (video_id, duration_seconds).
    """
    max_rows = row_limit(frames, max_rows=max_rows)
    small = ["video_id", "t", "ord", "complexity", "is_educational", "label"]
    scenes = scenes_of(frames, min_gap, floor, weight, max_rows).select(*small, "scene_id")
    first = settle(folds.select_per_scene(scenes, min_gap, max_gap, max_rows=max_rows).select(*small), "picked")

    targets = videos.select("video_id", frame_targets(F.col("duration_seconds")).alias("_n")).select("video_id", "_n.*")
    counted = targets.join(first.groupBy("video_id").agg(F.count(F.lit(1)).alias("_have")), "video_id", "left")
    short = counted.where(F.coalesce("_have", F.lit(0)) < F.col("target_min")).select("video_id", "target_min")
    # only videos that have too few frames enter the fill; they hold fewer than target_min
    chosen = short.join(first.select("video_id", "t", "ord"), "video_id", "left").select(
        "video_id", "t", "ord", "target_min"
    )
    rest = (
        scenes.where("is_educational")
        .join(short.select("video_id"), "video_id", "left_semi")
        .join(first.select("video_id", "t", "ord"), ["video_id", "t", "ord"], "left_anti")
    )
    added = folds.fill_to_minimum(
        chosen, rest.select("video_id", "t", "ord", "complexity"), min_gap / 2, max_rows=max_rows
    )
    extra = scenes.join(added.select("video_id", "t", "ord"), ["video_id", "t", "ord"], "left_semi").select(*small)
    final = first.unionByName(extra).join(targets.select("video_id", "target_max"), "video_id")
    final = folds.trim_to_maximum(final, F.col("target_max"), max_rows=max_rows).drop("target_max")
    numbered = sequence_no(final, ["t", "ord"], "idx", max_rows=max_rows)
    return numbered.select(
        "video_id",
        "idx",
        format_mmss(F.col("t")).alias("timestamp"),
        "t",
        frame_name(F.col("idx"), F.col("t")).alias("frame_path"),
        F.col("label").alias("content_type"),
        F.round("complexity", 4).alias("complexity"),
        keyframe_confidence(F.col("is_educational"), F.col("complexity")).alias("clip_confidence"),
        "ord",
    )


def usable_frames(frames: DataFrame, std: str = "std", score: str = "complexity") -> DataFrame:
    """Frames that are not blank; the filter comes before any embedding work."""
    return frames.where(~is_blank(F.col(std), F.col(score)))
