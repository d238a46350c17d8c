"""Intervention points: frames whose picture the speech does not describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avsync.functions import scoring
from avsync.functions.text import format_mmss
from avsync.operators.folds import REDUNDANCY_SECONDS, suppress_close
from avsync.operators.ordered import row_limit
from avsync.operators.timejoin import MATCH_WINDOW, match_segment, without_segment


def scored_frames(
    keyframes: DataFrame,
    segments: DataFrame,
    limit: float | None = MATCH_WINDOW,
    deictic: list[str] | None = None,
    negative: list[str] | None = None,
    max_rows: float | None = None,
) -> DataFrame:
    """Keyframes (video_id, t, ord, complexity, ...) with seg_text, score, trigger_reason, confidence."""
    # phrases are looked for once per segment, not once per frame
    said = scoring.text_rules(F.col("text"), deictic, negative)
    spoken = segments.select("video_id", "idx", "start", "end", "text", *[c.alias(n) for n, c in said.items()])
    matched = match_segment(keyframes, spoken, limit, max_rows)
    rules = scoring.frame_rules({n: F.col(f"seg_{n}") for n in said}, F.col("complexity"))
    score = scoring.intervention_score(rules)
    return matched.withColumns(
        {
            "score": score,
            "trigger_reason": scoring.trigger_reason(rules),
            "confidence": scoring.confidence_bucket(score),
        }
    )


def detect_interventions(
    keyframes: DataFrame,
    segments: DataFrame,
    limit: float | None = MATCH_WINDOW,
    gap: float = REDUNDANCY_SECONDS,
    deictic: list[str] | None = None,
    negative: list[str] | None = None,
    max_rows: float | None = None,
) -> DataFrame:
    """Qualifying frames at least ``gap`` seconds apart, with transcript_context.

    ``keyframes`` has video_id, t, ord and complexity; further columns are kept.
    """
    max_rows = row_limit(keyframes, segments, segments, max_rows=max_rows)
    scored = scored_frames(keyframes, segments, limit, deictic, negative, max_rows)
    kept = suppress_close(
        scored.where(scoring.is_intervention(F.col("score"), F.col("complexity"))), gap, max_rows=max_rows
    )
    return without_segment(kept.withColumn("transcript_context", F.coalesce("seg_text", F.lit(""))))


def intervention_rows(points: DataFrame) -> DataFrame:
    """Detected points as rows of the stored table; ids derive from the point, so a rerun repeats them."""
    vid = F.col("video_id").cast("string")
    return points.select(
        F.md5(F.concat_ws("|", vid, F.col("t").cast("string"), F.col("ord").cast("string"))).alias("id"),
        vid.alias("video_id"),
        F.col("t").alias("timestamp"),
        format_mmss(F.col("t")).alias("timestamp_formatted"),
        "frame_path",
        "content_type",
        F.col("complexity").alias("complexity_score"),
        F.col("clip_confidence"),
        "trigger_reason",
        "confidence",
        "transcript_context",
        F.lit(False).alias("is_bookmarked"),
        F.current_timestamp().alias("created_at"),
        "ord",
    )
