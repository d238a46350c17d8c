"""Segments and interventions as manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avsync.operators.library import segments_with_interventions
from avsync.operators.timejoin import nearest_frame, nearest_segment, without_segment
from avsync.sources.sinks import interventions_manifest_documents, manifest_documents


def manifest_segments(
    segments: DataFrame,
    snapshots: DataFrame,
    texts: DataFrame | None = None,
    reasons: DataFrame | None = None,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Every segment as a manifest row, filled from the snapshot near its start.

    ``texts`` (snapshot_id, text) replaces the spoken text; ``reasons`` (snapshot_id,
    trigger_reason) comes from the interventions the snapshots belong to; ``answers``
    (snapshot_id, answer) is the model's stored answer, which ``vlm_data`` holds whole.
    """
    rows = segments_with_interventions(segments, snapshots)
    for extra in (texts, reasons, answers):
        if extra is not None:
            new = [c for c in extra.columns if c != "snapshot_id"]
            rows = rows.join(extra.select("snapshot_id", *[F.col(c).alias(f"_{c}") for c in new]), "snapshot_id", "left")
    spoken = F.col("text")
    text = F.coalesce("_text", spoken) if "_text" in rows.columns else spoken
    reason = F.col("_trigger_reason") if "_trigger_reason" in rows.columns else F.lit(None).cast("string")
    file = F.format_string("audio_segments/intervention_%04d.mp3", F.col("idx").cast("long"))
    return rows.select(
        "video_id",
        F.col("idx").alias("chunk_id"),
        F.col("start").alias("timestamp"),
        text.alias("text"),
        "is_intervention",
        F.when(F.col("is_intervention"), file).alias("audio_file"),
        spoken.alias("original_transcript"),
        F.col("_answer" if answers is not None else "snapshot_id").alias("vlm_data"),
        F.when(F.col("is_intervention"), F.coalesce(reason, F.lit("Unknown"))).alias("intervention_reason"),
    )


def full_manifest(segments: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    return manifest_documents(manifest_segments(segments, snapshots, **kw))


def interventions_rows(
    snapshots: DataFrame, segments: DataFrame, frames: DataFrame, explanations: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Snapshots (video_id, t, ord, snapshot_id, content_type) with spoken text, frame and explanation."""
    spoken = nearest_segment(snapshots, segments).withColumn("transcript_context", F.coalesce("seg_text", F.lit("")))
    spoken = without_segment(spoken)
    framed = nearest_frame(spoken, frames, existing).drop("distance")
    told = framed.join(explanations.select("snapshot_id", "explanation"), "snapshot_id", "left")
    return told.withColumn("explanation", F.coalesce("explanation", "transcript_context"))


def interventions_manifest(rows: DataFrame, mode: str = "explanatory") -> DataFrame:
    return interventions_manifest_documents(rows, mode)
