"""Writers of the stored documents.

A document holds an array of rows of one video. Arrays are built per (video, part) of
``part_rows`` rows in order, so a video of any length is written without one group growing
with it; ordinary videos have part 0 only. The stored layout is: one JSON line per part,
``part`` in each, totals and numbers inside the items those of the whole video. Readers give
the same rows for every ``part_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.functions.text import format_mmss, watch_url
from avsync.functions.scoring import subject_of
from avsync.operators.aggregates import PART_ROWS, content_type_counts, dominant_type, sequence_no


def documents(
    rows: DataFrame,
    item: Column,
    order: list[str],
    name: str,
    totals: dict[str, Column],
    part_rows: int = PART_ROWS,
    numbered: bool = False,
) -> DataFrame:
    """(video_id, part, totals..., name array) with the items in order."""
    if not numbered:
        rows = sequence_no(rows, order, "_seq")
    rows = rows.withColumn("_item", item).withColumn("part", F.floor(F.col("_seq") / F.lit(part_rows)))
    parts = rows.groupBy("video_id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_item"))), lambda r: r["_item"]).alias(name)
    )
    sums = rows.groupBy("video_id").agg(*[c.alias(n) for n, c in totals.items()])
    return parts.join(sums, "video_id")


def write_json(docs: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = docs.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def keyframe_report(keyframes: DataFrame) -> DataFrame:
    """Report rows with seconds as double and scores to four places."""
    return keyframes.select(
        "video_id",
        format_mmss(F.col("t")).alias("timestamp"),
        F.col("t").cast("double").alias("timestamp_seconds"),
        "frame_path",
        "content_type",
        F.round("complexity", 4).alias("complexity_score"),
        F.round("clip_confidence", 4).alias("clip_confidence"),
    )


def write_keyframe_report(keyframes: DataFrame, path: str) -> None:
    """Rows below one folder per video."""
    write_json(keyframe_report(keyframes), path, ["video_id"])


def video_meta(videos: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Metadata per video: counts by type, subject of the dominant type, total."""
    counts = content_type_counts(keyframes)
    main = dominant_type(keyframes)
    total = keyframes.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("total_keyframes"))
    rows = videos.join(counts, "video_id", "left").join(main, "video_id", "left").join(total, "video_id", "left")
    return rows.select(
        F.col("video_id").cast("string").alias("video_id"),
        "title",
        "duration_seconds",
        format_mmss(F.col("duration_seconds")).alias("duration_formatted"),
        F.coalesce("total_keyframes", F.lit(0)).alias("total_keyframes"),
        subject_of(F.coalesce("dominant_type", F.lit("general"))).alias("subject"),
        watch_url(F.col("video_id").cast("string")).alias("source_url"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date_processed"),
        "content_type_counts",
    )


def write_video_meta(videos: DataFrame, keyframes: DataFrame, path: str) -> None:
    write_json(video_meta(videos, keyframes), path)


def intervention_documents(interventions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``interventions`` has the columns of the stored table plus ``ord`` for ties."""
    item = F.struct(
        "id", F.col("video_id").cast("string").alias("video_id"), "timestamp", "timestamp_formatted", "frame_path",
        "content_type", "complexity_score", "clip_confidence", "trigger_reason", "confidence", "transcript_context",
        "is_bookmarked", F.col("created_at").cast("string").alias("created_at"),
    )
    docs = documents(
        interventions, item, ["timestamp", "ord"], "interventions",
        {"total_interventions": F.count(F.lit(1))}, part_rows,
    )
    return docs.withColumn("created_at", F.current_timestamp().cast("string"))


def write_interventions(interventions: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    write_json(intervention_documents(interventions, part_rows), path)


def manifest_documents(segments: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Segments (video_id, chunk_id, timestamp, text, is_intervention, ...) as one document per video."""
    rest = [c for c in segments.columns if c != "video_id"]
    docs = documents(
        segments, F.struct(*rest), ["timestamp", "chunk_id"], "segments",
        {"total_segments": F.count(F.lit(1)), "intervention_count": F.count_if("is_intervention")}, part_rows,
    )
    return docs.withColumn("created_at", F.current_timestamp().cast("string"))


def write_manifest(segments: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    write_json(manifest_documents(segments, part_rows), path)


def manifest_item(number: Column) -> dict[str, Column]:
    """Names of the files of an intervention by its number."""
    folder = F.format_string("interventions/intervention_%04d/", number.cast("long"))
    return {
        "audio_file": F.concat(folder, F.lit("audio.mp3")),
        "description_file": F.concat(folder, F.lit("description.txt")),
        "frame_file": F.concat(folder, F.lit("frame.jpg")),
    }


def interventions_manifest_documents(interventions: DataFrame, mode: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Interventions (video_id, t, ord, content_type, explanation) numbered in time order."""
    numbered = sequence_no(interventions, ["t", "ord"], "_seq")
    item = F.struct(
        F.col("_seq").alias("intervention_id"),
        F.col("t").alias("timestamp"),
        format_mmss(F.col("t")).alias("timestamp_formatted"),
        "content_type",
        *[c.alias(n) for n, c in manifest_item(F.col("_seq")).items()],
        "explanation",
    )
    docs = documents(
        numbered, item, [], "interventions", {"total_interventions": F.count(F.lit(1))}, part_rows, numbered=True
    )
    return docs.withColumns(
        {"explanation_mode": F.lit(mode), "created_at": F.current_timestamp().cast("string")}
    )


def write_interventions_manifest(interventions: DataFrame, mode: str, path: str, part_rows: int = PART_ROWS) -> None:
    write_json(interventions_manifest_documents(interventions, mode, part_rows), path)


def transcript_documents(segments: DataFrame, part_rows: int = PART_ROWS, method: str = "api") -> DataFrame:
    """Segments (video_id, idx, start, duration, text) as transcript documents."""
    item = F.struct(
        F.col("idx").cast("long").alias("seq"),
        format_mmss(F.col("start")).alias("time"),
        "start",
        (F.col("start") + F.col("duration")).alias("end"),
        "duration",
        "text",
    )
    rows = segments.withColumn("_seq", F.col("idx").cast("long"))
    docs = documents(
        rows, item, [], "entries", {"entry_count": F.count(F.lit(1)).cast("int")}, part_rows, numbered=True
    )
    return docs.withColumns(
        {
            "video_id": F.col("video_id").cast("string"),
            "method": F.lit(method),
            "language": F.lit(None).cast("string"),
            "duration_seconds": F.lit(0.0),
            "error": F.lit(None).cast("string"),
        }
    )


def write_transcript(segments: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    write_json(transcript_documents(segments, part_rows), path)


def write_batch_report(report: DataFrame, path: str) -> None:
    write_json(report, path)


def write_artifacts(rows: DataFrame, path: str, order: str | None = None, files: int | None = None) -> None:
    """(video_id, id, kind, value) as JSON lines in few files, rows of a video near each other.

    Ids are stored whole, so two ids that begin alike stay two artifacts. Of several values
    of one key the one with the highest ``order`` is stored (without ``order`` the largest).
    Rows are dealt by video and id, so a video of any length is written by many tasks.
    """
    rows = rows.withColumn("_at", F.col(order) if order else F.lit(0))
    last = rows.groupBy(F.col("video_id").cast("string").alias("video_id"), "id", "kind").agg(
        F.max(F.struct("_at", "value"))["value"].alias("value")
    )
    spread = last.repartitionByRange(*([files] if files else []), "video_id", "id", "kind")
    write_json(spread.sortWithinPartitions("video_id", "id", "kind"), path)


def write_texts(texts: DataFrame, path: str, text: str = "text", order: str | None = None) -> None:
    """Explanations (video_id, id, mode, text)."""
    extra = [order] if order else []
    write_artifacts(texts.select("video_id", "id", F.col("mode").alias("kind"), F.col(text).alias("value"), *extra), path, order)


def write_snapshots(snapshots: DataFrame, path: str, answer: str = "answer", order: str | None = None) -> None:
    """Model answers (video_id, id, answer as JSON text)."""
    extra = [order] if order else []
    write_artifacts(
        snapshots.select("video_id", "id", F.lit("snapshot").alias("kind"), F.col(answer).alias("value"), *extra), path, order
    )


def write_metadata(interventions: DataFrame, path: str) -> None:
    """One metadata object per intervention: all its columns but the video, as JSON."""
    rest = F.struct(*[c for c in interventions.columns if c != "video_id"])
    write_artifacts(
        interventions.select("video_id", "id", F.lit("metadata").alias("kind"), F.to_json(rest).alias("value")), path
    )


def export_files(rows: DataFrame, path: str, ending: str = "txt") -> None:
    """Stored artifacts as single files ``<video_id>/interventions/<id>/<kind>.<ending>``, exactly their value.

    For viewers that want files; the store itself is ``write_artifacts``. Tasks write
    through the file system that ``path`` names.
    """
    from pyarrow import fs

    def write(batches):
        import pyarrow as pa

        system, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                folder = f"{base}/{row['video_id']}/interventions/{row['id']}"
                system.create_dir(folder, recursive=True)
                names.append(f"{folder}/{row['kind']}.{ending}")
                with system.open_output_stream(names[-1]) as out:
                    out.write(row["value"].encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    rows.select("video_id", "id", "kind", "value").mapInArrow(write, "path string").count()
