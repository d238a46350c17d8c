"""Readers of the stored documents; missing fields are tolerated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avsync import schemas
from avsync.functions.text import parse_clock, strip

FOLDER_ID = r"([^/]+)/[^/]+$"


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per entry: video_id, idx, start, end, text.

    The end is start + duration; a stored end is not used. Failed transcripts give no rows.
    idx is the stored number of the entry; documents of one part need not have it.
    """
    docs = _json(spark, path, schemas.TRANSCRIPT, multi_line)
    entries = docs.select("video_id", F.posexplode("entries").alias("at", "e"))
    entries = entries.withColumn("idx", F.coalesce("e.seq", F.col("at").cast("long")))
    start = F.coalesce("e.start", F.lit(0.0))
    return entries.select(
        "video_id",
        "idx",
        start.alias("start"),
        (start + F.coalesce("e.duration", F.lit(0.0))).alias("end"),
        F.coalesce("e.text", F.lit("")).alias("text"),
    )


def validate_segments(raw: DataFrame, pad_end: float = 0.0) -> DataFrame:
    """Rows with a text and a start that reads as a number; end falls back to start.

    ``raw`` is (video_id, idx, start, end, text) with start and end of any type.
    ``pad_end`` is added to the end; 1.0 gives the rows of the full run.
    """
    start = F.when(F.col("start").isNull(), F.lit(0.0)).otherwise(F.col("start").try_cast("double"))
    end = F.coalesce(F.col("end").try_cast("double"), start) + F.lit(float(pad_end))
    return raw.where("text IS NOT NULL").select("video_id", "idx", start.alias("start"), end.alias("end"), "text").where(
        "start IS NOT NULL"
    )


def read_keyframes(spark: SparkSession, path: str, multi_line: bool = True, video_id: Column | None = None) -> DataFrame:
    """One row per keyframe of a bare array or a wrapped object.

    Old rows have the clock text only: their seconds come from it, scores are 0.
    ``video_id`` defaults to the folder two levels above the file.
    """
    raw = _json(spark, path, schemas.KEYFRAMES, multi_line)
    raw = raw.withColumn("_path", F.translate(F.col("_metadata.file_path"), "\\", "/"))
    fields = ["timestamp", "timestamp_seconds", "frame_path", "content_type", "complexity_score", "clip_confidence"]
    flat = raw.where("keyframes IS NULL").select("_path", *fields)
    wrapped = raw.where("keyframes IS NOT NULL").select("_path", F.inline("keyframes"))
    rows = flat.unionByName(wrapped).where("timestamp IS NOT NULL OR timestamp_seconds IS NOT NULL")
    vid = F.regexp_extract("_path", r"([^/]+)/[^/]+/[^/]+$", 1) if video_id is None else video_id
    return rows.select(
        vid.alias("video_id"),
        F.coalesce("timestamp_seconds", parse_clock(F.col("timestamp"))).alias("t"),
        "timestamp",
        F.translate("frame_path", "\\", "/").alias("frame_path"),
        F.coalesce("content_type", F.lit("text")).alias("content_type"),
        F.coalesce("complexity_score", F.lit(0.0)).alias("complexity"),
        F.coalesce("clip_confidence", F.lit(0.0)).alias("clip_confidence"),
    )


def read_video_meta(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, path, schemas.VIDEO_META, multi_line)


def read_interventions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per intervention of the documents."""
    return _json(spark, path, schemas.INTERVENTIONS, multi_line).select(F.inline("interventions"))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, id, kind, value) as ``write_artifacts`` stored them, one row per key."""
    return spark.read.schema(schemas.ARTIFACT).json(path)


def read_snapshots(spark: SparkSession, path: str, stored: bool = False) -> DataFrame:
    """Model answers, the whole answer as VARIANT: video_id, id8, snapshot, error (and id if ``stored``).

    ``path`` names single files below video and short-id folders, or what
    ``write_snapshots`` stored.
    """
    snap = F.try_parse_json("value")
    value = [snap.alias("snapshot"), F.try_variant_get(snap, "$._error", "string").alias("error")]
    if stored:
        rows = read_artifacts(spark, path).where(F.col("kind") == "snapshot")
        return rows.select("video_id", "id", F.substring("id", 1, 8).alias("id8"), *value)
    return _whole_texts(spark, path).select(
        _folder("video_id", r"([^/]+)/interventions/[^/]+/[^/]+$"), _folder("id8", r"/interventions/([^/]+)/[^/]+$"), *value
    )


def read_explanations(spark: SparkSession, path: str, stored: bool = False) -> DataFrame:
    """(video_id, id8, mode, text) of texts by video, short id and mode (and id if ``stored``).

    ``path`` names single files ``<mode>.txt``, or what ``write_texts`` stored.
    """
    if stored:
        rows = read_artifacts(spark, path).where(~F.col("kind").isin("snapshot", "metadata"))
        return rows.select(
            "video_id", "id", F.substring("id", 1, 8).alias("id8"), F.col("kind").alias("mode"), F.col("value").alias("text")
        )
    raw = _whole_texts(spark, path)
    return raw.select(
        _folder("video_id", r"([^/]+)/interventions/[^/]+/[^/]+$"),
        _folder("id8", r"/interventions/([^/]+)/[^/]+$"),
        _folder("mode", r"/interventions/[^/]+/([^/]+)\.txt$"),
        F.col("value").alias("text"),
    )


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.withColumn("_path", F.col("_metadata.file_path"))


def _folder(name: str, pattern: str) -> Column:
    """Part of the path: from name=value folders where there are such, else by the pattern."""
    named = F.nullif(F.regexp_extract("_path", f"/{name}=([^/]+)/", 1), F.lit(""))
    return F.url_decode(F.coalesce(named, F.regexp_extract("_path", pattern, 1))).alias(name)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    return (
        spark.read.text(path)
        .select(strip(F.col("value")).alias("url"))
        .where((F.col("url") != "") & ~F.col("url").startswith("#"))
    )


IMAGE_FILES = "*.{jpg,jpeg,png,bmp,webp}"


def list_frames(spark: SparkSession, path: str, pattern: str = IMAGE_FILES) -> DataFrame:
    """Image files below a folder: path, length, modification time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def missing_frames(referenced: DataFrame, listed: DataFrame, path: str = "frame_path") -> DataFrame:
    """Referenced paths without a file."""
    return referenced.join(listed.select(F.col("path").alias(path)), path, "left_anti")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(concept, domain, explanation, ord) of a JSON object concept -> domain -> text."""
    docs = spark.read.text(path, wholetext=True)
    by_concept = F.from_json("value", "map<string,map<string,string>>")
    concepts = docs.select(F.posexplode(by_concept).alias("_c", "concept", "_d"))
    rows = concepts.select("_c", "concept", F.posexplode("_d").alias("_k", "domain", "explanation"))
    return rows.select("concept", "domain", "explanation", (F.col("_c").cast("long") * F.lit(1 << 32) + F.col("_k")).alias("ord"))
