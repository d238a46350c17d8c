"""Queries on sources and sinks (A): written from the given tables, read back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from avsync.operators.aggregates import table_counts
from avsync.plans import detect, manifest
from avsync.sources import catalog, files, sinks
from workload.base import long, query, r6
from workload.jobs import SCORED, detected


@query(
    "A1_read_transcripts",
    """SELECT CAST(video_id AS VARCHAR) AS video_id, idx, start, round("end", 6) AS end_s, md5(text) AS text FROM segments""",
)
def _(t):
    path = t.new_dir("transcripts")
    sinks.write_transcript(t.segments, path)
    rows = files.read_transcripts(t.spark, path, multi_line=False)
    return rows.select("video_id", long("idx"), "start", r6("end", "end_s"), F.md5("text").alias("text"))


@query(
    "A1_read_transcripts_parts",
    """SELECT CAST(video_id AS VARCHAR) AS video_id, idx, start, round("end", 6) AS end_s, md5(text) AS text FROM segments""",
)
def _(t):
    # small parts change the files, not what is read
    path = t.new_dir("transcripts")
    sinks.write_transcript(t.segments, path, part_rows=3)
    rows = files.read_transcripts(t.spark, path, multi_line=False)
    return rows.select("video_id", long("idx"), "start", r6("end", "end_s"), F.md5("text").alias("text"))


def _video_id():
    return F.regexp_extract("_path", r"video_id=([^/]+)/", 1)


_KEYFRAME_ROWS = """SELECT CAST(video_id AS VARCHAR) AS video_id, t,
    printf('%02d:%02d', CAST(floor(t / 60) AS BIGINT), CAST(floor(t) AS BIGINT) % 60) AS timestamp,
    frame_path, content_type FROM keyframes"""


@query("A2_read_keyframes", _KEYFRAME_ROWS)
def _(t):
    path = t.new_dir("keyframes")
    sinks.write_keyframe_report(t.keyframes, path)
    rows = files.read_keyframes(t.spark, path, multi_line=False, video_id=_video_id())
    return rows.select("video_id", "t", "timestamp", "frame_path", "content_type")


_META = """SELECT CAST(d.video_id AS VARCHAR) AS video_id, 'video ' || d.video_id AS title, duration_seconds,
    CAST((SELECT count(*) FROM keyframes k WHERE k.video_id = d.video_id) AS BIGINT) AS total_keyframes,
    (SELECT string_agg(content_type || '=' || n, '|' ORDER BY content_type) FROM (SELECT content_type, count(*) AS n FROM keyframes k
    WHERE k.video_id = d.video_id GROUP BY 1)) AS counts FROM keyframe_durations d"""
_META_ROWS = {"keyframe_durations": "SELECT video_id, CAST(floor(max(t) + 2) AS INTEGER) AS duration_seconds FROM keyframes GROUP BY video_id"}


def _meta_written(t):
    path = t.new_dir("meta")
    ends = t.keyframes.groupBy("video_id").agg((F.max("t") + 2).cast("int").alias("duration_seconds"))
    videos = ends.withColumn("title", F.concat(F.lit("video "), F.col("video_id").cast("string")))
    sinks.write_video_meta(videos, t.keyframes, path)
    return path


@query("A3_read_video_meta", _META, _META_ROWS)
def _(t):
    meta = files.read_video_meta(t.spark, _meta_written(t), multi_line=False)
    entries = F.array_sort(F.transform(F.map_entries("content_type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return meta.select(
        "video_id", "title", long("duration_seconds"), long("total_keyframes"), F.array_join(entries, "|").alias("counts")
    )


@query(
    "A11_write_video_meta",
    """SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(duration_seconds AS BIGINT) AS duration_seconds,
    printf('%02d:%02d', duration_seconds // 60, duration_seconds % 60) AS duration_formatted,
    (SELECT count(*) FROM keyframes k WHERE k.video_id = d.video_id) AS total_keyframes FROM keyframe_durations d""",
    _META_ROWS,
)
def _(t):
    raw = t.spark.read.json(_meta_written(t))
    return raw.select("video_id", long("duration_seconds"), "duration_formatted", long("total_keyframes"))


def _points(t):
    return detect.intervention_rows(detected(t))


_POINT_ROWS = """SELECT CAST(p.video_id AS VARCHAR) AS video_id, p.t AS timestamp, p.trigger_reason, p.confidence, k.content_type
    FROM points p JOIN keyframes k ON k.ord = p.ord"""


@query("A4_read_interventions", _POINT_ROWS, SCORED)
def _(t):
    path = t.new_dir("interventions")
    sinks.write_interventions(_points(t), path)
    rows = files.read_interventions(t.spark, path, multi_line=False)
    return rows.select("video_id", "timestamp", "trigger_reason", "confidence", "content_type")


@query(
    "A12_write_interventions",
    """SELECT CAST(video_id AS VARCHAR) AS video_id, count(*) AS total_interventions, count(*) AS listed FROM points GROUP BY video_id""",
    SCORED,
)
def _(t):
    path = t.new_dir("interventions")
    sinks.write_interventions(_points(t), path)
    docs = t.spark.read.json(path)
    return docs.select("video_id", "total_interventions", F.size("interventions").cast("long").alias("listed"))


@query(
    "A5_read_snapshots",
    """SELECT CAST(conv_id AS VARCHAR) AS video_id, left(md5(CAST(turn AS VARCHAR)), 8) AS id8, role AS content_type FROM conversations""",
)
def _(t):
    path = t.new_dir("snapshots")
    c = t.read("conversations")
    answer = F.to_json(F.struct(F.col("role").alias("content_type"), F.struct(F.col("text").alias("note")).alias("visual_analysis")))
    id8 = F.substring(F.md5(F.col("turn").cast("string")), 1, 8)
    sinks.write_snapshots(c.select(F.col("conv_id").alias("video_id"), id8.alias("id"), answer.alias("answer")), path)
    rows = files.read_snapshots(t.spark, path, stored=True)
    return rows.select("video_id", "id8", F.try_variant_get("snapshot", "$.content_type", "string").alias("content_type"))


_TEXTS = """SELECT CAST(conv_id AS VARCHAR) AS video_id, left(md5(CAST(turn AS VARCHAR)), 8) AS id8,
    CASE turn % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'explanatory' ELSE 'detailed' END AS mode, md5(text) AS text FROM conversations"""


def _artifacts(t):
    path = t.new_dir("texts")
    mode = F.expr("CASE turn % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'explanatory' ELSE 'detailed' END")
    rows = t.read("conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.md5(F.col("turn").cast("string")).alias("id"), mode.alias("mode"), "text"
    )
    sinks.write_texts(rows, path)
    return path


@query("A6_read_explanations", _TEXTS)
def _(t):
    rows = files.read_explanations(t.spark, _artifacts(t), stored=True)
    return rows.select("video_id", "id8", "mode", F.md5("text").alias("text"))


@query("A17_write_artifacts", "SELECT mode, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (" + _TEXTS.replace("md5(text) AS text", "text") + ") GROUP BY mode")
def _(t):
    rows = t.spark.read.json(_artifacts(t))
    return rows.groupBy(F.col("kind").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query(
    "A17_write_artifacts_of_one_short_id",
    """SELECT CAST(user_id % 100 AS VARCHAR) AS video_id, 'same-beginning-' || (event_id % 1000) AS id, event_type AS mode,
    'text ' || max(event_id) AS text FROM events GROUP BY ALL""",
)
def _(t):
    # ids that agree in their first eight letters, and several texts per key: the latest counts
    path = t.new_dir("texts")
    e = t.read("events").select(
        (F.col("user_id") % 100).alias("video_id"),
        F.concat(F.lit("same-beginning-"), (F.col("event_id") % 1000).cast("string")).alias("id"),
        F.col("event_type").alias("mode"),
        F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"),
        "event_id",
    )
    sinks.write_texts(e, path, order="event_id")
    return files.read_explanations(t.spark, path, stored=True).select("video_id", "id", "mode", "text")


@query("A7_read_url_list", "SELECT url FROM pages")
def _(t):
    path = t.new_dir("urls")
    p = t.read("pages")
    lines = p.select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.lit("   "), F.lit("# note"))).alias("value"))
    lines.write.text(path)
    return files.read_url_list(t.spark, path)


def _database(t):
    place = t.new_dir("tables")
    name = "avsync_" + re.sub(r"\W", "", place.rsplit("-", 1)[1])
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{place}'")
    catalog.create_tables(t.spark, name, location=place)
    return name


@query(
    "A8_catalog_tables",
    """SELECT 'videos' AS table_name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'interventions', count(*) FROM events
    UNION ALL SELECT 'explanations', count(*) FROM explanations UNION ALL SELECT 'transcripts', count(*) FROM segments""",
)
def _(t):
    db = _database(t)
    rows = {
        "videos": t.read("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")),
        "interventions": t.interventions.select(
            "id", "video_id", F.col("t").alias("timestamp"), "content_type", F.col("created_at").cast("timestamp").alias("created_at")
        ),
        "explanations": t.explanations.select(F.col("id").cast("int").alias("id"), "intervention_id", "text_explanation", "output_mode"),
        "transcripts": t.segments.select(
            F.col("video_id").cast("string").alias("video_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), "text"
        ),
    }
    for name, df in rows.items():
        catalog.append_rows(t.spark, f"{db}.{name}", df)
    return catalog.count_tables(t.spark, db)


_FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@query(
    "A9_list_frames",
    "SELECT unnest(string_split('" + _FILES + "', ' ')) AS path, true AS there UNION ALL SELECT DISTINCT event_type || 's', false FROM events",
)
def _(t):
    # the given tables are the files at hand; names referenced without a file are reported
    listed = files.list_frames(t.spark, t.folder, "*.parquet").select(
        F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("path"), "length"
    )
    asked = t.read("events").select(F.concat("event_type", F.lit("s")).alias("frame_path")).distinct().unionByName(
        t.read("region").select(F.lit("region").alias("frame_path"))
    )
    missing = files.missing_frames(asked.distinct(), listed)
    return listed.select("path", (F.col("length") > 0).alias("there")).unionByName(
        missing.select(F.col("frame_path").alias("path"), F.lit(False).alias("there"))
    )


@query(
    "A10_write_keyframe_report",
    """SELECT video_id, count(*) AS n, round(sum(t), 6) AS seconds FROM keyframes GROUP BY video_id""",
)
def _(t):
    path = t.new_dir("keyframes")
    sinks.write_keyframe_report(t.keyframes, path)
    rows = t.spark.read.json(path)
    return rows.groupBy(long("video_id")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("timestamp_seconds"), "seconds")
    )


@query(
    "A13_write_manifest",
    """SELECT video_id, count(*) AS total_segments, count(*) AS listed, count(*) FILTER (EXISTS (SELECT 1 FROM snapshots n
    WHERE n.video_id = s.video_id AND abs(n.t - s.start) <= 30)) AS intervention_count FROM segments s GROUP BY video_id""",
)
def _(t):
    path = t.new_dir("manifest")
    sinks.write_manifest(manifest.manifest_segments(t.segments, t.snapshots), path)
    docs = t.spark.read.json(path)
    return docs.select("video_id", "total_segments", F.size("segments").cast("long").alias("listed"), "intervention_count")


@query(
    "A14_write_interventions_manifest",
    """SELECT video_id, count(*) AS total_interventions, printf('interventions/intervention_%04d/frame.jpg', count(*) - 1) AS last_frame,
    'brief' AS explanation_mode FROM snapshots GROUP BY video_id""",
)
def _(t):
    path = t.new_dir("interventions-manifest")
    sinks.write_interventions_manifest(t.snapshots.withColumn("explanation", F.lit("told")), "brief", path)
    docs = t.spark.read.json(path)
    last = F.element_at("interventions", -1)["frame_file"].alias("last_frame")
    return docs.select("video_id", "total_interventions", last, "explanation_mode")


@query(
    "A15_write_transcript",
    "SELECT CAST(video_id AS VARCHAR) AS video_id, count(*) AS entry_count, md5(string_agg(text, ' ' ORDER BY idx)) AS text FROM segments GROUP BY 1",
)
def _(t):
    path = t.new_dir("transcripts")
    sinks.write_transcript(t.segments, path)
    docs = t.spark.read.json(path)
    return docs.select("video_id", "entry_count", F.md5(F.array_join("entries.text", " ")).alias("text"))


@query(
    "A16_write_batch_report",
    "SELECT page_id, regexp_extract(url, '([a-zA-Z0-9_-]{11})', 1) AS video_id, 'success' AS status FROM pages",
)
def _(t):
    path = t.new_dir("report")
    report = t.read("pages").select(
        "page_id", "url", F.regexp_extract("url", "([a-zA-Z0-9_-]{11})", 1).alias("video_id"), F.lit("success").alias("status")
    )
    sinks.write_batch_report(report, path)
    return t.spark.read.json(path).select("page_id", "video_id", "status")


@query(
    "A18_insert_if_absent",
    """SELECT 'videos' AS table_name, count(DISTINCT video_id) AS n FROM segments UNION ALL
    SELECT 'transcripts', count(*) FROM segments UNION ALL
    SELECT 'interventions', count(*) FROM keyframes WHERE video_id IN (SELECT video_id FROM segments)""",
)
def _(t):
    places = {n: t.new_dir(n) for n in ("videos", "transcripts", "interventions")}
    videos = t.segments.select(F.col("video_id").alias("id")).distinct()
    segments = t.segments.select("video_id", "idx", "text")
    points = t.keyframes.select("video_id", "ord", "t")
    for n, df in (("videos", videos), ("transcripts", segments), ("interventions", points)):
        df.where("false").write.parquet(places[n])

    def read(n):
        return t.spark.read.parquet(places[n])

    def append(n, rows):
        rows.write.mode("append").parquet(places[n])

    for _round in range(2):  # the second run finds everything stored
        catalog.insert_if_absent(videos, segments, points, read, append)
    return table_counts({n: read(n) for n in places})

