"""Whole results of the longer jobs: every column of prompts, contexts and written documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from avsync.plans import context, detect, explain, manifest
from avsync.sources import sinks
from workload.base import long, query, r6
from workload.jobs import _LEX, _MODE, _QUEUE, _TOP, CONTEXT, SCORED, detected
from workload.joins import _ALIKE, _MATCHED

_PRINCIPLES_SQL = """(SELECT coalesce(string_agg(p, '|' ORDER BY n), '') FROM (SELECT p, min(n) AS n FROM (VALUES ('que', 'french', 0),
    ('the', 'article', 1), ('the', 'english', 2), ('ein', 'german', 3), ('ein', 'article', 4)) AS v(c, p, n)
    WHERE list_contains({concepts}, c) GROUP BY p))"""

# --- context, with its principles and window -----------------------------------


@query(
    "J5_context_columns",
    f"""SELECT video_id, idx, mode, window_size, t, context, array_to_string(concepts, '|') AS concepts,
    {_PRINCIPLES_SQL.format(concepts="concepts")} AS principles FROM (
    SELECT f.video_id, f.idx, CASE f.idx % 4 WHEN 0 THEN 'brief' WHEN 1 THEN 'explanatory' WHEN 2 THEN 'detailed' ELSE 'standard' END AS mode,
    CAST(f.w AS DOUBLE) AS window_size, f.t, md5(coalesce(string_agg(a.text, ' ' ORDER BY a.start, a.sidx), '')) AS context,
    list_filter(['que', 'the', 'ein'], lambda k: contains(lower(coalesce(string_agg(a.text, ' ' ORDER BY a.start, a.sidx)
    FILTER (a.start < a.t), '')), k)) AS concepts
    FROM found_at f LEFT JOIN around a ON a.video_id = f.video_id AND a.idx = f.idx GROUP BY f.video_id, f.idx, f.w, f.t)""",
    CONTEXT,
)
def _(t):
    asked = t.segments.select("video_id", "idx", F.col("text").alias("transcript_context"), F.expr(_MODE).alias("mode"))
    rows = context.build_context(asked, t.segments, concepts=list(_LEX), principles=_LEX, topics=_TOP)
    return rows.select(
        "video_id", "idx", "mode", "window_size", "t", F.md5("context_text").alias("context"),
        F.array_join("previous_concepts", "|").alias("concepts"), F.array_join("related_principles", "|").alias("principles"),
    )


# --- prompts as the model gets them ---------------------------------------------

ELSEWHERE = {
    "que": {"math": "an open question", "biology": "a call"},
    "einstein": {"physics": "relativity", "math": "summed indices"},
    "the": {"economics": "a definite thing", "biology": "one of a kind"},
    "theorem": {"math": "a proven sentence", "physics": "a law with a proof"},
}
_PROMPTS = {
    **_QUEUE,
    "kb": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{c}', '{d}', '{x}', {i})" for i, (c, d, x) in enumerate((c, d, x) for c, by in ELSEWHERE.items() for d, x in by.items())
    )
    + ") AS v(concept, domain, explanation, ord)",
    "asked": """SELECT t.*, coalesce(n.text, '') AS spoken, CASE t.output_mode WHEN 'explanatory' THEN 60 WHEN 'detailed' THEN 120
        ELSE 30 END AS w FROM todo t LEFT JOIN near_text n ON n.ord = t.ord""",
    # a text is looked up once per video, whoever asks for it
    "held_in": """SELECT q.video_id, q.spoken, min(s.idx) AS idx FROM (SELECT DISTINCT video_id, spoken FROM asked) q
        JOIN segments s ON s.video_id = q.video_id AND contains(lower(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g')),
        lower(regexp_replace(q.spoken, '^\\s+|\\s+$', '', 'g'))) GROUP BY q.video_id, q.spoken""",
    "moments": """SELECT a.*, coalesce(s.start, 0.0) AS moment FROM asked a
        LEFT JOIN held_in h ON h.video_id = a.video_id AND h.spoken = a.spoken
        LEFT JOIN segments s ON s.video_id = a.video_id AND s.idx = coalesce(h.idx, 0)""",
    "windows": """SELECT m.video_id, m.moment, m.w, s.start, s.idx, s.text, coalesce(last_value(
        CASE WHEN contains(lower(s.text), 'que') OR contains(lower(s.text), 'une') THEN 'french'
        WHEN contains(lower(s.text), 'ein') OR contains(lower(s.text), 'und') THEN 'german' WHEN contains(lower(s.text), 'the') THEN 'english' END
        IGNORE NULLS) OVER (PARTITION BY m.video_id, m.moment, m.w ORDER BY s.start, s.idx), 'unknown') AS topic
        FROM (SELECT DISTINCT video_id, moment, w FROM moments) m JOIN segments s ON s.video_id = m.video_id
        AND s.start <= m.moment + m.w AND s."end" >= m.moment - m.w""",
    "surroundings": """SELECT video_id, moment, w, string_agg(text, ' ' ORDER BY start, idx) AS context,
        list_filter(['que', 'the', 'ein'], lambda k: contains(lower(coalesce(string_agg(text, ' ' ORDER BY start, idx)
        FILTER (start < moment), '')), k)) AS concepts,
        '{' || string_agg('"' || printf('%.1f', start) || '":"' || topic || '"', ',' ORDER BY start, idx) || '}' AS topics
        FROM windows GROUP BY video_id, moment, w""",
    "kinds_of_lists": "SELECT DISTINCT concepts FROM surroundings",
    "elsewhere": f"""SELECT concepts, string_agg('In ' || domain || ': ' || explanation, '; ' ORDER BY n, d) AS cross_domain FROM (
        SELECT concepts, domain, arg_min(explanation, n) AS explanation, min(n) AS n, min(d) AS d FROM (
        SELECT a.concepts, a.n, k.domain, list_position(['math', 'physics', 'chemistry', 'economics', 'biology'], k.domain) AS d,
        arg_min(k.explanation, (CASE WHEN k.concept = a.concept THEN 0 ELSE 1 END, k.ord)) AS explanation
        FROM (SELECT concepts, unnest(concepts) AS concept, unnest(range(len(concepts))) AS n FROM kinds_of_lists) a
        JOIN kb k ON {_ALIKE} GROUP BY ALL) GROUP BY concepts, domain) GROUP BY concepts""",
    # what the strict reading makes of each form of answer
    "read_answers": """SELECT event_id AS ord, CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN event_type || ', text' ELSE 'unknown' END AS types,
        CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'left' WHEN 2 THEN '' ELSE answer END AS structure FROM answers""",
    "fields": f"""SELECT m.intervention_id, m.output_mode, m.content_type, m.ord, m.spoken, coalesce(s.context, '') AS context,
        coalesce(nullif(array_to_string(s.concepts, ', '), ''), 'None') AS concepts,
        coalesce(nullif(replace({_PRINCIPLES_SQL.format(concepts="coalesce(s.concepts, []::VARCHAR[])")}, '|', ', '), ''), 'None') AS principles,
        coalesce(s.topics, '{{}}') AS topics, coalesce(e.cross_domain, 'No direct connections') AS cross_domain, r.types, r.structure
        FROM moments m LEFT JOIN surroundings s ON s.video_id = m.video_id AND s.moment = m.moment AND s.w = m.w
        LEFT JOIN elsewhere e ON e.concepts = s.concepts JOIN read_answers r ON r.ord = m.ord""",
}
_PROMPT_SQL = """SELECT intervention_id, output_mode, content_type, md5(context) AS context, concepts, principles, topics, cross_domain,
    md5(CASE output_mode WHEN 'brief' THEN 'Explain this picture to a listener who cannot see it, in a few sentences.' || chr(10) || common
    WHEN 'detailed' THEN 'Explain this picture in depth to a listener who cannot see it.' || chr(10) || common || around
        || 'Principles: ' || principles || chr(10) || 'Topics: ' || topics || chr(10) || 'Elsewhere: ' || cross_domain || chr(10)
    ELSE 'Explain this picture fully to a listener who cannot see it.' || chr(10) || common || around END) AS prompt
    FROM (SELECT *, 'Types on screen: ' || types || chr(10) || 'Visual data: {}' || chr(10) || 'Structure: ' || structure || chr(10)
    || 'Hints: ' || chr(10) || 'Spoken now: ' || spoken || chr(10) || 'Earlier concepts: ' || concepts || chr(10) AS common,
    'Reading order: Not specified' || chr(10) || 'Spoken around: ' || context || chr(10) AS around FROM fields)"""


def _prompts(t, knowledge):
    answers = t.answers.select(F.md5(F.col("event_id").cast("string")).alias("intervention_id"), "answer")
    points = t.interventions.select(
        "id", F.col("video_id").cast("long").alias("video_id"), "t", "content_type", F.col("complexity").alias("confidence_proxy")
    )
    rows = explain.prepare_explanations(
        t.requests, points, t.explanations, t.segments, answers, knowledge, concepts=list(_LEX), principles=_LEX, topics=_TOP
    )
    named = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("None"))
    return rows.select(
        "intervention_id", "output_mode", "content_type", F.md5("context_text").alias("context"),
        named("previous_concepts").alias("concepts"), named("related_principles").alias("principles"),
        F.to_json("topic_timeline").alias("topics"), "cross_domain", F.md5("prompt").alias("prompt"),
    )


@query("J6_explanation_prompts", _PROMPT_SQL, _PROMPTS)
def _(t):
    return _prompts(t, ELSEWHERE)


@query("J6_explanation_prompts_table", _PROMPT_SQL, _PROMPTS)
def _(t):
    # the same knowledge as a table that is joined
    rows = [(c, d, x, i) for i, (c, d, x) in enumerate((c, d, x) for c, by in ELSEWHERE.items() for d, x in by.items())]
    return _prompts(t, t.spark.createDataFrame(rows, "concept string, domain string, explanation string, ord long"))


# --- items of written documents ---------------------------------------------------

_CLOCK = "printf('%02d:%02d', CAST(floor({t} / 60) AS BIGINT), CAST(floor({t}) AS BIGINT) % 60)"


@query(
    "A12_written_items",
    f"""SELECT CAST(p.video_id AS VARCHAR) AS video_id, count(*) OVER (PARTITION BY p.video_id) AS total_interventions,
    row_number() OVER (PARTITION BY p.video_id ORDER BY p.t, p.ord) - 1 AS place,
    md5(p.video_id || '|' || CAST(p.t AS VARCHAR) || '|' || p.ord) AS id, p.t AS timestamp, {_CLOCK.format(t="p.t")} AS timestamp_formatted,
    k.frame_path, k.content_type, round(k.complexity, 6) AS complexity_score, round(k.clip_confidence, 6) AS clip_confidence,
    p.trigger_reason, p.confidence, md5(p.transcript_context) AS transcript_context, false AS is_bookmarked
    FROM points p JOIN keyframes k ON k.ord = p.ord""",
    SCORED,
)
def _(t):
    path = t.new_dir("interventions")
    sinks.write_interventions(detect.intervention_rows(detected(t)), path, part_rows=5)
    docs = t.spark.read.json(path)
    items = docs.select(F.col("video_id").cast("string").alias("vid"), "part", "total_interventions", F.posexplode("interventions").alias("at", "i"))
    return items.select(
        F.col("vid").alias("video_id"), "total_interventions", (F.col("part") * 5 + F.col("at")).alias("place"), "i.id", "i.timestamp",
        "i.timestamp_formatted", "i.frame_path", "i.content_type", r6("i.complexity_score", "complexity_score"),
        r6("i.clip_confidence", "clip_confidence"), "i.trigger_reason", "i.confidence",
        F.md5("i.transcript_context").alias("transcript_context"), "i.is_bookmarked",
    )


@query(
    "A13_written_items",
    """SELECT s.video_id, s.idx AS chunk_id, s.start AS timestamp, md5(CASE WHEN n.ord % 2 = 0 THEN 'told of ' || n.ord ELSE s.text END) AS text,
    n.ord IS NOT NULL AS is_intervention, CASE WHEN n.ord IS NOT NULL THEN printf('audio_segments/intervention_%04d.mp3', s.idx) END AS audio_file,
    md5(s.text) AS original_transcript, a.answer AS vlm_data, CASE WHEN n.ord % 3 = 0 THEN 'reason ' || n.ord WHEN n.ord IS NOT NULL THEN 'Unknown' END
    AS intervention_reason, count(*) OVER (PARTITION BY s.video_id) AS total_segments, count(n.ord) OVER (PARTITION BY s.video_id) AS intervention_count
    FROM segments s LEFT JOIN (SELECT s.video_id, s.idx, arg_min(n.ord, (abs(n.t - s.start), n.ord)) AS ord FROM segments s JOIN
    (SELECT video_id, t, max(ord) AS ord FROM snapshots GROUP BY video_id, t) n ON n.video_id = s.video_id
    AND abs(n.t - s.start) <= 30 GROUP BY s.video_id, s.idx) n ON n.video_id = s.video_id AND n.idx = s.idx LEFT JOIN answers a ON a.event_id = n.ord""",
)
def _(t):
    path = t.new_dir("manifest")
    snaps = t.snapshots
    texts = snaps.where("ord % 2 = 0").select("snapshot_id", F.concat(F.lit("told of "), "snapshot_id").alias("text"))
    reasons = snaps.where("ord % 3 = 0").select("snapshot_id", F.concat(F.lit("reason "), "snapshot_id").alias("trigger_reason"))
    answers = t.answers.select(F.col("event_id").cast("string").alias("snapshot_id"), "answer")
    sinks.write_manifest(manifest.manifest_segments(t.segments, snaps, texts, reasons, answers), path, part_rows=3)
    docs = t.spark.read.json(path)
    items = docs.select("video_id", "total_segments", "intervention_count", F.explode("segments").alias("s"))
    return items.select(
        "video_id", "s.chunk_id", "s.timestamp", F.md5("s.text").alias("text"), "s.is_intervention", "s.audio_file",
        F.md5("s.original_transcript").alias("original_transcript"), "s.vlm_data", "s.intervention_reason",
        "total_segments", "intervention_count",
    )


_TOLD = {
    **_MATCHED,
    "told_rows": """SELECT n.video_id, n.t, n.ord, n.snapshot_id, n.content_type, coalesce(s.text, '') AS spoken,
        CASE WHEN n.ord % 3 = 0 THEN 'about ' || n.ord ELSE coalesce(s.text, '') END AS explanation,
        (SELECT CASE WHEN count(o.o_orderkey) > 0 THEN f.frame_path END FROM orders o WHERE o.o_orderstatus = 'F'
            AND 'frames/' || o.o_orderkey || '.jpg' = f.frame_path) AS frame_path
        FROM snapshots n LEFT JOIN matched_any m ON m.ord = n.ord LEFT JOIN segments s ON s.video_id = n.video_id AND s.idx = m.seg_idx
        LEFT JOIN (SELECT n.ord, arg_min(k.frame_path, (abs(k.t - n.t), k.t, k.ord)) AS frame_path FROM snapshots n
        JOIN keyframes k ON k.video_id = n.video_id GROUP BY n.ord) f ON f.ord = n.ord""",
}


def _told(t):
    """Two of three snapshots have no explanation and fall back to what was said."""
    told = t.snapshots.where("ord % 3 = 0").select("snapshot_id", F.concat(F.lit("about "), "snapshot_id").alias("explanation"))
    there = t.read("orders").where("o_orderstatus = 'F'")
    there = there.select(F.concat(F.lit("frames/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))
    return manifest.interventions_rows(t.snapshots, t.segments, t.keyframes, told, there)


@query(
    "J8_interventions_rows",
    "SELECT video_id, t, ord, content_type, md5(spoken) AS spoken, md5(explanation) AS explanation, frame_path FROM told_rows",
    _TOLD,
)
def _(t):
    return _told(t).select(
        "video_id", "t", "ord", "content_type", F.md5("transcript_context").alias("spoken"), F.md5("explanation").alias("explanation"), "frame_path"
    )


_ITEMS_SQL = f"""SELECT video_id, n AS intervention_id, t AS timestamp, {_CLOCK.format(t="t")} AS timestamp_formatted, content_type,
    folder || 'audio.mp3' AS audio_file, folder || 'description.txt' AS description_file, folder || 'frame.jpg' AS frame_file,
    md5(explanation) AS explanation, 'detailed' AS explanation_mode, total AS total_interventions FROM (SELECT *,
    printf('interventions/intervention_%04d/', n) AS folder FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total,
    row_number() OVER (PARTITION BY video_id ORDER BY t, ord) - 1 AS n FROM told_rows))"""


def _manifest_items(docs):
    items = docs.select("video_id", "explanation_mode", "total_interventions", F.inline("interventions"))
    return items.select(
        "video_id", long("intervention_id"), "timestamp", "timestamp_formatted", "content_type", "audio_file", "description_file", "frame_file",
        F.md5("explanation").alias("explanation"), "explanation_mode", "total_interventions",
    )


@query("J8_manifest_items", _ITEMS_SQL, _TOLD)
def _(t):
    return _manifest_items(manifest.interventions_manifest(_told(t), "detailed"))


@query("A14_written_items", _ITEMS_SQL, _TOLD)
def _(t):
    path = t.new_dir("interventions-manifest")
    sinks.write_interventions_manifest(_told(t), "detailed", path, part_rows=4)
    return _manifest_items(t.spark.read.json(path))
