"""Queries on folds (F), streams (I) and whole jobs (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from avsync.operators import folds, vectors
from avsync.plans import context, detect, explain, infer, keyframes, manifest
from avsync.session import settle
from avsync.streaming import state
from workload.base import long, query, r6
from workload.groups import _SIM
from workload.joins import KNOWLEDGE, _KB, _MATCHED
from workload.scalars import DEICTIC, NEGATIVE, REASON_SQL, RULES_SQL, SCORE_SQL

# greedy by time: from a kept time the next is the first one far enough on
_KEEP = """SELECT video_id, min(t) AS t FROM {src} GROUP BY video_id UNION ALL
    SELECT k.video_id, min(q.t) AS t FROM {name} k JOIN {src} q ON q.video_id = k.video_id AND q.t - k.t >= {gap}
    GROUP BY k.video_id, k.t"""

_F1 = {
    "qualifying": "SELECT video_id, t, min(ord) AS ord FROM keyframes GROUP BY video_id, t",
    "kept": _KEEP.format(src="qualifying", name="kept", gap=5.0),
}


@query("F1_suppress_close", "SELECT video_id, t, q.ord FROM kept JOIN qualifying q USING (video_id, t)", _F1)
def _(t):
    return folds.suppress_close(t.keyframes).select("video_id", "t", "ord")


@query("F1_suppress_close_cut", "SELECT video_id, t, q.ord FROM kept JOIN qualifying q USING (video_id, t)", _F1)
def _(t):
    # the form for over-long videos, forced by a low limit
    return folds.suppress_close(t.keyframes, max_rows=40).select("video_id", "t", "ord")


def scenes_sql(floor: str) -> dict[str, str]:
    """Scenes, then the keyframe folds, row by row in time or score order."""
    return {
        **{k: v.replace("greatest(-1.0,", f"greatest({floor},") for k, v in _SIM.items()},
        "marks": """SELECT video_id, t, min(ord) AS ord FROM (SELECT video_id, t, ord FROM flagged WHERE changed
            UNION ALL SELECT video_id, min(t), min(ord) FROM frames GROUP BY video_id) GROUP BY video_id, t""",
        "begins": _KEEP.format(src="marks", name="begins", gap=4.0),
        "scened": """SELECT f.*, (SELECT count(*) FROM begins b WHERE b.video_id = f.video_id AND b.t <= f.t) - 1 AS scene_id
            FROM frames f""",
        "scene_best": """SELECT video_id, scene_id, min(t) AS start_s,
            arg_min(t, (-complexity, t)) FILTER (is_educational AND complexity > 0.05) AS edu_t,
            arg_min(t, (-complexity, t)) AS any_t FROM scened GROUP BY video_id, scene_id""",
        "picked": """SELECT video_id, -1::BIGINT AS scene_id, -4.0::DOUBLE AS last, NULL::DOUBLE AS t FROM scene_best WHERE scene_id = 0
            UNION ALL SELECT s.video_id, s.scene_id, CASE WHEN c.ok THEN c.best ELSE p.last END, CASE WHEN c.ok THEN c.best END
            FROM picked p JOIN scene_best s ON s.video_id = p.video_id AND s.scene_id = p.scene_id + 1,
            LATERAL (SELECT coalesce(s.edu_t, s.any_t) AS best, (s.edu_t IS NOT NULL OR s.start_s - p.last >= 30)
            AND coalesce(s.edu_t, s.any_t) - p.last >= 4 AS ok) c""",
        "first_pick": "SELECT f.* FROM picked p JOIN frames f ON f.video_id = p.video_id AND f.t = p.t",
        "fill_rows": """SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY complexity DESC, t, ord) AS n
            FROM frames f WHERE is_educational AND NOT EXISTS (SELECT 1 FROM first_pick p WHERE p.ord = f.ord)""",
        "filled": """SELECT v.video_id, 0::BIGINT AS n, greatest(5, CAST(floor(duration_seconds / 60 * 1.5) AS BIGINT)) AS want,
            coalesce((SELECT list(p.t) FROM first_pick p WHERE p.video_id = v.video_id), []::DOUBLE[]) AS got FROM video_durations v
            UNION ALL SELECT f.video_id, r.n, f.want, CASE WHEN len(f.got) < f.want
            AND len(list_filter(f.got, lambda x: abs(x - r.t) < 2.0)) = 0 THEN list_append(f.got, r.t) ELSE f.got END
            FROM filled f JOIN fill_rows r ON r.video_id = f.video_id AND r.n = f.n + 1""",
        "final_t": """SELECT DISTINCT video_id, unnest(got) AS t FROM filled f
            WHERE n = (SELECT max(g.n) FROM filled g WHERE g.video_id = f.video_id)""",
        "chosen": """SELECT f.* FROM final_t x JOIN frames f ON f.video_id = x.video_id AND f.t = x.t
            JOIN video_durations d ON d.video_id = f.video_id
            QUALIFY row_number() OVER (PARTITION BY f.video_id ORDER BY f.complexity DESC, f.t)
            <= greatest(8, floor(d.duration_seconds / 60 * 4))""",
    }


_LOW, _DEFAULT = scenes_sql("-1.0"), scenes_sql("0.7")


@query("F2_scene_boundaries", "SELECT video_id, t FROM begins", _LOW)
def _(t):
    flags = vectors.change_flags(vectors.neighbour_similarity(t.frames), floor=-1.0)
    return folds.scene_boundaries(flags).select("video_id", "t")


@query("F3_select_per_scene", "SELECT video_id, t FROM picked WHERE t IS NOT NULL", _DEFAULT)
def _(t):
    return folds.select_per_scene(keyframes.scenes_of(t.frames)).select("video_id", "t")


_F4 = {
    "rowed": "SELECT video_id, ord % 50 AS idx, embedding FROM frames",
    "sampled": """SELECT video_id, idx, true AS kept, idx AS last, embedding AS vec FROM rowed WHERE idx = 0 UNION ALL
        SELECT r.video_id, r.idx, c.hit, CASE WHEN c.hit THEN r.idx ELSE s.last END, CASE WHEN c.hit THEN r.embedding ELSE s.vec END
        FROM sampled s JOIN rowed r ON r.video_id = s.video_id AND r.idx = s.idx + 1,
        LATERAL (SELECT r.idx - s.last >= 15 OR (r.idx - s.last >= 2 AND list_inner_product(s.vec, r.embedding) < -0.1) AS hit) c""",
}


@query("F4_change_point_sample", "SELECT video_id, idx FROM sampled WHERE kept", _F4)
def _(t):
    rows = t.frames.select("video_id", (F.col("ord") % 50).alias("idx"), "embedding")
    return folds.change_point_sample(rows, threshold=-0.1, min_gap=2)


@query("F5_fill_to_minimum", "SELECT video_id, t FROM final_t EXCEPT SELECT video_id, t FROM first_pick", _LOW)
def _(t):
    frames = t.frames
    first = settle(folds.select_per_scene(keyframes.scenes_of(frames, floor=-1.0)).select("video_id", "t", "ord"))
    want = F.greatest(F.lit(5), F.floor(F.col("duration_seconds") / 60 * 1.5)).alias("target_min")
    chosen = t.video_durations.select("video_id", want).join(first, "video_id", "left")
    rest = frames.where("is_educational").join(first, ["video_id", "t", "ord"], "left_anti")
    return folds.fill_to_minimum(chosen, rest).select("video_id", "t")


@query(
    "F6_redundancy_flag",
    """SELECT ord, round(s, 6) AS similarity_to_last, s > 0.1 AS is_redundant FROM (SELECT ord, coalesce(list_inner_product(embedding,
    lag(embedding) OVER (PARTITION BY video_id ORDER BY t, ord)), 0.0) AS s FROM frames)""",
)
def _(t):
    rows = folds.redundancy_flag(t.frames, threshold=0.1)
    return rows.select("ord", r6("similarity_to_last", "similarity_to_last"), "is_redundant")


# --- jobs -------------------------------------------------------------------

SCORED = {
    **_MATCHED,
    "scored": f"""SELECT *, {SCORE_SQL} AS score, {REASON_SQL} AS trigger_reason FROM (SELECT *, {", ".join(
        f"{v} AS {k}" for k, v in RULES_SQL.items())} FROM (SELECT k.*, s.text AS x, k.complexity AS c FROM keyframes k
        LEFT JOIN matched m ON m.ord = k.ord LEFT JOIN segments s ON s.video_id = k.video_id AND s.idx = m.seg_idx))""",
    "candidates": """SELECT video_id, t, arg_min(struct_pack(ord := ord, score := score, trigger_reason := trigger_reason, x := x), ord) AS r
        FROM scored WHERE score >= 50 OR complexity > 0.25 GROUP BY video_id, t""",
    "points_kept": _KEEP.format(src="candidates", name="points_kept", gap=5.0),
    "points": """SELECT video_id, t, r.ord AS ord, r.trigger_reason AS trigger_reason, CASE WHEN r.score >= 100 THEN 'high'
        WHEN r.score >= 50 THEN 'medium' ELSE 'low' END AS confidence, coalesce(r.x, '') AS transcript_context
        FROM points_kept JOIN candidates USING (video_id, t)""",
}


def detected(t, **kw):
    return detect.detect_interventions(t.keyframes, t.segments, deictic=DEICTIC, negative=NEGATIVE, **kw)


@query("J3_detect_interventions", "SELECT video_id, t, ord, trigger_reason, confidence, transcript_context FROM points", SCORED)
def _(t):
    return detected(t).select("video_id", "t", "ord", "trigger_reason", "confidence", "transcript_context")


_J4 = """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t) - 1 AS idx, t, label AS content_type,
    complexity, CASE WHEN is_educational THEN complexity ELSE 0.0 END AS clip_confidence FROM chosen"""


@query("J4_select_keyframes", _J4, _DEFAULT)
def _(t):
    rows = keyframes.select_keyframes(t.frames, t.video_durations)
    return rows.select("video_id", "idx", "t", "content_type", "complexity", "clip_confidence")


@query("J4_select_keyframes_low_floor", _J4, _LOW)
def _(t):
    rows = keyframes.select_keyframes(t.frames, t.video_durations, floor=-1.0)
    return rows.select("video_id", "idx", "t", "content_type", "complexity", "clip_confidence")


_LEX = {"que": ["french"], "the": ["article", "english"], "ein": ["german", "article"]}
_TOP = {"french": ["que", "une"], "german": ["ein", "und"], "english": ["the"]}
_MODE = "CASE idx % 4 WHEN 0 THEN 'brief' WHEN 1 THEN 'explanatory' WHEN 2 THEN 'detailed' ELSE 'other' END"
CONTEXT = {
    "found_at": """SELECT a.video_id, a.idx, min(s.start) AS t, CASE a.idx % 4 WHEN 1 THEN 60 WHEN 2 THEN 120 ELSE 30 END AS w
        FROM segments a JOIN segments s ON s.video_id = a.video_id
        AND contains(lower(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(a.text, '^\\s+|\\s+$', '', 'g')))
        GROUP BY a.video_id, a.idx""",
    "around": """SELECT f.video_id, f.idx, f.t, s.start, s.idx AS sidx, s.text FROM found_at f JOIN segments s ON s.video_id = f.video_id
        AND s.start <= f.t + f.w AND s."end" >= f.t - f.w""",
    "topical": """SELECT *, coalesce(last_value(CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'une') THEN 'french'
        WHEN contains(lower(text), 'ein') OR contains(lower(text), 'und') THEN 'german' WHEN contains(lower(text), 'the') THEN 'english' END
        IGNORE NULLS) OVER (PARTITION BY video_id, idx ORDER BY start, sidx), 'unknown') AS topic FROM around""",
}


@query(
    "J5_build_context",
    """SELECT video_id, idx, md5(string_agg(text, ' ' ORDER BY start, sidx)) AS context,
    array_to_string(list_filter(['que', 'the', 'ein'], lambda k: contains(lower(coalesce(string_agg(text, ' ' ORDER BY start, sidx)
    FILTER (start < t), '')), k)), '|') AS concepts,
    string_agg(printf('%.1f', start) || '=' || topic, '|' ORDER BY start) AS timeline FROM topical GROUP BY video_id, idx""",
    CONTEXT,
)
def _(t):
    asked = t.segments.select("video_id", "idx", F.col("text").alias("transcript_context"), F.expr(_MODE).alias("mode"))
    rows = context.build_context(asked, t.segments, concepts=list(_LEX), principles=_LEX, topics=_TOP)
    timeline = F.transform(
        F.array_sort(
            F.transform(
                F.map_entries("topic_timeline"),
                lambda e: F.struct(e["key"].cast("double").alias("s"), e["key"].alias("k"), e["value"].alias("v")),
            )
        ),
        lambda e: F.concat(e["k"], F.lit("="), e["v"]),
    )
    return rows.select(
        "video_id",
        "idx",
        F.md5("context_text").alias("context"),
        F.array_join("previous_concepts", "|").alias("concepts"),
        F.array_join(timeline, "|").alias("timeline"),
    )


def prepared(t, templates=None, stored=None):
    snaps = t.answers.select(F.md5(F.col("event_id").cast("string")).alias("intervention_id"), "answer")
    points = t.interventions.select(
        "id", F.col("video_id").cast("long").alias("video_id"), "t", "content_type", F.col("complexity").alias("confidence_proxy")
    )
    return explain.prepare_explanations(
        t.requests, points, t.explanations if stored is None else stored, t.segments, snaps, KNOWLEDGE, templates,
        concepts=list(_LEX), principles=_LEX, topics=_TOP,
    )


_QUEUE = {
    **_KB,
    "todo": """SELECT r.intervention_id, r.output_mode, CAST(i.video_id AS BIGINT) AS video_id, i.t, i.ord,
        CASE WHEN i.complexity < 0.4 THEN 'unknown' ELSE i.content_type END AS content_type FROM requests r
        JOIN interventions i ON i.id = r.intervention_id WHERE NOT EXISTS (SELECT 1 FROM explanations e
        WHERE e.intervention_id = r.intervention_id AND e.output_mode = r.output_mode)""",
    "near_text": """SELECT k.ord, arg_min(s.text, (CASE WHEN s.start <= k.t AND k.t <= s."end" THEN 0 ELSE 1 END,
        CASE WHEN s.start <= k.t AND k.t <= s."end" THEN 0.0 ELSE least(abs(s.start - k.t), abs(s."end" - k.t)) END, s.idx)) AS text
        FROM todo k JOIN segments s ON s.video_id = k.video_id GROUP BY k.ord""",
}


@query(
    "J6_explanation_queue",
    """SELECT t.intervention_id, t.output_mode, t.content_type, md5(coalesce(n.text, '')) AS spoken,
    t.ord % 5 IN (0, 1, 2) AS use_model FROM todo t LEFT JOIN near_text n ON n.ord = t.ord""",
    _QUEUE,
)
def _(t):
    return prepared(t).select(
        "intervention_id", "output_mode", "content_type", F.md5("transcript_context").alias("spoken"), "use_model"
    )


def _echo():
    """Stands for a model: answers with the prompt's length, or with nothing."""
    return lambda prompts: ["" if len(p) % 7 == 0 else f"explained {len(p)}" for p in prompts]


@query(
    "J6_write_explanations",
    """SELECT t.intervention_id, t.output_mode, md5(CASE WHEN t.ord % 5 NOT IN (0, 1, 2) OR length(x) % 7 = 0 THEN x
    ELSE 'explained ' || length(x) END) AS told FROM (SELECT t.*, coalesce(n.text, '') AS x FROM todo t
    LEFT JOIN near_text n ON n.ord = t.ord) t""",
    _QUEUE,
)
def _(t):
    rows = explain.write_explanations(prepared(t, {"": "{transcript_context}"}), _echo)
    return rows.select("intervention_id", "output_mode", F.md5("text_explanation").alias("told"))


@query(
    "J6_stored_explanations",
    """SELECT t.intervention_id, t.output_mode, 'interventions/' || t.intervention_id || '/' || t.output_mode || '.txt' AS text_file_path,
    0::BIGINT AS left_to_do FROM todo t""",
    _QUEUE,
)
def _(t):
    # the second run over the same requests finds everything stored
    path = t.new_dir("explanations")
    kept = t.explanations.select("intervention_id", "output_mode")
    for _run in range(2):
        told = explain.write_explanations(prepared(t, {"": "{transcript_context}"}, kept), _echo)
        explain.store_explanations(told, lambda rows: rows.write.mode("append").parquet(path))
        stored = t.spark.read.parquet(path)
        kept = t.explanations.select("intervention_id", "output_mode").unionByName(stored.select("intervention_id", "output_mode"))
    left = prepared(t, {"": "{transcript_context}"}, kept).count()
    return stored.select("intervention_id", "output_mode", "text_file_path", F.lit(left).cast("long").alias("left_to_do"))


@query(
    "J7_full_manifest",
    """SELECT video_id, total_segments, intervention_count, CAST(min(part) AS BIGINT) AS part FROM (SELECT s.video_id,
    count(*) AS total_segments, count(*) FILTER (EXISTS (SELECT 1 FROM snapshots n WHERE n.video_id = s.video_id
    AND abs(n.t - s.start) <= 30)) AS intervention_count, 0 AS part FROM segments s GROUP BY s.video_id) GROUP BY ALL""",
)
def _(t):
    docs = manifest.full_manifest(t.segments, t.snapshots)
    return docs.where(F.size("segments") > 0).select("video_id", "total_segments", "intervention_count", long("part"))


@query(
    "J7_manifest_segments",
    """SELECT s.video_id, s.idx AS chunk_id, n.ord IS NOT NULL AS is_intervention,
    CASE WHEN n.ord IS NOT NULL THEN printf('audio_segments/intervention_%04d.mp3', s.idx) END AS audio_file,
    s.text AS original_transcript, a.answer AS vlm_data FROM segments s LEFT JOIN
    (SELECT s.video_id, s.idx, arg_min(n.ord, (abs(n.t - s.start), n.ord)) AS ord FROM segments s JOIN
    (SELECT video_id, t, max(ord) AS ord FROM snapshots GROUP BY video_id, t) n ON n.video_id = s.video_id
    AND abs(n.t - s.start) <= 30 GROUP BY s.video_id, s.idx) n ON n.video_id = s.video_id AND n.idx = s.idx LEFT JOIN answers a ON a.event_id = n.ord""",
)
def _(t):
    answers = t.answers.select(F.col("event_id").cast("string").alias("snapshot_id"), "answer")
    rows = manifest.manifest_segments(t.segments, t.snapshots, answers=answers)
    return rows.select("video_id", "chunk_id", "is_intervention", "audio_file", "original_transcript", "vlm_data")


@query(
    "J8_interventions_manifest",
    """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, ord) - 1 AS intervention_id, t AS timestamp,
    printf('interventions/intervention_%04d/audio.mp3', row_number() OVER (PARTITION BY video_id ORDER BY t, ord) - 1) AS audio_file,
    'of ' || snapshot_id AS explanation, count(*) OVER (PARTITION BY video_id) AS total_interventions FROM snapshots""",
)
def _(t):
    told = t.snapshots.select("snapshot_id", F.concat(F.lit("of "), "snapshot_id").alias("explanation"))
    rows = manifest.interventions_rows(t.snapshots, t.segments, t.keyframes, told)
    docs = manifest.interventions_manifest(rows)
    items = docs.select("video_id", "total_interventions", F.inline("interventions"))
    return items.select("video_id", "intervention_id", "timestamp", "audio_file", "explanation", "total_interventions")


def _upper():
    return lambda texts: [x.upper() for x in texts]


@query("J1_infer", "SELECT p_partkey, upper(p_name) AS loud FROM part")
def _(t):
    rows = t.read("part").select("p_partkey", "p_name")
    return infer.infer(rows, "p_name", _upper, "loud").select("p_partkey", "loud")


def _refuse_short(texts: list) -> list:
    return [ValueError("too short") if len(x) < 10 else f"a:{len(x)}" for x in texts]


def _refuse_red(texts: list) -> list:
    if all(x.startswith("red") for x in texts):
        raise ValueError("no red")
    return [ValueError("no red") if x.startswith("red") else f"b:{len(x)}" for x in texts]


_PROVIDERS = [("first", _refuse_short), ("second", _refuse_red)]
_STATUS_SQL = """SELECT p_partkey, CASE WHEN length(p_name) >= 10 THEN 'first' WHEN NOT starts_with(p_name, 'red') THEN 'second' END AS provider,
    CASE WHEN length(p_name) >= 10 THEN 'a:' || length(p_name) WHEN NOT starts_with(p_name, 'red') THEN 'b:' || length(p_name) END AS value,
    CASE WHEN length(p_name) < 10 AND starts_with(p_name, 'red') THEN 'failed' ELSE 'success' END AS status FROM part"""


@query("J2_infer_with_fallback", f"SELECT p_partkey, provider, value FROM ({_STATUS_SQL})")
def _(t):
    rows = infer.infer_with_fallback(t.read("part").select("p_partkey", "p_name"), "p_name", _PROVIDERS)
    return rows.select("p_partkey", "provider", "value")


@query("J9_batch_status", f"SELECT status, count(*) AS n FROM ({_STATUS_SQL}) GROUP BY status")
def _(t):
    rows = infer.batch_status(t.read("part").select("p_partkey", "p_name"), "p_name", _PROVIDERS)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- streams, drained over the table as it is now ---------------------------


def drained(t, result, name, mode="append"):
    path = t.new_dir(name)
    state.drain(result, path, t.new_dir(f"{name}-checkpoint"), mode)
    return t.spark.read.parquet(path)


def in_order(t, name, order, files=4):
    """A table as a stream of several files in time order, one per micro-batch."""
    path = t.new_dir(f"{name}-files")
    rows = t.read(name).repartitionByRange(files, order).sortWithinPartitions(order)
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def timed(e):
    return e.select(
        (F.col("user_id") % 100).alias("video_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") % 900) / 10.0).alias("t"),
        F.col("event_id").alias("ord"),
        (F.col("value") / 500.0).alias("complexity"),
    )


_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(
    "I1_sample_rate",
    f"""SELECT video_id, hour, arg_min(event_id, (ts, event_id)) AS ord FROM (SELECT user_id % 100 AS video_id, {_EPOCH} // 3600 AS hour,
    ts, event_id FROM events) GROUP BY video_id, hour""",
)
def _(t):
    closed = drained(t, state.sample_rate(timed(t.stream("events")), 3600.0), "sampled")
    rows = closed.unionByName(state.sample_tail(timed(t.read("events")), closed, 3600.0))
    return rows.select("video_id", F.floor(F.unix_timestamp("window_start") / 3600).alias("hour"), "ord")


@query(
    "I2_stall_detect",
    f"""SELECT video_id, min(s) AS first_s, max(s) AS last_s, count(*) AS n_rows FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END)
    OVER (PARTITION BY video_id ORDER BY ts, event_id) AS run FROM (SELECT user_id % 100 AS video_id, ts, event_id, {_EPOCH} AS s,
    coalesce(ts - lag(ts) OVER (PARTITION BY user_id % 100 ORDER BY ts, event_id) > INTERVAL 2 HOUR, true) AS gap FROM events))
    GROUP BY video_id, run""",
)
def _(t):
    closed = drained(t, state.stall_detect(timed(t.stream("events")), 7200.0), "stalls")
    rows = closed.unionByName(state.stall_tail(timed(t.read("events")), closed, 7200.0))
    return rows.select(
        "video_id", F.unix_timestamp("first_row").alias("first_s"), F.unix_timestamp("last_row").alias("last_s"), "n_rows"
    )


def out_of_order(t, rows, name, files=6):
    """Rows as a stream of several files by slices of time, each second file before the first: 1, 0, 3, 2, ..."""
    path = t.new_dir(f"{name}-files")
    rows = settle(rows.withColumn("slice", F.least(F.lit(files - 1), F.floor((F.unix_seconds("ts") - START) / (SPAN / files)))), name)
    for k in range(files):
        rows.where(F.col("slice") == (k ^ 1)).drop("slice").repartition(PARTS).write.mode("append").parquet(path)
    rows = rows.drop("slice")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", PARTS).parquet(path), rows


START = 86_400  # a stream's watermark begins at 0
SPAN = 104  # seconds that the timelines of keyframes and frames last
PARTS = 4  # files of a slice, read together


@query("I3_suppress_close_stream", "SELECT video_id, t, q.ord, round(k.complexity, 6) AS complexity FROM kept JOIN qualifying q USING (video_id, t) JOIN keyframes k ON k.ord = q.ord", _F1)
def _(t):
    stream, rows = out_of_order(t, timed(t.read("events")).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long") + START * 1_000_000)), "keyframes")
    closed = drained(t, state.suppress_close_ordered(stream, hold=36.0), "kept")
    kept = closed.where("NOT late").drop("late").unionByName(state.suppress_close_tail(rows, closed))
    return kept.select("video_id", "t", "ord", r6("complexity", "complexity"))


@query("I4_change_point_stream", "SELECT video_id, idx FROM sampled WHERE kept", _F4)
def _(t):
    e = t.read("embeddings")
    frames = e.select(
        F.floor(F.col("vec_id") / 50).alias("video_id"),
        F.timestamp_seconds((F.col("vec_id") % 50) * 2 + START).alias("ts"),
        (F.col("vec_id") % 50).alias("idx"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    stream, rows = out_of_order(t, frames, "frames")
    closed = drained(t, state.change_point_ordered(stream, -0.1, 2, hold=36.0), "changes")
    kept = closed.where("NOT late").select("video_id", "idx")
    return kept.unionByName(state.change_point_tail(rows, closed, -0.1, 2))


@query("I5_process_once", "SELECT user_id AS id, count(*) AS handled FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def _(t):
    # users come again in every file; the second run over the same input finds all of them stored
    path = t.new_dir("once")
    for _run in range(2):
        state.process_once_into(in_order(t, "events", "ts").select(F.col("user_id").alias("id"), "ts"), path, t.new_dir("once-checkpoint"))
    return state.once_rows(t.spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("handled"))
