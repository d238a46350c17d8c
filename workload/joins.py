"""Queries on joins (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from avsync.functions import lexicon
from avsync.operators import aggregates, folds, knowledge, library, timejoin, vectors
from avsync.operators.textmatch import find_segment_by_text
from avsync.session import spread
from workload.base import long, query, r6

_DIST = "least(abs(s.start - k.t), abs(s.\"end\" - k.t))"


def match_sql(points: str, limit: str) -> str:
    """First holder in list order, else the nearest; every pair compared."""
    return f"""SELECT k.ord, arg_min(s.idx, (CASE WHEN s.start <= k.t AND k.t <= s."end" THEN 0 ELSE 1 END,
    CASE WHEN s.start <= k.t AND k.t <= s."end" THEN 0.0 ELSE {_DIST} END, s.idx)) AS seg_idx
    FROM {points} k JOIN segments s ON s.video_id = k.video_id
    WHERE (s.start <= k.t AND k.t <= s."end") OR {_DIST} <= {limit} GROUP BY k.ord"""


_MATCHED = {"matched": match_sql("keyframes", "30.0"), "matched_any": match_sql("snapshots", "1e300")}


@query(
    "C1_match_segment",
    """SELECT k.video_id, k.ord, k.t, m.seg_idx, s.text AS seg_text FROM keyframes k LEFT JOIN matched m ON m.ord = k.ord
    LEFT JOIN segments s ON s.video_id = k.video_id AND s.idx = m.seg_idx""",
    _MATCHED,
)
def _(t):
    return timejoin.match_segment(t.keyframes, t.segments).select("video_id", "ord", "t", "seg_idx", "seg_text")


_SHUFFLED = {
    "seg_any": """SELECT video_id, (idx * 3) % 8 AS idx, start, start + (idx % 3) * 17.0::DOUBLE AS "end", text FROM segments""",
    "matched_shuffled": match_sql("keyframes", "30.0").replace("JOIN segments", "JOIN seg_any"),
}


@query(
    "C1_match_segment_any_order",
    """SELECT k.video_id, k.ord, m.seg_idx FROM keyframes k LEFT JOIN matched_shuffled m ON m.ord = k.ord""",
    _SHUFFLED,
)
def _(t):
    # the same segments listed out of time order and of other lengths
    seg = t.segments.select(
        "video_id",
        ((F.col("idx") * 3) % 8).alias("idx"),
        "start",
        (F.col("start") + (F.col("idx") % 3) * 17.0).alias("end"),
        "text",
    )
    return timejoin.match_segment(t.keyframes, seg).select("video_id", "ord", "seg_idx")


@query(
    "C2_nearest_segment",
    """SELECT k.video_id, k.ord, m.seg_idx FROM snapshots k LEFT JOIN matched_any m ON m.ord = k.ord""",
    _MATCHED,
)
def _(t):
    return timejoin.nearest_segment(t.snapshots, t.segments).select("video_id", "ord", "seg_idx")


@query(
    "C3_nearest_snapshot",
    """SELECT s.video_id, s.idx, arg_min(n.snapshot_id, (abs(n.t - s.start), n.ord)) AS snapshot_id
    FROM segments s LEFT JOIN snapshots n ON n.video_id = s.video_id AND abs(n.t - s.start) <= 0.5 GROUP BY ALL""",
)
def _(t):
    points = t.segments.withColumn("t", F.col("start"))
    return timejoin.nearest_snapshot(points, t.snapshots, 0.5).select("video_id", "idx", "snapshot_id")


@query(
    "C4_nearest_frame",
    """SELECT video_id, idx, CASE WHEN frame_path IN (SELECT 'frames/' || o_orderkey || '.jpg' FROM orders WHERE o_orderstatus = 'F')
    THEN frame_path END AS frame_path FROM (SELECT s.video_id, s.idx, arg_min(k.frame_path, (abs(k.t - s.start), k.ord)) AS frame_path
    FROM segments s LEFT JOIN keyframes k ON k.video_id = s.video_id GROUP BY ALL)""",
)
def _(t):
    points = t.segments.withColumn("t", F.col("start"))
    there = t.read("orders").where("o_orderstatus = 'F'")
    there = there.select(F.concat(F.lit("frames/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))
    return timejoin.nearest_frame(points, t.keyframes, there).select("video_id", "idx", "frame_path")


_AROUND = "s.start <= p.t + {w} AND s.\"end\" >= p.t - {w}"


@query(
    "C5_context_window_join",
    f"""SELECT p.video_id, p.t, s.idx FROM (SELECT DISTINCT video_id, t FROM keyframes) p JOIN segments s
    ON s.video_id = p.video_id AND {_AROUND.format(w=30)}""",
)
def _(t):
    return timejoin.window_rows(t.keyframes, t.segments, 30.0).select("video_id", "t", "idx")


@query(
    "C6_surrounding_text",
    f"""SELECT p.ord, coalesce(md5(string_agg(s.text, ' ' ORDER BY s.start, s.idx)), md5('')) AS around FROM keyframes p
    LEFT JOIN segments s ON s.video_id = p.video_id AND {_AROUND.format(w=12)} GROUP BY p.ord""",
)
def _(t):
    rows = timejoin.surrounding_text(t.keyframes, t.segments, 5.0, 12.0)
    return rows.select("ord", F.md5("surrounding_text").alias("around"))


@query(
    "C7_explained_interventions",
    """SELECT id, video_id, created_at FROM interventions WHERE id IN (SELECT intervention_id FROM explanations)""",
)
def _(t):
    return library.explained_interventions(t.interventions, t.explanations).select("id", "video_id", "created_at")


@query(
    "C8_explanation_lookup",
    """SELECT r.intervention_id, r.output_mode, e.text_explanation FROM requests r LEFT JOIN explanations e
    ON e.intervention_id = r.intervention_id AND e.output_mode = r.output_mode""",
)
def _(t):
    return library.explanation_lookup(t.requests, t.explanations)


@query(
    "C8_explanation_queue",
    """SELECT DISTINCT intervention_id, output_mode FROM requests EXCEPT SELECT intervention_id, output_mode FROM explanations""",
)
def _(t):
    return library.explanation_queue(t.requests, t.explanations)


@query(
    "C9_orphans",
    "SELECT id, intervention_id FROM explanations WHERE intervention_id NOT IN (SELECT id FROM interventions)",
)
def _(t):
    return library.orphans(t.explanations, t.interventions, "intervention_id", "id").select("id", "intervention_id")


@query(
    "C10_video_status",
    """SELECT a.video_id, coalesce(c.c_name, s.s_name) AS title,
    CASE WHEN c.c_custkey IS NOT NULL THEN CAST(floor(c.c_acctbal) AS BIGINT) ELSE CAST(floor(s.s_acctbal) AS BIGINT) END AS duration_seconds,
    c.c_custkey IS NOT NULL OR s.s_suppkey IS NOT NULL AS "exists", c.c_custkey IS NOT NULL AS processed
    FROM (SELECT DISTINCT event_id // 4 AS video_id FROM events) a
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = a.video_id
    LEFT JOIN supplier s ON s.s_suppkey = a.video_id""",
)
def _(t):
    asked = t.read("events").select(F.floor(F.col("event_id") / 4).alias("video_id")).distinct()
    stored = t.read("customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title"), F.floor("c_acctbal").alias("duration_seconds")
    )
    files = t.read("supplier").select(
        F.col("s_suppkey").alias("video_id"), F.col("s_name").alias("title"), F.floor("s_acctbal").alias("duration_seconds")
    )
    return library.video_status(asked, stored, files)


_PRINCIPLES = {"the": ["article", "short"], "la": ["article", "french"], "ein": ["german", "short"], "que": ["french"]}
_TERMS = ["que", "the", "ein", "la"]


@query(
    "C11_concept_principles",
    """SELECT video_id, idx, array_to_string(list_distinct_ordered, '|') AS principles FROM (
    SELECT video_id, idx, list_filter(all_p, lambda x, i: list_position(all_p, x) = i) AS list_distinct_ordered FROM (
    SELECT video_id, idx, flatten([CASE WHEN contains(lower(text), 'que') THEN ['french'] ELSE [] END,
    CASE WHEN contains(lower(text), 'the') THEN ['article', 'short'] ELSE [] END,
    CASE WHEN contains(lower(text), 'ein') THEN ['german', 'short'] ELSE [] END,
    CASE WHEN contains(lower(text), 'la') THEN ['article', 'french'] ELSE [] END]) AS all_p FROM segments))""",
)
def _(t):
    concepts = lexicon.concepts_in(F.col("text"), _TERMS)
    return t.segments.select(
        "video_id", "idx", F.array_join(lexicon.principles_of(concepts, _PRINCIPLES), "|").alias("principles")
    )


KNOWLEDGE = {
    "ring": {"math": "an algebra", "physics": "a closed loop"},
    "small": {"math": "near zero", "biology": "microscopic ring"},
    "red widget": {"physics": "long waves", "chemistry": "an oxide"},
    "bolt": {"physics": "a fastener", "economics": "a run on the bank"},
    "hot": {"chemistry": "exothermic", "physics": "much energy"},
}
_KB = {
    "kb": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{c}', '{d}', '{x}', {i})"
        for i, (c, d, x) in enumerate((c, d, x) for c, by in KNOWLEDGE.items() for d, x in by.items())
    )
    + ") AS v(concept, domain, explanation, ord)",
    "kb_asked": """SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE split_part(p_name, ' ', 2) END AS concept,
        CASE p_size % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END AS domain FROM part""",
}


def _asked(t):
    return spread(t.read("part").select("p_partkey", "p_name", "p_size")).select(
        "p_partkey",
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("concept"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END").alias("domain"),
    )


_ALIKE = "(contains(k.concept, a.concept) OR contains(a.concept, k.concept))"
ORACLE_KB = {}
ORACLE_KB["C15"] = f"""SELECT p_partkey, coalesce(string_agg('In ' || domain || ': ' || explanation, '; ' ORDER BY n, d), 'No direct connections') AS cross_text
    FROM (SELECT p_partkey, domain, arg_min(explanation, n) AS explanation, min(n) AS n, min(d) AS d FROM (
      SELECT a.p_partkey, a.n, k.domain, list_position(['math', 'physics', 'chemistry', 'economics', 'biology'], k.domain) AS d,
      arg_min(k.explanation, (CASE WHEN k.concept = a.concept THEN 0 ELSE 1 END, k.ord)) AS explanation
      FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS concept, unnest(range(len(string_split(p_name, ' ')))) AS n FROM part) a
      LEFT JOIN kb k ON {_ALIKE} GROUP BY ALL) GROUP BY p_partkey, domain) GROUP BY p_partkey"""
ORACLE_KB["C14"] = f"""SELECT c.p_partkey, coalesce(string_agg(k.domain || '=' || k.explanation, '|' ORDER BY k.ord), '') AS entries FROM (
    SELECT a.p_partkey, arg_min(k.concept, (CASE WHEN k.concept = a.concept THEN 0 ELSE 1 END, k.ord)) AS concept
    FROM kb_asked a LEFT JOIN kb k ON {_ALIKE} GROUP BY a.p_partkey) c LEFT JOIN kb k ON k.concept = c.concept GROUP BY c.p_partkey"""
ORACLE_KB["C13"] = """SELECT p_partkey, coalesce(string_agg(domain, '|' ORDER BY ord), '') AS domains FROM (
    SELECT a.p_partkey, k.domain, min(k.ord) AS ord FROM kb_asked a LEFT JOIN kb k
    ON k.concept = a.concept OR contains(lower(k.explanation), a.concept) GROUP BY ALL) GROUP BY p_partkey"""
ORACLE_KB["C12"] = f"""SELECT a.p_partkey, coalesce(arg_min(k.explanation, (CASE WHEN k.concept = a.concept THEN 0 ELSE 1 END, k.ord)), '') AS explanation
    FROM kb_asked a LEFT JOIN kb k ON k.domain = a.domain AND {_ALIKE} GROUP BY a.p_partkey"""


@query(
    "C12_kb_explanation",
    ORACLE_KB["C12"],
    _KB,
)
def _(t):
    return _asked(t).select(
        "p_partkey", lexicon.kb_explanation(F.col("concept"), F.col("domain"), KNOWLEDGE).alias("explanation")
    )


@query(
    "C13_kb_related_domains",
    ORACLE_KB["C13"],
    _KB,
)
def _(t):
    return _asked(t).select(
        "p_partkey", F.array_join(lexicon.kb_related_domains(F.col("concept"), KNOWLEDGE), "|").alias("domains")
    )


@query(
    "C14_kb_concept_map",
    ORACLE_KB["C14"],
    _KB,
)
def _(t):
    m = lexicon.kb_concept_map(F.col("concept"), KNOWLEDGE)
    entries = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _asked(t).select("p_partkey", F.array_join(entries, "|").alias("entries"))


@query(
    "C15_cross_domain_text",
    ORACLE_KB["C15"],
    _KB,
)
def _(t):
    return spread(t.read("part").select("p_partkey", "p_name")).select(
        "p_partkey", lexicon.cross_domain_text(F.split("p_name", " "), KNOWLEDGE).alias("cross_text")
    )


PROMPTS = 3


def prototypes(t):
    """The prompts of each label; labels 8 and 9 are the negatives.

    A category has ``PROMPTS`` prompts, its lowest vec_id: that is the size of a prompt list
    and a parameter of this workload. Spark keeps so many rows per label before the shuffle.
    """
    from pyspark.sql import Window

    e = t.read("embeddings")
    ranked = e.withColumn("prompt_no", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("prompt_no") <= PROMPTS)
    return ranked.select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        "prompt_no",
        (F.col("label") >= 8).alias("is_negative"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


PROTOTYPE_SQL = {
    "protos": f"""SELECT label, vec_id AS pid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {PROMPTS}""",
    "proto_scores": """SELECT f.ord, p.label, avg(list_inner_product(f.embedding, p.e)) AS mean_s,
        max(list_inner_product(f.embedding, p.e)) AS max_s FROM frames f, protos p GROUP BY f.ord, p.label""",
    "classified": """SELECT ord, arg_max(label, mean_s) FILTER (label < 8) AS best, max(mean_s) FILTER (label < 8) AS top,
        max(max_s) FILTER (label >= 8) AS worst FROM proto_scores GROUP BY ord""",
}


@query(
    "C16_prototype_classify",
    """SELECT ord, top > worst AS is_educational, CASE WHEN top > worst THEN 'c' || best ELSE 'non-educational' END AS label,
    round(CASE WHEN top > worst THEN top ELSE worst END, 6) AS confidence FROM classified""",
    PROTOTYPE_SQL,
)
def _(t):
    frames = t.frames.select("ord", "embedding")
    rows = vectors.prototype_classify(frames, prototypes(t))
    return rows.select("ord", "is_educational", "label", r6("confidence", "confidence"))


@query(
    "C17_scene_members",
    """SELECT f.ord, f.scene_id, s.start_time, s.end_time FROM (SELECT *, ord % 50 // 7 AS scene_id FROM frames) f
    JOIN (SELECT video_id, ord % 50 // 7 AS scene_id, min(t) AS start_time, max(t) AS end_time FROM frames GROUP BY 1, 2) s
    ON s.video_id = f.video_id AND f.t BETWEEN s.start_time AND s.end_time""",
)
def _(t):
    frames = t.frames.withColumn("scene_id", F.floor(F.col("ord") % 50 / 7))
    return aggregates.scene_members(frames, folds.scene_ranges(frames)).select("ord", "scene_id", "start_time", "end_time")


_ASKED_TEXT = {
    "asked_text": """SELECT video_id, idx, CASE WHEN idx % 3 = 2 THEN 'no such text' ELSE split_part(text, '. ', 1) END AS asked FROM segments"""
}


@query(
    "C18_find_segment_by_text",
    """SELECT a.video_id, a.idx, coalesce(min(s.idx), 0) AS seg_idx FROM asked_text a LEFT JOIN segments s ON s.video_id = a.video_id
    AND contains(lower(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(a.asked, '^\\s+|\\s+$', '', 'g')))
    GROUP BY a.video_id, a.idx""",
    _ASKED_TEXT,
)
def _(t):
    part = F.when(F.col("idx") % 3 == 2, "no such text").otherwise(F.split_part("text", F.lit(". "), F.lit(1)))
    asked = t.segments.select("video_id", "idx", part.alias("asked"))
    return find_segment_by_text(asked, t.segments, "asked").select("video_id", "idx", long("seg_idx"))


@query(
    "C19_short_id_join",
    """SELECT i.id, a.mode, a.text FROM interventions i JOIN (SELECT CAST(o_custkey % 100 AS VARCHAR) AS video_id,
    left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS id8, o_orderstatus AS mode, o_orderpriority AS text FROM orders) a
    ON a.video_id = i.video_id AND a.id8 = left(i.id, 8)""",
)
def _(t):
    stored = t.read("orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("video_id"),
        F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8).alias("id8"),
        F.col("o_orderstatus").alias("mode"),
        F.col("o_orderpriority").alias("text"),
    )
    return library.short_id_join(t.interventions, stored).select("id", "mode", "text")


# --- knowledge as a table: one entry per part, stored through H6 ---------------------

_TABLE = {
    "kb": """SELECT concept, domain, arg_max(explanation, ord) AS explanation, max(ord) AS ord FROM (
        SELECT lower(p_name) || ' ' || (p_partkey % 97) AS concept, CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics'
        ELSE 'chemistry' END AS domain, p_brand || ' of ' || p_name AS explanation, p_partkey AS ord FROM part) GROUP BY concept, domain""",
    "kb_asked": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || (p_partkey % 97) WHEN 1 THEN p_name
        WHEN 2 THEN 'the ' || p_name || ' ' || (p_partkey % 97) || ' here' ELSE 'none' END AS concept,
        CASE p_size % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END AS domain FROM part""",
}


def knowledge_table(t):
    p = t.read("part")
    numbered = F.concat(F.upper("p_name"), F.lit(" "), (F.col("p_partkey") % 97).cast("string"))
    added = p.select(
        numbered.alias("concept"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END").alias("domain"),
        F.concat("p_brand", F.lit(" of "), "p_name").alias("explanation"),
        F.col("p_partkey").alias("ord"),
    )
    return library.add_knowledge(added.where("false"), added)


def _asked_table(t):
    number = (F.col("p_partkey") % 97).cast("string")
    kind = F.col("p_partkey") % 4
    concept = (
        F.when(kind == 0, F.concat("p_name", F.lit(" "), number))
        .when(kind == 1, F.col("p_name"))
        .when(kind == 2, F.concat(F.lit("the "), "p_name", F.lit(" "), number, F.lit(" here")))
        .otherwise("none")
    )
    domain = F.expr("CASE p_size % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'physics' ELSE 'chemistry' END")
    return t.read("part").select("p_partkey", concept.alias("concept"), domain.alias("domain"))


@query("C12_kb_explanation_table", ORACLE_KB["C12"], _TABLE)
def _(t):
    return knowledge.explanations(_asked_table(t), knowledge_table(t)).select("p_partkey", "explanation")


@query("C13_kb_related_domains_table", ORACLE_KB["C13"], _TABLE)
def _(t):
    rows = knowledge.related_domains(_asked_table(t), knowledge_table(t))
    return rows.select("p_partkey", F.array_join("domains", "|").alias("domains"))


@query("C14_kb_concept_map_table", ORACLE_KB["C14"], _TABLE)
def _(t):
    rows = knowledge.concept_maps(_asked_table(t), knowledge_table(t))
    entries = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("p_partkey", F.array_join(entries, "|").alias("entries"))


@query("C15_cross_domain_text_table", ORACLE_KB["C15"], _TABLE)
def _(t):
    rows = spread(t.read("part").select("p_partkey", "p_name")).select("p_partkey", F.split("p_name", " ").alias("concepts"))
    return knowledge.cross_domain_texts(rows, "p_partkey", "concepts", knowledge_table(t)).select("p_partkey", F.col("cross_domain").alias("cross_text"))
