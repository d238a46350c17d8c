"""Queries on column functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions import math_speech, model_json, prompts, scoring, text
from avsync.operators import aggregates
from avsync.sources.files import validate_segments
from avsync.session import spread
from workload.base import long, query, r6

_id = lambda p, i: f"nullif(regexp_extract(url, '{p}', {i}), '')"
_STRICT = fixed.VIDEO_ID_PATTERNS["strict"][0]
_LENIENT = fixed.VIDEO_ID_PATTERNS["lenient"][0]
_BATCH = fixed.VIDEO_ID_PATTERNS["batch"]
_CLIENT = fixed.VIDEO_ID_PATTERNS["client"]
_STRICT_URL = "url LIKE '%youtu.be/%' OR url LIKE '%watch?v=%' OR url LIKE '%/embed/%' OR url LIKE '%/shorts/%'"


@query(
    "B1_extract_video_id",
    f"""SELECT page_id, {_id(_LENIENT, 1)} AS lenient, coalesce({_id(_BATCH[0], 1)}, {_id(_BATCH[1], 1)}, url) AS batch,
    coalesce({", ".join(_id(p, 1) for p in _CLIENT)}) AS client,
    CASE WHEN {_STRICT_URL} THEN {_id(_STRICT, 1)} END AS strict FROM urls""",
)
def _(t):
    url = F.col("url")
    return t.urls.select(
        "page_id",
        *[text.extract_video_id(url, p).alias(p) for p in ("lenient", "batch", "client")],
        F.when(F.expr(_STRICT_URL), text.extract_video_id(url, "strict")).alias("strict"),
    )


@query("B2_is_video_url", f"SELECT page_id, {_id(_LENIENT, 1)} IS NOT NULL AS is_video FROM urls")
def _(t):
    return t.urls.select("page_id", text.is_video_url(F.col("url")).alias("is_video"))


_MM = "CAST(floor(l_extendedprice / 60) AS BIGINT), CAST(floor(l_extendedprice) AS BIGINT) % 60"


@query(
    "B3_format_mmss",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, printf('%02d:%02d', {_MM}) AS mmss, printf('%d:%02d', {_MM}) AS client
    FROM lineitem""",
)
def _(t):
    s = F.col("l_extendedprice")
    return t.read("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", text.format_mmss(s).alias("mmss"), text.format_mmss(s, client=True).alias("client")
    )


@query(
    "B4_format_mmss_ms",
    """SELECT event_id, printf('%02d:%02d.%03d', CAST(floor(value / 60) AS BIGINT), CAST(floor(value) AS BIGINT) % 60,
    CAST(floor((value - floor(value)) * 1000) AS BIGINT)) AS clock FROM events""",
)
def _(t):
    return t.read("events").select("event_id", text.format_mmss_ms(F.col("value")).alias("clock"))


@query(
    "B5_parse_clock",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 7) * 60.0 + event_id % 60
    WHEN 1 THEN (event_id % 5) * 3600.0 + (event_id % 60) * 60 + event_id % 59 ELSE 0.0 END::DOUBLE AS seconds FROM events""",
)
def _(t):
    clock = F.expr(
        """CASE event_id % 3 WHEN 0 THEN format_string('%d:%d', event_id % 7, event_id % 60)
        WHEN 1 THEN format_string('%d:%d:%d', event_id % 5, event_id % 60, event_id % 59) ELSE '17' END"""
    )
    return t.read("events").select("event_id", text.parse_clock(clock).alias("seconds"))


@query(
    "B6_frame_name",
    """SELECT event_id, printf('frame_%04d_%02d_%02d.jpg', event_id, s // 60, s % 60) AS name,
    printf('frame_%04d_%02d_%02d_%02d.jpg', event_id, s // 3600, s % 3600 // 60, s % 60) AS legacy
    FROM (SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS s FROM events)""",
)
def _(t):
    n, s = F.col("event_id"), F.col("value") * 20
    return t.read("events").select("event_id", text.frame_name(n, s).alias("name"), text.frame_name(n, s, legacy=True).alias("legacy"))


@query("B7_segment_end", 'SELECT video_id, idx, round("end", 6) AS end_s FROM segments')
def _(t):
    return t.segments.select("video_id", "idx", r6(text.segment_end(F.col("start"), F.col("duration")), "end_s"))


@query(
    "B8_validate_segments",
    """SELECT video_id, idx, start, round(CASE WHEN idx % 3 = 0 THEN start ELSE "end" END, 6) AS end_s,
    round(CASE WHEN idx % 3 = 0 THEN start ELSE "end" END + 1, 6) AS end_padded, text
    FROM segments WHERE idx % 5 <> 4 AND text IS NOT NULL AND length(text) > 40""",
)
def _(t):
    raw = t.segments.select(
        "video_id",
        "idx",
        F.when(F.col("idx") % 5 == 4, "soon").otherwise(F.col("start").cast("string")).alias("start"),
        F.when(F.col("idx") % 3 != 0, F.col("end")).alias("end"),
        F.when(F.length("text") > 40, F.col("text")).alias("text"),
    )
    plain = validate_segments(raw).select("video_id", "idx", "start", r6("end", "end_s"), "text")
    padded = validate_segments(raw, pad_end=1.0).select("video_id", "idx", r6("end", "end_padded"))
    return plain.join(padded, ["video_id", "idx"])


_SIX = "array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 6), ' ')"


@query(
    "B9_title_from_text",
    f"""SELECT doc_id, upper(left(w, 1)) || substr(w, 2) AS title,
    upper(left(source, 1)) || substr(source, 2) AS untitled FROM (SELECT doc_id, source, {_SIX} AS w FROM documents)""",
)
def _(t):
    return t.read("documents").select(
        "doc_id",
        text.title_from_text(F.col("text"), F.col("source")).alias("title"),
        text.title_from_text(F.lit(""), F.col("source")).alias("untitled"),
    )


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PARAS = f"""list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'),
    lambda p: {_STRIP.format(x="replace(p, chr(10), ' ')")}), lambda p: p <> '')"""


@query(
    "B10_explanation_parts",
    f"""SELECT doc_id, coalesce({_STRIP.format(x="regexp_extract(p[1], '^[^.!?]*') || '.'")}, '') AS subtitle,
    len(p) AS n_raw, CASE WHEN len(p) > 2 THEN p[-1] ELSE '' END AS key_insight,
    md5(array_to_string(CASE WHEN len(p) > 2 THEN p[:-2] ELSE p END, '|')) AS body
    FROM (SELECT doc_id, {_PARAS} AS p FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text
    FROM documents))""",
)
def _(t):
    # the texts hold no blank lines: sentence ends stand in for them
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    p = text.explanation_parts(spaced)
    rows = t.read("documents").select("doc_id", p.alias("p"))
    n = F.size("p.paragraphs") + F.when(F.col("p.key_insight") != "", 1).otherwise(0)
    return rows.select(
        "doc_id",
        F.col("p.subtitle").alias("subtitle"),
        n.cast("long").alias("n_raw"),
        F.col("p.key_insight").alias("key_insight"),
        F.md5(F.array_join("p.paragraphs", "|")).alias("body"),
    )


@query(
    "B11_split_sentences",
    """SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS sentences
    FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents
    WHERE text <> '')""",
)
def _(t):
    s = text.split_sentences(F.col("text"))
    return t.read("documents").where("text <> ''").select(
        "doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences")
    )


@query(
    "B12_squash_whitespace",
    """SELECT doc_id, md5(s) AS squashed, length(s) > 1000 AS is_long
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)""",
)
def _(t):
    c = F.col("text")
    return t.read("documents").select(
        "doc_id", F.md5(text.squash_whitespace(c)).alias("squashed"), text.is_long_text(c).alias("is_long")
    )


@query(
    "B13_viewer_points",
    f"""SELECT video_id, id, CASE content_type WHEN 'slide' THEN 'diagram' ELSE content_type END AS category,
    regexp_replace(timestamp_formatted, '^00:', '') AS timestamp,
    CASE WHEN coalesce(text, '') = '' THEN upper(left(content_type, 1)) || substr(content_type, 2)
    ELSE upper(left(w, 1)) || substr(w, 2) END AS title
    FROM (SELECT *, {_SIX} AS w FROM (SELECT *, transcript_context AS text FROM viewer_rows))
    WHERE content_type <> 'non-educational'""",
)
def _(t):
    return aggregates.viewer_points(t.viewer_rows).select("video_id", "id", "category", "timestamp", "title")


@query(
    "B14_duration_or_estimate",
    """SELECT c.c_custkey AS video_id, round(CASE WHEN d = 0 AND last IS NOT NULL THEN last + 60 ELSE d END, 6) AS duration
    FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS INTEGER) END AS d
    FROM customer) c
    LEFT JOIN (SELECT video_id, max(t) AS last FROM keyframes GROUP BY 1) k ON k.video_id = c.c_custkey""",
)
def _(t):
    dur = F.when(F.col("c_mktsegment") == "MACHINERY", 0).otherwise(F.floor(F.abs("c_acctbal")).cast("int"))
    videos = t.read("customer").select(F.col("c_custkey").alias("video_id"), dur.alias("duration_seconds"))
    return aggregates.duration_or_estimate(videos, t.keyframes).select("video_id", r6("duration", "duration"))


@query(
    "B15_gate_content_type",
    """SELECT ord, CASE WHEN complexity < 0.40 THEN 'unknown' ELSE content_type END AS gated FROM keyframes""",
)
def _(t):
    return t.keyframes.select("ord", scoring.gate_content_type(F.col("content_type"), F.col("complexity")).alias("gated"))


def _ladder(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{p}') THEN '{n}'" for p, n in fixed.CATEGORY_LADDER) + " ELSE 'unknown' END"


@query(
    "B16_category_of",
    f"""SELECT p_partkey, {_ladder("x")} AS category FROM (SELECT p_partkey, CASE p_partkey % 15
    {" ".join(f"WHEN {i} THEN '{n.title()} ' || p_type" for i, (n, _) in enumerate(fixed.CATEGORY_LADDER))}
    ELSE p_type END AS x FROM part)""",
)
def _(t):
    kind = F
    for i, (n, _name) in enumerate(fixed.CATEGORY_LADDER):
        kind = kind.when(F.col("p_partkey") % 15 == i, F.concat(F.lit(n.title() + " "), F.col("p_type")))
    return t.read("part").select("p_partkey", scoring.category_of(kind.otherwise(F.col("p_type"))).alias("category"))


@query(
    "B17_subject_of",
    "SELECT ord, CASE content_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SUBJECTS.items())
    + " ELSE 'General' END AS subject FROM keyframes",
)
def _(t):
    return t.keyframes.select("ord", scoring.subject_of(F.col("content_type")).alias("subject"))


@query(
    "B18_frame_targets",
    """SELECT o_orderkey, CAST(greatest(5, floor(d / 60 * 1.5::DOUBLE)) AS BIGINT) AS target_min,
    CAST(greatest(8, floor(d / 60 * 4)) AS BIGINT) AS target_max
    FROM (SELECT o_orderkey, floor(o_totalprice / 100) AS d FROM orders)""",
)
def _(t):
    n = scoring.frame_targets(F.floor(F.col("o_totalprice") / 100))
    rows = t.read("orders").select("o_orderkey", n.alias("n"))
    return rows.select("o_orderkey", long("n.target_min", "target_min"), long("n.target_max", "target_max"))


_FEATURES = """l_quantity / 50 AS edge, l_extendedprice / 40000 AS txt, l_discount * 12 AS contrast, l_tax * 5 AS gradient,
    l_quantity / 100 AS colour"""


@query(
    "B19_weighted_score",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, round(least(1.0, 0.30::DOUBLE * edge + 0.25::DOUBLE * least(1.0, txt)
    + 0.20::DOUBLE * least(1.0, contrast) + 0.15::DOUBLE * gradient + 0.10::DOUBLE * colour), 6) AS score
    FROM (SELECT *, {_FEATURES} FROM lineitem)""",
)
def _(t):
    c = F.col
    score = scoring.weighted_score(
        c("l_quantity") / 50, c("l_extendedprice") / 40000, c("l_discount") * 12, c("l_tax") * 5, c("l_quantity") / 100
    )
    return t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r6(score, "score"))


@query("B20_is_blank", "SELECT event_id, value < 20 OR value / 500 < 0.02 AS blank FROM events")
def _(t):
    return t.read("events").select("event_id", scoring.is_blank(F.col("value"), F.col("value") / 500).alias("blank"))


@query(
    "B21_is_garbage",
    """SELECT event_id, value / 2 <= 5 OR value >= 250 OR value / 1000 < 0.1 OR value > 254 AS garbage FROM events""",
)
def _(t):
    v = F.col("value")
    mean = F.when(v > 254, v).otherwise(v / 1000)
    return t.read("events").select("event_id", scoring.is_garbage(v, v / 2, mean).alias("garbage"))


@query(
    "B22_keyframe_confidence",
    "SELECT ord, round(CASE WHEN is_educational THEN complexity ELSE 0.0 END, 4) AS confidence FROM frames",
)
def _(t):
    return t.frames.select("ord", scoring.keyframe_confidence(F.col("is_educational"), F.col("complexity")).alias("confidence"))


_HIT = lambda terms, x: "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


@query("B23_phrase_hit", f"SELECT doc_id, {_HIT(['the', 'que', 'ein '], 'lower(text)')} AS hit FROM documents")
def _(t):
    return t.read("documents").select("doc_id", scoring.phrase_hit(F.col("text"), ["the", "que", "ein "]).alias("hit"))


DEICTIC, NEGATIVE = ["the", "que"], ["ein"]
RULES_SQL = {
    "dei": f"coalesce({_HIT(DEICTIC, 'lower(x)')}, false)",
    "neg": f"coalesce({_HIT(NEGATIVE, 'lower(x)')}, false)",
    "sil": "coalesce(length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) < 10, false) AND c > 0.3",
    "hig": "c > 0.3",
}
SCORE_SQL = """CASE WHEN dei THEN 50 ELSE 0 END + CASE WHEN neg THEN -50 ELSE 0 END
    + CASE WHEN sil THEN 80 ELSE 0 END + CASE WHEN hig THEN 50 ELSE 0 END"""
REASON_SQL = """coalesce(nullif(concat_ws(' + ', CASE WHEN dei THEN 'Deictic' END, CASE WHEN neg THEN 'Negative Deictic' END,
    CASE WHEN sil THEN 'Silent Drawing' END, CASE WHEN hig THEN 'High Complexity' END), ''), 'Unknown')"""
_RULED = {
    "ruled": "SELECT video_id, idx, "
    + ", ".join(f"{v} AS {k}" for k, v in RULES_SQL.items())
    + " FROM (SELECT video_id, idx, CASE WHEN idx % 4 = 0 THEN ' so' || chr(10) ELSE text END AS x, (idx % 5) / 10.0::DOUBLE AS c FROM segments)"
}


def _rules(t):
    x = F.when(F.col("idx") % 4 == 0, " so\n").otherwise(F.col("text"))
    return t.segments, scoring.fired_rules(x, F.col("idx") % 5 / 10.0, DEICTIC, NEGATIVE)


@query("B24_intervention_score", f"SELECT video_id, idx, CAST({SCORE_SQL} AS BIGINT) AS score FROM ruled", _RULED)
def _(t):
    rows, rules = _rules(t)
    return rows.select("video_id", "idx", scoring.intervention_score(rules).cast("long").alias("score"))


@query("B25_trigger_reason", f"SELECT video_id, idx, {REASON_SQL} AS reason FROM ruled", _RULED)
def _(t):
    rows, rules = _rules(t)
    return rows.select("video_id", "idx", scoring.trigger_reason(rules).alias("reason"))


@query(
    "B26_confidence_bucket",
    """SELECT event_id, CASE WHEN s >= 100 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS bucket
    FROM (SELECT event_id, floor(value / 3) AS s, value / 500 AS c FROM events) WHERE s >= 50 OR c > 0.25""",
)
def _(t):
    s = F.floor(F.col("value") / 3)
    rows = t.read("events").where(scoring.is_intervention(s, F.col("value") / 500))
    return rows.select("event_id", scoring.confidence_bucket(s).alias("bucket"))


def _math_sql(x: str) -> str:
    out = x
    for find, put, is_pattern in math_speech.rules():
        f, p = find.replace("'", "''"), put.replace("'", "''")
        out = f"regexp_replace({out}, '{f}', '{p}', 'g')" if is_pattern else f"replace({out}, '{f}', '{p}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_NOTE = """'x_' || l_linenumber || ' = y^' || CAST(l_quantity AS INTEGER) || CASE l_linenumber % 4
    WHEN 0 THEN ' + f(x)/g' WHEN 1 THEN ' - dy/dx * 2' WHEN 2 THEN ' + sin e^3 and 3/4' ELSE '' END"""


def _note():
    tail = F.expr(
        """CASE l_linenumber % 4 WHEN 0 THEN ' + f(x)/g' WHEN 1 THEN ' - dy/dx * 2'
        WHEN 2 THEN ' + sin e^3 and 3/4' ELSE '' END"""
    )
    return F.concat(
        F.lit("x_"), F.col("l_linenumber").cast("string"), F.lit(" = y^"), F.col("l_quantity").cast("int").cast("string"), tail
    )


@query("B27_linearize_math", f"SELECT l_orderkey, l_partkey, l_linenumber, {_math_sql('n')} AS spoken FROM (SELECT *, {_NOTE} AS n FROM lineitem)")
def _(t):
    rows = spread(t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", _note().alias("n")))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", math_speech.linearize_math(F.col("n")).alias("spoken"))


@query(
    "B28_linearize_snapshot",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, {_math_sql('n')} AS text_readout, n AS kept, {_math_sql("'a+' || n")} AS element
    FROM (SELECT *, {_NOTE} AS n FROM lineitem)""",
)
def _(t):
    fields = ["text_readout", "kept", "elements"]
    element = F.create_map(F.lit("label"), F.concat(F.lit("a+"), F.col("n")))
    snap = F.struct(F.col("n").alias("text_readout"), F.col("n").alias("kept"), F.array(element).alias("elements"))
    rows = spread(t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", _note().alias("n")))
    rows = rows.withColumn("s", math_speech.linearize_snapshot(snap, fields))
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", "s.text_readout", "s.kept", F.col("s.elements")[0]["label"].alias("element")
    )


_CLEAN = """regexp_replace(trim(replace(regexp_replace(answer, '```(json)?\\s*\\n?', '', 'g'), '```', ''), ' ' || chr(10)),
    ',\\s*\\}', '}', 'g')"""
_STRICT_JSON = f"""SELECT event_id, json_valid(c) AS parsed, CASE WHEN json_valid(c) THEN coalesce(j->>'$.content_type',
    j->>'$.detected_types[0]', 'unknown') ELSE 'unknown' END AS content_type,
    CASE WHEN json_valid(c) THEN coalesce(j->>'$.layout', '') ELSE c END AS layout,
    CASE WHEN json_valid(c) THEN coalesce(j->>'$.text_readout', '') ELSE c END AS text_readout,
    CASE WHEN NOT json_valid(c) THEN 'Parse error' WHEN (j->>'$.missing_elements') = 'null' THEN NULL
    ELSE j->>'$.missing_elements' END AS missing_elements,
    CAST(CASE WHEN json_valid(c) AND (j->'$.detected_types') IS NOT NULL THEN json_array_length(j->'$.detected_types')
    ELSE 1 END AS BIGINT) AS n_types
    FROM (SELECT event_id, c, CASE WHEN json_valid(c) THEN c::JSON END AS j FROM (SELECT event_id, {_CLEAN} AS c FROM answers))"""


@query("B29_parse_model_json", _STRICT_JSON)
def _(t):
    rows = t.answers.select("event_id", model_json.parse_model_json(F.col("answer"), "strict").alias("p"))
    return rows.select(
        "event_id", "p.parsed", "p.content_type", "p.layout", "p.text_readout", "p.missing_elements",
        F.size("p.detected_types").cast("long").alias("n_types"),
    )


@query(
    "B29_parse_model_json_braces",
    """SELECT event_id, json_valid(c) AS parsed, coalesce(CASE WHEN json_valid(c) THEN c::JSON->>'$.content_type' END,
    event_type) AS content_type, CASE WHEN json_valid(c) THEN '' ELSE 'Error: JSON parse error' END AS structural_description,
    CASE WHEN json_valid(c) THEN NULL ELSE 'JSON parse error' END AS error FROM (SELECT event_id, event_type,
    regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(answer, '(?s)\\{.*\\}'), ''), answer), ',\\s*\\}', '}', 'g'),
    ',\\s*\\]', ']', 'g') AS c FROM answers)""",
)
def _(t):
    p = model_json.parse_model_json(F.col("answer"), "braces", F.col("event_type"))
    rows = t.answers.select("event_id", p.alias("p"))
    return rows.select("event_id", "p.parsed", "p.content_type", "p.structural_description", F.col("p._error").alias("error"))


@query(
    "B29_parse_model_json_retry",
    f"""SELECT event_id, ok AS parsed, CASE WHEN ok THEN coalesce(j->>'$.content_type', '[MISSING: content_type]')
    ELSE event_type END AS content_type, CASE WHEN ok THEN '[MISSING: visual_structure]' ELSE answer END AS visual_structure
    FROM (SELECT event_id, event_type, answer, json_valid(c) OR json_valid(b) AS ok,
    CASE WHEN json_valid(c) THEN c::JSON WHEN json_valid(b) THEN b::JSON END AS j FROM (SELECT event_id, event_type, answer, c,
    regexp_extract(c, '(?s)\\{{.*\\}}') AS b FROM (SELECT event_id, event_type, answer, {_CLEAN} AS c FROM answers)))""",
)
def _(t):
    p = model_json.parse_model_json(F.col("answer"), "retry", F.col("event_type"))
    return t.answers.select("event_id", p.alias("p")).select("event_id", "p.parsed", "p.content_type", "p.visual_structure")


@query(
    "B30_illegible_ratio",
    """SELECT video_id, idx, round(n / nullif(r, 0), 6) AS ratio, CASE WHEN r > 0 AND n / r > 0.2 AND idx % 2 = 0
    THEN 'OCR fallback required' END AS missing_elements FROM (SELECT video_id, idx, CAST(idx AS DOUBLE) AS n,
    length(regexp_replace(CASE WHEN idx % 3 = 2 THEN 'x = 2' ELSE text END, '^\\s+|\\s+$', '', 'g')) AS r FROM segments)""",
)
def _(t):
    rest = F.when(F.col("idx") % 3 == 2, "x = 2").otherwise(F.col("text"))
    x = F.concat(F.expr("repeat('[ILLEGIBLE]', cast(idx as int))"), rest)
    kind = F.when(F.col("idx") % 2 == 0, "Equation").otherwise("graph")
    none = F.lit(None).cast("string")
    return t.segments.select(
        "video_id", "idx", r6(scoring.illegible_ratio(x), "ratio"), scoring.illegible_gate(none, x, kind).alias("missing_elements")
    )


@query(
    "B31_missing_gate",
    "SELECT event_id, event_id % 4 = 3 AS transcript_only FROM events",
)
def _(t):
    m = F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN 'None' ELSE event_type END")
    return t.read("events").select("event_id", scoring.missing_gate(m).alias("transcript_only"))


@query(
    "B32_mismatch_flag",
    f"""SELECT video_id, idx, CASE idx % 3 WHEN 0 THEN {_HIT(['the', 'une'], 'lower(text)')}
    WHEN 1 THEN {_HIT(['ein'], 'lower(text)')} ELSE false END AS mismatch FROM segments""",
)
def _(t):
    kind = F.expr("CASE idx % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'code' ELSE 'other' END")
    table = {"graph": ["the", "une"], "code": ["ein"]}
    return t.segments.select("video_id", "idx", scoring.mismatch_flag(kind, F.col("text"), table).alias("mismatch"))


_MODES = "CASE event_id % 6 WHEN 0 THEN 'Brief' WHEN 1 THEN 'explanatory' WHEN 2 THEN 'DETAILED' WHEN 3 THEN NULL WHEN 4 THEN 'standard' ELSE event_type END"


@query(
    "B33_normalize_mode",
    f"""SELECT event_id, mode, CASE mode WHEN 'explanatory' THEN 60.0 WHEN 'detailed' THEN 120.0 ELSE 30.0 END::DOUBLE AS seconds
    FROM (SELECT event_id, CASE WHEN lower({_MODES}) IN ('brief', 'explanatory', 'detailed', 'standard') THEN lower({_MODES})
    ELSE 'standard' END AS mode FROM events)""",
)
def _(t):
    m = F.expr(_MODES)
    return t.read("events").select("event_id", scoring.normalize_mode(m).alias("mode"), scoring.mode_window(m).alias("seconds"))


@query(
    "B34_weave_mode",
    f"""SELECT video_id, idx, CASE WHEN contains(r, 'Deictic') OR contains(r, 'High Complexity') THEN 'deictic'
    WHEN contains(r, 'Silent') OR contains(r, 'Drawing') THEN 'narrator' ELSE 'bridge' END AS weave
    FROM (SELECT video_id, idx, {REASON_SQL} AS r FROM ruled)""",
    _RULED,
)
def _(t):
    rows, rules = _rules(t)
    return rows.select("video_id", "idx", scoring.weave_mode(scoring.trigger_reason(rules)).alias("weave"))


_TEMPLATES = {"brief": "B {text}: {previous_concepts}", "detailed": "D {text} / {reading_order}", "": "E {text}"}


@query(
    "B35_render_prompt",
    """SELECT video_id, idx, CASE idx % 3 WHEN 0 THEN 'B ' || text || ': ' || CASE WHEN contains(text, 'a') THEN 'a, b' ELSE 'None' END
    WHEN 1 THEN 'D ' || text || ' / ' || 'Not specified' ELSE 'E ' || text END AS prompt FROM segments""",
)
def _(t):
    mode = F.expr("CASE idx % 3 WHEN 0 THEN 'brief' WHEN 1 THEN 'detailed' ELSE 'standard' END")
    none = F.array().cast("array<string>")
    fields = {
        "text": F.col("text"),
        "previous_concepts": F.when(F.contains("text", F.lit("a")), F.array(F.lit("a"), F.lit("b"))).otherwise(none),
        "reading_order": none,
    }
    return t.segments.select("video_id", "idx", prompts.render_prompt(mode, fields, _TEMPLATES).alias("prompt"))


@query(
    "B36_render_vision_prompt",
    """SELECT ord, 'Look. Type: ' || content_type || chr(10) || CASE content_type WHEN 'graph' THEN 'Name axes.'
    WHEN 'equation' THEN 'Read symbols.' ELSE 'Say what is seen.' END AS prompt FROM keyframes""",
)
def _(t):
    table = {"graph": "Name axes.", "equation": "Read symbols.", "unknown": "Say what is seen."}
    return t.keyframes.select(
        "ord", prompts.render_vision_prompt(F.col("content_type"), table, "Look. ", "unknown").alias("prompt")
    )


@query(
    "B37_explanation_or_transcript",
    "SELECT video_id, idx, CASE WHEN idx % 3 = 0 THEN text ELSE 'told ' || idx END AS explanation FROM segments",
)
def _(t):
    made = F.expr("CASE idx % 6 WHEN 0 THEN NULL WHEN 3 THEN ' ' ELSE concat('told ', idx) END")
    return t.segments.select("video_id", "idx", scoring.explanation_or_transcript(made, F.col("text")).alias("explanation"))


@query(
    "B38_asset_urls",
    """SELECT page_id, 'https://www.youtube.com/watch?v=' || v AS watch, 'https://i.ytimg.com/vi/' || v || '/hqdefault.jpg' AS thumb,
    CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'data-url:data/' || v ELSE 'http://127.0.0.1:8000/out/' || v END AS served
    FROM (SELECT page_id, url, substr(md5(url), 1, 11) AS v FROM pages)""",
)
def _(t):
    v = F.substring(F.md5("url"), 1, 11)
    kind = F.col("page_id") % 3
    path = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("data/"), v)).otherwise(F.concat(F.lit("./out/"), v))
    return t.read("pages").select(
        "page_id", text.watch_url(v).alias("watch"), text.thumbnail_url(v).alias("thumb"), text.served_url(path).alias("served")
    )


@query("B39_normalize_path", "SELECT page_id, url AS path FROM pages")
def _(t):
    return t.read("pages").select("page_id", text.normalize_path(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


@query(
    "B40_usage_columns",
    """SELECT doc_id, CAST(n_chars * 12345 // 1000000 AS BIGINT) AS total_ms,
    CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents""",
)
def _(t):
    return t.read("documents").select(
        "doc_id", text.total_ms(F.col("n_chars") * 12345).alias("total_ms"), text.word_count(F.col("text")).cast("long").alias("words")
    )


@query(
    "B41_timeline_position",
    """SELECT ord, round(72 + t / 90.0::DOUBLE * 668, 6) AS x FROM keyframes""",
)
def _(t):
    return t.keyframes.select("ord", r6(text.timeline_x(F.col("t"), F.lit(90.0)), "x"))


@query(
    "B41_ruler_ticks",
    """SELECT o_orderkey, array_to_string(list_transform(range(n), lambda i: CAST(floor(i * (d / (n - 1)) + 0.5) AS BIGINT)), ',') AS ticks
    FROM (SELECT o_orderkey, d, CAST(least(6, ceil(d / 60) + 1) AS BIGINT) AS n
    FROM (SELECT o_orderkey, 1 + floor(o_totalprice / 1000) AS d FROM orders))""",
)
def _(t):
    ticks = text.ruler_ticks(F.floor(F.col("o_totalprice") / 1000) + F.lit(1.0))
    return t.read("orders").select("o_orderkey", F.array_join(ticks.cast("array<string>"), ",").alias("ticks"))


@query(
    "B42_job_stage",
    """SELECT event_id, CASE WHEN p < 20 THEN 'downloading' WHEN p < 45 THEN 'extracting' WHEN p < 80 THEN 'detecting'
    WHEN p < 100 THEN 'generating' ELSE 'done' END AS stage FROM (SELECT event_id, event_id % 101 AS p FROM events)""",
)
def _(t):
    return t.read("events").select("event_id", text.job_stage(F.col("event_id") % 101).alias("stage"))

