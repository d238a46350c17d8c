"""Queries on aggregations, windows, sorts and set operations (D, E, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions import text
from avsync.operators import aggregates, folds, library, vectors
from avsync.operators.timejoin import joined_text, window_rows
from avsync.functions.lexicon import concepts_in
from workload.base import long, query, r6
from workload.scalars import _ladder

_CATS = ", ".join(f"count(*) FILTER (c = '{c}') AS {c}" for c in fixed.CATEGORIES)


@query(
    "D1_category_counts",
    f'SELECT video_id, {_CATS} FROM (SELECT video_id, {_ladder("content_type")} AS c FROM keyframes) GROUP BY video_id',
)
def _(t):
    return aggregates.category_counts(t.keyframes)


@query(
    "D2_content_type_counts",
    """SELECT video_id, string_agg(content_type || '=' || n, '|' ORDER BY content_type) AS counts
    FROM (SELECT video_id, content_type, count(*) AS n FROM keyframes GROUP BY 1, 2) GROUP BY video_id""",
)
def _(t):
    entries = F.map_entries("content_type_counts")
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return aggregates.content_type_counts(t.keyframes).select("video_id", joined.alias("counts"))


@query(
    "D3_dominant_type",
    """SELECT video_id, arg_min(content_type, (-n, first_t, first_ord)) AS dominant_type FROM (SELECT video_id, content_type,
    count(*) AS n, min(t) AS first_t, arg_min(ord, (t, ord)) AS first_ord FROM keyframes GROUP BY 1, 2) GROUP BY video_id""",
)
def _(t):
    return aggregates.dominant_type(t.keyframes)


@query(
    "D4_manifest_totals",
    """SELECT video_id, count(*) AS total_segments, count(*) FILTER (content_type = 'graph') AS intervention_count
    FROM keyframes GROUP BY video_id""",
)
def _(t):
    return aggregates.manifest_totals(t.keyframes.withColumn("is_intervention", F.col("content_type") == "graph"))


@query(
    "D5_batch_summary",
    """SELECT count(*) FILTER (o_orderstatus <> 'P') AS success, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS total,
    CAST(sum(o_custkey) FILTER (o_orderstatus <> 'P') AS BIGINT) AS total_frames,
    CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_time FROM orders""",
)
def _(t):
    report = t.read("orders").select(
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"),
        F.col("o_custkey").alias("keyframes"),
        F.floor("o_totalprice").alias("time_sec"),
    )
    return aggregates.batch_summary(report).withColumn("total_time", F.col("total_time").cast("long"))


@query(
    "D6_transcript_text",
    """SELECT video_id, md5(string_agg(text, ' ' ORDER BY idx)) AS transcript, count(*) AS entry_count
    FROM segments GROUP BY video_id""",
)
def _(t):
    rows = aggregates.transcript_text(t.segments)
    return rows.select("video_id", F.md5("transcript_text").alias("transcript"), "entry_count")


@query(
    "D6_transcript_text_parts",
    """SELECT video_id, md5(string_agg(text, ' ' ORDER BY idx)) AS transcript, count(*) AS entry_count
    FROM segments GROUP BY video_id""",
)
def _(t):
    rows = aggregates.transcript_text(t.segments, part_rows=3)
    return rows.select("video_id", F.md5("transcript_text").alias("transcript"), "entry_count")


_SIM = {
    "sims": """SELECT *, list_inner_product(embedding, lag(embedding) OVER (PARTITION BY video_id ORDER BY t, ord)) AS similarity
        FROM frames""",
    "sim_stats": """SELECT video_id, avg(similarity) AS mean_sim, stddev_pop(similarity) AS std_sim,
        greatest(-1.0, avg(similarity) - 1.5 * stddev_pop(similarity)) AS threshold FROM sims GROUP BY video_id""",
    "flagged": """SELECT s.*, coalesce(s.similarity < x.threshold, false) AS changed FROM sims s JOIN sim_stats x USING (video_id)""",
}


@query(
    "D7_similarity_stats",
    """SELECT video_id, round(mean_sim, 6) AS mean_sim, round(std_sim, 6) AS std_sim, round(threshold, 6) AS threshold FROM sim_stats""",
    _SIM,
)
def _(t):
    s = vectors.similarity_stats(vectors.neighbour_similarity(t.frames), floor=-1.0)
    return s.select("video_id", r6("mean_sim", "mean_sim"), r6("std_sim", "std_sim"), r6("threshold", "threshold"))


@query(
    "D8_video_totals",
    """SELECT coalesce(k.video_id, s.video_id) AS video_id, coalesce(k.n, 0) AS total_keyframes, coalesce(s.n, 0) AS total_interventions
    FROM (SELECT video_id, count(*) AS n FROM keyframes GROUP BY 1) k FULL JOIN
    (SELECT video_id, count(*) AS n FROM segments GROUP BY 1) s ON s.video_id = k.video_id""",
)
def _(t):
    return aggregates.video_totals(t.keyframes, t.segments)


@query(
    "D9_lane_counts",
    """SELECT v.video_id, l.lane, count(k.ord) FILTER (l.lane = 'all' OR k.content_type = l.lane) AS n
    FROM (SELECT DISTINCT video_id FROM keyframes) v, (VALUES ('equation'), ('diagram'), ('chart'), ('graph'), ('all')) AS l(lane)
    JOIN keyframes k ON k.video_id = v.video_id GROUP BY v.video_id, l.lane""",
)
def _(t):
    return aggregates.lane_counts(t.keyframes.withColumn("category", F.col("content_type")))


@query(
    "D10_best_in_group",
    """SELECT video_id, arg_min(ord, (-complexity, t, ord)) AS ord, max(complexity) AS complexity FROM frames WHERE is_educational
    GROUP BY video_id""",
)
def _(t):
    return aggregates.best_in_group(t.frames.drop("embedding"), ["video_id"]).select("video_id", "ord", "complexity")


_WINDOWED = {
    "windowed": """SELECT p.video_id, p.t, s.start, s.idx, s.text FROM (SELECT DISTINCT video_id, t FROM keyframes) p JOIN segments s
        ON s.video_id = p.video_id AND s.start <= p.t + 30 AND s."end" >= p.t - 30"""
}


@query(
    "D11_context_text",
    "SELECT video_id, t, md5(string_agg(text, ' ' ORDER BY start, idx)) AS context FROM windowed GROUP BY video_id, t",
    _WINDOWED,
)
def _(t):
    rows = window_rows(t.keyframes, t.segments, 30.0)
    return rows.groupBy("video_id", "t").agg(F.md5(joined_text(rows)).alias("context"))


@query(
    "D12_extract_concepts",
    """SELECT video_id, t, array_to_string(list_filter(['que', 'the', 'ein', 'la r'], lambda k: contains(x, k)), '|') AS concepts
    FROM (SELECT video_id, t, lower(coalesce(string_agg(text, ' ' ORDER BY start, idx) FILTER (start < t), '')) AS x
    FROM windowed GROUP BY video_id, t)""",
    _WINDOWED,
)
def _(t):
    rows = window_rows(t.keyframes, t.segments, 30.0)
    before = rows.groupBy("video_id", "t").agg(joined_text(rows, F.col("start") < F.col("t")).alias("x"))
    found = concepts_in(F.col("x"), ["que", "the", "ein", "la r"])
    return before.select("video_id", "t", F.array_join(found, "|").alias("concepts"))


@query(
    "D13_concepts_in_domain",
    "SELECT DISTINCT p_name AS concept FROM part WHERE p_type = 'ECONOMY'",
)
def _(t):
    kb = t.read("part").select(F.col("p_name").alias("concept"), F.lower("p_type").alias("domain"))
    return library.concepts_in_domain(kb, " Economy")


_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "D14_table_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _ALL),
)
def _(t):
    return aggregates.table_counts({n: t.read(n) for n in _ALL})


@query(
    "D15_concept_history",
    """SELECT h.video_id, h.idx, h.start AS timestamp, md5(string_agg(s.text, ' ' ORDER BY s.start, s.idx)) AS context
    FROM segments h JOIN (SELECT video_id, max(start) AS last FROM segments GROUP BY 1) m ON m.video_id = h.video_id
    JOIN segments s ON s.video_id = h.video_id AND s.start <= h.start + 5 AND s."end" >= h.start - 5
    WHERE contains(lower(h.text), 'que') AND h.start >= m.last - 40 GROUP BY h.video_id, h.idx, h.start""",
)
def _(t):
    rows = aggregates.concept_history(t.segments, "Que", lookback=40.0)
    return rows.select("video_id", "idx", "timestamp", F.md5("context").alias("context"))


@query("E1_neighbour_similarity", "SELECT ord, round(similarity, 6) AS similarity FROM sims", _SIM)
def _(t):
    return vectors.neighbour_similarity(t.frames).select("ord", r6("similarity", "similarity"))


_TOPICS = {"french": ["que", "une"], "german": ["ein", "und"], "english": ["the"]}
_TOPIC_SQL = """CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'une') THEN 'french'
    WHEN contains(lower(text), 'ein') OR contains(lower(text), 'und') THEN 'german' WHEN contains(lower(text), 'the') THEN 'english' END"""


@query(
    "E2_topic_timeline",
    f"""SELECT video_id, printf('%.1f', start) AS time_key, arg_max(topic, (start, idx)) AS topic FROM (SELECT *,
    coalesce(last_value({_TOPIC_SQL} IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY start, idx), 'unknown') AS topic FROM segments)
    GROUP BY ALL""",
)
def _(t):
    return aggregates.topic_timeline(t.segments, _TOPICS)


@query(
    "E3_prev_next",
    """SELECT ord, lag(ord) OVER w AS prev_id, lead(ord) OVER w AS next_id FROM keyframes
    WINDOW w AS (PARTITION BY video_id ORDER BY t, ord)""",
)
def _(t):
    return aggregates.prev_next(t.keyframes, "ord").select("ord", "prev_id", "next_id")


@query(
    "E3_prev_next_cut",
    """SELECT ord, lag(ord) OVER w AS prev_id, lead(ord) OVER w AS next_id FROM keyframes
    WINDOW w AS (PARTITION BY video_id ORDER BY t, ord)""",
)
def _(t):
    # the form for over-long videos, forced by a low limit
    return aggregates.prev_next(t.keyframes, "ord", max_rows=40).select("ord", "prev_id", "next_id")


@query(
    "E4_scene_ranges",
    """SELECT video_id, scene_id, min(t) AS start_time, max(t) AS end_time, count(*) AS n_frames FROM (SELECT *,
    CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, ord) AS BIGINT) - 1 AS scene_id FROM (SELECT *,
    ord % 50 = 0 OR label = 'c3' AS b FROM frames)) GROUP BY video_id, scene_id""",
)
def _(t):
    begins = t.frames.where("ord % 50 = 0 OR label = 'c3'").select("video_id", "t", "ord")
    return folds.scene_ranges(folds.assign_scenes(t.frames.drop("embedding"), begins))


@query(
    "E5_sequence_no",
    "SELECT ord, row_number() OVER (PARTITION BY video_id ORDER BY t, ord) - 1 AS seq FROM keyframes",
)
def _(t):
    return aggregates.sequence_no(t.keyframes, ["t", "ord"]).select("ord", "seq")


@query("E6_similarity_change_flag", "SELECT ord, changed FROM flagged", _SIM)
def _(t):
    similar = vectors.neighbour_similarity(t.frames)
    return vectors.change_flags(similar, floor=-1.0).select("ord", "changed")


@query("G1_interventions_of_video", "SELECT id, t, content_type FROM interventions WHERE video_id = '7'")
def _(t):
    return library.interventions_of_video(t.interventions, "7").select("id", "t", "content_type")


@query(
    "G2_trim_to_maximum",
    """SELECT video_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY complexity DESC, t, ord) AS n
    FROM keyframes) WHERE n <= 8 + video_id % 5""",
)
def _(t):
    return folds.trim_to_maximum(t.keyframes, F.lit(8) + F.col("video_id") % 5).select("video_id", "ord")


@query(
    "G3_top1_fallback",
    """SELECT video_id, content_type, arg_min(ord, (-complexity, t, ord)) AS ord FROM keyframes GROUP BY 1, 2""",
)
def _(t):
    best = aggregates.best_in_group(t.keyframes, ["video_id", "content_type"], educational=False)
    return best.select("video_id", "content_type", "ord")


@query(
    "G4_slice_rows",
    """SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY video_id ORDER BY t, ord) - 1 AS n FROM keyframes)
    WHERE n >= 13 AND n < 20""",
)
def _(t):
    return aggregates.slice_rows(t.keyframes, ["t", "ord"], 13, 20).select("ord")


@query(
    "G5_head_with_rest",
    """SELECT video_id, idx, greatest(n - 3, 0) AS remaining, chars AS total_chars FROM (SELECT *,
    row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY video_id) AS n,
    CAST(sum(length(text)) OVER (PARTITION BY video_id) + count(*) OVER (PARTITION BY video_id) - 1 AS BIGINT) AS chars FROM segments)
    WHERE k <= 3""",
)
def _(t):
    return aggregates.head_with_rest(t.segments, 3).select("video_id", "idx", "remaining", "total_chars")


@query("G6_recent_first", "SELECT id, created_at FROM interventions")
def _(t):
    return library.newest_first(t.interventions).select("id", "created_at")


@query(
    "H1_upsert_latest",
    "SELECT id, arg_max(title, (saved_at, tie)) AS title, max(saved_at) AS saved_at FROM saved_items GROUP BY id",
)
def _(t):
    items = t.saved_items
    rows = library.upsert_latest(items.where("category <> 'O'"), items.where("category = 'O'"), tie="tie")
    return rows.select("id", "title", "saved_at")


@query("H2_remove_by_id", "SELECT id, tie FROM saved_items WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    gone = t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return library.remove_by_id(t.saved_items, gone).select("id", "tie")


@query(
    "H3_is_saved",
    "SELECT c_custkey AS id, c_custkey IN (SELECT id FROM saved_items WHERE category = 'F') AS is_saved FROM customer",
)
def _(t):
    rows = t.read("customer").select(F.col("c_custkey").alias("id"))
    return library.is_saved(rows, t.saved_items.where("category = 'F'"))


@query(
    "H4_set_bookmark",
    """SELECT i.id, coalesce(c.bookmarked, false) AS is_bookmarked FROM interventions i LEFT JOIN (SELECT id,
    arg_max(bookmarked, changed) AS bookmarked FROM (SELECT md5(CAST(o_custkey AS VARCHAR)) AS id, o_orderstatus = 'F' AS bookmarked,
    o_orderkey AS changed FROM orders) GROUP BY id) c ON c.id = i.id""",
)
def _(t):
    changes = t.read("orders").select(
        F.md5(F.col("o_custkey").cast("string")).alias("id"),
        (F.col("o_orderstatus") == "F").alias("bookmarked"),
        F.col("o_orderkey").alias("changed_at"),
    )
    rows = t.interventions.select("id").withColumn("is_bookmarked", F.lit(False))
    return library.set_bookmark(rows, changes)


@query(
    "H5_library_search",
    "SELECT p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')",
)
def _(t):
    items = t.read("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("video_title"),
        F.col("p_type").alias("category"),
    )
    return library.library_search(items, "  RING ").select("id", "title")


@query(
    "H6_add_knowledge",
    """SELECT concept, domain, arg_max(explanation, ord) AS explanation FROM (
    SELECT p_name AS concept, lower(p_type) AS domain, p_brand AS explanation, p_partkey AS ord FROM part
    UNION ALL SELECT lower(trim(p_name)), lower(p_type), p_brand, p_partkey + 1000000 FROM part WHERE p_size % 2 = 0)
    GROUP BY concept, domain""",
)
def _(t):
    p = t.read("part")
    kb = p.select(
        F.col("p_name").alias("concept"), F.lower("p_type").alias("domain"), F.col("p_brand").alias("explanation"),
        F.col("p_partkey").alias("ord"),
    )
    added = p.select(
        F.concat(F.lit(" "), F.upper("p_name"), F.lit("\n")).alias("concept"),
        F.col("p_type").alias("domain"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("explanation"),
        (F.col("p_partkey") + 1000000).alias("ord"),
    )
    return library.add_knowledge(kb, added).select("concept", "domain", "explanation")


@query(
    "H7_segments_with_interventions",
    """SELECT s.video_id, s.idx, arg_min(n.snapshot_id, (abs(n.t - s.start), n.ord)) AS snapshot_id, count(n.ord) > 0 AS is_intervention
    FROM segments s LEFT JOIN snapshots n ON n.video_id = s.video_id AND abs(n.t - s.start) <= 1.5
    AND n.ord = (SELECT max(x.ord) FROM snapshots x WHERE x.video_id = n.video_id AND x.t = n.t)
    GROUP BY s.video_id, s.idx""",
)
def _(t):
    rows = library.segments_with_interventions(t.segments, t.snapshots, 1.5)
    return rows.select("video_id", "idx", "snapshot_id", "is_intervention")


@query("H8_saved_key", "SELECT video_id || '-' || ord AS key FROM keyframes")
def _(t):
    return t.keyframes.select(text.saved_key(F.col("video_id"), F.col("ord")).alias("key"))


@query(
    "H9_filter_category",
    """SELECT 'graph' AS shown, ord FROM keyframes WHERE content_type = 'graph' UNION ALL SELECT 'all', ord FROM keyframes""",
)
def _(t):
    rows = t.keyframes.withColumn("category", F.col("content_type"))
    one, every = (
        aggregates.in_category(rows, c).select(F.lit(c).alias("shown"), "ord") for c in ("graph", "all")
    )
    return one.unionByName(every)

