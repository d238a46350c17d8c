"""Bindings of the given tables to timeline tables, in Spark and as SQL text."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avsync.functions.text import format_mmss
from avsync.operators.timejoin import nearest_segment
from avsync.session import new_dir, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables and their timeline forms."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream."""
        path = f"{self.folder}/{name}.parquet"
        rows = self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{self.folder}/{name}*.parquet")
        # event time must carry a zone; the files hold UTC
        return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows

    def new_dir(self, name: str) -> str:
        return new_dir(self.spark, name)

    @property
    def segments(self) -> DataFrame:
        start = F.col("turn") * 10.0
        duration = F.least(F.lit(14.0), F.length("text") / 40.0)
        return self.read("conversations").select(
            F.col("conv_id").alias("video_id"),
            F.col("turn").alias("idx"),
            start.alias("start"),
            (start + duration).alias("end"),
            duration.alias("duration"),
            "text",
        )

    def as_keyframes(self, events: DataFrame) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        return events.select(
            (F.col("user_id") % 100).alias("video_id"),
            ((F.col("event_id") % 900) / 10.0).alias("t"),
            F.col("event_id").alias("ord"),
            (F.col("value") / 500.0).alias("complexity"),
            F.element_at(kind, F.col("event_type")).alias("content_type"),
            F.concat(F.lit("frames/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("frame_path"),
            (F.col("value") / 500.0).alias("clip_confidence"),
        )

    @property
    def keyframes(self) -> DataFrame:
        return self.as_keyframes(self.read("events"))

    @property
    def frames(self) -> DataFrame:
        return self.read("embeddings").select(
            F.floor(F.col("vec_id") / 50).alias("video_id"),
            ((F.col("vec_id") % 50) * 2.0).alias("t"),
            F.col("vec_id").alias("ord"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            (((F.col("vec_id") * 37) % 101) / 100.0).alias("complexity"),
            (F.col("label") < 6).alias("is_educational"),
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        )

    @property
    def video_durations(self) -> DataFrame:
        return self.frames.groupBy("video_id").agg((F.max("t") + 2).cast("int").alias("duration_seconds"))

    @property
    def snapshots(self) -> DataFrame:
        """Purchases stand for the frames a model has looked at."""
        return self.keyframes.where("content_type = 'diagram'").select(
            "video_id", "t", "ord", F.col("ord").cast("string").alias("snapshot_id"), "content_type"
        )

    @property
    def interventions(self) -> DataFrame:
        e = self.read("events")
        return e.select(
            F.md5(F.col("event_id").cast("string")).alias("id"),
            (F.col("user_id") % 100).cast("string").alias("video_id"),
            ((F.col("event_id") % 900) / 10.0).alias("t"),
            F.col("event_id").alias("ord"),
            F.element_at(
                F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type")
            ).alias("content_type"),
            (F.col("value") / 500.0).alias("complexity"),
            F.col("ts").alias("created_at"),
        )

    @property
    def explanations(self) -> DataFrame:
        o = self.read("orders").where("o_orderstatus = 'F'")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.md5(F.col("o_orderkey").cast("string")).alias("intervention_id"),
            mode_of_priority().alias("output_mode"),
            F.concat(F.lit("about "), F.col("o_totalprice").cast("int").cast("string")).alias("text_explanation"),
        )

    @property
    def requests(self) -> DataFrame:
        e = self.read("events")
        mode = (
            F.when(F.col("event_type") == "view", "brief")
            .when(F.col("event_type") == "click", "explanatory")
            .when(F.col("event_type") == "purchase", "detailed")
            .otherwise("standard")
        )
        return e.select(F.md5(F.col("event_id").cast("string")).alias("intervention_id"), mode.alias("output_mode"))

    @property
    def urls(self) -> DataFrame:
        tail = F.substring(F.md5("url"), 1, 11)
        shapes = [
            "https://youtu.be/", "https://www.youtube.com/watch?v=", "https://www.youtube.com/embed/",
            "https://youtube.com/shorts/", "https://www.youtube.com/watch?list=abc&v=", "https://www.youtube.com/v/",
        ]
        kind = F.col("page_id") % 7
        url = F
        for i, shape in enumerate(shapes):
            url = url.when(kind == i, F.concat(F.lit(shape), tail))
        return self.read("pages").select("page_id", url.otherwise(F.col("url")).alias("url"))

    @property
    def answers(self) -> DataFrame:
        """Model answers: bare, fenced, with a trailing comma, in chatter, cut off."""
        e = self.read("events")
        kind, word = F.col("event_id") % 5, F.col("event_type")
        text = (
            F.when(kind == 0, F.col("props"))
            .when(
                kind == 1,
                F.concat(F.lit('```json\n{"content_type": "'), word,
                         F.lit('", "layout": "left", "missing_elements": "null"}\n```')),
            )
            .when(kind == 2, F.concat(F.lit('{"detected_types": ["'), word, F.lit('", "text"], "text_readout": "v", }')))
            .when(kind == 3, F.concat(F.lit('Sure: {"content_type": "'), word, F.lit('"} as asked')))
            .otherwise(F.concat(F.lit('{"content_type": "'), word, F.lit('", "layo')))
        )
        return e.select("event_id", "event_type", text.alias("answer"))

    @property
    def saved_items(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_custkey").alias("id"),
            F.col("o_orderdate").alias("saved_at"),
            F.col("o_orderkey").alias("tie"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderstatus").alias("category"),
        )

    @property
    def viewer_rows(self) -> DataFrame:
        """Intervention points with the text spoken there."""
        said = nearest_segment(self.keyframes, self.segments).withColumn("transcript_context", F.col("seg_text"))
        return said.select(
            "video_id",
            F.col("ord").alias("id"),
            "content_type",
            format_mmss(F.col("t")).alias("timestamp_formatted"),
            "transcript_context",
            "frame_path",
        )


def mode_of_priority():
    first = F.substring("o_orderpriority", 1, 1)
    return F.when(first == "1", "brief").when(first == "2", "explanatory").when(first == "3", "detailed").otherwise("standard")


KINDS = {"view": "equation", "click": "graph", "purchase": "diagram", "signup": "slide", "error": "non-educational"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"

# the same bindings as SQL; a query text gets those it names, and those they name
CTES = {
    "segments": """SELECT conv_id AS video_id, turn AS idx, CAST(turn AS DOUBLE) * 10 AS start,
        CAST(turn AS DOUBLE) * 10 + least(14.0::DOUBLE, length(text) / 40.0::DOUBLE) AS "end",
        least(14.0::DOUBLE, length(text) / 40.0::DOUBLE) AS duration, text FROM conversations""",
    "keyframes": f"""SELECT user_id % 100 AS video_id, (event_id % 900) / 10.0::DOUBLE AS t, event_id AS ord,
        value / 500.0::DOUBLE AS complexity, {_KIND_SQL} AS content_type,
        'frames/' || event_id || '.jpg' AS frame_path, value / 500.0::DOUBLE AS clip_confidence FROM events""",
    "frames": """SELECT vec_id // 50 AS video_id, (vec_id % 50) * 2.0::DOUBLE AS t, vec_id AS ord,
        CAST(embedding AS DOUBLE[]) AS embedding, ((vec_id * 37) % 101) / 100.0::DOUBLE AS complexity,
        label < 6 AS is_educational, 'c' || label AS label FROM embeddings""",
    "video_durations": "SELECT video_id, CAST(max(t) + 2 AS INTEGER) AS duration_seconds FROM frames GROUP BY video_id",
    "snapshots": """SELECT video_id, t, ord, CAST(ord AS VARCHAR) AS snapshot_id, content_type FROM keyframes
        WHERE content_type = 'diagram'""",
    "interventions": f"""SELECT md5(CAST(event_id AS VARCHAR)) AS id, CAST(user_id % 100 AS VARCHAR) AS video_id,
        (event_id % 900) / 10.0::DOUBLE AS t, event_id AS ord, {_KIND_SQL} AS content_type,
        value / 500.0::DOUBLE AS complexity, ts AS created_at FROM events""",
    "explanations": """SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS intervention_id,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'brief' WHEN '2' THEN 'explanatory' WHEN '3' THEN 'detailed'
        ELSE 'standard' END AS output_mode, 'about ' || CAST(trunc(o_totalprice) AS INTEGER) AS text_explanation
        FROM orders WHERE o_orderstatus = 'F'""",
    "requests": """SELECT md5(CAST(event_id AS VARCHAR)) AS intervention_id, CASE event_type WHEN 'view' THEN 'brief'
        WHEN 'click' THEN 'explanatory' WHEN 'purchase' THEN 'detailed' ELSE 'standard' END AS output_mode FROM events""",
    "urls": """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://youtu.be/' || substr(md5(url), 1, 11)
        WHEN 1 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11)
        WHEN 2 THEN 'https://www.youtube.com/embed/' || substr(md5(url), 1, 11)
        WHEN 3 THEN 'https://youtube.com/shorts/' || substr(md5(url), 1, 11)
        WHEN 4 THEN 'https://www.youtube.com/watch?list=abc&v=' || substr(md5(url), 1, 11)
        WHEN 5 THEN 'https://www.youtube.com/v/' || substr(md5(url), 1, 11) ELSE url END AS url FROM pages""",
    "answers": """SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN props
        WHEN 1 THEN '```json' || chr(10) || '{"content_type": "' || event_type
            || '", "layout": "left", "missing_elements": "null"}' || chr(10) || '```'
        WHEN 2 THEN '{"detected_types": ["' || event_type || '", "text"], "text_readout": "v", }'
        WHEN 3 THEN 'Sure: {"content_type": "' || event_type || '"} as asked'
        ELSE '{"content_type": "' || event_type || '", "layo' END AS answer FROM events""",
    "saved_items": """SELECT o_custkey AS id, o_orderdate AS saved_at, o_orderkey AS tie, o_orderpriority AS title,
        o_orderstatus AS category FROM orders""",
    "viewer_rows": """SELECT k.video_id, k.ord AS id, k.content_type,
        printf('%02d:%02d', CAST(floor(k.t / 60) AS BIGINT), CAST(floor(k.t) AS BIGINT) % 60) AS timestamp_formatted,
        s.text AS transcript_context, k.frame_path
        FROM keyframes k LEFT JOIN (SELECT k.ord, arg_min(s.text, (CASE WHEN s.start <= k.t AND k.t <= s."end" THEN 0 ELSE 1 END,
        CASE WHEN s.start <= k.t AND k.t <= s."end" THEN 0.0 ELSE least(abs(s.start - k.t), abs(s."end" - k.t)) END, s.idx)) AS text
        FROM keyframes k JOIN segments s ON s.video_id = k.video_id GROUP BY k.ord) s ON s.ord = k.ord""",
}


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """The query with the bindings it names in front."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []
    seen: set[str] = set()

    def add(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                add(known[name])
                needed.append(name)

    add(sql)
    parts = [f"{n} AS ({known[n]})" for n in needed]
    recursive = "RECURSIVE " if any("UNION ALL" in known[n] or "USING KEY" in known[n] for n in needed) else ""
    head = f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else ""
    return head + textwrap.dedent(sql).strip()


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a query on ``Tables``, with its SQL where there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_ctes(sql, extra)
        return fn

    return wrap


def long(column: str, name: str | None = None):
    return F.col(column).cast("long").alias(name or column)


def r6(column, name: str):
    """Six places, by the same arithmetic as round() in the SQL texts."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name)
