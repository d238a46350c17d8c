"""What was said around a moment: text, concepts, principles, topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avsync.functions import lexicon
from avsync.functions.scoring import mode_window, normalize_mode
from avsync.operators.textmatch import find_segment_by_text
from avsync.operators.timejoin import joined_text, window_rows


def context_rows(
    points: DataFrame,
    segments: DataFrame,
    concepts: list[str] | None = None,
    principles: dict[str, list[str]] | None = None,
    topics: dict[str, list[str]] | None = None,
    whole_word: bool = False,
    of_concepts: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Context of each distinct (video_id, t, mode): texts within the mode's window of t.

    Concepts come from rows that start before t; topics are carried on within the window.
    ``of_concepts`` adds columns that are worked out from the concepts, once per context.
    """
    asked = points.select("video_id", "t", normalize_mode(F.col("mode")).alias("mode")).distinct()
    rows = window_rows(asked, segments, mode_window(F.col("mode")))
    # the last topic is carried on; of rows with one key the last counts, and they stand together
    so_far = Window.partitionBy("video_id", "t", "w").orderBy("start", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    topic = F.last(lexicon.topic_of(F.col("text"), topics), ignorenulls=True).over(so_far)
    rows = rows.withColumn("topic", F.coalesce(topic, F.lit("unknown"))).withColumn("key", F.format_string("%.1f", F.col("start")))
    grouped = rows.groupBy("video_id", "t", "w").agg(
        joined_text(rows).alias("context_text"),
        joined_text(rows, F.col("start") < F.col("t")).alias("_before"),
        F.array_sort(F.collect_list(F.struct("start", "idx", "key", "topic"))).alias("_items"),
    )
    lasts = F.filter("_items", lambda r, i: F.coalesce(F.get("_items", i + 1)["key"] != r["key"], F.lit(True)))
    carried = F.transform(lasts, lambda r: F.struct(r["key"], r["topic"]))
    found = grouped.withColumn("previous_concepts", lexicon.concepts_in(F.col("_before"), concepts, whole_word)).select(
        "video_id",
        "t",
        "w",
        "context_text",
        "previous_concepts",
        lexicon.principles_of(F.col("previous_concepts"), principles).alias("related_principles"),
        F.map_from_entries(carried).alias("topic_timeline"),
    )
    none = F.array().cast("array<string>")
    joined = asked.withColumn("w", mode_window(F.col("mode"))).join(found, ["video_id", "t", "w"], "left")
    return joined.select(
        "video_id",
        "t",
        "mode",
        F.coalesce("context_text", F.lit("")).alias("context_text"),
        F.coalesce("previous_concepts", none).alias("previous_concepts"),
        F.coalesce("related_principles", none).alias("related_principles"),
        F.coalesce("topic_timeline", F.create_map().cast("map<string,string>")).alias("topic_timeline"),
        F.col("w").alias("window_size"),
    ).withColumns({name: make(F.col("previous_concepts")) for name, make in (of_concepts or {}).items()})


def build_context(
    asked: DataFrame, segments: DataFrame, text: str = "transcript_context", **lexicons
) -> DataFrame:
    """``asked`` (video_id, transcript_context, mode, ...) with the context of the segment spoken there.

    The segment is the first that holds the text; its start is the moment looked at.
    """
    found = find_segment_by_text(asked.withColumn("text", F.col(text)), segments).drop("text")
    starts = segments.select("video_id", F.col("idx").cast("long").alias("seg_idx"), F.col("start").alias("t"))
    placed = (
        found.withColumn("mode", normalize_mode(F.col("mode")))
        .drop("t")
        .join(starts, ["video_id", "seg_idx"], "left")
        .withColumn("t", F.coalesce("t", F.lit(0.0)))
    )
    return placed.join(context_rows(placed, segments, **lexicons), ["video_id", "t", "mode"], "left")
