"""Joins on time within a video: interval, nearest and window.

Points are ``(video_id, t)``; segments are ``(video_id, idx, start, end, text)``.
Interval and nearest joins pair no rows: they work on one row per distinct time
and carry neighbours along it (see ``ordered``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.operators import ordered
from avsync.operators.ordered import find_cuts, max_so_far, next_min

MATCH_WINDOW = 30.0
SNAPSHOT_WINDOW = 30.0
BUCKET_SECONDS = 60.0


def match_segment(
    points: DataFrame, segments: DataFrame, limit: float | None = MATCH_WINDOW, max_rows: float | None = None
) -> DataFrame:
    """Points with the segment that holds t, else the nearest within ``limit``.

    Adds the segment's columns with seg_ before their names (NULL without a match). The
    lowest idx wins among holders and among equally near segments.
    """
    found = match_times(points.select("video_id", "t"), segments, limit, max_rows)
    texts = segments.select("video_id", *[F.col(c).alias(f"seg_{c}") for c in segments.columns if c != "video_id"])
    found = found.where("seg_idx IS NOT NULL").join(texts, ["video_id", "seg_idx"])
    return points.join(found, ["video_id", "t"], "left")


def nearest_segment(points: DataFrame, segments: DataFrame, max_rows: float | None = None) -> DataFrame:
    """``match_segment`` without a distance limit."""
    return match_segment(points, segments, None, max_rows)


def match_times(
    times: DataFrame, segments: DataFrame, limit: float | None = MATCH_WINDOW, max_rows: float | None = None
) -> DataFrame:
    """(video_id, t, seg_idx) for each distinct time, seg_idx NULL without a match.

    Distinct times of queries and segment ends lie on one line per video. Seen from the
    row on, the smallest idx among later ends is the first segment not over by t; if it
    has begun by t it is the answer. If it has not, no segment holds t as long as starts
    rise with idx; where they do not, those times go through ``_sweep``.
    """
    seg = segments.select("video_id", F.col("idx").cast("long").alias("idx"), "start", "end")
    ends = (
        seg.select("video_id", "idx", "start", F.explode(F.array("start", "end")).alias("t"), "end")
        .groupBy("video_id", "t")
        .agg(
            F.min("idx").alias("near"),
            F.min(F.when(F.col("t") == F.col("end"), F.struct("idx", "start"))).alias("ending"),
        )
    )
    asked = times.select("video_id", "t").where("t IS NOT NULL").distinct().withColumn("asked", F.lit(True))
    line = ends.unionByName(asked, allowMissingColumns=True)
    cuts = find_cuts(line, ["video_id"], ["t"], max_rows)
    known = F.col("near").isNotNull()
    line = ordered.scan(
        line,
        cuts,
        before=max_so_far(F.when(known, F.struct("t", (-F.col("near")).alias("neg")))),
        after=next_min(F.when(known, F.struct("t", F.col("near").alias("idx")))),
        first_open=next_min(F.col("ending")),
    ).where("asked")
    holds = F.coalesce(F.col("first_open.start") <= F.col("t"), F.lit(False))
    sides = F.array_compact(
        F.array(
            F.when(F.col("before").isNotNull(), _side(F.col("t") - F.col("before.t"), -F.col("before.neg"))),
            F.when(F.col("after").isNotNull(), _side(F.col("after.t") - F.col("t"), F.col("after.idx"))),
        )
    )
    line = line.select("video_id", "t", "first_open", holds.alias("holds"), F.array_min(sides).alias("best"))
    near = F.col("best.idx")
    if limit is not None:
        near = F.when(F.col("best.dist") <= F.lit(float(limit)), near)
    line = line.select(
        "video_id",
        "t",
        F.when(F.col("holds"), F.col("first_open.idx")).otherwise(near).alias("seg_idx"),
        (~F.col("holds") & F.col("first_open").isNotNull()).alias("unsure"),
    )
    if not _out_of_order(seg, max_rows):
        return line.drop("unsure")
    held = _sweep(line.where("unsure").select("video_id", "t"), seg, max_rows)
    return line.join(held, ["video_id", "t"], "left").select(
        "video_id", "t", F.coalesce("held_idx", "seg_idx").alias("seg_idx")
    )


def without_segment(rows: DataFrame) -> DataFrame:
    """Drop the columns that ``match_segment`` added."""
    return rows.drop(*[c for c in rows.columns if c.startswith("seg_")])


def _side(dist: Column, idx: Column) -> Column:
    return F.struct(dist.alias("dist"), idx.alias("idx"))


def _out_of_order(seg: DataFrame, max_rows: float | None) -> bool:
    cuts = find_cuts(seg, ["video_id"], ["idx"], max_rows)
    seen = ordered.scan(seg, cuts, prev=ordered.lag(F.col("start")))
    return not seen.where("start < prev").select("video_id").isEmpty()


def _sweep(times: DataFrame, seg: DataFrame, max_rows: float | None) -> DataFrame:
    """Lowest idx holding each time, for segments listed in any order."""
    seg = seg.where("end >= start")
    marks = times.unionByName(seg.select("video_id", F.col("start").alias("t"))).unionByName(
        seg.select("video_id", F.col("end").alias("t"))
    )
    cuts = find_cuts(marks.distinct(), ["video_id"], ["t"], max_rows).looked()
    if cuts.any:
        times = cuts.chunked(times).drop("_long")
        first = cuts.chunked(seg.withColumn("t", F.col("start"))).withColumnRenamed(ordered.CHUNK, "_a")
        both = cuts.chunked(first.drop("_long").withColumn("t", F.col("end"))).withColumnRenamed(ordered.CHUNK, "_b")
        edges = both.withColumn(ordered.CHUNK, F.explode(F.array_distinct(F.array("_a", "_b"))))
        # a chunk that lies wholly inside segments needs only the lowest of them
        spans = (
            both.where("_b - _a > 1")
            .withColumn(ordered.CHUNK, F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)))
            .groupBy(*cuts.group)
            .agg(F.min(F.struct("idx", "start", "end")).alias("s"))
            .select(*cuts.group, "s.*")
        )
        seg = edges.select(*cuts.group, "idx", "start", "end").unionByName(spans)
    key = times.schema["video_id"]

    def lowest(left: pa.Table, right: pa.Table) -> pa.Table:
        t = np.sort(left["t"].to_numpy())
        held = first_holder(
            t, right["idx"].to_numpy(), right["start"].to_numpy(), right["end"].to_numpy()
        )
        video = left["video_id"].combine_chunks().take(pa.array(np.zeros(len(t), dtype=np.int64)))
        idx = pa.array(held, mask=held < 0, type=pa.int64())
        return pa.table({"video_id": video, "t": pa.array(t), "held_idx": idx})

    # both sides may stem from one table: fresh names keep the grouping columns apart
    seg = seg.select(*[F.col(c).alias(c) for c in seg.columns])
    times = times.select(*[F.col(c).alias(c) for c in times.columns])
    schema = f"video_id {key.dataType.simpleString()}, t double, held_idx long"
    return times.groupBy(*cuts.group).cogroup(seg.groupBy(*cuts.group)).applyInArrow(lowest, schema)


def first_holder(t: np.ndarray, idx: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lowest idx with start <= t <= end for sorted ``t``, -1 if none."""
    held = np.full(len(t), -1, dtype=np.int64)
    free = list(range(len(t) + 1))  # next time at or after i not yet held

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    lo, hi = np.searchsorted(t, start, "left"), np.searchsorted(t, end, "right")
    for k in np.argsort(idx, kind="stable"):
        i = next_free(int(lo[k]))
        while i < hi[k]:
            held[i] = idx[k]
            free[i] = i + 1
            i = next_free(i)
    return held


def nearest_row(
    points: DataFrame,
    others: DataFrame,
    value: str,
    limit: float | None = SNAPSHOT_WINDOW,
    order: str = "ord",
    max_rows: float | None = None,
) -> DataFrame:
    """Points with ``value`` of the other row nearest in time.

    ``others`` is (video_id, t, order, value); on equal distance the lower ``order`` wins.
    """
    spots = others.groupBy("video_id", "t").agg(F.min(F.struct(order, F.col(value).alias("v"))).alias("spot"))
    asked = points.select("video_id", "t").where("t IS NOT NULL").distinct().withColumn("asked", F.lit(True))
    line = spots.unionByName(asked, allowMissingColumns=True)
    cuts = find_cuts(line, ["video_id"], ["t"], max_rows)
    spot = F.when(F.col("spot").isNotNull(), F.struct("t", "spot"))
    line = ordered.scan(line, cuts, before=max_so_far(spot), after=next_min(spot)).where("asked")
    sides = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c).isNotNull(),
                    F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("dist"), F.col(f"{c}.spot").alias("spot")),
                )
                for c in ("before", "after")
            ]
        )
    )
    line = line.select("video_id", "t", F.array_min(sides).alias("best"))
    if limit is not None:
        line = line.where(F.col("best.dist") <= F.lit(float(limit)))
    found = line.where("best IS NOT NULL").select(
        "video_id", "t", F.col("best.spot.v").alias(value), F.col("best.dist").alias("distance")
    )
    return points.join(found, ["video_id", "t"], "left")


def nearest_snapshot(points: DataFrame, snapshots: DataFrame, limit: float = SNAPSHOT_WINDOW, **kw) -> DataFrame:
    """Nearest snapshot_id within ``limit`` seconds."""
    return nearest_row(points, snapshots, "snapshot_id", limit, **kw)


def nearest_frame(points: DataFrame, frames: DataFrame, existing: DataFrame | None = None, **kw) -> DataFrame:
    """Nearest frame_path at any distance, NULL if ``existing`` lacks that path."""
    near = nearest_row(points, frames, "frame_path", None, **kw)
    if existing is None:
        return near
    there = existing.select(F.col("path").alias("frame_path"), F.lit(True).alias("_there")).distinct()
    return (
        near.join(there, "frame_path", "left")
        .withColumn("frame_path", F.when(F.col("_there"), F.col("frame_path")))
        .drop("_there")
    )


def window_rows(
    points: DataFrame, segments: DataFrame, window: Column | float, bucket: float = BUCKET_SECONDS
) -> DataFrame:
    """Segments that overlap [t - w, t + w], one row per (video_id, t, w, segment).

    Points at one time with one width are looked up once. A segment overlaps a window if it
    begins inside it, or holds the window's beginning; the two exclude each other. Both are
    a point in an interval: intervals lie on the few dyadic cells that make them up (two per
    doubling of their length, however long), points in each cell above them of a size that
    the video's intervals use. So each pair meets once and the rows made are the result.
    """
    w = window if isinstance(window, Column) else F.lit(float(window))
    asked = (
        points.select("video_id", "t", w.alias("w"))
        .distinct()
        .withColumn("lo", F.col("t") - F.col("w"))
        .withColumn("hi", F.col("t") + F.col("w"))
    )
    held = segments.select("video_id", "idx", "start", "end", "text").where("start <= end")
    out = ["video_id", "t", "w", "idx", "start", "end", "text"]
    begun = _in_cells(held, "start", asked, "lo", "hi", bucket).where("start >= lo AND start <= hi")
    open_then = _in_cells(asked, "lo", held, "start", "end", bucket).where("start < lo AND end >= lo")
    return begun.select(*out).unionByName(open_then.select(*out))


def dyadic_cells(lo: str, hi: str, bucket: float) -> Column:
    """(level, cell) of the dyadic cells that make up the buckets from ``lo`` to ``hi``; a cell of a
    level is two of the level below."""
    first, last = f"CAST(floor({lo} / {float(bucket)!r}D) AS BIGINT)", f"CAST(floor({hi} / {float(bucket)!r}D) AS BIGINT)"
    kind = "array<struct<level:int,cell:bigint>>"
    low, high = "CASE WHEN pmod(a.lo, 2) = 1 THEN 1 ELSE 0 END", "CASE WHEN pmod(a.hi, 2) = 0 AND a.lo < a.hi + pmod(a.lo + 1, 2) THEN 1 ELSE 0 END"
    return F.expr(
        f"""aggregate(
            sequence(0, CAST(ceil(log2(greatest({last} - {first}, 0) + 1)) AS INT) + 1),
            named_struct('lo', {first}, 'hi', {last}, 'cells', CAST(array() AS {kind})),
            (a, k) -> CASE WHEN a.lo > a.hi THEN a ELSE named_struct(
                'lo', shiftright(a.lo + {low}, 1),
                'hi', shiftright(a.hi - {high}, 1),
                'cells', concat(a.cells,
                    CASE WHEN {low} = 1 THEN array(named_struct('level', k, 'cell', a.lo)) ELSE CAST(array() AS {kind}) END,
                    CASE WHEN {high} = 1 THEN array(named_struct('level', k, 'cell', a.hi)) ELSE CAST(array() AS {kind}) END)) END,
            a -> a.cells)"""
    )


def _in_cells(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, bucket: float) -> DataFrame:
    """Points (rows with ``at``) beside the spans of their video one of whose cells they lie in."""
    celled = spans.select("*", F.explode(dyadic_cells(lo, hi, bucket)).alias("c")).select(*spans.columns, "c.level", "c.cell")
    # 64 levels at most; few videos have more than the lowest ones
    levels = celled.groupBy("video_id").agg(F.collect_set("level").alias("_levels"))
    place = F.floor(F.col(at) / F.lit(float(bucket))).cast("long")
    placed = points.join(levels, "video_id").select(*points.columns, F.explode("_levels").alias("level"), place.alias("cell"))
    placed = placed.withColumn("cell", F.expr("shiftright(cell, level)"))
    return placed.join(celled, ["video_id", "level", "cell"])


def joined_text(rows: DataFrame, when: Column | None = None) -> Column:
    """Aggregate: texts by (start, idx), joined by single spaces; no rows give ''."""
    item = F.struct("start", "idx", "text")
    kept = F.collect_list(item if when is None else F.when(when, item))
    return F.array_join(F.transform(F.array_sort(kept), lambda r: r["text"]), " ")


def surrounding_text(points: DataFrame, segments: DataFrame, before: float, after: float) -> DataFrame:
    """Points with the text around t; the larger of the two widths counts on both sides."""
    rows = window_rows(points, segments, max(before, after))
    # texts before t come first by start already
    texts = rows.groupBy("video_id", "t").agg(joined_text(rows).alias("surrounding_text"))
    return points.join(texts, ["video_id", "t"], "left").withColumn(
        "surrounding_text", F.coalesce("surrounding_text", F.lit(""))
    )
