"""Ordered folds whose next step depends on the last accepted row.

Each fold is a chain of jumps: from an accepted row the next accepted row is known.
A video of ordinary length is walked in one group. A longer one is cut into chunks:
every chunk tells, as a small step table, where a chain that enters it leaves it;
the tables are walked in order to give each chunk its entry; then all chunks are
walked at once. Results equal the plain fold.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avsync.operators import ordered
from avsync.operators.ordered import CHUNK, Cuts, find_cuts, row_limit
from avsync.session import settle

REDUNDANCY_SECONDS = 5.0
MIN_SCENE_GAP = 4.0
MAX_FRAME_GAP = 30.0
MIN_EDU_COMPLEXITY = 0.05
SAMPLE_THRESHOLD = 0.50
SAMPLE_MIN_GAP = 1
SAMPLE_MAX_GAP = 15
REDUNDANT_SIMILARITY = 0.92
TRIM_PARTS = 64


# --- chains over (time, optional cover start) -------------------------------


def _first_at_least(values: np.ndarray, base: np.ndarray, gap: float) -> np.ndarray:
    """First j with values[j] - base >= gap, by subtraction as the rule is stated."""
    j = np.searchsorted(values, base + gap, "left")
    n = len(values)
    while True:  # the sum may round differently from the difference
        back = (j > 0) & (values[np.maximum(j - 1, 0)] - base >= gap)
        if not back.any():
            break
        j = np.where(back, j - 1, j)
    while True:
        on = (j < n) & (values[np.minimum(j, n - 1)] - base < gap) if n else np.zeros(len(j), bool)
        if not on.any():
            return j
        j = np.where(on, j + 1, j)


def _next_items(t: np.ndarray, cover: np.ndarray, base: np.ndarray, gap: float, cover_gap: float) -> np.ndarray:
    """For each base time the first item it accepts; len(t) if none.

    An item needs t - base >= gap and, where ``cover`` is set, cover - base >= cover_gap.
    """
    end = len(t)
    found = np.full(len(base), end, dtype=np.int64)
    free = np.flatnonzero(np.isnan(cover))
    if len(free):
        j = _first_at_least(t[free], base, gap)
        found = np.where(j < len(free), free[np.minimum(j, len(free) - 1)], end)
    tied = np.flatnonzero(~np.isnan(cover))
    if len(tied):
        j = np.maximum(_first_at_least(t[tied], base, gap), _first_at_least(cover[tied], base, cover_gap))
        found = np.minimum(found, np.where(j < len(tied), tied[np.minimum(j, len(tied) - 1)], end))
    return found


def _walk(t, cover, last, gap, cover_gap):
    """Accepted item numbers, starting from the last accepted time (None: take the first)."""
    n = len(t)
    nxt = _next_items(t, cover, t, gap, cover_gap)
    if last is None:
        i = 0
    else:
        i = int(_next_items(t, cover, np.array([last]), gap, cover_gap)[0])
    taken = []
    while i < n:
        taken.append(i)
        i = int(nxt[i])
    return np.array(taken, dtype=np.int64)


def _steps(t, cover, gap, cover_gap):
    """Step table of a chunk: items a chain can enter at, and where it then ends."""
    n = len(t)
    nxt = _next_items(t, cover, t, gap, cover_gap)
    leaves = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            leaves[i] = leaves[nxt[i]]
    rows = []
    # any earlier time is below the first item's; stop at an item all of them accept
    floor = t[0] if np.isnan(cover[0]) else min(t[0], cover[0])
    for i in range(n):
        rows.append((float(t[i]), float(cover[i]), float(t[leaves[i]])))
        if t[i] - floor >= gap and (np.isnan(cover[i]) or cover[i] - floor >= cover_gap):
            break
    kept = []
    for r in rows:  # runs of free items with one exit: the last of the run decides
        if kept and np.isnan(r[1]) and np.isnan(kept[-1][1]) and kept[-1][2] == r[2]:
            kept[-1] = r
        else:
            kept.append(r)
    return kept


def accept_chain(
    items: DataFrame,
    gap: float,
    cover_gap: float = 0.0,
    start: float | None = None,
    max_rows: float | None = None,
) -> DataFrame:
    """Accepted rows of items (video_id, t[, cover], ...), t distinct per video.

    In time order an item is accepted if t - last >= gap and, where ``cover`` is not
    NULL, cover - last >= cover_gap. ``start`` is the first ``last``; None accepts
    the first item. The rows keep their other columns.
    """
    out = T.StructType([f for f in items.schema.fields if f.name != "cover"])
    names = out.names
    if "cover" not in items.columns:
        items = items.withColumn("cover", F.lit(None).cast("double"))
    cuts = find_cuts(items, ["video_id"], ["t"], max_rows, min_width=2 * max(gap, cover_gap)).looked()

    def numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table["t"].to_numpy(), table["cover"].to_numpy(zero_copy_only=False).astype(float)

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        last = start
        if "entry" in table.column_names:
            last = table["entry"][0].as_py()
            last = start if last is None else last
        return table.take(pa.array(_walk(*numbers(table), last, gap, cover_gap))).select(names)

    if not cuts.any:
        return items.groupBy("video_id").applyInArrow(walk, out)

    video = items.schema["video_id"].dataType.simpleString()
    chunked = settle(cuts.chunked(items), "chain")  # read for the step tables and for the walk

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, cover = numbers(table)
        kept = _steps(t, cover, gap, cover_gap)
        first = _walk(t, cover, start, gap, cover_gap)
        return pa.table(
            {
                "video_id": table["video_id"].slice(0, 1),
                CHUNK: table[CHUNK].slice(0, 1),
                "at": pa.array([[k[0] for k in kept]], pa.list_(pa.float64())),
                "cover": pa.array([[k[1] for k in kept]], pa.list_(pa.float64())),
                "exit": pa.array([[k[2] for k in kept]], pa.list_(pa.float64())),
                "first_exit": pa.array([float(t[first[-1]]) if len(first) else None], pa.float64()),
            }
        )

    step_schema = (
        f"video_id {video}, {CHUNK} int, at array<double>, cover array<double>, exit array<double>, first_exit double"
    )
    narrow = chunked.where("_long").select(*cuts.group, "t", "cover")
    tables = narrow.groupBy(*cuts.group).applyInArrow(steps, step_schema)

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        entries, last = [], start
        for row in table.to_pylist():
            entries.append(last)
            if last is None:
                last = row["first_exit"]
                continue
            for at, cover, leave in zip(row["at"], row["cover"], row["exit"], strict=True):
                if at - last >= gap and (math.isnan(cover) or cover - last >= cover_gap):
                    last = leave
                    break
        return pa.table(
            {"video_id": table["video_id"], CHUNK: table[CHUNK], "entry": pa.array(entries, pa.float64())}
        )

    # one small row per chunk of a long video
    entries = tables.groupBy("video_id").applyInArrow(follow, f"video_id {video}, {CHUNK} int, entry double")
    entered = chunked.join(entries, cuts.group, "left")
    return entered.drop("_long").groupBy(*cuts.group).applyInArrow(walk, out)


def suppress_close(
    rows: DataFrame, gap: float = REDUNDANCY_SECONDS, order: str = "ord", max_rows: float | None = None
) -> DataFrame:
    """Keep a row unless it is within ``gap`` seconds of the last kept row of its video.

    Rows with equal times are tried in ``order``: only the first of them can be kept,
    so one row per distinct time goes on.
    """
    rest = [c for c in rows.columns if c not in ("video_id", "t")]
    firsts = rows.groupBy("video_id", "t").agg(F.min_by(F.struct(*rest), F.struct(order)).alias("r"))
    # the fold sees times only; texts and paths stay on the JVM side
    kept = accept_chain(rows.select("video_id", "t").distinct(), gap, max_rows=max_rows)
    return firsts.join(kept, ["video_id", "t"], "left_semi").select("video_id", "t", "r.*")


# --- scenes -----------------------------------------------------------------


def scene_boundaries(
    flagged: DataFrame, min_gap: float = MIN_SCENE_GAP, order: str = "ord", max_rows: float | None = None
) -> DataFrame:
    """(video_id, t, order) of rows that begin a scene.

    ``flagged`` is (video_id, t, order, changed): the first row begins one, later
    rows do if ``changed`` and at least ``min_gap`` seconds after the last beginning.
    """
    max_rows = row_limit(flagged, max_rows=max_rows)
    firsts = flagged.groupBy("video_id").agg(F.min(F.struct("t", order)).alias("r")).select("video_id", "r.*")
    marks = flagged.where("changed").select("video_id", "t", order).unionByName(firsts)
    marks = marks.groupBy("video_id", "t").agg(F.min(order).alias(order))
    # at the first time of a video its first row wins over a flagged row of equal time
    return accept_chain(marks, min_gap, max_rows=max_rows)


def assign_scenes(
    frames: DataFrame, boundaries: DataFrame, order: str = "ord", cuts: Cuts | None = None, max_rows: float | None = None
) -> DataFrame:
    """Frames with scene_id, 0-based in time order."""
    marked = frames.join(
        boundaries.select("video_id", "t", order, F.lit(1).alias("_begins")), ["video_id", "t", order], "left"
    )
    cuts = cuts or find_cuts(frames, ["video_id"], ["t", order], max_rows)
    numbered = ordered.scan(marked, cuts, scene_id=ordered.running_sum(F.coalesce("_begins", F.lit(0))))
    return numbered.withColumn("scene_id", F.col("scene_id") - 1).drop("_begins")


def scene_ranges(frames: DataFrame) -> DataFrame:
    """(video_id, scene_id, start_time, end_time, n_frames) of frames with scene_id."""
    return frames.groupBy("video_id", "scene_id").agg(
        F.min("t").alias("start_time"), F.max("t").alias("end_time"), F.count(F.lit(1)).alias("n_frames")
    )


def select_per_scene(
    frames: DataFrame,
    min_gap: float = MIN_SCENE_GAP,
    max_gap: float = MAX_FRAME_GAP,
    min_complexity: float = MIN_EDU_COMPLEXITY,
    order: str = "ord",
    max_rows: float | None = None,
) -> DataFrame:
    """Best frame per scene, spaced by ``min_gap``; non-educational ones only for coverage.

    ``frames`` has video_id, scene_id, t, order, complexity, is_educational and more.
    """
    max_rows = row_limit(frames, max_rows=max_rows)
    rest = F.struct(*[c for c in frames.columns if c not in ("video_id", "scene_id")])
    rank = F.struct("complexity", -F.col("t"), -F.col(order))
    useful = F.col("is_educational") & (F.col("complexity") > min_complexity)
    scenes = frames.groupBy("video_id", "scene_id").agg(
        F.min("t").alias("_start"),
        F.max_by(rest, F.when(useful, rank)).alias("_edu"),
        F.max_by(rest, rank).alias("_any"),
    )
    best = scenes.select(
        "video_id",
        "scene_id",
        F.coalesce("_edu", "_any").alias("best"),
        F.when(F.col("_edu").isNull(), F.col("_start")).alias("cover"),
    ).withColumn("t", F.col("best.t"))
    kept = accept_chain(best, min_gap, max_gap, start=-min_gap, max_rows=max_rows)
    return kept.select("video_id", "scene_id", "best.*")


# --- fill and sample --------------------------------------------------------


def fill_to_minimum(
    chosen: DataFrame,
    candidates: DataFrame,
    spacing: float = MIN_SCENE_GAP / 2,
    order: str = "ord",
    max_rows: float | None = None,
) -> DataFrame:
    """(video_id, t, order) added so that each video has ``target_min`` rows.

    ``chosen`` is (video_id, t, order, target_min), one row at least per video that
    wants filling (t NULL if none is chosen yet); ``candidates`` is (video_id, t, order,
    complexity) without the chosen rows. Candidates are tried from the most complex
    on and taken when no taken row is closer than ``spacing``.
    """
    cand = candidates.withColumn("_down", -F.col("complexity")).select("video_id", "t", order, "_down")
    chosen = chosen.select("video_id", "t", order, "target_min")
    spots = cand.select("video_id", "t").unionByName(chosen.where("t IS NOT NULL").select("video_id", "t"))
    cuts = find_cuts(spots, ["video_id"], ["t"], max_rows, min_width=4 * spacing).looked()
    if not cuts.any:
        return _fill(chosen, cand, spacing, order)
    # who is taken depends on near rows only; the number wanted just ends the list early
    need = chosen.groupBy("video_id").agg((F.max("target_min") - F.count("t")).alias("_need"))
    taken = _take_apart(chosen.where("t IS NOT NULL"), cand, spacing, order, cuts)
    ranks = find_cuts(taken, ["video_id"], ["_down", "t", order], max_rows).looked()
    ranked = ordered.scan(taken, ranks, _rank=ordered.row_number()).join(need, "video_id")
    return ranked.where(F.col("_rank") <= F.col("_need")).select("video_id", "t", order)


def _take_apart(chosen: DataFrame, cand: DataFrame, spacing: float, order: str, cuts: Cuts) -> DataFrame:
    """All candidates that are taken, best first, chunk by chunk of time.

    A chunk also sees its neighbours' rows closer than ``spacing``. It decides a row as
    soon as all better rows near it are decided; rows that wait for another chunk go on
    to the next round. The best waiting row never waits again, so rounds end.
    """
    columns = ["video_id", "t", order, "_down"]
    video = cand.schema["video_id"].dataType.simpleString()
    ord_type = cand.schema[order].dataType.simpleString()
    schema = f"video_id {video}, t double, {order} {ord_type}, _down double, taken boolean"

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_down", "ascending"), ("t", "ascending"), (order, "ascending")])
        known = table["taken"].to_numpy(zero_copy_only=False).astype(bool)
        t = table["t"].to_numpy()
        own = table["_own"].to_numpy(zero_copy_only=False).astype(bool)
        taken, waiting = sorted(t[known].tolist()), []
        kept, fate = [], []
        for i in np.flatnonzero(~known):
            if _is_near(taken, t[i], spacing):
                continue
            waits = not own[i] or _is_near(waiting, t[i], spacing)
            bisect.insort(waiting if waits else taken, float(t[i]))
            if own[i]:
                kept.append(i)
                fate.append(not waits)
        out = table.take(pa.array(kept, pa.int64())).select(columns)
        return out.append_column("taken", pa.array(fate, pa.bool_()))

    def at(rows: DataFrame, shift: float, name: str) -> DataFrame:
        moved = rows.withColumn("_t", F.col("t")).withColumn("t", F.col("t") + F.lit(shift))
        placed = cuts.chunked(moved).withColumnRenamed(CHUNK, name)
        return placed.drop("t", "_long").withColumnRenamed("_t", "t")

    waiting = cand.select(*columns).withColumn("taken", F.lit(False))
    known = chosen.select("video_id", "t", order, F.lit(0.0).alias("_down"), F.lit(True).alias("taken"))
    added = None
    while True:
        rows = at(at(at(waiting.unionByName(known), -spacing, "_a"), spacing, "_b"), 0.0, "_home")
        rows = rows.withColumn(CHUNK, F.explode(F.array_distinct(F.array("_a", "_home", "_b"))))
        rows = rows.withColumn("_own", F.col(CHUNK) == F.col("_home"))
        rows = rows.select(*cuts.group, "t", order, "_down", "taken", "_own")
        done = settle(rows.groupBy(*cuts.group).applyInArrow(decide, schema), "fill")
        new = done.where("taken")
        added = new if added is None else added.unionByName(new)
        known = known.unionByName(new)
        waiting = done.where("NOT taken")
        if waiting.isEmpty():
            return added.select(*columns)


def _is_near(times: list[float], t: float, spacing: float) -> bool:
    at = bisect.bisect_left(times, t)
    return any(abs(t - x) < spacing for x in times[max(at - 1, 0) : at + 1])


def _fill(chosen: DataFrame, cand: DataFrame, spacing: float, order: str) -> DataFrame:
    video = cand.schema["video_id"].dataType.simpleString()
    ord_type = cand.schema[order].dataType.simpleString()

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return right.select(["video_id", "t", order]).slice(0, 0)
        taken = sorted(x for x in left["t"].to_pylist() if x is not None)
        wanted = left["target_min"][0].as_py() - len(taken)
        right = right.sort_by([("_down", "ascending"), ("t", "ascending"), (order, "ascending")])
        picked = []
        for i, t in enumerate(right["t"].to_numpy()):
            if len(picked) >= wanted:
                break
            if not _is_near(taken, t, spacing):
                bisect.insort(taken, float(t))
                picked.append(i)
        return right.take(pa.array(picked, pa.int64())).select(["video_id", "t", order])

    chosen = chosen.select(*[F.col(c).alias(c) for c in chosen.columns])
    cand = cand.select("video_id", "t", order, "_down")
    cand = cand.select(*[F.col(c).alias(c) for c in cand.columns])
    return (
        chosen.groupBy("video_id")
        .cogroup(cand.groupBy("video_id"))
        .applyInArrow(take, f"video_id {video}, t double, {order} {ord_type}")
    )


def trim_to_maximum(
    rows: DataFrame, limit: Column, score: str = "complexity", order: str = "ord", max_rows: float | None = None
) -> DataFrame:
    """The ``limit`` best rows of each video; equal scores go by time."""
    # the best of each part of a video hold the best of the video: no key is ranked whole
    by = [F.col(score).desc(), "t", order]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("t", order), F.lit(TRIM_PARTS)))
    best = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("video_id", "_part").orderBy(*by))).where(F.col("_rank") <= limit)
    ranked = best.withColumn("_rank", F.row_number().over(Window.partitionBy("video_id").orderBy(*by)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank", "_part")


def change_point_sample(
    frames: DataFrame,
    threshold: float = SAMPLE_THRESHOLD,
    min_gap: int = SAMPLE_MIN_GAP,
    max_gap: int = SAMPLE_MAX_GAP,
    max_rows: float | None = None,
) -> DataFrame:
    """Kept (video_id, idx) of frames (video_id, idx, embedding).

    The first row is kept; then a row at least ``max_gap`` on from the last kept row,
    or at least ``min_gap`` on and less similar to it than ``threshold``.
    """
    max_rows = max_rows or ordered.MAX_ROWS
    frames = frames.select("video_id", "idx", "embedding")
    video = frames.schema["video_id"].dataType.simpleString()
    idx_type = frames.schema["idx"].dataType.simpleString()
    keys = frames.select("video_id", "idx")
    cuts = find_cuts(keys, ["video_id"], ["idx"], max_rows).looked()

    def jumps(table: pa.Table, n: int) -> np.ndarray:
        """For the first n rows, how many rows on the next kept row is."""
        idx = table["idx"].to_numpy()
        total = len(idx)
        flat = table["embedding"].combine_chunks().flatten()
        vec = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(total, -1)
        out = np.zeros(n, dtype=np.int64)
        rows = np.arange(n)
        for step in range(1, max_gap + 1):
            open_ = rows[(out == 0) & (rows + step < total)]
            gap = idx[open_ + step] - idx[open_]
            alike = np.einsum("ij,ij->i", vec[open_ + step], vec[open_])
            hit = (gap >= max_gap) | ((gap >= min_gap) & (alike < threshold))
            out[open_[hit]] = step
        return np.where(out == 0, total - rows, out)  # past the end

    def follow_jumps(jump: np.ndarray, i: int) -> list[int]:
        kept = []
        while i < len(jump):
            kept.append(i)
            i += int(jump[i])
        return kept

    schema = f"video_id {video}, idx {idx_type}"
    if not cuts.any:

        def whole(table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            kept = follow_jumps(jumps(table, table.num_rows), 0)
            return table.take(pa.array(kept, pa.int64())).select(["video_id", "idx"])

        return frames.groupBy("video_id").applyInArrow(whole, schema)

    # chunks of a fixed row count, each with a copy of the max_gap rows that follow it
    size = max(max_rows // 2, max_gap)
    placed = ordered.scan(frames, cuts, _pos=ordered.row_number()).withColumn("_pos", F.col("_pos") - 1)
    home = F.floor(F.col("_pos") / F.lit(size))
    placed = placed.withColumn(
        CHUNK,
        F.explode(
            F.when((F.col("_pos") % size < max_gap) & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))
        ),
    ).withColumn("_own", F.col(CHUNK) == home)
    group = ["video_id", CHUNK]

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = int(pa.compute.sum(table["_own"]).as_py())
        jump = jumps(table, n)
        leaves = np.zeros(n, dtype=np.int64)  # offset at which a chain enters the next chunk
        for i in range(n - 1, -1, -1):
            j = i + jump[i]
            leaves[i] = leaves[j] if j < n else j - n
        return pa.table(
            {
                "video_id": table["video_id"].slice(0, 1),
                CHUNK: table[CHUNK].slice(0, 1),
                "exit": pa.array([leaves[:max_gap].tolist()], pa.list_(pa.int64())),
            }
        )

    tables = placed.groupBy(*group).applyInArrow(steps, f"video_id {video}, {CHUNK} long, exit array<long>")

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        entries, at = [], 0
        for row in table.to_pylist():
            entries.append(at)
            at = row["exit"][at] if at < len(row["exit"]) else 0
        return pa.table({"video_id": table["video_id"], CHUNK: table[CHUNK], "entry": pa.array(entries, pa.int64())})

    # one row of max_gap numbers per chunk
    entries = tables.groupBy("video_id").applyInArrow(follow, f"video_id {video}, {CHUNK} long, entry long")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = int(pa.compute.sum(table["_own"]).as_py())
        kept = follow_jumps(jumps(table, n), table["entry"][0].as_py())
        return table.take(pa.array(kept, pa.int64())).select(["video_id", "idx"])

    return placed.join(entries, group).groupBy(*group).applyInArrow(walk, schema)


def redundancy_flag(
    rows: DataFrame, threshold: float = REDUNDANT_SIMILARITY, order: str = "ord", max_rows: float | None = None
) -> DataFrame:
    """Rows with their similarity to the previous row; the flag drops nothing."""
    from avsync.operators.vectors import dot

    cuts = find_cuts(rows, ["video_id"], ["t", order], max_rows)
    seen = ordered.scan(rows, cuts, _prev=ordered.lag(F.col("embedding")))
    return (
        seen.withColumn("similarity_to_last", F.coalesce(dot("embedding", "_prev"), F.lit(0.0)))
        .withColumn("is_redundant", F.col("similarity_to_last") > threshold)
        .drop("_prev")
    )
