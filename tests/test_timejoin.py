"""Interval and nearest joins against a plain loop, with and without cut keys."""

import random

import pytest
from pyspark.sql import functions as F

from avsync.operators import timejoin


def brute(t, segs, limit):
    for s in segs:
        if s[1] <= t <= s[2]:
            return s[0]
    if not segs:
        return None
    best = min(segs, key=lambda s: min(abs(s[1] - t), abs(s[2] - t)))
    d = min(abs(best[1] - t), abs(best[2] - t))
    return best[0] if limit is None or d <= limit else None


def make(seed, shuffled):
    rng = random.Random(seed)
    segs, points = {}, {}
    for v in ("a", "b", "c"):
        starts = [round(rng.uniform(0, 400), 1) for _ in range(40)]
        if not shuffled:
            starts.sort()
        segs[v] = [(i, s, s + round(rng.choice([0.0, 3.0, 8.5, 40.0, -2.0]), 1)) for i, s in enumerate(starts)]
        points[v] = sorted({round(rng.uniform(-60, 520), 1) for _ in range(90)} | {s[1] for s in segs[v][:5]})
    segs["d"], points["d"] = [], [1.0, 2.0]
    return segs, points


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("max_rows", [None, 25])
@pytest.mark.parametrize("limit", [30.0, None])
def test_match_equals_loop(spark, shuffled, max_rows, limit):
    segs, points = make(3, shuffled)
    seg_df = spark.createDataFrame(
        [(v, *s, f"{v}{s[0]}") for v, ss in segs.items() for s in ss],
        "video_id string, idx int, start double, end double, text string",
    )
    pt_df = spark.createDataFrame([(v, t) for v, ts in points.items() for t in ts], "video_id string, t double")
    got = {
        (r.video_id, r.t): (r.seg_idx, r.seg_text)
        for r in timejoin.match_segment(pt_df, seg_df, limit, max_rows).collect()
    }
    want = {}
    for v, ts in points.items():
        for t in ts:
            i = brute(t, segs[v], limit)
            want[v, t] = (i, None if i is None else f"{v}{i}")
    assert got == want


def test_distance_of_exactly_thirty_counts(spark):
    seg = spark.createDataFrame(
        [("v", 0, 0.0, 10.0, "x")], "video_id string, idx int, start double, end double, text string"
    )
    pts = spark.createDataFrame([("v", 40.0), ("v", 40.1)], "video_id string, t double")
    got = {r.t: r.seg_idx for r in timejoin.match_segment(pts, seg).collect()}
    assert got == {40.0: 0, 40.1: None}


@pytest.mark.parametrize("max_rows", [None, 10])
def test_nearest_row_equals_loop(spark, max_rows):
    rng = random.Random(5)
    others = [("v", round(rng.uniform(0, 300)), i, f"s{i}") for i in range(30)]
    points = sorted({round(rng.uniform(-50, 350), 1) for _ in range(60)})
    o = spark.createDataFrame(
        [(v, float(t), i, s) for v, t, i, s in others], "video_id string, t double, ord int, snapshot_id string"
    )
    p = spark.createDataFrame([("v", t) for t in points], "video_id string, t double")
    got = {r.t: r.snapshot_id for r in timejoin.nearest_snapshot(p, o, 9.0, max_rows=max_rows).collect()}
    for t in points:
        d, i, s = min((abs(float(x[1]) - t), x[2], x[3]) for x in others)
        assert got[t] == (s if d <= 9.0 else None)


def test_window_rows_equal_naive_join(spark):
    segs, points = make(7, False)
    seg_rows = [(v, *s, "x") for v, ss in segs.items() for s in ss]
    seg_df = spark.createDataFrame(seg_rows, "video_id string, idx int, start double, end double, text string")
    pt_df = spark.createDataFrame([(v, t) for v, ts in points.items() for t in ts], "video_id string, t double")
    for w in (5.0, 120.0):
        got = sorted((r.video_id, r.t, r.idx) for r in timejoin.window_rows(pt_df, seg_df, w).collect())
        want = sorted(
            (v, t, s[0])
            for v, ts in points.items()
            for t in ts
            for s in segs[v]
            if s[1] <= s[2] and s[1] <= t + w and s[2] >= t - w
        )
        assert got == want


def test_dyadic_cells_make_up_their_interval(spark):
    rng = random.Random(2)
    pairs = [(a, a + rng.choice([0, 1, 2, 7, 100, 4000])) for a in (rng.randint(-3000, 3000) for _ in range(60))]
    df = spark.createDataFrame([(a * 60.0 + 1, b * 60.0 + 59) for a, b in pairs], "lo double, hi double")
    for (a, b), row in zip(pairs, df.select(timejoin.dyadic_cells("lo", "hi", 60.0).alias("cells")).collect(), strict=True):
        held = [x for c in row["cells"] for x in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"])]
        assert sorted(held) == list(range(a, b + 1)) and len(row["cells"]) <= 2 * (b - a + 2).bit_length()
    long = spark.createDataFrame([(0.0, 6e7)], "lo double, hi double")
    assert len(long.select(timejoin.dyadic_cells("lo", "hi", 60.0).alias("cells")).collect()[0]["cells"]) < 60


def test_window_rows_equal_loops(spark):
    rng = random.Random(3)
    segments = [(v, i, s, s + rng.choice([-1.0, 0.0, 5.0, 61.0, 600.0, 1e6]), f"{v}{i}") for v in "ab" for i, s in enumerate(rng.uniform(-500, 5000) for _ in range(40))]
    points = [(v, round(rng.uniform(-600, 6000), 1)) for v in "abc" for _ in range(30)] + [("a", segments[0][2]), ("a", None)]
    width = lambda t: 0.0 if t % 3 < 1 else 45.0 if t % 3 < 2 else 700.0
    df = spark.createDataFrame([(v, t, None if t is None else width(t)) for v, t in points], "video_id string, t double, w double")
    seg = spark.createDataFrame(segments, "video_id string, idx int, start double, end double, text string")
    got = sorted((r.video_id, r.t, r.idx) for r in timejoin.window_rows(df, seg, F.col("w")).collect())
    want = sorted({(v, t, i) for v, t in points if t is not None for u, i, s, e, _ in segments if u == v and s <= e and s <= t + width(t) and e >= t - width(t)})
    assert got == want
