"""Folds against plain loops, with and without cut videos."""

import random

import numpy as np
import pytest

from avsync.operators import folds


def keep_far(times, gap):
    kept = []
    for t in times:
        if not kept or not abs(t - kept[-1]) < gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("max_rows", [None, 30])
def test_suppress_close(spark, max_rows):
    rng = random.Random(2)
    data = {"v": [0.0, 3.0, 5.0, 6.0, 9.9, 10.0, 30.0]}
    data["w"] = [round(rng.uniform(0, 300), 1) for _ in range(300)]
    data["grid"] = [i / 10 for i in range(900)]
    rows = [(v, t, i) for v, ts in data.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "video_id string, t double, ord int")
    got = {}
    for r in folds.suppress_close(df, max_rows=max_rows).collect():
        got.setdefault(r.video_id, []).append((r.t, r.ord))
    for v, ts in data.items():
        first = {}
        for i, t in enumerate(ts):
            first.setdefault(t, i)
        assert sorted(got[v]) == [(t, first[t]) for t in keep_far(sorted(ts), 5.0)]
    assert [t for t, _ in sorted(got["v"])] == [0.0, 5.0, 10.0, 30.0]


def loop_scenes(scenes, min_gap=4.0, max_gap=30.0):
    last, kept = -min_gap, []
    for frames in scenes:
        good = [f for f in frames if f[2] and f[1] > 0.05]
        if not good and frames[0][0] - last >= max_gap:
            good = sorted(frames, key=lambda f: -f[1])[:1]
        if not good:
            continue
        best = max(good, key=lambda f: f[1])
        if best[0] - last < min_gap:
            continue
        kept.append(best[0])
        last = best[0]
    return kept


@pytest.mark.parametrize("max_rows", [None, 12])
def test_select_per_scene(spark, max_rows):
    rng = random.Random(4)
    rows, want = [], {}
    for v in ("a", "b"):
        t, scenes = 0.0, []
        for s in range(80):
            frames = []
            for _ in range(rng.randint(1, 4)):
                frames.append((t, round(rng.uniform(0, 0.6), 1), rng.random() < 0.3))
                t += rng.choice([1.0, 2.0])
            scenes.append(frames)
            rows += [(v, s, f[0], i, f[1], f[2]) for i, f in enumerate(frames)]
        want[v] = loop_scenes(scenes)
    df = spark.createDataFrame(
        rows, "video_id string, scene_id int, t double, ord int, complexity double, is_educational boolean"
    )
    got = {}
    for r in folds.select_per_scene(df, max_rows=max_rows).collect():
        got.setdefault(r.video_id, []).append(r.t)
    assert {v: sorted(ts) for v, ts in got.items()} == want


@pytest.mark.parametrize("max_rows", [None, 40])
def test_change_point_sample(spark, max_rows):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for v, n in (("a", 200), ("b", 7)):
        vec = rng.normal(size=(n, 4)) + 1.0
        vec /= np.linalg.norm(vec, axis=1, keepdims=True)
        idx = np.cumsum(rng.integers(1, 4, size=n))
        kept = []
        for i in range(n):
            gap = idx[i] - idx[kept[-1]] if kept else 0
            if not kept or gap >= 15 or (gap >= 2 and vec[i] @ vec[kept[-1]] < 0.1):
                kept.append(i)
        want[v] = [int(idx[i]) for i in kept]
        rows += [(v, int(idx[i]), [float(x) for x in vec[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id string, idx int, embedding array<double>")
    got = {}
    for r in folds.change_point_sample(df, 0.1, 2, 15, max_rows=max_rows).collect():
        got.setdefault(r.video_id, []).append(r.idx)
    assert {v: sorted(x) for v, x in got.items()} == want


@pytest.mark.parametrize("max_rows", [None, 15])
def test_fill_to_minimum(spark, max_rows):
    rng = random.Random(6)
    chosen_rows, cand_rows, want = [], [], {}
    for v in ("a", "b"):
        target = 12
        chosen = sorted(rng.sample(range(0, 120, 6), 3))
        cand = [(round(rng.uniform(0, 120), 1), i, round(rng.random(), 1)) for i in range(60)]
        chosen_rows += [(v, float(t), -i, target) for i, t in enumerate(chosen)]
        cand_rows += [(v, *c) for c in cand]
        taken, added = [float(t) for t in chosen], []
        for t, i, _ in sorted(cand, key=lambda c: (-c[2], c[0], c[1])):
            if len(taken) >= target:
                break
            if not any(abs(t - x) < 2.0 for x in taken):
                taken.append(t)
                added.append((t, i))
        want[v] = sorted(added)
    c = spark.createDataFrame(chosen_rows, "video_id string, t double, ord int, target_min int")
    k = spark.createDataFrame(cand_rows, "video_id string, t double, ord int, complexity double")
    got = {}
    for r in folds.fill_to_minimum(c, k, max_rows=max_rows).collect():
        got.setdefault(r.video_id, []).append((r.t, r.ord))
    assert {v: sorted(x) for v, x in got.items()} == want


@pytest.mark.parametrize("max_rows", [None, 40])
def test_scene_boundaries_and_ranges(spark, max_rows):
    rng = random.Random(8)
    rows, want = [], []
    for v in ("a", "b"):
        last, t, scenes = None, 0.0, []
        for i in range(150):
            changed = rng.random() < 0.5
            if last is None or (changed and t - last >= 4.0):
                scenes.append([t, t])
                last = t
            scenes[-1][1] = t
            rows.append((v, t, i, changed))
            t += rng.choice([0.0, 1.0, 2.0])
        want += [(v, n, s[0], s[1]) for n, s in enumerate(scenes)]
    df = spark.createDataFrame(rows, "video_id string, t double, ord int, changed boolean")
    b = folds.scene_boundaries(df, max_rows=max_rows)
    got = folds.scene_ranges(folds.assign_scenes(df, b, max_rows=max_rows)).collect()
    assert sorted((r.video_id, r.scene_id, r.start_time, r.end_time) for r in got) == want
