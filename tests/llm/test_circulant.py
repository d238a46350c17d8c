"""Circulant MinHash near duplicates against plain sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from avsync.llm import circulant_minhash as cm


def pair_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set()


def plain(sets):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_near_duplicates(odd, odd_rows, none):
    sets = {r[0]: pair_set(r[1]) for r in odd_rows}
    want = plain(sets)
    got = {r["doc_id"]: tuple(r[1:]) for r in cm.near_duplicates(odd).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert {r["doc_id"] for r in cm.one_of_each(odd).collect()} == {i for i in sets if want[i] == i}
    assert cm.one_of_each(odd).columns == odd.columns
    assert cm.near_duplicates(none).count() == 0 and cm.one_of_each(none).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_borders_and_chains(spark, rounds):
    """Chains of texts just above and below the threshold, one id with two texts, null and repeated ids."""
    rng = random.Random(6)
    texts, words = {}, [f"w{k}" for k in range(80)]
    for k in range(40):
        texts[k] = " ".join(words)
        words = list(words)
        for _ in range(rng.randint(2, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    sets = {i: pair_set(t) for i, t in texts.items()}
    want = plain(sets)
    assert 1 < len(set(want.values())) < len(texts)
    rows = [*texts.items(), (3, texts[3]), (None, texts[4]), (None, None), (900, "one two three four five six"), (900, texts[39])]
    rows += [(950, "one two three four five six"), (951, "solo"), (952, "SOLO"), (953, "a b c d e f g h i j k"), (954, "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "n": F.lit(1), "label": F.lit(2), "signature": F.lit(3)}).repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in cm.near_duplicates(df, rounds=rounds, block=4, facing=8).collect()}
    assert {g for g in got if g[0] is not None and g[0] < 900} == {(i, len(s), want[i]) for i, s in sets.items()}
    assert {g for g in got if g[0] is None} == {(None, len(sets[4]), want[4]), (None, 0, None)}
    assert {(900, 5, 900), (900, len(sets[39]), want[39]), (950, 5, 900), (951, 1, 951), (952, 1, 951), (954, 11, 953)} <= got


def test_without_links(spark):
    df = spark.createDataFrame([(1, "all alone here"), (2, "nothing like that"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in cm.near_duplicates(df).collect()) == [(1, 2, 1, True), (2, 2, 2, True), (3, 0, 3, True)]


def test_signature_estimates_similarity():
    """Equal sets have equal signatures, and the share of equal coordinates is near the similarity."""
    rng = np.random.default_rng(5)
    for size in (5, 40, 3000, 70000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64))
        a, b = pool[:size], pool[size // 9 : size + size // 9]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one, two, three, empty = cm.signatures([a, b, a.copy(), a[:0]])
        assert (one == three).all() and not empty.any()
        assert abs((one == two).mean() - true) < 0.13
        assert (cm.signatures([b])[0] == two).all()


def test_coordinates_are_shifts():
    """Coordinate k of a set is coordinate 0 of the set whose places are shifted by k."""
    shingles = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(cm.SPREAD), -1, 1 << 64))
    whole = cm.signatures([np.sort(shingles)], 9)[0]
    places = (shingles * cm.SPREAD) >> np.uint64(32)
    for k in range(9):
        moved = (((places + np.uint64(k)) & np.uint64(0xFFFFFFFF)) << np.uint64(32)) * inverse
        assert cm.signatures([moved], 1)[0][0] == whole[k]


def test_large_group_of_near_copies(spark):
    """A third of all rows near copies of one text, not all of them linked with one another."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(60)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(500)}" for _ in range(40))) for i in range(150)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)]
    want = plain({i: pair_set(t) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_pairs_below_threshold(spark, monkeypatch):
    """Texts that are alike in three quarters: their signatures mostly let them pass, their bitmaps do not."""
    base = " ".join(f"b{k}" for k in range(150))
    rows = [(i, " ".join([base, *(f"v{i}x{k}" for k in range(25))])) for i in range(100)]
    rows += [(900 + i, f"{rows[i][1]} y") for i in range(3)]
    given, whole = [], cm.verified
    monkeypatch.setattr(cm, "verified", lambda pairs, *rest: given.append(pairs.count()) or whole(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    assert got == plain({i: pair_set(t) for i, t in rows}) == {i: i % 900 for i, _ in rows}
    assert 3 <= sum(given) < 600
