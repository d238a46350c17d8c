"""The hidden Markov model and the ordinal classifier; the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from avsync.llm import hmm_score, quality


def random_model(rng, states, symbols):
    start, step, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm_score.Markov(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def by_paths(model, text):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, s in zip(path, path[1:], text[1:], strict=False):
            p *= model.step[a, b] * model.emit[s, b]
        total += p
    return total


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    model = random_model(rng, 3, 5)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 7, 6, 1)]
    got = hmm_score.log_likelihood(model, texts)
    assert got == pytest.approx([math.log10(by_paths(model, t)) for t in texts])


def test_baum_welch_counts():
    """Expected counts by enumeration, and a likelihood that does not fall."""
    rng = np.random.default_rng(2)
    model = random_model(rng, 2, 4)
    texts = [rng.integers(0, 4, n) for n in (5, 3, 1)]
    start, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for t in texts:
        whole = by_paths(model, t)
        for path in itertools.product(range(2), repeat=len(t)):
            p = model.start[path[0]] * model.emit[t[0], path[0]]
            for a, b, s in zip(path, path[1:], t[1:], strict=False):
                p *= model.step[a, b] * model.emit[s, b]
            start[path[0]] += p / whole
            for a, b in itertools.pairwise(path):
                step[a, b] += p / whole
            for s, k in zip(t, path, strict=True):
                emit[s, k] += p / whole
    got = hmm_score.expected_counts(model, texts, [True] * 3)
    for a, b in zip(got, (start, step, emit), strict=False):
        assert a == pytest.approx(b)
    weights, last = np.ones(4), -math.inf
    for _ in range(10):
        a, b, c, likelihood = hmm_score.expected_counts(model, texts, [True] * 3)
        assert likelihood >= last - 1e-9
        last, model = likelihood, hmm_score.Markov(a / a.sum(), (b + 1e-12) / (b + 1e-12).sum(1, keepdims=True), c / c.sum(0))


def test_score_texts(spark, odd, odd_rows, none):
    words = {r[0]: [*(r[1] or "").encode().lower().split(), None] for r in odd_rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, known = sum(counts.values()), len(counts)
    for frequent in (hmm_score.FREQUENT, 8):  # few frequent words: the others come by the join
        old, hmm_score.FREQUENT = hmm_score.FREQUENT, frequent
        got = hmm_score.score_texts(odd, rounds=2).collect()
        hmm_score.FREQUENT = old
        assert len(got) == len(odd_rows)
        for r in got:
            ws = words[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), total)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + known + 1)) for w in ws))
            assert -math.inf < r["score"] < 0
    assert hmm_score.score_texts(none).count() == 0
    lone = spark.createDataFrame([(4, None), (None, "a b")], "doc_id long, text string")
    assert hmm_score.score_texts(lone, rounds=1).count() == 2


def test_a_chain_scores_held_out_texts_better(spark):
    """Two languages that share no words: the chain must learn which one it reads."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{min(int(rng.expovariate(0.1)), 60)}" for _ in range(60))) for i in range(300)]
    got = hmm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), states=2).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 3 * len(got)


def graded_texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(8, 60))]
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "knave"])
        if grade == 1:
            words = [w + "!!" for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def test_quality_on_held_out_texts(spark, odd, none):
    rows = graded_texts(900, 1)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, _score string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows[:600]] + [(3, None), (10_000, 1)], "doc_id long, grade int")
    model = quality.fit(df, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.grade_documents(df, model).collect()}
    right = sum(got[i]["kept"] == (g == 2) for i, _, g in rows[600:])
    assert right >= 0.97 * 300
    assert all(0 <= r["expected_grade"] <= 2 and r["kept"] == (r["p_top"] >= 0.5) for r in got.values())
    assert {r["doc_id"] for r in quality.keep_good(df, model).collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.keep_good(odd, model).schema == odd.schema
    assert quality.grade_documents(odd, model).count() == odd.count() and quality.grade_documents(none, model).count() == 0
    no_ratings = quality.fit(df, ratings.filter("false"))
    assert quality.keep_good(df, no_ratings).count() == len(rows)
    one_grade = quality.fit(df, ratings.filter("grade = 2"))
    assert quality.keep_good(df, one_grade).count() == len(rows)


def test_quality_gradient():
    """A model fitted without penalty has a gradient near zero: fitted tails match the shares seen."""
    rng = np.random.default_rng(0)
    features = [np.array([1, 2 + int(x)]) for x in rng.integers(0, 2, 4000)]
    p = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])
    grades = np.array([rng.choice(3, p=p[f[1] - 2]) for f in features])
    model = quality.fit_ordinal(features, grades, bits=4, l1=0.0, epochs=40)
    tails = model.tails(np.array([model.weights[[1, 2]].sum(), model.weights[[1, 3]].sum()]))
    for k in range(2):
        mine = grades[[f[1] == 2 + k for f in features]]
        assert tails[k] == pytest.approx([(mine > 0).mean(), (mine > 1).mean()], abs=0.05)


def test_pipeline(spark, tmp_path):
    rows = graded_texts(240, 7)
    rng = random.Random(3)
    passage = " ".join(f"exam{k}" for k in range(15))
    texts = [t + " " + passage if i % 20 == 5 else t for i, t, _ in rows]
    texts[50] = texts[51] = " ".join(f"word{rng.randrange(99)}" for _ in range(60))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(g != 1), int(g == 0)) for i, _, g in rows[:200]]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert now.columns == columns
        seen.append(now.collect())
    good = {i for i, _, g in rows if g == 2}
    kept = {r["doc_id"] for r in seen[0]}
    assert len(kept & good) >= 0.97 * len(good) and len(kept & {i for i, _, g in rows if g != 2}) <= 5
    assert not ({50, 51} <= {r["doc_id"] for r in seen[1]}) and len(seen[1]) >= len(seen[0]) - 3
    assert not any("exam3" in (r["text"] or "") for r in seen[2]) and len(seen[2]) == len(seen[1])
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in seen[2])
    assert {r["doc_id"] for r in seen[3]} <= {r["doc_id"] for r in seen[2]}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in seen[3])


def test_counts_in_used_room():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 50, hmm_score.SYMBOLS + 1).astype(float)
    model = hmm_score.first_guess(weights, 3)
    pieces = [rng.integers(0, 40, n) for n in (1, 7, 30, 2, 2)]
    room = np.full((2, 60, 3), np.nan)
    want = hmm_score.expected_counts(model, pieces, [True] * 4 + [False])
    for _ in range(2):
        got = hmm_score.expected_counts(model, pieces, [True] * 4 + [False], room)
        assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    assert np.isclose(got[2].sum(), sum(map(len, pieces))) and np.isclose(got[3], hmm_score.log_likelihood(model, pieces).sum())


def test_edges_of_texts_are_no_words(spark):
    texts = [" b  a ", "a b", "\x0ba\x0cb\x1f", None, " ", " ".join(["a", "b"] * 700_000) + " "]
    got = hmm_score.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rounds=0).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len((t or "").encode().split()) + 1 for i, t in enumerate(texts)}
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["base_score"] == by_id[4]["base_score"] and by_id[0]["n_known"] == by_id[1]["n_known"]
