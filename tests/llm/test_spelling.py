"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from avsync.llm import spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    some = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, found in some.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(some[w]), n[form[w]] if form[w] else None)
    return out


def odd_words():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 7))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at, c = rng.randrange(len(w)), rng.choice("abcdéÿÉ×")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "日", "ā", "9"]).join(words)))
    long = "".join(rng.choice("abc") for _ in range(4000))
    rows += [(7, f"{long} {long[:100]}x{long[100:]} {long}")] * 4
    rows += [(None, "hello hello hello hellos hellos hellos hello hello hello")] * 2
    rows += [(200, None), (201, ""), (202, " \n"), (203, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa " * 9)]
    # a chain: each form twice as frequent as the word before
    rows += [(300 + k, " ".join((["stone"] * 16 + ["stole"] * 8 + ["stale"] * 4 + ["scale"] * 2 + ["scalp"]) * 3)) for k in range(3)]
    return rows


SCHEMA = "doc_id long, text string"


def found(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df, **options).collect()}


def test_spelling_equals_loops(spark):
    rows = odd_words()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit(1), "n": F.lit("x"), "length": F.lit(2)}).repartition(3)
    want = plain(rows)
    assert found(df) == want
    assert any(v[0] and v[0] != v[1] for v in want.values())
    assert found(df, sent_bytes=64) == want  # many passes


def test_segments(spark):
    """Filters in segments of four blocks affirm every edit that leads to a word."""
    words = spelling.vocabulary(spark.createDataFrame(odd_words(), SCHEMA))
    whole = {tuple(r) for r in spelling.near_pairs(words).collect()}
    assert whole and whole == {tuple(r) for r in spelling.near_pairs(words, sent_bytes=256, span=4).collect()}


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "once upon some times")]):
        df = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == []
        assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_hashes_follow_edits():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcxyz\xe9") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    total = {w: int(spelling.terms(np.frombuffer(w, np.uint8)[None, :]).sum(dtype=np.uint64)) for w in words}
    for w in words:
        letters = np.frombuffer(w, np.uint8)[None, :]
        added = spelling.terms(letters)[0]
        for p in range(len(w)):
            head = int(added[:p].sum(dtype=np.uint64))
            after = (head + (total[w] - int(added[: p + 1].sum(dtype=np.uint64))) * int(spelling.BACK)) % (1 << 64)
            cut = np.frombuffer(w[:p] + w[p + 1 :], np.uint8)[None, :]
            assert after == int(spelling.terms(cut).sum(dtype=np.uint64))
