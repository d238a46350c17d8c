"""The rule chain against the rules applied one by one in Python."""

import random
import re
from itertools import groupby

from pyspark.sql import functions as F

from avsync.functions import math_speech


def by_hand(text):
    if not text.strip():
        return text
    for find, put, is_pattern in math_speech.rules():
        text = re.sub(find, put, text) if is_pattern else text.replace(find, put)
    return re.sub(r"\s+", " ", text).strip()


def test_rules_on_random_notation(spark):
    rng = random.Random(9)
    bits = ["x", "y_2", "x^2", "^n", "∫", "dx", " ", "f(x)", "g(t)", "a/b", "3/4", "dy/dx", "d^2y/dx^2", "e", "sin ",
            "θ", " Δ ", "²", "+", "-", "=", "*", "→", "the ", "\n", "ℝ", " ln ", "(", ")", "_", "^-1", "∑∑", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["", "  ", "plain  words"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", math_speech.linearize_math(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(texts))] == [by_hand(x) for x in texts]


def test_rules_of_one_mark_are_tried_together(spark):
    """Each rule had a test of its own, and each of a text's spaces was replaced by a space."""
    steps = list(math_speech._steps(False, True))
    groups = [list(g) for _, g in groupby(steps, lambda step: step[0])]
    assert max(len(g) for g in groups) >= 6 and len(groups) < 0.7 * len(steps)
    for mark, exact, _ in math_speech._steps(False, False):  # a group is left out by its mark
        assert mark in ("", "plus") or mark in exact
    assert re.findall(math_speech.LOOSE_SPACE.replace("(?U)", ""), "a b  c\td") == ["  ", "\t"]


def test_spaces_of_all_kinds_become_one(spark):
    texts = ["a  =\tb", " a = b ", "\u00a0a\n\n=\u2003b\t", "\t\u3000", "a = b c", "é  = \u00a0 x ", "  plain \t words\n"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", math_speech.linearize_math(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(texts))] == [by_hand(x) for x in texts]


def test_order_effects_and_null(spark):
    df = spark.createDataFrame([("dy/dx",), ("a-b",), (None,)], "x string")
    out = [r[0] for r in df.select(math_speech.linearize_math(F.col("x"))).collect()]
    assert out == ["dy divided by dx", "aminusb", ""]
    spaced = [r[0] for r in df.select(math_speech.linearize_math(F.col("x"), spaced=True)).collect()]
    assert spaced[1] == "a minus b"
