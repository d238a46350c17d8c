import random

import pytest
from pyspark.sql import types as T

ODD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("n", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("_found", T.StringType()),
        T.StructField("_tails", T.StringType()),
        T.StructField("token", T.StringType()),
    ]
)


def prose(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts():
    """Empty, null, short, very long, repeated, near-equal and mixed-case texts, by doc_id."""
    rng = random.Random(4)
    base = prose(rng, 120).split()
    texts = [None, "", " \t\n", "one", "One two THREE four", " ".join(base), " ".join(base).upper(), " ".join(base)]
    for k in range(6):  # near copies: one word changed
        words = list(base)
        words[10 + 15 * k] = "zz"
        texts.append(" ".join(words))
    texts += [" ".join(base[:60] + prose(rng, 60).split()) for _ in range(4)]  # a common passage
    texts += [prose(rng, 9000), "same " * 3000, "Ünï çödé ßtraße 日本   x y", "tail  ", None, "one"]
    texts += [prose(rng, rng.randint(5, 40)) for _ in range(12)]
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    return [(i, t, "en", (None, "b", "a", "c")[i % 4], len(t or ""), "x", None, "y", None, "z") for i, t in enumerate(odd_texts())]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
