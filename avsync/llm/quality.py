"""Operator 6: ordinal cumulative-link regression on graded ratings, over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avsync.llm.common import free_name, give_back, word_slices, worker_cache

BITS = 20
_PIECES = regex.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+")
#: shares are told in steps, so that they are features like words
_STEPS = np.array([0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


class Features:
    """The set of hashed features of a text: words, word beginnings, runs of signs, and shares.

    Words are taken between ASCII white space; a word's letters, its first four bytes and
    its signs are features. The shares (of different words, of words with capitals only, of
    words without letters, of the commonest word, of words with signs) are in steps.
    """

    ROOM = 1 << 17

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.of_word: dict[bytes, tuple[int, ...]] = {}

    def _hash(self, name: bytes) -> int:
        return xxhash.xxh3_64_intdigest(name) & self.mask

    def _word(self, word: bytes) -> tuple[int, ...]:
        out = []
        for piece in _PIECES.findall(word.lower()):
            if piece[0] >= 128 or chr(piece[0]).isalnum():
                out += [self._hash(b"w" + piece), self._hash(b"p" + piece[:4])]
            elif len(piece) > 1 or piece not in b".,":
                out.append(self._hash(b"s" + piece[:8]))
        if len(self.of_word) > self.ROOM:
            self.of_word.clear()
        self.of_word[word] = found = tuple(out)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        counts: dict[bytes, int] = {}
        for words in word_slices((text or "").encode("utf-8")):
            for word in words:
                counts[word] = counts.get(word, 0) + 1
        found: set[int] = {self._hash(b"bias")}
        get = self.of_word.get
        for word in counts:
            at = get(word)
            found.update(at if at is not None else self._word(word))
        n = sum(counts.values())
        if not n:
            found.add(self._hash(b"empty"))
            return np.fromiter(found, np.int64, len(found))
        capitals = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
        bare = sum(c for w, c in counts.items() if not any(b >= 128 or chr(b).isalnum() for b in w))
        signs = sum(c for w, c in counts.items() if w[-1] < 128 and not chr(w[-1]).isalnum())
        common = max(counts.values())
        shares = {"different": len(counts) / n, "capitals": capitals / n, "bare": bare / n, "signs": signs / n}
        if n >= 20:
            shares["common"] = common / n
        if n >= 200:
            shares["long_different"] = len(counts) / n
        for name, share in shares.items():
            found.add(self._hash(f"={name}{np.searchsorted(_STEPS, share)}".encode()))
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Ordinal:
    """P(grade <= k) = logistic(threshold[k] - weights . features); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one line per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit_ordinal(
    features: list[np.ndarray], grades: np.ndarray, bits: int = BITS, l1: float = 8.0, rate: float = 0.5, epochs: int = 12, block: int = 64, least: int = 4
) -> Ordinal:
    """Maximum likelihood with a lasso penalty, by follow-the-regularised-leader steps on blocks of rows.

    Grades are 0, 1, ..., up to the largest; a grade nobody gave has no width of its own.
    Features of fewer than ``least`` rows have weight 0. One grade only: its probability is
    that of the smoothed counts, whatever the text. Thresholds are kept as the first one and
    the logarithms of the gaps, so they stay in order. Rows are taken in a fixed shuffled
    order; the same input gives the same model.
    """
    n, top = len(grades), int(grades.max(initial=0))
    size = 1 << bits
    if n == 0 or top == 0:
        return Ordinal(np.zeros(size), np.array([np.log(0.5 / (n + 0.5))]), bits)
    often = np.zeros(size, np.int64)
    for f in features:
        often[f] += 1
    features = [f[often[f] >= least] for f in features]
    share = np.cumsum(np.bincount(grades, minlength=top + 1) + 0.5)[:-1] / (n + 0.5 * (top + 1))
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([[cuts[0]], np.log(np.maximum(1e-2, np.diff(cuts)))])
    seen_theta = np.full(top, 1.0)
    w, z, seen = np.zeros(size), np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(11)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(epochs):
        rows = rng.permutation(n)
        for lo in range(0, n, block):
            own = rows[lo : lo + block]
            flat = np.concatenate([features[i] for i in own])
            line = np.repeat(np.arange(len(own)), [len(features[i]) for i in own])
            grade = grades[own]
            score = np.bincount(line, w[flat], len(own))
            gaps = np.exp(np.clip(theta[1:], -20, 5))
            edge = np.concatenate([[-np.inf], np.cumsum(np.concatenate([[theta[0]], gaps])), [np.inf]])
            upper, lower = logistic(edge[grade + 1] - score), logistic(edge[grade] - score)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
            by_edge = np.bincount(grade, low, top + 1)[1:] - np.bincount(grade, up, top + 1)[:top]
            g_theta = np.array([by_edge.sum(), *(by_edge[k:].sum() * gaps[k - 1] for k in range(1, top))])
            seen_theta += g_theta**2
            theta = theta - rate * g_theta / np.sqrt(seen_theta)
            names, at = np.unique(flat, return_inverse=True)
            g = np.bincount(at, (up - low)[line], len(names))
            more = seen[names] + g * g
            z[names] += g - (np.sqrt(more) - np.sqrt(seen[names])) / rate * w[names]
            seen[names] = more
            zn = z[names]
            w[names] = np.where(np.abs(zn) <= l1, 0.0, -(zn - np.sign(zn) * l1) / ((1 + np.sqrt(more)) / rate))
    return Ordinal(w, np.cumsum(np.concatenate([[theta[0]], np.exp(np.clip(theta[1:], -20, 5))])), bits)


def fit(
    df: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", most_rows: int = 20_000, **options
) -> Ordinal:
    """Fit on at most ``most_rows`` rated documents, those of lowest hash; so many feature lists come to the driver.

    Rows without a grade are left out; of several grades of a document the lowest counts.
    Ratings of documents that are not there are ignored. A document that stands twice is
    used twice. No rated row at all: everything passes with the prior of one half.
    """
    rated = ratings.filter(F.col(grade).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(F.col(grade).cast("int")).alias("__grade"))
    here = df.select(F.col(doc_id).alias("__id")).join(rated, "__id")
    chosen = here.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    bits = options.get("bits", BITS)

    def describe(batches: Iterator[pa.RecordBatch]):
        features = worker_cache((Features, bits), lambda: Features(bits))
        for batch in batches:
            found = [np.sort(features(t)).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(found, pa.binary()), batch.column(2)], ["id", "features", "grade"])

    got = rows.select("__id", "__text", "__grade").mapInArrow(describe, "id string, features binary, grade int").toArrow()
    # views of the Arrow buffers: the driver holds the lists once
    lists = [np.frombuffer(x.as_buffer(), "<i4") for x in got.column("features")]
    grades = np.array(got.column("grade").to_pylist(), np.int64)
    ids = got.column("id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], grades[i], len(lists[i])))
    lists = [lists[i] for i in order]
    del got
    model = fit_ordinal(lists, grades[order] if len(ids) else grades, **options)
    del lists
    give_back()  # the driver's memory is needed by what follows
    return model


def _with_tails(df: DataFrame, model: Ordinal, text: str) -> DataFrame:
    """All columns and two more at the end: the score, and P(grade > k) for each k."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    out = T.StructType(
        [*df.schema.fields, T.StructField(free_name(df, "_score"), T.DoubleType()), T.StructField(free_name(df, "_tails"), T.ArrayType(T.DoubleType()))]
    )
    names = out.names

    def score(batches: Iterator[pa.RecordBatch]):
        model = shipped.value
        features = worker_cache((Features, model.bits), lambda: Features(model.bits))
        for batch in batches:
            scores = np.array([model.weights[np.sort(features(t))].sum() for t in batch.column(at).to_pylist()])
            tails = model.tails(scores).tolist() if len(scores) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(tails, pa.list_(pa.float64()))], names)

    return df.mapInArrow(score, out)


def grade_documents(df: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Per document: doc_id, score, expected_grade, p_top (the chance of the highest grade), kept.

    A null text counts as empty; an empty one has the one feature that it is empty. Other
    columns are not read.
    """
    rows = _with_tails(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text")
    expected = F.aggregate("_tails", F.lit(0.0), lambda a, x: a + x)
    top = F.element_at("_tails", -1)
    return rows.select("doc_id", F.col("_score").alias("score"), expected.alias("expected_grade"), top.alias("p_top"), (top >= least).alias("kept"))


def keep_good(df: DataFrame, model: Ordinal, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose chance of the highest grade is ``least`` or more, with their columns as they were."""
    rows = _with_tails(df, model, text)
    return rows.filter(F.element_at(rows[rows.columns[-1]], -1) >= least).select(*df.columns)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the given labels: 0 toxic, 1 of low quality, 2 neither."""
    return labels.select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade")
    )
