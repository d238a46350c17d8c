"""Operator 1: a hidden Markov language model, trained over partitions, exact in its likelihood.

A text is a sequence of tokens: its words, then one end. The chain emits *symbols*: the end,
or one of ``SYMBOLS`` buckets of words by hash; a bucket then gives the word, by the counts of
words in that bucket and one share for words never seen. So the model knows every word of the
training texts (a table that grows with them), while what the chain itself carries has a
fixed size. The probability of a text is the sum over all state sequences; texts have total
probability at most one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avsync.llm.common import lower_raw, numbered_words, slices, together, word_slices, worker_cache
from avsync.session import settle

SYMBOLS = 1 << 15
END = SYMBOLS
STATES = 8
ROUNDS = 5
PIECE = 2048  # training reads longer texts in pieces; the one transition between two pieces is not counted
BATCH = 1 << 19
FREQUENT = 1 << 18  # words whose counts every task holds, 4 MB


def word_key(word: bytes) -> int:
    """64-bit key of a word, as a signed number."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Markov:
    """start (states), step (states x states), emit (symbols and the end x states)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_guess(weights: np.ndarray, states: int = STATES, seed: int = 5) -> Markov:
    """States that stay, and symbols by their share in all texts with a seeded lean to some states."""
    rng = np.random.default_rng(seed)
    emit = (weights / weights.sum())[:, None] * np.exp(rng.normal(0, 1, (len(weights), states)))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Markov(np.full(states, 1 / states), step, emit / emit.sum(0))


def time_major(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts step by step, longest text first; where each step begins; how long each text is."""
    lengths = np.array([len(t) for t in texts], np.int64)
    longest = int(lengths.max(initial=0))
    active = len(texts) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    begins = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(begins[-1], np.int64)
    number = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[begins[at] + number] = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    return flat, begins, lengths


def log_likelihood(model: Markov, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole symbol sequence by the scaled forward recursion; holds one step only."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    flat, begins, _ = time_major([texts[i] for i in order])
    total = np.zeros(len(texts))
    ones = np.ones((len(model.start), 1))
    alpha = None
    for t in range(len(begins) - 1):
        e = np.take(model.emit, flat[begins[t] : begins[t + 1]], axis=0)
        alpha = model.start * e if alpha is None else (alpha[: len(e)] @ model.step) * e
        scale = alpha @ ones
        alpha /= scale
        total[: len(e)] += np.log10(scale[:, 0])
    out = np.empty(len(texts))
    out[order] = total
    return out


def expected_counts(
    model: Markov, pieces: list[np.ndarray], begin: list[bool], room: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, step, emit) of the pieces, and their log10 likelihood.

    ``room`` (two, symbols at least, states) is written over; who has many calls to make saves
    the system's work for fresh memory.
    """
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    flat, begins, _ = time_major([pieces[i] for i in order])
    states = len(model.start)
    if room is None:
        room = np.empty((2, len(flat), states))
    e, alpha = room[:, : len(flat)]
    np.take(model.emit, flat, axis=0, out=e, mode="clip")
    scale = np.empty((len(flat), 1))
    ones = np.ones((states, 1))
    before = None
    for t in range(len(begins) - 1):
        now = slice(begins[t], begins[t + 1])
        a = alpha[now]
        if before is None:
            np.multiply(model.start, e[now], out=a)
        else:
            np.matmul(before[: len(a)], model.step, out=a)
            a *= e[now]
        a /= np.matmul(a, ones, out=scale[now])
        before = a
    pairs = np.zeros((states, states))
    onward = None  # emission times beta over scale, of the step after
    back = model.step.T.copy()
    e /= scale
    for t in range(len(begins) - 2, -1, -1):
        now = e[begins[t] : begins[t + 1]]
        if onward is not None:
            of_each = alpha[begins[t] : begins[t] + len(onward)]
            pairs += of_each.T @ onward
            beta = onward @ back  # one where a piece ends
            now[: len(beta)] *= beta
            of_each *= beta  # from here on the chance of each state
        onward = now
    is_begin = np.array([begin[i] for i in order], bool)
    start = alpha[: begins[1]][is_begin].sum(0) if len(begins) > 1 else np.zeros(states)
    by_state = e.reshape(states, -1)
    by_state[:] = alpha.T
    emit = np.stack([np.bincount(flat, chance, len(model.emit)) for chance in by_state], 1)
    return start, model.step * pairs, emit, float(np.log10(scale).sum())


def maximised(start: np.ndarray, step: np.ndarray, emit: np.ndarray, weights: np.ndarray, smooth: float = 3000.0) -> Markov:
    """The model of the summed counts; each state's symbols are smoothed by their share in all texts."""
    emit = emit + smooth * (weights / weights.sum())[:, None]
    start, step = start + 0.1, step + 0.1
    return Markov(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


# -- tables --------------------------------------------------------------------------------


def _count_words(texts: DataFrame) -> DataFrame:
    """(word, n): counts by word key; the end counts as a word."""

    def count(rows: Iterator[pa.RecordBatch]):
        held: Counter[bytes] = Counter()
        ends = 0

        def report():
            keys = [word_key(w) for w in held] + [word_key(b"\n")]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*held.values(), ends], pa.int64())], ["word", "n"])

        for batch in rows:
            for text in batch.column(0).to_pylist():
                for words in word_slices(lower_raw(text)):
                    held.update(words)
                ends += 1
                if len(held) > 1 << 19:
                    yield report()
                    held.clear()
                    ends = 0
        yield report()

    return texts.mapInArrow(count, "word long, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of highest counts, as many whole powers of two as fit in FREQUENT, by key."""
    octave = F.floor(F.log2("n")).cast("int")
    least, held = 63, 0
    for row in sorted(counts.groupBy(octave.alias("k")).count().collect(), key=lambda r: -r["k"]):
        if held + row["count"] > FREQUENT:
            break
        least, held = row["k"], held + row["count"]
    got = counts.filter(octave >= least).toArrow()
    words, n = got.column("word").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def _encode(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: np.ndarray, all_tokens: int, words_known: int) -> DataFrame:
    """Per row: n_tokens, symbols, the parts of the scores that frequent words give, and the rare words with their counts."""
    shipped = docs.sparkSession.sparkContext.broadcast((*frequent, buckets))
    low = np.log10(all_tokens + words_known + 1) if all_tokens else 0.0
    end_key = word_key(b"\n")
    end_count = int(frequent[1][np.searchsorted(frequent[0], end_key)]) if end_key in frequent[0] else None

    def tell(out, raws):
        """Add what some texts, together not much longer than ``AT_ONCE``, or one longer text give."""
        names, counts, totals = shipped.value
        known = worker_cache("word keys", dict)
        keys, which, ends = [], [], None
        for part in slices(raws[0]) if len(raws) == 1 else [raws]:
            words, at, ends = numbered_words(part)
            if len(known) > 1 << 18:
                known.clear()
            new = [w for w in words if w not in known]
            known.update(zip(new, map(word_key, new), strict=True))
            which.append(at + sum(map(len, keys)))
            keys.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        # each different key once, ascending; an empty word stands at a text's edge and is none
        empty = word_key(b"")
        keys, rank = np.unique(np.concatenate([*keys, [end_key, empty]]), return_inverse=True)
        which = np.concatenate(which)
        ends = [len(which)] if len(raws) == 1 else ends
        ranks = rank[which]
        end, none = rank[-2], rank[-1]
        at = np.minimum(np.searchsorted(names, keys), max(0, len(names) - 1))
        found = names[at] == keys if len(names) else np.zeros(len(keys), bool)
        c = np.where(found, counts[at], 0) if len(names) else np.zeros(len(keys), np.int64)
        symbol = (keys & (SYMBOLS - 1)).astype("<u2")
        plain = np.log10(c + 1) - low
        inside = np.where(keys == end_key, 0.0, np.log10(c + 1) - np.log10(totals[symbol] + 1))
        begin = 0
        for stop in ends:
            of_text = ranks[begin:stop]
            of_text = of_text[of_text != none]
            begin = stop
            symbols = np.append(symbol[of_text], np.array([END], "<u2"))
            if end_count is not None:
                of_text = np.append(of_text, end)
            here, n = np.unique(of_text, return_counts=True)
            usual = found[here]
            often, times = here[usual], n[usual]
            rare, rare_n = keys[here[~usual]], n[~usual]
            if end_count is None:  # no text to learn from
                rare, rare_n = np.append(rare, end_key), np.append(rare_n, 1)
            out["n_tokens"].append(len(symbols))
            out["symbols"].append(symbols.tobytes())
            out["n_known"].append(int(times.sum()))
            out["base"].append(float((times * plain[often]).sum()))
            out["given"].append(float((times * inside[often]).sum()))
            out["rare"].append(rare)
            out["rare_n"].append(rare_n)

    def encode(rows: Iterator[pa.RecordBatch]):
        for batch in rows:
            out = {c: [] for c in ("n_tokens", "symbols", "n_known", "base", "given", "rare", "rare_n")}
            for raws in together(map(lower_raw, batch.column(0).to_pylist())):
                tell(out, raws)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [*batch.columns[1:], *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[1:], *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id", "held_out").mapInArrow(
        encode, f"doc_id {kind}, held_out boolean, n_tokens long, symbols binary, n_known long, base double, given double, rare array<long>, rare_n array<long>"
    )


def _round(texts: DataFrame, model: Markov) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Baum-Welch pass: each task sums the counts of its texts, Spark sums the tasks, one
    line per symbol and state row comes to the driver (a fixed number)."""
    states = len(model.start)
    shipped = texts.sparkSession.sparkContext.broadcast(model)
    columns = [f"s{k}" for k in range(states)]

    def count(rows: Iterator[pa.RecordBatch]):
        model = shipped.value
        start, step, emit, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS + 1, states)), 0.0
        pieces, begin, size, room = [], [], 0, np.empty((2, BATCH + PIECE, states))

        def add():
            nonlocal start, step, emit, likelihood
            a, b, c, d = expected_counts(model, pieces, begin, room)
            start, step, emit, likelihood = start + a, step + b, emit + c, likelihood + d

        for batch in rows:
            for raw in batch.column(0).to_pylist():
                symbols = np.frombuffer(raw, "<u2").astype(np.int64)
                for lo in range(0, len(symbols), PIECE):
                    pieces.append(symbols[lo : lo + PIECE])
                    begin.append(lo == 0)
                    size += len(pieces[-1])
                    if size >= BATCH:
                        add()
                        pieces, begin, size = [], [], 0
        if size:
            add()
        table = np.concatenate([emit, step, start[None, :], np.full((1, states), likelihood)])
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(table[used, k]) for k in range(states))], ["line", *columns])

    sums = texts.mapInArrow(count, "line long, " + ", ".join(f"{c} double" for c in columns)).groupBy("line").agg(*[F.sum(c).alias(c) for c in columns])
    got = sums.toArrow()
    table = np.zeros((SYMBOLS + 1 + states + 2, states))
    table[got.column("line").to_numpy()] = np.stack([got.column(c).to_numpy() for c in columns], 1) if got.num_rows else 0
    emit, step = table[: SYMBOLS + 1], table[SYMBOLS + 1 : SYMBOLS + 1 + states]
    return table[-2], step, emit, float(table[-1, 0])


def train(texts: DataFrame, weights: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Markov:
    """Baum-Welch over all texts (a column of symbol sequences), in ``rounds`` passes."""
    model = first_guess(weights, states)
    for _ in range(rounds if weights.sum() > len(weights) else 0):
        start, step, emit, _ = _round(texts, model)
        model = maximised(start, step, emit, weights)
    return model


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Score whole texts under a model learnt from those whose crc32(doc_id as text) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams plus one)
    and score (log10 of the text's probability under the chain). A null text is empty: its
    end alone. A null doc_id counts as the empty text in the remainder. Each row is scored,
    also rows with equal doc_id. With nothing to learn from, every word is unknown and
    base_score is 0. Other columns are not read.
    """
    remainder = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (remainder == 2).alias("held_out"))
    counts = settle(_count_words(docs.filter("not held_out").select("text")), "counts")
    row = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    all_tokens, words_known = row["n"] or 0, row["v"]
    end = word_key(b"\n")
    bucket = F.col("word").bitwiseAND(F.lit(SYMBOLS - 1)).cast("int")
    by_bucket = settle(
        counts.filter(F.col("word") != end).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("v")), "buckets"
    )
    got = by_bucket.toArrow()  # SYMBOLS lines at most
    weights, totals = np.ones(SYMBOLS + 1), np.zeros(SYMBOLS, np.int64)
    weights[got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    totals[got.column("bucket").to_numpy()] = got.column("n").to_numpy() + got.column("v").to_numpy()
    weights[END] += counts.filter(F.col("word") == end).agg(F.sum("n")).first()[0] or 0
    encoded = settle(
        _encode(docs, _frequent(counts), totals, all_tokens, words_known).withColumn("row", F.monotonically_increasing_id()), "encoded"
    )
    model = train(encoded.filter("not held_out").select("symbols"), weights, states, rounds)
    return _scored(encoded, counts, by_bucket, model, all_tokens, words_known)


def _scored(encoded: DataFrame, counts: DataFrame, by_bucket: DataFrame, model: Markov, all_tokens: int, words_known: int) -> DataFrame:
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    def forward(rows: Iterator[pa.RecordBatch]):
        model = shipped.value
        for batch in rows:
            texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()]
            scores, lo, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BATCH or i == len(texts) - 1:
                    scores.append(log_likelihood(model, texts[lo : i + 1]))
                    lo, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names[1:], "chain"])

    plain = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "given"]
    kinds = dict(encoded.dtypes)
    chained = encoded.select("symbols", *plain).mapInArrow(forward, ", ".join(f"{c} {kinds[c]}" for c in plain) + ", chain double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    is_end = F.col("word") == word_key(b"\n")
    # a table of SYMBOLS lines at most
    sizes = F.broadcast(by_bucket.select(F.col("bucket"), (F.col("n") + F.col("v")).alias("size")))
    c = F.coalesce(F.col("n"), F.lit(0))
    low = F.lit(float(np.log10(all_tokens + words_known + 1)) if all_tokens else 0.0)
    more = (
        rare.join(counts, "word", "left")
        .withColumn("bucket", F.col("word").bitwiseAND(F.lit(SYMBOLS - 1)).cast("int"))
        .join(sizes, "bucket", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * (F.log10(c + 1) - low)).alias("more_base"),
            F.sum(F.when(is_end, 0.0).otherwise(F.col("times") * (F.log10(c + 1) - F.log10(F.coalesce("size", F.lit(0)) + 1)))).alias("more_given"),
        )
    )
    return chained.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("chain") + F.col("given") + F.coalesce("more_given", F.lit(0.0))).alias("score"),
    )
