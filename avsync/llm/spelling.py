"""Operator 13: spelling variants by edits probed against Bloom filters of the vocabulary.

Every word asks for its neighbours by spelling them out: each deletion of a letter and each
replacement by a greater one, so that a pair is met from one side only. The asking is of
blocked Bloom filters, one per word length, that are sent to all tasks; only what they affirm
is shuffled, to a join with the vocabulary that removes the false positives.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avsync.llm.common import width, word_slices
from avsync.session import settle

LEAST_LETTERS, LEAST_COUNT, EVERY = 5, 3, 97
COUNT_ROOM = 1 << 17  # different words a task holds before it gives their counts away
BITS_PER_WORD = 32
SEGMENT = 1 << 20  # 64-bit blocks of a filter that lie together (8 MB)
SENT_BYTES = 32 << 20  # filters sent to tasks at a time; a larger vocabulary is asked in more passes
AT_ONCE = 4096

#: all code points of a run fit one byte: letters in lower case (A-Z only), everything else a space
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

# -- words and their counts ---------------------------------------------------------------------


def variants_of(doc_id: object, text: str | None) -> Iterator[tuple[bytes, int]]:
    """(word, count) of a text after the seeded deletions; one byte a code point. A word may come more than once."""
    raw = (text or "").encode("latin-1", "replace").translate(TABLE)
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for words in word_slices(raw):
        for run, n in Counter(words).items():
            if len(run) >= LEAST_LETTERS:
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                if h % EVERY == 0:
                    cut = h % len(run)
                    run = run[:cut] + run[cut + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                yield run, n


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least five code points and three occurrences, sums made in the tasks first."""
    schema = "word string, n long"

    def count(batches: Iterator[pa.RecordBatch]):
        def rows():
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        held: dict[bytes, int] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                doc, said = (c[at].as_py() for c in batch.columns)
                for word, n in variants_of(doc, said):
                    held[word] = held.get(word, 0) + n
                if len(held) > COUNT_ROOM:
                    yield rows()
        yield rows()

    counts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, schema)
    return settle(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "vocabulary")


# -- hashes that follow an edit --------------------------------------------------------------------

_RANDOM = np.random.default_rng(13)
LETTER = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15
BACK = np.uint64(pow(STEP, -1, 1 << 64))


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, STEP, np.uint64)]).cumprod(dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def terms(letters: np.ndarray) -> np.ndarray:
    """What each place of each word (rows of one length) adds to the word's hash."""
    return LETTER[letters] * powers(letters.shape[1])[:-1]


def blocks_of(words: int) -> int:
    """64-bit blocks of the filter of so many words of one length, a power of two."""
    return 1 << max(0, (words * BITS_PER_WORD // 64 - 1).bit_length())


def bit(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(34 + 6 * k)) & np.uint64(63)


PROBES = 5


def by_length(words: list[bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(length, words, letters) for words of one length, a bounded number of letters at a time."""
    groups: dict[int, list[bytes]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, same in groups.items():
        step = max(1, min(AT_ONCE, (1 << 20) // length))
        for at in range(0, len(same), step):
            part = same[at : at + step]
            yield length, part, np.frombuffer(b"".join(part), np.uint8).reshape(len(part), length)


def filters(words: DataFrame, sizes: dict[int, int], span: int = SEGMENT) -> DataFrame:
    """length, segment, filter: the blocked Bloom filters, a word's bits all in one 64-bit block.

    ``sizes`` has the blocks by length. Words are dealt by (length, segment) and a task holds
    one segment (8 MB at most) at a time.
    """

    def placed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for length, _, letters in by_length([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                h = mixed(terms(letters).sum(axis=1, dtype=np.uint64))
                block = h & np.uint64(sizes[length] - 1)
                mask = np.zeros(len(h), np.uint64)
                for k in range(PROBES):
                    mask |= np.uint64(1) << bit(h, k)
                columns = [np.full(len(h), length, np.int64), (block // np.uint64(span)).astype(np.int64), (block % np.uint64(span)).astype(np.int64), mask.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "segment", "block", "mask"])

    def built(batches: Iterator[pa.RecordBatch]):
        key, held = None, None
        for batch in batches:
            length, segment, block, mask = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero((np.diff(length) != 0) | (np.diff(segment) != 0)) + 1
            for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(length)], strict=True):
                if at == end:
                    continue
                now = (int(length[at]), int(segment[at]))
                if now != key:
                    if key:
                        yield row(key, held)
                    key, held = now, np.zeros(min(span, sizes[now[0]]), np.uint64)
                np.bitwise_or.at(held, block[at:end], mask[at:end].view(np.uint64))
        if key:
            yield row(key, held)

    def row(key, held):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["length", "segment", "filter"])

    bits = words.select("word").mapInArrow(placed, "length long, segment long, block long, mask long")
    dealt = bits.repartition(width(words.sparkSession), "length", "segment").sortWithinPartitions("length", "segment")
    return settle(dealt.mapInArrow(built, "length long, segment long, filter binary"), "filters")


class Filters:
    """Some segments of the filters, asked with hashes."""

    def __init__(self, parts: dict[tuple[int, int], bytes], sizes: dict[int, int], span: int):
        self.sizes, self.span = sizes, span
        self.parts: dict[int, dict[int, np.ndarray]] = {}
        for (length, segment), held in parts.items():
            self.parts.setdefault(length, {})[segment] = np.frombuffer(held, np.uint64)

    def affirmed(self, length: int, h: np.ndarray) -> np.ndarray:
        """Positions in the flat ``h`` (sums before mixing) of words that may be there."""
        found = []
        h = mixed(h)
        block = h & np.uint64(self.sizes[length] - 1)
        for segment, held in self.parts[length].items():
            some = None if self.sizes[length] <= self.span else np.flatnonzero(block // np.uint64(self.span) == np.uint64(segment))
            mine, where = (h, block) if some is None else (h[some], block[some] % np.uint64(self.span))
            bits = held[where.astype(np.int64)]
            left = np.flatnonzero((bits >> bit(mine, 0)) & np.uint64(1))
            for k in range(1, PROBES):
                left = left[((bits[left] >> bit(mine[left], k)) & np.uint64(1)).astype(bool)]
            found.append(left if some is None else some[left])
        return np.concatenate(found)


def edits(words: list[bytes], asked: Filters, alphabet: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(index of the word, edited word) for edits that the filters affirm: deletions, each different
    result once, and replacements by a greater letter."""
    at = {}
    for i, w in enumerate(words):
        at[w] = i
    for length, part, letters in by_length(words):
        power = powers(length)
        added = terms(letters)
        ends = added.cumsum(axis=1, dtype=np.uint64)
        total = ends[:, -1]
        if length - 1 in asked.parts:
            for p in range(length):
                head = ends[:, p - 1] if p else np.zeros(len(part), np.uint64)
                h = head + (total - ends[:, p]) * BACK
                hits = asked.affirmed(length - 1, h)
                if p:
                    hits = hits[letters[hits, p] != letters[hits, p - 1]]
                for i in hits.tolist():
                    yield at[part[i]], part[i][:p] + part[i][p + 1 :]
        if length in asked.parts:
            for p in range(length):
                h = (total - added[:, p])[:, None] + LETTER[alphabet][None, :] * power[p]
                hits = asked.affirmed(length, h.ravel())
                rows, new = np.divmod(hits, len(alphabet))
                greater = alphabet[new] > letters[rows, p]
                for i, c in zip(rows[greater].tolist(), alphabet[new[greater]].tolist(), strict=True):
                    yield at[part[i]], part[i][:p] + bytes([c]) + part[i][p + 1 :]


# -- Spark ---------------------------------------------------------------------------------------------


def near_pairs(words: DataFrame, sent_bytes: int = SENT_BYTES, span: int = SEGMENT) -> DataFrame:
    """a, n_a, b, n_b: each pair of words one edit apart once.

    The lengths and their counts come to the driver (one row per length of word). Filters are
    sent ``sent_bytes`` at a time; with a larger vocabulary its words are asked once per pass.
    A candidate is met by at most one word per possible edit, so no join key is hot.
    """
    spark = words.sparkSession
    lengths = {r["length"]: r["n"] for r in words.groupBy(F.length("word").cast("long").alias("length")).agg(F.count("*").alias("n")).collect()}
    sizes = {length: blocks_of(n) for length, n in lengths.items()}
    used = words.select(F.explode(F.split("word", "")).alias("c")).distinct().filter("c != ''").collect()
    alphabet = np.frombuffer(b"".join(sorted(r["c"].encode("latin-1") for r in used)), np.uint8)
    built = filters(words, sizes, span)
    passes, room = [[]], sent_bytes
    for length in sorted(sizes):
        for segment in range(-(-sizes[length] // span)):
            cost = 8 * min(span, sizes[length])
            if cost > room and passes[-1]:
                passes.append([])
                room = sent_bytes
            passes[-1].append((length, segment))
            room -= cost
    found = None
    for shards in passes if sizes else []:
        (low, first), (high, last) = shards[0], shards[-1]
        here = built.filter(f"(length > {low} or length = {low} and segment >= {first}) and (length < {high} or length = {high} and segment <= {last})")
        sent = spark.sparkContext.broadcast(({(r["length"], r["segment"]): bytes(r["filter"]) for r in here.toLocalIterator()}, sizes, span))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent):
            asked = Filters(*sent.value)
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    names, counts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    who, to = [], []
                    for i, edited in edits([w.encode("latin-1") for w in names], asked, alphabet):
                        who.append(i)
                        to.append(edited.decode("latin-1"))
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in who], pa.string()), pa.array([counts[i] for i in who], pa.int64()), pa.array(to, pa.string())], ["a", "n_a", "b"])

        more = words.select("word", "n").mapInArrow(probe, "a string, n_a long, b string")
        found = more if found is None else found.union(more)
    if found is None:
        found = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"))
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached by following forms (word, form).

    Pointers double in each round. A form occurs at least twice as often as its word, so a
    chain has at most log2 of the largest count steps and there are few rounds. Words whose
    end is found leave the rounds.
    """
    steps = settle(forms.select("word", F.col("form").alias("to")), "steps")
    left, done = steps, None
    while True:
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = settle(left.join(ahead, "to", "left").select("word", "to", "further"), "steps")
        ended = moved.filter("further is null").select("word", F.col("to").alias("root"))
        done = ended if done is None else done.union(ended)
        left = moved.filter("further is not null").select("word", F.col("further").alias("to"))
        if left.isEmpty():
            return done
        steps = settle(moved.select("word", F.coalesce("further", "to").alias("to")).union(steps.join(moved.select("word"), "word", "left_anti")), "steps")


def spelling_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Words and the form each is a variant of: word, n, form, form_n, n_near, root.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Let h be
    crc32 of ``doc_id:run``: where 97 divides h the run loses the code point h modulo its
    length. Words have five code points and three occurrences at least. A word's form is the
    word one edit away (a code point inserted, deleted or replaced) with most occurrences, the
    first by code points of equals, if it has at least twice as many; root is where forms
    lead in the end, the word itself if it has none.

    A null text has no words, a null doc_id counts as empty there; rows of one id are read like
    others, and other columns are not read. Empty tables give no rows.
    """
    words = vocabulary(df, doc_id, text)
    pairs = settle(near_pairs(words, sent_bytes), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.union(pairs.select(F.col("b"), F.col("a"), F.col("n_a")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    twice = -F.col("best.less") >= 2 * F.col("n")
    told = words.join(best, "word", "left").select(
        "word",
        "n",
        F.when(twice, F.col("best.near")).alias("form"),
        F.when(twice, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    told = settle(told, "forms")
    return told.join(roots(told.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE
bits(i, v, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n,
         xor(list_reduce(list_prepend(4294967295::UBIGINT,
               list_concat(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda c: ord(c)::UBIGINT),
                           flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT] ELSE [195::UBIGINT, (ord(c) - 64)::UBIGINT] END)))),
               lambda a, c: xor(t[(xor(a, c) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) AS h
  FROM counted, crc_table
),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
),
cut AS (SELECT word, n, p, left(word, p - 1) || substring(word, p + 1) AS rest FROM words, range(1, length(word) + 1) places(p)),
pairs AS (
  SELECT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT c.word, d.word FROM cut c JOIN cut d ON c.rest = d.rest AND c.p = d.p AND c.word <> d.word
),
best AS (SELECT a AS word, count(*) AS n_near, min({'less': -w.n, 'near': w.word}) AS best FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (
  SELECT word, n, CASE WHEN -best.less >= 2 * n THEN best.near END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words LEFT JOIN best USING (word)
),
chain(word, root) AS (
  SELECT word, coalesce(form, word) FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL AND c.root <> c.word
),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""
