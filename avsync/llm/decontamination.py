"""Operator 7: benchmark decontamination by an FM-index over each shard of the training text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avsync.llm.common import free_name, word_slices, worker_cache

WINDOW = 10
#: words are runs of ASCII letters and digits (A-Z taken as a-z) and of anything beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256))
_FIND = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SEPARATOR, OTHER, FIRST = 0, 1, 2


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def windows(words: list[bytes], length: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))]


def suffix_order(text: np.ndarray, letters: int) -> np.ndarray:
    """Positions in order of their suffixes. A suffix ends at the next separator; equal ones
    stand in the order of their separators. ``text`` ends in a separator.

    The first sort is by as many letters as fit in one number, then the sorted length
    doubles, over those positions only that are still tied.
    """
    n = len(text)
    bits = max(1, int(letters - 1).bit_length())
    width = max(1, 62 // bits)
    ends = np.flatnonzero(text == SEPARATOR)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    to_end = ends[piece] - np.arange(n)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):
        letter = np.where(open_, padded[j : j + n], 0)
        key = (key << bits) | letter
        open_ &= letter != SEPARATOR
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n + 1, bool)  # where a group of ties begins
    fresh[1:n] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    h = width
    while True:
        tied = np.flatnonzero(~(fresh[:n] & fresh[1:]))
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(to_end[at] < h, piece[at], rank[np.minimum(at + h, n - 1)])
        both = rank[at] * (n + 1) + after
        sorting = np.argsort(both)
        both, at = both[sorting], at[sorting]
        order[tied] = at
        fresh[tied[1:]] |= both[1:] != both[:-1]
        begins = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        rank[at] = begins
        h *= 2


class WaveletTree:
    """Ranks of letters in a sequence, level by level of their bits (the levelwise form)."""

    def __init__(self, text: np.ndarray, letters: int):
        self.levels = max(1, int(letters - 1).bit_length())
        self.ones, self.zeros = [], []
        base = np.zeros(1 << self.levels, np.int64)
        symbols = np.arange(1 << self.levels)
        for level in reversed(range(self.levels)):
            bit = ((text >> level) & 1).astype(bool)
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(text) - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            base = np.where((symbols >> level) & 1, zeros + ones[base], base - ones[base])
            text = np.concatenate([text[~bit], text[bit]])
        self.base = base  # where each letter begins in the last level

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each letter stands before each position."""
        for i, level in enumerate(reversed(range(self.levels))):
            ones = self.ones[i][at]
            at = np.where((letter >> level) & 1, self.zeros[i] + ones, at - ones)
        return at - self.base[letter]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letter at each position, and how often it stands before it."""
        letter = np.zeros(len(at), np.int64)
        for i in range(self.levels):
            ones = self.ones[i][at]
            bit = (self.ones[i][at + 1] - ones).astype(bool)
            letter = (letter << 1) | bit
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return letter, at - self.base[letter]


class FMIndex:
    """Backward search and location over one shard: a sequence of letters whose pieces end in separators."""

    RATE = 16

    def __init__(self, text: np.ndarray, letters: int):
        order = suffix_order(text, letters)
        before = text[order - 1]  # of position 0: the last letter, a separator
        self.tree = WaveletTree(before, letters)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
        # positions at the rate and at the beginnings of pieces, so that no walk passes a separator
        marked = (order % self.RATE == 0) | (before == SEPARATOR)
        self.marked, self.mark_rank, self.sampled = marked, np.cumsum(marked) - marked, order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, one per line of ``phrases`` (aligned to the right)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.first[-1], np.int64)
        live = np.arange(len(phrases))
        width = phrases.shape[1]
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            letter = phrases[live, width - 1 - step]
            lo[live] = self.first[letter] + self.tree.rank(letter, lo[live])
            hi[live] = self.first[letter] + self.tree.rank(letter, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows: step back to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.sampled[self.mark_rank[at[done]]] + steps[left[done]]
            left, at = left[~done], at[~done]
            letter, rank = self.tree.access(at)
            at = self.first[letter] + rank
            steps[left] += 1
        return out


class Phrases:
    """Different windows of a block of items, as letters; which items have which window."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int = WINDOW):
        self.letter: dict[bytes, int] = {}
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for window in windows(item_words(text), length):
                owners.setdefault(window, set()).update([item_id] if item_id is not None else [])
                for word in window:
                    self.letter.setdefault(word, len(self.letter) + FIRST)
        self.letters = len(self.letter) + FIRST
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.table = np.zeros((len(owners), length), np.int64)
        for i, window in enumerate(owners):
            self.table[i, length - len(window) :] = [self.letter[w] for w in window]

    def code(self, raw: bytes) -> np.ndarray:
        """The letters of a text; words of no phrase are one letter."""
        get = self.letter.get
        parts = [np.fromiter(map(get, words, repeat(OTHER)), np.int32, len(words)) for words in word_slices(raw.translate(_TABLE))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def search_shard(pieces: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard: number of the piece, position in it, number of the phrase."""
    ends = np.cumsum([len(p) + 1 for p in pieces])
    text = np.zeros(ends[-1], np.int32)
    for piece, end in zip(pieces, ends, strict=True):
        text[end - 1 - len(piece) : end - 1] = piece
    index = FMIndex(text, phrases.letters)
    lo, hi = index.search(phrases.table, phrases.lengths)
    found = np.flatnonzero(lo < hi)
    many = hi[found] - lo[found]
    phrase = np.repeat(found, many)
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(found) else np.zeros(0, np.int64)
    at = index.locate(rows)
    piece = np.searchsorted(ends, at, side="right")
    return piece, at - np.concatenate([[0], ends[:-1]])[piece], phrase


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of hits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _shards(coded: Iterator[tuple[object, np.ndarray]], phrases: Phrases, shard_words: int, overlap: int):
    """Texts gathered to shards of about ``shard_words`` words, searched; yields (row, words, runs, items).

    A text over that size is cut into pieces that overlap by one word less than the longest
    phrase, so no occurrence is lost; its pieces are shards of their own.
    """

    def flush(held):
        pieces = [(k, lo, codes[lo : lo + shard_words]) for k, (_, codes) in enumerate(held) for lo in range(0, max(1, len(codes)), max(1, shard_words - overlap))]
        base = np.cumsum([0, *(len(codes) for _, codes in held)])
        hits = np.zeros(base[-1], bool)
        items: list[set[str]] = [set() for _ in held]
        shard: list = []

        def run():
            piece, at, phrase = search_shard([p[2] for p in shard], phrases)
            if not len(at):
                return
            owner = np.array([p[0] for p in shard])[piece]
            at = base[owner] + at + np.array([p[1] for p in shard])[piece]
            length = phrases.lengths[phrase]
            for j in range(phrases.table.shape[1]):
                hits[at[length > j] + j] = True
            for both in np.unique(owner * len(phrases.table) + phrase).tolist():
                items[both // len(phrases.table)].update(phrases.owners[both % len(phrases.table)])

        size = 0
        for p in pieces:
            if shard and size + len(p[2]) > shard_words:
                run()
                shard, size = [], 0
            shard.append(p)
            size += len(p[2])
        run()
        for k, ((row, codes), found) in enumerate(zip(held, items, strict=True)):
            yield row, len(codes), runs(hits[base[k] : base[k + 1]]), sorted(found)

    held, size = [], 0
    for row, codes in coded:
        held.append((row, codes))
        size += len(codes)
        if size >= shard_words:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _blocks(items: DataFrame, item_id: str, text: str, block_items: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block = []
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == block_items:
            yield block
            block = []
    if block:
        yield block


def find_spans(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_items: int = 20_000,
    shard_words: int = 1 << 19,
    length: int = WINDOW,
    finish: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], T.StructType] | None = None,
) -> DataFrame:
    """All columns of ``df`` and a last one, a struct ``_found``: n_words, runs (word positions from, to), items.

    An FM-index is built over each shard of training text inside the task that reads it;
    the windows of the items are searched backwards in it and located by sampled
    positions. Items are taken in blocks of ``block_items``, which is what a task holds of
    them; with several blocks the text is passed as often, and runs and items are joined.
    No row moves. A null or empty text has no words; null items neither. An item without id
    hits words and is not listed. If ``df`` has a column ``_found``, the new one is called otherwise.
    ``finish`` (a function of whole batches and the schema that it gives) is applied in the
    tasks of the last block, so that no second Python worker stands beside the index.
    """
    found_type = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    out = df.withColumn(free_name(df, "_found"), F.lit(None).cast(found_type))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(found_type)
    at = df.columns.index(text)
    blocks = _blocks(items, item_id, item_text, block_items) if items.take(1) else iter([[]])
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shipped = df.sparkSession.sparkContext.broadcast(Phrases(block, length))
        final, schema = finish if finish and after is None else (lambda batch: batch, out.schema)

        def search(rows, shipped=shipped, final=final):
            phrases = shipped.value
            worker_cache("decontamination", dict)  # lets go of what other operators kept

            def coded():
                for batch in rows:
                    for i, t in enumerate(batch.column(at).to_pylist()):
                        yield (batch, i), phrases.code((t or "").encode("utf-8"))

            done, current = [], None

            def close(batch, done):
                last = batch.num_columns - 1
                new = []
                for old, (n, spans, names) in zip(batch.column(last).to_pylist(), done, strict=True):
                    if old and old["n_words"] is not None:
                        spans = _merge([(s["begin"], s["end"]) for s in old["runs"]] + spans)
                        names = sorted({*old["items"], *names})
                    new.append({"n_words": n, "runs": [{"begin": a, "end": b} for a, b in spans], "items": names})
                return batch.set_column(last, batch.schema.field(last), pa.array(new, arrow))

            if phrases.letters == FIRST:
                results = ((row, len(codes), [], []) for row, codes in coded())
            else:
                results = _shards(coded(), phrases, shard_words, phrases.table.shape[1] - 1)
            for (batch, _), *rest in results:
                if current is not None and batch is not current:
                    yield final(close(current, done))
                    done = []
                current = batch
                done.append(rest)
            if current is not None:
                yield final(close(current, done))

        out = out.mapInArrow(search, schema)
        block = after
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **options)
    hit: Column = F.aggregate("_found.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    names = F.array_sort("_found.items")
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("_found.runs") > 0).alias("contaminated"),
    )


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without its words of these runs and what stands between them."""
    if text is None or not spans:
        return text
    words = [m.span() for m in _FIND.finditer(text)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : words[a][0]].rstrip())
        at = words[b - 1][1]
    parts.append(text[at:].lstrip())
    return " ".join(p for p in parts if p)


def remove_spans(df: DataFrame, items: DataFrame, text: str = "text", drop_emptied: bool = False, **options) -> DataFrame:
    """The same rows and columns, with the words of found passages cut out of the text.

    ``drop_emptied``: rows that had words and have none left go; rows without words stay.
    """
    at, last = df.columns.index(text), len(df.columns)

    def clean(batch):
        spans = batch.column(last).to_pylist()
        texts = [cut(t.as_py(), [(r["begin"], r["end"]) for r in s["runs"]]) if s["runs"] else t.as_py() for t, s in zip(batch.column(at), spans, strict=True)]
        field = batch.schema.field(at)
        out = batch.set_column(at, field, pa.array(texts, field.type)).select(range(last))
        if drop_emptied:
            rest = [not s["runs"] or s["runs"][0]["begin"] > 0 or s["runs"][0]["end"] < s["n_words"] for s in spans]
            out = out.filter(pa.array(rest, pa.bool_()))
        return out

    return find_spans(df, items, text=text, finish=(clean, df.schema), **options)


SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), places AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM places) p JOIN item_windows v ON p.g = v.g AND p.n = v.n
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
