"""Operator 8: token ids as separately compressed documents with one shared dictionary.

A store is a folder with three tables, all written and read by Spark, so that it may lie in
any file system and a lost executor costs no more than its task:

* ``packs``: file_no, first_doc, last_doc, dictionary_hash, n_tokens, doc_ids, starts,
  lengths, offsets, payload. Documents stand in ascending doc_id order inside a file and over
  the files; ``payload`` holds one zstandard frame per document, cut at ``offsets``;
  ``starts`` counts ids from the beginning of the file.
* ``files``: file_no, first_token, n_tokens: where each file begins in the whole sequence.
* ``dictionary``: dictionary_hash and the dictionary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avsync.llm.common import AT_ONCE, numbered_words, width, word_slices, worker_cache
from avsync.session import new_dir, settle

#: letters whose lower case is one letter and whose normal form is themselves, then ASCII signs that begin no contraction or special token
_LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{-~]*)")
#: the splitting under which a run of letters is a piece of its own, and a run of signs after it another
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: the letter that the byte-level alphabet writes for each byte
_BYTE_LEVEL = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted({*range(256)}.difference(_SHOWN)))}

END = 1
DICTIONARY_BYTES = 112_640
PACK_BYTES = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never span ASCII white space.

    Such a tokenizer gives a text the ids of its words one after another, so each different
    word goes through the library once while there is room to remember it. Words are kept in
    lower case, as the normaliser would make them, except near the marks of special tokens,
    which are told apart by case. A comma or full stop after an ASCII letter or digit begins
    a token of its own, so such a word is known by the word without it.

    Where the tokenizer is of a known kind (``_plain_letters``), letters and the signs after them
    are looked up apart, and words of letters go to its model directly, past the normaliser and the
    splitting, which leave them as they are and cost more than the merges.

    Arrow splits texts and numbers their different words; only those are looked up one by
    one, the rest is gathering by number. New words go through the library some thousands at
    a time, kept apart by a special token, so that one list of ids comes back for all.
    """

    ROOM = 400_000  # words of one half; there are two
    AT_ONCE = AT_ONCE
    _ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        special = sorted(
            (number, token.content)
            for number, token in self.tokenizer.get_added_tokens_decoder().items()
            if token.special and not (token.normalized or token.single_word or token.lstrip or token.rstrip)
            and token.content.startswith("<|") and token.content.endswith("|>")
        )
        self.apart = None if literal or not special else special[-1]
        self.model = self.tokenizer.model if self._plain_letters() else None

    def _plain_letters(self) -> bool:
        """Whether normaliser and splitting do no more to a lower-case word of ``_LETTERS`` than tell letters from signs."""
        told = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        normal, split = told(self.tokenizer.normalizer), told(self.tokenizer.pre_tokenizer)
        steps = [(x["type"], x.get("pattern")) for x in normal.get("normalizers", [normal])]
        parts = split.get("pretokenizers", [{}, {}])
        return (
            type(self.tokenizer.model).__name__ == "BPE"
            and steps == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
            and len(parts) == 2
            and (parts[0].get("pattern"), parts[0].get("behavior"), parts[0].get("invert")) == ({"Regex": _PIECES}, "Removed", True)
            and (parts[1].get("type"), parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == ("ByteLevel", False, False)
        )

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters by the tokenizer's model."""
        tokenize = self.model.tokenize
        out = []
        for w in words:
            w = w if w.isascii() else w.decode().lower().encode()
            out.append(array("I", [t.id for t in tokenize(w.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes())
        return out

    def _stem(self, w: bytes) -> int:
        """How much of a word is looked up alone, the rest (signs) being looked up apart."""
        if self.model and (m := _LETTERS.fullmatch(w)):
            return m.end(1)
        return len(w) - 1 if len(w) > 1 and w[-1] in b",." and w[-2] in self._ALNUM else len(w)

    @classmethod
    def at(cls, path: str, literal: bool = False) -> WordEncoder:
        """One per Python worker, kept over tasks. ``literal``: the names of special tokens are ordinary text."""
        return worker_cache((cls, path, literal), lambda: cls(path, literal))

    def _library(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word by the tokenizer itself."""
        if self.apart and len(words) > 1 and not any(b"<|" in w for w in words):
            number, mark = self.apart
            text = mark.join([w.decode() for w in words])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == number) * 4
            if len(cuts) == len(words) - 1:
                raw = ids.tobytes()
                return [raw[i:j] for i, j in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words (one may be empty)."""
        if len(self.ids) > self.ROOM:
            # words that come again move to the new half, the rest go with the old one
            self.older, self.ids = self.ids, {}
        ids, older = self.ids, self.older
        out = list(map(ids.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        cuts = [self._stem(words[i]) for i in missing]
        stems = [words[i][:k] for i, k in zip(missing, cuts, strict=True)]
        tails = [words[i][k:] for i, k in zip(missing, cuts, strict=True)]
        unknown = {*stems, *tails, b""}.difference(ids)
        again = unknown.intersection(older)
        ids.update(zip(again, map(older.__getitem__, again), strict=True))
        new = list(unknown.difference(again))
        if self.model:
            letters = [w for w in new if (m := _LETTERS.fullmatch(w)) and m.end(1) == len(w)]
            ids.update(zip(letters, self._merged(letters), strict=True))
            new = list({*new}.difference(letters))
        odd = [w for w in new if b"<|" in w]
        plain = [w for w in new if b"<|" not in w] if odd else new
        for some in (plain, odd):
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                ids.update(zip(part, self._library(part), strict=True))
        for i, stem, tail in zip(missing, stems, tails, strict=True):
            out[i] = ids[stem] + ids[tail]
        return out

    def _together(self, raws: list[bytes]) -> list[bytes]:
        """The ids of some texts, together not much longer than ``AT_ONCE``."""
        words, which, stops = numbered_words(raws)
        known = self._of(words)
        flat = np.frombuffer(b"".join(known), "<u4")
        lengths = np.fromiter(map(len, known), np.int32, len(known)) // 4
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        each = lengths[which]
        ends = np.cumsum(each, dtype=np.int32)
        ids = flat[np.repeat(begins[which] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        at = np.concatenate([[0], ends])[[0, *stops]].astype(np.int64) * 4
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id."""
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            raw = (text or "").encode("utf-8")
            raw = raw if b"<|" in raw else raw.lower()
            if held and size + len(raw) > self.AT_ONCE:
                out += self._together(held)
                held, size = [], 0
            if len(raw) > self.AT_ONCE:
                out.append(b"".join(self._together([b" ".join(words)])[0] for words in word_slices(raw, self.AT_ONCE)))
            else:
                held.append(raw)
                size += len(raw)
        return out + self._together(held) if held else out


def _encoded(rows: Iterator[pa.RecordBatch], path: str, text: int, step: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    encoder = WordEncoder.at(path)
    for batch in rows:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, encoder.encode(part.column(text).to_pylist())


def train_dictionary(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, sample_docs: int = 2000, sample_bytes: int = 16_384
) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample of documents.

    The sample is the ``sample_docs`` documents of lowest hash, of each at most
    ``sample_bytes``; so much comes to the driver. Too few for training: the sample itself is
    the dictionary, as raw content.
    """
    tokenizer = tokenizer or default_tokenizer()
    chosen = df.select(F.col(doc_id).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs).distinct()
    texts = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id", "left_semi").select("__text")

    def sample(rows):
        for _, ids in _encoded(rows, tokenizer, 0):
            yield pa.RecordBatch.from_arrays([pa.array([x[:sample_bytes] for x in ids], pa.binary())], ["ids"])

    samples = sorted(bytes(r["ids"]) for r in texts.mapInArrow(sample, "ids binary").collect() if r["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_store(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, level: int = 3, pack_bytes: int = PACK_BYTES
) -> None:
    """Encode whole texts, end each with the id ``END``, and write them as a store.

    A null text is an empty document (its end id alone). A null doc_id stands first; equal
    doc_ids stand next to one another and each has its own entry. An empty table gives an
    empty store. Other columns are not read. A text larger than ``pack_bytes`` is a pack of
    its own.
    """
    spark = df.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    dictionary = train_dictionary(df, doc_id, text, tokenizer)
    mark = hashlib.sha256(dictionary).hexdigest()
    key = df.schema[doc_id].dataType
    end = np.array([END], "<u4").tobytes()

    def compress(rows):
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        for batch, ids in _encoded(rows, tokenizer, 1):
            whole = [x + end for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array([pack.compress(x) for x in whole], pa.binary())],
                ["doc_id", "length", "frame"],
            )

    frame = T.StructType([T.StructField("doc_id", key), T.StructField("length", T.LongType()), T.StructField("frame", T.BinaryType())])
    frames = settle(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(compress, frame), "frames")

    def gather(rows):
        held, size, start = [], 0, 0

        def packed():
            ids, lengths, frames, file_no = (list(x) for x in zip(*held, strict=True))
            offsets = np.cumsum([0, *map(len, frames)])
            starts = start + np.cumsum([0, *lengths[:-1]])
            first, last = next((x for x in ids if x is not None), None), ids[-1]
            row = {
                "file_no": file_no[0], "first_doc": first, "last_doc": last, "dictionary_hash": mark, "n_tokens": sum(lengths), "doc_ids": ids,
                "starts": starts.tolist(), "lengths": lengths, "offsets": offsets.tolist(), "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in rows:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size + len(row[2]) > pack_bytes:
                    yield packed()
                    start += sum(r[1] for r in held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield packed()

    from pyspark.sql.pandas.types import to_arrow_schema

    long = T.LongType()
    schema = T.StructType(
        [T.StructField("file_no", T.IntegerType()), T.StructField("first_doc", key), T.StructField("last_doc", key), T.StructField("dictionary_hash", T.StringType()), T.StructField("n_tokens", long)]
        + [T.StructField("doc_ids", T.ArrayType(key))]
        + [T.StructField(c, T.ArrayType(long)) for c in ("starts", "lengths", "offsets")]
        + [T.StructField("payload", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)
    ordered = frames.repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "length", "frame")
    numbered = ordered.withColumn("file_no", F.spark_partition_id())
    numbered.mapInArrow(gather, schema).write.parquet(f"{path}/packs")
    packs = spark.read.schema(schema).parquet(f"{path}/packs")
    counts = sorted((r["file_no"], r["n"]) for r in packs.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).collect())
    at, files = 0, []
    for file_no, n in counts:  # one row per file
        files.append((file_no, at, n))
        at += n
    spark.createDataFrame(files, "file_no int, first_token long, n_tokens long").coalesce(1).write.parquet(f"{path}/files")
    spark.createDataFrame([(mark, bytearray(dictionary))], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    mark, dictionary = row["dictionary_hash"], bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != mark:
        raise ValueError(f"the dictionary of {path} is not the one the store was written with")
    return mark, dictionary


def _opener(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document of a store: doc_id, start (ids before it), n_tokens, ids_crc32 and the ids."""
    mark, dictionary = _dictionary(spark, path)
    packs = spark.read.parquet(f"{path}/packs")
    files = spark.read.parquet(f"{path}/files").select("file_no", "first_token")
    key = packs.schema["doc_ids"].dataType.elementType

    def unpack(rows):
        opener = _opener(dictionary)
        for batch in rows:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != mark:
                    raise ValueError("a pack was written with another dictionary")
                for lo in range(0, len(row["doc_ids"]), 1024):
                    hi = min(lo + 1024, len(row["doc_ids"]))
                    raw = [opener.decompress(row["payload"][row["offsets"][i] : row["offsets"][i + 1]]) for i in range(lo, hi)]
                    columns = [
                        pa.array(row["doc_ids"][lo:hi], batch.schema.field("doc_ids").type.value_type),
                        pa.array([row["first_token"] + s for s in row["starts"][lo:hi]], pa.int64()),
                        pa.array([len(x) // 4 for x in raw], pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in raw], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("doc_id", key), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    names = [f.name for f in fields]
    # one row per file of the store; Spark's own size check decides on the broadcast
    return packs.join(files, "file_no").mapInArrow(unpack, T.StructType(fields))


def fetch(spark: SparkSession, path: str, doc_id) -> list[list[int]]:
    """The ids of one document (all entries of that id): reads only packs whose range holds it, and of
    these opens only its own frames."""
    _, dictionary = _dictionary(spark, path)
    at = F.explode(F.arrays_zip("doc_ids", "lengths", F.slice("offsets", 1, F.size("doc_ids")).alias("begins"), F.slice("offsets", 2, F.size("doc_ids")).alias("ends")))
    hits = (
        spark.read.parquet(f"{path}/packs")
        .filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        .select(at.alias("d"), "payload")
        .filter(F.col("d.doc_ids") == doc_id)
        .select(F.expr("substring(payload, cast(d.begins as int) + 1, cast(d.ends - d.begins as int))").alias("frame"))
    )
    opener = _opener(dictionary)
    return [np.frombuffer(opener.decompress(bytes(r["frame"])), "<u4").tolist() for r in hits.collect()]


def token_output(df: DataFrame, path: str | None = None, **write) -> DataFrame:
    """Write a store and read it back: doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = df.sparkSession
    path = path or new_dir(spark, "tokens")
    write_store(df, path, **write)
    return read_store(spark, path, ids=False)
