"""Operator 9: token counts of documents in flat token files, by a scan for the end id.

A flat file is nothing but ids, one document after another, each closed by the end id; it is
stored in blocks of fixed length that cut documents anywhere (a table with file_no, block_no,
payload). There is no index: the scan finds the ends in each block by one vector comparison,
and a prefix scan over the blocks' sums says what the part before a block's first end
continues, and the number and place of each document in its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from avsync.llm.token_output import WordEncoder, default_tokenizer
from avsync.session import settle

END = 49_407  # <|endoftext|>; no text gives it, its name in a text being ordinary text
BLOCK_TOKENS = 1 << 19
CHUNK = 1024  # blocks that one window of the prefix scan holds


def write_flat(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Whole texts as flat token files, one per task, in the order of reading.

    ``flat`` has the blocks (16-bit ids if the vocabulary allows, else 32-bit), ``names``
    the doc_ids in the order of the documents of each file, without any length or place.
    A null text is an empty document: its end alone.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = df.schema[doc_id].dataType

    def encode(rows: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encoder = WordEncoder.at(tokenizer, literal=True)
        size = "<u2" if max(end + 1, encoder.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
        file_no, block, held, length, names, first = TaskContext.get().partitionId(), 0, [], 0, [], 0
        last = np.array([end], size)

        def out(ids):
            nonlocal block, names, first
            row = {"file_no": [file_no], "block_no": [block], "payload": [ids.tobytes()], "first": [first], "names": [names]}
            block, first, names = block + 1, first + len(names), []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

        types = None
        for batch in rows:
            types = types or [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(batch.schema.field(0).type)]
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for name, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    names.append(name)
                    ids = np.append(np.frombuffer(ids, "<u4").astype(size), last)
                    held.append(ids)
                    length += len(ids)
                if length >= block_tokens:
                    flat = np.concatenate(held)
                    for lo in range(0, len(flat) - block_tokens + 1, block_tokens):
                        yield out(flat[lo : lo + block_tokens])
                    held = [flat[len(flat) // block_tokens * block_tokens :]]
                    length = len(held[0])
        if length:
            yield out(np.concatenate(held))

    schema = f"file_no int, block_no long, payload binary, first long, names array<{kind.simpleString()}>"
    df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)


def block_ends(flat: DataFrame, end: int = END, bits: int = 16) -> DataFrame:
    """Per block: how many ids it has, and where the ends stand."""
    size = f"<u{bits // 8}"

    def scan(rows: Iterator[pa.RecordBatch]):
        for batch in rows:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([np.flatnonzero(ids == end)], pa.list_(pa.int64()))],
                    ["file_no", "block_no", "n", "ends"],
                )

    return flat.select("file_no", "block_no", "payload").mapInArrow(scan, "file_no int, block_no long, n long, ends array<long>")


def stitched(blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Blocks with what the blocks before them in their file sum to: before (ids), documents
    (ends), last_end (ids up to and with the last end).

    A prefix scan in two levels: inside chunks of blocks, over the chunks, and both added.
    """
    blocks = blocks.withColumn("chunk", F.floor(F.col("block_no") / chunk)).withColumn("ended", F.size("ends").cast("long"))
    inside = Window.partitionBy("file_no", "chunk").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    after_end = F.when(F.col("ended") > 0, F.col("in_before") + F.element_at("ends", -1) + 1)
    rows = settle(
        blocks.withColumn("in_before", F.coalesce(F.sum("n").over(inside), zero))
        .withColumn("in_documents", F.coalesce(F.sum("ended").over(inside), zero))
        .withColumn("in_after", after_end)
        .withColumn("in_last", F.max("in_after").over(inside)),
        "scanned",
    )
    across = Window.partitionBy("file_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        rows.groupBy("file_no", "chunk")
        .agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"), F.max("in_after").alias("after"))
        .withColumn("c_before", F.coalesce(F.sum("n").over(across), zero))
        .withColumn("c_documents", F.coalesce(F.sum("ended").over(across), zero))
        .withColumn("c_last", F.coalesce(F.max(F.col("after") + F.col("c_before")).over(across), zero))
        .select("file_no", "chunk", "c_before", "c_documents", "c_last")
    )
    return rows.join(chunks, ["file_no", "chunk"]).select(
        "file_no",
        "block_no",
        "n",
        "ends",
        (F.col("c_before") + F.col("in_before")).alias("before"),
        (F.col("c_documents") + F.col("in_documents")).alias("documents"),
        F.coalesce(F.col("c_before") + F.col("in_last"), F.col("c_last")).alias("last_end"),
    )


def count_tokens(flat: DataFrame, end: int = END, bits: int = 16, chunk: int = CHUNK) -> DataFrame:
    """Per document of the files: file_no, ordinal, start, n_tokens (with its end).

    Ids after the last end of a file belong to no finished document and are not reported;
    files and blocks without ids have none.
    """
    blocks = stitched(settle(block_ends(flat, end, bits), "ends"), chunk)
    ends = blocks.select("file_no", "before", "documents", "last_end", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("last_end")).otherwise(F.col("before") + F.element_at("ends", F.greatest("i", F.lit(1))) + 1)
    return ends.select(
        "file_no", (F.col("documents") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("before") + F.col("end") + 1 - start).alias("n_tokens")
    )


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write flat files of the documents, scan them, and name what was found: doc_id, file_no, ordinal, start, n_tokens.

    Equal doc_ids are documents of their own; a null doc_id is kept as null.
    """
    write_flat(df, path, doc_id, text, tokenizer)
    stored = df.sparkSession.read.parquet(path)
    names = stored.select("file_no", "first", F.posexplode("names").alias("i", doc_id)).select("file_no", (F.col("first") + F.col("i")).alias("ordinal"), doc_id)
    return count_tokens(stored).join(names, ["file_no", "ordinal"]).select(doc_id, "file_no", "ordinal", "start", "n_tokens")
