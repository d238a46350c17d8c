"""Operator 3: exact duplicates by two passes over a Bloom filter. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.llm.common import text_or_empty
from avsync.session import settle

BLOCK_BITS = 32_768  # bits of one bitmap of bitmap_construct_agg
PROBES = 3


def _probe(digest: Column, k: int) -> Column:
    """The k-th bit position of a row inside its block, from 15 bits of the digest."""
    return F.conv(F.substring(digest, 17 + 4 * k, 4), 16, 10).cast("int") % BLOCK_BITS


def _block(digest: Column, blocks: int) -> Column:
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % blocks).cast("int")


def _bit_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position % 8) == 1


def exact_dedup(
    df: DataFrame,
    text: str = "text",
    order: str = "doc_id",
    bits_per_row: int = 32,
    most_bits: int = 1 << 28,
) -> DataFrame:
    """Which row of each set of equal texts stays: the one with the largest ``order``.

    Pass 1 counts how many rows hit each bit of a blocked Bloom filter (all bits of a row
    lie in one block) and keeps the bits hit at least twice. Pass 2 asks every row: only
    rows all of whose bits are kept may have a twin, and only they are shuffled by their
    digest; the rest pass straight through with a group of one. A wrong "maybe" costs a
    shuffled row, never a wrong answer.

    The filter has ``bits_per_row`` bits a row, ``most_bits`` at most (32 MB): that is the
    size bound of the one broadcast. Beyond it the share of wrong maybes rises.

    Returns ``order``, keep_id, group_size, kept, text_sha256. A null text counts as empty.
    Empty texts equal each other. Equal rows with equal ``order`` are rows like others:
    exactly one of them is kept. A null ``order`` is smaller than any other. An empty table
    gives none. Further columns are not read.
    """
    spark = df.sparkSession
    rows = settle(
        df.select(
            F.col(order).alias("order_key"),
            F.sha2(text_or_empty(text), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row_key"),
        ),
        "digests",
    )
    total = rows.count()
    blocks = max(1, min(most_bits, bits_per_row * total) // BLOCK_BITS)
    digest = F.col("digest")
    probed = rows.withColumn("block", _block(digest, blocks))
    hits = probed.select("block", F.explode(F.array_distinct(F.array(*[_probe(digest, k) for k in range(PROBES)]))).alias("bit"))
    repeated = (
        hits.groupBy("block", "bit")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy("block")
        .agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"))
    )
    asked = probed.join(F.broadcast(repeated), "block", "left")  # at most most_bits / 8 bytes
    maybe = F.lit(True)
    for k in range(PROBES):
        maybe = maybe & _bit_set(F.col("bitmap"), _probe(digest, k))
    asked = settle(asked.select("order_key", "digest", "row_key", F.coalesce(maybe, F.lit(False)).alias("maybe")), "asked")
    suspects = asked.filter("maybe").drop("maybe")
    # written, so that the join below is one of two plain tables, whose hot keys Spark splits
    groups = settle(
        suspects.groupBy("digest").agg(F.max(F.struct("order_key", "row_key")).alias("best"), F.count("*").alias("group_size")), "groups"
    )
    out = lambda d, keep, size, kept: d.select(
        F.col("order_key").alias(order), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256")
    )
    found = out(
        suspects.join(groups, "digest"),
        F.col("best.order_key"),
        F.col("group_size"),
        F.col("best.row_key") == F.col("row_key"),
    )
    alone = out(asked.filter("not maybe"), F.col("order_key"), F.lit(1).cast("long"), F.lit(True))
    return alone.unionByName(found)


def unique_rows(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The whole rows that stay. ``order`` must tell rows apart here."""
    kept = exact_dedup(df, text, order).filter("kept").select(order)
    return df.join(kept, order, "left_semi")
