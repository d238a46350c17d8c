"""Operator 10: balanced label propagation of linked documents over shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avsync.llm.common import numbered, pick, text_or_empty
from avsync.session import settle

BINS = 1024


def balanced_shards(
    nodes: DataFrame,
    links: DataFrame,
    shards: int = 16,
    rounds: int = 6,
    slack: float = 0.1,
) -> DataFrame:
    """Shards of equal row counts that keep linked rows together: node, shard, slot.

    ``nodes`` has the distinct column node, ``links`` has (node, link): rows that name one
    link are neighbours of each other. Links of a group are never spelled out as pairs;
    what a node sees of its neighbours is the link's count of rows by shard.

    Rows start dealt evenly. In each round every linked row looks for the shard with most
    of its neighbours among those with room, and moves there if it has more of them than
    its own. Even rounds move upwards and odd rounds downwards only, so that two rows do
    not swap for ever. A shard's room is (1 + slack) of the mean; the movers with most to
    gain go first, by a histogram of gains and hashes (a bounded number of bins comes to
    the driver). At the end rows with fewest neighbours leave the shards that are over
    their share: sizes then differ by one at most, whatever the links are.

    A group larger than a shard fills some shards and splits. Links of one row are no
    links. Null nodes or links are not allowed in ``links``; leave them out. Empty tables
    give no rows.
    """
    start = numbered(nodes.select("node"), F.xxhash64("node"), F.col("node"), name="at").select("node", (F.col("at") % shards).cast("int").alias("shard"))
    labels = settle(start, "labels")
    total = labels.count()
    ceiling = -(-total // shards)
    most = int(ceiling * (1 + slack)) + 1
    # sums by link are written before they are joined: a join of plain tables splits a hot link
    several = settle(links.groupBy("link").agg(F.count("*").alias("n")).filter("n > 1").select("link"), "several")
    links = settle(links.select("node", "link").join(several, "link"), "links")
    for r in range(rounds if total else 0):
        at = links.join(labels, "node")
        counts = settle(at.groupBy("link").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"n{s}") for s in range(shards)]), "counts")
        seen = at.join(counts, "link").groupBy("node", "shard").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)], F.count("*").alias("own"))
        filled = {x["shard"]: x["count"] for x in labels.groupBy("shard").count().collect()}
        room = [max(0, most - filled.get(s, 0)) for s in range(shards)]
        here = F.array(*[F.col(f"n{s}") for s in range(shards)])
        stay = F.element_at(here, F.col("shard") + 1) - F.col("own")  # not counting itself
        may = [
            F.struct(F.col(f"n{s}").alias("votes"), F.lit(s if r % 2 == 0 else -s).alias("tie"), F.lit(s).alias("to"))
            for s in range(shards)
            if room[s]
        ]
        if not may:
            continue
        onward = F.filter(F.array(*may), lambda x: x["to"] > F.col("shard") if r % 2 == 0 else x["to"] < F.col("shard"))
        wish = seen.select("node", "shard", stay.alias("stay"), F.array_max(onward).alias("best")).filter("best.votes > stay or (best.votes = stay and stay > 0)")
        # gains by powers of two, the largest first; rows of one class by hash
        grade = 63 - F.floor(F.log2(F.col("best.votes") - F.col("stay") + 1)).cast("int")
        wish = settle(
            wish.select("node", F.col("best.to").alias("to"), (grade * BINS + F.pmod(F.xxhash64("node"), F.lit(BINS)).cast("int")).alias("bin")), "wishes"
        )
        cuts = [-1] * shards
        left = list(room)
        closed = [False] * shards
        for x in wish.groupBy("to", "bin").count().orderBy("to", "bin").collect():
            t = x["to"]
            if not closed[t] and x["count"] <= left[t]:
                left[t] -= x["count"]
                cuts[t] = x["bin"]
            else:
                closed[t] = True
        moved = wish.filter(F.col("bin") <= pick(cuts, F.col("to"))).select("node", "to")
        labels = settle(
            labels.join(moved, "node", "left").select("node", F.coalesce("to", "shard").cast("int").alias("shard")), "labels"
        )
    return _evened(labels, links, shards, total)


def _evened(labels: DataFrame, links: DataFrame, shards: int, total: int) -> DataFrame:
    """Exact quotas: each shard's surplus, least linked rows first, fills the others' gaps."""
    at = links.join(labels, "node")
    near = settle(at.groupBy("link", "shard").agg(F.count("*").alias("n")), "near")
    kept = at.join(near, ["link", "shard"]).groupBy("node").agg(F.sum(F.col("n") - 1).alias("near"))
    ranked = labels.join(kept, "node", "left").select("node", "shard", F.coalesce("near", F.lit(0)).alias("near"))
    rows = numbered(settle(ranked, "ranked"), F.col("shard"), F.col("near").desc(), F.col("node"), name="at")
    filled = {x["shard"]: x["count"] for x in labels.groupBy("shard").count().collect()}
    held = [filled.get(s, 0) for s in range(shards)]
    # the shards with most rows get the larger quotas, so that fewest rows move
    larger = set(sorted(range(shards), key=lambda s: (-held[s], s))[: total % shards])
    quota = [total // shards + (s in larger) for s in range(shards)]
    first = [sum(held[:s]) for s in range(shards)]
    over = [max(0, held[s] - quota[s]) for s in range(shards)]
    over_first = [sum(over[:s]) for s in range(shards)]
    gaps, gap_first, done = [], [], 0
    for s in range(shards):
        gap_first.append(done)
        gaps.append(max(0, quota[s] - held[s]))
        done += gaps[s]
    index = F.col("at") - pick(first, F.col("shard"))
    surplus = index >= pick(quota, F.col("shard"))
    number = pick(over_first, F.col("shard")) + index - pick(quota, F.col("shard"))  # among all surplus rows
    to = F.lit(0)
    for s in range(shards):
        to = F.when((F.col("number") >= gap_first[s]) & (F.col("number") < gap_first[s] + gaps[s]), s).otherwise(to)
    return (
        rows.withColumn("slot", index)
        .withColumn("number", F.when(surplus, number))
        .withColumn("to", to.cast("int"))
        .select(
            "node",
            F.when(surplus, F.col("to")).otherwise(F.col("shard")).alias("shard"),
            F.when(surplus, pick(held, F.col("to")) + F.col("number") - pick(gap_first, F.col("to"))).otherwise(F.col("slot")).cast("long").alias("slot"),
        )
    )


def shard_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Documents dealt to shards of equal row counts, equal texts together where they fit.

    Returns doc_id, size (UTF-8 bytes plus one), text_crc32, law ('rows'), shard, slot,
    grown_shard (null under this law). A null text has no bytes and is linked with the
    empty ones; rows of equal doc_id are rows like others. Other columns are not read.
    """
    rows = settle(
        df.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"),
            F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(text_or_empty(text), 256), 1, 32)).alias("link"),
            F.monotonically_increasing_id().alias("node"),
        ),
        "rows",
    )
    placed = balanced_shards(rows.select("node"), rows.select("node", "link"), shards)
    return rows.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
