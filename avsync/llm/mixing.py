"""Operator 4: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.llm.common import WORD, free_name, numbered
from avsync.session import settle

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3


def _unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, the same in every engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source: source_size, target (columns source, size in).

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes; a
    target stops at ``most`` times its source's size and the excess goes to the others by
    weight until none is above. That level is found by a few sums over the source table;
    sources may be many, nothing but two numbers comes to the driver at a time.
    """
    per_source = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = numbered(per_source, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    state = settle(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weighed")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    full_at = F.col("cap") / F.col("weight")  # the level at which a source is full
    level, full = -1.0, -1
    while True:
        is_full = full_at <= level
        row = state.agg(
            F.sum(F.when(is_full, F.col("cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(is_full, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, taken, opened = row["full"], row["taken"] or 0, row["open"]
        level = (total - taken) / opened
    shared = F.col("weight") * F.lit(float(total - taken if full >= 0 else 0)) / F.lit(float(opened if full >= 0 else 1))
    target = F.when(full_at <= level, F.col("cap").cast("double")).otherwise(shared)
    return state.select("source", "source_size", target.alias("target"))


def mix_plan(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 17,
    row: str | None = None,
) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies, taken.

    With ``row``, a column that tells rows apart, the plan has that column first.

    A source's rate is target / size; each document comes floor(rate) times, plus one copy
    with probability equal to the fraction. The draws of a source are one hash-seeded start
    and equal steps along its documents in order of size (systematic sampling): each
    document's chance is the fraction, and documents of like size take turns, so the words
    taken stay within about one document of the target. Independent draws would miss it by
    tens of per cent where a few long documents hold most words.

    A null text has size 0; a null source is a source of its own, last in order. Documents
    of size 0 are drawn like others and take no words. Rows with equal doc_id are told
    apart by a row number only while drawing. An empty table gives an empty plan.
    """
    keys = [] if row is None else [F.col(row).alias("row")]
    sizes = settle(
        df.select(
            *keys,
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    by_source = settle(targets(sizes, weights, most), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), *([] if row is None else ["row"])]
    rows = numbered(sizes, *order, name="at")
    first = rows.groupBy("source").agg(F.min("at").alias("first"))
    info = first.join(by_source, first["source"].eqNullSafe(by_source["source"])).select(
        first["source"].alias("source_"), "first", "source_size", "target"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = F.col("rate") - F.floor("rate")
    start = _unit(F.coalesce("source", F.lit("")), seed)
    at = F.col("at") - F.col("first")
    extra = F.floor((at + 1) * F.col("fraction") + F.col("start")) - F.floor(at * F.col("fraction") + F.col("start"))
    return (
        rows.join(info, rows["source"].eqNullSafe(info["source_"]))
        .withColumn("rate", rate)
        .withColumn("fraction", fraction)
        .withColumn("start", start)
        .withColumn("copies", (F.floor("rate") + extra).cast("long"))
        .select(*([] if row is None else [F.col("row").alias(row)]), "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **plan) -> DataFrame:
    """The documents themselves, each row as often as ``mix_plan`` says. Rows are told apart by
    a number that is written with them, so ids may repeat or be null."""
    row = free_name(df, "_row")
    rows = settle(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = mix_plan(rows, text, source, doc_id, row=row, **plan).filter("copies > 0")
    copies = copies.select(F.col(row).alias(free_name(df, "_doc")), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(free_name(df, "_copies")))
    taken = rows.join(copies, rows[row] == copies[copies.columns[0]])
    return taken.select(*[rows[c] for c in df.columns], F.explode(copies[copies.columns[1]]).alias(free_name(df, "_copy"))).select(*df.columns)


#: the same plan as SQL text: the level by running sums over sources in order of cap / weight
SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], 1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)) AS weight,
         source_size * {MOST_REPEATS} AS cap
  FROM per_source
), level AS (
  SELECT *, cap / weight AS full_at, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (
  SELECT min(cap_before) AS taken, max(all_weight - weight_before) AS opened, any_value(total) AS total
  FROM level WHERE full_at > (total - cap_before) / (all_weight - weight_before)
), targets AS (
  SELECT source, source_size,
         CASE WHEN full_at <= (best.total - taken) / opened THEN cap::DOUBLE
              ELSE weight * (best.total - taken)::DOUBLE / opened::DOUBLE END AS target
  FROM level, best
), drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS i,
         ('0x' || substr(md5('17:' || coalesce(s.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate) + floor((i + 1) * (rate - floor(rate)) + start) - floor(i * (rate - floor(rate)) + start))::BIGINT AS copies,
       (floor(rate) + floor((i + 1) * (rate - floor(rate)) + start) - floor(i * (rate - floor(rate)) + start))::BIGINT * size AS taken
FROM drawn
"""
