"""Ordered scans (lag, lead, running values) that split an over-long key.

A window partitioned by ``video_id`` puts a whole video into one task. When a key
holds more than ``max_rows`` rows it is cut, in order, into chunks of about half
that size; windows then run per (key, chunk) and a table with one row per chunk
carries the missing value across the cuts. Results equal the plain window's.

Cuts come from a quantile sketch per key, in one aggregate with the keys' counts. They
are a DataFrame that is joined, so building a scan runs no job and brings nothing to the
driver; where no key is long the joins are with empty tables, which Spark drops at run time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avsync.session import settle

MAX_ROWS = 1_000_000
POINTS = 1023  # quantiles in a sketch: a key is cut into 1,024 chunks at most
ACCURACY = 20_000  # a chunk's share of its key is right to 1 in so many
CHUNK = "_chunk"


@dataclass(frozen=True)
class Cuts:
    """Cut points inside long keys.

    ``table`` has (keys, _cuts) for long keys only, sorted values of the first order column;
    it is None when no key can be long.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    table: DataFrame | None = None

    @property
    def any(self) -> bool:
        return self.table is not None

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.any else list(self.keys)

    def looked(self) -> Cuts:
        """With the table written, or without one if no key is long; for steps whose plans differ by that."""
        if not self.any:
            return self
        table = settle(self.table, "cuts")
        return replace(self, table=None if table.isEmpty() else table)

    def chunked(self, df: DataFrame) -> DataFrame:
        """Add the chunk number of each row (no column when nothing is cut)."""
        if not self.any:
            return df
        rows = df.join(self.table, list(self.keys), "left").withColumn("_long", F.col("_cuts").isNotNull())
        return rows.withColumn(CHUNK, F.when(F.col("_long"), self._number()).otherwise(F.lit(0))).drop("_cuts")

    def of_long_keys(self, df: DataFrame) -> DataFrame:
        """The rows of long keys with their chunk numbers."""
        return df.join(self.table, list(self.keys)).withColumn(CHUNK, self._number()).drop("_cuts")

    def _number(self) -> Column:
        return _at_or_below(F.col("_cuts"), F.col(self.order[0]), POINTS)


def _at_or_below(cuts: Column, here: Column, longest: int) -> Column:
    """How many of the sorted cuts are at or below a place, by halving."""
    steps = [2**k for k in range(max(longest, 1).bit_length() - 1, -1, -1)]

    def step(pos: Column, s: Column) -> Column:
        on = (pos + s <= F.size(cuts)) & (F.get(cuts, pos + s - 1) <= here)
        return F.when(on, pos + s).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def row_limit(*tables: DataFrame, keys: list[str] | None = None, max_rows: float | None = None) -> float:
    """``max_rows``, or infinity if no key has more rows than that in all tables together.

    One count over the key columns. Infinity tells later steps on parts of these rows
    that no key is long, so they need not look again.
    """
    max_rows = max_rows or MAX_ROWS
    if max_rows == math.inf:
        return max_rows
    keys = keys or ["video_id"]
    rows = tables[0].select(*keys)
    for other in tables[1:]:
        rows = rows.unionAll(other.select(*keys))
    over = rows.groupBy(*keys).count().where(F.col("count") > max_rows)
    return math.inf if over.isEmpty() else max_rows


def find_cuts(
    df: DataFrame, keys: list[str], order: list[str], max_rows: float | None = None, min_width: float = 0.0
) -> Cuts:
    """Cut points in keys of more than ``max_rows`` rows, as a plan; no job runs.

    ``order`` columns are ascending and not NULL, the first one a number or time. Rows that
    are equal in it stay in one chunk. ``min_width`` keeps that distance between cuts.
    """
    max_rows = max_rows or MAX_ROWS
    if max_rows == math.inf:
        return Cuts(tuple(keys), tuple(order))
    sketch = F.percentile_approx(order[0], [i / (POINTS + 1) for i in range(1, POINTS + 1)], ACCURACY)
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_points")).where(F.col("_n") > max_rows)
    wanted = F.least(F.lit(POINTS), F.ceil(2 * F.col("_n") / max_rows).cast("int") - 1)
    places = F.transform(F.sequence(F.lit(1), wanted), lambda i: F.get("_points", F.floor(i * (POINTS + 1) / (wanted + 1)).cast("int") - 1))
    picked = F.array_distinct(places)
    if min_width:
        apart = lambda kept, x: F.when((F.size(kept) > 0) & (x - F.element_at(kept, -1) < min_width), kept).otherwise(F.concat(kept, F.array(x)))
        picked = F.aggregate(picked, F.slice("_points", 1, 0), apart)
    return Cuts(tuple(keys), tuple(order), seen.select(*keys, picked.alias("_cuts")))


@dataclass(frozen=True)
class Scan:
    """One running value. ``value`` is an expression over the input columns."""

    kind: str  # lag, lead, row_number, sum, last, next, max, next_min
    value: Column | None = None


def lag(value: Column) -> Scan:
    return Scan("lag", value)


def lead(value: Column) -> Scan:
    return Scan("lead", value)


def row_number() -> Scan:
    """1-based position."""
    return Scan("row_number")


def running_sum(value: Column) -> Scan:
    """Sum up to and including the row."""
    return Scan("sum", value)


def last_known(value: Column) -> Scan:
    """Latest non-NULL value up to and including the row."""
    return Scan("last", value)


def next_known(value: Column) -> Scan:
    """Earliest non-NULL value from the row on."""
    return Scan("next", value)


def max_so_far(value: Column) -> Scan:
    """Largest non-NULL value up to the row and rows of equal order."""
    return Scan("max", value)


def next_min(value: Column) -> Scan:
    """Smallest non-NULL value from the row and rows of equal order on."""
    return Scan("next_min", value)


def scan(df: DataFrame, cuts: Cuts, **scans: Scan) -> DataFrame:
    """Add one column per scan, in the order and keys of ``cuts``."""
    up = Window.partitionBy(*cuts.group).orderBy(*cuts.order)
    down = Window.partitionBy(*cuts.group).orderBy(*[F.col(c).desc() for c in cuts.order])
    so_far = (Window.unboundedPreceding, Window.currentRow)
    rows = cuts.chunked(df)
    # values go into a struct, so "no row" (NULL) differs from "row with a NULL value"
    boxed = {n: F.struct(s.value.alias("v")) for n, s in scans.items() if s.kind in ("lag", "lead")}
    for name, s in scans.items():
        local = {
            "lag": lambda: F.lag(boxed[name]).over(up),
            "lead": lambda: F.lead(boxed[name]).over(up),
            "row_number": lambda: F.row_number().over(up).cast("long"),
            "sum": lambda: F.sum(s.value).over(up.rowsBetween(*so_far)),
            "last": lambda: F.last(s.value, ignorenulls=True).over(up.rowsBetween(*so_far)),
            "next": lambda: F.last(s.value, ignorenulls=True).over(down.rowsBetween(*so_far)),
            "max": lambda: F.max(s.value).over(up.rangeBetween(*so_far)),
            "next_min": lambda: F.min(s.value).over(down.rangeBetween(*so_far)),
        }[s.kind]()
        rows = rows.withColumn(name, local)
    if not cuts.any:
        return rows.withColumns({n: F.col(n)["v"] for n in boxed})

    carried = _carry(cuts, cuts.of_long_keys(df), scans, boxed)
    rows = rows.join(carried, cuts.group, "left")
    out = {}
    for name, s in scans.items():
        carry = F.col(f"_c_{name}")
        out[name] = {
            "lag": F.coalesce(F.col(name), carry)["v"] if s.kind in ("lag", "lead") else None,
            "row_number": F.col(name) + F.coalesce(carry, F.lit(0)) if s.kind == "row_number" else None,
            "sum": F.when(F.col(name).isNull(), carry).otherwise(F.col(name) + F.coalesce(carry, F.lit(0)))
            if s.kind == "sum"
            else None,
            "last": F.coalesce(F.col(name), carry) if s.kind in ("last", "next") else None,
            "max": F.greatest(F.col(name), carry) if s.kind == "max" else None,
            "next_min": F.least(F.col(name), carry) if s.kind == "next_min" else None,
        }[{"lead": "lag", "next": "last"}.get(s.kind, s.kind)]
    return rows.withColumns(out).drop(CHUNK, "_long", *[f"_c_{n}" for n in scans])


def _carry(cuts: Cuts, rows: DataFrame, scans: dict[str, Scan], boxed: dict[str, Column]) -> DataFrame:
    """One row per (long key, chunk) with what its rows miss from other chunks."""
    here = F.struct(*cuts.order)
    summary, between = [], {}
    before = Window.partitionBy(*cuts.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*cuts.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    for name, s in scans.items():
        known = None if s.value is None else F.when(s.value.isNotNull(), here)
        part = {
            "lag": lambda: F.max_by(boxed[name], here),
            "lead": lambda: F.min_by(boxed[name], here),
            "row_number": lambda: F.count(F.lit(1)),
            "sum": lambda: F.sum(s.value),
            "last": lambda: F.max_by(s.value, known),
            "next": lambda: F.min_by(s.value, known),
            "max": lambda: F.max(s.value),
            "next_min": lambda: F.min(s.value),
        }[s.kind]()
        summary.append(part.alias(f"_s_{name}"))
        col = F.col(f"_s_{name}")
        between[f"_c_{name}"] = {
            "lag": lambda: F.last(col, ignorenulls=True).over(before),
            "lead": lambda: F.last(col, ignorenulls=True).over(after),
            "row_number": lambda: F.sum(col).over(before),
            "sum": lambda: F.sum(col).over(before),
            "last": lambda: F.last(col, ignorenulls=True).over(before),
            "next": lambda: F.last(col, ignorenulls=True).over(after),
            "max": lambda: F.max(col).over(before),
            "next_min": lambda: F.min(col).over(after),
        }[s.kind]()
    return rows.groupBy(*cuts.group).agg(*summary).withColumns(between).select(*cuts.group, *between)
