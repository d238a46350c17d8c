"""The four stored tables and guarded inserts into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avsync import schemas


def create_tables(spark: SparkSession, database: str = "default", buckets: int = 0, location: str | None = None) -> list[str]:
    """Create the tables that are absent as Parquet; with ``buckets``, bucketed by their join key."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for name, columns in schemas.TABLES.items():
        full = f"{database}.{name}"
        made.append(full)
        if spark.catalog.tableExists(full):
            continue
        cols = ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in columns.split(", "))
        key = schemas.TABLE_KEYS[name]
        by = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if buckets else ""
        at = f"LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE {full} ({cols}) USING PARQUET {by} {at}")
    return made


def append_rows(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Append by column name; columns that are missing stay NULL."""
    wanted = spark.table(table).schema
    have = set(rows.columns)
    rows.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    ).write.insertInto(table)


def count_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    from avsync.operators.aggregates import table_counts

    return table_counts({n: spark.table(f"{database}.{n}") for n in schemas.TABLES})


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose key is not stored, one row per key."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def insert_if_absent(
    videos: DataFrame,
    segments: DataFrame,
    interventions: DataFrame,
    read,
    append,
) -> None:
    """Insert the videos that are not stored yet, with their segments and interventions.

    ``read(name)`` gives a stored table and ``append(name, rows)`` adds to it. The video
    rows go in last: a run that stops half way is seen as not done, and its rows are
    left out when it is repeated.
    """
    fresh = new_rows(videos, read("videos")).select("id").distinct()
    for name, rows in (("transcripts", segments), ("interventions", interventions)):
        keys = fresh.select(F.col("id").alias("video_id"))
        done = read(name).select("video_id").distinct()
        append(name, rows.join(keys, "video_id", "left_semi").join(done, "video_id", "left_anti"))
    append("videos", new_rows(videos, read("videos")))
