"""Look-ups, upserts and work queues on the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.functions.text import strip


def explained_interventions(interventions: DataFrame, explanations: DataFrame) -> DataFrame:
    """Interventions with an explanation, newest first within the whole result."""
    has = explanations.select(F.col("intervention_id").alias("id"))
    return interventions.join(has, "id", "left_semi").orderBy(F.col("created_at").desc(), "id")


def explanation_lookup(requests: DataFrame, explanations: DataFrame) -> DataFrame:
    """Requests (intervention_id, output_mode) with the stored text, NULL where there is none.

    Of several stored texts the first (lowest id) is used.
    """
    first = explanations.groupBy("intervention_id", "output_mode").agg(
        F.min_by("text_explanation", "id").alias("text_explanation")
    )
    return requests.join(first, ["intervention_id", "output_mode"], "left")


def explanation_queue(requests: DataFrame, explanations: DataFrame) -> DataFrame:
    """Distinct requests without a stored explanation."""
    keys = ["intervention_id", "output_mode"]
    return requests.dropDuplicates(keys).join(explanations.select(*keys), keys, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def video_status(asked: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """Asked ids with title and duration from the table, else from the file, and two flags.

    ``files`` has one row per folder; its metadata columns may be NULL.
    """
    cols = ["title", "duration_seconds"]
    s = stored.select("video_id", F.struct(*cols).alias("_s"))
    f = files.select("video_id", F.struct(*cols).alias("_f"))
    both = asked.join(s, "video_id", "left").join(f, "video_id", "left")
    chosen = F.when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("_f"))
    return both.select(
        *asked.columns,
        *[chosen[c].alias(c) for c in cols],
        (F.col("_s").isNotNull() | F.col("_f").isNotNull()).alias("exists"),
        F.col("_s").isNotNull().alias("processed"),
    )


def short_id_join(interventions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Interventions with artifacts stored under the first 8 characters of their id."""
    return interventions.withColumn("id8", F.substring("id", 1, 8)).join(artifacts, ["video_id", "id8"])


def upsert_latest(stored: DataFrame, changes: DataFrame, key: str | list[str] = "id", at: str = "saved_at",
                  tie: str | None = None) -> DataFrame:
    """The latest row per key of both tables. Sort by ``at`` descending to list newest first."""
    keys = [key] if isinstance(key, str) else key
    rows = stored.unionByName(changes, allowMissingColumns=True)
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    newest = F.max_by(rest, F.struct(at, *([tie] if tie else [])))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def remove_by_id(stored: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(removed.select(key), key, "left_anti")


def is_saved(rows: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a membership flag."""
    marks = saved.select(key).distinct().withColumn("_saved", F.lit(True))
    return rows.join(marks, key, "left").withColumn("is_saved", F.col("_saved").isNotNull()).drop("_saved")


def set_bookmark(interventions: DataFrame, changes: DataFrame, at: str = "changed_at") -> DataFrame:
    """Interventions with is_bookmarked set by the last change of each id."""
    last = changes.groupBy("id").agg(F.max_by("bookmarked", at).alias("_new"))
    return (
        interventions.join(last, "id", "left")
        .withColumn("is_bookmarked", F.coalesce("_new", "is_bookmarked"))
        .drop("_new")
    )


def library_search(items: DataFrame, query: str, columns: tuple[str, ...] = ("title", "video_title", "category")) -> DataFrame:
    """Items with the trimmed, lower-cased query in one of the columns; all for an empty query."""
    q = query.lower().strip()
    if not q:
        return items
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return items.where(hit)


def add_knowledge(knowledge: DataFrame, added: DataFrame, at: str = "ord") -> DataFrame:
    """Knowledge (concept, domain, explanation, ord) with rows added or replaced, keys normalised.

    Rows with a blank part are rejected; the highest ``ord`` per key wins.
    """
    blank = F.lit(False)
    for c in ("concept", "domain", "explanation"):
        blank = blank | (F.coalesce(c, F.lit("")) == "")
    clean = added.where(~blank)
    for c in ("concept", "domain"):
        clean = clean.withColumn(c, strip(F.lower(c)))
    return upsert_latest(knowledge, clean, ["concept", "domain"], at)


def concepts_in_domain(knowledge: DataFrame, domain: str) -> DataFrame:
    return knowledge.where(F.col("domain") == domain.lower().strip()).select("concept").distinct()


def segments_with_interventions(segments: DataFrame, snapshots: DataFrame, limit: float = 30.0, **kw) -> DataFrame:
    """Every segment, flagged and filled where a snapshot lies within ``limit`` of its start.

    ``snapshots`` is (video_id, t, ord, snapshot_id); of those at one time the last by
    ``ord`` counts.
    """
    from avsync.operators.timejoin import nearest_snapshot

    last = snapshots.groupBy("video_id", "t").agg(
        F.max("ord").alias("ord"), F.max_by("snapshot_id", "ord").alias("snapshot_id")
    )
    near = nearest_snapshot(segments.withColumn("t", F.col("start")), last, limit, **kw)
    return near.withColumn("is_intervention", F.col("snapshot_id").isNotNull()).drop("t", "distance")


def newest_first(rows: DataFrame, at: str = "created_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.col(at).desc(), tie)


def interventions_of_video(interventions: DataFrame, video_id) -> DataFrame:
    return interventions.where(F.col("video_id") == video_id).orderBy("t")
