"""Scans over cut keys equal the plain window."""

import math
import random

from pyspark.sql import functions as F

from avsync.operators import ordered
from avsync.operators.ordered import find_cuts


def jobs_of(spark, name, build):
    spark.sparkContext.setJobGroup(name, name)
    made = build()
    spark.sparkContext.setJobGroup("", "")
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_cut_scans_equal_plain_scans(spark):
    rng = random.Random(1)
    rows = []
    for v, n in (("hot", 400), ("warm", 60), ("one", 1)):
        for i in range(n):
            rows.append((v, float(rng.randint(0, 30)), i, rng.choice([None, rng.randint(0, 99)])))
    df = spark.createDataFrame(rows, "video_id string, t double, ord int, x int")
    scans = dict(
        a=ordered.lag(F.col("x")),
        b=ordered.lead(F.col("x")),
        c=ordered.row_number(),
        d=ordered.running_sum(F.col("x")),
        e=ordered.last_known(F.col("x")),
        f=ordered.next_known(F.col("x")),
        g=ordered.next_min(F.col("x")),
        h=ordered.max_so_far(F.col("x")),
    )
    plain = ordered.scan(df, find_cuts(df, ["video_id"], ["t", "ord"], max_rows=math.inf), **scans)
    (cuts, cut), jobs = jobs_of(spark, "cut", lambda: (lambda c: (c, ordered.scan(df, c, **scans)))(find_cuts(df, ["video_id"], ["t", "ord"], max_rows=40)))
    assert cuts.any and jobs == 0
    assert not find_cuts(df, ["video_id"], ["t", "ord"], max_rows=1000).looked().any
    chunks = cuts.chunked(df).groupBy("video_id", ordered.CHUNK).count().collect()
    assert sum(r.video_id == "hot" for r in chunks) > 6 and max(r["count"] for r in chunks if r.video_id == "hot") < 150
    assert sorted(plain.columns) == sorted(cut.columns)
    cols = plain.columns
    short = ordered.scan(df, find_cuts(df, ["video_id"], ["t", "ord"], max_rows=1000), **scans)  # no key is long
    assert sorted(map(str, short.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, plain.select(cols).collect()), key=key) == sorted(
        map(tuple, cut.select(cols).collect()), key=key
    )


def test_cuts_keep_their_distance(spark):
    df = spark.range(1000).selectExpr("'v' AS video_id", "id / 10.0D AS t", "id AS ord")
    wide = find_cuts(df, ["video_id"], ["t"], max_rows=10, min_width=7.5).table.collect()[0]["_cuts"]
    assert len(wide) > 8 and all(b - a >= 7.5 for a, b in zip(wide, wide[1:], strict=False))
    close = find_cuts(df, ["video_id"], ["t"], max_rows=100).table.collect()[0]["_cuts"]
    assert len(close) == 19
