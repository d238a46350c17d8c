"""Streams give the batch result, over one or several micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from avsync.operators import folds
from avsync.session import new_dir
from avsync.streaming import state


def test_suppress_close_stream_over_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    times = np.sort(rng.uniform(0, 200, 120).round(1))
    rows = [("v", float(x), i, "2024-01-01 00:00:00") for i, x in enumerate(times)]
    df = spark.createDataFrame(rows, "video_id string, t double, ord int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    for i in range(3):  # three files, one per micro-batch, in time order
        df.where(f"ord >= {i * 40} AND ord < {i * 40 + 40}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = new_dir(spark, "kept")
    state.drain(state.suppress_close_stream(stream), out, new_dir(spark, "c"))
    got = sorted((r.t, r.ord) for r in spark.read.parquet(out).where("NOT late").collect())
    want = sorted((r.t, r.ord) for r in folds.suppress_close(df).collect())
    assert got == want


def test_late_rows_are_given_aside(spark, tmp_path):
    schema = "video_id string, t double, ord int, ts timestamp"
    src = str(tmp_path / "in")
    for i, times in enumerate(([0.0, 50.0], [10.0, 52.0, 60.0])):
        rows = [("v", t, i, f"2024-01-01 00:00:{i:02d}") for t in times]
        df = spark.createDataFrame(rows, "video_id string, t double, ord int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        state.drain(state.suppress_close_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((r.t, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0.0, False), (10.0, True), (50.0, False), (60.0, False)]


def test_change_point_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(60, 4))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    rows = [("v", i, [float(x) for x in vec[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id string, idx long, embedding array<double>")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    out = new_dir(spark, "changes")
    stream = spark.readStream.schema(df.schema).parquet(src)
    state.drain(state.change_point_stream(stream, 0.0, 2), out, new_dir(spark, "c"))
    got = sorted(r.idx for r in spark.read.parquet(out).collect())
    assert got == sorted(r.idx for r in folds.change_point_sample(df, 0.0, 2).collect())


def test_sampling_gaps_and_once(spark, tmp_path):
    secs = [0, 1, 2, 3, 4, 100, 101, 4000]
    rows = [("v", i, float(s), f"2024-01-01 {s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}") for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "video_id string, ord int, t double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    batch = state.sample_rate(spark.read.parquet(src), 2.0)
    assert sorted(r.t for r in batch.collect()) == [0.0, 2.0, 4.0, 100.0, 4000.0]
    out = new_dir(spark, "s")
    state.drain(state.sample_rate(stream(), 2.0), out, new_dir(spark, "c"))
    # windows that the watermark has closed, then those still open
    closed = spark.read.parquet(out)
    assert sorted(r.t for r in closed.collect()) == [0.0, 2.0, 4.0, 100.0]
    assert [r.t for r in state.sample_tail(spark.read.parquet(src), closed, 2.0).collect()] == [4000.0]
    out = new_dir(spark, "r")
    state.drain(state.stall_detect(stream(), 30.0), out, new_dir(spark, "c"))
    closed = spark.read.parquet(out)
    assert sorted(r.n_rows for r in closed.collect()) == [2, 5]
    assert [r.n_rows for r in state.stall_tail(spark.read.parquet(src), closed, 30.0).collect()] == [1]
    runs = state.stall_detect(spark.read.parquet(src), 30.0).orderBy("first_row").collect()
    assert [r.n_rows for r in runs] == [5, 2, 1]
    gaps = state.stall_gaps(df, 30.0).orderBy("t").collect()
    assert [(r.prev_t, r.t) for r in gaps] == [(4.0, 100.0), (101.0, 4000.0)]


def test_an_id_that_comes_again_much_later_is_not_handled_again(spark, tmp_path):
    src, stored, handled = (str(tmp_path / n) for n in ("in", "stored", "handled"))
    schema = "id string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(stored)
    for day, ids in ((1, ["x", "x", "y"]), (6, ["x", "z"])):
        rows = [(i, f"2024-01-0{day} 00:00:00") for i in ids]
        spark.createDataFrame(rows, "id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(src)
        state.process_once(
            spark.readStream.schema(schema).parquet(src),
            lambda: spark.read.schema(schema).parquet(stored),
            lambda df: df.write.mode("append").parquet(stored),
            str(tmp_path / "c"),
            handle=lambda df: df.write.mode("append").parquet(handled),
        )
    assert sorted(r.id for r in spark.read.parquet(handled).collect()) == ["x", "y", "z"]


def _files(spark, src, parts, schema):
    """One file after another, so that a stream takes them in this order."""
    for rows in parts:
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
        df.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), spark.read.schema(schema).parquet(src)


def test_ordered_folds_of_files_in_reverse(spark, tmp_path):
    """Files come newest first; the stream gives what it can be sure of, the tail the rest."""
    rng = np.random.default_rng(4)
    schema = "video_id string, ts timestamp, t double, ord int, idx int, embedding array<double>"
    base, parts = 1e6, []
    vec = rng.normal(size=(2, 60, 3))
    for k in (2, 1, 0):
        parts.append([(v, base + i, float(i), i, i, [float(x) for x in vec[int(v == "b")][i]]) for v in "ab" for i in range(20 * k, 20 * k + 20)])
    parts.append([("c", base + 130, 130.0, 0, 0, [1.0, 0.0, 0.0])])  # moves the watermark on
    parts.append([("c", base + 131, 131.0, 1, 1, [1.0, 0.0, 0.0])])
    stream, rows = _files(spark, str(tmp_path / "in"), parts, schema)
    for name, fold, tail, batch in (
        ("s", lambda s: state.suppress_close_ordered(s, 4.5, hold=60.0), lambda r, c: state.suppress_close_tail(r, c, 4.5), lambda r: folds.suppress_close(r, 4.5)),
        ("c", lambda s: state.change_point_ordered(s, 0.0, 2, hold=60.0), lambda r, c: state.change_point_tail(r, c, 0.0, 2), lambda r: folds.change_point_sample(r, 0.0, 2)),
    ):
        out = str(tmp_path / name)
        state.drain(fold(stream), out, new_dir(spark, "c"))
        closed = spark.read.parquet(out)
        place = "t" if name == "s" else "idx"
        given = {(r.video_id, r[place]) for r in closed.where("NOT late").collect()}
        rest = {(r.video_id, r[place]) for r in tail(rows, closed).collect()}
        assert closed.where("late").count() == 0
        assert {v for v, _ in given} == {"a", "b"} and not given & rest
        assert given | rest == {(r.video_id, r[place]) for r in batch(rows).collect()}


def test_ordered_fold_gives_late_rows_aside(spark, tmp_path):
    schema = "video_id string, ts timestamp, t double, ord int"
    base = 1e6
    parts = [[("v", base + t, t, int(t))] for t in (0.0, 50.0, 68.0, 90.0, 95.0, 60.0, 130.0, 131.0)]
    stream, _ = _files(spark, str(tmp_path / "in"), parts, schema)
    state.drain(state.suppress_close_ordered(stream, 10.0, hold=20.0), str(tmp_path / "out"), new_dir(spark, "c"))
    got = sorted((r.t, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0.0, False), (50.0, False), (60.0, True), (68.0, False), (90.0, False)]


def test_a_batch_that_stops_half_way_is_made_again_whole(spark, tmp_path):
    """The second of three batches fails while its results are written; ids of all batches are handled once."""
    src, path, checkpoint, flag = (str(tmp_path / n) for n in ("in", "out", "c", "failed"))
    schema = "id string, ts timestamp"
    for ids in (["a", "b", "b"], ["b", "c", "d"], ["a", "d", "e"]):
        spark.createDataFrame([(i,) for i in ids], "id string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    def handle(rows):
        def work(batches):
            import os

            for batch in batches:
                if "d" in batch["id"].tolist() and not os.path.exists(flag):
                    open(flag, "w").close()
                    raise RuntimeError("stopped")
                yield batch

        return rows.select("id").mapInPandas(work, "id string")

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    with pytest.raises(Exception, match="stopped"):
        state.process_once_into(stream(), path, checkpoint, handle=handle)
    for _ in range(2):  # the stopped run goes on; a further one finds nothing to do
        state.process_once_into(stream(), path, checkpoint, handle=handle)
    assert sorted(r.id for r in state.once_rows(spark, path).collect()) == ["a", "b", "c", "d", "e"]
    state.process_once_into(stream(), path, str(tmp_path / "other"), handle=handle)  # another run over the same input
    assert state.once_rows(spark, path).count() == 5
