"""Streaming forms of the sampler, the gap detector and the two folds.

Streams carry (video_id, ts timestamp, t double, ...). State per video is one small row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from avsync.operators import folds
from avsync.operators.folds import SAMPLE_MAX_GAP, SAMPLE_MIN_GAP, SAMPLE_THRESHOLD
from avsync.session import settle
from avsync.sources.catalog import new_rows


def sample_rate(stream: DataFrame, seconds: float = 2.0, lateness: str = "10 minutes", order: str = "ord") -> DataFrame:
    """The first row of each video in every ``seconds``; rows are pre-aggregated before the shuffle."""
    rest = F.struct(*[c for c in stream.columns if c != "video_id"])
    return (
        stream.withWatermark("ts", lateness)
        .groupBy("video_id", F.window("ts", f"{int(seconds * 1000)} milliseconds").alias("window"))
        .agg(F.min_by(rest, F.struct("ts", order)).alias("r"))
        .select("video_id", F.col("window.start").alias("window_start"), "r.*")
    )


def stall_detect(stream: DataFrame, seconds: float = 30.0, lateness: str = "10 minutes") -> DataFrame:
    """Runs of rows of a video without a gap of ``seconds``; each end is a stall."""
    session = F.session_window("ts", f"{int(seconds * 1000)} milliseconds")
    return (
        stream.withWatermark("ts", lateness)
        .groupBy("video_id", session.alias("session"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("last_row"))
        .select("video_id", F.col("session.start").alias("first_row"), "last_row", "n_rows")
    )


def sample_tail(rows: DataFrame, closed: DataFrame, seconds: float = 2.0, order: str = "ord") -> DataFrame:
    """``sample_rate`` of the windows that a stream has not given when its input ends.

    ``rows`` is the input as a table, ``closed`` what the stream gave.
    """
    start = F.window("ts", f"{int(seconds * 1000)} milliseconds")["start"]
    given = closed.select("video_id", F.col("window_start").alias("_start"))
    rest = rows.withColumn("_start", start).join(given, ["video_id", "_start"], "left_anti").drop("_start")
    return sample_rate(rest.select(*rows.columns), seconds, order=order)


def stall_tail(rows: DataFrame, closed: DataFrame, seconds: float = 30.0) -> DataFrame:
    """``stall_detect`` of the runs that a stream has not given when its input ends."""
    last = closed.groupBy("video_id").agg(F.max("last_row").alias("_last"))
    rest = rows.join(last, "video_id", "left").where("_last IS NULL OR ts > _last").drop("_last")
    return stall_detect(rest.select(*rows.columns), seconds)


def stall_gaps(rows: DataFrame, seconds: float = 30.0, order: str = "ord", max_rows: float | None = None) -> DataFrame:
    """Batch form: pairs of neighbouring rows more than ``seconds`` apart."""
    from avsync.operators import ordered
    from avsync.operators.ordered import find_cuts

    cuts = find_cuts(rows, ["video_id"], ["t", order], max_rows)
    seen = ordered.scan(rows.select("video_id", "t", order), cuts, prev_t=ordered.lag(F.col("t")))
    return seen.where(F.col("t") - F.col("prev_t") > seconds).select("video_id", "prev_t", "t")


def _arranged(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def _expire(state: GroupState, seen: pd.Timestamp, idle_ms: int) -> None:
    at = int(seen.timestamp() * 1000) + idle_ms
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def suppress_close_stream(
    stream: DataFrame, gap: float = folds.REDUNDANCY_SECONDS, lateness: str = "10 minutes", order: str = "ord", idle_ms: int = 86_400_000
) -> DataFrame:
    """All columns of the rows at least ``gap`` seconds after the last kept row of their video, and ``late``.

    Within a micro-batch rows are taken in time order, of equal times the first by
    ``order``. A row older than the last kept one came too late to be judged in order: it
    is given too, with ``late`` true, for the caller to keep aside. A video whose rows
    lie ``idle_ms`` behind the watermark is forgotten.
    """
    out = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])
    names = stream.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _arranged(batches, ["t", order])
        seen = rows["ts"].max()
        late = rows["t"] < last if last is not None else pd.Series(False, index=rows.index)
        if late.any():
            yield rows[late][names].assign(late=True)
        rows = rows[~late].drop_duplicates("t")
        times = rows["t"].to_numpy(dtype=float)
        taken = folds._walk(times, np.full(len(times), np.nan), last, gap, 0.0) if len(times) else []
        if len(taken):
            last = float(times[taken[-1]])
            yield rows.iloc[taken][names].assign(late=False)
        if last is not None:
            state.update((last,))
            _expire(state, seen, idle_ms)

    return (
        stream.withWatermark("ts", lateness)
        .groupBy("video_id")
        .applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.EventTimeTimeout)
    )


def change_point_stream(
    stream: DataFrame,
    threshold: float = SAMPLE_THRESHOLD,
    min_gap: int = SAMPLE_MIN_GAP,
    max_gap: int = SAMPLE_MAX_GAP,
    lateness: str = "10 minutes",
    idle_ms: int = 86_400_000,
) -> DataFrame:
    """Kept (video_id, idx) of a stream of (video_id, idx, embedding), and ``late``; state is the last kept row.

    Rows before the last kept one are given with ``late`` true. If the stream has ``ts``, a
    video whose rows lie ``idle_ms`` behind the watermark is forgotten.
    """
    timed = "ts" in stream.columns
    video = stream.schema["video_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_idx, last_vec = state.get if state.exists else (None, None)
        rows = _arranged(batches, ["idx"])
        seen = rows["ts"].max() if timed else None
        if last_idx is not None:
            late = rows["idx"] < last_idx
            if late.any():
                yield pd.DataFrame({"video_id": key[0], "idx": rows["idx"][late], "late": True})
            rows = rows[~late]
        idx = rows["idx"].to_numpy()
        vec = np.stack(rows["embedding"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
        kept, at = [], 0
        if last_idx is None and len(idx):
            kept, at = [0], 1
            last_idx, last_vec = int(idx[0]), vec[0]
        while at < len(idx):
            # the next kept row is among those up to max_gap on
            end = int(np.searchsorted(idx, last_idx + max_gap, "left")) + 1
            near = idx[at:end] - last_idx
            hit = (near >= max_gap) | ((near >= min_gap) & (vec[at:end] @ np.asarray(last_vec, dtype=float) < threshold))
            if not hit.any():
                break
            at += int(np.argmax(hit))
            kept.append(at)
            last_idx, last_vec = int(idx[at]), vec[at]
            at += 1
        if kept:
            yield pd.DataFrame({"video_id": key[0], "idx": idx[kept], "late": False})
        if last_idx is not None:
            state.update((int(last_idx), [float(x) for x in last_vec]))
            if timed:
                _expire(state, seen, idle_ms)

    if timed:
        stream = stream.withWatermark("ts", lateness)
    return (
        stream.select("video_id", F.col("idx").cast("long").alias("idx"), "embedding", *(["ts"] if timed else []))
        .groupBy("video_id")
        .applyInPandasWithState(
            step,
            f"video_id {video}, idx long, late boolean",
            "idx long, embedding array<double>",
            "append",
            GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout,
        )
    )


# --- folds over streams that come out of order -------------------------------


def _plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return value.tolist()
    return value.item() if isinstance(value, np.generic) else None if value is pd.NaT else value


class OrderedFold(StatefulProcessor):
    """Holds the rows of a video back until no earlier one can come, and folds them in order.

    Rows wait in a list state, to which new ones are only added. A timer per video wakes it when
    its earliest row is due; then all rows that are due are taken in the order of ``by`` and given to
    ``fold(last, rows)``, which returns (kept rows, last). ``last`` is all that stays of rows
    that are done. A row older than what is already done comes out with ``late`` true. A
    video without rows in waiting is forgotten ``idle_us`` after its last one.
    """

    def __init__(self, given: list[str], names: list[str], held: T.StructType, last: T.StructType, by: list[str], fold: Callable, hold_us: int, idle_us: int):
        self.given, self.names, self.held, self.last, self.by, self.fold = given, names, held, last, by, fold
        self.hold_us, self.idle_us = hold_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.kept = handle.getValueState("last", self.last)
        self.done = handle.getValueState("done", "through long, newest long, wake long")

    def _wake(self, at_us: int, wake: int | None, mark: int) -> int:
        """When the next timer fires; an earlier one that is still set does as well."""
        at = at_us // 1000 + 1
        if wake is None or at < wake or wake <= mark:
            self.handle.registerTimer(at)
            return at
        return wake

    def _advance(self, timer_values: Any, fresh: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        # the watermark lies two holds behind the newest row, so rows are due one hold behind it
        mark = timer_values.getCurrentWatermarkInMs()
        due = mark * 1000 + self.hold_us if mark > 0 else -(1 << 62)  # 0: no watermark yet
        through, newest, wake = self.done.get() if self.done.exists() else (None, None, None)
        if fresh is not None:
            newest = max(int(fresh["_us"].max()), newest if newest is not None else -(1 << 62))
            if through is not None:
                late = fresh["_us"] <= through
                if late.any():
                    yield fresh[late][self.names].assign(late=True)
                fresh = fresh[~late]
            if len(fresh):
                self.rows.appendList([tuple(map(_plain, r)) for r in fresh[self.held.names].itertuples(index=False)])
                wake = self._wake(int(fresh["_us"].min()) - self.hold_us, wake, mark)
            self.done.update((through, newest, wake))
            return  # timers of this micro-batch come after its rows
        if newest is None:
            return
        waiting = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=self.held.names)
        if not len(waiting):
            if mark * 1000 > newest + self.idle_us:
                for state in (self.rows, self.kept, self.done):
                    state.clear()
            else:
                self.done.update((through, newest, self._wake(newest + self.idle_us, None, mark)))
            return
        ready = waiting["_us"] <= due
        if ready.any():
            last = self.kept.get() if self.kept.exists() else None
            kept, last = self.fold(last, waiting[ready].sort_values(self.by, kind="stable", ignore_index=True))
            if last is not None:
                self.kept.update(last)
            through = due
            if len(kept):
                yield kept[self.names].assign(late=False)
            self.rows.clear()
            waiting = waiting[~ready]
            if len(waiting):
                self.rows.put([tuple(map(_plain, r)) for r in waiting.itertuples(index=False)])
        at = int(waiting["_us"].min()) - self.hold_us if len(waiting) else newest + self.idle_us
        self.done.update((through, newest, self._wake(at, None, mark)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # names are set anew: those with a leading underscore do not come through
        yield from self._advance(timerValues, pd.concat(list(rows), ignore_index=True).set_axis(self.given, axis=1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues, None)

    def close(self) -> None:
        pass


def _ordered(stream: DataFrame, by: list[str], last: T.StructType, fold: Callable, hold: float, idle: float) -> DataFrame:
    spark = stream.sparkSession
    # list states and timers are kept by this store only
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark("ts", f"{int(2000 * hold)} milliseconds").withColumn("_us", F.unix_micros("ts"))
    held = T.StructType([f for f in rows.schema.fields if f.name != "ts"])  # _us says it
    names = [n for n in rows.columns if n != "ts"]
    out = T.StructType([rows.schema[n] for n in names] + [T.StructField("late", T.BooleanType())])
    fold_of = OrderedFold(rows.columns, names, held, last, by, fold, int(hold * 1_000_000), int(idle * 1_000_000))
    folded = rows.groupBy("video_id").transformWithStateInPandas(fold_of, out, "Append", "EventTime")
    return folded.withColumn("ts", F.timestamp_micros("_us")).select(*stream.columns, "late")


def suppress_close_ordered(
    stream: DataFrame, gap: float = folds.REDUNDANCY_SECONDS, hold: float = 600.0, order: str = "ord", idle: float = 86_400.0
) -> DataFrame:
    """``suppress_close`` of a stream whose rows come out of order by up to ``hold`` seconds of ``ts``.

    ``ts`` must grow with ``t``. All columns of the kept rows come out, as soon as the newest
    row of any video is ``hold`` seconds on; rows that come later than that have ``late`` true,
    and those later than twice that are dropped by the stream's watermark. Rows still held when
    an input ends come from ``suppress_close_tail``.
    """

    def fold(last: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None]:
        at = last[0] if last else None
        rows = rows.drop_duplicates("t") if at is None else rows[rows["t"] >= at].drop_duplicates("t")
        times = rows["t"].to_numpy(dtype=float)
        taken = folds._walk(times, np.full(len(times), np.nan), at, gap, 0.0) if len(times) else []
        kept = rows.iloc[taken]
        return kept, (float(times[taken[-1]]),) if len(taken) else last

    return _ordered(stream, ["t", order], T.StructType([T.StructField("t", T.DoubleType())]), fold, hold, idle)


def change_point_ordered(
    stream: DataFrame,
    threshold: float = SAMPLE_THRESHOLD,
    min_gap: int = SAMPLE_MIN_GAP,
    max_gap: int = SAMPLE_MAX_GAP,
    hold: float = 600.0,
    idle: float = 86_400.0,
) -> DataFrame:
    """``change_point_sample`` of a stream (video_id, ts, idx, embedding) that comes out of order by
    up to ``hold`` seconds of ``ts``, which must grow with ``idx``: (video_id, ts, idx, embedding, late).

    Late rows and the end of an input as in ``suppress_close_ordered``; the rest comes from
    ``change_point_tail``.
    """

    def fold(last: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None]:
        last_idx, last_vec = last or (None, None)
        idx = rows["idx"].to_numpy()
        vec = [np.asarray(v, dtype=float) for v in rows["embedding"]]
        kept = []
        for at in range(len(rows)):
            gap = None if last_idx is None else idx[at] - last_idx
            if gap is None or gap >= max_gap or (gap >= min_gap and float(vec[at] @ np.asarray(last_vec, dtype=float)) < threshold):
                kept.append(at)
                last_idx, last_vec = int(idx[at]), vec[at]
        return rows.iloc[kept], None if last_idx is None else (last_idx, [float(x) for x in last_vec])

    rows = stream.select("video_id", "ts", F.col("idx").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("embedding"))
    last = T.StructType([T.StructField("idx", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return _ordered(rows, ["idx"], last, fold, hold, idle)


def _from_last(rows: DataFrame, closed: DataFrame, place: str) -> DataFrame:
    """The rows of each video from its last kept one on, which the fold keeps again."""
    last = closed.where("NOT late").groupBy("video_id").agg(F.max(place).alias("_last"))
    return rows.join(last, "video_id", "left").where(f"_last IS NULL OR {place} >= _last")


def suppress_close_tail(rows: DataFrame, closed: DataFrame, gap: float = folds.REDUNDANCY_SECONDS, order: str = "ord") -> DataFrame:
    """What ``suppress_close_ordered`` still holds when its input, ``rows``, ends; ``closed`` is what it gave."""
    kept = folds.suppress_close(_from_last(rows, closed, "t"), gap, order)
    return kept.where("_last IS NULL OR t > _last").select(*rows.columns)


def change_point_tail(
    rows: DataFrame, closed: DataFrame, threshold: float = SAMPLE_THRESHOLD, min_gap: int = SAMPLE_MIN_GAP, max_gap: int = SAMPLE_MAX_GAP
) -> DataFrame:
    """(video_id, idx) that ``change_point_ordered`` still holds when its input ends."""
    left = _from_last(rows, closed, "idx")
    kept = folds.change_point_sample(left, threshold, min_gap, max_gap)
    return kept.join(closed.where("NOT late").select("video_id", "idx"), ["video_id", "idx"], "left_anti")


def process_once(
    stream: DataFrame,
    read: Callable[[], DataFrame],
    append: Callable[[DataFrame], Any],
    checkpoint: str,
    key: str = "id",
    handle: Callable[[DataFrame], Any] | None = None,
) -> None:
    """Handle the rows whose id is not stored yet, once each, however late a copy comes.

    ``read()`` gives the stored rows, ``append(rows)`` stores new ones; ids are stored after
    ``handle``, so a batch that stops half way is handled again and a finished one is not.
    """

    def one(batch: DataFrame, _: int) -> None:
        fresh = settle(new_rows(batch, read(), key), "fresh")
        if handle is not None:
            handle(fresh)
        append(fresh)

    for_each_new(stream, checkpoint, one)


def process_once_into(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "id",
    handle: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """``process_once`` whose results and handled ids are one commit: exactly once, wherever it stops.

    ``handle`` turns the fresh rows into result rows that keep the key column; they are
    written to ``path`` below the run and batch that made them, in one overwriting write.
    That folder is also the table of handled ids. A micro-batch that stopped half way is
    made again with the same number: it does not see its own unfinished folder and writes
    over it, so nothing is missing and nothing stands twice. Read results with ``once_rows``.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    kind = stream.schema[key].dataType.simpleString()

    def one(batch: DataFrame, batch_id: int) -> None:
        stored = once_rows(batch.sparkSession, path, f"{key} {kind}, run string, batch long")
        others = stored.where((F.col("run") != run) | (F.col("batch") < batch_id)).select(key)
        fresh = new_rows(batch, others, key)
        made = handle(fresh) if handle is not None else fresh
        made.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.select(key).schema).write.mode("overwrite").parquet(f"{path}/run=none/batch=0")
    for_each_new(stream, checkpoint, one)


def once_rows(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """What ``process_once_into`` has stored, with run and batch; give the schema while that may be nothing."""
    reader = spark.read.option("basePath", path)
    if schema is not None:
        return reader.schema(schema).parquet(path)
    return reader.option("mergeSchema", "true").parquet(path)


def drain(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into Parquet files, then stop."""
    query = (
        result.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def for_each_new(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], Any]) -> None:
    """Run ``handle(rows, batch_id)`` on every micro-batch of what is there now."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
