"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; memory, cores and shuffle width belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # long texts and vectors: what a Python worker is given at a time
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark, os.path.dirname(os.path.abspath(__file__)))
    return spark


def ship(spark: SparkSession, package: str) -> None:
    """Send a package's folder to the Python workers, once per application.

    The driver's own search path does not reach them. Only the driver reads the archive
    from its disk; workers get it from the driver.
    """
    context = spark.sparkContext
    name = os.path.basename(package)
    sent = context.__dict__.setdefault("_avsync_sent", set())
    if name in sent:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for folder, _, files in sorted(os.walk(package)):
            for file in sorted(files):
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.join(name, os.path.relpath(full, package)))
    path = os.path.join(tempfile.mkdtemp(prefix="avsync-"), f"{name}.zip")
    with open(path, "wb") as out:
        out.write(held.getvalue())
    context.addPyFile(path)
    sent.add(name)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the table is fewer files than cores, for work that costs
    far more per row than moving it. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master with none set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="avsync-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared one (not created)."""
    return f"{shared_dir(spark).rstrip('/')}/avsync/{name}-{uuid.uuid4().hex}"


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end, but those that are said to last.

    What goes on from here may read lasting tables only.
    """
    paths: list[str] = []
    before = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(before)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str = "step", lasting: bool = False) -> DataFrame:
    """Write a table that several later steps read, and go on from the file.

    It lies in the shared folder, so a lost executor does not bring the work back.
    """
    path = new_dir(df.sparkSession, name)
    if (paths := _PASSING.get()) is not None and not lasting:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
