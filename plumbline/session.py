"""Session defaults and the small helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; on a cluster leave ``master`` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # files go when nothing refers to them
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is read by Spark alone, so any file system it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; where none is set, a local folder, in local mode only."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "plumbline-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so its lineage ends there.

    The files outlive any executor, and go with the last reference to them where the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``build_session`` sets it. Used where a result is read more than once and is dear to
    compute again, and in loops whose plan would grow without end.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, in compressed columns: for wide tables that are read in part."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path  # known, so no file is opened for it


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that works as ``stored``; its tables are deleted at the end of the block, so nothing lazy that reads them may outlive it."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        table, path = _written(df)
        paths.append(path)
        return table

    try:
        yield keep
    finally:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of some 40 bytes that may be broadcast.
SMALL = 1_000_000


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is, to be shuffled; pass a stored table."""
    return F.broadcast(df) if df.count() <= most else df
