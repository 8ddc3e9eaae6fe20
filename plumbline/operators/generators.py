"""Sample tables from rules: synthetic images, injected duplicates, outliers and triggers, shifted batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import counter


def synthesize_samples(spark: SparkSession, n: int, side: int = 28, seed: int = 5) -> DataFrame:
    """``samples_of`` the ids 0 to n - 1."""
    return samples_of(spark.range(n), side, seed)


#: Images that a task makes, and those it makes at a time.
TASK_ROWS, BATCH_ROWS = 2048, 128


def samples_of(ids: DataFrame, side: int = 28, seed: int = 5) -> DataFrame:
    """(id, label, pixels) of ids: uniform background up to 0.3 and a 4x4 patch of +0.7 placed by the label.

    A few bytes of ids become images, so ids are dealt over tasks by their number, not by their bytes. The
    counters of a batch's pixels are drawn at once. A null id has a null label and pixels of 1.
    """
    at = np.arange(side * side)
    row, column = at // side, at % side

    def images(keys: np.ndarray, labels: np.ndarray) -> np.ndarray:
        top, left = (np.fmod(2 * labels + k, 20)[:, None] + 2 for k in (0, 1))  # signs as in Spark's %
        inside = (row >= top) & (row < top + 4) & (column >= left) & (column < left + 4)
        return np.minimum(counter.unit_array(keys[:, None], at, seed=seed) * 0.3 + np.where(inside, 0.7, 0.0), 1.0).astype(np.float32)

    def run(batches):
        for rows in batches:
            for i in range(0, rows.num_rows, BATCH_ROWS):
                part = rows.slice(i, BATCH_ROWS)
                keys, labels = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 1))
                pixels = images(keys, labels)
                pixels[part.column(2).is_null().to_numpy(zero_copy_only=False)] = 1.0
                ends = pa.array(np.arange(len(pixels) + 1) * len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(pixels.reshape(-1)))], names=["id", "label", "pixels"])

    rows = ids.select("id", (F.col("id") % 10).cast("int").alias("label"), F.col("id").cast("bigint").alias("key"))
    schema = T.StructType([ids.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.FloatType()))])
    return rows.repartition(ids.count() // TASK_ROWS + 1).mapInArrow(run, schema)


def inject_duplicates(df: DataFrame, mapping: DataFrame, value: str = "pixels") -> DataFrame:
    """``df`` (id, ...) with the values of ids in ``mapping`` (src, dst) put over those of their targets."""
    source = mapping.join(df.select(F.col("id").alias("src"), F.col(value).alias("__value")), "src").select(F.col("dst").alias("id"), "__value")
    return df.join(source, "id", "left").withColumn(value, F.coalesce("__value", value)).drop("__value")


def checkerboard(side: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: ((F.floor(i / side) + i % side) % 2).cast("float"))


def inject_outliers(df: DataFrame, ids: list[int], kind: str, side: int, value: str = "pixels") -> DataFrame:
    """Rows of ``ids`` become a checkerboard, a constant 0.95, or get a burst of bright noise in the middle."""
    pixels = F.col(value)
    low, high = side * 2 // 7, side * 5 // 7
    burst = F.transform(pixels, lambda x, i: F.when((F.floor(i / side).between(low, high - 1)) & (i % side).between(low, high - 1), 0.7 + 0.3 * counter.unit(F.col("id"), i, seed=9)).otherwise(x).cast("float"))
    new = {"checkerboard": checkerboard(side), "constant": F.transform(pixels, lambda x: F.lit(0.95).cast("float")), "burst": burst}[kind]
    return df.withColumn(value, F.when(F.col("id").isin(*ids), new).otherwise(pixels))


def inject_trigger(df: DataFrame, side: int, poisoned: Column, target: int = 0, at: int = 24, size: int = 3) -> DataFrame:
    """Poisoned rows get a bright square and the target label."""
    square = F.transform("pixels", lambda x, i: F.when(F.floor(i / side).between(at, at + size - 1) & (i % side).between(at, at + size - 1), F.lit(1.0)).otherwise(x).cast("float"))
    return df.withColumn("pixels", F.when(poisoned, square).otherwise(F.col("pixels"))).withColumn("label", F.when(poisoned, target).otherwise(F.col("label")))


def shifted_batch(spark: SparkSession, n: int, width: int = 784, reach: float = 10.0) -> DataFrame:
    """``waves_of`` the ids 0 to n - 1."""
    return waves_of(spark.range(n), width, reach)


def waves_of(ids: DataFrame, width: int = 784, reach: float = 10.0) -> DataFrame:
    """(id, pixels) of ids: the same sine wave in every row."""
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.sin(i * (reach / (width - 1))).cast("float")).alias("pixels"))
