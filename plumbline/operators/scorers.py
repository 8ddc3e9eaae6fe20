"""Class probabilities for rows: a linear softmax in built-in expressions, or any vectorised scorer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from plumbline.functions import exprs as E


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): mean vector of each label."""
    means = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "value")).groupBy(label, "dim").agg(F.avg("value").alias("m"))
    return means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("ms")).select(label, F.transform("ms", lambda x: x["m"]).alias("centroid"))


def linear_logits(df: DataFrame, weights: DataFrame, vector: str, label: str = "label") -> DataFrame:
    """``df`` with ``logits``: dot products with the weights, one row a class, in label order.

    The classes come as one row; their number is a model's, not the data's.
    """
    row = weights.agg(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("centroid")))).alias("__w")).withColumn("__one", F.lit(1))
    logits = E.let(E.doubles(F.col(vector)), lambda v: F.transform("__w", lambda w: E.dot(v, w["centroid"])))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(row), "__one").withColumn("logits", logits).drop("__w", "__one")


def linear_probabilities(df: DataFrame, weights: DataFrame, vector: str, label: str = "label") -> DataFrame:
    """``df`` with ``probs``: the softmax of its ``linear_logits``."""
    return linear_logits(df, weights, vector, label).withColumn("probs", E.softmax(F.col("logits"))).drop("logits")


def score_vectors(df: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], vector: str = "pixels", batch: int = 64) -> DataFrame:
    """``df`` with ``probs``: ``scorer`` maps (rows, width) to logits, ``batch`` rows at a time; softmax follows, always.

    The scorer is sent to the tasks once and called on Arrow batches.
    """
    schema = StructType([*df.schema.fields, StructField("probs", ArrayType(DoubleType()))])
    at = df.columns.index(vector)

    def run(batches):
        for rows in batches:
            out = []
            for i in range(0, rows.num_rows, batch):
                logits = np.asarray(scorer(np.array(rows.column(at).slice(i, batch).to_pylist(), dtype=np.float32)), dtype=float)
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                out += list(e / e.sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.list_(pa.float64()))], names=[*rows.schema.names, "probs"])

    return df.mapInArrow(run, schema)


def onnx_scorer(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer over an ONNX file that every executor can read; its session opens on first use in a task."""
    session: list = []

    def run(x: np.ndarray) -> np.ndarray:
        if not session:
            import onnxruntime

            session.append(onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]))
        return session[0].run(None, {session[0].get_inputs()[0].name: x})[0]

    return run
