"""Sources and sinks. Paths are read by Spark alone, so any file system it knows works."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import arrays

LEDGER_FIELDS = ("previous_event_hash", "event_hash", "timestamp", "model_sha256", "provenance_manifest")


def read_samples(spark: SparkSession, path: str, kind: str = "parquet", whole: int = arrays.WHOLE) -> DataFrame:
    """Samples: Parquet as it is, or npy / npz files (first array), a row per first-axis entry.

    Array files give (path, sample_id, shape, pixels, error); one that cannot be read gives one row with
    ``error``. A .npy file beyond ``whole`` bytes is read by row ranges, many tasks a file (``arrays``); an
    .npz file is compressed and is read by one task.
    """
    if kind == "parquet":
        return spark.read.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)

    def load(batches):
        for rows in batches:
            for name, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                try:
                    array = np.load(io.BytesIO(content), allow_pickle=False)
                    if hasattr(array, "files"):
                        array = array[array.files[0]]
                    if array.ndim < 1:
                        raise ValueError("no first axis")
                except Exception as error:  # any unreadable file is a row, not a failed job
                    yield arrays.batch_of([(name, None, None, None, str(error)[:200])])
                    continue
                shape = list(array.shape[1:])
                for i in range(0, len(array), 1000):
                    part = array[i : i + 1000].reshape(len(array[i : i + 1000]), -1).astype(np.float32)
                    yield arrays.batch_of([(name, i + k, shape, row, None) for k, row in enumerate(part)])

    small = files.where(F.col("length") <= whole) if kind == "npy" else files
    rows = small.select("path", "content").mapInArrow(load, arrays.SAMPLES)
    if kind != "npy":
        return rows
    return rows.unionByName(arrays.read_ranges(arrays.array_ranges(files.where(F.col("length") > whole))))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, sha256) of binary files; the digest is computed only if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("sha256", F.sha2("content", 256))


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded PNG and JPEG pixels; a file that cannot be decoded has height -1, or is dropped."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path).select("image.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(position, model_id, version, sha256, signer, approved_at) of an approved-model list."""
    entry = "struct<model_id:string,version:string,sha256:string,signer:string,approved_at:string>"
    rows = spark.read.schema(f"approved_models array<{entry}>").json(path, multiLine=True)
    return rows.select(F.posexplode("approved_models").alias("position", "m")).select("position", "m.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(seq, raw, parsed fields ...) of a JSON-lines ledger in file order; malformed lines are kept, blank ones dropped but counted.

    Line numbers: lines are counted per part of the file, the counts summed over the parts (few), and
    each line's own place added, so no task holds the file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("file", "block", "first", before.alias("before"))
    rows = lines.join(F.broadcast(offsets), ["file", "block"]).withColumn("seq", F.col("at") - F.col("first") + F.col("before") + 1).where(F.trim("value") != "")
    parsed = F.expr("try_parse_json(value)")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    has = F.lit(True)
    for name in LEDGER_FIELDS:
        has = has & field(name).isNotNull()
    return rows.select(
        F.col("file").alias("chain_id"), "seq", F.col("value").alias("raw"), parsed.isNotNull().alias("parsed"), F.expr("coalesce(schema_of_variant(try_parse_json(value)) like 'OBJECT%', false)").alias("is_object"), has.alias("has_fields"),
        field("previous_event_hash").alias("previous_event_hash"), field("event_hash").alias("event_hash"), field("model_sha256").alias("model_sha256"), field("provenance_manifest").alias("manifest"),
        F.expr("try_cast(get_json_object(value, '$.timestamp') as bigint)").alias("ts_us"),
    )


def append_ledger(events: DataFrame, path: str) -> None:
    """Events appended as JSON lines, in order of chain and seq within each file."""
    rows = events.repartition("chain_id").sortWithinPartitions("chain_id", "seq")
    rows.select(F.to_json(F.struct("chain_id", "seq", "previous_event_hash", "event_hash", F.col("ts_us").alias("timestamp"), "model_sha256", F.col("manifest").alias("provenance_manifest"))).alias("value")).write.mode("append").text(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    schema = "num_samples long, mean_entropy double, std_entropy double, anomaly_entropy_threshold double, max_prediction_distribution_distance double, max_flip_rate_threshold double, max_js_divergence_threshold double, pred_class_distribution array<double>"
    return spark.read.schema(schema).json(path)


def write_calibration(calibration: DataFrame, path: str) -> None:
    calibration.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


INFERENCE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("chain_id", "model_sha256", "input_data_summary", "prediction")] + [T.StructField("ts", T.TimestampType()), T.StructField("id", T.LongType())])


def read_inference_stream(spark: SparkSession, path: str, kind: str = "json", schema: T.StructType = INFERENCE_SCHEMA) -> DataFrame:
    """Inference records as a stream of files."""
    return spark.readStream.schema(schema).format(kind).load(path)


def export_certificates(certs: DataFrame, path: str) -> None:
    """Certificates as JSON texts; the canonical payload stays a text, so that its digest holds."""
    certs.select(F.to_json(F.struct(*certs.columns)).alias("value")).write.mode("overwrite").text(path)
