"""Whole scans: a dataset's forensic report, and the verdicts of many models."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators import anomalies, drift, duplicates, entropy, inventory, policy, stability, triage
from plumbline.operators.duplicates import one_row
from plumbline.session import checkpointed


def validate_shape(samples: DataFrame) -> DataFrame:
    """One row (n, ok, finding_type, risk_score): all samples of one shape of a dimension or more, and at least one sample."""
    row = samples.agg(F.count("*").alias("n"), F.count_distinct("shape").alias("shapes"), F.min(F.size("shape")).alias("dims"))
    ok = (F.col("n") > 0) & (F.col("shapes") == 1) & (F.col("dims") >= 1)
    return row.select("n", ok.alias("shape_ok"), F.when(~ok, "UNGUARANTEED_UNSUPPORTED_SHAPE").alias("shape_finding"), F.when(~ok, 80.0).otherwise(0.0).alias("shape_risk"))


def load_failure_report(loaded: DataFrame) -> DataFrame:
    """A hard-gate finding of risk 100 for each file that could not be read (path, error)."""
    bad = loaded.where(F.col("error").isNotNull())
    return bad.select(F.col("path").alias("subject_id"), F.lit("UNGUARANTEED_CORRUPT_DATASET").alias("finding_type"), F.lit(100.0).alias("risk_score"), F.lit("HIGH").alias("evidence_strength"), F.lit(True).alias("is_hard_gate"), F.col("error").alias("explanation"))


def scan_dataset(samples: DataFrame, role: str, hash_bits: int, threshold: float = anomalies.THRESHOLD) -> DataFrame:
    """One report row of samples (id, pixels, hash, shape): summary, duplicates, anomalies, merged risk and verdict."""
    vectors = samples.select("id", F.col("pixels").alias("vector"))
    # each is read by several rows of the report
    scores = checkpointed(anomalies.score_isolation_forest(vectors, anomalies.fit_isolation_forest(vectors)))
    _, classes, links = duplicates.near_duplicate_classes(samples.select("id", "pixels", "hash"), hash_bits)
    dup = checkpointed(duplicates.class_risk(checkpointed(classes), checkpointed(links), samples.agg(F.count("*").alias("n"))))
    odd = anomalies.anomaly_risk(scores, threshold)
    merged = anomalies.dataset_risk(dup, odd)
    summary = stability.pixel_summary(samples, "pixels", "shape")
    counts = one_row(dup.select("n_pairs", "n_exact", "n_members"), odd.select("n_anomalies"))
    report = one_row(summary, counts, merged, validate_shape(samples).select("shape_ok", "shape_finding"))
    return report.withColumn("role", E.normalize_role(F.lit(role))).withColumn("protocol", E.protocol_name(F.lit(role))).withColumn("verdict", F.when(F.col("shape_ok"), F.col("verdict")).otherwise("UNGUARANTEED"))


def scan_models(models: DataFrame, manifest: DataFrame | None, nodes: DataFrame, inputs: DataFrame, initializers: DataFrame, issues: DataFrame, reference: DataFrame, live: DataFrame, chains: DataFrame, samples: DataFrame, overlays: DataFrame, n_overlays: int, weights: DataFrame, vector: str = "embedding") -> DataFrame:
    """A verdict for each model: gate findings, STRIP if its format is valid, the drift of live inputs, and the state of its ledger chain.

    STRIP blends samples (id, vector) with overlays (position, overlay) and scores them with each
    model's weights (model_id, label, centroid); a model without weights has no STRIP finding.
    """
    gate = inventory.safety_gate(models, manifest, nodes, inputs, initializers, issues)
    score = drift.check_input(reference, live, vector)
    drifted = anomalies.one_row_join(models.select(F.col("model_id").alias("subject_id")), score.select("finding_type", "risk_score", "evidence_strength", "is_hard_gate"))
    drifted = drifted.withColumn("pos", F.lit(10)).withColumn("title", F.lit("distribution-shift / input-anomaly indicator"))
    valid = models.where("format_ok").select("model_id")
    strip = entropy.strip_by_model(samples, overlays, n_overlays, weights.join(valid, "model_id", "left_semi"))
    strip = strip.select(F.col("model_id").alias("subject_id"), F.lit(9).alias("pos"), "finding_type", "title", "risk_score", "evidence_strength", "is_hard_gate")
    broken = policy.broken_chain_finding(chains.join(models.select(F.col("model_id").alias("subject_id")), "subject_id", "left_semi"))
    return policy.evaluate_policy(policy.union_findings(broken, gate, strip, drifted))


@lru_cache(maxsize=256)
def _weights(source: int, target: int) -> np.ndarray:
    return np.array(E.resize_weights(source, target))


def _resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return _weights(x.shape[0], height) @ x @ _weights(x.shape[1], width).T


def image_vectors(images: DataFrame, side: int) -> DataFrame:
    """(path, vector, hash) of decoded images (origin, height, width, nChannels, data): gray pixels in 0..1, resized by fixed triangle weights, and the 64-bit difference hash as hex."""

    def run(batches):
        for batch in batches:
            vectors, hashes = [], []
            for height, width, channels, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                gray = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)[:, :, :3].mean(axis=2) / 255
                vectors.append(_resized(gray, side, side).reshape(-1))
                small = np.round(_resized(gray, 8, 9), 9)  # a difference that only rounding makes is none
                hashes.append(np.packbits((small[:, :-1] > small[:, 1:]).reshape(-1)).tobytes().hex())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(hashes, pa.string())], names=["path", "vector", "hash"])

    return images.where("height > 0").select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, vector array<double>, hash string")


def scan_images(files: DataFrame, images: DataFrame, score: Callable[[DataFrame], DataFrame], calibration: DataFrame, profile: str = "Standard", side: int = 28) -> DataFrame:
    """One row per file (path, sha256, format, hash, status, finding_type, reasons, risk_score, evidence_strength).

    ``files`` (path, length, content) are triaged by size and leading bytes before ``images`` (the
    decoded form, by origin) are looked at; ``score`` gives (id, variant, vector) rows their ``probs``.
    A file that passes triage and has no decoded form is malformed; a decoded one is judged by how its
    prediction holds under brightness, a shift, blur and noise, UNGUARANTEED without a calibration row.
    """
    # each is read by several branches: files are opened once for their bytes and once for their pixels
    seen, vectors = checkpointed(triage.triage(files, profile)), checkpointed(image_vectors(images, side))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    passed = seen.where("status <> 'REJECTED'").select(F.col("path").alias("id"), "sha256", plain(F.col("path")).alias("key"))
    rows = passed.join(vectors.withColumn("key", plain(F.col("path"))).drop("path"), "key")
    v, seed = F.col("vector"), E.seed_from_hash(F.col("sha256"))
    shown = stability.stack_variants(rows.select("id", "sha256", "vector"), {"baseline": v, "brightness": E.brightness(v), "translation": E.translate(v, side), "blur": E.blur(v, side), "noise": E.noise(v, 0.05, seed)})
    judged = stability.stability_verdict(stability.stability_metrics(score(shown)), calibration)
    judged = judged.join(rows.select("id", "hash"), "id").withColumnRenamed("id", "path")
    names = ["hash", "status", "finding_type", "reasons", "risk_score", "evidence_strength"]
    out = seen.join(judged.select("path", *(F.col(n).alias(f"own_{n}") for n in names)), "path", "left")
    lost = (F.col("status") != "REJECTED") & F.col("own_status").isNull()
    return out.select(
        "path", "sha256", "format", F.col("own_hash").alias("hash"),
        F.when(lost, "REJECTED").otherwise(F.coalesce("own_status", "status")).alias("status"),
        F.when(lost, "REJECTED_MALFORMED_IMAGE").otherwise(F.coalesce("own_finding_type", "finding_type")).alias("finding_type"),
        F.when(lost, F.array(F.lit("image cannot be decoded"))).otherwise(F.coalesce("own_reasons", "reasons")).alias("reasons"),
        F.when(lost, 100.0).otherwise(F.coalesce("own_risk_score", "risk_score")).alias("risk_score"),
        F.coalesce("own_evidence_strength", F.lit("HIGH")).alias("evidence_strength"),
    )
