"""Stability of predictions under perturbation, calibration of its thresholds, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators.duplicates import one_row

DEFAULTS = {"max_flip_rate_threshold": 0.25, "max_js_divergence_threshold": 0.15, "max_prediction_distribution_distance": 0.75, "anomaly_entropy_threshold": 1.5}


def stack_variants(df: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """(id, variant, vector): the baseline and each variant of each row."""
    each = F.array(*(F.struct(F.lit(name).alias("variant"), values.cast("array<double>").alias("vector")) for name, values in variants.items()))
    return df.select("id", F.explode(each).alias("v")).select("id", "v.variant", "v.vector")


def stability_metrics(scored: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per id of (id, variant, probs): how far the variants' predictions leave the baseline's."""
    base = scored.where(F.col("variant") == baseline).select("id", F.col("probs").alias("base"))
    both = scored.where(F.col("variant") != baseline).join(base, "id")
    p, q = F.col("base"), F.col("probs")
    own = F.element_at(q, E.argmax(p) + 1)
    rows = both.select(
        "id", "base", (E.argmax(p) != E.argmax(q)).cast("double").alias("flip"), E.js_divergence(p, q).alias("js"), (F.array_max(p) - own).alias("drop"), E.entropy_nats(q).alias("h"),
    )
    out = rows.groupBy("id").agg(F.first("base").alias("base"), F.avg("flip").alias("flip"), F.avg("js").alias("js"), F.max("drop").alias("drop"), F.avg("h").alias("h"))
    h0 = E.entropy_nats(F.col("base"))
    return out.select(
        "id", "base", E.argmax(F.col("base")).alias("baseline_class"), F.round(F.array_max("base"), 4).alias("baseline_confidence"), h0.alias("baseline_entropy"),
        F.round("flip", 4).alias("flip_rate"), F.round("js", 4).alias("mean_js"), F.round(F.greatest(F.lit(0.0), F.col("drop")), 4).alias("max_confidence_drop"), F.round(F.col("h") - h0, 4).alias("entropy_change"),
    )


def fit_calibration(scored: DataFrame) -> DataFrame:
    """One row of thresholds from clean probabilities: entropy mean + 3 deviations + 0.1, and mean classes."""
    h = scored.agg(F.count("*").alias("num_samples"), F.avg(E.entropy_calib(F.col("probs"))).alias("mean"), F.stddev_pop(E.entropy_calib(F.col("probs"))).alias("std"))
    each = scored.select(F.posexplode("probs").alias("k", "p")).groupBy("k").agg(F.avg("p").alias("p"))
    classes = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: F.round(x["p"], 6)).alias("pred_class_distribution"))
    return one_row(h, classes).select(
        "num_samples", F.round("mean", 4).alias("mean_entropy"), F.round("std", 4).alias("std_entropy"), F.round(F.col("mean") + 3 * F.col("std") + 0.1, 4).alias("anomaly_entropy_threshold"),
        F.lit(1.5).alias("max_prediction_distribution_distance"), F.lit(0.25).alias("max_flip_rate_threshold"), F.lit(0.15).alias("max_js_divergence_threshold"), "pred_class_distribution",
    )


def attach_calibration(metrics: DataFrame, calibration: DataFrame) -> DataFrame:
    """Every row with the thresholds of the one-row calibration, defaults where it has none."""
    known = [c for c in DEFAULTS if c in calibration.columns]
    row = calibration.select("pred_class_distribution", *(F.col(c).cast("double").alias(c) for c in known)).withColumn("__one", F.lit(1)).limit(1)
    joined = metrics.withColumn("__one", F.lit(1)).join(F.broadcast(row), "__one", "left").drop("__one")
    for name, value in DEFAULTS.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in known else F.lit(value))
    return joined


def stability_verdict(metrics: DataFrame, calibration: DataFrame) -> DataFrame:
    """(id, status, reasons, risk_score, evidence_strength): suspicious where any of four thresholds is exceeded.

    Without a calibration row every id is UNGUARANTEED, risk 0, strength LOW.
    """
    rows = attach_calibration(metrics, calibration)
    distance = F.round(E.l2_distance(F.col("base"), F.col("pred_class_distribution")), 4)
    rows = rows.withColumn("prediction_distance", distance)
    tests = [
        ("flip_rate", F.col("flip_rate") > F.col("max_flip_rate_threshold")),
        ("js_divergence", F.col("mean_js") > F.col("max_js_divergence_threshold")),
        ("prediction_distance", F.col("prediction_distance") > F.col("max_prediction_distribution_distance")),
        ("entropy", F.col("baseline_entropy") > F.col("anomaly_entropy_threshold")),
    ]
    reasons = F.filter(F.array(*(F.when(test, name) for name, test in tests)), lambda r: r.isNotNull())
    missing = F.col("pred_class_distribution").isNull()
    bad = F.size(reasons) > 0
    return rows.select(
        "id", "prediction_distance",
        F.when(missing, "UNGUARANTEED").when(bad, "SUSPICIOUS").otherwise("SAFE_UNDER_CHECKS").alias("status"),
        F.when(missing, "UNGUARANTEED_NO_CALIBRATION").when(bad, "SUSPICIOUS_IMAGE_BEHAVIOR_INDICATOR").otherwise("SAFE_UNDER_CHECKS_PASSED").alias("finding_type"),
        F.when(missing, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"),
        F.when(missing, 0.0).otherwise(E.sentinel_risk(bad, F.col("flip_rate"), F.col("mean_js"))).alias("risk_score"),
        F.when(missing, "LOW").when(bad & (F.col("flip_rate") < 0.4), "MEDIUM").otherwise("HIGH").alias("evidence_strength"),
    )


def noise_sweep(df: DataFrame, sigmas: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """(id, variant, vector): the baseline and a noisy copy for each sigma, seeded by id."""
    variants = {"baseline": F.col("vector")} | {f"noise_{s:.2f}": E.noise(F.col("vector"), s, F.col("id")) for s in sigmas}
    return stack_variants(df, variants)


def perturbation_variance_map(variants: DataFrame) -> DataFrame:
    """(id, pos, variance): population variance of each pixel over the variants."""
    return variants.select("id", F.posexplode("vector").alias("pos", "x")).groupBy("id", "pos").agg(F.var_pop("x").alias("variance"))


def pixel_summary(df: DataFrame, pixels: str, shape: str | None = None) -> DataFrame:
    """One row: mean, population deviation, least and largest pixel, 4 places; sums are per row, nothing is exploded."""
    v = F.col(pixels).cast("array<double>")
    rows = df.select(F.size(v).alias("n"), E.total(v).alias("s"), E.total(F.transform(v, lambda x: x * x)).alias("q"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"), (F.concat_ws(" × ", F.col(shape).cast("array<string>")) if shape else F.size(v).cast("string")).alias("shape"))
    row = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("samples"), F.max("shape").alias("shape"), F.count_distinct("shape").alias("shapes"))
    mean = F.col("s") / F.col("n")
    return row.select("samples", "shape", "shapes", F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)), 4).alias("std"), F.round("lo", 4).alias("min"), F.round("hi", 4).alias("max"))


def pixel_moments(df: DataFrame, pixels: str) -> DataFrame:
    """(pos, mean, std) of each pixel over all rows."""
    return df.select(F.posexplode(F.col(pixels).cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
