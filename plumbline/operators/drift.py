"""Distribution drift: two-sample Kolmogorov-Smirnov and Wasserstein distances for each dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranges import scan

ELEVATED, HIGH = 0.25, 0.50


def explode_dims(df: DataFrame, vector: str, side: str) -> DataFrame:
    """(dim, value, side) rows of a vector column."""
    return df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "value")).withColumn("side", F.lit(side))


def ecdf(values: DataFrame) -> DataFrame:
    """(dim, value, f_ref, f_live, next_value): both empirical distribution functions at every observed value.

    Equal values are counted first, so sums run over distinct values, in ranges that spread over tasks.
    """
    counts = values.groupBy("dim", "value").agg(F.count(F.when(F.col("side") == "ref", 1)).alias("r"), F.count(F.when(F.col("side") == "live", 1)).alias("l"))
    summed = scan(counts, "dim", "value", sums=("r", "l"), lead=True).where("r_total > 0 and l_total > 0")
    return summed.select("dim", "value", (F.col("r_upto") / F.col("r_total")).alias("f_ref"), (F.col("l_upto") / F.col("l_total")).alias("f_live"), F.col("next").alias("next_value"))


def ks_per_dim(values: DataFrame) -> DataFrame:
    """(dim, ks): the largest distance of the two distribution functions."""
    return ecdf(values).groupBy("dim").agg(F.max(F.abs(F.col("f_ref") - F.col("f_live"))).alias("ks"))


def wasserstein_per_dim(values: DataFrame) -> DataFrame:
    """(dim, distance): the area between the two distribution functions."""
    gap = F.abs(F.col("f_ref") - F.col("f_live")) * (F.coalesce("next_value", "value") - F.col("value"))
    return ecdf(values).groupBy("dim").agg(F.sum(gap).alias("distance"))


def drift_score(ks: DataFrame) -> DataFrame:
    """One row: mean, largest and smallest statistic, status and finding. Drift is never a hard gate."""
    row = ks.agg(F.avg("ks").alias("mean_ks"), F.max("ks").alias("max_ks"), F.min("ks").alias("min_ks"), F.count("*").alias("dims"))
    status = F.when(F.col("mean_ks") >= HIGH, "HIGH").when(F.col("mean_ks") >= ELEVATED, "ELEVATED").otherwise("NORMAL")
    row = row.withColumn("status", status)
    by = lambda high, elevated, normal: F.when(F.col("status") == "HIGH", high).when(F.col("status") == "ELEVATED", elevated).otherwise(normal)
    return row.select(
        "dims", F.round("mean_ks", 4).alias("mean_ks"), F.round("max_ks", 4).alias("max_ks"), F.round("min_ks", 4).alias("min_ks"), "status",
        F.concat(F.lit("INPUT_DISTRIBUTION_DRIFT_"), F.col("status")).alias("finding_type"), by(70.0, 40.0, 0.0).alias("risk_score"), by("HIGH", "MEDIUM", "HIGH").alias("evidence_strength"), F.lit(False).alias("is_hard_gate"),
    )


def dim_means(values: DataFrame, dims: int = 10) -> DataFrame:
    """(dim, mean_ref, mean_live) of the first dimensions, 4 places."""
    mean = lambda side: F.round(F.avg(F.when(F.col("side") == side, F.col("value"))), 4)
    return values.where(F.col("dim") < dims).groupBy("dim").agg(mean("ref").alias("mean_ref"), mean("live").alias("mean_live"))


def check_input(reference: DataFrame | None, live: DataFrame, vector: str = "embedding") -> DataFrame:
    """Drift of ``live`` against ``reference``; against itself where there is none."""
    values = explode_dims(reference if reference is not None else live, vector, "ref").unionByName(explode_dims(live, vector, "live"))
    return drift_score(ks_per_dim(values))
