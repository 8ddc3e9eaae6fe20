"""Input triage: formats by leading bytes, resource limits from headers before any decoding, image hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E

#: Largest side, pixels and bytes of each profile.
PROFILES = {"Standard": (4096, 16_000_000, 10_485_760), "Demo": (2048, 4_000_000, 5_242_880)}


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG header, without decoding; null for others."""
    png = E.head_hex(content).startswith("89504E470D0A1A0A") & (F.length(content) >= 24)
    number = lambda at: F.when(png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint"))
    return number(17), number(21)


def gate_resource_profile(rows: DataFrame, profile: str | Column = "Standard") -> DataFrame:
    """Rows (length, width, height) with ``reason``, null where all limits hold; cheap checks come first."""
    name = F.lit(profile) if isinstance(profile, str) else profile
    pick = lambda i: F.coalesce(*(F.when(name == p, F.lit(v[i])) for p, v in PROFILES.items()), F.lit(PROFILES["Standard"][i]))
    side, pixels, size = pick(0), pick(1), pick(2)
    reason = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("length") > size, "file size exceeds the limit")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "image has no pixels")
        .when(F.greatest("width", "height") > side, "image dimension exceeds the limit")
        .when(F.col("width") * F.col("height") > pixels, "pixel count exceeds the limit")
    )
    return rows.withColumn("reason", reason)


def classify_rejection(reasons: Column) -> Column:
    """REJECTED_RESOURCE_LIMIT where some reason speaks of exceeding, else REJECTED_MALFORMED_IMAGE."""
    return F.when(F.exists(reasons, lambda r: F.lower(r).contains("exceed")), "REJECTED_RESOURCE_LIMIT").otherwise("REJECTED_MALFORMED_IMAGE")


def rejection_risk(kind: Column) -> Column:
    return F.when(kind == "REJECTED_RESOURCE_LIMIT", 0.0).otherwise(100.0)


def triage(files: DataFrame, profile: str = "Standard") -> DataFrame:
    """(path, length, sha256, format, width, height, status, finding_type, risk_score) of binary files.

    Size is judged on file metadata; only files within it have their content looked at.
    """
    limit = PROFILES[profile][2]
    seen = F.when((F.col("length") > 0) & (F.col("length") <= limit), F.col("content"))
    width, height = png_size(seen)
    rows = files.select("path", "length", F.sha2(seen, 256).alias("sha256"), F.when(seen.isNotNull(), E.sniff_format(E.head_hex(seen))).alias("format"), width.alias("width"), height.alias("height"))
    rows = gate_resource_profile(rows, profile)
    foreign = F.col("format").startswith("REJECTED") | (F.col("format") == "UNKNOWN")
    reasons = F.filter(F.array("reason", F.when(foreign, F.concat(F.lit("unsupported format "), "format"))), lambda r: r.isNotNull())
    rejected = F.size(reasons) > 0
    kind = F.when(rejected, classify_rejection(reasons))
    return rows.select(
        "path", "length", "sha256", "format", "width", "height", reasons.alias("reasons"),
        F.when(rejected, "REJECTED").otherwise("UNGUARANTEED").alias("status"),
        F.coalesce(kind, F.lit("UNGUARANTEED_NO_CALIBRATION")).alias("finding_type"),
        F.when(rejected, rejection_risk(kind)).otherwise(0.0).alias("risk_score"),
    )


def image_hashes(samples: DataFrame, side: int, width: int = 9, height: int = 8) -> DataFrame:
    """(id, hash): pixels resized by fixed triangle weights to width x height, then the 64-bit difference hash as hex (``exprs.hash_of_hex`` makes it a number)."""
    across, down = np.array(E.resize_weights(side, width)), np.array(E.resize_weights(side, height))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, side, side)
            small = np.einsum("hy,nyx,wx->nhw", down, x, across)
            bits = (small[:, :, :-1] > small[:, :, 1:]).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.packbits(b).tobytes().hex() for b in bits], pa.string())], names=["id", "hash"])

    return samples.select("id", E.doubles(F.col("pixels")).alias("pixels")).mapInArrow(run, "id long, hash string")
