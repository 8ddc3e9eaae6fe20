"""Behavioural entropy: samples blended with overlays, scored, and judged by the entropy of the scores."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import exprs as E
from plumbline.operators.scorers import linear_logits
from plumbline.session import checkpointed, sized

TRIGGER = 0.35
#: Overlays that may be broadcast.
OVERLAYS = 10_000


def pair_with_overlays(samples: DataFrame, overlays: DataFrame, n_overlays: int, draws: int = 20) -> DataFrame:
    """(id, k, sample, overlay): each sample with ``draws`` overlays, drawn with replacement by hash.

    ``overlays`` is (position, overlay) with positions 0..n_overlays-1.
    """
    drawn = _drawn(samples.select("id", F.col("vector").alias("sample")), n_overlays, draws)
    return drawn.join(sized(overlays, OVERLAYS), "position").select("id", "k", "sample", "overlay")


def _drawn(samples: DataFrame, n_overlays: int, draws: int) -> DataFrame:
    """``samples`` ``draws`` times, k = 0, 1, ..., each with the position of the overlay it draws."""
    drawn = samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return drawn.withColumn("position", E.hash_pick(F.col("id"), F.col("k"), F.lit(n_overlays)))


def score_blends(samples: DataFrame, overlays: DataFrame, n_overlays: int, weights: DataFrame, draws: int = 20, alpha: float = 0.5) -> DataFrame:
    """(id, k, probs) of every blend under a linear scorer.

    The logits of a blend are the blend of the logits, so samples and overlays are scored once each
    and only those short arrays are paired.
    """
    own = linear_logits(samples.select("id", "vector"), weights, "vector").select("id", F.col("logits").alias("own"))
    over = linear_logits(overlays.select("position", "overlay"), weights, "overlay").select("position", F.col("logits").alias("over"))
    paired = _drawn(own, n_overlays, draws).join(sized(checkpointed(over), OVERLAYS), "position")
    return paired.select("id", "k", E.softmax(E.blend(F.col("own"), F.col("over"), alpha)).alias("probs"))


def blends(pairs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, k, vector) of every blend, as one table."""
    return pairs.select("id", "k", E.blend(F.col("sample"), F.col("overlay"), alpha).alias("vector"))


def sample_entropy(scored: DataFrame) -> DataFrame:
    """Per sample: mean, least and largest entropy in bits, and the classes of its first five variants."""
    with_entropy = scored.select("id", "k", E.entropy_bits(F.col("probs")).alias("h"), E.argmax(F.col("probs")).alias("cls"))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("k", "cls"))), 1, 5), lambda x: x["cls"])
    return with_entropy.groupBy("id").agg(F.avg("h").alias("mean_entropy"), F.min("h").alias("min_entropy"), F.max("h").alias("max_entropy"), first.alias("top_classes"))


def entropy_overall(scored: DataFrame, trigger: float = TRIGGER, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (one of each ``by``): mean, population deviation and least entropy over all variants; triggered below ``trigger``."""
    h = scored.select(*by, E.entropy_bits(F.col("probs")).alias("h"))
    row = h.groupBy(*by).agg(F.avg("h").alias("mean_entropy"), F.stddev_pop("h").alias("std_entropy"), F.min("h").alias("min_entropy"), F.count("*").alias("variants"))
    return row.withColumn("triggered", F.coalesce(F.col("mean_entropy") < trigger, F.lit(False)))


def trojan_finding(overall: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The finding of an ``entropy_overall`` row: a hard gate of risk 95, or clean at 5."""
    hit = F.col("triggered")
    return overall.select(
        *by,
        F.lit("EntropyDetector").alias("detector_id"),
        F.when(hit, "TROJAN_BEHAVIOR_INDICATOR").otherwise("TROJAN_BEHAVIOR_CLEAN").alias("finding_type"),
        F.when(hit, 95.0).otherwise(5.0).alias("risk_score"),
        F.lit("HIGH").alias("evidence_strength"),
        F.when(hit, "High-Strength Trojan Indicator").otherwise("Trojan Behavioral Analysis Passed").alias("title"),
        F.format_string("Mean entropy %.4f bits over %d variants.", F.col("mean_entropy"), F.col("variants")).alias("explanation"),
        hit.alias("is_hard_gate"),
    )


def strip_scan(samples: DataFrame, overlays: DataFrame, n_overlays: int, weights: DataFrame, draws: int = 20, alpha: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per sample, overall, finding) under a linear scorer."""
    scored = checkpointed(score_blends(samples, overlays, n_overlays, weights, draws, alpha))
    overall = entropy_overall(scored)
    return sample_entropy(scored), overall, trojan_finding(overall)


#: Numbers that the scorers and their overlays' logits may hold together to be broadcast.
BROADCAST_CELLS = 4_000_000
#: Samples whose blends a task scores: a few bytes of a sample make many blends, so these are dealt by their number.
TASK_SAMPLES = 256


def strip_by_model(samples: DataFrame, overlays: DataFrame, n_overlays: int, weights: DataFrame, draws: int = 20, alpha: float = 0.5) -> DataFrame:
    """The finding of each model of ``weights`` (model_id, label, centroid), keyed by model_id; ``overall_by_model`` says how."""
    return trojan_finding(overall_by_model(samples, overlays, n_overlays, weights, draws, alpha), ("model_id",))


def scorer_digests(weights: DataFrame) -> DataFrame:
    """(model_id, scorer): a digest of each model's weights (model_id, label, centroid), equal where these are.

    Each centroid is digested where it stands, so no weights are shuffled.
    """

    def digest(batches):
        for rows in batches:
            column = rows.column(2)
            flat = column.flatten()
            body = memoryview(np.ascontiguousarray(flat.fill_null(0.0).to_numpy(zero_copy_only=False), dtype=np.float64)).cast("B")
            gaps = flat.is_null().to_numpy(zero_copy_only=False)  # where a component is null; a row's digest must not hang on its batch
            found, at = [], 0
            for n in column.value_lengths().to_pylist():
                if n is None:
                    found.append(None)
                    continue
                own = hashlib.sha256(body[8 * at : 8 * (at + n)])
                if flat.null_count and gaps[at : at + n].any():
                    own.update(gaps[at : at + n].tobytes())
                found.append(own.digest())
                at += n
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.binary())], names=["model_id", "label", "digest"])

    schema = T.StructType([weights.schema["model_id"], weights.schema["label"], T.StructField("digest", T.BinaryType())])
    rows = weights.select("model_id", "label", E.doubles(F.col("centroid")).alias("c")).mapInArrow(digest, schema)
    return rows.groupBy("model_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("label", "digest")))), 256).alias("scorer"))


def overall_by_model(samples: DataFrame, overlays: DataFrame, n_overlays: int, weights: DataFrame, draws: int = 20, alpha: float = 0.5, trigger: float = TRIGGER) -> DataFrame:
    """The ``entropy_overall`` row of each model.

    The logits of a blend are the blend of the logits. So a scorer meets every sample and every overlay
    once; a scorer's overlays are one short array of logits, and a sample's blends are made of two short
    arrays inside its own row, which sends the sums of their entropies on. Models of equal weights are
    scored once, under the weights of the first of them; the others' are only digested. Scorers are broadcast while they and their overlays hold at most ``BROADCAST_CELLS`` numbers.
    """
    each = checkpointed(scorer_digests(weights))
    first = checkpointed(each.groupBy("scorer").agg(F.min("model_id").alias("first")))
    same = F.col("model_id").eqNullSafe(F.col("first"))
    own = weights.select("model_id", "label", "centroid").join(sized(first), same, "left_semi").join(sized(first), same)  # a semi-join goes before the making of weights
    scorers = checkpointed(own.groupBy("scorer").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("w")))
    logits = lambda vector: E.let(E.doubles(F.col(vector)), lambda v: F.transform("w", lambda w: E.dot(v, w["centroid"])))
    over = overlays.select("position", "overlay").crossJoin(scorers).select("scorer", F.struct("position", logits("overlay").alias("l")).alias("o"))
    over = over.groupBy("scorer").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["l"]).alias("over"))
    sets = checkpointed(scorers.join(over, "scorer"))
    size = sets.agg(F.max(F.size("w") * (F.size(F.col("w")[0]["centroid"]) + n_overlays))).first()[0] or 1
    dealt = samples.select("id", "vector").repartition(samples.count() // TASK_SAMPLES + 1)
    own = dealt.crossJoin(sized(sets, max(1, BROADCAST_CELLS // size)))
    own = own.select("scorer", "id", "over", logits("vector").alias("own"))

    def entropies(over, own):
        picked = lambda k: F.element_at(over, (E.hash_pick(F.col("id"), k, F.lit(n_overlays)) + 1).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: E.entropy_bits(E.softmax(E.blend(own, picked(k), alpha))))

    h = own.select("scorer", entropies(F.col("over"), F.col("own")).alias("h"))
    h = h.select("scorer", F.size("h").alias("n"), E.total(F.col("h")).alias("s"), E.total(F.transform("h", lambda x: x * x)).alias("q"), F.array_min("h").alias("low"))
    row = h.groupBy("scorer").agg(F.sum("n").alias("variants"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("min_entropy"))
    mean = F.col("s") / F.col("variants")
    row = row.select("scorer", "variants", mean.alias("mean_entropy"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("variants") - mean * mean)).alias("std_entropy"), "min_entropy")
    out = each.select("model_id", "scorer").join(row, "scorer", "left")
    return out.select("model_id", "mean_entropy", "std_entropy", "min_entropy", F.coalesce("variants", F.lit(0)).alias("variants"), F.coalesce(F.col("mean_entropy") < trigger, F.lit(False)).alias("triggered"))
