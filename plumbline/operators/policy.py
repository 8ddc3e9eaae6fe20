"""Findings to verdicts: mean risk, strongest evidence, hard gates, and thresholds by profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRENGTHS = ("LOW", "MEDIUM", "HIGH")
#: Finding types that are hard gates by themselves, and a title that is.
HARD_GATE_TYPES = ("MANIFEST_MISMATCH", "INVALID_FILE_FORMAT", "UNSAFE_SERIALIZATION_INDICATOR", "BROKEN_AUDIT_CHAIN", "TROJAN_BEHAVIOR_INDICATOR", "ONNX_GRAPH_FIREWALL")
HARD_GATE_TITLE = "High-Strength Trojan Indicator"
REVIEW_AT, GATED_RISK = 50.0, 95.0


def union_findings(*tables: DataFrame) -> DataFrame:
    """All findings in order of source, then of their own ``pos`` if they have one."""
    marked = [t.withColumn("source_pos", F.lit(i)) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def aggregate_evidence(findings: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Per subject: mean risk over all findings, 2 places, and the strongest evidence."""
    rank = reduce(lambda w, s: w.when(F.col("evidence_strength") == s, STRENGTHS.index(s) + 1), STRENGTHS, F.when(F.lit(False), 0))
    row = findings.groupBy(subject).agg(F.round(F.avg("risk_score"), 2).alias("mean_risk"), F.max(rank).alias("rank"), F.count("*").alias("n_findings"))
    return row.select(subject, "n_findings", "mean_risk", F.coalesce(F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("rank")), F.lit("LOW")).alias("evidence_strength"))


def is_hard_gate():
    return F.coalesce(F.col("is_hard_gate"), F.lit(False)) | F.coalesce(F.col("finding_type").isin(*HARD_GATE_TYPES), F.lit(False)) | F.coalesce(F.col("title") == HARD_GATE_TITLE, F.lit(False))


def collect_hard_gates(findings: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Per subject with fired gates: their titles in order of ``pos``."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"])
    return findings.where(is_hard_gate()).groupBy(subject).agg(titles.alias("hard_gates"))


def evaluate_policy(findings: DataFrame, subject: str = "subject_id", review_at: float = REVIEW_AT) -> DataFrame:
    """Per subject: verdict, risk, strength and fired gates. A gate quarantines and raises the risk to 95 at least."""
    joined = aggregate_evidence(findings, subject).join(collect_hard_gates(findings, subject), subject, "left")
    gated = F.col("hard_gates").isNotNull()
    return joined.select(
        subject, "n_findings",
        F.when(gated, "QUARANTINE").when(F.col("mean_risk") >= review_at, "REVIEW").otherwise("ACCEPT").alias("verdict"),
        F.when(gated, F.greatest(F.col("mean_risk"), F.lit(GATED_RISK))).otherwise(F.col("mean_risk")).alias("risk_score"),
        "evidence_strength", gated.alias("hard_gate_fired"), F.coalesce("hard_gates", F.array().cast("array<string>")).alias("hard_gates"),
    )


def broken_chain_finding(chains: DataFrame) -> DataFrame:
    """A hard-gate finding for each chain (subject_id, status) that does not validate."""
    bad = ~(F.col("status").startswith("VALID"))
    return chains.where(bad).select("subject_id", F.lit(-1).alias("pos"), F.lit("BROKEN_AUDIT_CHAIN").alias("finding_type"), F.lit("Broken Audit Ledger Chain").alias("title"), F.lit(100.0).alias("risk_score"), F.lit("HIGH").alias("evidence_strength"), F.lit(True).alias("is_hard_gate"))


#: Our own definition of profiles: mean risk at which a subject is reviewed and at which it is quarantined.
PROFILES = {"enterprise": (50.0, 90.0), "healthcare": (40.0, 75.0), "defense": (25.0, 60.0)}


def profile_policy(findings: DataFrame, profiles: dict[str, tuple[float, float]] | None = None, subject: str = "subject_id") -> DataFrame:
    """(subject, profile, verdict): the policy under each profile's thresholds; gates quarantine under all."""
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("profile"), F.lit(a).alias("review_at"), F.lit(b).alias("quarantine_at")) for n, (a, b) in (profiles or PROFILES).items())))
    rows = evaluate_policy(findings, subject).withColumn("p", table)
    return rows.select(subject, F.col("p.profile").alias("profile"), F.when(F.col("hard_gate_fired") | (F.col("risk_score") >= F.col("p.quarantine_at")), "QUARANTINE").when(F.col("risk_score") >= F.col("p.review_at"), "REVIEW").otherwise("ACCEPT").alias("verdict"))
