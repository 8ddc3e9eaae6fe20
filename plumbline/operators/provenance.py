"""Digests, hash chains, certificates and their audits, for many subjects at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions import exprs as E
from plumbline.operators.ranges import scan

SIGNER = "assurance-engine"
QR_VERSION = "QR-v1"


def dataset_digest(df: DataFrame, row: Column, key: Column, buckets: int | None = None) -> DataFrame:
    """One row (n, digest): rows hashed, hashes put in order within hash buckets, buckets hashed in order.

    The order of rows does not matter, repeated rows do. A bucket's hashes meet in one task, so there
    are 256 buckets up to 256 million rows and twice as many for each doubling beyond.
    """
    if buckets is None:
        buckets = 256 << max(0, (df.count() >> 28).bit_length())
    digits = 4 if buckets <= 1 << 16 else 8
    hashed = df.select(F.sha2(row, 256).alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, digits), 16, 10).cast("bigint") % buckets)
    parts = hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("d"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"])), 256).alias("digest"))


def provenance_manifest(runs: DataFrame) -> DataFrame:
    """Eight hashes per run; each column of ``runs`` but run_id is the canonical text of its part."""
    parts = ("dataset", "model", "config", "preprocess", "runtime", "input", "output", "engine")
    return runs.select("run_id", *(F.sha2(F.col(p).cast("string"), 256).alias(f"{p}_hash") for p in parts))


def event_payload() -> Column:
    """What an event's hash covers beside its predecessor: everything but its findings summary."""
    return E.canonical_json({"model_sha256": E.json_text(F.col("model_sha256")), "provenance_manifest": E.json_text(F.col("manifest")), "timestamp": F.col("ts_us").cast("string")})


def _link(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def build_chain(events: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Events (chain, seq, model_sha256, manifest, ts_us) with previous_event_hash and event_hash.

    A hash needs the one before, so one chain is folded in one task, row by row in the order of seq
    (sorting spills, the fold holds one hash); chains spread.
    """
    return _folded(events.withColumn("head", F.lit(E.GENESIS)), chain)


def _folded(events: DataFrame, chain: str) -> DataFrame:
    """Events linked from the ``head`` of their chain on, which is taken out."""
    kept = [c for c in events.columns if c != "head"]
    rows = events.select(*kept, F.col("head").alias("__head"), event_payload().alias("__payload"))
    schema = StructType([*(events.schema[c] for c in kept), StructField("previous_event_hash", StringType()), StructField("event_hash", StringType())])
    at = kept.index(chain)

    def fold(batches):
        current, last = object(), ""
        for batch in batches:
            before, after = [], []
            for key, head, payload in zip(*(batch.column(i).to_pylist() for i in (at, len(kept), len(kept) + 1)), strict=True):
                if key != current:
                    current, last = key, head
                before.append(last)
                last = hashlib.sha256((last + payload).encode()).hexdigest()
                after.append(last)
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "previous_event_hash", "event_hash"])

    return rows.repartition(chain).sortWithinPartitions(chain, "seq").mapInArrow(fold, schema)


def validate_events(events: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Each event with its ``line`` in the chain (from 1) and ``code``, null where it is right, else the first check that fails.

    Each link is held against the stored hash before it, so events are checked independently, and one
    long chain is checked in ranges. Columns:
    parsed (null: no JSON), is_object, has_fields, model_sha256, manifest, ts_us, hashes, seq.
    """
    rows = scan(events.withColumn("__one", F.lit(1)), chain, "seq", sums=("__one",), lags=("event_hash",), maxima=("ts_us",))
    rows = rows.withColumns({"expected": F.coalesce("event_hash_lag", F.lit(E.GENESIS)), "latest": F.coalesce("ts_us_before", F.lit(0)), "line": F.col("__one_upto")})
    code = (
        F.when(~F.coalesce("parsed", F.lit(False)), "MALFORMED_JSON_LINE")
        .when(~F.coalesce("is_object", F.lit(False)), "INVALID_RECORD_FORMAT")
        .when(~F.coalesce("has_fields", F.lit(False)), "MISSING_REQUIRED_FIELD")
        .when(~F.coalesce(F.col("model_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "INVALID_MODEL_SHA256")
        .when(~F.col("previous_event_hash").eqNullSafe(F.col("expected")), "BROKEN_CHAIN_LINK")
        .when(~F.col("event_hash").eqNullSafe(_link(F.col("previous_event_hash"), event_payload())), "INCORRECT_EVENT_HASH")
        .when(F.col("ts_us") < F.col("latest"), "EVENT_ORDERING_ERROR")
    )
    return rows.select(*events.columns, "line", code.alias("code"))


def well_formed(events: DataFrame) -> DataFrame:
    """Events that come as columns: they parsed, are objects and have their fields."""
    return events.withColumns({c: F.lit(True) for c in ("parsed", "is_object", "has_fields")})


def validate_chain(events: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Per chain: status with the first failing line, and the events verified before it."""
    checked = validate_events(events, chain)
    first = checked.groupBy(chain).agg(F.count("*").alias("n"), F.min(F.when(F.col("code").isNotNull(), F.struct("line", "code"))).alias("bad"))
    good = F.concat(F.lit("VALID_AUDIT_CHAIN ("), F.col("n").cast("string"), F.lit(" events verified)"))
    status = F.when(F.col("bad").isNull(), good).otherwise(F.concat(F.col("bad.code"), F.lit(" (Line "), F.col("bad.line").cast("string"), F.lit(")")))
    return first.select(chain, status.alias("status"), F.col("bad").isNull().alias("valid"), F.coalesce(F.col("bad.line") - 1, F.col("n")).cast("bigint").alias("verified"))


def chain_head(events: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Per chain: the hash of its last event before the first failing one; the genesis hash if there is none."""
    checked = validate_events(events, chain)
    bad = checked.groupBy(chain).agg(F.min(F.when(F.col("code").isNotNull(), F.col("seq"))).alias("first_bad"))
    rows = checked.join(bad, chain)
    within = F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))
    return rows.groupBy(chain).agg(F.coalesce(F.max_by(F.when(within, F.col("event_hash")), F.when(within, F.col("seq"))), F.lit(E.GENESIS)).alias("head"))


def checkpoint_payload() -> Column:
    """The four-field compact payload of an event; missing parts have their defaults."""
    return E.canonical_json({
        "event_hash": E.json_text(F.coalesce("event_hash", F.lit(""))),
        "model_sha256": E.json_text(F.coalesce("model_sha256", F.lit(""))),
        "previous_event_hash": E.json_text(F.coalesce("previous_event_hash", F.lit(E.GENESIS))),
        "timestamp": F.coalesce(F.col("ts_us").cast("string"), F.lit("0")),
    })


def checkpoints(events: DataFrame) -> DataFrame:
    """Events with ``checkpoint_payload`` and its digest; a signature column is the caller's."""
    return events.withColumn("checkpoint_payload", checkpoint_payload()).withColumn("checkpoint_hash", F.sha2("checkpoint_payload", 256))


Verifier = Callable[[Column, Column], Column]


def _digest_signature(payload: Column, signature: Column) -> Column:
    """The default hook: a signature is the digest of signer and payload. Replace it by real cryptography."""
    return signature == F.sha2(F.concat(F.lit(SIGNER), payload), 256)


def sign(payload: Column) -> Column:
    return F.sha2(F.concat(F.lit(SIGNER), payload), 256)


def verify_checkpoints(rows: DataFrame, verify: Verifier = _digest_signature) -> DataFrame:
    """Rows with ``checkpoint_status``: FAILED without signature, else VALID or INVALID by the hook."""
    good = F.coalesce(verify(checkpoint_payload(), F.col("signature")), F.lit(False))
    return rows.withColumn("checkpoint_status", F.when(F.coalesce("signature", F.lit("")) == "", "FAILED").when(good, "VALID").otherwise("INVALID"))


def certificate_payload(verdicts: DataFrame) -> DataFrame:
    """Verdict rows (subject_id, verdict, risk_score, evidence_strength, hard_gate_fired, hard_gates, model_sha256) as certificates.

    The canonical payload has sorted keys and compact separators; risk is in hundredths, so that all
    engines write it alike.
    """
    listed = F.concat(F.lit("["), F.array_join(F.transform("hard_gates", E.json_text), ","), F.lit("]"))
    payload = E.canonical_json({
        "evidence_strength": E.json_text(F.col("evidence_strength")),
        "hard_gate_fired": F.col("hard_gate_fired").cast("string"),
        "hard_gates_triggered": listed,
        "model_sha256": E.json_text(F.col("model_sha256")),
        "risk_hundredths": F.round(F.col("risk_score") * 100).cast("bigint").cast("string"),
        "verdict": E.json_text(F.col("verdict")),
    })
    rows = verdicts.withColumn("canonical_payload", payload)
    return rows.select("subject_id", "verdict", "model_sha256", "canonical_payload", F.sha2("canonical_payload", 256).alias("cert_hash"), sign(F.col("canonical_payload")).alias("signature"), F.lit(SIGNER).alias("signer_identity"))


def audit_certificates(certs: DataFrame, verify: Verifier = _digest_signature, signer: str = SIGNER) -> DataFrame:
    """Certificates (cert_id, canonical_payload, signature, signer_identity, cert_hash, model_sha256, verdict) with ``status``.

    The checks go in order; a missing expected value skips its check.
    """
    claim = lambda field: F.get_json_object("canonical_payload", f"$.{field}")
    differs = lambda expected, actual: expected.isNotNull() & (expected != "") & ~expected.eqNullSafe(actual)
    status = (
        F.when(F.coalesce("canonical_payload", F.lit("")) == "", "MISSING_CANONICAL_PAYLOAD")
        .when(F.coalesce("signature", F.lit("")) == "", "MISSING_SIGNATURE")
        .when(F.col("signer_identity").isNotNull() & (F.col("signer_identity") != signer), "INVALID_SIGNER_IDENTITY")
        .when(differs(F.col("cert_hash"), F.sha2("canonical_payload", 256)), "CERT_HASH_MISMATCH")
        .when(differs(F.col("model_sha256"), claim("model_sha256")), "MODEL_HASH_MISMATCH")
        .when(differs(F.col("verdict"), claim("verdict")), "VERDICT_MISMATCH")
        .when(~F.coalesce(verify(F.col("canonical_payload"), F.col("signature")), F.lit(False)), "INVALID_SIGNATURE")
        .otherwise("VALID (Authentic Signed Certificate)")
    )
    return certs.withColumn("status", status)


def parse_certificates(raw: DataFrame, qr_version: str = QR_VERSION) -> DataFrame:
    """(cert_id, layout, status, fields ...) of raw JSON texts (cert_id, raw): the first of four layouts that fits.

    ``status`` is null where the text is fit for ``audit_certificates``. Payload texts are kept as
    written, so they must be canonical.
    """
    field = lambda path: F.get_json_object("raw", f"$.{path}")
    parsed = F.expr("try_parse_json(raw)")
    is_object = F.expr("schema_of_variant(try_parse_json(raw)) like 'OBJECT%'")
    layout = (
        F.when(field("spec_version") == qr_version, "QR_PAYLOAD")
        .when(field("canonical_payload").isNotNull() & field("signature").isNotNull(), "FULL_JSON_CERTIFICATE")
        .when(field("signed_checkpoint").isNotNull(), "SIGNED_CHECKPOINT")
        .when(field("qr_payload").startswith("{"), "EMBEDDED_QR_PAYLOAD")
    )
    rows = raw.withColumn("layout", layout)
    pick = lambda **by: F.coalesce(*(F.when(F.col("layout") == name, value) for name, value in by.items()), F.lit(None).cast("string"))
    return rows.select(
        "cert_id", "layout",
        F.when(parsed.isNull(), "MALFORMED_INPUT_JSON").when(~F.coalesce(is_object, F.lit(False)), "INVALID_INPUT_TYPE").when(F.col("layout").isNull(), "UNRECOGNIZED_FORMAT").alias("parse_status"),
        pick(QR_PAYLOAD=field("canonical_payload"), FULL_JSON_CERTIFICATE=field("canonical_payload"), SIGNED_CHECKPOINT=field("signed_checkpoint.checkpoint_payload"), EMBEDDED_QR_PAYLOAD=F.coalesce(field("qr_payload.canonical_payload"), field("canonical_payload"))).alias("canonical_payload"),
        pick(QR_PAYLOAD=field("signature"), FULL_JSON_CERTIFICATE=field("signature"), SIGNED_CHECKPOINT=field("signed_checkpoint.signature"), EMBEDDED_QR_PAYLOAD=F.coalesce(field("qr_payload.signature"), field("signature"))).alias("signature"),
        pick(QR_PAYLOAD=field("signer_identity"), FULL_JSON_CERTIFICATE=F.coalesce(field("certificate_header.signer_identity"), field("signer_identity")), SIGNED_CHECKPOINT=field("signed_checkpoint.signer"), EMBEDDED_QR_PAYLOAD=field("qr_payload.signer_identity")).alias("signer_identity"),
        pick(QR_PAYLOAD=field("cert_hash"), FULL_JSON_CERTIFICATE=F.coalesce(field("certificate_header.cert_hash"), field("cert_hash")), EMBEDDED_QR_PAYLOAD=field("qr_payload.cert_hash")).alias("cert_hash"),
        pick(QR_PAYLOAD=field("model_sha256"), EMBEDDED_QR_PAYLOAD=field("qr_payload.model_sha256")).alias("model_sha256"),
        pick(QR_PAYLOAD=field("verdict"), EMBEDDED_QR_PAYLOAD=field("qr_payload.verdict")).alias("verdict"),
    )


def log_inferences(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows (chain_id, seq, ...) with ``log_status``: rejected where their chain is broken."""
    chains = validate_chain(ledger).select("chain_id", "valid")
    joined = batch.join(chains, "chain_id", "left")
    return joined.withColumn("log_status", F.when(F.coalesce("valid", F.lit(True)), "LOGGED").otherwise("REJECTED_BROKEN_CHAIN")).drop("valid")


def append_inferences(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The events that ``batch`` (chain_id, seq, model_sha256, manifest, ts_us) adds to ``ledger``, linked behind their chains' last events.

    A chain that is broken takes none; a chain that the ledger lacks begins at the genesis hash.
    Batch rows are numbered on in the order of their seq, so the result can be written behind the ledger.
    """
    good = log_inferences(ledger, batch).where("log_status = 'LOGGED'").drop("log_status")
    heads = ledger.groupBy("chain_id").agg(F.max_by("event_hash", "seq").alias("head"), F.max("seq").alias("last"))
    good = good.join(heads, "chain_id", "left")
    order = F.row_number().over(Window.partitionBy("chain_id").orderBy("seq"))
    good = good.withColumn("seq", (F.coalesce("last", F.lit(-1)) + order).cast("bigint")).withColumn("head", F.coalesce("head", F.lit(E.GENESIS))).drop("last")
    return _folded(good, "chain_id")
