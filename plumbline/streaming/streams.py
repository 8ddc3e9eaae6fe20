"""Structured Streaming: chains with their heads as state, drift per micro-batch, file triage, windowed verdicts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators import drift, policy, sketches
from plumbline.operators.provenance import event_payload
from plumbline.operators.ranges import scan
from plumbline.operators.triage import triage
from plumbline.session import checkpointed


def stream_ledger(events: DataFrame, late_us: int = 0, idle: str | None = None) -> DataFrame:
    """(chain_id, seq, previous_event_hash, event_hash, status) of a stream of events (chain_id, seq, model_sha256, manifest, ts_us).

    A chain's state is its head, its last seq and a buffer. An event waits in the buffer until the chain has
    seen one that is ``late_us`` later, so events that come out of order by no more than that are
    chained by seq, as the batch form does; nothing overtakes an event of a smaller seq that still waits.
    One whose seq the chain has passed is given out as LATE, without hashes, and not chained. With ``idle``
    (such as "1 hour"), a chain silent for that processing time gives out what its buffer holds; such a
    query always has timers to look at, so it is for continuous triggers, not for availableNow.
    """

    def append(key, parts, state):
        head, last, newest, buffer = state.get if state.exists else (E.GENESIS, None, None, [])
        buffer = [tuple(x) for x in buffer or []]
        out = []
        if not state.hasTimedOut:
            for rows in parts:
                for seq, ts, payload in zip(rows["seq"], rows["ts_us"], rows["payload"], strict=True):
                    if last is not None and seq <= last:
                        out.append((key[0], int(seq), None, None, "LATE"))
                        continue
                    ts = None if pd.isna(ts) else int(ts)
                    newest = ts if newest is None else newest if ts is None else max(newest, ts)
                    buffer.append((int(seq), ts, payload))
        buffer.sort(key=lambda x: (x[0], x[2]))
        ready = len(buffer)
        if not state.hasTimedOut:
            ready = next((i for i, (_, ts, _) in enumerate(buffer) if ts is not None and ts > newest - late_us), len(buffer))
        for seq, _, payload in buffer[:ready]:
            new = hashlib.sha256((head + payload).encode()).hexdigest()
            out.append((key[0], seq, head, new, "APPENDED"))
            head, last = new, seq
        state.update((head, last, newest, buffer[ready:]))
        if idle and ready < len(buffer):
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["chain_id", "seq", "previous_event_hash", "event_hash", "status"])

    rows = events.select("chain_id", F.col("seq").cast("bigint").alias("seq"), F.col("ts_us").cast("bigint").alias("ts_us"), event_payload().alias("payload"))
    schema = f"chain_id {events.schema['chain_id'].dataType.simpleString()}, seq long, previous_event_hash string, event_hash string, status string"
    return rows.groupBy("chain_id").applyInPandasWithState(append, schema, "head string, last long, newest long, buffer array<struct<seq: long, ts: long, payload: string>>", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def stream_drift(live: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], vector: str = "embedding"):
    """A writer that hands each micro-batch's drift against the reference to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(drift.check_input(reference, batch, vector).withColumn("batch", F.lit(number)), number)

    return live.writeStream.foreachBatch(each)


def stream_drift_from_past(live: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], vector: str = "embedding", k: int = 1000):
    """A writer that hands each micro-batch's drift against all batches before it, (dim, ks, error, batch), to ``sink``.

    The past is a table of quantile summaries in ``folder``, shared by the cluster, one version a
    batch: batch n reads version n - 1 and writes version n, so a batch that runs again writes the same
    again. The first batch has no past and gives no rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = checkpointed(sketches.summarise(drift.explode_dims(batch, vector, "live"), k))
        before = spark.read.schema(sketches.SCHEMA).parquet(f"{folder}/past-{number - 1}") if number else spark.createDataFrame([], sketches.SCHEMA)
        sink(sketches.ks_of_sketches(own, before).withColumn("batch", F.lit(number)), number)
        sketches.absorb(before, own, k).write.mode("overwrite").parquet(f"{folder}/past-{number}")

    return live.writeStream.foreachBatch(each)


def windowed_drift(events: DataFrame, ts: str, value: str, width: str = "1 day") -> DataFrame:
    """(window_start, ks): the values of each window against those of all other windows, the batch form of drift over time.

    Between two values of a window its own distribution function stands still and the others' rises,
    so the largest distance lies at one of its own values or just before one: a row for each value of
    each window meets the running count of all values there, and no window meets the values of others.
    """
    counts = events.select(F.window(ts, width).start.alias("dim"), F.col(value).alias("value")).where(F.col("value").isNotNull()).groupBy("dim", "value").agg(F.count("*").alias("l"))
    whole = counts.groupBy("value").agg(F.sum("l").alias("all")).withColumn("one", F.lit(1))
    own = scan(counts, "dim", "value", sums=("l",))
    rows = own.join(scan(whole, "one", "value", sums=("all",)).drop("one"), "value").where("all_total > l_total")

    def gap(upto, all_upto):
        return F.abs(upto / F.col("l_total") - (all_upto - upto) / (F.col("all_total") - F.col("l_total")))

    at, before = gap(F.col("l_upto"), F.col("all_upto")), gap(F.col("l_upto") - F.col("l"), F.col("all_upto") - F.col("all"))
    return rows.groupBy(F.col("dim").alias("window_start")).agg(F.max(F.greatest(at, before)).alias("ks"))


def stream_triage(spark: SparkSession, path: str, profile: str = "Standard") -> DataFrame:
    """Triage of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return triage(files, profile)


def windowed_verdicts(findings: DataFrame, ts: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, n_findings, mean_risk, n_gates) per event-time window; the watermark matters for streams only."""
    rows = findings.withWatermark(ts, late) if findings.isStreaming else findings
    out = rows.groupBy(F.window(ts, width)).agg(F.count("*").alias("n_findings"), F.round(F.avg("risk_score"), 4).alias("mean_risk"), F.count_if(policy.is_hard_gate()).alias("n_gates"))
    return out.select(F.col("window.start").alias("window_start"), "n_findings", "mean_risk", "n_gates")
