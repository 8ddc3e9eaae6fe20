"""Every query of the assurance operators over the given tables, with its DuckDB SQL.

The tables stand in for the operators' inputs: embeddings are samples of 8 x 8 pixels, vectors and
classifier inputs; events are findings, ledger events, model nodes and inference logs; documents are
artifacts; part and lineitem give input dimensions. Floats are rounded alike in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import counter
from plumbline.functions import exprs as E
from plumbline.operators import anomalies, drift, duplicates, embedders, entropy, generators, inventory, policy, provenance, scorers, stability, triage
from plumbline.plans import pipelines
from plumbline.session import checkpointed, ensure_checkpoint_dir, table
from plumbline.sources import arrays, readers
from plumbline.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) and the SQL of the same result."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


# ------------------------------------------------------------ inputs


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    """(dim, value, side): even ids are the reference, odd ones live."""
    rows = _embeddings(spark, sf).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value"))
    return rows.select("dim", "value", F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("live").alias("side"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """(id, pixels, hash): embeddings and copies of every fiftieth with one pixel moved."""
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pixels"))
    moved = F.transform("pixels", lambda x, i: F.when(i == 10, x + 0.25).otherwise(x))
    copies = rows.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), moved.alias("pixels"))
    return rows.unionByName(copies).withColumn("hash", E.dhash(F.col("pixels"), 8, 8))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "TROJAN_BEHAVIOR_INDICATOR").when(F.col("event_type") == "signup", "MANIFEST_MISMATCH").otherwise(F.upper("event_type"))
    return _events(spark, sf).select(
        F.col("user_id").alias("subject_id"), F.col("event_id").alias("pos"), kind.alias("finding_type"), F.concat_ws(" ", F.lit("Finding"), F.col("event_type"), (F.col("event_id") % 7).cast("string")).alias("title"),
        F.least(F.col("value"), F.lit(100.0)).alias("risk_score"), F.when(F.col("value") > 100, "HIGH").when(F.col("value") > 30, "MEDIUM").otherwise("LOW").alias("evidence_strength"), (F.col("value") > 400).alias("is_hard_gate"), "ts",
    )


_FINDINGS = """findings AS (
  SELECT user_id AS subject_id, event_id AS pos, CASE event_type WHEN 'error' THEN 'TROJAN_BEHAVIOR_INDICATOR' WHEN 'signup' THEN 'MANIFEST_MISMATCH' ELSE upper(event_type) END AS finding_type,
         'Finding ' || event_type || ' ' || (event_id % 7)::VARCHAR AS title, least(value, 100.0) AS risk_score,
         CASE WHEN value > 100 THEN 'HIGH' WHEN value > 30 THEN 'MEDIUM' ELSE 'LOW' END AS evidence_strength, value > 400 AS is_hard_gate, ts FROM events),
gated AS (SELECT *, is_hard_gate OR finding_type IN ('TROJAN_BEHAVIOR_INDICATOR', 'MANIFEST_MISMATCH') AS gate FROM findings),
policy AS (
  SELECT subject_id, count(*) AS n_findings, round(avg(risk_score), 2) AS mean_risk, max(CASE evidence_strength WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS rank,
         coalesce(list(title ORDER BY pos) FILTER (WHERE gate), []::VARCHAR[]) AS hard_gates, count(*) FILTER (WHERE gate) > 0 AS hard_gate_fired FROM gated GROUP BY 1),
verdicts AS (
  SELECT subject_id, n_findings, CASE WHEN hard_gate_fired THEN 'QUARANTINE' WHEN mean_risk >= 50 THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict,
         CASE WHEN hard_gate_fired THEN greatest(mean_risk, 95.0) ELSE mean_risk END AS risk_score, ['LOW', 'MEDIUM', 'HIGH'][rank] AS evidence_strength, hard_gate_fired, hard_gates FROM policy)"""

# ------------------------------------------------------------ drift

_CDF = """v AS (SELECT vec_id % 2 = 0 AS ref, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
c AS (SELECT dim, value, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS l FROM v GROUP BY 1, 2),
f AS (SELECT dim, value, sum(r) OVER w::DOUBLE / sum(r) OVER (PARTITION BY dim) AS fr, sum(l) OVER w::DOUBLE / sum(l) OVER (PARTITION BY dim) AS fl, lead(value) OVER (PARTITION BY dim ORDER BY value) AS nxt
      FROM c WINDOW w AS (PARTITION BY dim ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT dim, max(abs(fr - fl)) AS ks FROM f GROUP BY 1)"""
_CDF = _CDF.replace("sum(r) OVER w::DOUBLE", "(sum(r) OVER w)::DOUBLE").replace("sum(l) OVER w::DOUBLE", "(sum(l) OVER w)::DOUBLE")


@query("drift_ks_dims", f"WITH {_CDF} SELECT dim, round(ks, 6) AS ks FROM ks")
def drift_ks_dims(spark, sf):
    return drift.ks_per_dim(_halves(spark, sf)).select("dim", F.round("ks", 6).alias("ks"))


@query(
    "drift_score",
    f"""WITH {_CDF}, s AS (SELECT count(*) AS dims, avg(ks) AS m, max(ks) AS hi, min(ks) AS lo FROM ks)
SELECT dims, round(m, 4) AS mean_ks, round(hi, 4) AS max_ks, round(lo, 4) AS min_ks, CASE WHEN m >= 0.5 THEN 'HIGH' WHEN m >= 0.25 THEN 'ELEVATED' ELSE 'NORMAL' END AS status,
       'INPUT_DISTRIBUTION_DRIFT_' || CASE WHEN m >= 0.5 THEN 'HIGH' WHEN m >= 0.25 THEN 'ELEVATED' ELSE 'NORMAL' END AS finding_type,
       CASE WHEN m >= 0.5 THEN 70.0 WHEN m >= 0.25 THEN 40.0 ELSE 0.0 END::DOUBLE AS risk_score, CASE WHEN m >= 0.5 THEN 'HIGH' WHEN m >= 0.25 THEN 'MEDIUM' ELSE 'HIGH' END AS evidence_strength, false AS is_hard_gate FROM s""",
)
def drift_score(spark, sf):
    return drift.drift_score(drift.ks_per_dim(_halves(spark, sf)))


@query(
    "drift_dim_means",
    "SELECT dim, round(avg(value) FILTER (WHERE ref), 4) AS mean_ref, round(avg(value) FILTER (WHERE NOT ref), 4) AS mean_live FROM (SELECT vec_id % 2 = 0 AS ref, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) WHERE dim < 10 GROUP BY 1",
)
def drift_dim_means(spark, sf):
    return drift.dim_means(_halves(spark, sf))


@query("wasserstein_dims", f"WITH {_CDF} SELECT dim, round(sum(abs(fr - fl) * (coalesce(nxt, value) - value)), 6) AS distance FROM f GROUP BY 1")
def wasserstein_dims(spark, sf):
    return drift.wasserstein_per_dim(_halves(spark, sf)).select("dim", F.round("distance", 6).alias("distance"))


@query(
    "drift_events_by_type",
    """WITH m AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS mid FROM events),
c AS (SELECT event_type AS dim, value, count(*) FILTER (WHERE epoch_us(ts) <= mid) AS r, count(*) FILTER (WHERE epoch_us(ts) > mid) AS l FROM events, m GROUP BY 1, 2),
f AS (SELECT dim, (sum(r) OVER w)::DOUBLE / sum(r) OVER (PARTITION BY dim) AS fr, (sum(l) OVER w)::DOUBLE / sum(l) OVER (PARTITION BY dim) AS fl FROM c WINDOW w AS (PARTITION BY dim ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT dim AS event_type, round(max(abs(fr - fl)), 6) AS ks FROM f GROUP BY 1""",
)
def drift_events_by_type(spark, sf):
    events = _events(spark, sf)
    mid = events.agg(F.expr("unix_micros(min(ts)) + (unix_micros(max(ts)) - unix_micros(min(ts))) div 2").alias("mid"))
    rows = anomalies.one_row_join(events, mid).select(F.col("event_type").alias("dim"), "value", F.when(F.unix_micros("ts") <= F.col("mid"), "ref").otherwise("live").alias("side"))
    return drift.ks_per_dim(rows).select(F.col("dim").alias("event_type"), F.round("ks", 6).alias("ks"))


@query(
    "drift_windowed",
    """WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS dim, value, count(*) AS l FROM events GROUP BY 1, 2),
s AS (SELECT dim, sum(l) AS n_live FROM c GROUP BY 1), w AS (SELECT value, sum(l) AS a FROM c GROUP BY 1),
g AS (SELECT s.dim, w.value, n_live, coalesce(c.l, 0) AS l, a FROM s CROSS JOIN w LEFT JOIN c ON c.dim = s.dim AND c.value = w.value),
f AS (SELECT dim, n_live, sum(l) OVER x AS c, sum(a) OVER x AS a, sum(a) OVER (PARTITION BY dim) AS n FROM g WINDOW x AS (PARTITION BY dim ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT strftime(dim, '%Y-%m-%d') AS day, round(max(abs(c::DOUBLE / n_live - (a - c)::DOUBLE / (n - n_live))), 6) AS ks FROM f WHERE n > n_live GROUP BY 1""",
)
def drift_windowed(spark, sf):
    return streams.windowed_drift(_events(spark, sf), "ts", "value").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.round("ks", 6).alias("ks"))


# ------------------------------------------------------------ duplicates


@query("dup_exact_docs", "SELECT a.doc_id AS i, b.doc_id AS j FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id")
def dup_exact_docs(spark, sf):
    return duplicates.exact_duplicate_pairs(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("dup_exact_groups", "SELECT md5(text) AS digest, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_exact_groups(spark, sf):
    return duplicates.exact_duplicate_groups(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query(
    "dup_exact_risk",
    """WITH g AS (SELECT count(*) AS m FROM documents GROUP BY md5(text) HAVING count(*) > 1), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT coalesce(sum(m * (m - 1) // 2), 0)::BIGINT AS p, coalesce(sum(m), 0)::BIGINT AS k FROM g)
SELECT n, p AS n_pairs, p AS n_exact, k AS n_members, CASE WHEN p = 0 THEN 0.0 ELSE round(least(95.0, greatest(15.0, 30 + 40 * (k::DOUBLE / n) + least(30.0, 2.0 * p))), 1) END::DOUBLE AS risk FROM s, n""",
)
def dup_exact_risk(spark, sf):
    docs = table(spark, sf, "documents")
    return duplicates.exact_duplicate_risk(duplicates.exact_duplicate_groups(docs, "doc_id", F.col("text")), docs.agg(F.count("*").alias("n")))


_HASH = " + ".join(f"(CASE WHEN p[{r * 8 + c + 1}] > p[{r * 8 + c + 2}] THEN {1 << (55 - (r * 7 + c))} ELSE 0 END)::BIGINT" for r in range(8) for c in range(7))
_NEAR = f"""e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS p FROM embeddings),
s AS (SELECT id, p FROM e UNION ALL SELECT id + 1000000, list_transform(p, lambda x, i: CASE WHEN i = 11 THEN x + 0.25 ELSE x END) FROM e WHERE id % 50 = 0),
h AS (SELECT id, p, {_HASH} AS h FROM s),
b AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.h, b.h)) AS hamming, list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64 AS mse, a.p = b.p AS exact FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4),
pairs AS (SELECT i, j, hamming::INTEGER AS hamming, round(mse, 6) AS mse, exact FROM b WHERE exact OR mse <= 0.001)"""


@query("dup_near_pairs", f"WITH {_NEAR} SELECT * FROM pairs")
def dup_near_pairs(spark, sf):
    return duplicates.near_duplicate_pairs(_samples(spark, sf), 56)


@query("dup_members", f"WITH {_NEAR} SELECT i AS id FROM pairs UNION SELECT j FROM pairs")
def dup_members(spark, sf):
    return duplicates.duplicate_members(dup_near_pairs(spark, sf))


_DUP_RISK = """k AS (SELECT count(*) AS k FROM (SELECT i FROM pairs UNION SELECT j FROM pairs)), n AS (SELECT count(*) AS n FROM s),
t AS (SELECT count(*) AS p, count(*) FILTER (WHERE exact) AS x, coalesce(sum(CASE WHEN exact THEN 1.0 ELSE greatest(0.2, 1 - hamming / 8.0) END), 0) AS v FROM pairs),
risk AS (SELECT n, p AS n_pairs, x AS n_exact, k AS n_members, CASE WHEN p = 0 THEN 0.0 ELSE round(least(95.0, greatest(15.0, 30 + 40 * (k::DOUBLE / n) + least(30.0, 2 * v))), 1) END::DOUBLE AS risk FROM t, k, n)"""


@query("dup_near_risk", f"WITH {_NEAR}, {_DUP_RISK} SELECT * FROM risk")
def dup_near_risk(spark, sf):
    samples = _samples(spark, sf)
    _, classes, links = duplicates.near_duplicate_classes(samples, 56)
    return duplicates.class_risk(classes, checkpointed(links), samples.agg(F.count("*").alias("n")))


@query(
    "dup_finding",
    f"""WITH {_NEAR}, {_DUP_RISK} SELECT 'DatasetDuplicateDetector' AS detector_id, CASE WHEN n_pairs = 0 THEN 'DATASET_DUPLICATE_CLEAN' ELSE 'DATASET_DUPLICATE_SAMPLES' END AS finding_type, risk AS risk_score,
CASE WHEN n_pairs = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS evidence_strength, CASE WHEN n_pairs = 0 THEN 'No Dataset Duplicate Pairs Detected' ELSE 'Dataset Duplicate / Near-Duplicate Samples Detected' END AS title,
CASE WHEN n_pairs = 0 THEN 'No duplicate pairs among ' || n || ' samples.' ELSE n_pairs || ' pairs (' || n_exact || ' exact) touch ' || n_members || ' of ' || n || ' samples.' END AS explanation, false AS is_hard_gate FROM risk""",
)
def dup_finding(spark, sf):
    return duplicates.duplicate_finding(dup_near_risk(spark, sf))


@query("page_pairs", "SELECT i, j FROM (SELECT a.doc_id AS i, b.doc_id AS j FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id) ORDER BY i, j LIMIT 10 OFFSET 10")
def page_pairs(spark, sf):
    return duplicates.page_exact(table(spark, sf, "documents"), "doc_id", F.col("text"), 1)


@query("leak_docs_benchmark", "WITH t AS (SELECT md5(text) AS d, count(*) AS copies, min(doc_id) AS f FROM documents GROUP BY 1) SELECT item_id AS test_id, copies, f AS first_train_id FROM benchmark JOIN t ON md5(text) = d")
def leak_docs_benchmark(spark, sf):
    return duplicates.cross_set_leakage(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id", F.col("text"), F.col("text"))


@query("leak_docs_parity", "WITH t AS (SELECT md5(text) AS d, count(*) AS copies, min(doc_id) AS f FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id AS test_id, copies, f AS first_train_id FROM documents JOIN t ON md5(text) = d WHERE doc_id % 2 = 1")
def leak_docs_parity(spark, sf):
    docs = table(spark, sf, "documents")
    return duplicates.cross_set_leakage(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "doc_id", F.col("text"), F.col("text"))


# ------------------------------------------------------------ pixels and expressions


def _rounded_sql(values: str) -> str:
    """A list of doubles rounded to 6 places as Spark's ``round`` does it: half up on the decimal digits, and no zero has a sign."""
    return f"list_transform({values}, lambda x: CASE WHEN abs(x) < 1e9 THEN x::VARCHAR::DECIMAL(18, 6)::DOUBLE ELSE round(x, 6) END)"


@query(
    "pixel_summary",
    """WITH v AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT (SELECT count(*) FROM embeddings) AS samples, '8 × 8' AS shape, 1 AS shapes, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max FROM v""",
)
def pixel_summary(spark, sf):
    return stability.pixel_summary(_embeddings(spark, sf).withColumn("shape", F.array(F.lit(8), F.lit(8))), "embedding", "shape")


@query("pixel_moments", "SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1")
def pixel_moments(spark, sf):
    return stability.pixel_moments(_embeddings(spark, sf), "embedding").select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "scale_pixels",
    """WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: least(greatest((x * (CASE WHEN list_max(embedding) <= 1 THEN 255 ELSE 1 END)::FLOAT)::FLOAT, 0::FLOAT), 255::FLOAT)) AS p FROM embeddings)
SELECT id, list_sum(list_transform(p, lambda x: floor(x)::INTEGER))::BIGINT AS total, list_max(list_transform(p, lambda x: floor(x)::INTEGER)) AS most FROM s""",
)
def scale_pixels(spark, sf):
    scaled = E.scale_pixels(F.col("embedding"))
    return _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.aggregate(scaled, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max(scaled).alias("most"))


@query(
    "grayscale",
    f"SELECT vec_id AS id, {_rounded_sql('list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 16] + embedding[i + 32] + embedding[i + 48]) / 4)')} AS gray FROM embeddings",
)
def grayscale(spark, sf):
    return _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.transform(E.to_grayscale(F.col("embedding"), F.lit(4), F.lit(16)), lambda x: F.round(x, 6)).alias("gray"))


@query(
    "translate_pixels",
    "SELECT vec_id AS id, list_transform(range(0, 64), lambda i: CASE WHEN i % 8 >= 1 AND i >= 8 THEN embedding[i - 8]::DOUBLE ELSE 0.0 END) AS moved FROM embeddings",
)
def translate_pixels(spark, sf):
    return _embeddings(spark, sf).select(F.col("vec_id").alias("id"), E.translate(F.col("embedding"), 8).alias("moved"))


@query("difference_hash", f"SELECT vec_id AS id, {_HASH} AS hash FROM (SELECT vec_id, embedding::DOUBLE[] AS p FROM embeddings)")
def difference_hash(spark, sf):
    return _embeddings(spark, sf).select(F.col("vec_id").alias("id"), E.dhash(F.col("embedding"), 8, 8).alias("hash"))


#: Weights from 8 to 9 pixels across, and half of the bits of the hash over them.
_WIDE = "[" + ", ".join("[" + ", ".join(f"{w!r}::DOUBLE" for w in row) + "]" for row in E.resize_weights(8, 9)) + "]"
_BITS = " + ".join(f"(CASE WHEN r[{y * 9 + x + 1}] > r[{y * 9 + x + 2}] THEN {1 << (31 - (y % 4 * 8 + x))} ELSE 0 END)::BIGINT" for y in range(4) for x in range(8))


@query(
    "resized_hash",
    f"""WITH r AS (SELECT vec_id AS id, list_transform(range(72), lambda i: list_sum(list_transform(range(8), lambda k: {_WIDE}[i % 9 + 1][k + 1] * embedding[i // 9 * 8 + k + 1]::DOUBLE))) AS r FROM embeddings)
SELECT id, lower(printf('%08x', {_BITS}) || printf('%08x', {_BITS.replace("r[", "r[36 + ")})) AS hash FROM r""",
)
def resized_hash(spark, sf):
    return triage.image_hashes(_embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("pixels")), 8)


def _tall(spark, sf) -> DataFrame:
    """(id, pixels, hash): embeddings as 9 x 8 pixels, the last eight being the first again, and perturbed copies; hashes of 64 bits."""
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pixels"))
    rows = rows.withColumn("pixels", F.concat("pixels", F.slice("pixels", 1, 8)))
    moved = F.transform("pixels", lambda x, i: F.when(i == 10, x + 0.25).otherwise(x))
    copies = rows.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), moved.alias("pixels"))
    return rows.unionByName(copies).withColumn("hash", E.dhash(F.col("pixels"), 9, 8))


_HASH_64 = " + ".join(f"(CASE WHEN p[{r * 9 + c + 1}] > p[{r * 9 + c + 2}] THEN {1 << (63 - (r * 8 + c))} ELSE 0 END)::UBIGINT" for r in range(8) for c in range(8))


@query(
    "dup_near_pairs_64",
    f"""WITH e AS (SELECT vec_id AS id, list_concat(embedding, embedding[1:8])::DOUBLE[] AS p FROM embeddings),
s AS (SELECT id, p FROM e UNION ALL SELECT id + 1000000, list_transform(p, lambda x, i: CASE WHEN i = 11 THEN x + 0.25 ELSE x END) FROM e WHERE id % 50 = 0), h AS (SELECT id, p, {_HASH_64} AS h FROM s),
b AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.h, b.h)) AS hamming, list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 72 AS mse, a.p = b.p AS exact FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4)
SELECT i, j, hamming::INTEGER AS hamming, round(mse, 6) AS mse, exact FROM b WHERE exact OR mse <= 0.001""",
)
def dup_near_pairs_64(spark, sf):
    return duplicates.near_duplicate_pairs(_tall(spark, sf), 64)


@query("hash_seeds", "SELECT doc_id, ('0x' || substr(sha256(coalesce(text, '')), 1, 8))::BIGINT AS seed FROM documents")
def hash_seeds(spark, sf):
    """The noise seed that a document's digest gives."""
    return table(spark, sf, "documents").select("doc_id", E.seed_from_hash(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("seed"))


@query("load_failures", "SELECT url AS subject_id, 'UNGUARANTEED_CORRUPT_DATASET' AS finding_type, 100.0::DOUBLE AS risk_score, 'HIGH' AS evidence_strength, true AS is_hard_gate, 'not an array: ' || length(html) || ' characters' AS explanation FROM pages WHERE length(html) % 3 = 0")
def load_failures(spark, sf):
    """Pages as files, a third of which could not be read."""
    error = F.when(F.length("html") % 3 == 0, F.concat(F.lit("not an array: "), F.length("html").cast("string"), F.lit(" characters")))
    return pipelines.load_failure_report(table(spark, sf, "pages").select(F.col("url").alias("path"), error.alias("error")))


_SOFT = """x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT id, v, list_transform(v, lambda a: exp(a - list_max(v))) AS w FROM x), p AS (SELECT id, list_transform(w, lambda a: a / list_sum(w)) AS p FROM e)"""


@query(
    "entropies",
    f"""WITH {_SOFT} SELECT id, round(-list_sum(list_transform(p, lambda a: a * log2(a))), 6) AS bits, round(-list_sum(list_transform(p, lambda a: a * ln(a))), 6) AS nats, round(-list_sum(list_transform(p, lambda a: a * ln(a + 1e-12))), 6) AS calib, (list_position(p, list_max(p)) - 1)::INTEGER AS top FROM p""",
)
def entropies(spark, sf):
    p = F.col("p")
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), E.softmax(F.col("embedding")).alias("p"))
    return rows.select("id", F.round(E.entropy_bits(p), 6).alias("bits"), F.round(E.entropy_nats(p), 6).alias("nats"), F.round(E.entropy_calib(p), 6).alias("calib"), E.argmax(p).alias("top"))


@query(
    "divergence_of_neighbours",
    f"""WITH {_SOFT} SELECT a.id, round(greatest(0.0, list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] * ln(z[1] / ((z[1] + z[2]) / 2)) + z[2] * ln(z[2] / ((z[1] + z[2]) / 2))) / 2))), 6) AS js,
round(sqrt(list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2 FROM p a JOIN p b ON b.id = a.id + 1""",
)
def divergence_of_neighbours(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), E.softmax(F.col("embedding")).alias("p"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("p").alias("q"))
    return rows.join(after, "id").select("id", F.round(E.js_divergence(F.col("p"), F.col("q")), 6).alias("js"), F.round(E.l2_distance(F.col("p"), F.col("q")), 6).alias("l2"))


# ------------------------------------------------------------ entropy and stability

_SCORE = """cent AS (SELECT label, list(m ORDER BY dim) AS w FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT list(w ORDER BY label) AS ws FROM cent)"""
_LOGITS = "list_transform(ws, lambda c: list_sum(list_transform(list_zip(c, v), lambda z: z[1] * z[2])))"
_BLEND = f"""{_SCORE}, o AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id < 50),
d AS (SELECT vec_id AS id, k, embedding::DOUBLE[] AS s, ('0x' || substr(md5(vec_id || ':' || k), 1, 8))::BIGINT % 50 AS pos FROM embeddings, range(0, 20) t(k)),
b AS (SELECT id, k, list_transform(list_zip(s, o), lambda z: z[1] * 0.5 + z[2] * 0.5) AS v FROM d JOIN o USING (pos)),
l AS (SELECT id, k, {_LOGITS} AS l FROM b, w), x AS (SELECT id, k, list_transform(l, lambda a: exp(a - list_max(l))) AS e FROM l),
p AS (SELECT id, k, list_transform(e, lambda a: a / list_sum(e)) AS p FROM x),
h AS (SELECT id, k, -list_sum(list_transform(p, lambda a: greatest(a, 1e-12) * log2(greatest(a, 1e-12)))) AS h, (list_position(p, list_max(p)) - 1)::INTEGER AS cls FROM p)"""


def _blended(spark, sf) -> DataFrame:
    rows = _embeddings(spark, sf)
    samples = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    overlays = rows.where("vec_id < 50").select(F.col("vec_id").alias("position"), F.col("embedding").alias("overlay"))
    return entropy.score_blends(samples, overlays, 50, scorers.centroids(rows))


@query("entropy_samples", f"WITH {_BLEND} SELECT id, round(avg(h), 6) AS mean_entropy, round(min(h), 6) AS min_entropy, round(max(h), 6) AS max_entropy, list(cls ORDER BY k)[1:5] AS top_classes FROM h GROUP BY 1")
def entropy_samples(spark, sf):
    return entropy.sample_entropy(_blended(spark, sf)).select("id", *(F.round(c, 6).alias(c) for c in ("mean_entropy", "min_entropy", "max_entropy")), "top_classes")


@query("entropy_overall", f"WITH {_BLEND} SELECT round(avg(h), 4) AS mean_entropy, round(stddev_pop(h), 4) AS std_entropy, round(min(h), 4) AS min_entropy, count(*) AS variants, avg(h) < 0.35 AS triggered FROM h")
def entropy_overall(spark, sf):
    return entropy.entropy_overall(_blended(spark, sf)).select(*(F.round(c, 4).alias(c) for c in ("mean_entropy", "std_entropy", "min_entropy")), "variants", "triggered")


@query(
    "trojan_finding",
    f"""WITH {_BLEND}, a AS (SELECT avg(h) AS m, count(*) AS n FROM h) SELECT 'EntropyDetector' AS detector_id, CASE WHEN m < 0.35 THEN 'TROJAN_BEHAVIOR_INDICATOR' ELSE 'TROJAN_BEHAVIOR_CLEAN' END AS finding_type, CASE WHEN m < 0.35 THEN 95.0 ELSE 5.0 END::DOUBLE AS risk_score, 'HIGH' AS evidence_strength,
CASE WHEN m < 0.35 THEN 'High-Strength Trojan Indicator' ELSE 'Trojan Behavioral Analysis Passed' END AS title, format('Mean entropy {{:.4f}} bits over {{}} variants.', m, n) AS explanation, m < 0.35 AS is_hard_gate FROM a""",
)
def trojan_finding(spark, sf):
    return entropy.trojan_finding(entropy.entropy_overall(_blended(spark, sf)))


def _variants(spark, sf) -> DataFrame:
    """Baseline and three variants of each embedding, scored with sharpened centroids."""
    rows = _embeddings(spark, sf)
    v = F.col("vector")
    shown = stability.stack_variants(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), {"baseline": v, "brightness": E.brightness(v), "translation": E.translate(v, 8), "mirror": F.reverse(E.doubles(v))})
    weights = scorers.centroids(rows).withColumn("centroid", F.transform("centroid", lambda x: x * 20))
    return scorers.linear_probabilities(shown, weights, "vector")


#: From logits l (id, variant, l) to metrics.
_METRICS = """e AS (SELECT id, variant, list_transform(l, lambda a: exp(a - list_max(l))) AS e FROM l), p AS (SELECT id, variant, list_transform(e, lambda a: a / list_sum(e)) AS p FROM e),
j AS (SELECT a.id, a.p AS p, b.p AS q, (list_position(a.p, list_max(a.p)))::INTEGER AS top FROM p a JOIN p b ON a.id = b.id AND a.variant = 'baseline' AND b.variant <> 'baseline'),
m AS (SELECT id, any_value(p) AS base, avg((top <> list_position(q, list_max(q)))::INTEGER) AS flip,
       avg(greatest(0.0, list_sum(list_transform(list_zip(p, q), lambda z: (greatest(z[1], 1e-12) * ln(greatest(z[1], 1e-12) / ((greatest(z[1], 1e-12) + greatest(z[2], 1e-12)) / 2)) + greatest(z[2], 1e-12) * ln(greatest(z[2], 1e-12) / ((greatest(z[1], 1e-12) + greatest(z[2], 1e-12)) / 2))) / 2)))) AS js,
       max(list_max(p) - q[top]) AS drop, avg(-list_sum(list_transform(q, lambda a: greatest(a, 1e-12) * ln(greatest(a, 1e-12))))) AS h FROM j GROUP BY 1),
metrics AS (SELECT id, base, (list_position(base, list_max(base)) - 1)::INTEGER AS baseline_class, round(list_max(base), 4) AS baseline_confidence, -list_sum(list_transform(base, lambda a: greatest(a, 1e-12) * ln(greatest(a, 1e-12)))) AS h0,
       round(flip, 4) AS flip_rate, round(js, 4) AS mean_js, round(greatest(0.0, drop), 4) AS max_confidence_drop, h FROM m)"""

_VARIANTS = f"""{_SCORE}, x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings),
v AS (SELECT id, 'baseline' AS variant, b AS v FROM x UNION ALL SELECT id, 'brightness', list_transform(b, lambda a: least(a * 1.1::DOUBLE, 1.0)) FROM x
      UNION ALL SELECT id, 'translation', list_transform(range(0, 64), lambda i: CASE WHEN i % 8 >= 1 AND i >= 8 THEN b[i - 8] ELSE 0.0 END) FROM x UNION ALL SELECT id, 'mirror', list_reverse(b) FROM x),
l AS (SELECT id, variant, list_transform(ws, lambda c: list_sum(list_transform(list_zip(c, v), lambda z: z[1] * 20 * z[2]))) AS l FROM v, w),
{_METRICS}"""


@query("stability_metrics", f"WITH {_VARIANTS} SELECT id, baseline_class, baseline_confidence, flip_rate, mean_js, max_confidence_drop, round(h - h0, 4) AS entropy_change FROM metrics")
def stability_metrics(spark, sf):
    return stability.stability_metrics(_variants(spark, sf)).drop("base", "baseline_entropy")


_CALIB = """cal AS (SELECT count(*) AS n, avg(c) AS m, stddev_pop(c) AS s FROM (SELECT -list_sum(list_transform(p, lambda a: a * ln(a + 1e-12))) AS c FROM p WHERE variant = 'baseline')),
cls AS (SELECT list(round(m, 6) ORDER BY k) AS d FROM (SELECT k, avg(x) AS m FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS k FROM p WHERE variant = 'baseline') GROUP BY 1))"""


@query(
    "calibration_fit",
    f"WITH {_VARIANTS}, {_CALIB} SELECT n AS num_samples, round(m, 4) AS mean_entropy, round(s, 4) AS std_entropy, round(m + 3 * s + 0.1, 4) AS anomaly_entropy_threshold, 1.5::DOUBLE AS max_prediction_distribution_distance, 0.25::DOUBLE AS max_flip_rate_threshold, 0.15::DOUBLE AS max_js_divergence_threshold, d AS pred_class_distribution FROM cal, cls",
)
def calibration_fit(spark, sf):
    return stability.fit_calibration(_variants(spark, sf).where("variant = 'baseline'"))


@query(
    "stability_verdict",
    f"""WITH {_VARIANTS}, {_CALIB},
t AS (SELECT id, flip_rate, mean_js, round(sqrt(list_sum(list_transform(list_zip(base, d), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4) AS dist, h0, round(m + 3 * s + 0.1, 4) AS cut FROM metrics, cal, cls),
r AS (SELECT *, list_filter([CASE WHEN flip_rate > 0.25 THEN 'flip_rate' END, CASE WHEN mean_js > 0.15 THEN 'js_divergence' END, CASE WHEN dist > 1.5 THEN 'prediction_distance' END, CASE WHEN h0 > cut THEN 'entropy' END], lambda x: x IS NOT NULL) AS reasons FROM t)
SELECT id, dist AS prediction_distance, CASE WHEN len(reasons) > 0 THEN 'SUSPICIOUS' ELSE 'SAFE_UNDER_CHECKS' END AS status, CASE WHEN len(reasons) > 0 THEN 'SUSPICIOUS_IMAGE_BEHAVIOR_INDICATOR' ELSE 'SAFE_UNDER_CHECKS_PASSED' END AS finding_type, reasons,
CASE WHEN len(reasons) > 0 THEN round(least(90.0, 50 + 40 * flip_rate + 100 * mean_js), 2) ELSE 2.5 END AS risk_score, CASE WHEN len(reasons) > 0 AND flip_rate < 0.4 THEN 'MEDIUM' ELSE 'HIGH' END AS evidence_strength FROM r""",
)
def stability_verdict(spark, sf):
    scored = _variants(spark, sf)
    return stability.stability_verdict(stability.stability_metrics(scored), stability.fit_calibration(scored.where("variant = 'baseline'")))


_NOISE = f"sqrt(-2 * ln({counter.unit_sql('id', 'z[2]', seed=1)})) * cos(2 * pi() * {counter.unit_sql('id', 'z[2]', seed=2)})"


@query(
    "noise_sweep",
    f"""WITH {_SCORE}, x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings),
z AS (SELECT id, b, list_transform(list_zip(b, range(64)), lambda z: {_NOISE}) AS z FROM x),
v AS (SELECT id, 'baseline' AS variant, b AS v FROM x UNION ALL SELECT id, 'noise', list_transform(list_zip(b, z), lambda a: least(greatest(a[1] + a[2] * s, 0.0), 1.0)) FROM z, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE)) AS t(s)),
l AS (SELECT id, variant, {_LOGITS} AS l FROM v, w),
{_METRICS} SELECT id, baseline_class, baseline_confidence, round(h0, 4) AS baseline_entropy, flip_rate, mean_js, max_confidence_drop, round(h - h0, 4) AS entropy_change FROM metrics""",
)
def noise_sweep(spark, sf):
    rows = _embeddings(spark, sf)
    noisy = stability.noise_sweep(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return stability.stability_metrics(scorers.linear_probabilities(noisy, scorers.centroids(rows), "vector")).drop("base").withColumn("baseline_entropy", F.round("baseline_entropy", 4))


#: The blur's weights, which the SQL takes as literals.
_BLUR = "[" + ", ".join(f"{w!r}::DOUBLE" for w in E.blur_weights()) + "]"


@query(
    "blurred_entropy",
    f"""WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {_BLUR} AS k FROM embeddings),
a AS (SELECT id, k, list_transform(range(64), lambda i: list_sum(list_transform(range(5), lambda j: k[j + 1] * v[i // 8 * 8 + least(greatest(i % 8 + j - 2, 0), 7) + 1]))) AS v FROM x),
b AS (SELECT id, list_transform(range(64), lambda i: list_sum(list_transform(range(5), lambda j: k[j + 1] * v[least(greatest(i // 8 + j - 2, 0), 7) * 8 + i % 8 + 1]))) AS v FROM a),
e AS (SELECT id, list_transform(v, lambda c: exp(c - list_max(v))) AS e FROM b), p AS (SELECT id, list_transform(e, lambda c: c / list_sum(e)) AS p FROM e)
SELECT id, round(-list_sum(list_transform(p, lambda c: c * ln(c + 1e-12::DOUBLE))), 6) AS entropy FROM p""",
)
def blurred_entropy(spark, sf):
    rows = _embeddings(spark, sf)
    return rows.select(F.col("vec_id").alias("id"), F.round(E.entropy_nats(E.softmax(E.blur(F.col("embedding"), 8))), 6).alias("entropy"))


@query(
    "variance_map",
    f"WITH {_VARIANTS} SELECT id, pos, round(var_pop(x), 6) AS variance FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM v) GROUP BY 1, 2",
)
def variance_map(spark, sf):
    v = F.col("vector")
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    shown = stability.stack_variants(rows, {"baseline": v, "brightness": E.brightness(v), "translation": E.translate(v, 8), "mirror": F.reverse(E.doubles(v))})
    return stability.perturbation_variance_map(shown).select("id", "pos", F.round("variance", 6).alias("variance"))


# ------------------------------------------------------------ anomalies


def _vectors(spark, sf) -> DataFrame:
    return _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _forest_sql(rows: str = "e", dims: int = 64, trees: int = 100, sample: int = 256, seed: int = 42) -> str:
    """The isolation forest of ``rows`` (id, v) as a table of nodes, level by level, and the walk of every row through it: sc (id, score)."""
    depth = sample.bit_length() - 1
    path = "CASE WHEN m > 2 THEN 2 * (ln(m - 1) + 0.5772156649015329::DOUBLE) - 2 * (m - 1)::DOUBLE / m WHEN m = 2 THEN 1.0 ELSE 0.0 END"
    out = [
        f"fn AS (SELECT count(*) AS n FROM {rows})",
        f"fr AS (SELECT n, least({trees}, ({4 * sample * trees} + n - 1) // n) AS r FROM fn)",
        f"fcand AS (SELECT id, v, n, r, (f + j) % {trees} AS tree FROM (SELECT id, v, {counter.draw_sql('id', 'id >> 31', seed=seed)} AS f FROM {rows}), fr, range({trees}) t(j) WHERE j < r)",
        f"fdrawn AS (SELECT *, {counter.draw_sql('id', 'id >> 31', 'tree', seed=seed + 1)} AS d FROM fcand)",
        f"fs AS (SELECT tree, id, v FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY d, id) AS k FROM fdrawn WHERE d < least({counter.PRIME}, ({4 * sample * trees * counter.PRIME}::HUGEINT // (n * r)))) WHERE k <= {sample})",
        "flim AS (SELECT tree, ceil(log2(greatest(2, count(*)))) AS lim FROM fs GROUP BY tree)",
        "l0 AS (SELECT tree, id, v, 1::BIGINT AS node FROM fs)",
        f"w0 AS (SELECT id, v, tree, 1::BIGINT AS node FROM {rows}, (SELECT DISTINCT tree FROM fs))",
    ]
    lows, highs = (", ".join(f"{f}(v[{i + 1}])" for i in range(dims)) for f in ("min", "max"))
    for d in range(depth + 1):
        out += [
            f"g{d} AS (SELECT tree, node, count(*) AS m, [{lows}] AS lo, [{highs}] AS hi FROM l{d} GROUP BY tree, node)",
            f"f{d} AS (SELECT tree, node, m, lo, hi, CASE WHEN {d} >= lim OR m <= 1 THEN [] ELSE list_filter(range({dims}), lambda i: hi[i + 1] > lo[i + 1]) END AS free FROM g{d} JOIN flim USING (tree))",
            f"t{d} AS (SELECT tree, node, {d} + {path} AS path, lo, hi, CASE WHEN len(free) > 0 THEN free[1 + {counter.draw_sql('tree', 'node', seed=seed + 2)} % len(free)] + 1 END AS f FROM f{d})",
            f"n{d} AS (SELECT tree, node, path, f, lo[f] + {counter.unit_sql('tree', 'node', seed=seed + 3)} * (hi[f] - lo[f]) AS cut FROM t{d})",
            f"l{d + 1} AS (SELECT tree, id, v, node * 2 + (v[f] >= cut)::INTEGER AS node FROM l{d} JOIN n{d} USING (tree, node) WHERE f IS NOT NULL)",
            f"w{d + 1} AS (SELECT id, v, tree, node * 2 + (v[f] >= cut)::INTEGER AS node FROM w{d} JOIN n{d} USING (tree, node) WHERE f IS NOT NULL)",
            f"p{d} AS (SELECT id, tree, path FROM w{d} JOIN n{d} USING (tree, node) WHERE f IS NULL)",
        ]
    paths = " UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(depth + 1))
    expected = "(SELECT " + path.replace("m", "x.k") + f" FROM (SELECT least({sample}, greatest(2, n)) AS k FROM fn) x)"
    out += [f"paths AS ({paths})", f"sc AS (SELECT id, 0.5 - pow(2, -avg(path) / {expected}) AS score FROM paths GROUP BY id)"]
    return ",\n".join(out)


_FOREST = f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), {_forest_sql()}"


def _forest_scores(spark, sf) -> DataFrame:
    vectors = _vectors(spark, sf)
    return anomalies.score_isolation_forest(vectors, anomalies.fit_isolation_forest(vectors))


@query("anomaly_scores", f"WITH {_FOREST} SELECT id, round(score, 6) AS score, score < -0.07 AS is_anomaly FROM sc")
def anomaly_scores(spark, sf):
    return anomalies.flag_anomalies(_forest_scores(spark, sf)).withColumn("score", F.round("score", 6))


def _power_sql(name: str, source: str, squarings: int = 24) -> str:
    """The leading eigenvector of the matrix ``source`` (i, j, x), by squaring it: ``name`` (i, x), its largest entry positive."""
    out = [f"{name}0 AS MATERIALIZED (SELECT i, j, x / (SELECT max(abs(x)) FROM {source}) AS x FROM {source})"]
    for k in range(squarings):
        out += [
            f"{name}s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY 1, 2)",
            f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, x / (SELECT max(abs(x)) FROM {name}s{k}) AS x FROM {name}s{k})",
        ]
    last = f"{name}{squarings}"
    out += [
        f"{name}c AS (SELECT i, x FROM {last} WHERE j = (SELECT arg_max(j, x) FROM {last} WHERE i = j))",
        f"{name} AS MATERIALIZED (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM {name}c) * (SELECT sign(arg_max(x, abs(x))) FROM {name}c) AS x FROM {name}c)",
    ]
    return ",\n".join(out)


_PCA = f"""cells AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centred AS MATERIALIZED (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM cells),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS x FROM centred a JOIN centred b ON a.id = b.id GROUP BY 1, 2),
{_power_sql("pa", "cov")},
lam AS (SELECT sum(u.x * c.x * v.x) AS l FROM cov c JOIN pa u ON u.i = c.i JOIN pa v ON v.i = c.j),
rest AS MATERIALIZED (SELECT c.i, c.j, c.x - l * u.x * v.x AS x FROM cov c JOIN pa u ON u.i = c.i JOIN pa v ON v.i = c.j, lam),
{_power_sql("pb", "rest")},
coords AS MATERIALIZED (SELECT id, sum(c.x * a.x) AS x, sum(c.x * b.x) AS y FROM centred c JOIN pa a USING (i) JOIN pb b USING (i) GROUP BY 1),
most AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM coords)"""


@query(
    "anomaly_points",
    f"WITH {_FOREST}, {_PCA} SELECT id, round(x / CASE WHEN m > 1e-6 THEN m ELSE 1 END, 4) AS x, round(y / CASE WHEN m > 1e-6 THEN m ELSE 1 END, 4) AS y, round(score, 4) AS score, score < -0.07 AS is_anomaly FROM coords JOIN sc USING (id), most",
)
def anomaly_points(spark, sf):
    vectors = _vectors(spark, sf)
    return anomalies.chart_points(_forest_scores(spark, sf), anomalies.pca_2d(vectors))


_PROJECTION = embedders.FixedProjection(8)
_KERNELS = "[" + ", ".join(f"{k!r}::DOUBLE" for k in _PROJECTION.kernels.ravel().tolist()) + "]"
_SIGNS = "[" + ", ".join(f"{k:.0f}" for k in _PROJECTION.signs.tolist()) + "]"


@query(
    "anomaly_embed",
    f"""WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {_KERNELS} AS k, {_SIGNS} AS s FROM embeddings),
pos AS (SELECT f, g, p, p // 2 + g // 4 * 2 AS r, p % 2 + g % 4 * 2 AS c FROM range(8) a(f), range(16) b(g), range(4) d(p)),
lit AS (SELECT id, f, g, greatest(0.0, list_sum(list_transform(range(9), lambda t: k[f * 9 + t + 1] * CASE WHEN r + t // 3 BETWEEN 1 AND 8 AND c + t % 3 BETWEEN 1 AND 8 THEN v[(r + t // 3 - 1) * 8 + c + t % 3] ELSE 0.0 END))) AS y FROM x, pos),
pooled AS (SELECT id, list(y ORDER BY q) AS y FROM (SELECT id, f * 16 + g AS q, sum(y) / 4 AS y FROM lit GROUP BY 1, 2) GROUP BY 1)
SELECT id, {_rounded_sql("list_transform(range(64), lambda j: list_sum(list_transform(range(128), lambda q: y[q + 1] * s[q + 1] * CASE WHEN bit_count((37 * j + 11) % 128 & q) % 2 = 0 THEN 1 ELSE -1 END)) / sqrt(128))")} AS vector FROM pooled JOIN x USING (id)""",
)
def anomaly_embed(spark, sf):
    rows = embedders.embed(_embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("pixels")), _PROJECTION)
    return rows.select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


# A score that SQL can follow: minus the distance from the mean vector.
_DISTANCE = """mu AS (SELECT list(m ORDER BY k) AS m FROM (SELECT k, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1)),
sc AS (SELECT vec_id AS id, label AS dataset_id, 0.93 - sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM embeddings, mu)"""


def _distance_scores(spark, sf) -> DataFrame:
    rows = _embeddings(spark, sf)
    each = rows.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"))
    mean = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("mean"))
    return anomalies.one_row_join(rows, mean).select(F.col("vec_id").alias("id"), F.col("label").alias("dataset_id"), (0.93 - E.l2_distance(F.col("embedding"), F.col("mean"))).alias("score"))


@query("anomaly_summary", f"WITH {_DISTANCE} SELECT round(min(score), 4) AS min_score, round(max(score), 4) AS max_score, round(avg(score), 4) AS mean_score, -0.07::DOUBLE AS threshold, count(*) FILTER (WHERE score < -0.07) AS n_anomalies, count(*) AS n FROM sc")
def anomaly_summary(spark, sf):
    return anomalies.anomaly_summary(_distance_scores(spark, sf))


_ANOMALY_RISK = """ar AS (SELECT count(*) AS n, count(*) FILTER (WHERE score < -0.07) AS k, avg(greatest(0.0, -0.07 - score)) FILTER (WHERE score < -0.07) AS depth FROM sc),
arisk AS (SELECT n, k AS n_anomalies, CASE WHEN k = 0 THEN 0.0 ELSE round(least(95.0, greatest(20.0, 35 + 45 * (k::DOUBLE / n) + 300 * depth)), 1) END::DOUBLE AS risk FROM ar)"""


@query("anomaly_risk", f"WITH {_FOREST}, {_ANOMALY_RISK} SELECT * FROM arisk")
def anomaly_risk(spark, sf):
    return anomalies.anomaly_risk(_forest_scores(spark, sf))


@query("anomaly_distance_risk", f"WITH {_DISTANCE}, {_ANOMALY_RISK} SELECT * FROM arisk")
def anomaly_distance_risk(spark, sf):
    return anomalies.anomaly_risk(_distance_scores(spark, sf))


@query(
    "anomaly_finding",
    f"""WITH {_DISTANCE}, {_ANOMALY_RISK} SELECT 'DatasetAnomalyDetector' AS detector_id, CASE WHEN n_anomalies = 0 THEN 'DATASET_ANOMALY_CLEAN' ELSE 'DATASET_ANOMALY_INDICATOR' END AS finding_type, risk AS risk_score, CASE WHEN n_anomalies = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS evidence_strength,
CASE WHEN n_anomalies = 0 THEN 'Dataset Feature Distribution Clean' ELSE 'Dataset Embedding Anomaly Clusters Detected' END AS title, n_anomalies || ' of ' || n || ' samples lie below the anomaly threshold.' AS explanation, false AS is_hard_gate FROM arisk""",
)
def anomaly_finding(spark, sf):
    return anomalies.anomaly_finding(_risk := anomalies.anomaly_risk(_distance_scores(spark, sf)))


@query("first_flagged", f"WITH {_DISTANCE} SELECT dataset_id, id, round(score, 6) AS score FROM sc WHERE score < -0.07 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY id) <= 12")
def first_flagged(spark, sf):
    return anomalies.first_n_flagged(anomalies.flag_anomalies(_distance_scores(spark, sf))).select("dataset_id", "id", F.round("score", 6).alias("score"))


@query("inlier_rates", f"WITH {_DISTANCE} SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE score < -0.07) / count(*), 1)::DOUBLE AS anomaly_pct, round(100.0 * count(*) FILTER (WHERE score >= -0.07) / count(*), 1)::DOUBLE AS inlier_pct FROM sc")
def inlier_rates(spark, sf):
    return anomalies.inlier_rates(anomalies.flag_anomalies(_distance_scores(spark, sf)))


@query(
    "confidence",
    f"""WITH {_DISTANCE}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM sc)
SELECT id, round(CASE WHEN score < -0.07 THEN least(99.4::DOUBLE, 70 + 29.4::DOUBLE * (-0.07 - score) / greatest(-0.07 - lo, 0.01)) ELSE 100 - least(99.8::DOUBLE, 65 + 34.8::DOUBLE * (score + 0.07) / greatest(hi + 0.07, 0.01)) END, 4) AS confidence FROM sc, b""",
)
def confidence(spark, sf):
    scores = _distance_scores(spark, sf)
    rows = anomalies.one_row_join(scores, scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    return rows.select("id", F.round(E.anomaly_confidence(F.col("score"), -0.07, F.col("lo"), F.col("hi")), 4).alias("confidence"))


@query(
    "dataset_risk",
    f"""WITH {_NEAR}, {_DUP_RISK}, {_DISTANCE}, {_ANOMALY_RISK}
SELECT d.risk AS duplicate_risk, a.risk AS anomaly_risk, CASE WHEN n_pairs > 0 AND n_anomalies > 0 THEN round(least(98.0, greatest(d.risk, a.risk) + 0.15::DOUBLE * least(d.risk, a.risk)), 1) WHEN n_pairs > 0 OR n_anomalies > 0 THEN greatest(d.risk, a.risk) ELSE 0.0 END AS risk,
CASE WHEN n_pairs > 0 OR n_anomalies > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS evidence_strength, CASE WHEN n_pairs > 0 OR n_anomalies > 0 THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict FROM risk d, arisk a""",
)
def dataset_risk(spark, sf):
    return anomalies.dataset_risk(dup_near_risk(spark, sf), anomaly_distance_risk(spark, sf))


# ------------------------------------------------------------ policy


@query("findings_policy", f"WITH {_FINDINGS} SELECT * FROM verdicts")
def findings_policy(spark, sf):
    return policy.evaluate_policy(_findings(spark, sf))


@query("hard_gates", f"WITH {_FINDINGS} SELECT subject_id, hard_gates FROM policy WHERE hard_gate_fired")
def hard_gates(spark, sf):
    return policy.collect_hard_gates(_findings(spark, sf))


@query("evidence", f"WITH {_FINDINGS} SELECT subject_id, n_findings, mean_risk, ['LOW', 'MEDIUM', 'HIGH'][rank] AS evidence_strength FROM policy")
def evidence(spark, sf):
    return policy.aggregate_evidence(_findings(spark, sf))


@query("verdict_counts", f"WITH {_FINDINGS} SELECT verdict, count(*) AS n, round(avg(risk_score), 4) AS mean_risk FROM verdicts GROUP BY 1")
def verdict_counts(spark, sf):
    return findings_policy(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 4).alias("mean_risk"))


@query(
    "profile_verdicts",
    f"""WITH {_FINDINGS}, f(profile, a, b) AS (VALUES ('enterprise', 50, 90), ('healthcare', 40, 75), ('defense', 25, 60))
SELECT subject_id, profile, CASE WHEN hard_gate_fired OR risk_score >= b THEN 'QUARANTINE' WHEN risk_score >= a THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict FROM verdicts, f""",
)
def profile_verdicts(spark, sf):
    return policy.profile_policy(_findings(spark, sf))


@query("windowed_verdicts", f"WITH {_FINDINGS} SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n_findings, round(avg(risk_score), 4) AS mean_risk, count(*) FILTER (WHERE gate) AS n_gates FROM gated GROUP BY 1")
def windowed_verdicts(spark, sf):
    return streams.windowed_verdicts(_findings(spark, sf), "ts").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_findings", "mean_risk", "n_gates")


@query("union_findings", f"WITH {_FINDINGS} SELECT source_pos, count(*) AS n, round(sum(risk_score), 2) AS risk FROM (SELECT 0 AS source_pos, risk_score FROM gated WHERE gate UNION ALL SELECT 1, risk_score FROM gated WHERE NOT gate) GROUP BY 1")
def union_findings(spark, sf):
    rows = _findings(spark, sf)
    both = policy.union_findings(rows.where(policy.is_hard_gate()), rows.where(~policy.is_hard_gate()).drop("ts"))
    return both.groupBy("source_pos").agg(F.count("*").alias("n"), F.round(F.sum("risk_score"), 2).alias("risk"))


# ------------------------------------------------------------ inventory


def _models(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("model_id"), F.sha2("text", 256).alias("sha256"))


@query(
    "manifest_check",
    """WITH m AS (SELECT sha256(text) AS h, arg_min(doc_id, doc_id) AS a FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT doc_id::VARCHAR AS model_id, sha256(text) AS sha256, CASE WHEN a IS NULL THEN 'MANIFEST_MISMATCH_UNAPPROVED_MODEL' ELSE 'MANIFEST_VERIFIED_OK (Approved ID: ' || a || ')' END AS status, a::VARCHAR AS approved_id FROM documents LEFT JOIN m ON sha256(text) = h""",
)
def manifest_check(spark, sf):
    models = _models(spark, sf)
    approved = models.where("cast(model_id as bigint) % 3 = 0").select(F.col("model_id").cast("bigint").alias("position"), "model_id", F.upper("sha256").alias("sha256"))
    return inventory.verify_manifest(models, approved)


def _nodes(spark, sf) -> DataFrame:
    """Clicks and views are nodes of allowed operators, all of them in turn; other events of operators that are not; some of a foreign domain."""
    allowed = F.element_at(F.array(*map(F.lit, inventory.ALLOWED_OPERATORS)), (F.col("event_id") % len(inventory.ALLOWED_OPERATORS) + 1).cast("int"))
    kind = F.when(F.col("event_type").isin("click", "view"), allowed).otherwise(F.initcap("event_type"))
    return table(spark, sf, "events").select(F.col("user_id").alias("model_id"), F.col("event_id").cast("string").alias("node_path"), F.when(F.col("event_id") % 97 == 0, "custom.domain").otherwise("").alias("domain"), kind.alias("op_type"))


_ALLOWED = "[" + ", ".join(f"'{name}'" for name in inventory.ALLOWED_OPERATORS) + "]"
_NODES = f"""nodes AS (SELECT user_id AS model_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'custom.domain' ELSE '' END AS domain,
  CASE WHEN event_type IN ('click', 'view') THEN {_ALLOWED}[event_id % {len(inventory.ALLOWED_OPERATORS)} + 1] ELSE upper(event_type[1]) || event_type[2:] END AS op_type FROM events)"""


@query("allowlist_audit", f"WITH {_NODES} SELECT op_type, count(*) AS nodes, count(DISTINCT model_id) AS models FROM nodes WHERE NOT list_contains({_ALLOWED}, op_type) GROUP BY 1")
def allowlist_audit(spark, sf):
    return inventory.disallowed_operators(_nodes(spark, sf)).groupBy("op_type").agg(F.count("*").alias("nodes"), F.count_distinct("model_id").alias("models"))


@query("domain_audit", f"WITH {_NODES} SELECT domain || '::' || op_type AS offence, count(*) AS nodes FROM nodes WHERE domain <> '' GROUP BY 1")
def domain_audit(spark, sf):
    return inventory.disallowed_domains(_nodes(spark, sf)).groupBy("offence").agg(F.count("*").alias("nodes"))


@query("operator_inventory", f"WITH {_NODES} SELECT model_id, count(*) AS n_nodes, list_sort(list(DISTINCT op_type)) AS operators, coalesce(list_sort(list(DISTINCT op_type) FILTER (WHERE NOT list_contains({_ALLOWED}, op_type))), []::VARCHAR[]) AS disallowed, count(*) <= 50000 AS within_limit FROM nodes GROUP BY 1")
def operator_inventory(spark, sf):
    return inventory.operator_inventory(_nodes(spark, sf))


def _inputs(spark, sf) -> DataFrame:
    """Orders are inputs of their customer's model; their lines' part numbers are dims, some unknown or zero."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    value = F.when(F.col("l_partkey") % 11 == 0, None).when(F.col("l_partkey") % 13 == 0, 0).otherwise(F.col("l_partkey") % 97).cast("bigint")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("model_id"), F.col("o_orderkey").cast("string").alias("input_name"), F.col("l_linenumber").cast("int").alias("dim_pos"), value.alias("dim_value"), F.lit(None).cast("string").alias("dim_param"))


def _filled(spark, sf) -> DataFrame:
    """Inputs of finished orders are filled by initializers."""
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("model_id"), F.col("o_orderkey").cast("string").alias("name"))


#: The dims of what is fed, the elements of each input, and the violations of each model.
_FED = """fed AS (SELECT o_custkey AS model_id, o_orderkey AS i, l_linenumber AS pos, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 0 ELSE l_partkey % 97 END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'),
el AS (SELECT model_id, i, list_reduce(list_prepend(1::HUGEINT, list(CASE WHEN v IS NULL OR v = 0 THEN 1 ELSE v END::HUGEINT)), lambda a, b: a * b) AS p FROM fed GROUP BY 1, 2)"""
_WALL = f"""{_NODES}, {_FED},
v AS (SELECT model_id, 'DISALLOWED_OPERATOR: ' || op_type AS x FROM nodes WHERE NOT list_contains({_ALLOWED}, op_type) UNION ALL SELECT model_id, 'DISALLOWED_DOMAIN: ' || domain || '::' || op_type FROM nodes WHERE domain <> ''
  UNION ALL SELECT model_id, 'INPUT_ELEMENTS: ' || i FROM el WHERE p > 16000000 UNION ALL SELECT model_id, 'TOTAL_INPUT_ELEMENTS' FROM el GROUP BY 1 HAVING sum(p) > 16000000)"""


@query(
    "input_budget",
    """WITH d AS (SELECT o_custkey AS model_id, o_orderkey AS i, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 0 ELSE l_partkey % 97 END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT model_id, i, list_reduce(list_prepend(1::HUGEINT, list(CASE WHEN v IS NULL OR v = 0 THEN 1 ELSE v END::HUGEINT)), lambda a, b: a * b) AS p, max(v) AS m FROM d GROUP BY 1, 2)
SELECT model_id, sum(p)::DOUBLE AS total_elements, max(p)::DOUBLE AS largest_input, max(m)::BIGINT AS largest_dim, sum(p) <= 16000000 AND coalesce(max(m), 0) <= 65536 AS within_budget FROM e GROUP BY 1""",
)
def input_budget(spark, sf):
    out = inventory.input_budget(_inputs(spark, sf))
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_elements", "largest_input")})


@query(
    "feed_budget",
    """WITH d AS (SELECT o_custkey AS model_id, o_orderkey AS i, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 0 ELSE l_partkey % 97 END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'),
e AS (SELECT model_id, i, list_reduce(list_prepend(1::HUGEINT, list(CASE WHEN v IS NULL OR v = 0 THEN 1 ELSE v END::HUGEINT)), lambda a, b: a * b) AS p, max(v) AS m FROM d GROUP BY 1, 2)
SELECT model_id, sum(p)::DOUBLE AS total_elements, max(p)::DOUBLE AS largest_input, max(m)::BIGINT AS largest_dim, sum(p) <= 16000000 AND coalesce(max(m), 0) <= 65536 AS within_budget FROM e GROUP BY 1""",
)
def feed_budget(spark, sf):
    """The budget of what is fed: inputs of finished orders are filled by initializers."""
    out = inventory.input_budget(inventory.feed_inputs(_inputs(spark, sf), _filled(spark, sf)))
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_elements", "largest_input")})


@query(
    "graph_io",
    """WITH d AS (SELECT o_custkey AS m, o_orderkey AS i, string_agg(d, ',' ORDER BY l_linenumber, d) AS s FROM (SELECT o_custkey, o_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN '?' WHEN l_partkey % 13 = 0 THEN '0' ELSE (l_partkey % 97)::VARCHAR END AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1, 2),
i AS (SELECT m, count(*) AS n, string_agg(i || '[' || s || ']', '|' ORDER BY i || '[' || s || ']') AS shapes FROM d GROUP BY 1), o AS (SELECT o_custkey AS m, count(*) AS n, string_agg(o_orderkey || '[batch,10]', '|' ORDER BY o_orderkey || '[batch,10]') AS shapes FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT c_custkey AS model_id, coalesce(i.n, 0) AS n_inputs, coalesce(o.n, 0) AS n_outputs, i.shapes AS inputs, o.shapes AS outputs, CASE WHEN i.n IS NULL THEN 'NO_INPUTS' WHEN o.n IS NULL THEN 'NO_OUTPUTS' ELSE 'OK' END AS status FROM customer LEFT JOIN i ON i.m = c_custkey LEFT JOIN o ON o.m = c_custkey""",
)
def graph_io(spark, sf):
    """Outputs have a batch dim by name and ten classes."""
    dim = F.explode(F.array(F.struct(F.lit(0).alias("dim_pos"), F.lit(None).cast("bigint").alias("dim_value"), F.lit("batch").alias("dim_param")), F.struct(F.lit(1).alias("dim_pos"), F.lit(10).cast("bigint").alias("dim_value"), F.lit(None).cast("string").alias("dim_param"))))
    outputs = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("model_id"), F.col("o_orderkey").cast("string").alias("output_name"), dim.alias("d")).select("model_id", "output_name", "d.*")
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"))
    return inventory.graph_io_check(models, _inputs(spark, sf), outputs).select("model_id", "n_inputs", "n_outputs", F.array_join("inputs", "|").alias("inputs"), F.array_join("outputs", "|").alias("outputs"), "status")


@query(
    "firewall_report",
    f"""WITH {_WALL} SELECT c_custkey AS model_id, count(x) AS n_violations, md5(coalesce(string_agg(x, '|' ORDER BY x), '')) AS digest, count(x) = 0 AS passed FROM customer LEFT JOIN v ON v.model_id = c_custkey GROUP BY 1""",
)
def firewall_report(spark, sf):
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"))
    rows = inventory.firewall_report(models, _nodes(spark, sf), _inputs(spark, sf), _filled(spark, sf))
    return rows.select("model_id", F.size("violations").cast("bigint").alias("n_violations"), F.md5(F.array_join("violations", "|")).alias("digest"), "passed")


def _artifacts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are models, every fourth of them approved, every 17th of a bad format; errors are a scanner's issues."""
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"), (F.col("c_custkey") % 17 != 0).alias("format_ok"))
    manifest = models.where("model_id % 4 = 0").select(F.col("model_id").alias("position"), "model_id", "sha256")
    return models, manifest, _issues(spark, sf)


def _issues(spark, sf) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("model_id"), F.lit("HIGH").alias("severity"), F.col("props").alias("description"))


#: Findings of the gate: (subject_id, pos, finding_type, title, r).
_GATE = f"""{_WALL}, m AS (SELECT c_custkey AS id, c_custkey % 17 <> 0 AS ok FROM customer),
gate AS (SELECT DISTINCT id AS subject_id, 0 AS pos, 'ONNX_GRAPH_FIREWALL' AS finding_type, 'ONNX Graph Firewall Violation' AS title, 100.0 AS r FROM m JOIN v ON model_id = id
  UNION ALL SELECT id, 1, 'INVALID_FILE_FORMAT', 'Invalid Artifact Format', 100.0 FROM m WHERE NOT ok UNION ALL SELECT id, 2, 'MANIFEST_MISMATCH', 'Unapproved Model Hash / Manifest Mismatch', 95.0 FROM m WHERE id % 4 <> 0
  UNION ALL SELECT DISTINCT id, 3, 'UNSAFE_SERIALIZATION_INDICATOR', 'ModelScan Unsafe Serialization Detection', 100.0 FROM m JOIN events ON user_id = id WHERE event_type = 'error' AND ok)"""


@query(
    "safety_gate",
    f"""WITH {_GATE} SELECT subject_id, count(*) AS n_findings, round(avg(r), 2)::DOUBLE AS mean_risk, string_agg(finding_type, ',' ORDER BY pos) AS findings FROM gate GROUP BY 1""",
)
def safety_gate(spark, sf):
    models, manifest, issues = _artifacts(spark, sf)
    found = inventory.safety_gate(models, manifest, _nodes(spark, sf), _inputs(spark, sf), _filled(spark, sf), issues)
    return found.groupBy("subject_id").agg(F.count("*").alias("n_findings"), F.round(F.avg("risk_score"), 2).alias("mean_risk"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "finding_type"))), lambda x: x["finding_type"]), ",").alias("findings"))


@query("issue_rollup", "SELECT user_id AS model_id, count(*) AS n_issues, md5(string_agg(concat_ws(': ', 'HIGH', props), '|' ORDER BY concat_ws(': ', 'HIGH', props))) AS issues, 'UNSAFE_SERIALIZATION_INDICATOR' AS finding_type FROM events WHERE event_type = 'error' GROUP BY 1")
def issue_rollup(spark, sf):
    return inventory.issue_rollup(_issues(spark, sf)).withColumn("issues", F.md5(F.array_join("issues", "|")))


@query("artifact_precheck", "SELECT url AS path, CASE WHEN length(html) > 3000 THEN 'FILE_NOT_FOUND' WHEN NOT ends_with(lower(url), '/') THEN 'INVALID_FILE_EXTENSION' WHEN length(html) = 0 THEN 'EMPTY_FILE' ELSE 'OK' END AS status FROM pages")
def artifact_precheck(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.when(F.length("html") <= 3000, F.length("html")).alias("length"))
    return inventory.artifact_precheck(files, ("/",))


@query(
    "roles",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'live_input_batch' WHEN 'view' THEN 'perturbation_overlay' ELSE event_type END AS raw FROM events), n AS (SELECT event_id, CASE WHEN raw IN ('live_input_batch', 'perturbation_overlay') THEN raw ELSE 'training_eval' END AS role FROM r)
SELECT role, CASE role WHEN 'live_input_batch' THEN 'Live Input Batch Assurance' WHEN 'perturbation_overlay' THEN 'Perturbation Overlay Assurance' ELSE 'Training / Evaluation Dataset Assurance' END AS protocol, count(*) AS n FROM n GROUP BY 1, 2""",
)
def roles(spark, sf):
    raw = F.when(F.col("event_type") == "click", "live_input_batch").when(F.col("event_type") == "view", "perturbation_overlay").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(E.normalize_role(raw).alias("role"), E.protocol_name(raw).alias("protocol")).groupBy("role", "protocol").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ triage


#: Leading bytes of every kind of file that is told apart, in hex.
_HEADS = (*(magic for magic, _ in E.MAGIC), "524946460000000057454250", "52494646000000005741564520", "20203C537647", "0A3C737667", "", "89504E47")


@query(
    "sniff_formats",
    f"""SELECT page_id, ['PNG', 'JPEG', 'REJECTED_GIF', 'REJECTED_GIF', 'REJECTED_TIFF', 'REJECTED_TIFF', 'REJECTED_PDF', 'REJECTED_ARCHIVE', 'REJECTED_ARCHIVE', 'REJECTED_ARCHIVE', 'REJECTED_ARCHIVE', 'REJECTED_EXECUTABLE', 'REJECTED_EXECUTABLE',
'WEBP', 'UNKNOWN', 'REJECTED_SVG', 'REJECTED_SVG', 'UNKNOWN', 'UNKNOWN'][page_id % {len(_HEADS)} + 1] AS format FROM pages""",
)
def sniff_formats(spark, sf):
    heads = F.array(*map(F.lit, _HEADS))
    content = F.concat(F.unhex(F.element_at(heads, (F.col("page_id") % len(_HEADS) + 1).cast("int"))), F.col("html").cast("binary"))
    return table(spark, sf, "pages").select("page_id", E.sniff_format(E.head_hex(content)).alias("format"))


@query(
    "resource_gate",
    """WITH p AS (SELECT page_id, length(html) * 1500 AS length, page_id * 37 % 5000 AS width, page_id * 91 % 5000 AS height, CASE WHEN page_id % 2 = 0 THEN 4096 ELSE 2048 END AS side, CASE WHEN page_id % 2 = 0 THEN 16000000 ELSE 4000000 END AS px, CASE WHEN page_id % 2 = 0 THEN 10485760 ELSE 5242880 END AS sz FROM pages),
r AS (SELECT page_id, CASE WHEN length = 0 THEN 'empty file' WHEN length > sz THEN 'file size exceeds the limit' WHEN width <= 0 OR height <= 0 THEN 'image has no pixels' WHEN greatest(width, height) > side THEN 'image dimension exceeds the limit' WHEN width * height > px THEN 'pixel count exceeds the limit' END AS reason FROM p)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN NULL WHEN reason LIKE '%exceed%' THEN 'REJECTED_RESOURCE_LIMIT' ELSE 'REJECTED_MALFORMED_IMAGE' END AS finding_type, CASE WHEN reason IS NULL THEN NULL WHEN reason LIKE '%exceed%' THEN 0.0 ELSE 100.0 END::DOUBLE AS risk_score FROM r""",
)
def resource_gate(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", (F.length("html") * 1500).alias("length"), (F.col("page_id") * 37 % 5000).alias("width"), (F.col("page_id") * 91 % 5000).alias("height"), F.when(F.col("page_id") % 2 == 0, "Standard").otherwise("Demo").alias("profile"))
    gated = triage.gate_resource_profile(rows, F.col("profile"))
    kind = F.when(F.col("reason").isNotNull(), triage.classify_rejection(F.array("reason")))
    return gated.select("page_id", "reason", kind.alias("finding_type"), F.when(kind.isNotNull(), triage.rejection_risk(kind)).alias("risk_score"))


@query(
    "triage_pages",
    """WITH p AS (SELECT url, html, strlen(html) AS n, lower(html[1:512]) LIKE '%<svg%' AS svg FROM pages)
SELECT url AS path, n AS length, CASE WHEN n > 5242880 OR n = 0 THEN NULL ELSE sha256(html) END AS sha256, CASE WHEN n > 5242880 OR n = 0 THEN NULL WHEN svg THEN 'REJECTED_SVG' ELSE 'UNKNOWN' END AS format, 'REJECTED' AS status,
       CASE WHEN n > 5242880 THEN 'REJECTED_RESOURCE_LIMIT' ELSE 'REJECTED_MALFORMED_IMAGE' END AS finding_type, CASE WHEN n > 5242880 THEN 0.0 ELSE 100.0 END::DOUBLE AS risk_score,
       CASE WHEN n = 0 THEN 'empty file' WHEN n > 5242880 THEN 'file size exceeds the limit' WHEN svg THEN 'unsupported format REJECTED_SVG' ELSE 'unsupported format UNKNOWN' END AS reasons FROM p""",
)
def triage_pages(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length"), F.col("html").cast("binary").alias("content"))
    found = triage.triage(files, "Demo")
    return found.select("path", "length", "sha256", "format", "status", "finding_type", "risk_score", F.array_join("reasons", "; ").alias("reasons"))


# ------------------------------------------------------------ provenance


def _ledger_events(spark, sf) -> DataFrame:
    return _events(spark, sf).select(F.col("user_id").alias("chain_id"), F.col("event_id").alias("seq"), F.sha2("event_type", 256).alias("model_sha256"), F.col("props").alias("manifest"), F.unix_micros("ts").alias("ts_us"))


_ZERO = "repeat('0', 64)"
_CHAIN = f"""pay AS (SELECT user_id AS chain_id, event_id AS seq, epoch_us(ts) AS ts_us, sha256(event_type) AS model, '{{"model_sha256":"' || sha256(event_type) || '","provenance_manifest":"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '","timestamp":' || epoch_us(ts) || '}}' AS p FROM events),
lst AS (SELECT chain_id, list(seq ORDER BY seq) AS s, list(p ORDER BY seq) AS ps FROM pay GROUP BY 1),
chain AS (SELECT chain_id, unnest(s) AS seq, unnest(list_transform(range(1, len(ps) + 1), lambda i: list_reduce(list_prepend({_ZERO}, ps[1:i]), lambda a, b: sha256(a || b)))) AS h FROM lst),
built AS (SELECT chain_id, seq, coalesce(lag(h) OVER (PARTITION BY chain_id ORDER BY seq), {_ZERO}) AS prev, h FROM chain)"""


@query("chain_build", f"WITH {_CHAIN} SELECT chain_id, seq, prev AS previous_event_hash, h AS event_hash FROM built")
def chain_build(spark, sf):
    return provenance.build_chain(_ledger_events(spark, sf)).select("chain_id", "seq", "previous_event_hash", "event_hash")


@query("chain_validate", "SELECT user_id AS chain_id, 'VALID_AUDIT_CHAIN (' || count(*) || ' events verified)' AS status, true AS valid, count(*) AS verified FROM events GROUP BY 1")
def chain_validate(spark, sf):
    return provenance.validate_chain(provenance.well_formed(provenance.build_chain(_ledger_events(spark, sf))))


def _tampered(spark, sf) -> DataFrame:
    """Some manifests, links, hashes, models and times changed after the chains were built."""
    rows = provenance.well_formed(provenance.build_chain(_ledger_events(spark, sf)))
    hit = lambda k: F.col("seq") % 500 == k
    return rows.withColumns({
        "manifest": F.when(hit(1), F.lit('{"k": -1}')).otherwise(F.col("manifest")),
        "previous_event_hash": F.when(hit(101), F.repeat(F.lit("deadbeef"), 8)).otherwise(F.col("previous_event_hash")),
        "model_sha256": F.when(hit(201), F.lit("short")).otherwise(F.col("model_sha256")),
        "has_fields": ~hit(301),
        "parsed": ~hit(401),
    })


_TAMPER = f"""{_CHAIN}, line AS (SELECT chain_id, seq, h, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS line, CASE seq % 500 WHEN 401 THEN 'MALFORMED_JSON_LINE' WHEN 301 THEN 'MISSING_REQUIRED_FIELD' WHEN 201 THEN 'INVALID_MODEL_SHA256' WHEN 101 THEN 'BROKEN_CHAIN_LINK' WHEN 1 THEN 'INCORRECT_EVENT_HASH' END AS code FROM built),
bad AS (SELECT chain_id, count(*) AS n, min(line) FILTER (WHERE code IS NOT NULL) AS b, arg_min(code, line) FILTER (WHERE code IS NOT NULL) AS code FROM line GROUP BY 1)"""


@query("chain_validate_tampered", f"WITH {_TAMPER} SELECT chain_id, CASE WHEN b IS NULL THEN 'VALID_AUDIT_CHAIN (' || n || ' events verified)' ELSE code || ' (Line ' || b || ')' END AS status, b IS NULL AS valid, coalesce(b - 1, n) AS verified FROM bad")
def chain_validate_tampered(spark, sf):
    return provenance.validate_chain(_tampered(spark, sf))


@query(
    "chain_times",
    """WITH t AS (SELECT user_id AS chain_id, event_id AS seq, epoch_us(ts) - CASE WHEN event_id % 500 = 7 THEN 10000000000000 ELSE 0 END AS ts FROM events),
m AS (SELECT *, row_number() OVER w AS line, coalesce(max(ts) OVER (PARTITION BY chain_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latest FROM t WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
bad AS (SELECT chain_id, count(*) AS n, min(line) FILTER (WHERE ts < latest) AS b FROM m GROUP BY 1)
SELECT chain_id, CASE WHEN b IS NULL THEN 'VALID_AUDIT_CHAIN (' || n || ' events verified)' ELSE 'EVENT_ORDERING_ERROR (Line ' || b || ')' END AS status, b IS NULL AS valid, coalesce(b - 1, n) AS verified FROM bad""",
)
def chain_times(spark, sf):
    """Chains some of whose events carry a time before an earlier event's, hashed as they are."""
    back = F.when(F.col("seq") % 500 == 7, F.lit(10_000_000_000_000)).otherwise(F.lit(0))
    events = _ledger_events(spark, sf).withColumn("ts_us", F.col("ts_us") - back)
    return provenance.validate_chain(provenance.well_formed(provenance.build_chain(events)))


@query("chain_head", f"WITH {_TAMPER} SELECT chain_id, coalesce(max(h) FILTER (WHERE line = coalesce(b - 1, n)), {_ZERO}) AS head FROM line JOIN bad USING (chain_id) GROUP BY 1")
def chain_head(spark, sf):
    return provenance.chain_head(_tampered(spark, sf))


@query("broken_chain_findings", f"WITH {_TAMPER} SELECT chain_id AS subject_id, 'BROKEN_AUDIT_CHAIN' AS finding_type, 100.0::DOUBLE AS risk_score FROM bad WHERE b IS NOT NULL")
def broken_chain_findings(spark, sf):
    chains = provenance.validate_chain(_tampered(spark, sf)).withColumnRenamed("chain_id", "subject_id")
    return policy.broken_chain_finding(chains).select("subject_id", "finding_type", "risk_score")


@query(
    "checkpoint_hashes",
    f"""WITH {_CHAIN} SELECT b.chain_id, b.seq, sha256('{{"event_hash":"' || h || '","model_sha256":"' || model || '","previous_event_hash":"' || prev || '","timestamp":' || ts_us || '}}') AS checkpoint_hash FROM built b JOIN pay USING (chain_id, seq)""",
)
def checkpoint_hashes(spark, sf):
    return provenance.checkpoints(provenance.build_chain(_ledger_events(spark, sf))).select("chain_id", "seq", "checkpoint_hash")


@query("checkpoint_status", "SELECT user_id AS chain_id, event_id AS seq, CASE event_id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'INVALID' ELSE 'VALID' END AS checkpoint_status FROM events")
def checkpoint_status(spark, sf):
    rows = provenance.checkpoints(provenance.build_chain(_ledger_events(spark, sf)))
    k = F.col("seq") % 10
    signed = rows.withColumn("signature", F.when(k == 0, "").when(k == 1, "forged").otherwise(provenance.sign(F.col("checkpoint_payload"))))
    return provenance.verify_checkpoints(signed).select("chain_id", "seq", "checkpoint_status")


@query("inference_log", f"WITH {_TAMPER} SELECT CASE WHEN b IS NULL THEN 'LOGGED' ELSE 'REJECTED_BROKEN_CHAIN' END AS log_status, count(*) AS n FROM line JOIN bad USING (chain_id) GROUP BY 1")
def inference_log(spark, sf):
    return provenance.log_inferences(_tampered(spark, sf), _ledger_events(spark, sf)).groupBy("log_status").agg(F.count("*").alias("n"))


@query(
    "inference_append",
    f"""WITH {_CHAIN.split("lst AS")[0]}
lst AS (SELECT chain_id, list(seq ORDER BY seq % 2, seq) AS s, list(p ORDER BY seq % 2, seq) AS ps, coalesce(max(seq) FILTER (WHERE seq % 2 = 0), -1) AS last, count(*) FILTER (WHERE seq % 2 = 0) AS n FROM pay GROUP BY 1),
h AS (SELECT chain_id, last, n, unnest(range(1, len(ps) + 1)) AS i, unnest(list_transform(range(1, len(ps) + 1), lambda i: list_reduce(list_prepend({_ZERO}, ps[1:i]), lambda a, b: sha256(a || b)))) AS h FROM lst)
SELECT chain_id, last + i - n AS seq, coalesce(prev, {_ZERO}) AS previous_event_hash, h AS event_hash FROM (SELECT *, lag(h) OVER (PARTITION BY chain_id ORDER BY i) AS prev FROM h) WHERE i > n""",
)
def inference_append(spark, sf):
    """Events of odd numbers appended to chains of those of even ones."""
    events = _ledger_events(spark, sf)
    ledger = provenance.well_formed(provenance.build_chain(events.where("seq % 2 = 0")))
    return provenance.append_inferences(ledger, events.where("seq % 2 = 1")).select("chain_id", "seq", "previous_event_hash", "event_hash")


@query(
    "dataset_digest",
    """WITH h AS (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS h FROM orders), p AS (SELECT ('0x' || substr(h, 1, 4))::INTEGER % 256 AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM p""",
)
def dataset_digest(spark, sf):
    orders = table(spark, sf, "orders")
    return provenance.dataset_digest(orders, F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus"), F.col("o_orderkey"))


@query("provenance_manifest", "SELECT event_id AS run_id, sha256(event_type) AS dataset_hash, sha256(user_id::VARCHAR) AS model_hash, sha256(props) AS config_hash, sha256('none') AS preprocess_hash, sha256('runtime') AS runtime_hash, sha256(event_id::VARCHAR) AS input_hash, sha256(event_type || props) AS output_hash, sha256('engine') AS engine_hash FROM events")
def provenance_manifest(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("dataset"), F.col("user_id").alias("model"), F.col("props").alias("config"), F.lit("none").alias("preprocess"), F.lit("runtime").alias("runtime"), F.col("event_id").alias("input"), F.concat("event_type", "props").alias("output"), F.lit("engine").alias("engine"))
    return provenance.provenance_manifest(runs)


def _certificates(spark, sf) -> DataFrame:
    verdicts = findings_policy(spark, sf).withColumn("model_sha256", F.sha2(F.col("subject_id").cast("string"), 256))
    return provenance.certificate_payload(verdicts)


_CERT = f"""{_FINDINGS}, cert AS (SELECT subject_id, verdict, sha256(subject_id::VARCHAR) AS model_sha256, '{{"evidence_strength":"' || evidence_strength || '","hard_gate_fired":' || hard_gate_fired || ',"hard_gates_triggered":[' || coalesce(array_to_string(list_transform(hard_gates, lambda g: '"' || g || '"'), ','), '') || '],"model_sha256":"' || sha256(subject_id::VARCHAR) || '","risk_hundredths":' || round(risk_score * 100)::BIGINT || ',"verdict":"' || verdict || '"}}' AS p FROM verdicts)"""


@query("cert_payload", f"WITH {_CERT} SELECT subject_id, verdict, model_sha256, p AS canonical_payload, sha256(p) AS cert_hash, sha256('assurance-engine' || p) AS signature, 'assurance-engine' AS signer_identity FROM cert")
def cert_payload(spark, sf):
    return _certificates(spark, sf)


@query(
    "cert_audit",
    f"""WITH {_CERT} SELECT subject_id AS cert_id, CASE subject_id % 9 WHEN 0 THEN 'MISSING_CANONICAL_PAYLOAD' WHEN 1 THEN 'MISSING_SIGNATURE' WHEN 2 THEN 'INVALID_SIGNER_IDENTITY' WHEN 3 THEN 'CERT_HASH_MISMATCH' WHEN 4 THEN 'MODEL_HASH_MISMATCH' WHEN 5 THEN 'VERDICT_MISMATCH' WHEN 6 THEN 'INVALID_SIGNATURE' ELSE 'VALID (Authentic Signed Certificate)' END AS status FROM cert""",
)
def cert_audit(spark, sf):
    k = F.col("subject_id") % 9
    change = {"canonical_payload": (0, F.lit(None)), "signature": (1, F.lit("")), "signer_identity": (2, F.lit("someone")), "cert_hash": (3, F.lit("0" * 64)), "model_sha256": (4, F.lit("f" * 64)), "verdict": (5, F.lit("NONE"))}
    certs = _certificates(spark, sf).withColumns({c: F.when(k == i, v).otherwise(F.col(c)) for c, (i, v) in change.items()})
    certs = certs.withColumn("signature", F.when(k == 6, "forged").otherwise(F.col("signature")))
    return provenance.audit_certificates(certs.withColumnRenamed("subject_id", "cert_id")).select("cert_id", "status")


@query(
    "cert_layouts",
    f"""WITH {_CERT} SELECT subject_id AS cert_id, CASE subject_id % 7 WHEN 0 THEN 'QR_PAYLOAD' WHEN 1 THEN 'FULL_JSON_CERTIFICATE' WHEN 2 THEN 'SIGNED_CHECKPOINT' WHEN 3 THEN 'EMBEDDED_QR_PAYLOAD' END AS layout, CASE subject_id % 7 WHEN 4 THEN 'MALFORMED_INPUT_JSON' WHEN 5 THEN 'INVALID_INPUT_TYPE' WHEN 6 THEN 'UNRECOGNIZED_FORMAT' ELSE 'VALID (Authentic Signed Certificate)' END AS status FROM cert""",
)
def cert_layouts(spark, sf):
    c = _certificates(spark, sf)
    body = F.concat(F.lit('"canonical_payload":'), "canonical_payload", F.lit(',"signature":"'), "signature", F.lit('"'))
    raw = (
        F.when(F.col("subject_id") % 7 == 0, F.concat(F.lit('{"spec_version":"QR-v1",'), body, F.lit("}")))
        .when(F.col("subject_id") % 7 == 1, F.concat(F.lit("{"), body, F.lit(',"certificate_header":{"cert_hash":"'), "cert_hash", F.lit('"}}')))
        .when(F.col("subject_id") % 7 == 2, F.concat(F.lit('{"signed_checkpoint":{"checkpoint_payload":'), "canonical_payload", F.lit(',"signature":"'), "signature", F.lit('"}}')))
        .when(F.col("subject_id") % 7 == 3, F.concat(F.lit('{"qr_payload":{'), body, F.lit(',"cert_hash":"'), "cert_hash", F.lit('"}}')))
        .when(F.col("subject_id") % 7 == 4, F.lit("{not json"))
        .when(F.col("subject_id") % 7 == 5, F.lit("[1, 2]"))
        .otherwise(F.lit('{"a": 1}'))
    )
    parsed = provenance.parse_certificates(c.select(F.col("subject_id").alias("cert_id"), raw.alias("raw")))
    return provenance.audit_certificates(parsed).select("cert_id", "layout", F.coalesce("parse_status", "status").alias("status"))


# ------------------------------------------------------------ generators and whole scans


@query("inject_duplicates", "SELECT a.vec_id AS id, round(list_sum(b.embedding::DOUBLE[]), 4) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = CASE WHEN a.vec_id % 40 = 7 THEN a.vec_id - 7 ELSE a.vec_id END")
def inject_duplicates(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("pixels"))
    mapping = rows.where("id % 40 = 7").select((F.col("id") - 7).alias("src"), F.col("id").alias("dst"))
    return generators.inject_duplicates(rows, mapping).select("id", F.round(E.total(E.doubles(F.col("pixels"))), 4).alias("total"))


@query("inject_trigger", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE label END AS label, round(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN vec_id % 5 = 0 AND i // 8 BETWEEN 5 AND 7 AND i % 8 BETWEEN 5 AND 7 THEN 1.0 ELSE embedding[i + 1]::DOUBLE END)), 4) AS total FROM embeddings")
def inject_trigger(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("pixels"))
    changed = generators.inject_trigger(rows, 8, F.col("id") % 5 == 0, at=5)
    return changed.select("id", "label", F.round(E.total(E.doubles(F.col("pixels"))), 4).alias("total"))


_BURST = f"CASE WHEN z[2] // 8 BETWEEN 2 AND 4 AND z[2] % 8 BETWEEN 2 AND 4 THEN (0.7::DOUBLE + 0.3::DOUBLE * {counter.unit_sql('id', 'z[2]', seed=9)})::FLOAT ELSE z[1] END"


@query(
    "inject_outliers",
    f"""WITH e AS (SELECT vec_id AS id, embedding AS p FROM embeddings)
SELECT kind, id, round(CASE WHEN id NOT IN (3, 5, 8) THEN list_sum(p::DOUBLE[]) WHEN kind = 'checkerboard' THEN 32.0 WHEN kind = 'constant' THEN 64 * 0.95::FLOAT::DOUBLE ELSE list_sum(list_transform(list_zip(p, range(64)), lambda z: {_BURST})::DOUBLE[]) END, 4) AS total
FROM e, (VALUES ('checkerboard'), ('constant'), ('burst')) AS t(kind)""",
)
def inject_outliers(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("pixels"))
    each = [generators.inject_outliers(rows, [3, 5, 8], kind, 8).select(F.lit(kind).alias("kind"), "id", F.round(E.total(E.doubles(F.col("pixels"))), 4).alias("total")) for kind in ("checkerboard", "constant", "burst")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    "synthesize_samples",
    f"""WITH c AS (SELECT c_custkey AS id, (c_custkey % 10)::INTEGER AS label FROM customer), b AS (SELECT id, label, 2 * label % 20 + 2 AS t, (2 * label + 1) % 20 + 2 AS l FROM c)
SELECT id, label, round(list_sum(list_transform(range(784), lambda i: least({counter.unit_sql('id', 'i', seed=5)} * 0.3::DOUBLE + CASE WHEN i // 28 BETWEEN t AND t + 3 AND i % 28 BETWEEN l AND l + 3 THEN 0.7::DOUBLE ELSE 0.0 END, 1.0)::FLOAT::DOUBLE)), 4) AS total FROM b""",
)
def synthesize_samples(spark, sf):
    """A synthetic image for each customer's id."""
    rows = generators.samples_of(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))
    return rows.select("id", "label", F.round(E.total(E.doubles(F.col("pixels"))), 4).alias("total"))


@query(
    "shifted_drift",
    """WITH v AS (SELECT true AS ref, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings UNION ALL SELECT false, sin(i * (10.0::DOUBLE / 63))::FLOAT::DOUBLE, i FROM embeddings, range(64) t(i) WHERE vec_id % 2 = 1),
n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT dim, min(value) AS w FROM v WHERE NOT ref GROUP BY 1),
k AS (SELECT dim, greatest(count(*) FILTER (WHERE value < w), n.n - count(*) FILTER (WHERE value <= w))::DOUBLE / n.n AS ks FROM v JOIN w USING (dim), n WHERE ref GROUP BY dim, n.n)
SELECT dim, round(ks, 6) AS ks FROM k""",
)
def shifted_drift(spark, sf):
    """A batch of sine waves, one for each odd sample, against all samples: every dimension drifts."""
    rows = _embeddings(spark, sf)
    waves = generators.waves_of(rows.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id")), 64)
    values = drift.explode_dims(rows, "embedding", "ref").unionByName(drift.explode_dims(waves, "pixels", "live"))
    return drift.ks_per_dim(values).select("dim", F.round("ks", 6).alias("ks"))


@query(
    "scan_dataset",
    f"""WITH {_NEAR}, {_DUP_RISK}, fe AS (SELECT id, p AS v FROM s), {_forest_sql("fe")}, {_ANOMALY_RISK},
px AS (SELECT count(*) AS samples, sum(list_sum(p)) / sum(len(p)) AS m, sum(list_sum(list_transform(p, lambda x: x * x))) / sum(len(p)) AS q, min(list_min(p)) AS lo, max(list_max(p)) AS hi FROM s)
SELECT samples, '8 × 8' AS shape, 1 AS shapes, round(m, 4) AS mean, round(sqrt(q - m * m), 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, n_pairs, n_exact, n_members, n_anomalies, d.risk AS duplicate_risk, a.risk AS anomaly_risk,
CASE WHEN n_pairs > 0 AND n_anomalies > 0 THEN round(least(98.0, greatest(d.risk, a.risk) + 0.15::DOUBLE * least(d.risk, a.risk)), 1) WHEN n_pairs > 0 OR n_anomalies > 0 THEN greatest(d.risk, a.risk) ELSE 0.0 END AS risk,
CASE WHEN n_pairs > 0 OR n_anomalies > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS evidence_strength, CASE WHEN n_pairs > 0 OR n_anomalies > 0 THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict,
true AS shape_ok, NULL::VARCHAR AS shape_finding, 'training_eval' AS role, 'Training / Evaluation Dataset Assurance' AS protocol FROM px, risk d, arisk a""",
)
def scan_dataset(spark, sf):
    return pipelines.scan_dataset(_samples(spark, sf).withColumn("shape", F.array(F.lit(8), F.lit(8))), "training_eval", hash_bits=56)


def _model_weights(spark, sf, models: DataFrame) -> DataFrame:
    """The tables hold no models: every fifth has sharper weights, whose predictions no overlay unsettles; some lie between."""
    sharp = F.when(F.col("model_id") % 5 == 0, 1000.0).when(F.col("model_id") % 5 == 1, 40.0).otherwise(1.0)
    # a model's few bytes become weights, so models are dealt over tasks by their number
    dealt = models.select("model_id").repartition(models.count() // 4096 + 1, "model_id")
    return dealt.crossJoin(F.broadcast(scorers.centroids(_embeddings(spark, sf)))).withColumn("centroid", F.transform("centroid", lambda x: x * sharp))


def _strip_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _embeddings(spark, sf)
    samples = rows.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return samples, rows.where("vec_id < 50").select(F.col("vec_id").alias("position"), F.col("embedding").alias("overlay"))


#: Mean, deviation and least entropy of the blends of odd samples under each sharpness of the weights.
_STRIP = f"""{_SCORE}, o AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id < 50),
d AS (SELECT vec_id AS id, k, embedding::DOUBLE[] AS s, ('0x' || substr(md5(vec_id || ':' || k), 1, 8))::BIGINT % 50 AS pos FROM embeddings, range(0, 20) t(k) WHERE vec_id % 2 = 1),
bl AS (SELECT id, k, list_transform(list_zip(s, o), lambda z: z[1] * 0.5 + z[2] * 0.5) AS v FROM d JOIN o USING (pos)),
lo AS (SELECT sharp, list_transform({_LOGITS}, lambda a: a * sharp) AS l FROM bl, w, (VALUES (1000.0::DOUBLE), (40.0::DOUBLE), (1.0::DOUBLE)) AS t(sharp)), ex AS (SELECT sharp, list_transform(l, lambda a: exp(a - list_max(l))) AS e FROM lo),
pr AS (SELECT sharp, list_transform(e, lambda a: a / list_sum(e)) AS p FROM ex), en AS (SELECT sharp, -list_sum(list_transform(p, lambda a: greatest(a, 1e-12) * log2(greatest(a, 1e-12)))) AS h FROM pr),
strip AS (SELECT sharp, avg(h) AS m, stddev_pop(h) AS s, min(h) AS lo, count(*) AS n FROM en GROUP BY 1),
sharps AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 1000.0 WHEN 1 THEN 40.0 ELSE 1.0 END::DOUBLE AS sharp FROM customer)"""


@query("strip_models", f"WITH {_STRIP} SELECT id AS model_id, round(m, 4) AS mean_entropy, round(s, 4) AS std_entropy, round(lo, 4) AS min_entropy, n AS variants, m < 0.35 AS triggered FROM sharps JOIN strip USING (sharp)")
def strip_models(spark, sf):
    """The entropy of many models over the same samples and overlays."""
    out = entropy.overall_by_model(*_strip_inputs(spark, sf), 50, _model_weights(spark, sf, _artifacts(spark, sf)[0]))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_entropy", "std_entropy", "min_entropy")})


@query(
    "scan_model",
    f"""WITH {_GATE}, {_STRIP}, {_CDF.replace("v AS", "dv AS", 1).replace("FROM v GROUP", "FROM dv GROUP").replace("c AS (SELECT dim", "dc AS (SELECT dim").replace("FROM c WINDOW", "FROM dc WINDOW")}, {_TAMPER},
drift AS (SELECT avg(ks) AS k FROM ks),
found AS (SELECT subject_id, pos, finding_type, title, r, 3 AS rank, true AS gate FROM gate
  UNION ALL SELECT chain_id, -1, 'BROKEN_AUDIT_CHAIN', 'Broken Audit Ledger Chain', 100.0, 3, true FROM bad JOIN m ON chain_id = id WHERE b IS NOT NULL
  UNION ALL SELECT id, 9, NULL, CASE WHEN x.m < 0.35 THEN 'High-Strength Trojan Indicator' ELSE 'Trojan Behavioral Analysis Passed' END, CASE WHEN x.m < 0.35 THEN 95.0 ELSE 5.0 END, 3, x.m < 0.35 FROM m JOIN sharps USING (id) JOIN strip x USING (sharp) WHERE ok
  UNION ALL SELECT id, 10, NULL, 'distribution-shift / input-anomaly indicator', CASE WHEN k >= 0.5 THEN 70.0 WHEN k >= 0.25 THEN 40.0 ELSE 0.0 END, CASE WHEN k >= 0.5 OR k < 0.25 THEN 3 ELSE 2 END, false FROM m, drift),
each AS (SELECT subject_id, count(*) AS n, round(avg(r), 2)::DOUBLE AS mean, max(rank) AS rank, coalesce(list(title ORDER BY pos) FILTER (WHERE gate), []::VARCHAR[]) AS hard_gates FROM found GROUP BY 1)
SELECT subject_id, n AS n_findings, CASE WHEN len(hard_gates) > 0 THEN 'QUARANTINE' WHEN mean >= 50 THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict, CASE WHEN len(hard_gates) > 0 THEN greatest(mean, 95.0) ELSE mean END AS risk_score,
  ['LOW', 'MEDIUM', 'HIGH'][rank] AS evidence_strength, len(hard_gates) > 0 AS hard_gate_fired, hard_gates FROM each""",
)
def scan_model(spark, sf):
    models, manifest, issues = _artifacts(spark, sf)
    rows = _embeddings(spark, sf)
    chains = provenance.validate_chain(_tampered(spark, sf)).withColumnRenamed("chain_id", "subject_id")
    samples, overlays = _strip_inputs(spark, sf)
    return pipelines.scan_models(models, manifest, _nodes(spark, sf), _inputs(spark, sf), _filled(spark, sf), issues, rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), chains, samples, overlays, 50, _model_weights(spark, sf, models))


def _folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("array_files", "SELECT round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding)::BIGINT AS width, count(*) AS n FROM embeddings GROUP BY 1, 2")
def array_files(spark, sf):
    """All vectors written as .npy files and read back by row ranges."""
    folder = _folder(spark, "arrays")
    checkpointed(arrays.write_arrays(_embeddings(spark, sf), folder, "embedding"))  # writes
    rows = readers.read_samples(spark, folder, "npy", whole=0)
    return rows.groupBy(F.round(E.total(E.doubles(F.col("pixels"))), 4).alias("total"), F.element_at("shape", 1).cast("bigint").alias("width")).agg(F.count("*").alias("n"))



@query(
    "scan_images",
    f"""WITH g AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(greatest(0.0, least(255.0, 128 + 255 * x::DOUBLE)))::INTEGER) AS p FROM embeddings),
r AS (SELECT id, list_transform(range(72), lambda i: round(list_sum(list_transform(range(8), lambda k: {_WIDE}[i % 9 + 1][k + 1] * (p[i // 9 * 8 + k + 1] / 255.0::DOUBLE))), 9)) AS r FROM g)
SELECT id, 'PNG' AS format, lower(printf('%08x', hi) || printf('%08x', lo)) AS hash, 'UNGUARANTEED' AS status, 'UNGUARANTEED_NO_CALIBRATION' AS finding_type, 0.0::DOUBLE AS risk_score
FROM (SELECT id, {_BITS} AS hi, {_BITS.replace("r[", "r[36 + ")} AS lo FROM r)
UNION ALL SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'REJECTED_GIF' ELSE 'PNG' END, NULL, 'REJECTED', 'REJECTED_MALFORMED_IMAGE', 100.0 FROM pages WHERE page_id % 50 < 2""",
)
def scan_images(spark, sf):
    """Vectors as PNG files of 8 x 8 gray pixels, and some pages' bytes behind leading bytes of images; hashes and outcomes of all, without a calibration."""
    folder = _folder(spark, "images")
    gray = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 255 * x.cast("double")))).cast("int"))
    written = checkpointed(arrays.write_images(_embeddings(spark, sf).select(F.concat(F.lit("v"), "vec_id").alias("name"), gray.alias("pixels")), folder, 8))
    head = F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("474946383961"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452000000080000000808000000")))
    broken = table(spark, sf, "pages").where("page_id % 50 < 2").select(F.concat(F.lit("p"), "page_id", F.lit(".png")).alias("path"), F.concat(head, F.encode(F.col("html"), "UTF-8")).alias("content"))
    files = readers.read_artifacts(spark, folder).select("path", "length", "content", "sha256")
    files = files.unionByName(broken.select("path", F.length("content").cast("bigint").alias("length"), "content", F.sha2("content", 256).alias("sha256")))
    none = spark.createDataFrame([], "num_samples long, mean_entropy double, anomaly_entropy_threshold double, max_prediction_distribution_distance double, max_flip_rate_threshold double, max_js_divergence_threshold double, pred_class_distribution array<double>")
    score = lambda df: scorers.linear_probabilities(df.withColumn("vector", F.slice("vector", 1, 64)), scorers.centroids(_embeddings(spark, sf)), "vector")
    out = pipelines.scan_images(files, readers.read_images(spark, folder), score, none, side=8)
    return out.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("id"), "format", "hash", "status", "finding_type", "risk_score")


# ------------------------------------------------------------ shapes and charts


@query("shape_check", "SELECT count(*) AS n, count(DISTINCT len(embedding)) = 1 AND count(*) > 0 AS shape_ok, CASE WHEN count(DISTINCT len(embedding)) = 1 AND count(*) > 0 THEN NULL ELSE 'UNGUARANTEED_UNSUPPORTED_SHAPE' END AS shape_finding, CASE WHEN count(DISTINCT len(embedding)) = 1 AND count(*) > 0 THEN 0.0 ELSE 80.0 END::DOUBLE AS shape_risk FROM embeddings")
def shape_check(spark, sf):
    return pipelines.validate_shape(_embeddings(spark, sf).select(F.array(F.size("embedding")).alias("shape")))


@query("ragged_shape_check", "SELECT count(*) AS n, false AS shape_ok, 'UNGUARANTEED_UNSUPPORTED_SHAPE' AS shape_finding, 80.0::DOUBLE AS shape_risk FROM conversations HAVING count(DISTINCT length(text)) > 1")
def ragged_shape_check(spark, sf):
    """Texts as samples of their own lengths: no common shape."""
    return pipelines.validate_shape(table(spark, sf, "conversations").select(F.array(F.length("text")).alias("shape")))


@query(
    "scaled_points",
    """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM p)
SELECT id, round(x / CASE WHEN m > 1e-6 THEN m ELSE 1 END, 4) AS x, round(y / CASE WHEN m > 1e-6 THEN m ELSE 1 END, 4) AS y FROM p, m""",
)
def scaled_points(spark, sf):
    """The first two coordinates of each vector as chart points."""
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return anomalies.scale_coords(rows.select("id", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y")))
