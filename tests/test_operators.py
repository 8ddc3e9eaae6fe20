"""Operators on literal tables: expected values, edge cases, and properties."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import counter
from plumbline.functions import exprs as E
from plumbline.operators import anomalies, drift, duplicates, embedders, entropy, generators, inventory, policy, provenance, ranges, scorers, stability, triage
from plumbline.plans import pipelines
from plumbline.sources import readers


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_softmax_and_entropies(spark):
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    e = np.exp([1.0, 2.0, 3.0]) / np.exp([1.0, 2.0, 3.0]).sum()
    assert np.allclose(one(spark, E.softmax(v)), e)
    assert one(spark, E.entropy_bits(E.softmax(v))) == pytest.approx(-(e * np.log2(e)).sum())
    assert one(spark, E.entropy_nats(F.array(F.lit(1.0), F.lit(0.0)))) == pytest.approx(0, abs=1e-9)
    assert one(spark, E.js_divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == pytest.approx(np.log(2), abs=1e-6)
    assert one(spark, E.js_divergence(v, v)) == 0
    assert one(spark, E.argmax(F.array(F.lit(0.5), F.lit(0.5)))) == 0


def test_pixels(spark):
    f = lambda *x: F.array(*(F.lit(float(v)) for v in x)).cast("array<float>")
    assert one(spark, E.scale_pixels(f(0, 0.5, 1))) == [0, 127, 255]
    assert one(spark, E.scale_pixels(f(-3, 12.9, 400))) == [0, 12, 255]
    assert one(spark, E.translate(f(1, 2, 3, 4), 2)) == [0, 0, 0, 1]
    assert one(spark, E.to_grayscale(f(1, 2, 3, 4), F.lit(2), F.lit(2))) == [2, 3]
    assert one(spark, E.brightness(f(0.5, 1))) == pytest.approx([0.55, 1.0])
    flat = one(spark, E.blur(f(*[0.3] * 16), 4))
    assert flat == pytest.approx([0.3] * 16, abs=1e-6)
    assert one(spark, E.dhash(f(3, 2, 1, 1, 2, 3), 3, 2)) == 0b1100
    noisy = one(spark, E.noise(f(*[0.5] * 400), 0.1, F.lit(7)))
    assert abs(np.mean(noisy) - 0.5) < 0.03 and abs(np.std(noisy) - 0.1) < 0.02


@pytest.mark.parametrize(
    "head, kind",
    [("89504E470D0A1A0A00", "PNG"), ("FFD8FFE1", "JPEG"), ("524946460000000057454250", "WEBP"), ("5249464600000000AAAA", "UNKNOWN"), ("4D5A90", "REJECTED_EXECUTABLE"), ("20203C735647", "REJECTED_SVG"), ("03C7376670", "UNKNOWN"), ("", "UNKNOWN")],
)
def test_sniff(spark, head, kind):
    assert one(spark, E.sniff_format(F.lit(head))) == kind


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [round(rng.random(), 3) for _ in range(16)]) for i in range(40)]
    rows += [(100 + i, [x + rng.choice([0, 0, 0.05]) for x in rows[i][1]]) for i in range(20)] + [(200, rows[0][1]), (201, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, pixels array<double>").withColumn("hash", E.dhash(F.col("pixels"), 4, 4))
    hashes = {r["id"]: r["hash"] for r in df.collect()}
    want = set()
    for a, p in rows:
        for b, q in rows:
            mse = sum((x - y) ** 2 for x, y in zip(p, q)) / 16
            if a < b and (p == q or (bin(hashes[a] ^ hashes[b]).count("1") <= 4 and mse <= 0.001)):
                want.add((a, b))
    got = duplicates.near_duplicate_pairs(df, 12)
    assert {(r["i"], r["j"]) for r in got.collect()} == want
    assert {(r["i"], r["j"]) for r in duplicates.near_duplicate_pairs(df.repartition(7), 12).collect()} == want
    assert got.where("exact").count() == 3
    assert duplicates.near_duplicate_pairs(df.where("id < 0"), 12).count() == 0


@pytest.mark.parametrize("pairs, risk", [([(5, 15), (12, 28), (20, 45)], 38.4), ([], 0.0)])
def test_duplicate_risk(spark, pairs, risk):
    df = spark.createDataFrame([(*p, 0, 0.0, True) for p in pairs], "i long, j long, hamming int, mse double, exact boolean")
    row = duplicates.duplicate_risk(df, spark.range(100).agg(F.count("*").alias("n")))
    assert row.first()["risk"] == risk
    assert duplicates.duplicate_finding(row).first()["finding_type"] == ("DATASET_DUPLICATE_SAMPLES" if pairs else "DATASET_DUPLICATE_CLEAN")


def test_exact_groups_count_pairs_without_making_them(spark):
    df = spark.createDataFrame([(i, b"a") for i in range(5)] + [(9, b"b")], "id long, c binary")
    row = duplicates.exact_duplicate_risk(duplicates.exact_duplicate_groups(df, "id", F.col("c")), df.agg(F.count("*").alias("n"))).first()
    assert (row["n_pairs"], row["n_members"]) == (10, 5)


def test_drift(spark):
    ref = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<double>")
    assert drift.check_input(None, ref, "v").first()["mean_ks"] == 0
    far = ref.withColumn("v", F.transform("v", lambda x: x + 1000))
    row = drift.check_input(ref, far, "v").first()
    assert (row["status"], row["risk_score"], row["is_hard_gate"]) == ("HIGH", 70.0, False)
    values = drift.explode_dims(ref, "v", "ref").unionByName(drift.explode_dims(far, "v", "live"))
    assert {r["distance"] for r in drift.wasserstein_per_dim(values).collect()} == {1000.0}


def test_isolation_forest_flags_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(400)] + [(1000 + i, (rng.normal(0, 1, 8) + 30).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    scores = {r["id"]: r["score"] for r in anomalies.score_isolation_forest(df, anomalies.fit_isolation_forest(df)).collect()}
    again = {r["id"]: r["score"] for r in anomalies.score_isolation_forest(df, anomalies.fit_isolation_forest(df.repartition(5))).collect()}
    assert scores == again
    assert set(sorted(scores, key=scores.get)[:3]) == {1000, 1001, 1002}
    points = anomalies.pca_2d(df).agg(F.abs(F.avg("x")).alias("x")).first()
    assert points["x"] < 1e-6


def test_embedding_is_fixed(spark):
    samples = generators.synthesize_samples(spark, 70, side=16)
    fixed = embedders.FixedProjection(16)
    a, b, c = (embedders.embed(s.select("id", "pixels"), fixed, batch=n).orderBy("id").collect() for s, n in ((samples, 64), (samples.repartition(3), 1), (samples.repartition(5), 7)))
    assert a == b == c and len(a[0]["vector"]) == 64
    mix = fixed.mix()
    assert np.allclose(mix @ mix.T, np.eye(64))
    other = embedders.embed(samples.select("id", "pixels"), embedders.FixedProjection(16, seed=99)).orderBy("id").collect()
    assert other != a


def test_any_embedder(spark):
    samples = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, pixels array<float>")
    got = embedders.embed(samples, lambda x: x.sum(axis=1, keepdims=True)).collect()
    assert sorted(tuple(r) for r in got) == [("a", [3.0]), ("b", [7.0])]


def test_stability_without_calibration(spark):
    scored = spark.createDataFrame([(1, "baseline", [0.9, 0.1]), (1, "noise", [0.2, 0.8])], "id long, variant string, probs array<double>")
    metrics = stability.stability_metrics(scored)
    assert metrics.first()["flip_rate"] == 1.0
    none = stability.fit_calibration(scored).limit(0)
    assert stability.stability_verdict(metrics, none).first()["status"] == "UNGUARANTEED"
    row = stability.stability_verdict(metrics, stability.fit_calibration(scored)).first()
    assert row["status"] == "SUSPICIOUS" and "flip_rate" in row["reasons"] and row["risk_score"] == 90.0


def test_entropy_trigger(spark):
    sure = spark.createDataFrame([(1, k, [1.0, 0.0]) for k in range(20)], "id long, k int, probs array<double>")
    row = entropy.trojan_finding(entropy.entropy_overall(sure)).first()
    assert (row["risk_score"], row["is_hard_gate"]) == (95.0, True)
    assert entropy.trojan_finding(entropy.entropy_overall(sure.limit(0))).first()["is_hard_gate"] is False


def test_scorers(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, pixels array<float>")
    rows = scorers.score_vectors(df, lambda x: x * 3, batch=1).orderBy("id").collect()
    assert rows[0]["probs"] == pytest.approx(one(spark, E.softmax(F.array(F.lit(3.0), F.lit(0.0)))))


def finding(subject, risk, kind="X", strength="LOW", gate=False, title="t", pos=0):
    return (subject, pos, kind, title, risk, strength, gate)


FINDING = "subject_id string, pos int, finding_type string, title string, risk_score double, evidence_strength string, is_hard_gate boolean"


def test_policy(spark):
    df = spark.createDataFrame(
        [finding("clean", 5.0), finding("clean", 0.0, strength="HIGH"), finding("review", 60.0), finding("type", 10.0, "MANIFEST_MISMATCH"), finding("title", 10.0, title="High-Strength Trojan Indicator"), finding("flag", 99.0, gate=True)], FINDING
    )
    got = {r["subject_id"]: (r["verdict"], r["risk_score"]) for r in policy.evaluate_policy(df).collect()}
    assert got == {"clean": ("ACCEPT", 2.5), "review": ("REVIEW", 60.0), "type": ("QUARANTINE", 95.0), "title": ("QUARANTINE", 95.0), "flag": ("QUARANTINE", 99.0)}


def chains(spark):
    events = [(c, s, "ab" * 32, f'{{"k": {s}}}', 10 * s) for c in (1, 2) for s in range(5)]
    return provenance.build_chain(spark.createDataFrame(events, "chain_id long, seq long, model_sha256 string, manifest string, ts_us long"))


@pytest.mark.parametrize(
    "column, value, code",
    [("manifest", "{}", "INCORRECT_EVENT_HASH"), ("previous_event_hash", "deadbeef" * 8, "BROKEN_CHAIN_LINK"), ("event_hash", "deadbeef" * 8, "INCORRECT_EVENT_HASH"), ("model_sha256", "zz", "INVALID_MODEL_SHA256"), ("ts_us", -5, "INCORRECT_EVENT_HASH"), ("parsed", False, "MALFORMED_JSON_LINE"), ("is_object", False, "INVALID_RECORD_FORMAT"), ("has_fields", False, "MISSING_REQUIRED_FIELD")],
)
def test_tampering_is_found(spark, column, value, code):
    rows = provenance.well_formed(chains(spark))
    changed = rows.withColumn(column, F.when((F.col("chain_id") == 1) & (F.col("seq") == 2), F.lit(value)).otherwise(F.col(column)))
    got = {r["chain_id"]: r for r in provenance.validate_chain(changed).collect()}
    assert got[1]["status"] == f"{code} (Line 3)" and got[1]["verified"] == 2
    assert got[2]["status"] == "VALID_AUDIT_CHAIN (5 events verified)"
    heads = {r["chain_id"]: r["head"] for r in provenance.chain_head(changed).collect()}
    built = {(r["chain_id"], r["seq"]): r["event_hash"] for r in rows.collect()}
    assert heads == {1: built[1, 1], 2: built[2, 4]}


def test_order_of_times(spark):
    events = spark.createDataFrame([(1, 0, "ab" * 32, "{}", 50), (1, 1, "ab" * 32, "{}", 40)], "chain_id long, seq long, model_sha256 string, manifest string, ts_us long")
    assert provenance.validate_chain(provenance.well_formed(provenance.build_chain(events))).first()["status"] == "EVENT_ORDERING_ERROR (Line 2)"


def test_digest_ignores_order_only(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("r"))
    digest = lambda d: provenance.dataset_digest(d, F.col("r"), F.col("r")).first()["digest"]
    assert digest(df) == digest(df.repartition(9)) != digest(df.union(df.limit(1)))


NODES = "model_id string, node_path string, domain string, op_type string"
INPUTS = "model_id string, input_name string, dim_pos int, dim_value long, dim_param string"


def test_firewall(spark):
    models = spark.createDataFrame([("clean",), ("op",), ("domain",), ("big",), ("wide",), ("weight",)], "model_id string")
    nodes = spark.createDataFrame([("clean", "0", "", "Relu"), ("op", "0", "", "CustomMaliciousOp"), ("op", "1", "", "CustomMaliciousOp"), ("domain", "0", "custom.unapproved.domain", "Relu")], NODES)
    dims = lambda m, *ds: [(m, "x", i, d, None if d is not None else "N") for i, d in enumerate(ds)]
    inputs = spark.createDataFrame(dims("clean", None, 3, 224, 224) + dims("big", 1, 50, 1000, 1000) + dims("wide", 1, 100_000, 1, 1) + dims("weight", 50_000, 50_000), INPUTS)
    held = spark.createDataFrame([("weight", "x")], "model_id string, name string")
    got = {r["model_id"]: r["violations"] for r in inventory.firewall_report(models, nodes, inputs, held).collect()}
    assert got["clean"] == [] and got["weight"] == []
    assert got["op"] == ["DISALLOWED_OPERATOR: CustomMaliciousOp"] * 2
    assert got["domain"] == ["DISALLOWED_DOMAIN: custom.unapproved.domain::Relu"]
    assert got["big"] == ["INPUT_ELEMENTS: x", "TOTAL_INPUT_ELEMENTS"] and got["wide"] == ["INPUT_DIMENSION: x"]


def test_overflowing_dims(spark):
    inputs = spark.createDataFrame([("m", "x", i, 9_000_000_000_000_000_000, None) for i in range(4)], INPUTS)
    assert inventory.input_budget(inputs).first()["within_budget"] is False


def test_manifest(spark):
    models = spark.createDataFrame([("a", "AB"), ("b", "cd")], "model_id string, sha256 string")
    manifest = spark.createDataFrame([(1, "second", "ab"), (0, "first", "Ab")], "position int, model_id string, sha256 string")
    got = {r["model_id"]: r["status"] for r in inventory.verify_manifest(models, manifest).collect()}
    assert got == {"a": "MANIFEST_VERIFIED_OK (Approved ID: first)", "b": "MANIFEST_MISMATCH_UNAPPROVED_MODEL"}
    assert {r["status"] for r in inventory.verify_manifest(models, None).collect()} == {"MANIFEST_NOT_FOUND"}


def test_resource_limits(spark):
    rows = spark.createDataFrame([(1, 100, 4500, 100), (2, 0, 1, 1), (3, 2008, 1920, 1080), (4, 20_000_000, 1, 1), (5, 10, 4096, 4096)], "id int, length long, width long, height long")
    got = {r["id"]: r["reason"] for r in triage.gate_resource_profile(rows).collect()}
    assert got == {1: "image dimension exceeds the limit", 2: "empty file", 3: None, 4: "file size exceeds the limit", 5: "pixel count exceeds the limit"}
    assert one(spark, triage.classify_rejection(F.array(F.lit("pixel count exceeds the limit")))) == "REJECTED_RESOURCE_LIMIT"


def test_scan_images_opens_files_once(spark, tmp_path):
    """The plan of a scan reads what was stored of the files, not the files again for every branch."""
    (tmp_path / "a.png").write_bytes(png([[0, 255, 10], [5, 6, 7], [9, 1, 0]]))
    none = spark.createDataFrame([], "pred_class_distribution array<double>")
    score = lambda df: df.withColumn("probs", F.array(F.lit(0.5), F.lit(0.5)))
    out = pipelines.scan_images(readers.read_artifacts(spark, str(tmp_path)), readers.read_images(spark, str(tmp_path)), score, none, side=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and " image" not in plan
    assert [r["status"] for r in out.collect()] == ["UNGUARANTEED"]


def test_digests_of_weights(spark):
    """Models of equal weights share a scorer, whatever the order of their rows."""
    w = [[0.5, -1.0], [2.0, 0.0], [2.0, None], [2.0], None]
    rows = [(1, 0, w[0]), (1, 1, w[1]), (2, 1, w[1]), (2, 0, w[0]), (3, 0, w[1]), (3, 1, w[0]), (4, 0, w[0]), (4, 1, w[2]), (5, 0, w[0]), (5, 1, w[3]), (6, 0, w[0]), (6, 1, w[4]), (None, 0, w[0]), (None, 1, w[1])]
    for n in (1, 5):
        weights = spark.createDataFrame(rows, "model_id long, label int, centroid array<double>").repartition(n)
        got = {r["model_id"]: r["scorer"] for r in entropy.scorer_digests(weights).collect()}
        assert got[1] == got[2] == got[None] and len({got[i] for i in (1, 3, 4, 5, 6)}) == 5
    samples = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(600)], "id long, vector array<double>").coalesce(1)
    overlays = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "position long, overlay array<double>")
    equal = spark.createDataFrame([r for r in rows if r[0] in (None, 1, 2, 3)], "model_id long, label int, centroid array<double>")
    out = {r["model_id"]: tuple(r)[1:] for r in entropy.overall_by_model(samples, overlays, 2, equal, draws=3).collect()}
    assert out[1] == out[2] == out[None] and out[1][3] == 1800 and set(out) == {1, 2, 3, None}


def test_images_of_ids_are_dealt_over_tasks(spark):
    """Ids that one file's only part holds; odd ones have the pixels that the column expressions of the rule give."""
    assert generators.samples_of(spark.range(0, 5000, 1, 1)).rdd.getNumPartitions() >= 3
    ids = spark.createDataFrame([(0,), (7,), (-13,), (-3,), (None,), (1 << 31,), ((1 << 62) + 9,), (7,)], "id long").coalesce(1)
    label = (F.col("id") % 10).cast("int")
    top, left = (2 * label) % 20 + 2, (2 * label + 1) % 20 + 2

    def pixel(i):
        row, column = F.floor(i / 28), i % 28
        inside = (row >= top) & (row < top + 4) & (column >= left) & (column < left + 4)
        return F.least(counter.unit(F.col("id"), i, seed=5) * 0.3 + F.when(inside, 0.7).otherwise(0.0), F.lit(1.0)).cast("float")

    want = ids.select("id", label.alias("label"), F.transform(F.sequence(F.lit(0), F.lit(783)), pixel).alias("pixels"))
    got = generators.samples_of(ids)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert generators.samples_of(ids.limit(0)).count() == 0


def test_generators(spark):
    samples = generators.synthesize_samples(spark, 30, side=28)
    assert samples.select(F.max(F.array_max("pixels"))).first()[0] <= 1.0
    mapped = generators.inject_duplicates(samples, spark.createDataFrame([(5, 15), (12, 28)], "src long, dst long"))
    pairs = duplicates.near_duplicate_pairs(mapped.select("id", "pixels", E.dhash(F.col("pixels"), 9, 8).alias("hash")), 63)
    assert {(r["i"], r["j"]) for r in pairs.where("exact").collect()} == {(5, 15), (12, 28)}
    assert generators.inject_outliers(samples, [1], "constant", 28).where("id = 1 and array_min(pixels) > 0.94").count() == 1
    assert generators.shifted_batch(spark, 2).count() == 2


def png(pixels):
    """A gray PNG of rows of bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in pixels))) + chunk(b"IEND", b"")


def test_scan_images(spark, tmp_path):
    rng = random.Random(3)
    ramp = [[(4 * c + r) % 256 for c in range(40)] for r in range(30)]
    (tmp_path / "good.png").write_bytes(png(ramp))
    (tmp_path / "speckled.png").write_bytes(png([[rng.choice([0, 255]) for _ in range(40)] for _ in range(30)]))
    (tmp_path / "cut.png").write_bytes(png(ramp)[:60])
    (tmp_path / "wide.png").write_bytes(png([[0] * 5000]))
    (tmp_path / "tool.png").write_bytes(b"MZ" + b"\0" * 100)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    weights = spark.createDataFrame([(k, [3.0 * k * (i % 28 > 13) - 1.5 * k for i in range(784)]) for k in (0, 1)], "label long, centroid array<double>")
    score = lambda shown: scorers.linear_probabilities(shown, weights, "vector")
    clean = pipelines.image_vectors(readers.read_images(spark, str(tmp_path)), 28).where("path like '%good%'")
    calibration = stability.fit_calibration(score(clean.select(F.col("path").alias("id"), F.lit("baseline").alias("variant"), "vector")))
    scan = lambda c: {r["path"].rpartition("/")[2]: r for r in pipelines.scan_images(files, readers.read_images(spark, str(tmp_path)), score, c).collect()}
    got = scan(calibration)
    assert len(got) == 5
    assert [got[n]["status"] for n in ("cut.png", "wide.png", "tool.png")] == ["REJECTED"] * 3
    assert got["wide.png"]["finding_type"] == "REJECTED_RESOURCE_LIMIT" and got["cut.png"]["finding_type"] == "REJECTED_MALFORMED_IMAGE"
    assert got["good.png"]["status"] == "SAFE_UNDER_CHECKS" and len(got["good.png"]["hash"]) == 16
    assert got["speckled.png"]["status"] in ("SAFE_UNDER_CHECKS", "SUSPICIOUS")
    assert scan(calibration.limit(0))["good.png"]["finding_type"] == "UNGUARANTEED_NO_CALIBRATION"


def test_hashes_of_64_bits(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(100)) for _ in range(81)]) for i in range(30)] + [(100, [0.0] * 81), (101, [0.0] * 81), (102, [0.0] * 81)]
    df = spark.createDataFrame(rows, "id long, pixels array<double>")
    hashed = df.select("id", "pixels", E.dhash(F.col("pixels"), 9, 8).alias("hash"))
    for r in hashed.collect():
        bits = "".join(str(int(r["pixels"][y * 9 + x] > r["pixels"][y * 9 + x + 1])) for y in range(8) for x in range(8))
        assert r["hash"] % 2**64 == int(bits, 2)
    assert {(r["i"], r["j"]) for r in duplicates.near_duplicate_pairs(hashed, 64).collect()} == {(100, 101), (100, 102), (101, 102)}
    hexes = triage.image_hashes(df.where("id < 100").select("id", F.slice("pixels", 1, 81).alias("pixels")), 9)
    assert hexes.select(E.hash_of_hex(F.col("hash")).alias("h")).where("h is null").count() == 0


def test_appended_events_go_on_with_their_chain(spark):
    ledger = provenance.well_formed(chains(spark))
    batch = spark.createDataFrame([(c, s, "cd" * 32, "{}", 1000 + s) for c in (1, 2, 3) for s in (7, 3)], "chain_id long, seq long, model_sha256 string, manifest string, ts_us long")
    broken = ledger.withColumn("manifest", F.when(F.col("chain_id") == 2, F.lit("{}")).otherwise(F.col("manifest")))
    new = provenance.append_inferences(broken, batch)
    assert sorted((r["chain_id"], r["seq"]) for r in new.collect()) == [(1, 5), (1, 6), (3, 0), (3, 1)]
    columns = ["chain_id", "seq", "model_sha256", "manifest", "ts_us", "previous_event_hash", "event_hash"]
    whole = ledger.where("chain_id = 1").select(columns).unionByName(new.select(columns))
    assert {r["chain_id"]: r["status"] for r in provenance.validate_chain(provenance.well_formed(whole)).collect()} == {1: "VALID_AUDIT_CHAIN (7 events verified)", 3: "VALID_AUDIT_CHAIN (2 events verified)"}


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(g, v, rng.randrange(9)) for g in ("a", "b") for v in rng.sample(range(10_000), 300)]
    got = ranges.scan(spark.createDataFrame(rows, "g string, v long, n long").repartition(7), "g", "v", sums=("n",), lead=True).collect()
    for g in ("a", "b"):
        own, total = sorted((v, n) for h, v, n in rows if h == g), 0
        by = {r["v"]: r for r in got if r["g"] == g}
        for k, (v, n) in enumerate(own):
            total += n
            assert (by[v]["n_upto"], by[v]["n_total"], by[v]["next"]) == (total, sum(x for _, x in own), own[k + 1][0] if k + 1 < len(own) else None)


def test_scan_models_sees_strip(spark):
    models = spark.createDataFrame([(i, f"h{i}", i != 3) for i in (1, 2, 3, 4)], "model_id long, sha256 string, format_ok boolean")
    manifest = models.select(F.col("model_id").alias("position"), "model_id", "sha256")
    empty = lambda schema: spark.createDataFrame([], schema)
    nodes, inputs = empty("model_id long, domain string, op_type string"), empty("model_id long, input_name string, dim_pos int, dim_value long, dim_param string")
    none, issues = empty("model_id long, name string"), empty("model_id long, severity string, description string")
    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 3)]) for i in range(12)], "id long, embedding array<double>")
    samples, overlays = rows.select("id", F.col("embedding").alias("vector")), rows.select(F.col("id").alias("position"), F.col("embedding").alias("overlay"))
    flat, sharp = [[0.0, 0.0], [0.0, 0.0]], [[100.0, 100.0], [0.0, 0.0]]
    weights = spark.createDataFrame([(m, k, w[k]) for m, w in ((1, flat), (2, sharp), (3, sharp), (4, flat)) for k in (0, 1)], "model_id long, label long, centroid array<double>")
    scan = lambda s: {r["subject_id"]: r for r in pipelines.scan_models(models, manifest, nodes, inputs, none, issues, rows, rows, empty("subject_id long, status string"), s, overlays, 12, weights).collect()}
    got = scan(samples)
    for m in (1, 4):
        assert (got[m]["verdict"], got[m]["risk_score"], got[m]["n_findings"]) == ("ACCEPT", 2.5, 2)
    assert (got[2]["verdict"], got[2]["risk_score"], got[2]["hard_gates"]) == ("QUARANTINE", 95.0, ["High-Strength Trojan Indicator"])
    assert got[3]["hard_gates"] == ["Invalid Artifact Format"] and got[3]["n_findings"] == 2
    assert scan(samples.limit(0))[2]["risk_score"] == 2.5


# ------------------------------------------------------------ classes, counters, pages


def test_counter_draws_alike_everywhere(spark):
    import duckdb

    from plumbline.functions import counter

    keys = np.array([0, 1, 2, 50, 2**31 - 2, 2**31, 2**40 + 3, 2**62])
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    got = [tuple(r) for r in df.select("k", counter.draw(F.col("k"), F.lit(7), seed=3).alias("d"), counter.unit(F.col("k"), seed=4).alias("u")).collect()]
    assert [r[1] for r in got] == counter.draw_array(keys, 7, seed=3).tolist()
    assert [r[2] for r in got] == counter.unit_array(keys, seed=4).tolist()
    sql = duckdb.sql(f"SELECT {counter.draw_sql('k', '7', seed=3)}, {counter.unit_sql('k', seed=4)} FROM (SELECT unnest({keys.tolist()}::BIGINT[]) AS k)").fetchall()
    assert [tuple(r) for r in sql] == [(r[1], r[2]) for r in got]
    many = counter.unit_array(np.arange(20_000), 3, seed=9)
    assert abs(many.mean() - 0.5) < 0.01 and abs(np.corrcoef(many[1:], many[:-1])[0, 1]) < 0.03
    assert np.bincount((many * 16).astype(int)).std() < 60
    assert abs(np.corrcoef(counter.unit_array(np.arange(20_000), 4, seed=9), many)[0, 1]) < 0.03


@pytest.mark.parametrize("seed", [1, 2])
def test_class_risk_equals_that_of_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    base = [rng.random(64).tolist() for _ in range(6)]
    rows = []
    for i in range(60):
        pixels = list(base[rng.integers(0, 6)])
        if rng.random() < 0.4:
            pixels[int(rng.integers(0, 64))] += float(rng.choice([0.001, 0.2]))
        rows.append((i, pixels))
    df = spark.createDataFrame(rows, "id long, pixels array<double>").withColumn("hash", E.dhash(F.col("pixels"), 8, 8)).cache()
    n = df.agg(F.count("*").alias("n"))
    _, classes, links = duplicates.near_duplicate_classes(df, 56)
    want = duplicates.duplicate_risk(duplicates.near_duplicate_pairs(df, 56), n).collect()
    assert duplicates.class_risk(classes, links, n).collect() == want and want[0]["n_pairs"] > 100
    none = df.limit(0)
    _, classes, links = duplicates.near_duplicate_classes(none, 56)
    assert duplicates.class_risk(classes, links, none.agg(F.count("*").alias("n"))).collect()[0]["risk"] == 0.0


def test_class_risk_of_a_million_copies(spark):
    df = spark.range(1_000_000).select("id", F.array(*(F.lit(float(k % 5)) for k in range(16))).alias("pixels"), F.lit(5).cast("long").alias("hash"))
    _, classes, links = duplicates.near_duplicate_classes(df, 56)
    row = duplicates.class_risk(classes, links, df.agg(F.count("*").alias("n"))).collect()[0]
    assert (row["n_pairs"], row["n_members"], row["risk"]) == (1_000_000 * 999_999 // 2, 1_000_000, 95.0)


def test_pages_open_only_the_groups_they_reach(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), str(rng.choice(["a", "b", "c", f"x{i}"], p=[0.5, 0.1, 0.05, 0.35]))) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, "id long, text string")
    every = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0])
    for number, size in ((0, 10), (3, 7), (40, 10), (10_000, 10)):
        assert [tuple(r) for r in duplicates.page_exact(df, "id", F.col("text"), number, size).collect()] == every[number * size : (number + 1) * size]


def test_forest_over_many_rows_sends_a_bounded_sample(spark):
    df = spark.range(60_000).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("vector"))
    forest = anomalies.fit_isolation_forest(df, trees=10, sample=64).collect()
    assert {r["tree"] for r in forest} == set(range(10)) and max(r["node"] for r in forest) < 128
    odd = df.where("id < 500").unionByName(spark.createDataFrame([(100_000, [9.0, 9.0, 9.0])], "id long, vector array<double>"))
    scores = {r["id"]: r["score"] for r in anomalies.score_isolation_forest(odd, anomalies.fit_isolation_forest(df.unionByName(odd.where("id = 100000")), trees=10, sample=64), 64).collect()}
    assert min(scores, key=scores.get) == 100_000


def test_entropy_by_model_equals_scoring_every_blend(spark):
    rng = np.random.default_rng(5)
    samples = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(12)], "id long, vector array<double>")
    overlays = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(6)], "position long, overlay array<double>")
    sets = {m: rng.normal(size=(3, 4)) * s for m, s in ((1, 1.0), (2, 30.0), (3, 0.1))}
    sets[4] = sets[2]  # scored once
    weights = spark.createDataFrame([(m, c, w[c].tolist()) for m, w in sets.items() for c in range(3)], "model_id long, label int, centroid array<double>")
    got = {r["model_id"]: r for r in entropy.overall_by_model(samples, overlays, 6, weights, draws=7).collect()}
    for m, w in sets.items():
        own = spark.createDataFrame([(c, w[c].tolist()) for c in range(3)], "label int, centroid array<double>")
        scored = scorers.linear_probabilities(entropy.blends(entropy.pair_with_overlays(samples, overlays, 6, 7)), own, "vector")
        want = entropy.entropy_overall(scored).first()
        assert got[m]["variants"] == want["variants"] == 84 and got[m]["triggered"] == want["triggered"]
        assert all(abs(got[m][c] - want[c]) < 1e-9 for c in ("mean_entropy", "std_entropy", "min_entropy"))
    none = entropy.overall_by_model(samples.limit(0), overlays, 6, weights).collect()
    assert [(r["variants"], r["triggered"]) for r in none] == [(0, False)] * 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scans_over_ranges_equal_windows(spark, seed):
    rng = random.Random(seed)
    rows = []
    for group in [None, "a", "b", "c", "longest"]:
        for k in range({"longest": 150, "a": 1}.get(group, rng.randint(2, 25))):
            rows.append((group, k * rng.choice([1, 1, 3]) + k, rng.choice([None, rng.randint(-5, 5)]), rng.choice([None, f"h{rng.randint(0, 9)}"])))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v long, h string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rng.choice(["3", "7", "10000"]))
    try:
        got = ranges.scan(df, "g", "o", sums=("v",), lags=("h",), maxima=("v",), lead=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: r[1])
        for i, r in enumerate(own):
            earlier = [x[2] for x in own[:i] if x[2] is not None]
            want.append((*r, sum(x[2] or 0 for x in own[: i + 1]), sum(x[2] or 0 for x in own), own[i - 1][3] if i else None, max(earlier) if earlier else None, own[i + 1][1] if i + 1 < len(own) else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert ranges.scan(df.limit(0), "g", "o", sums=("v",), lead=True).count() == 0


def test_one_long_chain_spreads_over_tasks(spark):
    events = spark.range(20_000).select(F.lit(7).alias("chain_id"), F.col("id").alias("seq"), F.sha2(F.lit("m"), 256).alias("model_sha256"), F.lit("{}").alias("manifest"), (F.col("id") * 10).alias("ts_us"))
    built = provenance.well_formed(provenance.build_chain(events))
    assert provenance.validate_chain(built).collect()[0]["status"] == "VALID_AUDIT_CHAIN (20000 events verified)"
    bad = built.withColumn("ts_us", F.when(F.col("seq") == 15_000, 5).otherwise(F.col("ts_us")))
    assert provenance.validate_chain(bad).collect()[0]["status"] == "INCORRECT_EVENT_HASH (Line 15001)"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        checked = provenance.validate_events(built, "chain_id")
        assert checked.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and checked.where("code is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
