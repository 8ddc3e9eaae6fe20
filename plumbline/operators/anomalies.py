"""Embedding outliers: isolation forest, two principal components, chart points, risk and findings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import counter
from plumbline.functions import exprs as E
from plumbline.operators.duplicates import one_row

THRESHOLD = -0.07


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_isolation_forest(vectors: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, path) rows of a forest over (id, vector); node 1 is a root, n has the children 2n and 2n + 1.

    All choices are counters of ids, trees and nodes (``counter``), so SQL can grow the same forest.
    A row stands for the draw of as many trees as the table's size asks for, of one in large tables; a
    tree takes the ``sample`` rows of the smallest draws, of which some four times as many are sent to it.
    """
    n = max(1, vectors.count())
    each = min(trees, -(-4 * sample * trees // n))
    most = min(counter.PRIME, 4 * sample * trees * counter.PRIME // (n * each))
    own = [F.col("id"), F.shiftright(F.col("id").cast("bigint"), 31)]
    taken = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), counter.draw(*own, seed=seed).alias("first"))
    taken = taken.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda j: ((F.col("first") + j) % trees).cast("int"))))
    taken = taken.withColumn("draw", counter.draw(*own, F.col("tree"), seed=seed + 1)).where(F.col("draw") < most)

    def grow(key, pdf):
        tree = int(key[0])
        pdf = pdf.sort_values(["draw", "id"]).head(sample)
        x = np.stack(pdf["vector"].to_numpy())
        limit, rows, todo = int(np.ceil(np.log2(max(2, len(x))))), [], [(1, np.arange(len(x)), 0)]
        while todo:
            node, at, depth = todo.pop()
            low, high = x[at].min(axis=0), x[at].max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= limit or len(at) <= 1 or not len(free):
                rows.append((tree, node, -1, 0.0, depth + float(_average_path(len(at)))))
                continue
            f = int(free[int(counter.draw_array(tree, node, seed=seed + 2)) % len(free)])
            cut = float(low[f] + float(counter.unit_array(tree, node, seed=seed + 3)) * (high[f] - low[f]))
            less = x[at, f] < cut
            rows.append((tree, node, f, cut, 0.0))
            todo += [(2 * node, at[less], depth + 1), (2 * node + 1, at[~less], depth + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "path"])

    return taken.select("tree", "id", "draw", "vector").groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, path double")


def score_isolation_forest(vectors: DataFrame, forest: DataFrame, sample: int = 256) -> DataFrame:
    """(id, score): 0.5 - 2^(-mean path / expected path); lower is odder.

    The forest holds at most 2 * sample nodes a tree, so its rows are collected and sent to the tasks.
    """
    nodes = forest.toPandas()
    grown = []
    for _, g in nodes.groupby("tree"):
        tree = {"feature": np.full(int(g["node"].max()) + 1, -1), "cut": np.zeros(int(g["node"].max()) + 1), "path": np.zeros(int(g["node"].max()) + 1)}
        for name in tree:
            tree[name][g["node"].to_numpy()] = g[name].to_numpy()
        grown.append(tree)
    trees = vectors.sparkSession.sparkContext.broadcast(grown)
    expected = float(_average_path(min(sample, max(2, vectors.count()))))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            path = np.zeros(len(x))
            for t in trees.value:
                at = np.ones(len(x), dtype=np.int64)
                inner = np.flatnonzero(t["feature"][at] >= 0)
                while len(inner):
                    here = at[inner]
                    at[inner] = 2 * here + (x[inner, t["feature"][here]] >= t["cut"][here])
                    inner = inner[t["feature"][at[inner]] >= 0]
                path += t["path"][at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(0.5 - 2 ** (-path / max(1, len(trees.value)) / expected))], names=["id", "score"])

    return vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, score double")


def flag_anomalies(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.withColumn("is_anomaly", F.col("score") < threshold)


def pca_2d(vectors: DataFrame) -> DataFrame:
    """(id, x, y): two principal components of centred vectors, the largest loading of each positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, k])), k] >= 0 else -1.0 for k in range(2)]
    p = vector_to_array("p")
    return model.transform(centred).select("id", (p[0] * signs[0]).alias("x"), (p[1] * signs[1]).alias("y"))


def scale_coords(points: DataFrame) -> DataFrame:
    """Both axes divided by their common largest absolute value if above 1e-6, 4 places."""
    most = points.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("most"))
    by = F.when(F.col("most") > 1e-6, F.col("most")).otherwise(1.0)
    return one_row_join(points, most).select("id", F.round(F.col("x") / by, 4).alias("x"), F.round(F.col("y") / by, 4).alias("y"))


def one_row_join(rows: DataFrame, row: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def chart_points(scores: DataFrame, coords: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, x, y, score, is_anomaly)."""
    return scale_coords(coords).join(scores, "id").select("id", "x", "y", F.round("score", 4).alias("score"), (F.col("score") < threshold).alias("is_anomaly"))


def anomaly_summary(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.agg(F.round(F.min("score"), 4).alias("min_score"), F.round(F.max("score"), 4).alias("max_score"), F.round(F.avg("score"), 4).alias("mean_score"), F.lit(threshold).alias("threshold"), F.count_if(F.col("score") < threshold).alias("n_anomalies"), F.count("*").alias("n"))


def anomaly_risk(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (n, n_anomalies, risk): by the share of anomalies and how far below the threshold they lie."""
    bad = F.col("score") < threshold
    row = scores.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_anomalies"), F.avg(F.when(bad, F.greatest(F.lit(0.0), F.lit(threshold) - F.col("score")))).alias("depth"))
    risk = F.round(F.least(F.lit(95.0), F.greatest(F.lit(20.0), 35 + 45 * F.col("n_anomalies") / F.col("n") + 300 * F.col("depth"))), 1)
    return row.select("n", "n_anomalies", F.when(F.col("n_anomalies") == 0, 0.0).otherwise(risk).alias("risk"))


def anomaly_finding(risk: DataFrame) -> DataFrame:
    clean = F.col("n_anomalies") == 0
    return risk.select(
        F.lit("DatasetAnomalyDetector").alias("detector_id"),
        F.when(clean, "DATASET_ANOMALY_CLEAN").otherwise("DATASET_ANOMALY_INDICATOR").alias("finding_type"),
        F.col("risk").alias("risk_score"),
        F.when(clean, "HIGH").otherwise("MEDIUM").alias("evidence_strength"),
        F.when(clean, "Dataset Feature Distribution Clean").otherwise("Dataset Embedding Anomaly Clusters Detected").alias("title"),
        F.format_string("%d of %d samples lie below the anomaly threshold.", "n_anomalies", "n").alias("explanation"),
        F.lit(False).alias("is_hard_gate"),
    )


def first_n_flagged(scores: DataFrame, n: int = 12, dataset: str = "dataset_id") -> DataFrame:
    """The ``n`` flagged rows of the smallest ids of each dataset."""
    return scores.where("is_anomaly").withColumn("rank", F.row_number().over(Window.partitionBy(dataset).orderBy("id"))).where(F.col("rank") <= n)


def inlier_rates(flags: DataFrame) -> DataFrame:
    """(n, anomaly_pct, inlier_pct), one place."""
    row = flags.agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("bad"))
    return row.select("n", F.round(100.0 * F.col("bad") / F.col("n"), 1).alias("anomaly_pct"), F.round(100.0 * (F.col("n") - F.col("bad")) / F.col("n"), 1).alias("inlier_pct"))


def dataset_risk(duplicate: DataFrame, anomaly: DataFrame) -> DataFrame:
    """One row: the larger risk and 0.15 of the smaller where both fired, else the larger; REVIEW if any fired."""
    row = one_row(duplicate.select("n_pairs", F.col("risk").alias("d")), anomaly.select("n_anomalies", F.col("risk").alias("a")))
    dup, odd = F.col("n_pairs") > 0, F.col("n_anomalies") > 0
    risk = F.when(dup & odd, F.round(F.least(F.lit(98.0), F.greatest("d", "a") + 0.15 * F.least("d", "a")), 1)).when(dup | odd, F.greatest("d", "a")).otherwise(0.0)
    return row.select(F.col("d").alias("duplicate_risk"), F.col("a").alias("anomaly_risk"), risk.alias("risk"), F.when(dup | odd, "MEDIUM").otherwise("HIGH").alias("evidence_strength"), F.when(dup | odd, "REVIEW").otherwise("ACCEPT").alias("verdict"))
