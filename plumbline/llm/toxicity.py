"""Toxicity: a cumulative-link ordinal regression that predicts a severity grade per document.

Features are sparse: which of some ``FEATURES`` selected words and word beginnings a text holds, as
1 + ln(count). They are those of the labelled sample that tell its toxic rows from the others best. Grades are
ordered: 0 for rows labelled clean; toxic rows have grade 1, 2 or 3 by how often they use words that
clean rows of the sample never use (once, up to three times, more). One weight vector is shared by
all thresholds, P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < t_2, fitted by gradient descent on
the log likelihood. The result is the expected grade; a document is called toxic when P(grade > 0)
reaches a threshold that is chosen within the training folds.

The labels know two values only, so some rule has to order the toxic rows for an ordinal model; how
often a row uses toxic words is one that the text itself supports. Only 0 against the rest is held
against labels.

The model is small and fitted on a bounded sample of labelled rows outside fold 0; scoring is one
pass over whole texts without a shuffle. Null and empty texts hold no words. With no toxic or no
clean labelled row every expected grade is 0. Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.labelled import MOST_LABELLED, fold, labelled_sample
from plumbline.session import stored

FEATURES, GRADES = 2000, 3
#: Bytes of text taken together: each word gives several features, so parts are smaller than a slab.
PART = 1 << 18


#: Lengths in bytes of the word beginnings that are features beside whole words: they carry a stem to forms not seen.
STEMS = (4, 5, 6, 7, 8, 10)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and each longer word's beginnings, lower-cased A-Z."""
    data = tk.LOWER[data]
    words = tk.Words(data, at, tk.ALNUM)
    prefix = tk.PrefixHash(data)
    rows, hashes = [words.row], [words.hashes(prefix)]
    for n in STEMS:
        longer = np.flatnonzero(words.ends - words.starts > n)
        rows.append(words.row[longer])
        hashes.append(tk.mix(prefix.of(words.starts[longer], words.starts[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class ToxicityModel:
    words: np.ndarray  # ascending hashes
    weights: np.ndarray
    steps: np.ndarray  # ascending thresholds
    least: float = 0.5  # P(grade > 0) from which a document is called toxic

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def features(self, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of the selected words of each row."""
        if not len(self.words):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        near = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        row, hashes = row[near], hashes[near]
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        pair, count = np.unique(row[hit] * len(self.words) + at[hit], return_counts=True)
        return pair // len(self.words), pair % len(self.words), 1 + np.log(count)

    def above(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rows, grades): P(grade > k) of each row."""
        row, feature, value = self.features(*_words(data, at))
        s = np.bincount(row, weights=value * self.weights[feature] if len(row) else None, minlength=len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.steps, -500, 500)))


def _select(sample: DataFrame, n_yes: int, n_no: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(selected words, words that only toxic rows use) by a log-odds z score over the sample's rows.

    Rows that hold a word are counted by Spark; at most ``most`` words of each kind come back.
    """

    def count(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch, size=PART):
                row, hashes = _words(data, at)
                bad = np.asarray(rows.column(1).to_numpy()) >= 0.5
                _, once = np.unique(tk.mix(hashes ^ tk.mix(row.astype(np.uint64))), return_index=True)
                words, first = np.unique(hashes[once], return_inverse=True)
                yes = np.bincount(first, weights=bad[row[once]], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(yes), pa.array(np.bincount(first, minlength=len(words)) - yes)], names=["word", "yes", "no"])

    counts = sample.select("text", "target").mapInArrow(count, "word long, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where("yes + no >= 3")
    yes, no = F.col("yes") + 0.5, F.col("no") + 0.5
    odds = F.ln(yes / (n_yes + 1 - yes)) - F.ln(no / (n_no + 1 - no))
    error = F.sqrt(1 / yes + 1 / (n_yes + 1 - yes) + 1 / no + 1 / (n_no + 1 - no))
    scored = counts.withColumn("z", odds / error).where(F.abs("z") >= 3).orderBy(F.abs("z").desc(), "word")
    chosen = [r["word"] for r in scored.limit(most).collect()]
    own = [r["word"] for r in scored.where((F.col("no") == 0) & (F.col("z") >= 3) & (F.col("yes") >= max(3, 0.02 * n_yes))).limit(most).collect()]
    return tuple(np.sort(np.array(x, dtype=np.int64).view(np.uint64)) for x in (chosen, own))


def _steps(g: np.ndarray) -> np.ndarray:
    """Ascending thresholds from a first one and exponents of gaps."""
    return np.cumsum(np.concatenate([g[:1], np.exp(np.clip(g[1:], -6, 4))]))


def loss_and_slopes(x: tuple, grade: np.ndarray, w: np.ndarray, g: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades with a penalty on weights, and its slopes in ``w`` and ``g``."""
    row, feature, value = x
    n = len(grade)
    s = np.bincount(row, weights=value * w[feature], minlength=n)
    up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - _steps(g), -60, 60))), np.zeros((n, 1))], axis=1)
    slope = up * (1 - up)
    i = np.arange(n)
    p = np.maximum(up[i, grade] - up[i, grade + 1], 1e-9)
    ds = (slope[i, grade] - slope[i, grade + 1]) / p  # of the log likelihood
    dt = np.zeros(GRADES)
    for k in range(GRADES):
        dt[k] = (np.where(grade == k + 1, -slope[i, k + 1] / p, 0) + np.where(grade == k, slope[i, k + 1] / p, 0)).sum()
    gap = np.array([dt[k:].sum() for k in range(GRADES)])
    gap[1:] *= np.exp(np.clip(g[1:], -6, 4))
    return float(-np.log(p).mean() + decay / 2 * (w @ w)), decay * w - np.bincount(feature, weights=value * ds[row], minlength=len(w)) / n, -gap / n


def _fit(x: tuple, grade: np.ndarray, width: int, epochs: int = 400, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative links by Adam."""
    params = [np.zeros(width), np.concatenate([[2.0], np.zeros(GRADES - 1)])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        _, *slopes = loss_and_slopes(x, grade, *params, decay)
        for j, d in enumerate(slopes):
            m[j] = 0.9 * m[j] + 0.1 * d
            v[j] = 0.999 * v[j] + 0.001 * d * d
            params[j] = params[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return params[0], _steps(params[1])


def _model(sample: DataFrame, features: int) -> ToxicityModel:
    """The model of all rows of ``sample`` (text, target)."""
    n_yes, n_no = sample.agg(F.count_if(F.col("target") >= 0.5), F.count_if(F.col("target") < 0.5)).first()
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 50.0))
    if not n_yes or not n_no:
        return empty
    chosen, own = _select(sample, n_yes, n_no, features)
    if not len(chosen):
        return empty
    pick = ToxicityModel(chosen, np.zeros(len(chosen)), np.zeros(GRADES))

    def hold(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch, size=PART):
                row, hashes = _words(data, at)
                used = np.bincount(row[np.isin(hashes, own)], minlength=rows.num_rows)
                row, feature, value = pick.features(row, hashes)
                cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
                spans = list(zip(cut.tolist(), cut[1:].tolist(), strict=False))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1), pa.array(used), pa.array([feature[a:b] for a, b in spans], pa.list_(pa.int64())), pa.array([value[a:b] for a, b in spans], pa.list_(pa.float64()))], names=["target", "used", "features", "values"]
                )

    found = sample.select("text", "target").mapInArrow(hold, "target double, used long, features array<long>, values array<double>").collect()
    found.sort(key=lambda r: (r["target"], r["used"], r["features"], r["values"]))
    toxic = np.array([r["target"] >= 0.5 for r in found], dtype=bool)
    row = np.repeat(np.arange(len(found)), [len(r["features"]) for r in found])
    feature = np.array([x for r in found for x in r["features"]], dtype=np.int64)
    value = np.array([x for r in found for x in r["values"]], dtype=float)
    grade = np.where(toxic, np.digitize([r["used"] for r in found], [1.5, 3.5]) + 1, 0)
    weights, steps = _fit((row, feature, value), grade, len(chosen))
    return ToxicityModel(chosen, weights, steps)


def choose_least(probability: np.ndarray, toxic: np.ndarray, cost: float = 5.0) -> float:
    """The middle of the thresholds that catch most for ``cost`` times their share of false alarms; 0.5 without rows of both kinds."""
    if not toxic.any() or toxic.all():
        return 0.5
    grid = np.linspace(0.05, 0.95, 91)
    worth = np.array([(probability[toxic] >= t).mean() - cost * (probability[~toxic] >= t).mean() for t in grid])
    best = grid[worth >= worth.max() - 1e-12]
    return float(best[len(best) // 2])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most_labelled: int = MOST_LABELLED, features: int = FEATURES) -> ToxicityModel:
    """The model from at most ``most_labelled`` labelled rows.

    Its threshold is chosen on one fold of them under a model of the others; the model is then fitted
    on all. Rows of fold 0 take no part in either.
    """
    sample = stored(labelled_sample(docs, labels, label, id_col, text_col, most_labelled))
    apart = F.coalesce(fold(F.col("id")) == 1, F.lit(False))
    judged = score_toxicity(sample.where(apart), _model(sample.where(~apart), features), "id").join(sample.where(apart).select("id", "target"), "id").select("probability", "target").collect()
    model = _model(sample, features)
    model.least = choose_least(np.array([r["probability"] for r in judged]), np.array([r["target"] >= 0.5 for r in judged], dtype=bool))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """(id, severity, grade, probability, toxic) of every row: expected and likeliest grade, P(grade > 0), the call."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    least = model.least if least is None else least
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch, size=PART):
                above = sent.value.above(data, at)
                share = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(above.sum(axis=1)), pa.array(share.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= least)], names=["id", "severity", "grade", "probability", "toxic"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, severity double, grade int, probability double, toxic boolean").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's expected severity."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_toxicity(docs, labels))
