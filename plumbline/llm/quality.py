"""Quality classifier: random-indexing vectors, pooled per document, under a small calibrated network.

Random indexing: each word and each punctuation mark falls in one of ``BUCKETS`` hash buckets and
has a fixed sparse ternary index vector; a bucket's vector is the sum of the index vectors seen
within two tokens of it, over every document. The sums are a table of fixed size, added up by
Spark from the tasks' parts. A document pools its tokens' vectors by mean and deviation. A network
of two layers, fitted with numpy on a bounded sample of labelled rows outside the held-out fold,
gives a logit; a temperature fitted on rows kept out of the fit turns it into a probability.

Labels, language, source and id are no inputs. Null and empty texts pool to zeros and get the
score of that. With no labelled rows every score is 0.5. Repeated rows get equal scores; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.labelled import MOST_LABELLED, fold, labelled_sample

BUCKETS, WIDTH, NONZERO, REACH, BLOCK = 1 << 14, 32, 4, 2, 1024
THRESHOLD = 0.3

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_draw = np.random.default_rng(29)
_PLACES = np.argsort(_draw.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
_SIGNS = _draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each punctuation mark, in order."""
    data = tk.LOWER[data]
    words = tk.Words(data, at, tk.ALNUM)
    marks = np.flatnonzero(_MARKS[data])
    starts = np.concatenate([words.starts, marks])
    hashes = tk.mix(tk.PrefixHash(data).of(starts, np.concatenate([words.ends, marks + 1])))
    order = np.argsort(starts, kind="stable")
    row = np.searchsorted(at, starts[order], side="right") - 1
    return row, (hashes[order] & np.uint64(BUCKETS - 1)).astype(np.int64)


def index_sums(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, counts) of all buckets over all documents."""

    def count(batches):
        total = np.zeros(BUCKETS * WIDTH)
        seen = np.zeros(BUCKETS)
        for batch in batches:
            for _, data, at in tk.slabs(batch):
                row, bucket = tokens(data, at)
                seen += np.bincount(bucket, minlength=BUCKETS)
                for reach in range(1, REACH + 1):
                    near = row[reach:] == row[:-reach]
                    a, b = bucket[:-reach][near], bucket[reach:][near]
                    pair, n = np.unique(np.concatenate([a * BUCKETS + b, b * BUCKETS + a]), return_counts=True)
                    own, other = pair // BUCKETS, pair % BUCKETS
                    for k in range(NONZERO):
                        total += np.bincount(own * WIDTH + _PLACES[other, k], weights=n * _SIGNS[other, k], minlength=BUCKETS * WIDTH)
        table = np.concatenate([total.reshape(BUCKETS, WIDTH), seen[:, None]], axis=1).reshape(-1, BLOCK * (WIDTH + 1))
        kept = [i for i in range(len(table)) if table[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([table[i].astype("<f4").tobytes() for i in kept], pa.binary())], names=["block", "values"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = tk.add_up(docs.select(text).mapInArrow(count, "block int, values binary"), "<f4", "<f8").collect()
    table = np.zeros((BUCKETS // BLOCK, BLOCK * (WIDTH + 1)))
    for r in rows:
        table[r["block"]] = np.frombuffer(r["values"], "<f8")
    table = table.reshape(BUCKETS, WIDTH + 1)
    return table[:, :WIDTH], table[:, WIDTH]


@dataclass
class QualityModel:
    vectors: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float = 1.0

    def pool(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean and deviation of each row's token vectors, with the logarithm of its tokens."""
        n = len(at) - 1
        row, bucket = tokens(data, at)
        weight = self.weights[bucket]
        total = np.bincount(row, weights=weight, minlength=n)
        own = np.maximum(total, 1e-9)
        first, second = np.zeros((n, WIDTH)), np.zeros((n, WIDTH))
        for k in range(WIDTH):
            v = self.vectors[:, k][bucket]
            first[:, k] = np.bincount(row, weights=weight * v, minlength=n) / own
            second[:, k] = np.bincount(row, weights=weight * v * v, minlength=n) / own
        size = np.log1p(np.bincount(row, minlength=n))[:, None]
        return np.concatenate([first, np.sqrt(np.maximum(0, second - first * first)), size], axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pool(data, at)) / self.temperature, -500, 500)))


def loss_and_slopes(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """Mean log loss of the two layers with a penalty on their weights, and its slopes."""
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    logit = h @ w2 + b2
    loss = np.logaddexp(0, np.clip(logit, -500, 500)).mean() - (y * logit).mean() + decay / 2 * ((w1 * w1).sum() + (w2 * w2).sum())
    d = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) / len(y)
    back = d[:, None] * w2 * (1 - h * h)
    return float(loss), [x.T @ back + decay * w1, back.sum(axis=0), h.T @ d + decay * w2, d.sum()]


def _train(x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 250, rate: float = 0.03, decay: float = 1e-4) -> tuple:
    """Two layers by Adam on the whole sample."""
    draw = np.random.default_rng(5)
    layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for t in range(1, epochs + 1):
        for i, g in enumerate(loss_and_slopes(layers, x, y, decay)[1]):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows kept out of the fit."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, np.where(y[:, None] > 0.5, -1, 1) * (logits / t)[:, None]).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED) -> QualityModel:
    """Vectors from every document, the network from at most ``most_labelled`` labelled ones."""
    sums, counts = index_sums(docs, text_col)
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    share = counts / max(1.0, counts.sum())
    vectors = vectors - (vectors * share[:, None]).sum(axis=0)
    model = QualityModel(vectors, 1e-3 / (1e-3 + share), np.zeros(2 * WIDTH + 1), np.ones(2 * WIDTH + 1), (np.zeros((2 * WIDTH + 1, 1)), np.zeros(1), np.zeros(1), np.array(0.0)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def pooled(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(list(sent.value.pool(data, at)), pa.list_(pa.float64()))], names=["id", "target", "pooled"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = labelled_sample(docs, labels, label, id_col, text_col, most_labelled).select("id", "text", "target").mapInArrow(pooled, f"id {kind}, target double, pooled array<double>").collect()
    if not rows:
        return model
    rows.sort(key=lambda r: (str(r["id"]), r["target"], r["pooled"]))
    x, y = np.array([r["pooled"] for r in rows]), np.array([r["target"] for r in rows])
    model.shift, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - model.shift) / model.scale
    apart = np.arange(len(y)) % 5 == 0
    if len(y) < 50:
        apart[:] = False
    model.layers = _train(z[~apart], y[~apart])
    if apart.any():
        model.temperature = _temperature(model.logit(x[apart]), y[apart])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch):
                score = sent.value.score(data, at)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch, text_col):
                yield rows.filter(pa.array(sent.value.score(data, at) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit_quality(docs, labels))
