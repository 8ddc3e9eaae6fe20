"""Mergeable quantile summaries with a stated error, and Kolmogorov-Smirnov distances between them.

A summary is a sorted list of values with weights that add up to the number of values seen. Where it
grows beyond ``k`` points it is compressed to the values at the ranks (i + 1/2) n / k, which moves the
count of values up to any point by at most n / 2k; the sum of these is carried as ``error``. Summaries
merge by putting their points together, which adds their errors and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "dim long, level int, values array<double>, weights array<double>, n long, error double"


def compress(values: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, weights, error added): at most ``k`` points, sorted."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= k:
        return values, weights, 0.0
    upto, n = np.cumsum(weights), weights.sum()
    at = np.minimum(np.searchsorted(upto, (np.arange(k) + 0.5) * (n / k)), len(values) - 1)
    return values[at], np.full(k, n / k), n / (2 * k)


def _rows(rows: list[tuple]) -> pa.Table:
    dims, levels, values, weights, n, error = zip(*rows, strict=True) if rows else ([],) * 6
    return pa.table({
        "dim": pa.array(dims, pa.int64()), "level": pa.array(levels, pa.int32()), "values": pa.array(list(values), pa.list_(pa.float64())),
        "weights": pa.array(list(weights), pa.list_(pa.float64())), "n": pa.array(n, pa.int64()), "error": pa.array(error, pa.float64()),
    })


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.asarray(x, dtype=float) for x in table[name].to_pylist()]


def summarise(rows: DataFrame, k: int = 1000) -> DataFrame:
    """A summary (dim, level 0, values, weights, n, error) of each dim of (dim, value) rows: of each task's rows first, then of those."""

    def own(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            dims, values = np.asarray(batch.column(0)), np.asarray(batch.column(1), dtype=float)
            order = np.argsort(dims, kind="stable")
            dims, values = dims[order], values[order]
            starts = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1]])) if len(dims) else []
            for part in np.split(values, starts[1:]) if len(dims) else []:
                dim = int(dims[starts[0]])
                starts = starts[1:]
                v, w, n, e = kept.get(dim, (np.zeros(0), np.zeros(0), 0, 0.0))
                v, w = np.concatenate([v, part]), np.concatenate([w, np.ones(len(part))])
                added = 0.0
                if len(v) > 32 * k:  # seldom, so that little error is added
                    v, w, added = compress(v, w, 4 * k)
                kept[dim] = (v, w, n + len(part), e + added)
        out = []
        for dim, (v, w, n, e) in kept.items():
            v, w, added = compress(v, w, 4 * k)
            out.append((dim, 0, v, w, n, e + added))
        yield from _rows(out).to_batches()

    def joined(key, table):
        v, w, added = compress(np.concatenate(_lists(table, "values")), np.concatenate(_lists(table, "weights")), k)
        return _rows([(key[0].as_py(), 0, v, w, sum(table["n"].to_pylist()), sum(table["error"].to_pylist()) + added)])

    values = rows.select(F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return values.mapInArrow(own, SCHEMA).groupBy("dim").applyInArrow(joined, SCHEMA)


def absorb(state: DataFrame, batch: DataFrame, k: int = 1000) -> DataFrame:
    """The state with a batch's summaries: two of a level merge into one of the next, so t batches cost each value log2 t compressions."""

    def carry(key, table):
        rows = sorted(zip(table["level"].to_pylist(), _lists(table, "values"), _lists(table, "weights"), table["n"].to_pylist(), table["error"].to_pylist(), strict=True), key=lambda r: (r[0], -r[3]))
        done: list = []
        while rows:
            level, v, w, n, e = rows.pop(0)
            if rows and rows[0][0] == level:
                _, v2, w2, n2, e2 = rows.pop(0)
                v, w, added = compress(np.concatenate([v, v2]), np.concatenate([w, w2]), k)
                rows.append((level + 1, v, w, n + n2, e + e2 + added))
                rows.sort(key=lambda r: r[0])
            else:
                done.append((key[0].as_py(), level, v, w, n, e))
        return _rows(done)

    return state.unionByName(batch).groupBy("dim").applyInArrow(carry, SCHEMA)


def ks_of_sketches(one: DataFrame, other: DataFrame) -> DataFrame:
    """(dim, ks, error) of two tables of summaries: the distance between their distribution functions, and how far the exact one may be from it."""

    def distance(key, a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"dim": pa.array([], pa.int64()), "ks": pa.array([], pa.float64()), "error": pa.array([], pa.float64())})
        points, steps, error = [], [], 0.0
        for table, sign in ((a, 1.0), (b, -1.0)):
            n = sum(table["n"].to_pylist())
            points.append(np.concatenate(_lists(table, "values")))
            steps.append(sign * np.concatenate(_lists(table, "weights")) / n)
            error += sum(table["error"].to_pylist()) / n
        points, steps = np.concatenate(points), np.concatenate(steps)
        order = np.argsort(points, kind="stable")
        points, upto = points[order], np.cumsum(steps[order])
        last = np.concatenate([points[1:] != points[:-1], [True]])  # equal values step together
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int64()), "ks": [float(np.abs(upto[last]).max())], "error": [float(error)]})

    return one.groupBy("dim").cogroup(other.groupBy("dim")).applyInArrow(distance, "dim long, ks double, error double")
