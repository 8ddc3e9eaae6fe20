"""Vectors of samples by a pluggable embedder, a batch of rows at a time."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import counter
from plumbline.functions import exprs as E


class Embedder(Protocol):
    """Maps (rows, pixels) to (rows, dim). It is sent to the tasks once; each row's result must not depend on the others."""

    def __call__(self, pixels: np.ndarray) -> np.ndarray: ...


class FixedProjection:
    """A never-trained convolutional projection of side x side pixels: 3x3 filters, rectified, averaged over a 4x4 grid, and mixed by an orthogonal map.

    Filters are normal counters of the seed. The map is a subsampled Hadamard matrix with the columns'
    signs drawn, so it is exactly orthogonal and any engine can write it down. Sums are taken term by term in
    one order, so a row's vector is the same in every batch.
    """

    def __init__(self, side: int, dim: int = 64, seed: int = 42, filters: int = 8):
        self.side, self.dim, self.seed, self.filters = side, dim, seed, filters
        at = np.arange(filters * 9)
        normal = np.sqrt(-2 * np.log(counter.unit_array(at, seed=seed))) * np.cos(2 * np.pi * counter.unit_array(at, seed=seed + 1))
        self.kernels = (normal / 3).reshape(filters, 3, 3)
        self.grid = np.array_split(np.arange(side), 4)
        self.width = 1 << max(filters * 16 - 1, dim - 1).bit_length()
        self.signs = np.where(counter.draw_array(np.arange(self.width), seed=seed + 2) % 2 == 0, 1.0, -1.0)

    def rows(self) -> np.ndarray:
        """The rows of the Hadamard matrix that are kept."""
        return (37 * np.arange(self.dim) + 11) % self.width

    def mix(self) -> np.ndarray:
        """(dim, width) orthogonal rows."""
        bits = self.rows()[:, None] & np.arange(self.width)[None, :]
        parity = np.array([bin(b).count("1") % 2 for b in bits.ravel().tolist()]).reshape(bits.shape)
        return np.where(parity == 0, 1.0, -1.0) * self.signs / np.sqrt(self.width)

    def __call__(self, pixels: np.ndarray) -> np.ndarray:
        n, side = len(pixels), self.side
        padded = np.zeros((n, side + 2, side + 2))
        padded[:, 1:-1, 1:-1] = np.asarray(pixels, dtype=float).reshape(n, side, side)
        out = np.zeros((n, self.dim))
        mix = self.mix()
        for f, kernel in enumerate(self.kernels):
            lit = np.zeros((n, side, side))
            for a in range(3):
                for b in range(3):
                    lit += kernel[a, b] * padded[:, a : a + side, b : b + side]
            lit = np.maximum(lit, 0)
            for i, rows in enumerate(self.grid):
                for j, columns in enumerate(self.grid):
                    total = np.zeros(n)
                    for r in rows:
                        for c in columns:
                            total += lit[:, r, c]
                    out += (total / max(1, len(rows) * len(columns)))[:, None] * mix[:, f * 16 + i * 4 + j]
        return out


def embed(samples: DataFrame, embedder: Embedder, pixels: str = "pixels", batch: int = 64) -> DataFrame:
    """(id, vector) of samples (id, pixels), ``batch`` rows at a time."""

    def run(batches):
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                flat = part.column(1)
                wide = np.asarray(flat.flatten(), dtype=float).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(np.asarray(embedder(wide), dtype=float)), pa.list_(pa.float64()))], names=["id", "vector"])

    kind = samples.schema["id"].dataType.simpleString()
    return samples.select("id", E.doubles(F.col(pixels)).alias("pixels")).mapInArrow(run, f"id {kind}, vector array<double>")
