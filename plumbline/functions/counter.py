"""Random numbers from counters: a number depends on its keys and seed alone, whatever the partitioning or the engine.

Keys are absorbed one by one into a state modulo the prime 2^31 - 1 by x -> (x + key + constant)^5, a
permutation there (5 does not divide the group's order) that is far from linear, as in the MiMC family
of ciphers; two rounds without a key follow. Every product fits a 64-bit integer, so Spark, SQL and numpy
give the same numbers. The period is that of the prime: these are for sampling and noise, not for secrets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: Rounds after the last key.
AFTER = 2


def _constant(i: int) -> int:
    return pow(7, 3 * i + 5, PRIME)


def draw(*keys: Column, seed: int) -> Column:
    """A whole number in [0, 2^31 - 1) from whole-number keys; keys equal modulo the prime draw alike."""
    absorbed = [(F.pmod(k.cast("bigint"), F.lit(PRIME)) + _constant(i)) % PRIME for i, k in enumerate(keys)]
    absorbed += [F.lit(_constant(len(keys) + i)).cast("bigint") for i in range(AFTER)]

    def power(x: Column, k: Column) -> Column:
        y = (x + k) % PRIME
        square = (y * y) % PRIME
        return ((square * square) % PRIME * y) % PRIME

    return F.aggregate(F.array(*absorbed), F.lit(seed % PRIME).cast("bigint"), power)


def unit(*keys: Column, seed: int) -> Column:
    """A number in (0, 1)."""
    return (draw(*keys, seed=seed) + 0.5) / float(PRIME)


def draw_array(*keys: np.ndarray | int, seed: int) -> np.ndarray:
    """``draw`` of arrays of keys."""
    x = np.int64(seed % PRIME)
    steps = [(np.asarray(k, np.int64) % PRIME + _constant(i)) % PRIME for i, k in enumerate(keys)]
    for k in [*steps, *(_constant(len(keys) + i) for i in range(AFTER))]:
        y = (x + k) % PRIME
        square = y * y % PRIME
        x = square * square % PRIME * y % PRIME
    return x


def unit_array(*keys: np.ndarray | int, seed: int) -> np.ndarray:
    return (draw_array(*keys, seed=seed) + 0.5) / float(PRIME)


def draw_sql(*keys: str, seed: int) -> str:
    """``draw`` as a DuckDB expression of expressions that are not negative."""
    steps = [f"(({k}) % {PRIME} + {_constant(i)}) % {PRIME}" for i, k in enumerate(keys)] + [str(_constant(len(keys) + i)) for i in range(AFTER)]
    y = f"((cx + ck) % {PRIME})"
    square = f"({y} * {y} % {PRIME})"
    first = f"{seed % PRIME}::BIGINT"
    return f"list_reduce([{', '.join([first, *(f'({s})::BIGINT' for s in steps)])}], lambda cx, ck: {square} * {square} % {PRIME} * {y} % {PRIME})"


def unit_sql(*keys: str, seed: int) -> str:
    return f"(({draw_sql(*keys, seed=seed)} + 0.5::DOUBLE) / {PRIME}::DOUBLE)"
