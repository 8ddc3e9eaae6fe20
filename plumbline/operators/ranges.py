"""Running sums, maxima and neighbours over ordered groups of any size: ranges are scanned apart and put together.

A window over a group needs the whole group in one task. Here rows are dealt by ranges of (group, order),
each task scans its sorted range once, and what a row needs from the ranges before it is a small table
of one row a group and range. One group of all rows spreads over tasks like many small ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from plumbline.session import checkpointed, sized

_LEAST = np.iinfo(np.int64).min


def _codes(keys: pa.Array) -> np.ndarray:
    """Equal codes for equal keys, nulls among them."""
    return np.asarray(keys.dictionary_encode(null_encoding="encode").indices)


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(int64 values, which are null)."""
    gone = np.asarray(column.is_null())
    return np.asarray(pc.fill_null(column.cast(pa.int64()), 0)), gone


def scan(rows: DataFrame, group: str, order: str, sums: tuple[str, ...] = (), lags: tuple[str, ...] = (), maxima: tuple[str, ...] = (), lead: bool = False) -> DataFrame:
    """``rows`` with, within ``group`` in the order of ``order``:

    ``c_upto`` and ``c_total`` for whole-number columns c of ``sums`` (up to and with the row; of the
    group), ``c_lag`` for ``lags`` (the value of the row before; null at the first), ``c_before`` for
    whole-number ``maxima`` (the largest before the row, nulls passed over), and ``next`` (the ``order`` of
    the row behind) with ``lead``.
    """
    names = rows.columns
    spots = {c: names.index(c) for c in (*sums, *lags, *maxima, group, order)}
    fields = [*rows.schema.fields, StructField("__part", rows.select(F.spark_partition_id()).schema[0].dataType), StructField("__first", BooleanType())]
    fields += [StructField(f"{c}_upto", LongType()) for c in sums] + [StructField(f"{c}_lag", rows.schema[c].dataType) for c in lags]
    fields += [StructField(f"{c}_before", LongType()) for c in maxima] + ([StructField("next", rows.schema[order].dataType)] if lead else [])

    def run(batches):
        key, carry = None, None  # the last row's group, and what it hands on
        held = None  # a batch waits until the first row of the next is known

        def scanned(batch: pa.RecordBatch, follower: tuple | None) -> pa.RecordBatch:
            nonlocal key, carry
            n = batch.num_rows
            code = _codes(batch.column(spots[group]))
            new = np.ones(n, bool)
            new[1:] = code[1:] != code[:-1]
            goes_on = carry is not None and batch.column(spots[group])[0].as_py() == key
            new[0] = not goes_on
            run_id = np.cumsum(new)
            out, handed = [pa.array(new)], {}
            for c in sums:
                values, _ = _whole(batch.column(spots[c]))
                upto = np.cumsum(values)
                starts = np.flatnonzero(new)
                base = np.zeros(n, np.int64)
                if len(starts):
                    base[starts[0] :] = np.repeat(upto[starts] - values[starts], np.diff(np.append(starts, n)))
                    base[: starts[0]] = -carry[c, "sum"] if goes_on else 0
                elif goes_on:
                    base[:] = -carry[c, "sum"]
                upto = upto - base
                handed[c, "sum"] = int(upto[-1])
                out.append(pa.array(upto))
            for c in lags:
                column = batch.column(spots[c])
                before = pa.concat_arrays([pa.array([carry[c, "lag"] if goes_on else None], column.type), column.slice(0, n - 1)])
                out.append(pc.if_else(pa.array(new), pa.scalar(None, column.type), before))
                handed[c, "lag"] = column[n - 1].as_py()
            for c in maxima:
                values, gone = _whole(batch.column(spots[c]))
                values = np.where(gone, _LEAST, values)
                first = values.copy()
                if goes_on:
                    first[0] = max(first[0], carry[c, "max"])
                most = pd.Series(first).groupby(run_id).cummax().to_numpy()
                before = np.concatenate([[carry[c, "max"] if goes_on else _LEAST], most[:-1]])
                before = np.where(new, _LEAST, before)
                out.append(pa.array(before, mask=before == _LEAST))
                handed[c, "max"] = int(most[-1])
            if lead:
                column = batch.column(spots[order])
                same = follower is not None and follower[0] == batch.column(spots[group])[n - 1].as_py()
                after = pa.concat_arrays([column.slice(1), pa.array([follower[1] if same else None], column.type)])
                out.append(pc.if_else(pa.array(np.append(new[1:], not same)), pa.scalar(None, column.type), after))
            key, carry = batch.column(spots[group])[n - 1].as_py(), handed
            return pa.RecordBatch.from_arrays([*batch.columns, *out], names=[f.name for f in fields])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield scanned(held, (batch.column(spots[group])[0].as_py(), batch.column(spots[order])[0].as_py()))
            held = batch
        if held is not None:
            yield scanned(held, None)

    dealt = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("__part", F.spark_partition_id())
    parts = checkpointed(dealt.mapInArrow(run, StructType(fields)))
    ends = [F.sum(c).alias(f"__s_{c}") for c in sums] + [F.max_by(c, order).alias(f"__l_{c}") for c in lags] + [F.max(c).alias(f"__m_{c}") for c in maxima] + [F.min(order).alias("__n")]
    ends = parts.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(*ends)
    by = Window.partitionBy("__group").orderBy("__of")  # a row a range
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__group")
    starts = ends.select(
        "__group", "__of", F.lead("__n").over(by).alias("__next"),
        *(F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums), *(F.sum(f"__s_{c}").over(whole).alias(f"{c}_total") for c in sums),
        *(F.lag(f"__l_{c}").over(by).alias(f"__p_{c}") for c in lags), *(F.max(f"__m_{c}").over(before).alias(f"__h_{c}") for c in maxima),
    )
    joined = parts.join(sized(checkpointed(starts)), (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.select(
        *names,
        *((F.col(f"{c}_upto") + F.col(f"__b_{c}")).alias(f"{c}_upto") for c in sums), *(f"{c}_total" for c in sums),
        *(F.when(F.col("__first"), F.col(f"__p_{c}")).otherwise(F.col(f"{c}_lag")).alias(f"{c}_lag") for c in lags),
        *(F.greatest(f"{c}_before", f"__h_{c}").alias(f"{c}_before") for c in maxima), *([F.coalesce("next", "__next").alias("next")] if lead else []),
    )
