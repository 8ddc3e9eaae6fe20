"""A bounded sample of labelled rows, the only rows that a classifier here is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on.
MOST_LABELLED = 12_000


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are never learnt from."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """(id, text, target) of at most ``most`` labelled rows outside fold 0, those of the smallest id hashes.

    A row with several labels has their mean. The ids are few enough to be broadcast whatever the
    corpus holds; the sample is the same at every partitioning.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.avg(F.col(label).cast("double")).alias("target"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id")
