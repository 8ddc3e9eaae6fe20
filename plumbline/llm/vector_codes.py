"""Product-quantisation codes of vectors by exact integer arithmetic on float64 matrix products.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts`` equal parts, each with
its own codebook. Nearest entries are found by the expansion |x|^2 - 2 x.c + |c|^2, in which the dot
products are matrix products of limbs: an integer is split as ``high * 2^14 + low`` with a balanced
low limb, so that each limb product and its sum over a part stay far below 2^53 and float64 holds them
exactly; they are put together again in int64, where the first argmin is taken.

A codebook starts from the parts of the vectors of smallest ids. Each round is one pass over the
vectors: a task assigns its batches and sends one row of sums for each entry that it used. Only the
codebooks (``parts`` x ``entries`` rows, whatever the table holds) come to the driver. Coded rows are
written once; the error of a label joins back as a small table, or by a shuffled join whose hot label
adaptive execution can split.

Defined cases: null vectors, vectors of no component and those with null or non-finite components are
dropped, and so are vectors of another length than that of the smallest id. A length that ``parts``
does not divide is an error. Components that would make a squared distance overflow a long (beyond
2^27 after scaling at 64 dimensions) are held at that bound. Null ids come last in the order of ids,
equal ids are ordered by their integers; repeated rows are coded each. With fewer than ``entries``
vectors a codebook is shorter; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import sized, stored

LIMB = 14
_HALF = 1 << (LIMB - 1)
#: Vectors whose distances a task holds at a time.
BLOCK = 1024
_HEX = np.array([f"{i:02x}" for i in range(256)], dtype="S2")


def bound_of(width: int) -> int:
    """The largest size of a component at which a squared distance over ``width`` components fits a long."""
    return 1 << ((62 - max(1, width).bit_length()) // 2)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Balanced limbs of 14 bits, lowest first, as float64; as many as the largest value needs."""
    out = []
    while not out or x.any():
        low = ((x + _HALF) & ((1 << LIMB) - 1)) - _HALF
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB
    return out


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(parts, n, entries) dot products of (parts, n, width) and (parts, entries, width) integers, in int64."""
    out = np.zeros((x.shape[0], x.shape[1], c.shape[1]), np.int64)
    for j, right in enumerate(limbs(c)):
        turned = np.ascontiguousarray(right.transpose(0, 2, 1))
        for i, left in enumerate(limbs(x)):
            out += np.matmul(left, turned).astype(np.int64) << (LIMB * (i + j))
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance), each (parts, n), of the nearest entry, the lowest of several."""
    far = (books * books).sum(axis=2)[:, None, :] - 2 * exact_products(x, books)
    best = far.argmin(axis=2)
    return best, np.take_along_axis(far, best[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)


def _blocks(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their integers as (parts, n, width)."""
    column = batch.column(batch.schema.get_field_index("v"))
    flat = np.asarray(column.flatten()).reshape(len(batch), parts, width)
    for i in range(0, len(batch), BLOCK):
        yield batch.slice(i, BLOCK), np.ascontiguousarray(flat[i : i + BLOCK].transpose(1, 0, 2))


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the usable vectors, as integers."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~odd)
    most = F.lit(float(1 << 40))  # the exact bound follows from the width
    return rows.select("id", "label", F.transform("x", lambda x: F.greatest(-most, F.least(most, F.floor(x * scale).cast("double"))).cast("long")).alias("v"))


def train_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """(parts, entries, width) integers; None without vectors. ``rows`` as ``fit_transform`` prepares them."""
    order = F.col("id").asc_nulls_last()
    ids = [r["id"] for r in rows.select("id").orderBy(order).limit(entries).collect()]
    # tasks first send ids alone; vectors come from those tasks that hold some of the first
    some = rows.where(F.col("id") <= F.lit(ids[-1])) if len(ids) == entries and ids[-1] is not None else rows
    first = some.orderBy(order, "v").limit(entries).select("v").collect()
    if not first:
        return None
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width, entries = books.shape[2], books.shape[1]
    sums = [f"s{i}" for i in range(width)]
    for _ in range(rounds):

        def assigned(batches, books=books):
            total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
            base = (np.arange(parts) * entries)[:, None]
            for batch in batches:
                for _, x in _blocks(batch, parts, width):
                    slots = (nearest(x, books)[0] + base).ravel()
                    np.add.at(total, slots, x.reshape(-1, width))
                    count += np.bincount(slots, minlength=len(count))
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(np.ascontiguousarray(total[used, i])) for i in range(width))], names=["slot", "n", *sums])

        sent = rows.select("v").mapInArrow(assigned, "slot int, n long, " + ", ".join(f"{s} long" for s in sums))
        found = sent.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", *sums))).collect()
        books = books.copy()
        for r in found:
            books[r["slot"] // entries, r["slot"] % entries] = [r[s] // r["n"] for s in sums]
    return books


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of (id, label, v) rows."""
    parts, _, width = books.shape

    def coded(batches):
        for batch in batches:
            for own, x in _blocks(batch, parts, width):
                index, error = nearest(x, books)
                code = np.ascontiguousarray(_HEX[index.T]).view(f"S{2 * parts}").ravel().astype(str)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(code, pa.string()), pa.array(error.sum(axis=0))], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def fit_transform(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of every usable vector (id, code, error, label_error, codebooks_sha256), and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = integers(df, id_col, vector_col, label_col, scale)
    lead = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    width = lead[0]["n"] if lead else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    most = F.lit(bound_of(width))
    rows = rows.where(F.size("v") == width).withColumn("v", F.transform("v", lambda x: F.greatest(-most, F.least(most, x))))
    books = train_codebooks(rows, parts, entries, rounds)
    if books is None:
        none = rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return none.where(F.lit(False)), None
    coded = stored(encode(rows, books))
    labels = stored(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"))).withColumnRenamed("label", "of")
    joined = coded.join(sized(labels), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")), books


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every usable vector's code."""
    return fit_transform(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


_X = [f"x{i}" for i in range(4)]
_ROUND = f"""
a{{n}} AS (
  SELECT vec_id, p, min({" + ".join(f"(t.{x} - b.{x}) * (t.{x} - b.{x})" for x in _X)} << 6 | e) AS m
  FROM t JOIN b{{n}} b USING (p) GROUP BY vec_id, p)"""
_NEXT = f"""
b{{k}} AS (
  SELECT p, e, {", ".join(f"coalesce(c.{x}, b.{x}) AS {x}" for x in _X)}
  FROM b{{n}} b LEFT JOIN (
    SELECT p, m & 63 AS e, {", ".join(f"floor(sum({x})::DOUBLE / count(*))::BIGINT AS {x}" for x in _X)}
    FROM t JOIN a{{n}} USING (vec_id, p) GROUP BY p, m & 63) c USING (p, e))"""

#: For vectors of 64 components and distinct ids, as the tables hold them.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
t AS (SELECT vec_id, p, {", ".join(f"v[p * 4 + {i + 1}] AS {x}" for i, x in enumerate(_X))} FROM kept, range(16) AS r(p)),
b0 AS (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {", ".join(_X)} FROM t) WHERE e < 64),
{_ROUND.format(n=0)}, {_NEXT.format(n=0, k=1)}, {_ROUND.format(n=1)}, {_NEXT.format(n=1, k=2)}, {_ROUND.format(n=2)},
codes AS (
  SELECT vec_id, string_agg(lpad(to_hex(m & 63), 2, '0'), '' ORDER BY p) AS code, sum(m >> 6)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg({" || ',' || ".join(_X)}, ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""
