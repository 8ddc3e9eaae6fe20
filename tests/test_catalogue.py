"""Every query against its SQL on the smallest tables; those beyond SQL must give rows of a stable schema."""

import duckdb
import pandas as pd
import pytest

from plumbline.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return f"{float(v):.6g}" if float(v) != int(float(v)) else str(int(v))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted("|".join(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["grayscale", "anomaly_embed"])
def test_rounded_lists_match_sql_to_the_sign(spark, tmp_path, name):
    """Means just below zero, ties and infinite values: rounded to one and the same number, never to minus zero."""
    vectors = [[-1e-7] * 64, [1e-7] * 64, [-0.0] * 64, [0.0078125] * 64, [-0.0078125] * 64, [1e-6 * (i - 32) / 3 for i in range(64)]]
    vectors += [[float("inf")] * 64] if name == "grayscale" else []
    spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    exact = lambda rows: sorted(repr((r[0], list(r[1]))) for r in rows)
    assert exact(QUERIES[name](spark, str(tmp_path)).collect()) == exact(con.sql(ORACLES[name]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
