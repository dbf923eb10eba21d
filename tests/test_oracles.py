"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from latticeconf.plans.catalogue import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    f = float(v)
    return None if math.isnan(f) else round(f, 6) + 0.0


def ordered(columns, rows):
    return sorted((repr(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True)))) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    got = QUERIES[name](spark, data)
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == ordered(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_model_queries_run(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows
    if name == "kmeans_clusters":
        assert {r["cluster"] for r in rows} <= set(range(15)) and len(rows) == spark.read.parquet(f"{data}/embeddings.parquet").count()
    if name == "gmm_groups":
        assert {r["label"] for r in rows} <= {0, 1, 2}
    if name == "pca_halves":
        v = [r["variance"] for r in sorted(rows, key=lambda r: r["place"])]
        assert all(abs(r["mean"]) < 1e-5 for r in rows)  # centred, unlike a bare PCA transform
        assert v[:8] == sorted(v[:8], reverse=True) and v[8:] == sorted(v[8:], reverse=True)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
