"""Zeros have the sign that SQL gives them."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from latticeconf.functions.scores import rounded
from latticeconf.plans.catalogue import ORACLE_SQL, QUERIES


def both(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    return sorted(map(repr, cur.fetchall())), sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(columns).collect())


def test_scores_of_zero_predictions(spark, tmp_path):
    ids = [i for i in range(1, 60) if i % 7]
    value = [(450 - i * 37 % 901) / 100 for i in ids]  # y + (37 id) % 901 - 450 = 0
    pq.write_table(pa.table({"event_id": ids, "user_id": [1] * len(ids), "event_type": ["view"] * len(ids), "value": value}), tmp_path / "events.parquet")
    want, got = both(spark, tmp_path, "nonconformity", "events")
    assert got == want and all(r.endswith("-0.0)") for r in got)


def test_parts_keep_the_sign_of_rounded_zeros(spark, tmp_path):
    rows = [[(-1) ** (i + k) * (k - 32) * 1e-5 for k in range(64)] for i in range(30)]
    pq.write_table(pa.table({"vec_id": list(range(30)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([i % 5 for i in range(30)], pa.int32())}), tmp_path / "embeddings.parquet")
    want, got = both(spark, tmp_path, "parts_round_trip", "embeddings")
    assert got == want and "-0.0," in got[0]


@pytest.mark.parametrize("x", [0.0, -0.0, -0.00004, 0.00005, -0.00005, 0.03125, -0.03125, 1e300, math.inf, -math.inf])
def test_rounded_equals_sql(spark, x):
    got = spark.createDataFrame([(x,)], "x double").select(rounded(F.col("x"), 4)).collect()[0][0]
    assert repr(got) == repr(duckdb.execute("SELECT round($1::DOUBLE, 4)", [x]).fetchone()[0])
