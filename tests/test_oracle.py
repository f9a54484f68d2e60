"""Every registered query with an oracle must agree with DuckDB (row count, column
names, order-insensitive values) — the same gate the driver applies."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_MID, SF_SMALL

ORACLE = sorted(E.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)  # bit-for-bit, signed zeros included
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ORACLE)
@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_MID])
def test_query_matches_oracle(spark, duck, name, sf_dir):
    df = E.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = duck(sf_dir).execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    exp = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(exp)
    assert _rows(df.columns, got) == _rows(ocols, exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "category" in df.columns


HEAVY = {"grid_ml_cv", "grid_ml_predict", "stream_grid_ingest", "stream_hourly", "stream_anomalies",
         "knn_training_features", "knn_inference_features"}


def test_every_light_query_has_a_plan(spark):
    # analysis only for the whole registry (model fits and streams are exercised elsewhere)
    for name, fn in E.queries().items():
        if name not in HEAVY:
            assert fn(spark, SF_SMALL).schema is not None, name
