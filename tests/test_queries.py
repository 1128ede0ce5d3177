import os

import duckdb
import pytest

from kinweave.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == float:
            frame[c] = frame[c].round(6) + 0.0
    return sorted(map(tuple, frame.astype(str).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["quick_score", "pair_features_v2", "pair_features_v1", "isotonic_calibrated", "auc", "feature_importance", "match_two_stage", "candidates_v1", "two_stage_v1"])
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
