import compare
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimelake import suite
from regimelake.functions import ema as E
from regimelake.operators import regimes as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = compare.same(suite.QUERIES[name](spark, SF), con, suite.ORACLE_SQL[name])
    assert got == want


def test_ema_over_chunks_equals_loop(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 7)
    x = [None, 3.0, None, 5.0, *np.random.default_rng(1).random(40).tolist()]
    df = spark.createDataFrame(pd.DataFrame({"chain": "a", "idx": range(len(x)), "x": pd.array(x, "Float64")}))
    got = [r.e for r in E.ema(df, {"e": ("x", 0.2)}).orderBy("idx").collect()]
    e, want = None, []
    for v in x:
        e = e if v is None else v if e is None else 0.2 * v + 0.8 * e
        want.append(e)
    assert got[0] is None and got[1:] == pytest.approx(want[1:])


def test_states_at_thresholds_and_nulls(spark):
    rows = spark.createDataFrame([(1.12, 1.10, 1.20, 1.0), (None, 1.10, 1.0, 1.0), (1.11, 1.0, 1.3, 1.2)], "rhythm double, sigma double, size_r double, tx_r double")
    assert [r.state for r in R.classify(rows, 1.12, 1.10, 1.20, 1.10, 2).collect()] == ["S2D2", "S1D1", "S1D2"]
    slots = spark.createDataFrame([(1.12, 0.6, 1.0, 1.0, 1.0), (1.13, 0.6, 1.2, 1.0, 1.0), (1.13, 0.6, 1.2, 1.2, 1.0), (1.0, 0.4, 1.0, 1.0, 1.0)], "rhythm double, c_s double, sigma double, size_r double, tx_r double")
    assert [r.state for r in R.classify_slots(slots).collect()] == ["S1D1", "S1D2", "S2D2", "S2D1"]


def test_m1_level(spark):
    assert [r[0] for r in spark.createDataFrame([(5.07,), (1.0,), (0.5,), (0.1,)], "m double").select(R.level(F.col("m"))).collect()] == ["Excellent", "Certified", "Operational", "Provisional"]
