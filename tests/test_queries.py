"""Every query with an oracle gives the oracle's rows on the smallest data; the others run."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import PLANS

SF = "/root/testdata/sf0.001"
#: Those that ``test_invariants`` runs.
SLOW = {"GR-01", "GR-02", "CL-02", "BOQ-01", "BOQ-05", "INS-02", "GEO-14", "GEO-21", "AGG-11", "JOB-supervised-classified", "JOB-supervised", "JOB-unsupervised", "FIX-01", "FWA-05", "FWA-06", "FWA-07", "FWA-02", "GEO-10", "GR-12-reroute", "GR-12-routes", "GR-13", "AGG-18", "INS-02-paths", "GR-15", "BOQ-03"}
ALL = {k: q for plan in PLANS for k, q in plan.QUERIES.items()}
ORACLE = {k: q for plan in PLANS for k, q in plan.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _text(v):
    return None if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(ALL) - SLOW))
def test_query(spark, duck, name):
    df = ALL[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(str([_text(v) for v in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(want.columns) == cols
        assert rows == sorted(str([_text(v) for v in r]) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(ALL)
