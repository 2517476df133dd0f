"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from evtide.plans.catalog import ORACLES, QUERIES
from oracle_harness import duck, frame_digest, type_diffs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    con = duck(SF)
    sn, sc, sh = frame_digest(df.toPandas())
    on, oc, oh = frame_digest(con.execute(ORACLES[name]).df())
    assert sc == oc, f"columns differ: {sc} vs {oc}"
    assert sn == on, f"row count {sn} vs {on}"
    assert sh == oh, "values differ"
    diffs = type_diffs(df, con.sql(ORACLES[name]))
    assert not diffs, diffs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert set(df.columns) == {"result_type", "event_type", "count", "unique_users", "page"}
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
