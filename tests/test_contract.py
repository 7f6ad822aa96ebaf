"""Driver contract: the flagship query runs on sf0.001, and a sample of queries equals its DuckDB oracle."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_smoke(spark):
    df = _entry().entry(spark)
    assert df.count() > 0
    assert {"story_id", "n_nodes", "n_edges", "graph_json"} <= set(df.columns)


def test_every_query_has_oracle_or_is_listed():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 83


@pytest.mark.parametrize("name", ["outline_fold", "event_graph", "context_text", "parse_events",
                                  "chk_state_transitions", "req_validate", "ledger_call_fake"])
def test_query_matches_oracle(spark, name):
    import sys
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from oracle_check import rows_of
    from longform.sources.tables import TABLES
    m = _entry()
    sdf = m.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(m.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, res.fetchall())
