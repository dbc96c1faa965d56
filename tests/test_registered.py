"""Some registered queries against their SQL, at the smallest scale; the driver compares all of them."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from callscape.queries import ORACLE_SQL, QUERIES, TABLES

DATA = "/root/testdata/sf0.001"
SOME = ["b1_project_properties", "d4_three_hops", "h18_call_edges", "h23_route_edges", "h33_refreshed_edges", "j4_trace_path", "h28_scip_edges", "i6_edge_pair_f1", "e6_architecture", "c9_and_or", "d1_expand_out", "d3_undirected_strict", "f7_distinct_edges", "e9_trace_outbound", "d14_trace_both", "j2_search_graph", "j9_search_code_full", "h1_classify_changes", "fq_prefixes", "d8_enclosing_definition", "i3_positional_f1", "a18_edge_pairs", "d13_sweep_edges"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(float(v), 9) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == cols
    assert ours == sorted(repr(tuple(plain(r[have.index(c)]) for c in cols)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["r_id", "m_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
