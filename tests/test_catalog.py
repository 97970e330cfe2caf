"""Registered queries against DuckDB on the smallest tables, and the entry point's contract."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from symbolgraph.plans import catalog

TESTDATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 6)
    return columns, sorted((tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["projection_counts", "impact_depth2", "method_hotspots", "dead_methods", "cycles_events", "inheritance_chain", "architecture_layers", "token_df", "find_route", "page_links", "architecture_pairs", "find_kinds", "data_flow_edges", "data_flow_reached", "property_types_propagated", "route_groups", "ticket_route_anchors", "ticket_symbol_anchors", "queue_infrastructure", "endpoint_merge_nodes", "endpoint_merge_edges", "import_paths", "constant_urls", "config_edges", "candidates_merged"])
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{TESTDATA}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, TESTDATA).toPandas()) == rows(db.sql(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
