"""A cross-section of the named pipelines against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from pipeloom import queries

SF = "/root/testdata/sf0.001"
NAMES = ["pricing_summary", "match_not_field", "match_nin", "project_nested", "unwind_index", "redact_descend", "bucket_auto", "facet_skip", "acc_first_mixed", "acc_push", "lookup_pipeline", "lookup_pipeline_self", "graph_lookup_chain", "window_max_range_days", "window_shift_ahead", "expr_slice_middle", "expr_reduce_sum", "expr_reduce_array", "window_count_range_fractions", "expr_date_week", "pipe_conversations", "lookup_array_unwind", "lookup_array_size", "match_elem_match", "window_max_range_months", "window_range_milliseconds", "window_push_null", "out_written", "merge_insert", "stream_stateless", "own_stage", "facet_mixed_order", "bucket_auto_ties"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(c[0] for c in want.description) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
