"""Registered queries of ``cases`` against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomgraph import cases, cases_views
from loomgraph.catalogue import QUERIES, SQL

NAMES = [n for n, f in QUERIES.items() if f.__module__ in (cases.__name__, cases_views.__name__) and n in SQL]
#: Small, and between them through most modules; all of them run in the driver's comparison.
SOME = ["set_subpart", "hom_iso", "merge_values", "pullback_attrs", "ac_nested", "lift_monic", "commutes_paths", "migrate_rule", "spo_conflict", "pbpo_typed", "pbpo_values", "slice_hom", "merge_rule", "view_after_changes", "pull_back_lines", "view_under_nac", "view_after_merge", "open_rewrite_host", "colimit_map", "compiled_rule", "schedule_batch", "weighted_walk", "pbpo_partial_abstract", "hom_take"]


@pytest.mark.parametrize("name", SOME)
def test_case_equals_its_sql(spark, sf, name):
    assert name in NAMES
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, sf)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
