"""Registered queries against their oracle at the smallest scale.

CHAINLOOM_ALL=1 runs every query; by default a spread of them.
"""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry
from chainloom.plans import catalog, views

SF = "/root/testdata/sf0.001"
SPREAD = (
    "context_status", "segment_tools", "turn_skeleton", "inspect_verdicts", "rewrite", "written_prune", "rendered_notes", "canonical_checksum", "sandwich_report", "explode_blocks",
    "condense_state_summary", "score_to_action", "plan_checksum", "extract_js_spans", "inspect_any_length", "summarize_segments", "overview_routes", "bad_routes", "add_notes", "search_notes",
)
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
NAMES = list(QUERIES) if os.environ.get("CHAINLOOM_ALL") else [n for n in SPREAD if n in QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLES:
        return
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


def test_no_view_looks_at_a_whole_key_in_spark():
    whole = {name for name, text in views.VIEWS.items() if "OVER (" in text}
    assert whole == set(views.SPREAD)
