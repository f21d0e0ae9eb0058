"""Every query of the engine against DuckDB on small tables."""

import duckdb
import pytest

from fragmill import catalog

#: Queries that find nothing among the few spectra of the smallest tables take the next size.
SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LARGER = {"search_mixed_queries", "spectrum_at", "search_pruned_topk", "prune_stats", "search_topk", "entropy_topk"}


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if v[i] is None else f"{v[i]:.7f}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    sf = NEXT if name in LARGER else SMALL
    db = duckdb.connect()
    for t in ("events", "lineitem"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    expected = rows(names, want.fetchall())
    assert expected
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
