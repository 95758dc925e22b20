"""Every registered query beside its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from descmap import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    flat = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(flat(r[k]) for k in order) for r in found), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in registry.ORACLES:
        q = con.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(q.columns)
        a, b = rows(df.columns, got), rows(q.columns, q.fetchall())
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, abs_tol=2e-4, rel_tol=1e-6) for u, v in zip(x, y, strict=True)), (x, y)


def test_some_dbscan_query_clusters(spark):
    """At sf0.01 some registered DBSCAN query has core rows, clusters and noise."""
    labels = [{r.cluster_label for r in registry.QUERIES[q](spark, SF.replace("0.001", "0.01")).collect()} for q in registry.QUERIES if q in ("dbscan", "dbscan_wide")]
    assert any(-1 in x and max(x) >= 0 for x in labels)


def test_entry(spark):
    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
