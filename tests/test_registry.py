"""Registered queries against their SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from tallyweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v + 0.0, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    relation = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_every_query_with_sql_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_the_sweep_is_whole(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(registry.report, "sweep", lambda d, numeric, categorical, stats, n, charts: seen.append((numeric, categorical, stats)) or [])
    monkeypatch.setattr(registry.results, "as_frame", lambda spark, rows: None)
    monkeypatch.setattr(registry.findings, "with_q", lambda frame: frame)
    registry._all(spark, sf_dir, False)
    assert seen[0][0] == ["qty", "price", "disc", "tax", "planted"] and seen[0][1] == ["flag", "status", "echo"]
    assert set(seen[0][2]) == set(seen[0][0])
