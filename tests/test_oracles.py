"""Every query that has an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from factloom import plans
from factloom.sources import adapters

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in adapters.BASE:
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v[i]:.9g}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_oracle(spark, duck, name):
    found = plans.QUERIES[name](spark, FOLDER)
    wanted = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
