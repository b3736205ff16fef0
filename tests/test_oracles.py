"""Every registered query of pictures and policies against its SQL, on whole tables."""

import duckdb
import pytest

from tessera.plans import further, oracles, queries, wider

ORACLES, QUERIES = {**oracles.ORACLES, **wider.ORACLES, **further.ORACLES}, {**queries.QUERIES, **wider.QUERIES, **further.QUERIES}

SF = "/root/testdata/sf0.001"
TABLES = "part events embeddings documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    mine = rows(got.select(*order).collect())
    assert mine and mine == rows(want.select(*order).fetchall())


def test_all_rules_have_sql():
    from tessera.operators.composite import BLENDS

    assert len(BLENDS) == 56 == sum(f"composite_{rule}" in ORACLES for rule in BLENDS)
