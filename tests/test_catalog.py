"""Every registered graph query against its SQL on the smallest tables; queries without SQL give the same rows twice."""

import os

import pytest

from depweave import catalog, catalog_code  # noqa: F401  (registers its queries in the catalog)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    """Rows with columns by name, doubles rounded, nulls as text; sorted."""
    names = sorted(table.column_names)
    cell = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toArrow()) == rows(duck.sql(catalog.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_is_stable(spark, duck, name):
    run = catalog.queries()[name]
    assert rows(run(spark, SF).toArrow()) == rows(run(spark, SF).toArrow())
