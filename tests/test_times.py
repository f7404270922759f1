"""Times with parts of a second, against the SQL."""

import datetime

import pytest

from depweave import catalog, catalog_code  # noqa: F401  (registers its queries in the catalog)


def test_ages_around_now(spark, tmp_path):
    """Half a second after now is the future, though its text is that of now."""
    duckdb = pytest.importorskip("duckdb")
    now = datetime.datetime(2024, 1, 20, 12, tzinfo=datetime.timezone.utc)
    times = [now + datetime.timedelta(microseconds=us) for us in (-86_400_000_001, -86_400_000_000, -500_000, -1, 0, 1, 500_000, 1_000_000)] + [None]
    spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp").selectExpr("event_id", "ts", "'view' event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_id"], r["iso"], r["age_days"], r["style"]) for r in catalog.queries()["times_and_styles"](spark, str(tmp_path)).select("event_id", "iso", "age_days", "style").collect()}
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view events as select event_id, ts::timestamp ts, event_type from '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.sql(catalog.oracle_sql()["times_and_styles"]).fetchall())
    assert {a for i, _, a, _ in got if 5 <= i <= 7} == {None}
