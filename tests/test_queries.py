"""Every registered event-time query against its SQL."""

import time

import duckdb
import pytest

from tidemark.operators import state
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Queries whose results SQL does not express; the tests of their operators cover them.
ROWS_ONLY = {"agg_approx_median"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or str(v) in ("nan", "<NA>", "None", "NaT"):
        return "null"
    return repr(int(v)) if isinstance(v, float) and v == int(v) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name not in registry.oracle_sql():
        assert name in ROWS_ONLY and len(got)
        return
    want = con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(_plain, r)) for r in df[cols].itertuples(index=False, name=None))
    assert len(got) == len(want) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def events_of(spark, path, made):
    """A connection to DuckDB and the folder of an events table made by SQL from ``id``."""
    c = duckdb.connect()
    c.execute(f"COPY ({made}) TO '{path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return c, str(path)


def test_depot_metrics_of_a_large_late_window(spark, tmp_path):
    """2,500 late rows correct one window; each is a step and not a new pass over all rows before."""
    at = "CASE WHEN id = 2 THEN 30000000 ELSE 1000 + id END"
    c, d = events_of(spark, tmp_path, f"SELECT id AS event_id, make_timestamp({at} * 1000) AS ts, 3::BIGINT AS user_id, 'view' AS event_type, (9000 - (id * 7919) % 9001)::DOUBLE AS value, '' AS props FROM range(2500) r(id)")
    began = time.time()
    got = registry.queries()["depot_metrics"](spark, d).toPandas()
    assert time.time() - began < 40
    want = c.execute(registry.oracle_sql()["depot_metrics"]).df()
    rows = lambda df: sorted(tuple(map(_plain, r)) for r in df[sorted(want.columns)].itertuples(index=False, name=None))
    assert len(want) > 2300 and rows(got) == rows(want)


def test_totals_to_the_last_bit():
    c, n = duckdb.connect(), 20_000
    made = f"SELECT id, ((id * 7919 + id * id * 31) % 56021 / 100)::DOUBLE AS v FROM range({n}) r(id)"
    want = c.execute(f"SELECT v, sum(v) OVER (ORDER BY id) AS s FROM ({made}) ORDER BY id").fetchnumpy()
    totals, got = state.Totals(), []
    for at in range(0, n, 777):
        got += totals.add(want["v"][at : at + 777]).tolist()
    assert got == want["s"].tolist()


@pytest.mark.parametrize("value", ["(100000 + id % 3) / 100.0::DOUBLE", "CASE WHEN id % 2 = 0 THEN 0.1::DOUBLE ELSE 999.9 END", "CASE WHEN id % 5 > 0 THEN 1000.7::DOUBLE END"])
@pytest.mark.parametrize("key", ["id", "id // 3"])
def test_stateful_total_at_multiples(spark, tmp_path, value, key):
    """Totals that are just a multiple of 10,000 or miss it by a bit, nulls, and several rows of one id."""
    c, d = events_of(spark, tmp_path, f"SELECT {key} AS event_id, make_timestamp(id * 1000000) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, ({value})::DOUBLE AS value, '' AS props FROM range(30000) r(id)")
    got = sorted(map(tuple, registry.queries()["stateful_total"](spark, d).collect()))
    assert got == sorted(c.execute(registry.oracle_sql()["stateful_total"]).fetchall()) and len(got) > 500
