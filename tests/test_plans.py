"""Every registered query of the library proper against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidewords import plans

DATA = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    asked = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in asked.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, asked.fetchall())


@pytest.mark.parametrize("name", ["a26_load_report", "l7_newest_first", "p16_pending", "p2_omit_result", "s19_apply_transitions", "s2_read_jobs", "w13_concurrency", "w13_held_bytes"])
def test_last_half_millisecond_of_a_minute(spark, duck, name, tmp_path):
    """Times are cut, not rounded: 59.9996 s belong to the minute that they end."""
    made = "SELECT range AS event_id, TIMESTAMP '2024-01-05 10:00:59.9996' + INTERVAL (range // 9) MINUTE AS ts, range % 40 AS user_id, ['signup', 'view', 'purchase', 'error', 'click'][range % 5 + 1] AS event_type, range / 8 AS value, '{\"k\": ' || range % 9 || '}' AS props FROM range(360)"
    own = duckdb.connect()
    own.execute(f"COPY ({made}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, asked = plans.QUERIES[name](spark, str(tmp_path)), own.execute(plans.ORACLES[name])
    columns = [c[0] for c in asked.description]
    assert rows(got.columns, got.collect()) == rows(columns, asked.fetchall())
