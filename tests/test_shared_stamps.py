"""Catalogue queries where few events of a type share a stamp, as in larger tables: rows are the SQL's, none is refused or lost."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
#: Queries that such events made fail, each named by a finding.
NAMES = [
    "append_round_trip",  # F3
    "bounds_key",  # F4
    "cmp_eq",  # F5
    "cmp_gte",  # F6
    "cmp_ne",  # F7
    "cmp_price_open",  # F8
    "cmp_tick_volume",  # F9
    "contradiction_empty",  # F10
    "datetime_below_first",  # F11
    "datetime_lt",  # F12
    "first_asc",  # F13
    "from_only",  # F14
    "keys_prefix",  # F15
    "limit_zero",  # F17
    "project_zero_fill",  # F18
    "range_limit_newest",  # F19
    "range_window",  # F20
    "tick_count",  # F22
    "tick_negative",  # F23
    "select_all",  # F24
]


@pytest.fixture(scope="module")
def seldom(tmp_path_factory):
    """Some clicks have a twin in their millisecond but not in their microsecond, some views one in their microsecond."""
    path = str(tmp_path_factory.mktemp("seldom"))
    db = duckdb.connect()
    db.execute(f"""COPY (
      SELECT * FROM '{SF_DIR}/events.parquet'
      UNION ALL SELECT event_id + 1000000,
        CASE event_type WHEN 'click' THEN make_timestamp(epoch_us(ts) // 1000 * 1000 + (epoch_us(ts) + 1) % 1000) ELSE ts END,
        user_id + 1, event_type, value + 1.5, props
      FROM '{SF_DIR}/events.parquet' WHERE event_type IN ('click', 'view') AND event_id % 20 = 3 ORDER BY event_id) TO '{path}/events.parquet'""")
    shared = "SELECT count(*) - count(DISTINCT %s) FROM '%s/events.parquet' WHERE event_type = '%s'"
    of = {kind: [db.execute(shared % (stamp, path, kind)).fetchone()[0] for stamp in ("epoch_us(ts) // 1000", "ts")] for kind in ("click", "view")}
    assert of["click"][0] > 3 and of["click"][1] == 0 and of["view"][1] > 3
    return path


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_the_sqls_where_few_events_share_a_stamp(spark, seldom, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{seldom}/events.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, seldom)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
