"""Every registered query on the smallest data set, against its SQL where it has one."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from sensorloom.plans.queries import registered

FOLDER = "/root/testdata/sf0.001"
REGISTERED = registered()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", REGISTERED)
def test_query_matches_sql(spark, duck, name):
    query, sql = REGISTERED[name]
    assert compare(query, sql, spark, FOLDER, duck) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    flagship = contract.entry(spark)
    assert flagship.count() == 20
    assert flagship.columns[:3] == ["patient_id", "condition", "window_index"]


@pytest.mark.parametrize(
    "name", ["pulse_guard", "missing_session_files", "balanced_windows", "beat_intervals", "paired_feature_table"]
)
def test_subjects_past_four_digits_match_sql(spark, duck, tmp_path, name):
    """Users of subjects above 9,999, which the SQL pads and cuts to four digits."""
    far = tmp_path / "sf"
    far.mkdir()
    for table, key, shift in (("events", "user_id", 15_000), ("customer", "c_custkey", 1_450)):
        duck.execute(
            f"""COPY (SELECT t.* REPLACE ({key} + {shift} * i AS {key}) FROM {table} t, range(3) AS copies(i))
            TO '{far}/{table}.parquet' (FORMAT parquet)"""
        )
    shifted = connect(FOLDER)
    for table in ("events", "customer"):
        shifted.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{far}/{table}.parquet'")
    query, sql = REGISTERED[name]
    assert compare(query, sql, spark, str(far), shifted) is None


@pytest.mark.parametrize("name", ["missing_session_files", "availability_flags", "paired_audit"])
def test_sessions_that_lack_streams_match_sql(spark, tmp_path, name):
    """One user in three has sign-ups alone, another no ``error`` events."""
    far = tmp_path / "sf"
    far.mkdir()
    thin = connect(FOLDER)
    thin.execute(
        f"""COPY (SELECT * FROM events WHERE event_type = 'signup' OR user_id % 3 = 0
                  OR (user_id % 3 = 1 AND event_type <> 'error')) TO '{far}/events.parquet' (FORMAT parquet)"""
    )
    thin.execute(f"COPY customer TO '{far}/customer.parquet' (FORMAT parquet)")
    thin.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{far}/events.parquet'")
    query, sql = REGISTERED[name]
    assert compare(query, sql, spark, str(far), thin) is None


@pytest.mark.parametrize(
    "name",
    ["availability_flags", "balanced_counts", "blocked_sample_rate", "bvp_variability", "cohort_paired_table",
     "eeg_window_features", "paired_audit"],
)
@pytest.mark.parametrize("shift", [0, 150_000])
def test_repeated_events_match_sql(spark, duck, tmp_path, name, shift):
    """Each event three times, under its own user or under users so far apart that a hundred subjects share an id."""
    far = tmp_path / "sf"
    far.mkdir()
    duck.execute(
        f"""COPY (SELECT t.* REPLACE (user_id + {shift} * i AS user_id, event_id + 1000000 * i AS event_id)
        FROM events t, range(3) AS copies(i)) TO '{far}/events.parquet' (FORMAT parquet)"""
    )
    copied = connect(FOLDER)
    copied.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{far}/events.parquet'")
    query, sql = REGISTERED[name]
    assert compare(query, sql, spark, str(far), copied) is None
