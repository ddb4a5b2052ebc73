from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators.balance import balance_conditions, condition_counts
from sensorloom.operators.features import pooled_channels, trend
from sensorloom.operators.windows import (
    assign_windows,
    session_audit,
    session_overlap,
    stream_extents,
    window_grid,
)
from sensorloom.schema import STREAMS

GRID = "patient_id string, condition string, analysis_start double, windows_candidate long"


def test_candidate_windows_of_known_overlaps(spark):
    overlaps = [187.53800010681152, 116.5, 277.1710000038147, 120.0, 10.0]
    rows = [(str(i), "c", 0.0, o) for i, o in enumerate(overlaps)]
    df = spark.createDataFrame(rows, "patient_id string, condition string, overlap_start double, overlap_stop double")
    found = {r["patient_id"]: r["windows_candidate"] for r in window_grid(df).collect()}
    # A session shorter than its warm-up keeps the negative count, and gets no window.
    assert [found[str(i)] for i in range(5)] == [5, 3, 6, 3, -1]
    assert window_grid(df, max_windows=None).where("patient_id = '2'").first()["windows_candidate"] == 8


def test_overlap_needs_every_stream(spark):
    rows = [("a", "c", s, float(t), 1.0) for s in STREAMS for t in range(3 + STREAMS.index(s))]
    rows += [("b", "c", s, 0.0, 1.0) for s in STREAMS[:3]]
    samples = spark.createDataFrame(rows, "patient_id string, condition string, stream string, time double, value double")
    found = {r["patient_id"]: r for r in window_grid(session_overlap(stream_extents(samples))).collect()}
    assert (found["a"]["overlap_start"], found["a"]["overlap_stop"]) == (0.0, 2.0)
    assert found["a"]["temperature_rows"] == 6
    assert found["b"]["overlap_start"] is None and found["b"]["windows_candidate"] == 0
    assert found["b"]["temperature_rows"] == 0


def test_edges_are_half_open(spark):
    grid = spark.createDataFrame([("a", "c", 0.1, 3)], GRID)
    times = [0.0999999, 0.1, 0.1 + 0.3, 0.1 + 2 * 0.3, 0.1 + 3 * 0.3, float(np.nextafter(0.1 + 0.3, 0))]
    samples = spark.createDataFrame([("a", "c", t) for t in times], "patient_id string, condition string, time double")
    rows = assign_windows(samples, grid, window_seconds=0.3).collect()
    found = sorted((r["time"], r["window_index"]) for r in rows)
    inside = lambda t, i: 0.1 + i * 0.3 <= t < 0.1 + i * 0.3 + 0.3
    assert found == sorted((t, i) for t in times for i in range(3) if inside(t, i))
    assert len(found) == 5


def test_salted_assignment_equals_broadcast(spark):
    generator = np.random.default_rng(1)
    keys = np.where(generator.random(3000) < 0.4, 0, generator.integers(0, 50, 3000))
    rows = [(f"p{k}", "c", float(t)) for k, t in zip(keys, generator.random(3000) * 100)]
    samples = spark.createDataFrame(rows, "patient_id string, condition string, time double")
    grid = spark.createDataFrame([(f"p{k}", "c", float(k), 4) for k in range(45)], GRID)
    plain = assign_windows(samples, grid, window_seconds=10.0)
    salted = assign_windows(samples, grid, window_seconds=10.0, broadcast_rows=5, hot_rows=200)
    shuffled = assign_windows(samples, grid, window_seconds=10.0, broadcast_rows=5)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, shuffled.collect()))


def test_balancing_with_gaps_and_blocks(spark):
    windows = [("a", "x", i) for i in (0, 2, 3, 7)] + [("a", "y", i) for i in (1, 5)]
    windows += [("b", "x", 0)] + [("c", c, 0) for c in "xyz"]
    df = spark.createDataFrame(windows, "patient_id string, condition string, window_index long")
    expected = [("a", "x", 0), ("a", "x", 2), ("a", "y", 1), ("a", "y", 5)]
    for block in (1, 2, 3, 4096):
        found = balance_conditions(df, block=block)
        assert sorted(map(tuple, found.select("patient_id", "condition", "window_index").collect())) == expected
    counts = {r["patient_id"]: (r["conditions"], r["windows_per_condition"]) for r in condition_counts(df).collect()}
    assert counts == {"a": (2, 2), "b": (1, 1), "c": (3, 1)}


def test_audit_keeps_sessions_without_used_windows(spark):
    grid = spark.createDataFrame(
        [("a", "x", 1, 1, 1, 1, 60.0, 2), ("b", "x", 1, 1, 1, 0, None, 0)],
        "patient_id string, condition string, eeg_rows long, bvp_rows long, eda_rows long, "
        "temperature_rows long, overlap_seconds double, windows_candidate long",
    )
    used = spark.createDataFrame([("a", "x")], "patient_id string, condition string")
    found = {r["patient_id"]: r["windows_used_after_balancing"] for r in session_audit(grid, used).collect()}
    assert found == {"a": 1, "b": None}


def test_pooling_with_uneven_nulls_and_group_sizes(spark):
    generator = np.random.default_rng(2)
    values = generator.normal(size=(50, 5))
    values[generator.random(values.shape) < 0.3] = np.nan
    rows = [(i % 2, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double")
    found = pooled_channels(df, ["k"], {"wide": ["a", "b", "c"], "narrow": ["d", "e"]}).collect()
    for row in found:
        part = values[row["k"] :: 2]
        assert row["channel_rows"] == 25
        for name, columns in (("wide", part[:, :3]), ("narrow", part[:, 3:])):
            assert row[f"{name}_mean"] == pytest.approx(np.nanmean(columns), abs=1e-12)
            assert row[f"{name}_variability"] == pytest.approx(np.nanstd(columns), abs=1e-12)


def test_trend_of_degenerate_windows(spark):
    rows = [("one", 1.0, 5.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("line", 0.0, 1.0), ("line", 2.0, 5.0),
            ("line", 3.0, None), ("line", 4.0, float("inf")), ("none", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, time double, value double")
    found = {r["k"]: r["s"] for r in df.groupBy("k").agg(trend("value", "time").alias("s")).collect()}
    assert found == {"one": None, "flat": None, "line": 2.0, "none": None}


def test_null_values_count_as_rows(spark):
    from sensorloom.operators.windows import window_row_counts

    rows = [("a", "c", 0, s, None) for s in STREAMS]
    df = spark.createDataFrame(rows, "patient_id string, condition string, window_index long, stream string, value double")
    row = window_row_counts(df).first()
    assert all(row[f"{s}_window_rows"] == 1 for s in STREAMS)
    assert df.agg(F.count("value")).first()[0] == 0


def test_known_counts_save_the_counting_scan(spark, tmp_path):
    """Above the broadcast limit, with a hot session: the samples are scanned once, and the rows are the same."""
    import sensorloom.operators.joins as joins

    rows = [(f"p{i % 4 if i % 3 else 0}", "a", float(i % 97)) for i in range(600)]
    spark.createDataFrame(rows, "patient_id string, condition string, time double").write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    grid = samples.groupBy("patient_id", "condition").agg(
        F.min("time").alias("analysis_start"), F.lit(6).cast("long").alias("windows_candidate"), F.count(F.lit(1)).alias("n")
    )
    spark.createDataFrame(grid.collect(), grid.schema).write.parquet(str(tmp_path / "g"))
    grid = spark.read.parquet(str(tmp_path / "g"))
    counted = []
    group = type(samples).groupBy

    def watched(self, *columns):
        counted.append(self)
        return group(self, *columns)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(samples), "groupBy", watched)
        known = assign_windows(samples, grid, window_seconds=10.0, rows=F.col("n"), broadcast_rows=0, hot_rows=100)
        assert not counted
        plain = assign_windows(samples, grid, window_seconds=10.0, broadcast_rows=0, hot_rows=100)
        assert counted
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/s]") == 1 and joins.BROADCAST_ROWS
    direct = assign_windows(samples, grid, window_seconds=10.0)
    expected = sorted(map(tuple, direct.collect()))
    assert sorted(map(tuple, known.select(*direct.columns).collect())) == expected
    assert sorted(map(tuple, plain.select(*direct.columns).collect())) == expected
