from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import ordering
from sensorloom.operators.ordering import (
    column_medians,
    first_difference,
    grouped_median,
    neighbor,
    running_totals,
)


def _skewed(spark, rows=2000, seed=3):
    generator = np.random.default_rng(seed)
    keys = np.where(generator.random(rows) < 0.4, 0, generator.integers(0, 20, rows))
    times = generator.permutation(rows).astype(float)
    values = generator.integers(0, 40, rows).astype(float)
    data = [(int(k), float(t), float(v)) for k, t, v in zip(keys, times, values)]
    return spark.createDataFrame(data, "k int, t double, v double")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [1.0, 37.0, 1e6])
def test_neighbor_equals_the_plain_window(spark, forward, width):
    df = _skewed(spark).withColumn("block", F.floor(F.col("t") / width))
    step = F.lead if forward else F.lag
    plain = df.select("k", "t", step("v").over(Window.partitionBy("k").orderBy("t")).alias("n"))
    found = neighbor(df, ["k"], "block", ["t"], {"v": "n"}, forward=forward).select("k", "t", "n")
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def test_first_difference_forms_agree(spark):
    df = _skewed(spark)
    plain = first_difference(df, ["k"], "t", "v", "d").select("k", "t", "d")
    blocked = first_difference(df, ["k"], "t", "v", "d", block=F.floor(F.col("t") / 100)).select("k", "t", "d")
    ranged = first_difference(df, ["k"], "t", "v", "d", block_rows=100).select("k", "t", "d")
    assert sorted(plain.collect(), key=str) == sorted(ranged.collect(), key=str)
    assert sorted(plain.collect(), key=str) == sorted(blocked.collect(), key=str)


def test_running_totals_in_blocks(spark):
    df = _skewed(spark)
    measures = {"rank": F.lit(1), "total": F.col("v")}
    plain = running_totals(df, ["k"], ["t"], measures)
    blocked = running_totals(df, ["k"], ["t"], measures, block_rows=100)
    assert blocked.columns == plain.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, blocked.collect()))


@pytest.mark.parametrize("block_rows", [50, 10_000])
def test_grouped_median(spark, block_rows):
    df = _skewed(spark).withColumn("w", F.when(F.col("k") != 5, F.col("t") * 1.5))
    pdf = df.toPandas()
    expected = pdf.groupby("k")[["v", "w"]].median()
    found = grouped_median(df, ["k"], ["v", "w"], block_rows=block_rows).toPandas().set_index("k")
    for key, row in expected.iterrows():
        assert found.loc[key, "v_median"] == row["v"]
        assert found.loc[key, "w_median"] == row["w"] or (np.isnan(row["w"]) and np.isnan(found.loc[key, "w_median"]))


def test_column_medians_by_bracketing(spark):
    generator = np.random.default_rng(4)
    n = 5001
    columns = {
        "normal": generator.normal(size=n),
        "half_zero": np.where(generator.random(n) < 0.5, 0.0, generator.random(n)),
        "two_values": generator.integers(0, 2, n).astype(float),
        "constant": np.full(n, 7.0),
        "sparse": np.where(generator.random(n) < 0.6, np.nan, generator.exponential(size=n)),
        "empty": np.full(n, np.nan),
    }
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    for frame, size in ((df, n), (df.limit(n - 1), n - 1)):
        data = frame.toPandas()
        found = column_medians(frame, list(columns), small_rows=200, accuracy=100)
        for name in columns:
            expected = data[name].median()
            assert found[name] == expected or (found[name] is None and np.isnan(expected)), (name, size)


def test_block_count_follows_the_cluster():
    from sensorloom.operators.ordering import block_count

    assert block_count(600_000, 250_000, 8) == 3
    assert block_count(10**9, 250_000, 200) == 2_000
    assert block_count(10**13, 250_000, 5_000) == 20_000


def test_positions_follow_the_order(spark):
    from sensorloom.operators.ordering import with_position

    rows = [(i * 37 % 101, chr(97 + i % 5)) for i in range(101)]
    df = spark.createDataFrame(rows, "n int, s string").repartition(7)
    found = {(r["s"], r["n"]): r["position"] for r in with_position(df, ["s", "n"]).collect()}
    assert found == {(s, n): i + 1 for i, (s, n) in enumerate(sorted((s, n) for n, s in rows))}
    assert with_position(df.limit(0), ["n"]).count() == 0


@pytest.mark.parametrize("form", ["totals", "difference", "median"])
def test_only_large_groups_are_cut_into_blocks(spark, monkeypatch, form):
    """One plan with both branches: a group of 800 rows goes through blocks, twenty of 60 and one of nulls stay whole."""
    df = _skewed(spark).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    seen = []
    cut = ordering.ordered_blocks

    def watched(rows, *args):
        seen.append({r["k"] for r in rows.select("k").distinct().collect()})
        return cut(rows, *args)

    monkeypatch.setattr(ordering, "ordered_blocks", watched)
    forms = {
        "totals": lambda rows: running_totals(df, ["k"], ["t"], {"total": F.col("v")}, block_rows=rows),
        "difference": lambda rows: first_difference(df, ["k"], "t", "v", "d", block_rows=rows),
        "median": lambda rows: grouped_median(df, ["k"], ["t"], block_rows=rows),
    }
    mixed, whole = forms[form](300), forms[form](10_000)
    assert mixed.columns == whole.columns and seen and all(s == {0} for s in seen)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, whole.collect()))
