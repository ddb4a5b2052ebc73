from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import (
    binary_cross_entropy_term,
    entity_id,
    epoch_seconds,
    half_even_count,
    is_finite,
    lenient_double,
    log_loss_term,
    predicted_class,
    sigmoid,
)


def _values(spark, rows, schema, **columns):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [tuple(r) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_lenient_double(spark):
    text = ["1.5", " 7 ", "1e3", "-.5", "+2.", "abc", "", None, "1.5d", "nan", "0x10", "inf", "1,5"]
    found = [v for (v,) in _values(spark, text, "t string", v=lenient_double("t"))]
    assert found == [1.5, 7.0, 1000.0, -0.5, 2.0, None, None, None, None, None, None, math.inf, None]


def test_finite(spark):
    rows = [1.0, None, math.nan, math.inf, -math.inf]
    assert [v for (v,) in _values(spark, rows, "x double", v=is_finite("x"))] == [True, False, False, False, False]


def test_sigmoid_is_clipped(spark):
    found = [v for (v,) in _values(spark, [0.0, 1000.0, -1000.0, None], "z double", v=sigmoid("z"))]
    assert found[0] == 0.5 and found[1] == 1 / (1 + math.exp(-30)) and found[3] is None
    assert found[2] == pytest.approx(1 / (1 + math.exp(30)))


def test_losses_at_the_bounds(spark):
    rows = _values(
        spark, [1.0, 0.0], "p double",
        training=binary_cross_entropy_term(F.lit(1.0), "p"),
        reported=log_loss_term(F.lit(0.0), "p"),
    )
    assert rows[1][0] == pytest.approx(-math.log(1e-7))
    assert rows[0][1] == pytest.approx(-math.log(2.220446049250313e-16))


def test_half_even_and_ids(spark):
    counts = _values(spark, [10, 5, 25, 1], "n long", a=half_even_count("n", 0.5), b=half_even_count("n", 0.1))
    assert counts == [(5, 1), (2, 1), (12, 2), (1, 1)]
    ids = [v for (v,) in _values(spark, [3, 10, 1234], "n long", v=entity_id("n", "p_", 2))]
    assert ids == ["p_03", "p_10", "p_1234"]
    assert [v for (v,) in _values(spark, [0.5, 0.4999], "p double", v=predicted_class("p"))] == [1, 0]


def test_epoch_seconds_has_no_time_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.179575' AS ts")
    assert df.select(epoch_seconds("ts")).first()[0] == 1704067207.179575
