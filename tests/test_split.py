from __future__ import annotations

import hashlib

import pytest

from sensorloom.operators.split import (
    attach_split,
    overlapping_subjects,
    require_subjects,
    split_label_counts,
    split_subjects,
)


def _subjects(spark, n, copies=1):
    return spark.createDataFrame([(f"s{i:03d}",) for i in range(n) for _ in range(copies)], "patient_id string")


@pytest.mark.parametrize(
    "n, train, validation, expected",
    [(10, 0.64, 0.18, (6, 2, 2)), (5, 0.5, 0.1, (2, 1, 2)), (5, 0.9, 0.05, (3, 1, 1)), (7, 0.64, 0.18, (4, 1, 2))],
)
def test_counts(spark, n, train, validation, expected):
    rows = split_subjects(_subjects(spark, n, 3), train_fraction=train, validation_fraction=validation).collect()
    splits = [r["split"] for r in rows]
    assert tuple(splits.count(s) for s in ("train", "validation", "test")) == expected


def test_order_is_the_hash_and_not_the_partitioning(spark):
    df = _subjects(spark, 300)
    found = {r["patient_id"]: r["split"] for r in split_subjects(df, seed=7).collect()}
    assert found == {r["patient_id"]: r["split"] for r in split_subjects(df.repartition(13), seed=7).collect()}
    assert found != {r["patient_id"]: r["split"] for r in split_subjects(df, seed=8).collect()}
    ordered = sorted(found, key=lambda s: hashlib.sha256(f"7:{s}".encode()).hexdigest())
    assert [found[s] for s in ordered] == ["train"] * 192 + ["validation"] * 54 + ["test"] * 54


def test_errors(spark):
    with pytest.raises(ValueError):
        split_subjects(_subjects(spark, 9), train_fraction=1.0)
    with pytest.raises(ValueError):
        split_subjects(_subjects(spark, 9), train_fraction=0.9, validation_fraction=0.1)
    with pytest.raises(ValueError):
        require_subjects(_subjects(spark, 4, 5))
    require_subjects(_subjects(spark, 5))


def test_lookup_is_complete_or_an_error(spark):
    df = _subjects(spark, 6, 2)
    membership = split_subjects(df)
    assert attach_split(df, membership).where("split IS NULL").count() == 0
    with pytest.raises(Exception, match="lists no split for subject s001"):
        attach_split(df, membership.where("patient_id <> 's001'")).collect()
    assert attach_split(df, membership.where("patient_id <> 's001'"), strict=False).where("split IS NULL").count() == 2
    assert overlapping_subjects(membership).isEmpty()
    twice = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "patient_id string, split string")
    assert [r["patient_id"] for r in overlapping_subjects(twice).collect()] == ["a"]


def test_crosstab_has_zeros(spark):
    df = spark.createDataFrame([("train", 0), ("train", 1), ("test", 1)], "split string, target_cognitive_load int")
    found = {r["split"]: (r["label_0"], r["label_1"]) for r in split_label_counts(df).collect()}
    assert found == {"train": (1, 1), "test": (0, 1)}
