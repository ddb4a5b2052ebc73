from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators.evaluate import ablation, classification_metrics, two_level_metrics
from sensorloom.operators.explain import explanations, top_contributions, with_sentence
from sensorloom.operators.fusion import (
    LateFusion,
    fit_fusion,
    missing_modality_scenarios,
    shares,
)
from sensorloom.operators.heads import LogisticHead, Standardizer, fit_heads, fit_standardizer, score_heads
from sensorloom.plans.study import MODELS, StudySettings, run_study, save_study
from sensorloom.schema import TARGET

# Published test windows: subject, condition, window, label, and the wearable probability.
WINDOWS = [
    ("01", "baseline", 0, 0, 0.1684910938552075),
    ("01", "baseline", 1, 0, 0.21830691630144322),
    ("01", "baseline", 2, 0, 0.16924196826229973),
    ("01", "cognitive_load", 0, 1, 0.8228545142354386),
    ("01", "cognitive_load", 1, 1, 0.8048044715114118),
    ("01", "cognitive_load", 2, 1, 0.5483980534314592),
    ("09", "baseline", 0, 0, 0.059473497957482746),
    ("09", "baseline", 1, 0, 0.029876895770262552),
    ("09", "baseline", 2, 0, 0.03151023507862544),
    ("09", "cognitive_load", 0, 1, 0.5565829111607875),
    ("09", "cognitive_load", 1, 1, 0.21044537362685492),
    ("09", "cognitive_load", 2, 1, 0.3406902457566066),
]
FUSION = LateFusion(("eeg", "wearable"), (0.1346601652909332, 0.8653398347090667), 0.5)


@pytest.fixture(scope="module")
def tested(spark):
    schema = f"patient_id string, condition string, window_index int, {TARGET} int, beta_wearable double"
    df = spark.createDataFrame(WINDOWS, schema).withColumn("alpha_eeg", F.lit(0.5))
    return df.withColumn("combined_probability", FUSION.fuse(["alpha_eeg", "beta_wearable"]))


def test_published_fusion_and_metrics(tested):
    first = tested.where("patient_id = '01' AND condition = 'baseline' AND window_index = 0").first()
    assert first["combined_probability"] == pytest.approx(0.21313213795208172, abs=1e-15)
    models = {"eeg": "alpha_eeg", "wearable": "beta_wearable", "late_fusion": "combined_probability"}
    found = {(r["model"], r["level"]): tuple(r)[2:] for r in two_level_metrics(tested, models).collect()}
    expected = {
        ("eeg", "window"): (0.5, 0.6931471805599453, 0.5, 0.5),
        ("eeg", "session"): (0.5, 0.6931471805599453, 0.5, 0.5),
        ("wearable", "window"): (0.9722222222222223, 0.41450197855736093, 0.8333333333333334, 0.8333333333333333),
        ("wearable", "session"): (1.0, 0.3908802468699895, 0.75, 0.75),
        ("late_fusion", "window"): (0.9722222222222223, 0.4362805877118478, 0.8333333333333334, 0.8333333333333333),
        ("late_fusion", "session"): (1.0, 0.41994068899898085, 0.75, 0.75),
    }
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, abs=1e-12), key


def test_published_ablation(tested):
    scenarios = missing_modality_scenarios(tested, FUSION)
    assert scenarios.count() == 48
    found = {r["model_or_scenario"]: tuple(r)[1:] for r in ablation(tested, scenarios, MODELS).collect()}
    wearable, nothing = (1.0, 0.3908802468699895, 0.75, 0.75), (0.5, 0.6931471805599453, 0.5, 0.5)
    fused = (1.0, 0.41994068899898085, 0.75, 0.75)
    expected = {
        "EEG only (alpha)": nothing,
        "wearable only (beta)": wearable,
        "learned late fusion": fused,
        "missingness: both_available": fused,
        "missingness: eeg_missing": wearable,
        "missingness: wearable_missing": nothing,
        "missingness: both_missing": nothing,
    }
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, abs=1e-12), key


def test_metrics_of_ties_and_single_classes(spark):
    rows = [("tie", 1, 0.5), ("tie", 0, 0.5), ("tie", 1, 0.9), ("one", 1, 0.7), ("one", 1, 0.2), ("both", 0, 0.1),
            ("both", 1, 0.6)]
    df = spark.createDataFrame(rows, f"g string, {TARGET} int, probability double")
    found = {r["g"]: r for r in classification_metrics(df, ["g"]).collect()}
    assert found["tie"]["auroc"] == 0.75 and found["tie"]["balanced_accuracy"] == 0.5
    assert found["one"]["auroc"] is None and found["one"]["balanced_accuracy"] == 0.5
    assert found["both"]["auroc"] == 1.0 and found["both"]["accuracy"] == 1.0


def test_a_row_without_a_score_is_an_error(spark):
    rows = [("a", 1, None), ("a", 0, 0.1), ("a", 1, 0.6)]
    df = spark.createDataFrame(rows, f"g string, {TARGET} int, probability double")
    with pytest.raises(Exception, match="no value in probability"):
        classification_metrics(df, ["g"]).collect()


def test_blocked_auroc_against_pairs(spark):
    generator = np.random.default_rng(6)
    rows = [("g", int(y), float(s)) for y, s in zip(generator.integers(0, 2, 600), generator.integers(0, 90, 600) / 90)]
    df = spark.createDataFrame(rows, f"g string, {TARGET} int, probability double")
    ones = np.array([s for _, y, s in rows if y])
    zeros = np.array([s for _, y, s in rows if not y])
    pairs = (ones[:, None] > zeros).mean() + 0.5 * (ones[:, None] == zeros).mean()
    for block_rows in (10, 1000):
        found = classification_metrics(df, ["g"], block_rows=block_rows).first()
        assert found["auroc"] == pytest.approx(pairs, abs=1e-12)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _entropy(y, p):
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


def _training_rows(spark, n=240):
    generator = np.random.default_rng(7)
    x = generator.normal(size=(n, 4)) * [1, 10, 0.1, 0] + [0, 5, 0, 3]
    y = (x[:, 0] + generator.normal(size=n) > 0).astype(int)
    x[generator.random(x.shape) < 0.1] = np.nan
    split = np.array(["train", "train", "validation", "test"])[np.arange(n) % 4]
    rows = [(i, s, int(t), *(None if np.isnan(v) else float(v) for v in row)) for i, (s, t, row) in enumerate(zip(split, y, x))]
    return spark.createDataFrame(rows, f"i int, split string, {TARGET} int, a double, b double, c double, d double"), x, y, split


def test_heads_against_a_plain_loop(spark):
    df, x, y, split = _training_rows(spark)
    rate, epochs, l2 = 0.5, 12, 0.01
    result = fit_heads(df.repartition(5), {"first": ["a", "b"], "all": list("abcd")}, learning_rate=rate, epochs=epochs, l2=l2)
    for name, columns in (("first", [0, 1]), ("all", [0, 1, 2, 3])):
        train = x[split == "train"][:, columns]
        medians = np.nanmedian(train, axis=0)
        fill = lambda v: np.where(np.isnan(v), medians, v)
        means, scales = fill(train).mean(axis=0), fill(train).std(axis=0)
        scales[scales < 1e-8] = 1.0
        z = {s: (fill(x[split == s][:, columns]) - means) / scales for s in ("train", "validation", "test")}
        target = {s: y[split == s] for s in z}
        w, b, best, curve = np.zeros(len(columns)), 0.0, (np.inf,), []
        for epoch in range(epochs + 1):
            p = _sigmoid(z["train"] @ w + b)
            loss = _entropy(target["validation"], _sigmoid(z["validation"] @ w + b))
            curve.append((epoch, _entropy(target["train"], p) + 0.5 * l2 * w @ w, loss))
            if loss < best[0]:
                best = (loss, w.copy(), b, epoch)
            error = p - target["train"]
            w, b = w - rate * (z["train"].T @ error / len(error) + l2 * w), b - rate * error.mean()
        head = result.heads[name]
        assert head.weights == pytest.approx(best[1], abs=1e-10) and head.bias == pytest.approx(best[2], abs=1e-10)
        assert head.best_epoch == best[3] and head.best_validation_loss == pytest.approx(best[0], abs=1e-10)
        assert np.allclose(result.curves[name], curve)
        scored = score_heads(df.where("split = 'test'"), {"p": head}).orderBy("i").toPandas()["p"]
        assert np.allclose(scored, _sigmoid(z["test"] @ best[1] + best[2]))


def test_checkpoint_can_be_epoch_zero_and_ties_keep_order(spark):
    rows = [("train", 1, 1.0, 2.0), ("train", 0, -1.0, 1.0), ("validation", 0, 1.0, 1.5), ("validation", 1, -1.0, 1.5)]
    df = spark.createDataFrame(rows, f"split string, {TARGET} int, a double, b double")
    head = fit_heads(df, {"h": ["a", "b"]}, epochs=3).heads["h"]
    assert head.best_epoch == 0 and head.weights == (0.0, 0.0)
    assert [r["feature"] for r in head.coefficient_table(spark).collect()] == ["a", "b"]


def test_standardizer_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    fitted = fit_standardizer(df, ["a", "b"])
    assert (fitted.medians, fitted.means, fitted.scales) == ((0.0, 2.0), (0.0, 2.0), (1.0, 1.0))
    with pytest.raises(ValueError):
        fit_standardizer(df.limit(0), ["a"])


def test_fusion_against_a_plain_loop(spark):
    generator = np.random.default_rng(8)
    y = generator.integers(0, 2, 90)
    p = np.clip(np.c_[generator.random(90), 0.5 + 0.3 * (y - 0.5) + 0.1 * generator.normal(size=90)], 0.01, 0.99)
    df = spark.createDataFrame([(int(t), *map(float, row)) for t, row in zip(y, p)], f"{TARGET} int, a double, b double")
    result = fit_fusion(df.repartition(4), ["a", "b"], learning_rate=0.8, epochs=25, fallback=0.4)
    z, best = np.zeros(2), (np.inf,)
    for _ in range(26):
        w = shares(z)
        f = p @ w
        loss = _entropy(y, f)
        if loss < best[0]:
            best = (loss, w)
        c = np.clip(f, 1e-7, 1 - 1e-7)
        g = (c - y) / (c * (1 - c) * len(y))
        z = z - 0.8 * np.array([np.sum(g * w[k] * (p[:, k] - f)) for k in range(2)])
    assert result.fusion.weights == pytest.approx(best[1], abs=1e-10)
    assert [h[0] for h in result.history] == [*range(0, 26, 2), 25]
    assert result.curve(spark).columns == ["epoch", "validation_loss", "weight_eeg", "weight_wearable"]
    for broken in (float("nan"), None, math.inf):
        bad = spark.createDataFrame([(1, 0.5, broken)], f"{TARGET} int, a double, b double")
        with pytest.raises(ValueError):
            fit_fusion(bad, ["a", "b"], epochs=1)
    with pytest.raises(ValueError):
        fit_fusion(df, ["a"], epochs=1)


def test_fusing_with_missing_modalities(spark):
    fusion = LateFusion(("eeg", "wearable"), (0.25, 0.75), 0.4)
    df = spark.createDataFrame([(0.2, 0.6), (None, 0.6), (0.2, float("nan")), (None, None)], "a double, b double")
    found = [r[0] for r in df.select(fusion.fuse(["a", "b"])).collect()]
    assert found == pytest.approx([0.5, 0.6, 0.2, 0.4])
    declared = [r[0] for r in df.select(fusion.fuse(["a", "b"], [F.lit(True), F.lit(False)])).collect()]
    assert declared == [0.2, None, 0.2, None]
    with pytest.raises(ValueError):
        fusion.fuse(["a"])


def test_explanations(spark):
    standard = Standardizer(("x", "y", "z"), (0.0,) * 3, (0.0,) * 3, (1.0,) * 3)
    head = LogisticHead("h", standard, (1.0, -1.0, 3.0), 0.0, 0, 0.0)
    df = spark.createDataFrame(
        [("p_01", "baseline", 2.0, 2.0, 0.5, 0.25, 0.75, 0.6)],
        "patient_id string, condition string, x double, y double, z double, alpha_eeg double, "
        "beta_wearable double, combined_probability double",
    )
    row = with_sentence(explanations(df, head, head, FUSION, top_k=2)).first()
    assert row["eeg_linear_contributions"] == {"x": 2.0, "y": -2.0}
    assert row["fusion_weights"]["wearable"] == FUSION.weights[1]
    assert row["explanation"].startswith(
        "Participant p_01 / baseline: EEG alpha=0.250, wearable beta=0.750, combined cognitive-load probability=0.600. "
    )
    listed = df.select(top_contributions([("n", F.lit(None).cast("double")), ("x", F.col("x")), ("y", -F.col("y"))], 3)).first()[0]
    assert [e["feature"] for e in listed] == ["x", "y", "n"]


def test_whole_study(spark, tmp_path):
    generator = np.random.default_rng(9)
    features = [f"f{i}" for i in range(4)]
    rows = []
    for subject in range(10):
        for condition, label in (("baseline", 0), ("cognitive_load", 1)):
            for window in range(3):
                values = generator.normal(size=4) + label * np.array([0.1, 0.0, 1.5, 0.5])
                rows.append((f"s{subject}", condition, window, label, *map(float, values)))
    columns = ", ".join(f"{f} double" for f in features)
    paired = spark.createDataFrame(rows, f"patient_id string, condition string, window_index int, {TARGET} int, {columns}")
    settings = StudySettings(head_epochs=6, fusion_epochs=6, eeg_features=features[:2], wearable_features=features[2:])
    result = run_study(paired, settings)
    assert result.test.count() == 12 and result.scenarios.count() == 48 and result.ablation.count() == 7
    assert result.fusion.fusion.fallback == 0.5
    both = result.scenarios.where("scenario = 'both_available'").agg(F.sum("combined_probability")).first()[0]
    assert both == pytest.approx(result.test.agg(F.sum("combined_probability")).first()[0])
    save_study(spark, result, str(tmp_path / "out"))
    written = {p.name for p in (tmp_path / "out").iterdir()}
    assert len(written) == 11 and {"metrics", "explanations", "ablation", "eeg_training_curve"} <= written
    document = spark.read.json(str(tmp_path / "out" / "metrics")).collect()
    sizes = {r["name"]: r["value"] for r in document if r["section"] == "split_sizes"}
    assert sizes == {"train": 6, "validation": 2, "test": 2}
    listed = [(r["name"], r["text"]) for r in document if r["section"] == "split_subjects"]
    assert sorted(listed) == sorted((r["split"], r["patient_id"]) for r in result.membership.collect())
    assert sum(r["section"] == "metrics" for r in document) == 24
    explicit = result.membership.withColumn("split", F.reverse(F.col("split")))
    assert explicit.count() == 10


@pytest.mark.parametrize("parts", [1, 5, 90])
def test_one_row_of_sums_reaches_the_driver(spark, parts):
    from sensorloom.operators.blocks import block_sums, pack_blocks, release_blocks, sum_over_blocks

    rows = spark.range(900).selectExpr("cast(id as double) as a", "cast(id * id as double) as b").repartition(parts)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 40)  # a task per file
    try:
        blocks = pack_blocks(rows, ["a", "b"])
        assert blocks.rdd.getNumPartitions() == parts
        assert block_sums(blocks, 2, 3, lambda m: np.array([len(m), *m.sum(axis=0)])).count() == 1
        total = sum_over_blocks(blocks, 2, 3, lambda m: np.array([len(m), *m.sum(axis=0)]))
        assert total.tolist() == [900, 900 * 899 / 2, 899 * 900 * 1799 / 6]
        release_blocks(blocks)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    empty = pack_blocks(rows.limit(0), ["a", "b"])
    assert sum_over_blocks(empty, 2, 3, lambda m: np.ones(3)).tolist() == [0, 0, 0]
