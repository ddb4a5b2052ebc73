from __future__ import annotations

import numpy as np
import pytest

from sensorloom.operators.pulse import (
    PulseRules,
    Segments,
    beat_intervals,
    interval_summary,
    local_maxima,
    maxima_of,
    prominences,
    pulse_features,
    pulse_peaks,
    spaced,
)


def naive_maxima(x):
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return found


def naive_spaced(positions, heights, distance):
    kept = []
    for h, p in sorted(zip(heights, positions), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def naive_prominence(x, p):
    bases = []
    for step in (-1, 1):
        i, low = p, x[p]
        while 0 <= i < len(x) and x[i] <= x[p]:
            low = min(low, x[i])
            i += step
        bases.append(low)
    return x[p] - max(bases)


def signals():
    generator = np.random.default_rng(5)
    t = np.arange(400) / 16.0
    yield "noise", generator.normal(size=400)
    yield "coarse", generator.integers(0, 4, 400).astype(float)
    yield "beats", np.sin(2 * np.pi * 1.2 * t) + 0.1 * generator.normal(size=400)
    yield "clipped", np.clip(np.sin(2 * np.pi * 1.2 * t) * 2, -1, 1)
    yield "ramp", np.arange(400) * 0.05 + (np.arange(400) % 2)
    yield "falling", -np.arange(400) * 0.05 + (np.arange(400) % 3)
    yield "spike", np.where(np.arange(400) == 150, 50.0, generator.normal(size=400))
    yield "step", np.where(np.arange(400) < 200, 0.0, 10.0) + 0.2 * generator.normal(size=400)
    yield "constant", np.full(400, 2.0)
    yield "saturated", np.where(np.arange(400) % 7 == 0, 3.0, 2.9) - 3.0 * (np.arange(400) % 100 == 50)


@pytest.mark.parametrize("name, x", list(signals()))
def test_kernel_parts_against_brute_force(name, x):
    peaks = local_maxima(x)
    assert list(peaks) == naive_maxima(x)
    for distance in (1, 2, 5, 30):
        kept = peaks[spaced(peaks, x[peaks], np.zeros(len(peaks), dtype=int), np.array([distance]))]
        assert list(kept) == naive_spaced(list(peaks), list(x[peaks]), distance)
    found = prominences(x, peaks, peaks, Segments.between(np.arange(len(x)) == 0))
    assert np.allclose(found, [naive_prominence(x, p) for p in peaks])


def test_many_windows_at_once_equal_each_alone():
    parts = [x for _, x in signals()] + [np.zeros(1), np.array([0.0, 1.0, 0.0])]
    # A staircase of peaks, each of which has to wait for the one before.
    parts.append(np.where(np.arange(600) % 2, np.arange(600.0), 0.0))
    values = np.concatenate(parts)
    windows = Segments.between(np.concatenate([np.arange(len(x)) == 0 for x in parts]))
    peaks = maxima_of(values, windows)
    distance = np.array([1 + 3 * (i % 5) for i in range(len(parts) - 1)] + [3])
    kept = set(peaks[spaced(peaks, values[peaks], windows.of[peaks], distance)].tolist())
    for w, (x, start) in enumerate(zip(parts, windows.starts)):
        assert [p + start for p in naive_maxima(x)] == peaks[windows.of[peaks] == w].tolist()
        alone = naive_spaced(naive_maxima(x), list(x[naive_maxima(x)]), distance[w])
        assert [p + start for p in alone] == sorted(p for p in kept if windows.of[p] == w)


def test_intervals_bridge_dropped_ones(spark):
    beats = {"a": [0.0, 1.0, 4.0, 4.8], "b": [0.0, 0.2], "c": [0.0, 0.33, 1.83]}
    rows = [(w, i, t, 1.0) for w, times in beats.items() for i, t in enumerate(times)]
    peaks = spark.createDataFrame(rows, "w string, position long, time double, height double")
    found = {r["w"]: tuple(r)[1:] for r in interval_summary(beat_intervals(peaks, ["w"]), ["w"]).collect()}
    assert found["a"] == pytest.approx((60 / 0.9, 200.0))
    assert "b" not in found
    assert found["c"][0] == pytest.approx(60 / ((0.33 + 1.5) / 2))


def _frame(spark):
    rows = []
    for name, x in signals():
        rows += [(name, 1.7e9 + i / 16.0, float(v)) for i, v in enumerate(x)]
    rows += [("short", 0.0, 1.0), ("short", 1.0, 2.0), ("same time", 3.0, 1.0)] + [("same time", 3.0, 2.0)] * 3
    rows += [("spoiled", i / 4.0, float("nan") if i % 3 else float(i % 5)) for i in range(40)]
    return spark.createDataFrame(rows, "w string, time double, value double").repartition(7)


@pytest.mark.parametrize("block_rows", [16])
def test_long_windows_equal_the_one_task_form(spark, block_rows):
    rules = PulseRules(refractory_seconds=0.35, shortest_interval=0.1, longest_interval=5.0)
    df = _frame(spark)

    def peaks(rows):
        found = pulse_peaks(df, ["w"], rules=rules, block_rows=rows)
        return sorted((r["w"], r["position"], r["time"], r["height"]) for r in found.collect())

    expected = peaks(100_000)
    assert len(expected) > 50
    assert [p[:3] for p in peaks(block_rows)] == [p[:3] for p in expected]

    def features(rows):
        found = pulse_features(df, ["w"], rules=rules, block_rows=rows)
        return {r["w"]: tuple(r)[1:] for r in found.collect()}

    # The features of long windows are compared with SQL by a registered query.
    ordinary = features(100_000)
    assert ordinary["short"][1:] == (None, None, None)
    assert ordinary["same time"][1] is None and ordinary["same time"][3] is not None
    assert ordinary["spoiled"][0] == 40


def plain_prominence(values, peak, start, stop):
    bases = []
    for side in (values[start:peak][::-1], values[peak + 1 : stop]):
        reach = next((i for i, x in enumerate(side) if x > values[peak]), len(side))
        bases.append(min([*side[:reach], values[peak]]))
    return values[peak] - max(bases)


def test_prominences_of_many_windows_equal_a_search_per_peak():
    random = np.random.default_rng(6)
    for size in (1, 2, 3, 40, 400):
        values = random.integers(0, 12, size * 5).astype(float)
        windows = Segments.between(np.arange(len(values)) % size == 0)
        maxima = maxima_of(values, windows)
        chosen = maxima[random.random(len(maxima)) < 0.6]
        found = prominences(values, chosen, maxima, windows)
        wanted = [plain_prominence(values.tolist(), p, p // size * size, (p // size + 1) * size) for p in chosen.tolist()]
        assert found.tolist() == wanted


def test_bases_of_a_staircase_take_few_rounds():
    """Every peak looks past all others; a search per peak would pass a hundred thousand of them each."""
    steps = np.repeat(np.arange(100_000.0), 2)
    steps[1::2] -= 5.5
    windows = Segments.between(np.arange(len(steps)) == 0)
    maxima = maxima_of(steps, windows)
    found = prominences(steps, maxima, maxima, windows)
    assert len(maxima) == 99_999 and (found > 0).all() and found[-1] == steps[maxima[-1]] - steps[maxima[-1] + 1]
