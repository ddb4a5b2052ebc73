"""Pulse peaks of windows with more samples than one task should hold.

The results equal those of the one-task form. A window is numbered in time order and cut into
chunks of ``block_rows`` samples; every step works per chunk and passes only what crosses the cuts:

* the previous and next sample values (:func:`neighbor`), for steps and local maxima;
* peaks within the refractory distance of a cut, whose fate is settled in rounds;
* chunk minima and maxima, for the bases of peaks that see no higher sample inside their chunk.

Subtracting the median moves neither peaks nor prominences, so it is left out here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators.joins import sized_join
from sensorloom.operators.ordering import grouped_median, neighbor, running_totals
from sensorloom.operators.pulse import PulseRules, base_levels
from sensorloom.sources.scratch import materialize

LONG, DOUBLE, BOOLEAN = T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(df: DataFrame, keys: Sequence[str], **fields: T.DataType) -> T.StructType:
    return T.StructType(
        [*(df.schema[key] for key in keys), *(T.StructField(n, t) for n, t in fields.items())]
    )


def _take(table: pa.Table, columns: Sequence[str], rows: np.ndarray) -> pa.Table:
    return table.select(list(columns)).take(pa.array(rows, pa.int64()))


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _limits(indexed: DataFrame, keys: Sequence[str], rules: PulseRules, block_rows: int) -> DataFrame:
    """Per window: refractory distance in samples and prominence floor."""
    steps = neighbor(indexed, keys, "chunk", ["position"], {"time": "before"}).select(
        *keys, (F.col("time") - F.col("before")).alias("step")
    )
    medians = grouped_median(steps, keys, ["step"], block_rows=block_rows)
    floors = indexed.groupBy(*keys).agg(
        F.greatest(
            F.stddev_pop("value") * F.lit(rules.prominence_share), F.lit(rules.prominence_floor)
        ).alias("floor"),
        F.count(F.lit(1)).alias("n"),
    )
    rate = 1.0 / F.col("step_median")
    distance = F.greatest(F.lit(1), F.bround(rate * F.lit(rules.refractory_seconds), 0).cast("long"))
    usable = (F.col("n") >= rules.minimum_samples) & (F.col("step_median") != 0)
    limits = medians.join(floors, list(keys)).where(usable)
    return materialize(limits.select(*keys, distance.alias("distance"), "floor"), "limits")


def _maxima(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Middle sample of every strict local maximum; runs of equal values may cross chunks."""
    order = ["position"]
    with_before = neighbor(indexed, keys, "chunk", order, {"value": "before"})
    runs = with_before.where(F.col("before").isNull() | (F.col("before") != F.col("value")))
    runs = neighbor(
        runs, keys, "chunk", order, {"position": "next_position", "value": "after"}, forward=True
    )
    tops = runs.where((F.col("value") > F.col("before")) & (F.col("value") > F.col("after")))
    middle = F.floor((F.col("position") + F.col("next_position") - 1) / 2).alias("position")
    times = indexed.select(*keys, "position", "time")
    return tops.select(*keys, middle, F.col("value").alias("height")).join(times, [*keys, "position"])


def _settle(table: pa.Table) -> pa.Table:
    """Decide the own peaks of one cell as far as the visible neighbours allow.

    A peak goes if a kept higher one is too close, stays if all higher ones close by are gone, and
    waits otherwise. Equal heights rank by position, the later first.
    """
    position, height = _array(table, "position"), _array(table, "height")
    by_place = np.argsort(position)
    position, height = position[by_place], height[by_place]
    own = table.column("is_own").to_numpy(zero_copy_only=False).astype(bool)[by_place]
    kept = table.column("kept").to_pandas()
    state = kept.map({True: 1, False: 0}).fillna(-1).to_numpy(dtype=np.int8)[by_place]
    distance = int(table.column("distance")[0].as_py())
    order = np.lexsort((position, height))[::-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    first = np.searchsorted(position, position - distance, side="right")
    last = np.searchsorted(position, position + distance, side="left")
    for peak in order:
        if state[peak] != -1 or not own[peak]:
            continue
        near = slice(first[peak], last[peak])
        higher = state[near][rank[near] < rank[peak]]
        if (higher == 1).any():
            state[peak] = 0
        elif not (higher == -1).any():
            state[peak] = 1
    rows = np.flatnonzero(own)
    columns = [c for c in table.column_names if c not in ("kept", "is_own", "cell")]
    decided = pa.array([None if s == -1 else bool(s) for s in state[rows]], pa.bool_())
    return _take(table, columns, by_place[rows]).append_column("kept", decided)


def _spaced(maxima: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Peaks left after higher ones suppress others within the refractory distance.

    Each round settles all peaks whose higher neighbours are settled, a whole cell at a time, so a
    chain of undecided peaks shortens by at least one cell per round.
    """
    columns = [*keys, "position", "height", "time", "distance", "floor"]
    peaks = materialize(maxima.select(*columns, F.lit(None).cast("boolean").alias("kept")), "peaks")
    widest = peaks.agg(F.max("distance")).first()[0] or 1
    if widest == 1:
        return peaks.drop("kept", "distance")
    cell_rows = max(block_rows, 2 * widest)
    cell = F.floor(F.col("position") / cell_rows)
    offset = F.col("position") - cell * cell_rows
    cells = F.array_compact(
        F.array(
            cell,
            F.when(offset <= F.col("distance"), cell - 1),
            F.when(cell_rows - offset <= F.col("distance"), cell + 1),
        )
    )
    schema = T.StructType([*(peaks.schema[c] for c in columns), T.StructField("kept", BOOLEAN)])
    while not peaks.where(F.col("kept").isNull()).isEmpty():
        shared = peaks.withColumn("_home", cell).withColumn("cell", F.explode(cells))
        shared = shared.withColumn("is_own", F.col("cell") == F.col("_home")).drop("_home")
        peaks = materialize(shared.groupBy(*keys, "cell").applyInArrow(_settle, schema), "peaks")
    return peaks.where("kept").drop("kept", "distance")


def _inside_chunk(keys: Sequence[str]):
    """Both sides of each peak as seen inside its chunk: True, False, or NULL where still open."""

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        at = np.flatnonzero(table.column("is_peak").to_numpy(zero_copy_only=False))
        values = _array(table, "value")
        floor = _array(table, "floor")[at]
        result = _take(table, [*keys, "position", "chunk", "time", "value", "floor"], at)
        result = result.rename_columns([*keys, "position", "chunk", "time", "height", "floor"])
        for side, (base, walled) in zip(("left", "right"), base_levels(values, at), strict=True):
            stands_out = values[at] - base >= floor
            known = stands_out | walled
            result = result.append_column(side, pa.array(stands_out, pa.bool_(), mask=~known))
        return result

    return judge


def _nearest_chunks(table: pa.Table) -> pa.Table:
    """For each open side, the nearest chunk with a higher or a low enough sample; -1 if none.

    The group holds one row per chunk, and per chunk at most one open height on each side.
    """
    table = table.sort_by("chunk")
    chunk, low, high = _array(table, "chunk"), _array(table, "low"), _array(table, "high")
    height, floor = _array(table, "height"), _array(table, "floor")
    side = table.column("side").to_pylist()
    is_chunk = np.array([s is None for s in side])
    chunks, lows, highs = chunk[is_chunk], low[is_chunk], high[is_chunk]
    rows = np.flatnonzero(~is_chunk)
    target = np.full(len(rows), -1, dtype=np.int64)
    for n, row in enumerate(rows):
        leftward = side[row] == "left"
        at = int(np.searchsorted(chunks, chunk[row]))
        reach, start = 64, at - 1 if leftward else at + 1
        while 0 <= start < len(chunks):
            stop = max(start - reach, -1) if leftward else min(start + reach, len(chunks))
            seen = np.arange(start, stop, -1 if leftward else 1)
            hit = (highs[seen] > height[row]) | (height[row] - lows[seen] >= floor[row])
            if hit.any():
                target[n] = chunks[seen[int(np.argmax(hit))]]
                break
            start, reach = stop, reach * 2
    columns = [c for c in table.column_names if c not in ("low", "high")]
    return _take(table, columns, rows).append_column("target", pa.array(target))


def _first_event(keys: Sequence[str]):
    """Whether the low enough sample comes before any higher one, walking into the target chunk."""

    def judge(queries: pa.Table, samples: pa.Table) -> pa.Table:
        values = _array(samples.sort_by("position"), "value")
        side = np.array(queries.column("side").to_pylist(), dtype=object)
        height, floor = _array(queries, "height"), _array(queries, "floor")
        stands_out = np.zeros(len(side), dtype=bool)
        for name in ("left", "right"):
            walk = values[::-1] if name == "left" else values
            if not len(walk):
                continue
            here = side == name
            highest, lowest = np.maximum.accumulate(walk), np.minimum.accumulate(walk)
            higher_at = np.searchsorted(highest, height[here], side="right")
            # The running minimum falls, so its negative can be searched.
            low_at = np.searchsorted(-lowest, -(height[here] - floor[here]), side="left")
            stands_out[here] = low_at < higher_at
        result = queries.select([*keys, "chunk", "side", "height"])
        return result.append_column("stands_out", pa.array(stands_out))

    return judge


def _prominent(indexed: DataFrame, spaced: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    marks = spaced.select(*keys, "position", "floor", F.lit(True).alias("is_peak"))
    marked = indexed.join(marks, [*keys, "position"], "left").withColumn(
        "is_peak", F.coalesce("is_peak", F.lit(False))
    )
    fields = {"position": LONG, "chunk": LONG, "time": DOUBLE, "height": DOUBLE, "floor": DOUBLE}
    judged = marked.groupBy(*keys, "chunk").applyInArrow(
        _inside_chunk(keys), _schema(indexed, keys, **fields, left=BOOLEAN, right=BOOLEAN)
    )
    # A peak that failed on one side is out, whatever the other side would show.
    alive = materialize(
        judged.where(F.coalesce("left", F.lit(True)) & F.coalesce("right", F.lit(True))), "alive"
    )
    # Two open peaks of one chunk and side, neither of them out, have the same height: a lower one
    # would be walled by the other with too shallow a base. So there is one question per side.
    sides = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("left").isNull(), F.lit("left")),
                F.when(F.col("right").isNull(), F.lit("right")),
            )
        )
    )
    questions = alive.select(*keys, "chunk", "height", "floor", sides.alias("side")).distinct()
    bounds = indexed.groupBy(*keys, "chunk").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    both = questions.unionByName(bounds, allowMissingColumns=True)
    targets = materialize(
        both.groupBy(*keys).applyInArrow(
            _nearest_chunks,
            _schema(
                both, keys, chunk=LONG, height=DOUBLE, floor=DOUBLE, side=T.StringType(), target=LONG
            ),
        ),
        "targets",
    )
    found = targets.where(F.col("target") >= 0)
    samples = indexed.select(*keys, "position", "value", F.col("chunk").alias("target"))
    visited = samples.join(found.select(*keys, "target").distinct(), [*keys, "target"], "left_semi")
    answers = (
        found.groupBy(*keys, "target")
        .cogroup(visited.groupBy(*keys, "target"))
        .applyInArrow(
            _first_event(keys),
            _schema(
                found, keys, chunk=LONG, side=T.StringType(), height=DOUBLE, stands_out=BOOLEAN
            ),
        )
    )
    answers = materialize(answers, "answers")
    passed = answers.where("stands_out").select(*keys, "chunk", "height", "side")
    for side in ("left", "right"):
        reached = passed.where(F.col("side") == side).select(
            *keys, "chunk", "height", F.lit(True).alias(f"{side}_reached")
        )
        alive = sized_join(
            alive, reached, [*keys, "chunk", "height"], "left", spread_by=["position"]
        ).where(F.coalesce(side, f"{side}_reached", F.lit(False)))
    return alive.select(*keys, "position", "time", "height")


def long_window_peaks(
    df: DataFrame, keys: Sequence[str], *, rules: PulseRules, block_rows: int
) -> DataFrame:
    """Peaks of long windows from their finite samples; same result as the one-task form."""
    keys = list(keys)
    numbered = running_totals(
        df.select(*keys, "time", "value"),
        keys,
        ["time", "value"],
        {"position": F.lit(1)},
        block_rows=block_rows,
    )
    chunk = F.floor(F.col("position") / block_rows)
    indexed = materialize(
        numbered.withColumn("position", F.col("position").cast("long")).withColumn("chunk", chunk),
        "indexed",
    )
    limits = _limits(indexed, keys, rules, block_rows)
    maxima = sized_join(_maxima(indexed, keys), limits, keys, spread_by=["position"])
    return _prominent(indexed, _spaced(maxima, keys, block_rows), keys)
