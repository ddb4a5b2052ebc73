"""Order-dependent operators that do not need a whole group in one task.

A plain window function puts all rows of its partition key in one task. The forms here cut a group
into blocks, work inside the blocks, and carry one small row per block across the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.sources.scratch import materialize

BLOCK_ROWS = 250_000
MOST_BLOCKS = 2_000
# Rows up to which a built-in exact median of whole columns is the quicker way.
SMALL_ROWS = 1_000_000


def neighbor(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    columns: dict[str, str],
    *,
    forward: bool = False,
) -> DataFrame:
    """Previous (or next) row's values per group; ``columns`` maps source to new column.

    ``block`` must not decrease along ``order``. The first row of a block gets the last row of the
    nearest earlier block of the group, so empty blocks are bridged. NULL at the group's end.
    """
    keys, order = list(keys), list(order)
    step = F.lead if forward else F.lag
    edge_of = F.min_by if forward else F.max_by
    direction = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    packed = F.struct(*(F.col(source).alias(f"_{target}") for source, target in columns.items()))

    inside = Window.partitionBy(*keys, block).orderBy(*order)
    numbered = Window.partitionBy(*keys, block).orderBy(*direction)
    edges = df.groupBy(*keys, block).agg(edge_of(packed, F.struct(*order)).alias("_edge"))
    carried = edges.select(
        *keys, block, step("_edge").over(Window.partitionBy(*keys).orderBy(block)).alias("_carried")
    )
    local = df.select("*", step(packed).over(inside).alias("_near"), F.row_number().over(numbered).alias("_rank"))
    chosen = F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col("_near"))
    return (
        local.join(carried, [*keys, block], "left")
        .withColumn("_chosen", chosen)
        .select(
            *df.columns, *(F.col(f"_chosen._{target}").alias(target) for target in columns.values())
        )
    )


def first_difference(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    name: str,
    *,
    tie: Sequence[str] = (),
    block: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``value - previous value`` in time order per group; NULL on the first row.

    Groups up to ``block_rows`` rows use a plain window function. The rows of larger ones, and only those, are
    range-partitioned into blocks of about that size and the last row of each block is carried
    over. ``block`` may give blocks that are already known; it must not decrease with time.
    """
    order = [time, *tie]

    def in_blocks(blocked: DataFrame) -> DataFrame:
        with_previous = neighbor(blocked, keys, "_block", order, {value: "_previous"})
        return with_previous.withColumn(name, F.col(value) - F.col("_previous")).drop("_block", "_previous")

    if block is not None:
        return in_blocks(df.withColumn("_block", block))
    small, large = split_groups(df, keys, block_rows)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    plain = small.withColumn(name, F.col(value) - F.lag(value).over(ordered))
    if large is None:
        return plain
    return plain.unionByName(in_blocks(ordered_blocks(large.rows, keys, order, large.blocks(block_rows))))


def block_count(rows: int, block_rows: int, partitions: int) -> int:
    """Blocks of about ``block_rows`` rows, but no more than a cluster can schedule: larger ones are streamed and spill."""
    return max(2, min(-(-rows // block_rows), max(MOST_BLOCKS, 4 * partitions)))


@dataclass(frozen=True)
class LargeGroups:
    """The rows of groups that are too large for one task, and how many they are."""

    rows: DataFrame
    count: int

    def blocks(self, block_rows: int) -> int:
        partitions = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return block_count(self.count, block_rows, partitions)


def split_groups(
    df: DataFrame, keys: Sequence[str], block_rows: int, rows: int | None = None
) -> tuple[DataFrame, LargeGroups | None]:
    """The rows of groups up to ``block_rows`` rows, and those of the others (None if there are none).

    Counting is one pass over the keys with partial aggregation. There are at most (all rows) / ``block_rows`` large groups,
    so their list is small enough to be broadcast. ``rows`` may give a known largest group size.
    """
    if rows is not None and rows <= block_rows:
        return df, None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    named = [F.col(k).alias(f"_large_{i}") for i, k in enumerate(keys)]
    listed = materialize(counts.select(*named, "_n"), "large-groups")
    count = listed.agg(F.sum("_n")).first()[0]
    if not count:
        return df, None
    listed = F.broadcast(listed.drop("_n"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_large_{i}")) for i, k in enumerate(keys)))
    return df.join(listed, same, "left_anti"), LargeGroups(df.join(listed, same, "left_semi"), count)


def ordered_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int
) -> DataFrame:
    """Range-partition by keys and order, and keep the partition number as ``_block``.

    The result is a written table: block numbers are read back, never drawn again.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(blocks, *columns).withColumn("_block", F.spark_partition_id())
    return materialize(ranged, "blocks")


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row in the order of the columns ``order``, from 1: a sort that can be checked.

    Rows are range-partitioned, sorted and numbered inside their partition; each partition's count moves the numbers of
    the later ones. ``order`` should be unique, as equal rows get their places in any order. No task holds more than a range.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    # The high bits of the id are the partition, the low 33 bits the row in it.
    numbered = numbered.withColumn("_range", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the sort.
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_row") + 1).alias(name)
    return numbered.join(F.broadcast(offsets), "_range").select(*df.columns, place)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Column],
    *,
    block_rows: int = BLOCK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Sum of each measure over the strictly earlier rows of the group, as a new column.

    ``order`` must be unique per group. Groups up to ``block_rows`` use a plain window function;
    the rows of larger ones, and only those, are range-partitioned into blocks of about that size and
    block totals are carried along each group. ``rows`` may give a known largest group size.
    """
    keys, order = list(keys), list(order)
    named = df.select("*", *(measure.alias(f"_w_{name}") for name, measure in measures.items()))

    def before(partition: Sequence[str], names: dict[str, str], by: Sequence[str]) -> list[Column]:
        frame = Window.partitionBy(*partition).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return [
            F.coalesce(F.sum(source).over(frame), F.lit(0)).alias(name)
            for source, name in names.items()
        ]

    weights = {f"_w_{name}": name for name in measures}
    small, large = split_groups(named, keys, block_rows, rows)
    plain = small.select("*", *before(keys, weights, order)).drop(*weights)
    if large is None:
        return plain
    blocked = ordered_blocks(large.rows, keys, order, large.blocks(block_rows))
    totals = blocked.groupBy(*keys, "_block").agg(
        *(F.sum(weight).alias(f"{weight}_block") for weight in weights)
    )
    offsets = totals.select(
        *keys,
        "_block",
        *before(keys, {f"{w}_block": f"{w}_offset" for w in weights}, ["_block"]),
    )
    local = blocked.select(
        "*", *before([*keys, "_block"], {w: f"{w}_local" for w in weights}, order)
    )
    in_blocks = local.join(offsets, [*keys, "_block"]).select(
        *df.columns,
        *((F.col(f"{w}_local") + F.col(f"{w}_offset")).alias(name) for w, name in weights.items()),
    )
    return plain.unionByName(in_blocks)


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact interpolating median of each value column per group, NULLs skipped.

    Groups with up to ``block_rows`` rows use the built-in aggregate. Larger ones would collect
    all their distinct values in one task; there the distinct values are counted, ranked with
    :func:`running_totals`, and the one or two middle values are picked.
    """
    keys = list(keys)
    small, large = split_groups(df, keys, block_rows)
    plain = small.groupBy(*keys).agg(*(F.median(v).alias(f"{v}_median") for v in values))
    return plain if large is None else plain.unionByName(_ranked_medians(large.rows, keys, values, block_rows))


def _ranked_medians(df: DataFrame, keys: list[str], values: Sequence[str], block_rows: int) -> DataFrame:
    counted = materialize(
        df.select(
            *keys,
            F.explode(
                F.array(*(F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_value")) for v in values))
            ).alias("_entry"),
        )
        .select(*keys, "_entry.*")
        .where(F.col("_value").isNotNull())
        .groupBy(*keys, "_name", "_value")
        .agg(F.count(F.lit(1)).alias("_count")),
        "counts",
    )
    group = [*keys, "_name"]
    ranked = running_totals(
        counted, group, ["_value"], {"_before": F.col("_count")}, block_rows=block_rows
    )
    totals = counted.groupBy(*group).agg(F.sum("_count").alias("_total"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    covers = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_count"))
    middle = (
        ranked.join(totals, group)
        .where(covers(low) | covers(high))
        .groupBy(*group)
        .agg(((F.min("_value") + F.max("_value")) / 2).alias("_median"))
    )
    wide = middle.groupBy(*keys).agg(
        *(F.max(F.when(F.col("_name") == v, F.col("_median"))).alias(f"{v}_median") for v in values)
    )
    return df.select(*keys).distinct().join(wide, keys, "left")


def column_medians(
    df: DataFrame,
    values: Sequence[str],
    *,
    small_rows: int = SMALL_ROWS,
    accuracy: int = 10_000,
) -> dict[str, float | None]:
    """Exact interpolating median of whole columns, as scalars, without sorting the table.

    Up to ``small_rows`` rows the built-in aggregate is used. Beyond that each pass brackets every
    median between two sketch quantiles and counts exactly what lies below and inside; the bracket
    shrinks until its distinct values are few, and the last pass counts just those.
    """
    columns = {v: f"_{i}" for i, v in enumerate(values)}
    data = df.select(*(F.col(v).cast("double").alias(c) for v, c in columns.items()))
    sizes = data.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns.values())).first()
    if sizes["rows"] <= small_rows:
        row = data.agg(*(F.median(c).alias(c) for c in columns.values())).first()
        return {v: row[c] for v, c in columns.items()}

    # bracket per column: low bound, high bound, rows below it, rows inside it
    brackets = {c: (None, None, 0, sizes[c]) for c in columns.values() if sizes[c]}
    middle = {c: ((sizes[c] - 1) // 2, sizes[c] // 2) for c in brackets}

    def inside(c: str, low: float | None, high: float | None) -> Column:
        bounds = F.col(c).isNotNull()
        if low is not None:
            bounds = bounds & (F.col(c) >= F.lit(low)) & (F.col(c) <= F.lit(high))
        return bounds

    open_columns = {c for c in brackets if brackets[c][3] > small_rows}
    while open_columns:
        aggregates = []
        for c in sorted(open_columns):
            low, high, below, count = brackets[c]
            fractions = [
                min(max((rank - below) / count + shift / accuracy, 0.0), 1.0)
                for rank, shift in zip(middle[c], (-2, 2), strict=True)
            ]
            kept = F.when(inside(c, low, high), F.col(c))
            aggregates.append(F.percentile_approx(kept, fractions, accuracy).alias(c))
        quantiles = data.agg(*aggregates).first()
        proposals = {c: tuple(quantiles[c]) for c in open_columns}
        counts = data.agg(
            *(F.count(F.when(F.col(c) < F.lit(low), 1)).alias(f"{c}_b") for c, (low, _) in proposals.items()),
            *(F.count(F.when(inside(c, *bounds), 1)).alias(f"{c}_i") for c, bounds in proposals.items()),
            *(
                F.approx_count_distinct(F.when(inside(c, *bounds), F.col(c))).alias(f"{c}_d")
                for c, bounds in proposals.items()
            ),
        ).first()
        for c, (low, high) in proposals.items():
            below, count, distinct = counts[f"{c}_b"], counts[f"{c}_i"], counts[f"{c}_d"]
            holds = below <= middle[c][0] and middle[c][1] < below + count
            if not holds:
                accuracy *= 10
                continue
            brackets[c] = (low, high, below, count)
            if distinct <= small_rows // 2:
                open_columns.discard(c)

    entries = F.array(
        *(
            F.struct(F.lit(c).alias("name"), F.when(inside(c, b[0], b[1]), F.col(c)).alias("value"))
            for c, b in brackets.items()
        )
    )
    counted = (
        data.select(F.explode(entries).alias("entry"))
        .select("entry.*")
        .where(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranked = running_totals(materialize(counted, "counted"), ["name"], ["value"], {"before": F.col("count")})
    wanted = [(c, rank - b[2]) for c, b in brackets.items() for rank in sorted(set(middle[c]))]
    holds = [
        (F.col("name") == c) & (F.col("before") <= rank) & (F.col("before") + F.col("count") > rank)
        for c, rank in wanted
    ]
    # One row for each middle rank reaches the driver, two for each column at most.
    found = ranked.where(reduce(Column.__or__, holds)).collect() if holds else []
    medians: dict[str, float | None] = dict.fromkeys(values)
    for v, c in columns.items():
        if c in brackets:
            at = [
                next(r["value"] for r in found if r["name"] == c and r["before"] <= rank - brackets[c][2] < r["before"] + r["count"])
                for rank in middle[c]
            ]
            medians[v] = (at[0] + at[1]) / 2
    return medians
