"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors of a label are one node. The nodes of a label are dealt over tiles; a task multiplies two tiles of
int8 codes. How far such a product can be from the cosine follows from each vector's own quantisation error, so only
pairs whose interval holds the threshold are computed again in double precision. A task returns one count and at most
one link per node, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.components import connected_components
from sensorloom.llm.tables import join_sized, quoted
from sensorloom.sources.scratch import materialize

LEAST_COSINE = 0.93
# Values of one tile: 16,384 vectors of 64 dimensions, 8 MB in double precision.
TILE_VALUES = 1 << 20
STRIP_ROWS = 256
PAIR_ROWS = 1 << 15
# Products of two codes are at most 127 * 127, so sums over so many dimensions are exact in single precision.
EXACT_DIMENSIONS = 1024
# More than any rounding of the double-precision steps.
ROUNDING = 1e-9


def usable(vector: str) -> Column:
    """Whether the vector is not null and holds only finite components, one of them not zero."""
    values = F.col(quoted(vector))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(values.isNotNull() & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and quantisation error of each unit vector: |unit - scale * code| <= error."""
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    errors = np.linalg.norm(units - codes * scales[:, None], axis=1) * (1 + ROUNDING)
    return codes, scales, errors


def code_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, exact."""
    total = np.zeros((len(left), len(right)))
    for at in range(0, left.shape[1], EXACT_DIMENSIONS):
        part = slice(at, at + EXACT_DIMENSIONS)
        total += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return total


class Tile:
    """Vectors with their codes. Vectors are first divided by their largest component, which no cosine sees."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.codes, self.scales, self.errors = quantised(self.vectors / self.norms[:, None])

    def __len__(self) -> int:
        return len(self.vectors)


def close_pairs(left: Tile, right: Tile, at: int, stop: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of cosine ``least`` or more of the rows ``at`` to ``stop`` of ``left``; of one tile, only i < j.

    For unit vectors x and y with codes p, q, scales s, t and errors e, f, x.y differs from s * t * p.q by at most
    e + f + e * f. Pairs whose interval lies above the threshold are links, those below are none.
    """
    estimate = code_products(left.codes[at:stop], right.codes)
    estimate *= left.scales[at:stop, None] * right.scales
    slack = left.errors[at:stop, None] * (1 + right.errors) + right.errors + ROUNDING
    i, j = np.nonzero(estimate + slack >= least)
    if same:
        later = j > i + at
        i, j = i[later], j[later]
    linked = estimate[i, j] - slack[i, j] >= least
    open_pairs = np.flatnonzero(~linked)
    for low in range(0, len(open_pairs), PAIR_ROWS):
        chosen = open_pairs[low : low + PAIR_ROWS]
        a, b = i[chosen] + at, j[chosen]
        cosine = np.einsum("ij,ij->i", left.vectors[a], right.vectors[b]) / (left.norms[a] * right.norms[b])
        linked[chosen] = cosine >= least
    return i[linked] + at, j[linked]


def joined_roots(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make ``roots``, the smallest known member of each node's group, agree on both ends of all pairs."""
    while True:
        a, b = roots[i], roots[j]
        if not (a != b).any():
            return
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = roots[roots]
            if (higher == roots).all():
                break
            roots[:] = higher


def _block(least: float):
    def run(rows: pa.Table) -> pa.Table:
        nodes, times, second = (rows.column(c).to_numpy() for c in ("node", "times", "second"))
        vectors = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.astype(np.float64).reshape(len(nodes), -1)
        first = np.flatnonzero(~second)
        other = np.flatnonzero(second)
        left = Tile(vectors[first])
        same = bool(rows.column("tile")[0].as_py() == rows.column("other_tile")[0].as_py())
        right, other = (left, first) if same else (Tile(vectors[other]), other)
        counts, roots = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
        if len(left) and len(right):
            for at in range(0, len(left), STRIP_ROWS):
                i, j = close_pairs(left, right, at, min(at + STRIP_ROWS, len(left)), least, same)
                a, b = first[i], other[j]
                np.add.at(counts, a, times[b])
                np.add.at(counts, b, times[a])
                joined_roots(roots, a, b)
        some = np.flatnonzero(counts)
        return pa.table({"node": nodes[some], "linked": counts[some], "root": nodes[roots[some]]})

    return run


def linked_nodes(points: DataFrame, least: float, tile_values: int) -> DataFrame:
    """``node, linked, root`` per node and block with a link: vectors linked there, and a node of its group there.

    ``points`` has ``node, label, vec, times``, a written table. A label of many vectors has many tiles and each two
    of them are a block, so no block has more rows than two tiles however hot the label is.
    """
    kind = points.withColumn("size", F.size("vec"))
    tiles = materialize(
        kind.groupBy("label", "size").agg(
            F.ceil(F.count(F.lit(1)) * F.col("size") / F.lit(tile_values)).cast("int").alias("tiles")
        ),
        "vector-tiles",
    )
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (
        join_sized(kind, tiles, ["label", "size"], "inner")
        .withColumn("own", own)
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "label",
            "size",
            F.least("own", "met").alias("tile"),
            F.greatest("own", "met").alias("other_tile"),
            (F.col("own") > F.col("met")).alias("second"),
            "node",
            "times",
            "vec",
        )
    )
    blocks = dealt.groupBy("label", "size", "tile", "other_tile")
    return blocks.applyInArrow(_block(least), "node long, linked long, root long")


def near_duplicate_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = LEAST_COSINE,
    tile_values: int = TILE_VALUES,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows of the same label with a cosine of at least ``least`` in double precision,
    repeated rows each. ``component_id`` is the smallest id that links reach, the row's own included; ``kept``
    says that it is the row's own. Rows with a null label, and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different length do not link either. A row with a null id
    links like any other, is not kept, and has the smallest id it reaches or null. Other columns are not read.

    Equal vectors meet before anything is compared, so a group of copies of any size is one node. The comparisons in
    one label grow with the square of its distinct vectors, as those of any exact join do; links do not, since a block
    of two tiles returns one link per node.
    """
    rows = vectors.select(
        F.col(quoted(vec_id)).alias("id"), F.col(quoted(label)).alias("label"), F.col(quoted(vector)).alias("vec")
    ).withColumn("usable", F.col("label").isNotNull() & usable("vec"))
    valid = rows.where("usable")
    points = materialize(
        valid.groupBy("label", "vec")
        .agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("least_id"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vector-nodes",
    )
    linked = materialize(linked_nodes(points, least, tile_values), "vector-links")
    components = connected_components(
        linked.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    )
    groups = materialize(
        points.select("node", "times", "least_id")
        .join(linked.groupBy("node").agg(F.sum("linked").alias("linked")), "node", "left")
        .join(components, "node", "left")
        .select(
            "node",
            "least_id",
            (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "vector-groups",
    )
    least_ids = groups.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = points.select("node", "label", "vec").join(
        groups.join(least_ids, "component").select("node", "n_links", "component_id"), "node"
    )
    found = valid.join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
