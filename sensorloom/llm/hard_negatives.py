"""Hard negatives by bounds along a spanning tree of anchors.

Anchors lie in trees of bounded size whose edges are short. A candidate's score at a child anchor differs from its
score at the parent by at most the edge's length times the candidate's norm, so scores are computed again only where
that interval meets the window of scores that the child still wants. All rows are candidates: each pass reads them
where they are, with a bounded block of anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sensorloom.llm.tables import quoted
from sensorloom.sources.scratch import materialize, new_path

POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
# Values of one tree (2,048 anchors of 64 dimensions) and of the trees that one pass over the candidates takes.
TREE_VALUES = 1 << 17
PASS_VALUES = 1 << 21
# Above this share of the pairs of a level, one matrix product scores them all.
DENSE = 0.25
# Sums of products below this are exact in double precision.
EXACT = 2.0**53
LONG_MAX = 2**63 - 1


def steps(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256 * vectors)


@dataclass
class Tree:
    """Anchors by depth: ``bounds`` are the first places of each depth, parents come before their children."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray
    bounds: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent (-1: root), edge length and depth of each vector in a minimum spanning tree (Prim)."""
    count = len(vectors)
    parents, edges, depths = np.full(count, -1), np.zeros(count), np.zeros(count, dtype=np.int64)
    distance, nearest = np.full(count, np.inf), np.zeros(count, dtype=np.int64)
    open_ = np.ones(count, dtype=bool)
    place = 0
    for _ in range(count - 1):
        open_[place] = False
        apart = np.sqrt(((vectors - vectors[place]) ** 2).sum(axis=1))
        closer = open_ & (apart < distance)
        distance[closer], nearest[closer] = apart[closer], place
        place = int(np.argmin(np.where(open_, distance, np.inf)))
        parents[place], edges[place] = nearest[place], distance[place]
        depths[place] = depths[nearest[place]] + 1
    return parents, edges, depths


def _grow(rows: pa.Table) -> pa.Table:
    """The anchors of one tree -> the same in order of depth, with parent place and edge."""
    rows = rows.sort_by([("id", "ascending"), ("label", "ascending")])
    vectors = steps(_matrix(rows.column("vec").combine_chunks()))
    parents, edges, depths = spanning_tree(vectors)
    order = np.lexsort((np.arange(len(depths)), depths))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    parents = np.where(parents[order] < 0, -1, place[parents[order]])
    made = {"place": np.arange(len(order)), "parent": parents, "edge": edges[order], "depth": depths[order]}
    kept = rows.select(["tree", "id", "label", "vec"]).take(pa.array(order))
    for name, values in made.items():
        kept = kept.append_column(name, pa.array(values))
    return kept


_TREES = "tree long, id long, label long, vec array<double>, place long, parent long, edge double, depth long"


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _trees(rows: pa.Table) -> list[Tree]:
    trees = []
    rows = rows.sort_by([("tree", "ascending"), ("place", "ascending")])
    numbers = rows.column("tree").to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True]))) if len(numbers) else [0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        part = rows.slice(low, high - low).combine_chunks()
        column = {n: part.column(n).to_numpy() for n in ("id", "label", "parent", "edge", "depth")}
        bounds = np.searchsorted(column["depth"], np.arange(column["depth"][-1] + 2))
        vectors = steps(_matrix(part.column("vec").combine_chunks()))
        trees.append(Tree(column["id"], column["label"], vectors, column["parent"], column["edge"], bounds))
    return trees


def _exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers beyond double precision, held within 64 bits."""
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object) for m in (left, right)]
    products = whole[0].reshape(left.shape) @ whole[1].reshape(right.shape).T
    return np.clip(products, -LONG_MAX, LONG_MAX).astype(np.int64)


def scores_in_windows(
    tree: Tree, vectors: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Place, candidate and score of all wanted pairs with a score from ``low`` to ``high`` of their anchor.

    The last value is the number of scores that were computed.
    """
    reach = np.abs(tree.vectors).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1]
    if not reach < EXACT:
        score = _exact_scores(tree.vectors, vectors)
        i, j = np.nonzero(wanted & (score >= low[:, None]) & (score <= high[:, None]))
        return i, j, score[i, j], score.size
    norms = np.sqrt((vectors**2).sum(axis=1)) * (1 + 1e-12)
    lower = np.empty((len(tree.ids), len(vectors)))
    upper = np.empty_like(lower)
    found, computed = [], 0
    for start, stop in zip(tree.bounds[:-1], tree.bounds[1:]):
        rows = slice(start, stop)
        if start == 0:
            lower[rows], upper[rows] = -np.inf, np.inf
            may = np.ones((stop - start, len(vectors)), dtype=bool)
        else:
            apart = (tree.edges[rows] * (1 + 1e-12))[:, None] * norms + (1e-6 + 2e-15 * reach)  # above any rounding
            lower[rows] = lower[tree.parents[rows]] - apart
            upper[rows] = upper[tree.parents[rows]] + apart
            may = wanted[rows] & (upper[rows] >= low[rows, None]) & (lower[rows] <= high[rows, None])
        i, j = np.nonzero(may)
        if len(i) > DENSE * may.size:
            score = tree.vectors[rows] @ vectors.T
            lower[rows] = upper[rows] = score
            score, computed = score[i, j], computed + may.size
        else:
            score = np.einsum("ij,ij->i", tree.vectors[i + start], vectors[j])
            lower[i + start, j] = upper[i + start, j] = score
            computed += len(i)
        i = i + start
        inside = wanted[i, j] & (score >= low[i]) & (score <= high[i])
        found.append((i[inside], j[inside], score[inside]))
    i, j, score = (np.concatenate(parts) for parts in zip(*found))
    return i, j, score.astype(np.int64), computed


class Best:
    """The first ``count`` rows of each key by score descending, then id."""

    def __init__(self, count: int) -> None:
        self.count = count
        self.keys, self.ids, self.scores = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keys, ids, scores = (
            np.concatenate(p) for p in ((self.keys, keys), (self.ids, ids), (self.scores, scores))
        )
        order = np.lexsort((ids, -scores, keys))
        keys, ids, scores = keys[order], ids[order], scores[order]
        rank = np.arange(len(keys)) - np.searchsorted(keys, keys)
        kept = rank < self.count
        self.keys, self.ids, self.scores = keys[kept], ids[kept], scores[kept]

    def least(self, low: np.ndarray) -> np.ndarray:
        """For each key, the score that a new row needs at least: that of the last row where the list is full."""
        raised = low.copy()
        last = np.arange(self.count - 1, len(self.keys))
        full = last[self.keys[last] == self.keys[last - self.count + 1]]
        raised[self.keys[full]] = np.maximum(raised[self.keys[full]], self.scores[full])
        return raised


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the candidates; those of one batch by length."""
    for batch in batches:
        lengths = np.diff(batch.column(2).offsets.to_numpy())
        for length in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == length))
            if length and part.num_rows:
                yield part.column(0).to_numpy(), part.column(1).to_numpy(), steps(_matrix(part.column(2)))


def _positives(trees, count: int):
    """Candidates -> the first ``count`` of the same label for each anchor, within this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(count) for _ in trees.value]
        for ids, labels, vectors in _batches(batches):
            for tree, top in zip(trees.value, best):
                if tree.vectors.shape[1] != vectors.shape[1]:
                    continue
                low = top.least(np.full(len(tree.ids), -LONG_MAX))
                wanted = (tree.labels[:, None] == labels) & (tree.ids[:, None] != ids)
                i, j, score, _ = scores_in_windows(tree, vectors, wanted, low, np.full(len(low), LONG_MAX))
                top.add(i, ids[j], score)
        for tree, top in zip(trees.value, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.ids[top.keys]), pa.array(top.ids), pa.array(top.scores)],
                names=["anchor_id", "positive_id", "positive_score"],
            )

    return run


def _negatives(trees, windows, count: int):
    """Candidates -> for each anchor and positive the first ``count`` of other labels inside the window, within this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(count) for _ in trees.value]
        for ids, labels, vectors in _batches(batches):
            for tree, top, (_, low, high) in zip(trees.value, best, windows.value):
                if tree.vectors.shape[1] != vectors.shape[1]:
                    continue
                wide = low.shape[1]
                needed = top.least(low.reshape(-1)).reshape(low.shape)
                wanted = tree.labels[:, None] != labels
                i, j, score, _ = scores_in_windows(tree, vectors, wanted, needed.min(axis=1), high.max(axis=1))
                for k in range(wide):
                    inside = (score >= needed[i, k]) & (score <= high[i, k])
                    top.add(i[inside] * wide + k, ids[j[inside]], score[inside])
        for tree, top, (positives, low, high) in zip(trees.value, best, windows.value):
            place, k = np.divmod(top.keys, low.shape[1])
            columns = tree.ids[place], positives[place, k], top.ids, high[place, k], top.scores
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns],
                names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
            )

    return run


Windows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _windows(trees: list[Tree], positives: pa.Table, count: int, least_percent: int) -> list[Windows]:
    """Per tree the positive ids, lowest and highest scores of each anchor; a missing positive has an empty window."""
    result: list[Windows] = []
    place: dict[int, tuple[int, int]] = {}
    for t, tree in enumerate(trees):
        shape = (len(tree.ids), count)
        result.append((np.zeros(shape, dtype=np.int64), np.full(shape, LONG_MAX), np.full(shape, -LONG_MAX)))
        place.update((anchor, (t, i)) for i, anchor in enumerate(tree.ids.tolist()))
    for anchor, positive, score, rank in zip(*(column.to_pylist() for column in positives.columns)):
        t, i = place[anchor]
        ids, low, high = result[t]
        ids[i, rank - 1], high[i, rank - 1] = positive, score
        low[i, rank - 1] = -(-least_percent * score // 100)
    return result


def _one_row_per_id(rows: DataFrame) -> DataFrame:
    """``rows`` with one row per id, that with the smallest label and then vector; unchanged if no id repeats."""
    repeats = rows.groupBy("id").count().where(F.col("count") > 1)
    if repeats.isEmpty():
        return rows
    least = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"))
    return materialize(least.select("id", "row.label", "row.vec"), "candidates")


def hard_negatives(
    vectors: DataFrame,
    anchor: Callable[[Column], Column],
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    tree_values: int = TREE_VALUES,
    pass_values: int = PASS_VALUES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, all exact.

    ``anchor`` says of an id whether its row is an anchor: the query set, any share of all rows. A component x counts
    as floor(256 * x); scores are inner products of these, whole numbers (held within 64 bits). The positives of an
    anchor are its first rows of the same label by score, then id. For each, the first rows of other labels follow that
    have at least ``least_percent`` percent of its score and at most all of it. Rows with a null id, label or vector, or a
    null or non-finite component, take no part; vectors only meet others of their length; of rows with one id the
    one with the smallest label and vector counts. Fewer rows than asked for are returned as they are. Other columns are not read.

    Anchors are read in passes of about ``pass_values`` values (16 MB), which bounds what is sent to a task. A task
    returns its best rows only, and the tasks' rows meet in a ranking that keeps the first few before its exchange.
    """
    spark = vectors.sparkSession
    values = F.col(quoted(vector))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.where(values.isNotNull() & finite)
        .select(
            F.col(quoted(vec_id)).cast("long").alias("id"),
            (F.col(quoted(label)) if isinstance(label, str) else label).cast("long").alias("label"),
            values.cast("array<double>").alias("vec"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull())
    )
    rows = _one_row_per_id(rows)
    chosen = materialize(rows.where(anchor(F.col("id"))).withColumn("size", F.size("vec")).where("size > 0"), "anchors")
    sizes = chosen.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("widest")).first()
    number = -(-(sizes.n * (sizes.widest or 1)) // tree_values) if sizes.n else 0
    tree = F.pmod(F.xxhash64("id"), F.lit(max(number, 1)))
    trees = materialize(
        chosen.withColumn("tree", tree * F.lit(1 << 20) + F.col("size"))
        .select("tree", "id", "label", "vec")
        .groupBy("tree")
        .applyInArrow(_grow, _TREES),
        "anchor-trees",
    )
    per_pass = max(1, pass_values // tree_values)
    near, far = new_path(spark, "positives"), new_path(spark, "negatives")
    first = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    for start in range(0, number, per_pass):
        in_pass = (F.shiftright("tree", 20) >= start) & (F.shiftright("tree", 20) < start + per_pass)
        sent = spark.sparkContext.broadcast(_trees(trees.where(in_pass).toArrow()))
        found = rows.mapInArrow(_positives(sent, positives), "anchor_id long, positive_id long, positive_score long")
        ranked = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
        path = f"{near}/pass={start}"
        ranked.write.parquet(path)
        best = spark.read.schema(ranked.schema).parquet(path).toArrow()
        windows = spark.sparkContext.broadcast(_windows(sent.value, best, positives, least_percent))
        rows.mapInArrow(
            _negatives(sent, windows, negatives),
            "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
        ).write.mode("append").parquet(far)
        sent.destroy()
        windows.destroy()
    schema = T.StructType(
        [
            T.StructField(n, T.LongType())
            for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        ]
    )
    found = spark.read.schema(schema).parquet(far) if number else spark.createDataFrame([], schema)
    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
