from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sensorloom.llm import vector_copies
from sensorloom.llm.hard_negatives import Best, Tree, hard_negatives, scores_in_windows, spanning_tree
from sensorloom.llm.vector_copies import Tile, close_pairs, near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node long, tree int, rank string"
NAN, INF = float("nan"), float("inf")


def vectors(seed, n=220, width=8, labels=3):
    """Near copies around the threshold, copies, scaled copies, and every kind of row that takes no part."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base, label = [rng.gauss(0, 1) for _ in range(width)], rng.randrange(labels)
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append([[x + rng.gauss(0, rng.choice([0, 0.05, 0.2, 0.3])) for x in base], label])
    rows += [[list(rows[0][0]), rows[0][1]] for _ in range(30)] + [[[2 * x for x in rows[1][0]], rows[1][1]]]
    rows += [[None, 1], [[0.0] * width, 1], [[-0.0] * width, 1], [[], 1], [[1.0] * (width - 1) + [NAN], 1], [[1.0] * (width - 1) + [INF], 1]]
    rows += [[[1.0] * (width - 1) + [None], 1], [[1.0] * width, None], [[1.0] * (width + 1), 1], [[1.0] * width, 1], [[3e38] * width, 1]]
    rng.shuffle(rows)
    rows = [(i, *r) for i, r in enumerate(rows)]
    return rows + [(None, rows[3][1], rows[3][2]), rows[5], (rows[7][0], rows[9][1], rows[9][2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def as_float(vector):
    return None if vector is None else [None if x is None else float(np.float32(x)) for x in vector]


def brute_links(rows, least=0.93):
    ok = []
    for _, vector, label in rows:
        v = as_float(vector)
        ok.append(
            v if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None
        )
    links = [set() for _ in rows]
    for i, x in enumerate(ok):
        for j, y in enumerate(ok[:i]):
            if x and y and rows[i][2] == rows[j][2] and len(x) == len(y):
                dot = sum(a * b for a, b in zip(x, y))
                if dot >= least * math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)):
                    links[i].add(j), links[j].add(i)
    return links


def brute_groups(rows):
    links, result = brute_links(rows), []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        result.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(result, key=str)


@pytest.mark.parametrize("tile_values", [1 << 20, 160])
def test_near_duplicates_equal_brute_force(spark, tile_values):
    rows = vectors(11)
    got = near_duplicate_vectors(frame(spark, rows), tile_values=tile_values)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicate_vectors(frame(spark, [])).count() == 0
    rows = [(4, None, 1), (None, [1.0, 0.0], None)]
    assert sorted((tuple(r) for r in near_duplicate_vectors(frame(spark, rows)).collect()), key=str) == [
        (4, 0, 4, True),
        (None, 0, None, False),
    ]


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    rng = np.random.default_rng(5)
    made = []
    for n in (300, 600):
        base = rng.normal(size=16)
        rows = [(i, (base + rng.normal(scale=0.05, size=16)).tolist(), 1) for i in range(n)]
        points = frame(spark, rows).selectExpr("vec_id as node", "label", "embedding as vec", "1L as times")
        linked = vector_copies.linked_nodes(points, 0.93, 16 * 100).collect()
        made.append(len(linked) / n)
        assert sum(r["linked"] for r in linked) == n * (n - 1)
    assert made[0] <= 4 and made[1] <= 8  # one row per node and tile met


def test_error_bounds_are_rigorous():
    rng = np.random.default_rng(9)
    for width in (1, 3, 64, 1500):
        x = rng.normal(size=(60, width)) * rng.lognormal(sigma=3, size=(60, width))
        left, right = Tile(x[:30]), Tile(x[30:])
        exact = (left.vectors / left.norms[:, None]) @ (right.vectors / right.norms[:, None]).T
        estimate = vector_copies.code_products(left.codes, right.codes) * left.scales[:, None] * right.scales
        slack = left.errors[:, None] * (1 + right.errors) + right.errors + vector_copies.ROUNDING
        assert (np.abs(exact - estimate) <= slack).all()
        for least in (0.1, 0.5, 0.93):
            i, j = close_pairs(left, right, 0, 30, least, False)
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(exact >= least))))


def brute_negatives(rows, every=5, positives=5, negatives=5, percent=80):
    kept = {}
    for key, vector, label in rows:
        v = as_float(vector)
        if key is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        if key not in kept or (label, v) < kept[key]:
            kept[key] = (label, v)
    whole = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in kept.items()}
    result = set()
    for key, (label, v) in whole.items():
        if key % every or not v:
            continue
        scored = [
            (-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), other, g)
            for other, (g, w) in whole.items()
            if other != key and len(w) == len(v)
        ]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and percent * -score <= 100 * -s[0] <= 100 * -score]
            result |= {(key, positive, i + 1, s[1], -score, -s[0]) for i, s in enumerate(inside[:negatives])}
    return result


@pytest.mark.parametrize("values", [(1 << 17, 1 << 21), (40, 120)])
def test_hard_negatives_equal_brute_force(spark, values):
    rows = [r for r in vectors(12) if r[1] is None or 3e38 not in r[1]]
    got = hard_negatives(frame(spark, rows), lambda key: key % 5 == 0, tree_values=values[0], pass_values=values[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) > 50 and set(found) == brute_negatives(rows)


def test_hard_negatives_with_ties_huge_values_and_nothing(spark):
    rows = [(i, [1.0, float(i % 2)], i % 3) for i in range(40)]
    got = hard_negatives(frame(spark, rows), lambda key: key % 5 == 0)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows)
    rows = [(i, [3e30, float(i)], i % 2) for i in range(12)]
    assert {tuple(r) for r in hard_negatives(frame(spark, rows), lambda key: key % 5 == 0).collect()} == brute_negatives(rows)
    assert hard_negatives(frame(spark, []), lambda key: key % 5 == 0).count() == 0
    assert hard_negatives(frame(spark, [(5, None, 1), (None, [1.0], 1)]), lambda key: key % 5 == 0).count() == 0
    assert hard_negatives(frame(spark, [(5, [1.0], 1), (6, [1.0], 2)]), lambda key: key % 5 == 0).count() == 0


def test_tree_bounds_spare_scores_and_lose_none():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 4
    anchors = np.floor(256 * (centres[rng.integers(0, 20, 120)] + rng.normal(scale=0.05, size=(120, 16))))
    others = np.floor(256 * (centres[rng.integers(0, 20, 400)] + rng.normal(scale=0.05, size=(400, 16))))
    parents, edges, depths = spanning_tree(anchors)
    order = np.lexsort((np.arange(120), depths))
    place = np.argsort(order)
    bounds = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    tree = Tree(order, order % 3, anchors[order], np.where(parents[order] < 0, -1, place[parents[order]]), edges[order], bounds)
    exact = tree.vectors @ others.T
    low = np.sort(exact, axis=1)[:, -20].astype(np.int64)
    wanted = rng.random(exact.shape) < 0.9
    i, j, score, computed = scores_in_windows(tree, others, wanted, low, np.full(120, 2**62))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(wanted & (exact >= low[:, None])))))
    assert (score == exact[i, j]).all()
    assert computed < 0.6 * exact.size


def test_best_keeps_the_first_rows():
    best = Best(2)
    best.add(np.array([1, 1, 1, 0]), np.array([9, 5, 7, 3]), np.array([4, 4, 6, 1]))
    assert list(zip(best.keys, best.ids, best.scores)) == [(0, 3, 1), (1, 7, 6), (1, 5, 4)]
    assert best.least(np.array([-5, -5])).tolist() == [-5, 4]
