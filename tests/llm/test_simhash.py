from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from sensorloom.llm import simhash
from sensorloom.llm.words import flat_bytes, xxh64


def brute_print(text, n=3):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    n = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """Component id per row from all pairs."""
    prints = [brute_print(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return prints, [least.get(g) for g in group], group


def documents():
    random.seed(2)
    vocabulary = [f"Wört{i}" for i in range(400)] + ["x" * 50, "Über", "é"]
    rows = []
    for i in range(60):
        words = random.choices(vocabulary, k=random.choice([1, 2, 3, 40, 400]))
        rows.append((3 * i + 1, " ".join(words)))
        for k in range(random.choice([0, 0, 2])):
            near = list(words)
            near[random.randrange(len(near))] = "changed"
            rows.append((500 + 3 * i + k, "\n".join(near)))
    copies = [(1000 + i, rows[0][1]) for i in range(20)]
    edges = [(2000, None), (2001, ""), (2002, " \t\x0b"), (None, rows[5][1]), (None, "on its own and long enough to be"), (2003, "a"), (2003, "a"), (2003, "b c d e f")]
    return rows + copies + edges


def test_xxh64_equals_the_library():
    random.seed(1)
    parts = [bytes(random.randrange(256) for _ in range(n)) for n in [*range(0, 70), 200]]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    got = xxh64(data, ends - [len(p) for p in parts], ends, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_fingerprints_equal_brute_force():
    texts = [text or "" for _, text in documents()] + ["word " * 70_000, "A B c", "a b C"]
    for n in (3, 5):
        assert simhash.fingerprints(pa.array(texts), n).tolist() == [brute_print(t, n) for t in texts]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0
    sliced = pa.array(texts).slice(3, 5)
    assert flat_bytes(sliced)[0].tobytes() == "".join(texts[3:8]).encode()


def test_ring_test_loses_no_pair():
    random_bits = np.random.default_rng(3)
    points = [int(x) for x in random_bits.integers(0, 2**63, 40)]
    for point in points[:20]:
        for flips in (1, 2, 3, 4):
            places = random_bits.choice(64, flips, replace=False)
            points.append(point ^ sum(1 << int(p) for p in places))
    array = np.unique(np.array(points, dtype=np.uint64))
    i, j = simhash.ring_pairs(array)
    wanted = {(a, b) for a in range(len(array)) for b in range(a + 1, len(array)) if int(array[a] ^ array[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == wanted


def test_groups_equal_all_pairs(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints, components, _ = brute_groups(rows)
    got = simhash.near_duplicate_groups(docs).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = [(doc_id, p, c) for (doc_id, _), p, c in zip(rows, prints, components)]
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=order) == sorted(wanted, key=order)


def test_large_blocks_are_divided(spark):
    random_bits = np.random.default_rng(4)
    center = 0x0123456789ABCDEF
    near = {center ^ sum(1 << int(p) for p in random_bits.choice(64, k, replace=False)) for k in (1, 2, 5, 6) for _ in range(60)}
    points = np.array(sorted(near), dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in points], "fingerprint long")

    def groups(links):
        group = {p: p for p in points}
        for a, b in links:
            old, new = group[a], group[b]
            group = {p: new if g == old else g for p, g in group.items()}
        return {tuple(sorted(p for p in points if group[p] == g)) for g in set(group.values())}

    every = [(a, b) for a in points for b in points if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    for block_rows in (100, 4096):
        links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(table, block_rows).collect()]
        assert set(map(tuple, map(sorted, links))) <= {tuple(sorted(e)) for e in every}
        assert groups(links) == groups(every)


def test_one_of_each_group_stays(spark):
    rows = [(*row, "clash", 7) for row in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component int").repartition(4)
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    _, components, groups = brute_groups([r[:2] for r in rows])
    assert len(got) == len(set(groups))
    assert {r["doc_id"] for r in got} == set(components)
    assert simhash.keep_one_of_each_group(docs.limit(0)).count() == 0
