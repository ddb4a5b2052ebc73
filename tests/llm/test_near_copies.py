from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from sensorloom.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def documents():
    """Texts with more and more words replaced, texts of common phrases, short and empty ones, exact copies."""
    random.seed(21)
    vocabulary = [f"n{i}" for i in range(3000)]
    phrases = [random.choices(vocabulary, k=12) for _ in range(6)]
    texts = []
    for i in range(30):
        words = random.choices(vocabulary, k=random.choice([6, 9, 60, 150, 300]))
        texts.append(words)
        for _ in range(4):
            words = list(words)
            for place in random.sample(range(len(words)), random.choice([1, 1, len(words) // 50, len(words) // 40])):
                words[place] = f"new{random.random()}"
            texts.append(words)
    texts += [random.choice(phrases) + random.choice(phrases) + random.choices(vocabulary, k=k) for k in [3, 5, 9] * 20]
    texts += [["a", "b"], ["A", "b"], ["b", "a"], [], ["a"] * 40, ["a"] * 90] + texts[:20]
    random.shuffle(texts)
    return [(i, " ".join(words)) for i, words in enumerate(texts)]


def brute_groups(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 10 * shared >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in group]


def test_stage_joins_every_pair_of_the_least_similarity(spark):
    rows = documents()
    wanted = brute_groups(rows)
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(wanted)
    # Three words and three bits, the rule of op3, leave many of these pairs apart.
    assert len(got) < simhash.keep_one_of_each_group(docs).count()


def groups_of(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs, shingle=5, least_percent=80).collect()}


def around_the_threshold(n, changed, length=200, seed=4):
    """Variants of one text, with so many words replaced in each that most pairs are near the least similarity."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for place in rng.sample(range(length), changed):
            words[place] = f"v{i}x{place}"
        rows.append((i, " ".join(words)))
    return rows


def one_shared_passage(n, seed=5):
    """Texts of 170 words that share 150: no two are similar enough."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(150)]
    return [(i, " ".join(passage + [f"o{i}x{rng.random()}" for _ in range(20)])) for i in range(n)]


def recall(rows, got):
    """Of the pairs that brute force puts in one group, the share that is in one group here; and there are no others."""
    wanted = brute_groups(rows)
    apart = {}
    for (key, _), group in zip(rows, wanted):
        apart.setdefault(group, []).append(got[key])
    assert all(got[k] in (r[0] for r in rows) for k, _ in rows)
    owners = {}
    for group, parts in apart.items():
        for part in set(parts):
            assert owners.setdefault(part, group) == group
    pairs = sum(len(p) * (len(p) - 1) for p in apart.values())
    held = sum(p.count(x) * (p.count(x) - 1) for p in apart.values() for x in set(p))
    return held / pairs if pairs else 1.0


@pytest.mark.parametrize("changed", [1, 2, 3])
def test_recall_of_groups_around_the_threshold(spark, changed):
    rows = around_the_threshold(150, changed)
    assert recall(rows, groups_of(spark, rows)) >= (1.0 if changed < 3 else 0.9)


@pytest.mark.parametrize("made", [lambda n: around_the_threshold(n, 3), one_shared_passage])
def test_candidates_grow_with_the_texts(spark, monkeypatch, made):
    counts = []
    compare = near_copies.similar_pairs

    def counted(pairs, *rest):
        counts[-1] += pairs.count()
        return compare(pairs, *rest)

    monkeypatch.setattr(near_copies, "similar_pairs", counted)
    for n in (400, 800):
        counts.append(0)
        groups_of(spark, made(n))
    assert counts[1] <= 2.6 * counts[0] + 1000, counts
    assert counts[1] < 150 * 800 < 800 * 799 / 2


def test_nulls_long_texts_and_large_groups(spark):
    rng = random.Random(8)
    long = [f"l{i}" for i in range(30_000)]
    changed = list(long)
    for place in range(0, 30_000, 100):
        changed[place] = f"c{place}"
    base = [f"g{i}" for i in range(60)]
    rows = [(1, " ".join(long)), (2, " ".join(changed)), (3, None), (4, ""), (5, "one two"), (6, "ONE  two"), (None, " ".join(long))]
    rows += [(100 + i, " ".join(base[: 59 - i % 3])) for i in range(500)]
    rows += [(700 + i, " ".join(rng.choices(base, k=60))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs, shingle=5, least_percent=80).collect()}
    assert got[2] == got[1] == got[None] == 1 and got[4] == got[3] == 3 and got[6] == got[5] == 5
    assert {got[100 + i] for i in range(500)} == {100}
    kept = simhash.keep_one_of_each_group(docs, shingle=5, least_percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.near_duplicate_groups(docs.limit(0), shingle=5, least_percent=80).count() == 0


def test_long_bands_are_worked_off_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HELD_ROWS", 4)
    rows = around_the_threshold(150, 1)
    assert recall(rows, groups_of(spark, rows)) == 1.0


def test_signatures_refuse_no_similar_pair():
    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 300, 4000):
        for changed in {0, 1, size // 12, size // 9, size // 8}:
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            other = np.concatenate((base[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)))
            left, right = (np.frombuffer(near_copies.signature(x), dtype=np.uint64)[None] for x in (base, other))
            allowed = near_copies.may_be_similar(left, right, np.array([2 * size]), 80)[0]
            assert allowed or 10 * (size - changed) < 8 * (size + changed)
    far = [np.frombuffer(near_copies.signature(rng.integers(0, 1 << 63, 300, dtype=np.uint64)), dtype=np.uint64)[None] for _ in "ab"]
    assert not near_copies.may_be_similar(*far, np.array([600]), 80)[0]


def test_whole_sets_travel_only_for_pairs_that_may_be_similar(spark, monkeypatch):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(130)]
    rows = [(i, " ".join(passage + [f"o{i}x{rng.random()}" for _ in range(40)])) for i in range(300)]
    compared = []
    compare = near_copies.similar_pairs

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(near_copies, "similar_pairs", counted)
    assert len(set(groups_of(spark, rows).values())) == 300
    assert sum(compared) < 300, compared


def test_joins_between_rounds_see_a_node_once(spark):
    """A node in twenty bands is one row of both joins, and repeated rows of a band count once."""
    rows = [(band, node, 7) for node in (1, 2, 3) for band in range(20)] + [(0, 1, 7), (19, 3, 7)]
    table = spark.createDataFrame(rows, "key long, node long, size long")
    components = spark.createDataFrame([(2, 1), (1, 1)], "node long, component long")
    signs = spark.createDataFrame([(n, 7, bytes([n])) for n in (1, 2, 3, 4)], "node long, size long, sign binary")
    made = near_copies.open_bands(table, components, signs)
    got = [(r["key"], r["node"], r["size"], r["component"], bytes(r["sign"])) for r in made.collect()]
    of = {1: 1, 2: 1, 3: 3}
    assert sorted(got) == [(band, n, 7, of[n], bytes([n])) for band in range(20) for n in (1, 2, 3)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")
