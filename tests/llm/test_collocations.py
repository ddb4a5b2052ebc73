from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from sensorloom.llm import collocations
from sensorloom.llm.collocations import Index, Shard, extended, frequent_phrases, runs
from sensorloom.sources.scratch import _PATHS, materialize

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int, id long"


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, least, top=2000, longest=4, covered=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for (lang, *words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, *words[i : i + k])
                inside[part] = max(inside[part], a)
    found = {}
    for (lang, *words), a in candidates.items():
        if 100 * inside[(lang, *words)] >= covered * a:
            continue
        score, cut, left, right = min(
            (2_000_000 * a // (counts[(lang, *words[:k])] + counts[(lang, *words[k:])]), k, counts[(lang, *words[:k])], counts[(lang, *words[k:])])
            for k in range(1, len(words))
        )
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, listed in found.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top])
    }


def corpus(seed=5):
    random.seed(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "Ab", "ab", "日本"]
    fixed = ["new york city", "New York", "a a a a a", "one two three four five", "the quick brown fox"]
    rows = []
    for _ in range(500):
        parts = [random.choice(fixed) if random.random() < 0.3 else random.choice(words) for _ in range(random.randint(0, 30))]
        text = "".join(p + random.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", " \x0b"]) for p in parts)
        rows.append((text, random.choice(["en", "en", "en", "fr", None, "und", ""])))
    rows += rows[:40] + [(None, "en"), ("", "fr"), ("   ", None), ("...", "en"), ("x " * 3000, "long"), ("y z y z " * 40, "en")]
    return rows


def as_frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, g, "clash", 7, 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)


def listed(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def test_equals_brute_force_over_many_shards(spark):
    rows = corpus()
    wanted = brute(rows, 6)
    assert len(wanted) > 60 and {len(w[2].split(" ")) for w in wanted} == {2, 3, 4}
    for shard_bytes, parts in ((1 << 24, 3), (2_000, 5)):
        got = collocations.collocations(as_frame(spark, rows, parts), least=6, shard_bytes=shard_bytes)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert listed(got) == wanted


def test_first_of_each_language_and_shorter_phrases(spark):
    rows = corpus(6)
    docs = as_frame(spark, rows, 3)
    assert listed(collocations.collocations(docs, least=6, top=5)) == brute(rows, 6, top=5)
    assert listed(collocations.collocations(docs, least=6, longest=3)) == brute(rows, 6, longest=3)


def test_empty_and_rare(spark):
    empty = as_frame(spark, [], 1)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(as_frame(spark, [(None, None), ("a b c", "en")], 2)).count() == 0


def test_scores_do_not_overflow(spark):
    from pyspark.sql import functions as F

    counts = spark.createDataFrame([(2**62 + 1, 2**62 + 3, 2**62 + 5), (3, 4, 5)], "a long, l long, r long")
    got = [r[0] for r in counts.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [2_000_000 * (2**62 + 1) // (2**63 + 8), 2_000_000 * 3 // 9]


def test_intervals_hold_exactly_the_occurrences():
    random.seed(3)
    ids = np.array([random.choice([0, 1, 2, 3, 3]) for _ in range(400)] + [0], dtype=np.int32)
    shard = Shard(ids)
    for length in (1, 2, 3, 4):
        wanted = Counter(
            tuple(ids[i : i + length]) for i in range(len(ids) - length + 1) if (ids[i : i + length] > 0).all()
        )
        starts, sizes = shard.phrases(length)
        got = {}
        for start, size in zip(starts, sizes):
            places, _ = shard.places(np.array([start]), np.array([size]))
            assert len({tuple(ids[p : p + length]) for p in places}) == 1
            got[tuple(ids[places[0] : places[0] + length])] = size
        assert got == wanted


def test_both_directions_agree():
    random.seed(4)
    ids = np.array([random.choice([0, 1, 2, 3]) for _ in range(300)] + [0], dtype=np.int32)
    shard = Shard(ids)
    left, right, sizes = shard.words()
    _, mirrored, counts = extended(shard.leftward, left, right, sizes)
    for start, size in zip(mirrored, counts):
        places = shard.rightward.suffixes[start : start + size]
        pairs = {tuple(ids[::-1][p : p + 2]) for p in places}
        assert len(pairs) == 1


def test_runs_keep_marked_phrases_only():
    ids = np.array([1, 2, 3, 4, 0, 5, 6, 0], dtype=np.int32)
    kept, marks = runs(ids, np.array([7, 8, 0, 0, 0, 9, 0, 0]), 2)
    assert kept.tolist() == [1, 2, 3, 0, 5, 6, 0]
    assert marks.tolist() == [7, 8, 0, 0, 9, 0, 0]


def test_words_and_totals(spark):
    rows = corpus(8)
    levels, totals = frequent_phrases(as_frame(spark, rows, 4), least=3)
    words = Counter(("und" if g is None else g, w) for t, g in rows for p in pieces(t) for w in p)
    assert {(r["lang"], r["phrase"]): r["total"] for r in levels[0].collect()} == {k: v for k, v in words.items() if v >= 3}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {
        g: sum(v for (h, _), v in words.items() if h == g) for g in {g for g, _ in words}
    }
    assert isinstance(Index(np.zeros(0, dtype=np.int32)).suffixes, np.ndarray)


def test_phrases_travel_packed_and_tables_go_once_read(spark, monkeypatch):
    """A shard's phrases are one row per range of hashes, and only what levels are made of stays on disk."""
    made = {}

    def recorded(df, name):
        table = materialize(df, name)
        made[name] = (table, table.count())
        return table

    monkeypatch.setattr(collocations, "materialize", recorded)
    frequent_phrases(as_frame(spark, corpus(7), 3), least=3, shard_bytes=4_000)
    shards = made["word-shards"][1] // 2  # its own row and one range
    assert shards > 5
    for length in (2, 3, 4):
        assert 0 < made[f"phrases-{length}"][1] <= 2 * shards
        assert 0 < made[f"frequent-{length}"][1] <= shards + 1
    kept = {name for name, (table, _) in made.items() if table in _PATHS}
    assert kept == {"language-totals", "named-1", "named-2", "named-3", "named-4"}


def test_packed_longs_come_back():
    for values in ([], [0], [-1, 1 << 58, 7, -(1 << 40)]):
        assert collocations._long_unblob(collocations._long_blob(np.array(values, dtype=np.int64))).tolist() == values
