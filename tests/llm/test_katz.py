from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import katz

def learnable():
    return F.crc32(F.col("doc_id").cast("string")) % 10 != 0


def tokens(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["</end>"]


class BruteForce:
    """The model from plain dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), Counter()
        self.followers = defaultdict(set)
        for text in texts:
            before = "<begin>"
            for word in tokens(text):
                self.words[word] += 1
                self.pairs[before, word] += 1
                self.after[before] += 1
                self.followers[before].add(word)
                before = word
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.kept_words, self.kept_pairs = self.discounts(self.words), self.discounts(self.pairs)
        lost = sum((1 - self.kept_words(c)) * c for c in self.words.values())
        self.unknown = lost / self.n if self.n else 1.0
        self.weights = {}

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        common = 6 * n[6] / n[1] if n[1] else 1.0

        def kept(r):
            if r > 5:
                return 1 - 0.01 / r
            if n[r] and common != 1.0:
                value = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                if 1e-6 < value < 1 - 1e-6:
                    return value
            return (r - 0.5) / r

        return kept

    def single(self, word):
        count = self.words[word]
        return self.kept_words(count) * count / self.n if count else self.unknown

    def __call__(self, before, word):
        count = self.pairs[before, word]
        if count:
            return self.kept_pairs(count) * count / self.after[before]
        if not self.after[before]:
            return self.single(word)
        if before not in self.weights:
            seen = self.followers[before]
            left = 1 - sum(self(before, w) for w in seen)
            self.weights[before] = left / (1 - sum(self.single(w) for w in seen))
        return self.weights[before] * self.single(word)

    def row(self, text):
        score = base = known = 0
        before = "<begin>"
        for word in tokens(text):
            score += math.log10(self(before, word))
            base += math.log10((self.words[word] + 0.1) / (self.n + 0.1 * (self.v + 1)))
            known += self.words[word] > 0
            before = word
        return len(tokens(text)), known, base, score


def corpus(size=300):
    random.seed(5)
    words = ["the", "of", "And", "a", "Ünd", "x", "y"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(random.choices(words, weights=range(len(words), 0, -1), k=random.randint(0, 40))) for _ in range(size)]
    return texts + [None, "", " \t\n", "only once seen here", texts[3], texts[3], "w1 " * 500]


@pytest.mark.parametrize(("chunk", "part"), [(150, 500), (4_000_000, 8_000_000)])
def test_scores_equal_brute_force(spark, chunk, part):
    texts = corpus()
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10]
    model = BruteForce(train)
    got = sorted(katz.score_texts(docs, learnable(), chunk_tokens=chunk, part_bytes=part).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    by_id = dict(enumerate(texts))
    for row in got:
        n, known, base, score = model.row(by_id[row["doc_id"]])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, model.n)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 10 == 0)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and math.isclose(row["score"], score, rel_tol=1e-9)


def test_every_history_sums_to_one():
    model = BruteForce(corpus())
    for before in [*list(model.after)[:20], "never seen"]:
        total = sum(model(before, w) for w in model.words) + model(before, "an unknown word")
        assert math.isclose(total, 1.0, rel_tol=1e-9)
        assert model(before, "an unknown word") > 0


def test_no_rows_no_training_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert katz.score_texts(spark.createDataFrame([], schema), learnable()).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (None, None)], schema)
    rows = katz.score_texts(docs, F.lit(False)).collect()
    assert [(r["train_tokens"], r["n_known"], r["held_out"]) for r in rows] == [(0, 0, True)] * 2
    assert all(r["score"] == 0.0 for r in rows)  # the unknown word is the only outcome
    rows = katz.score_texts(docs, learnable()).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {1: False, None: True}


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) << np.uint64(1))
    for size in (0, 1, 2, 1000):
        assert (katz.unpack_sorted(katz.pack_sorted(keys[:size])) == keys[:size]).all()
    for counts in ([], [0, 255], [256], [70_000], [2**33]):
        assert katz.unpack_counts(katz.pack_counts(np.array(counts, dtype=np.int64))).tolist() == counts
