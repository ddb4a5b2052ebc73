from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sensorloom.llm import byte_bpe, packing


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.BpeEncoder(byte_bpe.vocabulary_path())


def brute_ids(texts):
    loaded = byte_bpe.tokenizer(f"{byte_bpe.vocabulary_path()}.json")
    return [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers(encoder):
    random.seed(3)
    parts = ["a", "bc", "é", "ß", "1", "23", " ", "  ", "   ", "\n", "\n\n", "\t", ".", "!?", "Ärger", "the "]
    odd = parts + ["'", "'s", "don't", "×", "÷", "€", "你好", " ", "\x1c", "<|endoftext|>", "٣", "½", "\r\n", "_"]
    texts = ["", *("".join(random.choices(parts if i % 2 else odd, k=random.randint(0, 14))) for i in range(2000))]
    for _ in range(2):  # the second time all pieces are known
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == brute_ids(texts)


def test_pieces(spark):
    texts = [None, "", "one two", "word " * 3000, "x " * 1023, "x " * 1022 + "x", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = []
    for doc_id, ids in enumerate(brute_ids([t or "" for t in texts])):
        ids = ids + [2]
        cut, start, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while start < len(ids):
            raw = np.array(ids[start:cut], dtype="<u4").tobytes()
            wanted.append((doc_id, piece, start, cut - start, zlib.crc32(raw)))
            start, cut, piece = cut, cut + 1024, piece + 1
    assert sorted(map(tuple, packing.token_pieces(docs).collect())) == wanted


def filled(plan, counts):
    """Sequences as lists of (offset, length) from the plan's slots."""
    sequences = defaultdict(list)
    for length, slots in plan.slots.items():
        bounds = [s[0] for s in slots[1:]] + [counts[length]]
        for (first, sequence, offset), last in zip(slots, bounds):
            for rank in range(first, last):
                sequences[sequence + rank - first].append((offset, length))
    return sequences


def check(counts, capacity=1024):
    plan = packing.plan_packing(counts, capacity)
    sequences = filled(plan, counts)
    assert Counter(n for s in sequences.values() for _, n in s) == Counter({k: v for k, v in counts.items() if v})
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert set(sequences) == set(range(plan.sequences))
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_tight(seed):
    random.seed(seed)
    counts = Counter(min(1024, int(random.lognormvariate(5, 1.2)) + 1) for _ in range(5000))
    used = check(counts)
    total = sum(k * v for k, v in counts.items())
    large = sum(v for k, v in counts.items() if 2 * k > 1024)
    assert used <= max(-(-total // 1024), large) * 1.02 + 1


def test_plan_of_few_pieces():
    assert check({}) == 0
    assert check({1024: 3}) == 3
    assert check({512: 4}) == 2
    assert check({600: 2, 400: 1, 24: 3}) == 2
    assert check({341: 7}) == 3
    assert check({1: 10_000}) == 10
    assert check({700: 1, 350: 2, 300: 2}) == 2


def test_packed_documents(spark):
    random.seed(9)
    rows = [(i if i % 9 else None, "w " * random.choice([1, 5, 100, 340, 341, 700, 1500]), "k") for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[3], (5, None, "k")], "doc_id long, text string, length string").repartition(4)
    packed = packing.pack_documents(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == Counter(
        (r["doc_id"], r["piece"], r["length"]) for r in packing.token_pieces(docs).collect()
    )
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0
