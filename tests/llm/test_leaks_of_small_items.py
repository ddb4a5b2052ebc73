from __future__ import annotations

import random

import pyarrow as pa

from sensorloom.llm.contamination import ItemIndex


def test_no_small_item_is_missed():
    random.seed(5)
    vocabulary = [f"k{i}" for i in range(5000)]
    items = [(i, " ".join(random.choices(vocabulary, k=1 + i % 12))) for i in range(6000)]
    # Repeated words make fewer distinct shingles than the item has places.
    items += [(6000 + i, "again " * (6 + i)) for i in range(5)]
    index = ItemIndex(items)
    texts = []
    for _, text in items:
        words = random.choices(vocabulary, k=60)
        words[30:30] = text.upper().split()
        texts.append(" ".join(words))
    found = {(row, index.ids[place]) for row, place, _ in index.matches(pa.array(texts))}
    assert [i for i, _ in items if (i, i) not in found] == []
