"""The pipeline on a small corpus against plain Python, stage by stage."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from test_packing import brute_ids
from test_near_copies import shingles

import corpus_pipeline
from sensorloom.llm import contamination

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, text(20)) for i in range(6)]
    rows = []
    for i in range(150):
        lines = [text(random.choice([8, 15])) for _ in range(random.choice([2, 6, 12]))]
        if i % 5 == 0:
            lines.insert(1, " Subscribe to the site ")
        if i % 11 == 0:
            lines.append(items[i % 6][1].upper())
        if i % 13 == 0:
            lines = ["again and again " * 40]
        rows.append([i, "\n".join(lines)])
    for i in range(150, 190):
        rows.append([i, rows[random.choice([1, 2, 3, 50])][1] + random.choice(["", "", " end"])])
    rows += [[190, None], [191, ""], [None, text(80)], [192, rows[7][1]], [192, rows[7][1]]]
    return [(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in rows], items


def good(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def brute_force(rows, items):
    kept = [r for r in rows if good(r[1])]
    yield kept
    texts = {(r[3], r[1]) for r in kept}
    pages, on = Counter(source for source, _ in texts), Counter()
    for source, text in texts:
        on.update({(source, line.strip(" ")) for line in text.split("\n") if line.strip(" ")})
    cleaned = []
    for d, t, lang, source, _ in kept:
        t = "\n".join(
            line for line in t.split("\n")
            if not (on[source, line.strip(" ")] >= 5 and on[source, line.strip(" ")] > 0.1 * pages[source])
        )
        cleaned.append((d, t, lang, source, len(t)))
    yield cleaned
    sets = [shingles(r[1]) for r in cleaned]
    group = list(range(len(cleaned)))
    for i, j in itertools.combinations(range(len(cleaned)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = sorted((group[i], group[j]), reverse=True)
            group = [new if g == old else g for g in group]
    unique = {}
    for row, g in zip(cleaned, group):
        kept_row = unique.setdefault(g, row)
        if row[0] is not None and (kept_row[0] is None or row[0] < kept_row[0]):
            unique[g] = row
    unique = list(unique.values())
    yield unique
    own = [contamination._shingles(t, 5) for _, t in items]
    clean = [r for r in unique if not any(len(i & contamination._shingles(r[1], 5)) >= 0.8 * len(i) for i in own)]
    yield clean
    yield Counter(
        (r[0], -(-(len(ids) + 1) // 1024)) for r, ids in zip(clean, brute_ids([r[1] for r in clean]))
    )


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = list(brute_force(*corpus()))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_removal", "near_duplicates", "decontamination", "best_fit_packing"
    ]
    sizes = []
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (_, stage), wanted in zip(corpus_pipeline.STAGES[:-1], expected):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert sorted(got, key=key) == sorted(wanted, key=key)
        sizes.append(len(got))
        docs = spark.createDataFrame(got, docs.schema)
    assert sizes[0] == sizes[1] and sizes[1] > sizes[2] > sizes[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter((r["doc_id"]) for r in pieces) == Counter(
        {d: n for (d, n), times in expected[-1].items() for _ in range(times)}
    )


def test_run_gives_the_last_stage(spark, folder):
    *_, wanted = brute_force(*corpus())
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"]) for r in rows} == {d for d, _ in wanted}
    at = {}
    for sequence, offset, length in sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows):
        assert at.get(sequence, 0) == offset
        at[sequence] = offset + length
    assert max(at.values()) <= 1024


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
