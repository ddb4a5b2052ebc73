"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and word beginnings, hashed into a fixed number of columns; each term counts once
per text. A score has a weight per term and, for every pair of terms, the product of their factor vectors, so
that words that are toxic only together are learnt, which additive weights cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.tables import quoted, with_text_columns
from sensorloom.llm.words import IS_SPACE, chunks, mark_words, segment_hashes, split_words
from sensorloom.sources.scratch import materialize

PREFIXES = (4, 5)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the machine is fitted on."""

    bits: int = 18
    factors: int = 4
    sample: int = 30_000
    least_texts: int = 5
    toxic_weight: float = 2.0
    epochs: int = 8
    rate: float = 0.05
    penalty: float = 1e-3
    seed: int = 7


def terms(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, as columns and their bounds per text.

    Words are lower-cased (A-Z) and lose punctuation at their ends. Terms are the words and their first four and six
    bytes, each kind with a hash of its own.
    """
    words = split_words(texts)
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        inner = ends - starts > 1
        ends -= inner & _PUNCTUATION[words.data[ends - 1]]
        inner = ends - starts > 1
        starts += inner & _PUNCTUATION[words.data[np.minimum(starts, len(words.data) - 1)]]
    row = words.text_of_word().astype(np.uint64) << np.uint64(32)
    shift = np.uint64(64 - bits)
    keys = [row | segment_hashes(words.data, starts, ends) >> shift]
    for n, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > size)
        cut = segment_hashes(words.data, starts[long], starts[long] + size)
        keys.append(row[long] | (cut * np.uint64(2 * n + 1)) >> shift)
    keys = np.unique(np.concatenate(keys))
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), bounds


@dataclass
class Machine:
    """A fitted machine; its size is fixed by ``bits`` and ``factors``."""

    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of toxicity for each text; a text without terms has the bias alone."""
        result = np.full(len(texts), self.bias)
        for start, stop in chunks(texts):
            columns, bounds = terms(texts.slice(start, stop - start), self.bits)
            linear = np.concatenate(([0.0], np.cumsum(self.weights[columns])))
            vectors = self.factors[columns]
            summed = np.concatenate((np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)))
            squares = np.concatenate(([0.0], np.cumsum((vectors * vectors).sum(axis=1))))
            between = lambda total: total[bounds[1:]] - total[bounds[:-1]]
            pairs = 0.5 * ((between(summed) ** 2).sum(axis=1) - between(squares))
            result[start:stop] += between(linear) + pairs
        return 1.0 / (1.0 + np.exp(-np.clip(result, -30.0, 30.0)))


def fit(rows: list[tuple[np.ndarray, int]], settings: Settings) -> Machine:
    """Adaptive gradient descent on the log loss, over rows of distinct terms and a label of 0 or 1.

    Terms in fewer than ``least_texts`` rows are left out: they would be learnt by heart.
    """
    random = np.random.default_rng(settings.seed)
    size = 1 << settings.bits
    weights = np.zeros(size)
    factors = random.normal(0.0, 0.01, (size, settings.factors))
    weight_sum, factor_sum = np.full(size, 1e-2), np.full((size, settings.factors), 1e-2)
    positive = sum(label for _, label in rows)
    share = min(max(positive / max(len(rows), 1), 1e-3), 1 - 1e-3)
    seen = np.zeros(size, dtype=np.int64)
    for columns, _ in rows:
        seen[columns] += 1
    usual = seen >= settings.least_texts
    factors[~usual] = 0.0
    rows = [(columns[usual[columns]], label) for columns, label in rows]
    bias, bias_sum = float(np.log(share / (1 - share))), 1.0
    if 0 < positive < len(rows):
        order = np.arange(len(rows))
        for _ in range(settings.epochs):
            random.shuffle(order)
            for i in order.tolist():
                columns, label = rows[i]
                if not len(columns):
                    continue
                v = factors[columns]
                summed = v.sum(axis=0)
                value = bias + weights[columns].sum() + 0.5 * ((summed**2).sum() - (v * v).sum())
                error = 1.0 / (1.0 + np.exp(-min(max(value, -30.0), 30.0))) - label
                if abs(error) < 1e-3:
                    continue
                error *= settings.toxic_weight if label else 1.0
                gradient = error + settings.penalty * weights[columns]
                weight_sum[columns] += gradient * gradient
                weights[columns] -= settings.rate * gradient / np.sqrt(weight_sum[columns])
                gradient = error * (summed - v) + settings.penalty * v
                factor_sum[columns] += gradient * gradient
                factors[columns] = v - 0.1 * settings.rate * gradient / np.sqrt(factor_sum[columns])
                bias_sum += error * error
                bias -= settings.rate * error / np.sqrt(bias_sum)
    return Machine(settings.bits, float(bias), weights.astype(np.float32), factors.astype(np.float32))


def _labelled_terms(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, labels, texts = batch.columns
            parts = []
            for start, stop in chunks(texts):
                columns, bounds = terms(texts.slice(start, stop - start), settings.bits)
                parts += [columns[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [order, labels, pa.array(parts, pa.binary())], names=["place", "label", "columns"]
            )

    return run


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    settings: Settings = Settings(),
) -> Machine:
    """A machine from the rows of ``docs`` that ``learnable`` selects and that have a 0 or 1 in ``labels``.

    At most ``settings.sample`` labelled rows are used: the ones whose hashed id is smallest, so that the sample does
    not depend on the partitions, and toxic rows are at least half of it if there are as many. Terms of
    too few sampled texts get no weight. No rows, or one class alone, give the bias of that class. Of labels of one id that
    disagree the larger counts.
    """
    known = labels.where(F.col(quoted(label)).isin(0, 1)).groupBy(F.col(quoted(doc_id)).alias("id")).agg(
        F.max(quoted(label)).cast("int").alias("label")
    )
    ids = docs.where(learnable & F.col(quoted(doc_id)).isNotNull()).select(F.col(quoted(doc_id)).alias("id"))
    order = F.xxhash64("id", F.lit(settings.seed))
    chosen = ids.join(known, "id").distinct().select("id", "label", order.alias("place"))
    half = settings.sample // 2
    toxic = chosen.where("label = 1").orderBy("place").limit(half)
    clean = chosen.where("label = 0").orderBy("place").limit(settings.sample - half)
    sample = materialize(toxic.unionByName(clean), "labelled")
    texts = (
        docs.select(F.col(quoted(doc_id)).alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "id")
        .select("place", "label", "text")
    )
    rows = texts.mapInArrow(_labelled_terms(settings), "place long, label int, columns binary")
    found = []
    for row in sorted(rows.collect(), key=lambda r: (r["place"], bytes(r["columns"]))):
        found.append((np.frombuffer(row["columns"], dtype="<i4"), row["label"]))
    return fit(found, settings)


def score_toxicity(docs: DataFrame, machine: Machine, score: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability of toxicity of the whole text; null and empty texts are scored too."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    field = T.StructField(score, T.DoubleType(), False)
    return with_text_columns(docs, text, [field], lambda texts: [pa.array(model.value.scores(texts), pa.float64())])
