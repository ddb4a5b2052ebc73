"""Katz backoff language model of words: Good-Turing discounts, exactly normalised backoff weights.

Words and word pairs are 64- and 56-bit hashes. Every task reads a chunk of documents, sends each distinct word and pair
of it once, with its training count, to the part of the key range it belongs to, and gets the corpus counts back in
the order sent. No key is hot, however common: it is one entry per chunk. A history's backoff weight is the sum
of what the chunks know about it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.tables import join_sized, quoted
from sensorloom.llm.words import chunks, mixed, split_words, word_hashes
from sensorloom.sources.scratch import materialize, new_path

CHUNK_TOKENS = 1_500_000
PART_BYTES = 8_000_000
RELIABLE = 5
KEPT_BACK = 0.01
DOCUMENT, WORDS, PAIRS, TOTALS = range(4)
END = np.uint64(0x5EED0000000000E1)
BEGIN = np.uint64(0x5EED0000000000B1)


# Packing


def pack_sorted(keys: np.ndarray) -> bytes:
    """Distinct sorted 64-bit keys as differences of as few bytes as the largest needs, low bytes of all first."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    low = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + low.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, dtype=np.uint64)
    width = packed[0]
    low = np.frombuffer(packed, dtype=np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((low.shape[1] + 1, 8), dtype=np.uint8)
    steps[1:, :width] = low.T
    steps = steps.view("<u8")[:, 0]
    steps[0] = int.from_bytes(packed[1:9], "little")
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    for kind in ("<u1", "<u2", "<u4", "<u8"):
        if not len(counts) or counts.max() <= np.iinfo(kind).max:
            return kind[-1].encode() + counts.astype(kind).tobytes()
    raise AssertionError


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[:1].decode()}", offset=1).astype(np.int64)


def parts_of(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The part of each key when the key range is cut into equal parts; it grows with the key."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


# The sequence of a chunk: word places, with a begin before and an end after each document


def _pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * np.uint64(0xD6E8FEB86659FD93) + word) >> np.uint64(8)


class _Chunk:
    """Documents until there are enough tokens; then the messages of the chunk."""

    def __init__(self, number: int, parts: int):
        self.number, self.parts, self.tokens = number, parts, 0
        self.ids, self.train, self.hashes = [], [], []

    def add(self, ids: pa.Array, train: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
        self.ids.append(ids)
        self.train.append(train)
        self.hashes += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        self.tokens += len(hashes) + len(train)

    def messages(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.hashes:
            return
        train = np.concatenate(self.train)
        sequence = np.concatenate([part for h in self.hashes for part in (h, END[None])])
        sizes = np.fromiter(map(len, self.hashes), np.int64, len(self.hashes)) + 1
        of = np.repeat(np.arange(len(sizes)), sizes)
        trained = train[of]
        ends = np.cumsum(sizes)
        words, where = np.unique(np.append(sequence, BEGIN), return_inverse=True)
        counts = np.bincount(where[:-1][trained], minlength=len(words))
        counts[where[-1]] += int(train.sum())
        history = np.empty_like(sequence)
        history[1:] = sequence[:-1]
        history[ends - sizes] = BEGIN
        keys = _pair_keys(history, sequence)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        pair_counts = np.add.reduceat(trained[order].astype(np.int64), starts)
        # Frequent words get small numbers, which pack well.
        by_count = np.argsort(-np.bincount(where[:-1], minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[by_count] = np.arange(len(words), dtype=np.uint32)
        places = rank[where[:-1]]
        for low in range(0, len(sizes), 2000):
            high = min(low + 2000, len(sizes))
            packed = [
                zlib.compress(np.ascontiguousarray(places[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T), 1)
                for a, b in zip((ends - sizes)[low:high], ends[low:high])
            ]
            yield self._rows(
                kind, DOCUMENT, np.full(high - low, self.number % self.parts),
                pa.concat_arrays(self.ids).slice(low, high - low), np.arange(low, high), train[low:high], packed,
            )
        ranks = zlib.compress(by_count.astype("<u4").tobytes(), 1)
        for message, sorted_keys, sums, bits in (
            (WORDS, words, counts, 64), (PAIRS, ranked[starts], pair_counts, 56)
        ):
            part = parts_of(sorted_keys, self.parts, bits)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            yield self._rows(
                kind, message, part[cuts[:-1]], pa.nulls(len(cuts) - 1, kind), np.arange(len(cuts) - 1), None,
                [pack_sorted(sorted_keys[a:b]) for a, b in zip(cuts, cuts[1:])],
                [pack_counts(sums[a:b]) for a, b in zip(cuts, cuts[1:])],
            )
        yield self._rows(
            kind, TOTALS, np.array([self.number % self.parts]), pa.nulls(1, kind), np.array([0]), None, [ranks]
        )

    def _rows(self, kind, message, part, ids, place, train, data, counts=None) -> pa.RecordBatch:
        n = len(part)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, message), pa.int32()), pa.array(part.astype(np.int64), pa.int64()),
                pa.array(np.full(n, self.number), pa.int64()), pa.array(place, pa.int64()), ids.cast(kind),
                pa.array(train, pa.bool_()) if train is not None else pa.nulls(n, pa.bool_()),
                pa.array(data, pa.binary()), pa.array(counts, pa.binary()) if counts else pa.nulls(n, pa.binary()),
            ],
            names=_MESSAGE,
        )


_MESSAGE = ["message", "part", "chunk", "place", "doc_id", "train", "data", "counts"]


def _message_schema(id_type: T.DataType) -> T.StructType:
    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), id_type, T.BooleanType(), T.BinaryType(), T.BinaryType())
    return T.StructType([T.StructField(n, k) for n, k in zip(_MESSAGE, kinds)])


def _send(parts: int, chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_number = TaskContext.get().partitionId() << 24
        number, chunk = first_number, _Chunk(first_number, parts)
        for batch in batches:
            ids, train, texts = batch.columns
            train = train.to_numpy(zero_copy_only=False).astype(bool)
            for start, stop in chunks(texts):
                words = split_words(texts.slice(start, stop - start))
                chunk.add(ids.slice(start, stop - start), train[start:stop], word_hashes(words), words.first)
                if chunk.tokens >= chunk_tokens:
                    yield from chunk.messages(ids.type)
                    number += 1
                    chunk = _Chunk(number, parts)
        if chunk.ids:
            yield from chunk.messages(chunk.ids[0].type)

    return run


# Counting: one part of the key range at a time


_COUNTED = [*_MESSAGE, "seen", "ones"]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by message, part and chunk -> answers, documents as they came, and one totals row per part.

    A totals row has the part's table of keys and counts, its token count and how many keys have counts 1 to 6.
    """
    held: list[tuple] = []
    current = None
    for batch in batches:
        messages, part_numbers = batch.column("message").to_numpy(), batch.column("part").to_numpy()
        changed = (messages[1:] != messages[:-1]) | (part_numbers[1:] != part_numbers[:-1])
        cuts = np.flatnonzero(np.concatenate(([True], changed, [True]))) if batch.num_rows else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            rows = batch.slice(low, high - low)
            this = (int(messages[low]), int(part_numbers[low]))
            if this != current:
                yield from _merged(current, held)
                held, current = [], this
            if this[0] in (WORDS, PAIRS):
                for data, counts, row in zip(rows.column("data"), rows.column("counts"), range(high - low)):
                    held.append((data.as_py(), counts.as_py(), rows.slice(row, 1)))
            else:
                none = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *none], names=_COUNTED)
    yield from _merged(current, held)


def _merged(current, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    message, part = current
    lists = [unpack_sorted(data) for data, _, _ in held]
    keys = np.unique(np.concatenate(lists))
    totals = np.zeros(len(keys), dtype=np.int64)
    places = [np.searchsorted(keys, own) for own in lists]
    for at, (_, counts, _) in zip(places, held):
        totals[at] += unpack_counts(counts)
    for at, (_, _, one) in zip(places, held):
        columns = list(one.columns)
        if message == PAIRS:  # the chunk knows its pairs
            columns[6] = pa.nulls(1, pa.binary())
        columns[7] = pa.array([zlib.compress(pack_counts(totals[at]), 1)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))], names=_COUNTED
        )
    known = totals > 0
    counted = known & (keys != BEGIN) if message == WORDS else known
    ones = [int((totals[counted] == r).sum()) for r in range(1, RELIABLE + 2)]
    ones += [int(counted.sum()), int(totals[counted].sum())]
    kind = held[0][2].schema.field("doc_id").type
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([10 + message], pa.int32()), pa.array([part], pa.int64()), pa.array([-1], pa.int64()),
            pa.array([0], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.bool_()),
            pa.array([pack_sorted(keys[known])], pa.binary()), pa.array([pack_counts(totals[known])], pa.binary()),
            pa.array([ones[-1]], pa.int64()), pa.array([ones], pa.list_(pa.int64())),
        ],
        names=_COUNTED,
    )


# The model


@dataclass(frozen=True)
class Discounts:
    """What is kept of a count: ``kept[r]`` for r up to five; above, all but ``KEPT_BACK`` of one count."""

    kept: tuple[float, ...]

    def of(self, counts: np.ndarray) -> np.ndarray:
        counts = np.asarray(counts, dtype=np.float64)
        table = np.array((0.0, *self.kept))
        small = table[np.minimum(counts, RELIABLE).astype(np.int64)]
        return np.where(counts <= RELIABLE, small, 1.0 - KEPT_BACK / np.maximum(counts, 1.0))


def good_turing(ones: list[int]) -> Discounts:
    """Katz's discounts from the numbers of keys with counts 1 to 6.

    A discount that is not strictly between 0 and 1, as small corpora give, is replaced by (r - 1/2) / r.
    """
    kept = []
    common = (RELIABLE + 1) * ones[RELIABLE] / ones[0] if ones[0] else 1.0
    for r in range(1, RELIABLE + 1):
        value = -1.0
        if ones[r - 1] and common != 1.0:
            value = ((r + 1) * ones[r] / ones[r - 1] / r - common) / (1 - common)
        kept.append(value if 1e-6 < value < 1 - 1e-6 else (r - 0.5) / r)
    return Discounts(tuple(kept))


@dataclass(frozen=True)
class Model:
    """The scalars of a model; counts and backoff weights are tables."""

    train_tokens: int
    vocabulary: int
    words: Discounts
    pairs: Discounts
    unknown: float

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these training counts; all unknown words are one outcome."""
        counts = np.asarray(counts, dtype=np.float64)
        return np.where(counts > 0, self.words.of(counts) * counts / max(self.train_tokens, 1), self.unknown)


def _model(counted: DataFrame) -> Model:
    sums = {}
    for row in counted.where(F.col("message") >= 10).select("message", F.posexplode("ones")).groupBy(
        "message", "pos"
    ).agg(F.sum("col").alias("n")).collect():
        sums[row["message"], row["pos"]] = row["n"]
    of = lambda message: [sums.get((10 + message, i), 0) for i in range(RELIABLE + 3)]
    words, pairs = of(WORDS), of(PAIRS)
    kept, tokens = good_turing(words), words[-1]
    small = sum((1 - kept.kept[r - 1]) * r * words[r - 1] for r in range(1, RELIABLE + 1))
    large = KEPT_BACK * (words[-2] - sum(words[:RELIABLE]))
    unknown = (small + large) / tokens if tokens else 1.0
    return Model(tokens, words[-2], kept, good_turing(pairs), unknown)


# Scoring


_SCORED = (
    "row int, chunk long, place long, doc_id {id}, train boolean, n_tokens long, n_known long, base double, "
    "score double, history long, times long, missing double, covered double"
)
DOCUMENT_ROW, BACKOFF_ROW, HISTORY_ROW = range(3)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            numbers = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True])))
            for a, b in zip(cuts, cuts[1:]):
                if numbers[a] != current:
                    if held:
                        yield from _scored_chunk(current, held, model)
                    held, current = [], int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from _scored_chunk(current, held, model)

    return run


def _scored_chunk(number: int, batches: list[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk sorted by message and part -> document, backoff and history rows."""
    rows = pa.Table.from_batches(batches)
    by = {m: rows.filter(pa.compute.equal(rows["message"], m)) for m in (DOCUMENT, WORDS, PAIRS, TOTALS)}
    words = np.concatenate([unpack_sorted(d) for d in by[WORDS]["data"].to_pylist()])
    word_counts = np.concatenate([unpack_counts(zlib.decompress(c)) for c in by[WORDS]["counts"].to_pylist()])
    pair_totals = np.concatenate([unpack_counts(zlib.decompress(c)) for c in by[PAIRS]["counts"].to_pylist()])
    ranks = np.frombuffer(zlib.decompress(by[TOTALS]["data"][0].as_py()), dtype="<u4").astype(np.int64)
    documents = by[DOCUMENT].sort_by("place")
    sequences = []
    for packed in documents["data"].to_pylist():
        planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
        sequences.append(np.ascontiguousarray(planes.T).view("<u4")[:, 0])
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = ranks[np.concatenate(sequences)]
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[starts] = int(np.searchsorted(words, BEGIN))
    _, pair_of = np.unique(_pair_keys(words[before], words[at]), return_inverse=True)
    pair_counts = pair_totals[pair_of]
    del sequences, pair_of, pair_totals, by

    train = documents["train"].to_numpy().astype(bool)
    trained = np.repeat(train, sizes)
    probability = model.word_probability(word_counts)
    with np.errstate(divide="ignore"):
        base = np.log10((word_counts + 0.1) / (model.train_tokens + 0.1 * (model.vocabulary + 1)))
        word_log = np.log10(probability)
        kept = model.pairs.of(pair_counts)
        seen = pair_counts > 0
        pair_log = np.log10(np.where(seen, kept * pair_counts, 1.0) / np.where(seen, np.maximum(word_counts[before], 1), 1))
    score = np.where(seen, pair_log, word_log[at])
    per_document = lambda values: np.add.reduceat(values, starts)

    def batch(n, **given):
        fields = [f.strip().split(" ", 1) for f in _SCORED.split(",")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(),
                 "{id}": rows.schema.field("doc_id").type}
        columns = [
            (given[name].combine_chunks() if isinstance(given[name], pa.ChunkedArray) else pa.array(given[name], kinds[kind]))
            if name in given else pa.nulls(n, kinds[kind])
            for name, kind in fields
        ]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=[f[0] for f in fields])

    n = len(sizes)
    yield batch(
        n, row=np.full(n, DOCUMENT_ROW), chunk=np.full(n, number), place=documents["place"].to_numpy(),
        doc_id=documents["doc_id"], train=train, n_tokens=sizes,
        n_known=per_document((word_counts[at] > 0).astype(np.int64)), base=per_document(base[at]),
        score=per_document(score),
    )
    # A pair not seen in training backs off, if its history was seen: the weight comes from the history's table.
    away = np.flatnonzero(~seen & (word_counts[before] > 0))
    if len(away):
        of = np.repeat(np.arange(n), sizes)[away]
        keys, times = np.unique(of * len(words) + before[away], return_counts=True)
        yield batch(
            len(keys), row=np.full(len(keys), BACKOFF_ROW), chunk=np.full(len(keys), number),
            place=documents["place"].to_numpy()[keys // len(words)],
            history=words[keys % len(words)].view(np.int64), times=times,
        )
    # Each training occurrence gives its share of its pair: the shares of a pair over all chunks sum to one.
    own = np.flatnonzero(trained)
    if len(own):
        missing = np.bincount(before[own], weights=1.0 - kept[own], minlength=len(words))
        covered = np.bincount(before[own], weights=probability[at[own]] / pair_counts[own], minlength=len(words))
        used = np.flatnonzero(np.bincount(before[own], minlength=len(words)))
        yield batch(
            len(used), row=np.full(len(used), HISTORY_ROW), history=words[used].view(np.int64),
            missing=missing[used] / word_counts[used], covered=covered[used],
        )


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """While a table is written, its shuffle files go as soon as the job is over: they would double the disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score_texts(
    docs: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
    chunk_tokens: int = CHUNK_TOKENS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows that ``learnable`` selects (null: not) and scores all. Tokens are the words (A-Z lowered)
    and one end per text; a null text is an end alone. P(w | h) is the discounted count of the pair over the count of h if
    the pair was seen, else the history's backoff weight times P(w), which is the discounted share of w, or what the
    discounts leave for all unknown words together. A history that was not seen has the weight 1. For every history
    the probabilities of all known words and the unknown one sum to 1.

    Tables, below ``folder`` (scratch by default): ``counts`` (messages by kind; kinds 11 and 12 are the word and pair
    counts by part of the key range), ``scored``, ``backoff`` (history, weight). A chunk of ``chunk_tokens`` and a part of the key range for
    ``part_bytes`` of text fit in a task's memory. ``docs`` should be a stored table.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "katz")
    chosen = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(learnable, F.lit(False)).alias("train"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // part_bytes + 1)
    kind = docs.schema[doc_id].dataType
    counted_schema = T.StructType(
        [*_message_schema(kind).fields, T.StructField("seen", T.LongType()), T.StructField("ones", T.ArrayType(T.LongType()))]
    )
    with _shuffles_removed(spark):
        sent = chosen.mapInArrow(_send(parts, chunk_tokens), _message_schema(kind))
        merged = sent.repartition("part").sortWithinPartitions("message", "part", "chunk").mapInArrow(_merge, counted_schema)
        merged.write.partitionBy("message").parquet(f"{folder}/counts")
        counted = spark.read.schema(counted_schema).parquet(f"{folder}/counts")
        model = _model(counted)
        answers = counted.where(F.col("message") < 10).select("message", "part", "chunk", "place", "doc_id", "train", "data", "counts")
        ordered = answers.repartition("chunk").sortWithinPartitions("chunk", "message", "part", "place")
        scored_schema = _SCORED.format(id=kind.simpleString())
        ordered.mapInArrow(_score(model), scored_schema).write.partitionBy("row").parquet(f"{folder}/scored")
    scored = spark.read.schema(scored_schema).parquet(f"{folder}/scored")
    documents = scored.where(F.col("row") == DOCUMENT_ROW)
    away = scored.where(F.col("row") == BACKOFF_ROW).select("chunk", "place", "history", "times")
    weights = scored.where(F.col("row") == HISTORY_ROW).groupBy("history").agg(
        F.sum("missing").alias("missing"), F.sum("covered").alias("covered")
    )
    weights.select("history", (F.col("missing") / (1 - F.col("covered"))).alias("weight")).write.parquet(f"{folder}/backoff")
    backoff = spark.read.parquet(f"{folder}/backoff")
    added = (
        away.join(backoff, "history")
        .groupBy("chunk", "place")
        .agg(F.sum(F.col("times") * F.log10("weight")).alias("added"))
    )
    added = materialize(added, "backed-off")
    return join_sized(documents, added, ["chunk", "place"]).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )
