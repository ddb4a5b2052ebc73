"""Phrase collocations from one FM-index per shard over word ids.

Texts become shards of local word ids. Per length, each shard extends its phrases by one word over the intervals of a
bidirectional index and sends each distinct one with its count, packed by ranges of hashes; sums across shards decide
which are frequent, and each shard gets the numbers of those it sent, in the order it sent them. A phrase is frequent
only if its parts are, so every round works on what is left of the shard. Word pairs are counted by hash buckets before,
and those in rare buckets are not sent. No key is hot: a phrase is one entry per shard, however common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.llm.tables import quoted, shuffles_removed
from sensorloom.llm.words import LOWERED, chunks, flat_bytes, mixed, segment_hashes
from sensorloom.sources.scratch import materialize, release

LEAST_COUNT = 30
LONGEST = 4
COVERED_PERCENT = 80
TOP = 2000
NO_LANGUAGE = "und"
SCORE_UNIT = 2_000_000
# Bytes of text of a shard; one longer text is a shard of its own.
SHARD_BYTES = 1 << 23
RANK_PARTS = 64
# Counters of one range of buckets.
RANGE_BITS = 20

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True


# The index


class Index:
    """FM-index of word ids 1 and up with 0 between pieces, whose suffixes are sorted by their first ``LONGEST`` ids.

    Extension of phrases up to that length needs no more: what follows the first ids decides no interval.
    """

    def __init__(self, ids: np.ndarray) -> None:
        base = int(ids.max(initial=0)) + 1
        padded = np.concatenate((ids, np.zeros(LONGEST, dtype=ids.dtype))).astype(np.int64)
        pairs = _ranks(padded[:-1] * base + padded[1:])
        most = int(pairs.max(initial=0)) + 1
        self.suffixes = _order(pairs[: len(ids)].astype(np.int64) * most + pairs[2 : len(ids) + 2])
        self.before = ids[self.suffixes - 1] if len(ids) else ids
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=base))))

    @cached_property
    def back(self) -> np.ndarray:
        """For each place of the index that of the suffix one word longer."""
        return _inverse(_order(self.before))


def _order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable").astype(np.int32)


def _inverse(order: np.ndarray) -> np.ndarray:
    result = np.empty_like(order)
    result[order] = np.arange(len(order), dtype=order.dtype)
    return result


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = _order(keys)
    new = np.zeros(len(keys), dtype=np.int32)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    result = np.empty(len(keys), dtype=np.int32)
    result[order] = np.cumsum(new, dtype=np.int32)
    return result


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the intervals, and which interval each belongs to."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return starts[of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of], of


def extended(
    index: Index, here: np.ndarray, there: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every phrase with one more word in the direction of ``index``: its intervals' starts and their size.

    ``here`` are the starts in ``index``, ``there`` those in the index of the other direction. In that one, the phrases
    that a phrase is extended to follow each other in the order of their new words.
    """
    places, of = _spread(here, sizes)
    words = index.before[places]
    base = int(words.max(initial=0)) + 1
    keys, first, counts = np.unique(of * base + words, return_index=True, return_counts=True)
    phrase, word = keys // base, keys % base
    smaller = np.cumsum(counts) - counts
    smaller -= smaller[np.searchsorted(phrase, phrase)]
    real = word > 0
    return index.back[places[first]][real].astype(np.int64), (there[phrase] + smaller)[real], counts[real]


class Shard:
    """Word ids of a shard with an index of each direction, read from the left and from the right."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids

    @cached_property
    def leftward(self) -> Index:
        return Index(self.ids)

    @cached_property
    def rightward(self) -> Index:
        return Index(self.ids[::-1])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = self.leftward.starts
        sizes = np.diff(starts)
        some = np.flatnonzero(sizes[1:]) + 1
        return starts[some], starts[some], sizes[some]

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the leftward interval of each distinct phrase of ``length`` words.

        Phrases grow to the left and to the right in turn.
        """
        left, right, sizes = self.words()
        for grown in range(2, length + 1):
            if grown % 2:
                right, left, sizes = extended(self.rightward, right, left, sizes)
            else:
                left, right, sizes = extended(self.leftward, left, right, sizes)
        return left, sizes

    def places(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the shard the phrases of these leftward intervals begin, and which phrase it is."""
        inside, of = _spread(starts, sizes)
        return self.leftward.suffixes[inside], of


def runs(ids: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids where phrases of ``length`` words begin that have a mark (> 0), one run after the other.

    A run is the words of consecutive marked phrases, with a 0 after it. Also the mark of the phrase that begins at each id.
    """
    marked = marks > 0
    begins = np.flatnonzero(marked & ~np.concatenate(([False], marked[:-1])))
    stops = np.flatnonzero(marked & ~np.concatenate((marked[1:], [False]))) + 1
    places, of = _spread(begins, stops - begins + length)
    last = np.arange(len(places)) == (np.cumsum(stops - begins + length) - 1)[of]
    places = np.minimum(places, max(len(ids) - 1, 0))
    return np.where(last, 0, ids[places]), np.where(places < stops[of], marks[places], 0)


# Shards


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and whether it is the first of its piece."""
    inside = ~(_BREAK | _BLANK)[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data] | edge[:-1])))
    piece = breaks[starts + 1] if len(starts) else starts
    return starts, ends, np.concatenate((piece[:1] >= 0, piece[1:] != piece[:-1]))


def _encoded(langs: list[str], texts: pa.Array):
    """The distinct words of a shard with language and count, and its ids (from 1) with 0 after each piece."""
    names = sorted(set(langs))
    salts = dict(zip(names, mixed(np.arange(1, len(names) + 1, dtype=np.uint64))))
    hashes, heads, owners, parts = [], [], [], []
    for low, high in chunks(texts):
        data, offsets = flat_bytes(texts.slice(low, high - low))
        data = LOWERED[data]
        starts, ends, first = _words_of(data, offsets)
        of = np.searchsorted(offsets, starts, side="right") - 1 + low
        salt = np.array([salts[lang] for lang in langs[low:high]], dtype=np.uint64)
        hashes.append(mixed(segment_hashes(data, starts, ends) ^ salt[of - low]) if len(starts) else np.zeros(0, np.uint64))
        heads.append(first)
        owners.append(of)
        parts.append((data.tobytes(), starts, ends))
    hashes, heads, owners = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (hashes, heads, owners))
    if not len(hashes):
        return [], [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    _, first, ids, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    words, bound, part = [""] * len(first), 0, iter(parts)
    data, starts, ends = b"", np.zeros(0), np.zeros(0)
    base = 0
    for at in np.argsort(first).tolist():
        while first[at] >= bound:
            base = bound
            data, starts, ends = next(part)
            bound += len(starts)
        place = first[at] - base
        words[at] = data[starts[place] : ends[place]].decode()
    spoken = [langs[i] for i in owners[first].tolist()]
    gaps = np.flatnonzero(heads)[1:]
    return spoken, words, counts, np.append(np.insert(ids + 1, gaps, 0), 0).astype(np.int32)


_SHARDS = "shard long, kind int, lang string, word string, place long, times long, ids binary"
_WORD, _IDS = 0, 1


def _make_shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 14
        held, size = [], 0

        def made() -> pa.RecordBatch:
            langs = [x for batch in held for x in batch.column(0).to_pylist()]
            texts = pa.concat_arrays([batch.column(1) for batch in held])
            spoken, words, counts, ids = _encoded(langs, texts)
            n = len(words)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, number)),
                    pa.array([_WORD] * n + [_IDS], pa.int32()),
                    pa.array(spoken + [None], pa.string()),
                    pa.array(words + [None], pa.string()),
                    pa.array(np.arange(1, n + 2)),
                    pa.array(np.append(counts, 0)),
                    pa.array([None] * n + [_blob(ids)], pa.binary()),
                ],
                names=["shard", "kind", "lang", "word", "place", "times", "ids"],
            )

        for batch in batches:
            while batch.num_rows:
                ends = np.cumsum(_lengths(batch.column(1)))
                taken = max(1 if not held else 0, int(np.searchsorted(ends, shard_bytes - size, side="right")))
                if taken:
                    held.append(batch.slice(0, taken))
                    size += int(ends[taken - 1])
                    batch = batch.slice(taken)
                if batch.num_rows:
                    yield made()
                    number, held, size = number + 1, [], 0
        if held:
            yield made()

    return run


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(flat_bytes(texts)[1])


# Rounds


_KEPT = "shard long, part int, ids binary, extra binary"
_WHOLE = -1
_CODEC = "zstd"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, dtype="<u4").tobytes(), _CODEC, asbytes=True) if len(values) else b""


def _unpacked(packed: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, dtype=np.int64)
    return np.frombuffer(pa.decompress(packed, 4 * count, _CODEC), dtype="<u4").astype(np.int64)


def _blob(values: np.ndarray) -> bytes:
    """Numbers below 2**32 with their count before them."""
    return len(values).to_bytes(4, "little") + _packed(values)


def _unblob(blob: bytes) -> np.ndarray:
    return _unpacked(blob[4:], int.from_bytes(blob[:4], "little"))


def _long_blob(values: np.ndarray) -> bytes:
    """Longs with their count before them. Bytes of one place follow each other, so that the equal high ones pack well."""
    planes = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), _CODEC, asbytes=True)


def _long_unblob(blob: bytes) -> np.ndarray:
    count = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], 8 * count, _CODEC), dtype=np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<i8").ravel().astype(np.int64)


def _buckets(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each pair of global word numbers."""
    joined = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    return (mixed(joined) >> np.uint64(64 - bits)).astype(np.int64)


def _bucket_counts(bits: int):
    """A shard and its frequent words -> the shard of these words alone, and how many pairs of it fall in each bucket.

    The shard's row holds its ids, which are new from 1, and their global numbers. A row of a range of buckets holds the
    number of buckets in it, differences between them, and counts.
    """

    def run(shards: pa.Table, frequent: pa.Table) -> pa.Table:
        if not (shards.num_rows and frequent.num_rows):
            return pa.table({"shard": [], "part": [], "ids": [], "extra": []}, schema=_arrow(_KEPT))
        number = shards.column("shard")[0].as_py()
        whole = _unblob(shards.column("ids")[0].as_py())
        places, numbers = (frequent.column(n).to_numpy() for n in ("place", "id"))
        marks = np.zeros(max(int(whole.max(initial=0)), int(places.max())) + 1, dtype=np.int32)
        marks[places] = np.arange(1, len(places) + 1)
        _, ids = runs(whole, marks[whole], 1)
        pairs = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        buckets, counts = np.unique(
            _buckets(numbers[ids[pairs] - 1], numbers[ids[pairs + 1] - 1], bits), return_counts=True
        )
        rows = [(number, _WHOLE, _blob(ids), _long_blob(numbers))]
        ranges = buckets >> RANGE_BITS
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1, append=1 << 62)) if len(ranges) else [0]
        for low, high in zip(cuts[:-1], cuts[1:]):
            inside = np.diff(buckets[low:high] & ((1 << RANGE_BITS) - 1), prepend=0)
            size = int(high - low).to_bytes(4, "little")
            rows.append((number, int(ranges[low]), size + _packed(inside), _packed(counts[low:high])))
        return pa.table(dict(zip(("shard", "part", "ids", "extra"), map(list, zip(*rows)))), schema=_arrow(_KEPT))

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _frequent_buckets(least: int):
    """All shards' counts of one range of buckets -> for each shard one bit per bucket it sent: are there ``least`` in all?"""

    def run(rows: pa.Table) -> pa.Table:
        totals, sent = np.zeros(1 << RANGE_BITS, dtype=np.int64), []
        for ids, counts in zip(rows.column("ids").to_pylist(), rows.column("extra").to_pylist()):
            size = int.from_bytes(ids[:4], "little")
            buckets = np.cumsum(_unpacked(ids[4:], size))
            totals[buckets] += _unpacked(counts, size)
            sent.append(buckets)
        bits = [np.packbits(totals[buckets] >= least).tobytes() for buckets in sent]
        sizes = [len(buckets).to_bytes(4, "little") for buckets in sent]
        return pa.table(
            {"shard": rows.column("shard"), "part": rows.column("part"), "ids": bits, "extra": sizes}, schema=_arrow(_KEPT)
        )

    return run


_SENT = "shard long, part int, ids binary, extra binary, times binary"
_NAMED = "id long, first long, second long, total long"
# Not a shard: the frequent phrases of a part.
_LEVEL = -1


def _sent_table(rows: list[tuple]) -> pa.Table:
    schema = _arrow(_SENT)
    return pa.Table.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _phrase_rows(number: int, ids: np.ndarray, found: tuple[np.ndarray, ...], bits: int, last: bool) -> pa.Table:
    """What a shard sends: per range of buckets its phrases' first and second parts (by number) and counts.

    ``found`` are the phrases' leftward intervals (starts and sizes) and parts. A row for the shard itself holds its ids
    and the intervals in the order in which the phrases are sent; after the ``last`` round nobody asks for it.
    """
    ranges = _buckets(*found[2:], bits) >> RANGE_BITS
    order = np.lexsort((found[3], found[2], ranges))
    starts, sizes, first, second = (c[order] for c in found)
    rows = [] if last else [(number, _WHOLE, _blob(ids), _blob(starts), _blob(sizes))]
    ranges = ranges[order]
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1, append=1 << 62)) if len(ranges) else [0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        parts = _long_blob(np.diff(first[low:high], prepend=0)), _long_blob(second[low:high])
        rows.append((number, int(ranges[low]), *parts, _blob(sizes[low:high])))
    return _sent_table(rows)


def _pairs(bits: int, last: bool):
    """A shard with the answers about its buckets -> its word pairs in frequent buckets."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        parts, ids, extra = (rows.column(c).to_pylist() for c in ("part", "ids", "extra"))
        numbers, left = _long_unblob(extra[0]), Shard(_unblob(ids[0]).astype(np.int32))
        assert parts[0] == _WHOLE
        starts, sizes = left.phrases(2)
        begin = left.leftward.suffixes[starts]
        first, second = numbers[left.ids[begin] - 1], numbers[left.ids[begin + 1] - 1]
        answers = [
            np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=int.from_bytes(n, "little")) for b, n in zip(ids[1:], extra[1:])
        ]
        frequent = np.concatenate([np.zeros(0, dtype=np.uint8), *answers]) > 0
        buckets = _buckets(first, second, bits)
        kept = frequent[np.searchsorted(np.unique(buckets), buckets)] if len(buckets) else buckets > 0
        found = tuple(c[kept] for c in (starts, sizes, first, second))
        return _phrase_rows(rows.column("shard")[0].as_py(), left.ids, found, bits, last)

    return run


def _counted(least: int, last: bool):
    """All shards' phrases of one range -> those with ``least`` occurrences in all, and for each shard which of its own these are.

    A frequent phrase's number is its range and its place among the frequent ones of it. Answers hold a bit per phrase that the
    shard sent and the places of the frequent ones.
    """

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        shards, ids, extra, times = (rows.column(c).to_pylist() for c in ("shard", "ids", "extra", "times"))
        firsts = [np.cumsum(_long_unblob(b)) for b in ids]
        first, second = np.concatenate(firsts), np.concatenate([_long_unblob(b) for b in extra])
        counts = np.concatenate([_unblob(b) for b in times])
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        totals = np.add.reduceat(counts[order], np.flatnonzero(new))
        frequent = totals >= least
        begin = np.flatnonzero(new)[frequent]
        found = [(_LEVEL, part, _long_blob(first[begin]), _long_blob(second[begin]), _long_blob(totals[frequent]))]
        if not last:
            places = np.where(frequent, np.cumsum(frequent) - 1, -1)
            own = np.empty(len(order), dtype=np.int64)
            own[order] = places[np.cumsum(new) - 1]
            ends = np.cumsum([len(f) for f in firsts])
            for shard, low, high in zip(shards, ends - [len(f) for f in firsts], ends):
                mine = own[low:high]
                bits = int(high - low).to_bytes(4, "little") + np.packbits(mine >= 0).tobytes()
                found.append((shard, part, bits, _blob(mine[mine >= 0]), b""))
        return _sent_table(found)

    return run


def _named_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of a part, packed -> one row for each."""
    for batch in batches:
        for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            first, second, totals = map(_long_unblob, packed)
            numbers = (part << 32) + np.arange(len(first))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (numbers, first, second, totals))), names=_arrow(_NAMED).names)


def _round(length: int, bits: int, last: bool):
    """A shard and the answers about its phrases of ``length`` words -> what is left of the shard, and its phrases of one word more.

    A longer phrase names its first and its second part by their numbers.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        parts, ids, extra, times = (rows.column(c).to_pylist() for c in ("part", "ids", "extra", "times"))
        assert parts[0] == _WHOLE
        whole, starts, sizes = Shard(_unblob(ids[0]).astype(np.int32)), _unblob(extra[0]), _unblob(times[0])
        answers = [
            np.unpackbits(np.frombuffer(b, dtype=np.uint8, offset=4), count=int.from_bytes(b[:4], "little")) for b in ids[1:]
        ]
        frequent = np.concatenate([np.zeros(0, dtype=np.uint8), *answers]) > 0
        if not frequent.any():
            return _sent_table([])
        numbers = np.concatenate([(part << 32) + _unblob(places) for part, places in zip(parts[1:], extra[1:])])
        marks = np.zeros(len(whole.ids), dtype=np.int64)
        at, of = whole.places(starts[frequent], sizes[frequent])
        marks[at] = of + 1
        kept, marks = runs(whole.ids, marks, length)
        left = Shard(kept.astype(np.int32))
        starts, sizes = left.phrases(length + 1)
        begin = left.leftward.suffixes[starts]
        found = starts, sizes, numbers[marks[begin] - 1], numbers[marks[begin + 1] - 1]
        return _phrase_rows(rows.column("shard")[0].as_py(), left.ids, found, bits, last)

    return run


def _summed(rows: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """The words with ``least`` occurrences in all shards, their ``total`` and a number ``id``: that of one row."""
    # The hash comes first because rows are sorted by it: most comparisons end there.
    same = W.partitionBy("mixed", *keys)
    own = F.shiftleft("shard", 29) + F.col("place")
    return materialize(
        rows.withColumn("mixed", F.xxhash64(*keys))
        .withColumn("total", F.sum("times").over(same))
        .where(F.col("total") >= least)
        .withColumn("own", own)
        .withColumn("id", F.min("own").over(same))
        .withColumn("one", F.col("own") == F.col("id"))
        # The word itself is on one row only.
        .select("shard", "place", "total", "id", *(F.when(F.col("one"), F.col(k)).alias(k) for k in keys), "one"),
        name,
    )


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST_COUNT,
    longest: int = LONGEST,
    shard_bytes: int = SHARD_BYTES,
) -> tuple[list[DataFrame], DataFrame]:
    """Per length from 1 to ``longest`` the frequent phrases, and ``lang, n``: the words of each language.

    Words are ``id, lang, phrase, last, total``. Longer phrases also have ``first`` and ``second``, the numbers of the phrases
    without their last and their first word, with their counts ``first_total`` and ``second_total``.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"Phrases have 2 to {LONGEST} words.")
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    with shuffles_removed(spark):
        made = materialize(texts.mapInArrow(_make_shards(shard_bytes), _SHARDS), "shards")
        words = made.where(F.col("kind") == _WORD)
        totals = materialize(words.groupBy("lang").agg(F.sum("times").alias("n")), "language-totals")
        found = _summed(words.select("shard", "place", "times", "lang", "word"), ["lang", "word"], least, "frequent-words")
        level = materialize(
            found.where("one").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "total"), "named-1"
        )
        levels = [level]
        shards = made.where(F.col("kind") == _IDS).select("shard", "ids")
        words_in_all = totals.agg(F.sum("n")).first()[0] or 0
        # About four pairs in a bucket, so that few rare pairs share one with others to make it frequent.
        bits = max(RANGE_BITS, int(words_in_all).bit_length() - 2)
        known = found.select("shard", "place", "id").groupBy("shard")
        kept = materialize(shards.groupBy("shard").cogroup(known).applyInArrow(_bucket_counts(bits), _KEPT), "word-shards")
        # Tables that no later job reads go at once: disk is what this operator needs most.
        release(made)
        release(found)
        for length in range(1, longest):
            last = length + 1 == longest
            if length == 1:
                whole = kept.where(F.col("part") == _WHOLE)
                answers = kept.where(F.col("part") != _WHOLE).groupBy("part").applyInArrow(_frequent_buckets(least), _KEPT)
                sent = materialize(
                    whole.unionByName(answers).groupBy("shard").applyInArrow(_pairs(bits, last), _SENT), "phrases-2"
                )
                read = [kept]
            else:
                asked = sent.where(F.col("part") == _WHOLE).unionByName(counted.where(F.col("shard") != _LEVEL))
                read = [sent, counted]
                sent = materialize(asked.groupBy("shard").applyInArrow(_round(length, bits, last), _SENT), f"phrases-{length + 1}")
            for table in read:
                release(table)
            phrases = sent.where(F.col("part") != _WHOLE)
            counted = materialize(phrases.groupBy("part").applyInArrow(_counted(least, last), _SENT), f"frequent-{length + 1}")
            found = counted.where(F.col("shard") == _LEVEL).select("part", "ids", "extra", "times").mapInArrow(_named_rows, _NAMED)
            parts = [
                level.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), F.col("total").alias("first_total")),
                level.select(F.col("id").alias("second"), "last", F.col("total").alias("second_total")),
            ]
            level = materialize(
                found.join(parts[0], "first").join(parts[1], "second")
                .withColumn("phrase", F.concat_ws(" ", "head", "last"))
                .select("id", "lang", "phrase", "last", "total", "first", "second", "first_total", "second_total"),
                f"named-{length + 1}",
            )
            levels.append(level)
        release(sent)
        release(counted)
    return levels, totals


def _score(total: Column, left: Column, right: Column) -> Column:
    wide = "decimal(38,0)"
    both = left.cast("decimal(20,0)") + right.cast("decimal(20,0)")
    return F.call_function("div", total.cast(wide) * F.lit(SCORE_UNIT).cast("decimal(7,0)"), both)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST_COUNT,
    longest: int = LONGEST,
    covered_percent: int = COVERED_PERCENT,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Texts (A-Z lowered, null: empty) are cut into pieces at ``.,;:!?`` and the characters 0x0A to 0x0D, pieces into words
    at spaces and tabs. A phrase is 2 to ``longest`` words of one piece that occur ``least`` times or more in their language
    (null: ``und``), overlaps included. Cut after its first words, it has a score of 2,000,000 a / (l + r), rounded down; a
    is its count, l and r are those of its parts. The cut with the lowest score counts, of equal ones the first. A phrase is left out if a
    longer one that contains it has at least ``covered_percent`` percent of its count. Ranks go by score, count, phrase.
    A phrase contained in a longer one is contained in one of one more word that is as frequent or more, so the extensions by
    one word decide. Repeated rows count each; other columns are not read. Counts are exact, and so are scores.
    """
    levels, totals = frequent_phrases(docs, text, lang, least, longest, shard_bytes)
    wide = "decimal(38,0)"
    chosen = None
    for k in range(2, longest + 1):
        level = levels[k - 1]
        cuts = [(1, F.col("w_total"), F.col("second_total"))]
        # The first word is the first part's first word, and so on down; the tail after two words is reached alike.
        heads, tails = level.select("id", "first"), level.select("id", "second")
        for depth in range(k - 2, 0, -1):
            below = levels[depth].select(F.col("id").alias("at"), F.col("first").alias("next"))
            heads = heads.join(below, heads["first"] == below["at"]).select("id", F.col("next").alias("first"))
            below = levels[depth].select(F.col("id").alias("at"), F.col("second").alias("next"))
            tails = tails.join(below, tails["second"] == below["at"]).select("id", F.col("next").alias("second"))
        one = levels[0].select(F.col("id").alias("at"), "total")
        first_word = heads.join(one, heads["first"] == one["at"]).select("id", F.col("total").alias("w_total"))
        last_word = tails.join(one, tails["second"] == one["at"]).select("id", F.col("total").alias("z_total"))
        rows = level.join(first_word, "id").join(last_word, "id")
        if k > 2:
            cuts.append((k - 1, F.col("first_total"), F.col("z_total")))
        if k == 4:
            pair = levels[2].select(F.col("id").alias("first"), F.col("first_total").alias("head_total"))
            rows = rows.join(pair, "first")
            pair = levels[2].select(F.col("id").alias("second"), F.col("second_total").alias("tail_total"))
            rows = rows.join(pair, "second")
            cuts.append((2, F.col("head_total"), F.col("tail_total")))
        scored = [
            F.struct(
                _score(F.col("total"), left, right).alias("score"),
                F.lit(cut).alias("cut"),
                left.alias("l"),
                right.alias("r"),
            )
            for cut, left, right in cuts
        ]
        best = F.least(*scored) if len(scored) > 1 else scored[0]
        rows = rows.withColumn("best", best).select("id", "lang", "phrase", F.col("total").alias("a"), "best.l", "best.r", "best.score")
        if k < longest:
            longer = levels[k].select(F.explode(F.array("first", "second")).alias("id"), F.col("total").alias("longer"))
            rows = rows.join(longer.groupBy("id").agg(F.max("longer").alias("longer")), "id", "left").where(
                F.col("longer").isNull()
                | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * F.lit(covered_percent))
            )
        rows = rows.select("lang", "phrase", "a", "l", "r", "score")
        chosen = rows if chosen is None else chosen.unionByName(rows)
    # Ranked in parts first, so that no task ranks all phrases of a language.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = chosen.withColumn("part", part).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))
    )
    some = some.where(F.col("rank") <= top).drop("rank", "part")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
