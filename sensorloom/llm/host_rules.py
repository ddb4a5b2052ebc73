"""Quality rules with host-level verdicts.

Every document is measured; each host's share of documents that fail a rule is shrunk towards the share
of all hosts with a beta prior fitted to the hosts; a document that fails a rule falls if its host's shrunk
share is too high. Documents that fail a base rule always fall, documents that fail no rule always stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.tables import fresh, join_sized, quoted, with_text_columns
from sensorloom.llm.words import (
    IS_SPACE,
    chunks,
    joined_hashes,
    mark_words,
    flat_bytes,
    segment_hashes,
    window_starts,
    word_hashes,
)
from sensorloom.sources.scratch import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Base rules reject alone; the other rules count towards the host and reject with its verdict.

    A host is rejected if its shrunk rate lies ``host_deviations`` standard deviations of the prior above the prior's mean;
    0.84 is about the upper fifth of the hosts that the prior expects.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_word_chars: float = 3.0
    max_word_chars: float = 12.0
    max_symbols_per_word: float = 0.1
    max_dup_line_share_percent: int = 30
    host_deviations: float = 0.84


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks values that occur more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    result = np.empty(len(keys), dtype=bool)
    result[order] = same[1:] | same[:-1]
    return result


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The five measures of each text, in the order of ``MEASURES``."""
    data, offsets = flat_bytes(texts)
    words = mark_words(data, offsets)
    rows = len(texts)
    characters = (data & 0xC0) != 0x80
    word_chars = _per_text(characters & ~IS_SPACE[data], offsets)
    symbols = _per_text(_SYMBOL[data], offsets)

    text_key = np.arange(rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    covered = np.zeros(len(words.starts), dtype=np.int64)
    at, of = window_starts(words, 3)
    if len(at):
        hits = at[_repeated(joined_hashes(word_hashes(words), 3)[at] ^ text_key[of])]
        for step in range(3):
            covered[hits + step] = 1
    repeated_words = _per_text(covered, words.first)

    starts, ends, of = line_bounds(data, offsets)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, of = starts[has_word], ends[has_word], of[has_word]
    keys = segment_hashes(data, starts, ends) ^ text_key[of]
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[firsts] = False
    dup_lines = np.bincount(of[later], minlength=rows).astype(np.int64)
    return [words.counts().astype(np.int64), word_chars, symbols, dup_lines, repeated_words]


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line (texts split at line feeds)."""
    feeds = np.flatnonzero(data == 10)
    of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    rows = len(offsets) - 1
    starts = np.concatenate((offsets[:-1], feeds + 1))
    ends = np.concatenate((feeds, offsets[1:]))
    start_of = np.concatenate((np.arange(rows), of_feed))
    end_of = np.concatenate((of_feed, np.arange(rows)))
    # Lines of one text are in order of position; a text's last line ends at the text's end.
    order = np.lexsort((starts, start_of))
    return starts[order], ends[np.lexsort((ends, end_of))], start_of[order]


def _measured(texts: pa.Array) -> list[pa.Array]:
    parts = [measure(texts.slice(a, b - a)) for a, b in chunks(texts)]
    return [
        pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64())
        for i in range(len(MEASURES))
    ]


def with_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and the five measures of the whole text."""
    fields = [T.StructField(prefix + name, T.LongType(), False) for name in MEASURES]
    return with_text_columns(docs, text, fields, _measured)


def base_failed(rules: Rules, prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * words)


def rule_failed(rules: Rules, prefix: str = "") -> Column:
    """True if a base rule or another rule fails."""
    words, chars = F.col(prefix + "n_words"), F.col(prefix + "word_chars")
    symbols, dups = F.col(prefix + "n_symbols"), F.col(prefix + "n_dup_lines")
    return (
        base_failed(rules, prefix)
        | (chars < rules.min_word_chars * words)
        | (chars > rules.max_word_chars * words)
        | (symbols > rules.max_symbols_per_word * words)
        | (100 * dups > rules.max_dup_line_share_percent * words)
    )


def host_verdicts(measured: DataFrame, host: str, rules: Rules, prefix: str = "") -> DataFrame:
    """One row per host: pages, failed, rate, shrunk_rate, host_rejected.

    Pages are those that pass the base rules, failed those of them that fail another. The prior is a beta distribution whose
    mean and strength come from the moments of the hosts' rates (each host with pages counts once). If the
    rates do not vary, or there is one host, its strength is 1e6 pages; if they vary as much as possible, it has none. The bar
    follows the prior, so a host falls for being worse than other hosts, not for a fixed rate. Partial
    aggregation takes care of hot hosts.
    """
    passed = ~base_failed(rules, prefix)
    hosts = measured.groupBy(F.col(quoted(host)).alias("host")).agg(
        F.sum(passed.cast("long")).alias("pages"),
        F.sum((passed & rule_failed(rules, prefix)).cast("long")).alias("failed"),
    )
    hosts = materialize(hosts.withColumn("rate", F.try_divide("failed", "pages")), "hosts")
    moments = hosts.agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread")).first()
    mean, spread = moments["mean"] or 0.0, moments["spread"] or 0.0
    strength = min(1e6, max(0.0, mean * (1 - mean) / spread - 1)) if spread > 1e-15 else 1e6
    bar = mean + rules.host_deviations * (mean * (1 - mean) / (strength + 1)) ** 0.5
    shrunk = F.try_divide(F.col("failed") + F.lit(mean * strength), F.col("pages") + F.lit(strength))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn(
        "host_rejected", F.coalesce(F.col("shrunk_rate") > F.lit(bar), F.lit(False))
    )


def judge_documents(
    docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), prefix: str = ""
) -> DataFrame:
    """All columns of ``docs``, the measures, ``base_failed``, ``host_rejected`` and ``kept`` (with ``prefix``).

    A null text is empty: it has no words and fails. A null host is a host of its own. Repeated rows are judged
    each. Columns whose names clash with the new ones need a ``prefix``. No text is shuffled: texts are
    measured once for the hosts' rates and once more for the documents' own verdicts.
    """
    hosts = host_verdicts(
        with_measures(docs.select(F.col(quoted(host)), F.col(quoted(text))), text, prefix), host, rules, prefix
    )
    rejected = hosts.where("host_rejected").select(
        F.coalesce(F.concat(F.lit("="), "host"), F.lit("-")).alias("host_key"), F.lit(True).alias("host_rejected")
    )
    key, verdict = fresh(docs, prefix + "host_key"), fresh(docs, prefix + "host_rejected")
    rejected = rejected.select(F.col("host_key").alias(key), F.col("host_rejected").alias(verdict))
    judged = with_measures(docs, text, prefix).withColumn(
        key, F.coalesce(F.concat(F.lit("="), F.col(quoted(host)).cast("string")), F.lit("-"))
    )
    judged = join_sized(judged, rejected, [key]).drop(key)
    return (
        judged.withColumn(verdict, F.coalesce(F.col(verdict), F.lit(False)))
        .withColumn(prefix + "base_failed", base_failed(rules, prefix))
        .withColumn(
            prefix + "kept",
            ~F.col(prefix + "base_failed") & ~(F.col(verdict) & rule_failed(rules, prefix)),
        )
    )


def keep_good_documents(
    docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    prefix = "judged_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = judge_documents(docs, text, host, rules, prefix)
    return judged.where(F.col(prefix + "kept")).select(*(F.col(quoted(c)) for c in docs.columns))
