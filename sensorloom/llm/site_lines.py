"""Line removal by site-relative frequency.

A line is boilerplate on a host if it is on more than a given share of the host's pages, which are its distinct texts. Texts
are not shuffled: pages are hashes of their lines, lines are reduced to one row per host and line before the exchange, and
texts are filtered where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import BROADCAST_ROWS, fresh, join_sized, quoted
from sensorloom.sources.scratch import materialize

BOILERPLATE_RATIO = 0.1
LEAST_PAGES = 5
BROADCAST_HASHES = 1 << 20
_BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANK))


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(quoted(host)).cast("string")), F.lit("-"))


def boilerplate_lines(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    ratio: float = BOILERPLATE_RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """``host_key, line_hash, pages, host_pages`` of the lines on more than ``ratio`` of a host's pages.

    A page is a distinct text of the host, so copies of a page are one; a null text is empty. Lines are compared without
    blanks at their ends; empty ones never count, and a line counts once per page. Lines on fewer than ``least_pages``
    pages stay: on a handful of pages a tenth is one page, and every line would be on it. A hot host is no hot key: pages
    are told apart by two hashes of their text before they are shuffled, and lines are keys of their own.
    """
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    hashes = F.array_distinct(
        F.transform(F.filter(_lines(whole), lambda x: _stripped(x) != ""), lambda x: F.xxhash64(_stripped(x)))
    )
    page = ["host_key", "page_hash", "page_check"]
    pages = materialize(
        docs.select(
            _host_key(host).alias("host_key"),
            F.xxhash64(whole).alias("page_hash"),
            F.xxhash64(F.lit(1), whole).alias("page_check"),
            hashes.alias("line_hashes"),
        ).dropDuplicates(page),
        "host-pages",
    )
    totals = materialize(pages.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_pages")), "host-totals")
    counted = (
        pages.select("host_key", F.explode("line_hashes").alias("line_hash"))
        .groupBy("host_key", "line_hash")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= least_pages)
    )
    return join_sized(counted, totals, ["host_key"], "inner").where(
        F.col("pages") > F.lit(ratio) * F.col("host_pages")
    )


def drop_boilerplate_lines(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    ratio: float = BOILERPLATE_RATIO,
    least_pages: int = LEAST_PAGES,
    n_chars: str | None = None,
    dropped: str | None = None,
) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``: the same rows and columns.

    ``n_chars`` names a column that gets the new text's length, ``dropped`` a column for the number of lines taken out
    (in place of one of that name). A null text stays null; a text of boilerplate alone becomes empty. A null host
    is a host of its own. Per host there are at most (mean lines per page) / ``ratio`` boilerplate lines, so their
    hashes fit in one array per host, which is joined to the pages; all arrays together are broadcast up to 8 MB.
    """
    lines = materialize(boilerplate_lines(docs, text, host, ratio, least_pages), "boilerplate")
    key, bad, count = (fresh(docs, n) for n in ("host_key", "boilerplate", "line_count"))
    per_host = lines.groupBy(F.col("host_key").alias(key)).agg(F.collect_set("line_hash").alias(bad))
    per_host = materialize(per_host, "boilerplate-hosts")
    limit = BROADCAST_ROWS if lines.count() <= BROADCAST_HASHES else 0
    joined = join_sized(docs.withColumn(key, _host_key(host)), per_host, [key], limit=limit)
    original = F.col(quoted(text))
    kept = F.array_join(
        F.filter(
            _lines(original),
            lambda x: (_stripped(x) == "") | ~F.array_contains(F.col(bad), F.xxhash64(_stripped(x))),
        ),
        "\n",
    )
    cleaned = F.when(F.col(bad).isNull() | original.isNull(), original).otherwise(kept)
    result = joined.withColumn(count, F.size(_lines(original))).withColumn(text, cleaned)
    if n_chars is not None:
        result = result.withColumn(n_chars, F.char_length(F.col(quoted(text))).cast(docs.schema[n_chars].dataType))
    names = [F.col(quoted(c)) for c in docs.columns if dropped is None or c.lower() != dropped.lower()]
    if dropped is not None:
        # A text of dropped lines only is one empty line less than its count says.
        left = F.when(F.col(quoted(text)) == "", F.lit(0)).otherwise(F.size(_lines(F.col(quoted(text)))))
        names.append((F.col(count) - left).alias(dropped))
    return result.select(*names)
