"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text. The first pass labels a block by where it stands, its length and the densities of
its stop words and links; short and unclear blocks stay undecided. In the second pass they take
the label of the nearest decided block before or after them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.tables import quoted

LONG_CHARS = 70
STOP_DENSITY = 0.2
LINK_DENSITY = 0.4

STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to
    was we were will with you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im
    in ist mit nach nicht noch oder sich sie sind so über um und uns unter von vor war wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par
    pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más muy no o para
    pero por que se sin sobre son su sus también un una y ya
    """.split()
)
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary
    table tbody td tfoot th thead title tr ul
    """.split()
)
RAW_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video".split())
OUTSIDE = frozenset(
    "nav footer aside form head title menu dialog select button textarea datalist label legend fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
NEVER_OUTSIDE = frozenset("html body article main h1".split())
OUTSIDE_NAMES = frozenset(
    """
    nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar aside widget widgets related
    recommended ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search
    share sharing social comment comments disqus reply replies respond discussion pagination pager toolbar tagcloud
    copyright disclaimer paywall
    """.split()
)
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
)
_NEGATED = frozenset("has with no without is not".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?]|<(/?)([a-zA-Z][^\s/>'\"]*)""", re.DOTALL)
_SPECIAL = re.compile(r"['\">]")
_DECLARED = re.compile(r"<[!?]")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    content: bool
    heading: bool


def _named_outside(attributes: str) -> bool:
    """Whether class, id or role name something that is not the main text."""
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value.strip() in OUTSIDE_ROLES:
                return True
            continue
        for token in value.split():
            parts = _PARTS.findall(token)
            if parts and parts[0] not in _NEGATED and not OUTSIDE_NAMES.isdisjoint(parts):
                return True
    return False


class _Tags:
    """Finds where tags end, in time that grows with the page whatever quotes are left open.

    A tag ends at the first ``>`` outside its quotes. If there is none, no tag that opens the same quote has an end.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.endless: set[int] = set()
        self.near = (0, -1, None)  # from where, up to where, and what was found there last

    def _special(self, at: int):
        low, high, found = self.near
        if not low <= at <= high:
            found = _SPECIAL.search(self.html, at)
            self.near = (at, found.start() if found else len(self.html), found)
        return found

    def end(self, at: int) -> int | None:
        """The place of the ``>`` that ends the tag whose name ends at ``at``."""
        opened = []
        while (found := self._special(at)) is not None:
            place = found.start()
            if found[0] == ">":
                return place
            if place in self.endless:
                break
            opened.append(place)
            close = self.html.find(found[0], place + 1)
            if close < 0:
                break
            at = close + 1
        self.endless.update(opened)
        return None


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order; text of scripts, styles and markup is left out."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, outside, within content
    pieces: list[str] = []
    link_chars = links = 0
    heading = False
    at = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        if text:
            outside, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            found.append(Block(text, link_chars, outside, content, heading))
        pieces.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                link_chars += len(text)

    tags, end, search = _Tags(html), len(html), 0
    open_names: Counter[str] = Counter()
    while at < end:
        mark = _MARKUP.search(html, search)
        if mark is None:
            break
        name = (mark[2] or "").lower()
        if name:
            stop = tags.end(mark.end())
            if stop is None:
                # No tag: text. What else begins inside the name has the same end, unless it is a comment or the like.
                inside = _DECLARED.search(html, mark.start() + 1, mark.end())
                search = inside.start() if inside else mark.end()
                continue
            attributes = html[mark.end() : stop]
        elif len(mark[0]) == 2:
            stop = html.find(">", mark.end())
            if stop < 0:
                break
        else:
            stop = mark.end() - 1
        add(html[at : mark.start()])
        at = search = stop + 1
        if not name:
            continue
        if not mark[1]:
            if name in RAW_TEXT and not attributes.endswith("/"):
                close = re.compile(rf"</{name}\s*>|\Z", re.IGNORECASE).search(html, at)
                at = search = close.end()
                continue
            if name == "br":
                pieces.append(" ")
                continue
            is_block = name in BLOCKS
            named = bool(attributes) and name not in NEVER_OUTSIDE and _named_outside(attributes)
            if is_block:
                flush()
                if stack and stack[-1][0] in ("p", name) and name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
                    open_names[stack.pop()[0]] -= 1
                elif stack and stack[-1][0] == "p":
                    open_names[stack.pop()[0]] -= 1
                heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            elif name == "a":
                links += 1
            if name in VOID or attributes.endswith("/"):
                continue
            if is_block or named or name in OUTSIDE:
                outside, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if not is_block and (named or name in OUTSIDE):
                    flush()
                open_names[name] += 1
                stack.append(
                    (
                        name,
                        outside or named or name in OUTSIDE or (name == "header" and not content),
                        content or name in CONTENT,
                    )
                )
        else:
            place = None
            if open_names[name]:
                place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
            if name in BLOCKS or place is not None:
                flush()
                heading = False
            if name == "a" and links:
                links -= 1
            if place is not None:
                open_names.subtract(element[0] for element in stack[place:])
                del stack[place:]
    add(html[at:])
    flush()
    return found


def _decided(block: Block, has_content: bool) -> bool | None:
    """First pass: main text, not main text, or undecided."""
    if block.outside or (has_content and not block.content):
        return False
    size = len(block.text)
    words = block.text.lower().split()
    stops = sum(word.strip(".,;:!?") in STOP_WORDS for word in words)
    linked = block.link_chars > LINK_DENSITY * size
    prose = stops >= STOP_DENSITY * len(words)
    if size >= LONG_CHARS and prose and not linked:
        return True
    if has_content:
        return None  # inside the article nothing is dropped for its words or links alone
    if linked or (size >= LONG_CHARS and 2 * stops < STOP_DENSITY * len(words)):
        return False
    return None


def main_blocks(found: list[Block]) -> list[Block]:
    """Both passes. A heading follows the next decided block, of two equally near ones main text wins.

    Undecided blocks are main text on a page without any block that could have been decided as main text.
    """
    has_content = any(block.content and not block.outside for block in found)
    labels = [_decided(block, has_content) for block in found]
    open_ = [i for i, label in enumerate(labels) if label is None]
    if not open_:
        return [block for block, label in zip(found, labels) if label]
    # Elements that are outside by their place say nothing about their neighbours.
    decided = [
        i for i, label in enumerate(labels)
        if label is not None and not (found[i].outside or (has_content and not found[i].content))
    ]
    final = list(labels)
    after = 0
    for i in open_:
        while after < len(decided) and decided[after] < i:
            after += 1
        following = decided[after] if after < len(decided) else None
        preceding = decided[after - 1] if after else None
        if following is None and preceding is None:
            final[i] = True
        elif preceding is not None and following is not None and following - i == i - preceding:
            final[i] = labels[following] if found[i].heading else labels[following] or labels[preceding]
        elif preceding is None or (following is not None and (found[i].heading or following - i < i - preceding)):
            final[i] = labels[following]
        else:
            final[i] = labels[preceding]
    return [block for block, label in zip(found, final) if label]


def main_text(html: str) -> str:
    return " ".join(block.text for block in main_blocks(blocks(html)))


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The columns of ``pages`` without ``html``, and the main text with its length in code points.

    Null or empty html gives an empty text. Existing columns named ``text`` or ``n_chars`` are replaced. Rows stay
    in their partitions; each page is handled by itself, so repeated rows repeat.
    """
    kept = [c for c in pages.columns if c not in (html, text, n_chars)]
    schema = T.StructType(
        [*(pages.schema[c] for c in kept), T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]
    )
    chosen = pages.select(*(F.col(quoted(c)) for c in kept), F.coalesce(F.col(quoted(html)), F.lit("")).alias("page_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, pages_ = batch.columns
            texts = [main_text(page) for page in pages_.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*kept, text, n_chars],
            )

    return chosen.mapInArrow(run, schema)
