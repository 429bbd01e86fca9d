"""Main text of web pages by block rules in two passes.

A page is cut into tags and text; elements that never hold article text are cut out on the way: by their tag, their role
or the head words of their class and id names. The rest falls into blocks at block-level tags. The first pass labels
each block by link density, length and stop-word density; short blocks stay undecided. The second pass gives undecided
blocks the label of their nearest decided neighbours. Both passes run over every page. A mark (``article``, or
else ``main``) only moves thresholds: it speaks for its blocks if it is the page's only one or holds a block that the first
pass takes by itself; then they need no length or stop words, and up to half of them may be links. A card without such a block
beside other articles is judged like the rest of the page.

Character references are decoded once, white space inside a block becomes one space, blocks are joined by a line feed.
A single ``<br>`` is white space, two in a row end a block. Each page is worked on alone; there is no shuffle.

Defined results: null, empty or markup-only pages have the empty text; broken markup never fails: open elements end with
their parent or the page, a ``<`` that opens no tag is text, an unclosed script or comment reaches to the page's end.
Repeated rows give equal rows; an empty table gives an empty table; only the three named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm.common import query, table

#: Elements whose content is no text of the page: up to the page's end if unclosed, or only if closed.
RAW = "script style noscript template title textarea iframe".split()
SILENT = "svg object select button canvas audio video".split()
#: Elements that end a block, and among them those that may hold others.
HOLDERS = frozenset(
    "html body div section article main header footer nav aside form dialog menu ul ol li dl dd dt table thead tbody tfoot"
    " tr td th caption figure figcaption blockquote pre address details summary fieldset center".split()
)
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Boilerplate by tag, by role, and by the first or last word of a class or id name.
BOILERPLATE_TAGS = frozenset("nav aside footer form dialog menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget ad ads advert"
    " adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal"
    " overlay newsletter subscribe subscription signup login form search comment comments reply replies respond disqus"
    " discussion share sharing social related recommended pagination pager toolbar copyright legal disclaimer alert".split()
)
LAYOUT_PREFIXES = frozenset("has with no without is".split())
#: Fixed values of the first pass: characters of a short and of a long block, densities.
SHORT, LONG, MOST_LINKS, MOST_LINKS_INSIDE, SOME_STOP_WORDS, MANY_STOP_WORDS = 70, 200, 0.2, 0.5, 0.1, 0.2
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their
    they this to was we were what which who will with you
    aber als am auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat im ist mit nach nicht
    noch sich sie sind so und vom von war wie wird zu zum zur
    au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous on ou où par pas plus pour que
    qui sa se ses son sont sur un une vous
    al como con del el ella ellos entre era esta este ha las lo los más muy o para pero por se sin su sus también una y
    """.split()
)
TOKENS = re.compile(
    r"(?is)<!--.*?(?:-->|$)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|$)|<(" + "|".join(SILENT) + r")\b[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>|<[/!?a-z][^>]*(?:>|$)"
)
#: A whole attribute: its name, and its value if it has one.
ATTRIBUTES = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))?)?|\"[^\"]*\"|'[^']*'")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

GOOD, BAD, SHORT_BLOCK, NEAR = "good", "bad", "short", "near"


@dataclass
class Block:
    text: str
    linked: int
    mark: int  # number of the mark it stands in, 0 outside
    heading: bool
    label: str = ""


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    seen = set()
    for kind, *values in ATTRIBUTES.findall(attributes):
        kind, value = kind.lower(), next(filter(None, values), "")
        if not kind or kind in seen:  # of repeated attributes the first counts
            continue
        seen.add(kind)
        if kind == "hidden" or kind == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        for name in value.split() if kind in ("class", "id") else ():
            words = [w.lower() for w in NAME_WORDS.findall(name)]
            if words and words[0] not in LAYOUT_PREFIXES:
                ends = {words[0], words[-1]} - ({"header"} if in_article else set())
                if ends & BOILERPLATE_NAMES:
                    return True
    return False


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page outside boilerplate elements, in page order."""
    blocks: list[Block] = []
    stack: list[str] = []  # open holders
    cut_at = article_at = -1  # depth at which boilerplate, or the article, began
    n_marks = 0
    pieces: list[str] = []
    linked_pieces: list[str] = []
    in_link = heading = False
    breaks = 0
    marks = ("article",) if re.search(r"(?i)<article\b", html) else ("main",)

    def close() -> None:
        nonlocal breaks
        text = " ".join(unescape("".join(pieces)).split())
        if text and cut_at < 0:
            linked = len(" ".join(unescape("".join(linked_pieces)).split()))
            blocks.append(Block(text, linked, n_marks if article_at >= 0 else 0, heading))
        pieces.clear(), linked_pieces.clear()
        breaks = 0

    def say(text: str) -> None:
        nonlocal breaks
        if text and cut_at < 0:
            pieces.append(text)
            if in_link:
                linked_pieces.append(text)
            if breaks and not text.isspace():
                breaks = 0

    at = 0
    for token in TOKENS.finditer(html):
        say(html[at : token.start()])
        at = token.end()
        tag = token[4]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token[3])
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            breaks += 1
            close() if breaks > 1 else say("\n")
        elif tag in BLOCKS:
            close()
            heading = tag in HEADINGS and not closing
            if tag not in HOLDERS or token[5].endswith("/"):
                continue
            if not closing:
                stack.append(tag)
                if cut_at < 0 and _is_boilerplate(tag, token[5], article_at >= 0):
                    cut_at = len(stack)
                if article_at < 0 and cut_at < 0 and tag in marks:
                    article_at = len(stack)
                    n_marks += 1
            elif tag in stack:
                while stack.pop() != tag:
                    pass
                in_link = False
                cut_at = -1 if len(stack) < cut_at else cut_at
                article_at = -1 if len(stack) < article_at else article_at
    say(html[at:])
    close()
    return blocks


def first_pass(blocks: list[Block]) -> None:
    for b in blocks:
        links = b.linked / len(b.text)
        words = [w.strip(".,;:!?()\"'").lower() for w in b.text.split()]
        stop_words = sum(w in STOP_WORDS for w in words) / len(words)
        if links > MOST_LINKS:
            b.label = BAD
        elif len(b.text) < SHORT:
            b.label = BAD if links else SHORT_BLOCK
        elif stop_words >= MANY_STOP_WORDS:
            b.label = GOOD if len(b.text) > LONG else NEAR
        else:
            b.label = NEAR if stop_words >= SOME_STOP_WORDS else BAD
    marks = {b.mark for b in blocks} - {0}
    trusted = marks if len(marks) == 1 else {b.mark for b in blocks if b.label == GOOD} - {0}
    for b in blocks:
        if b.mark in trusted:
            b.label = GOOD if b.linked <= MOST_LINKS_INSIDE * len(b.text) else BAD


def second_pass(blocks: list[Block]) -> None:
    decided = [b.label if b.label in (GOOD, BAD) else "" for b in blocks]
    before, after = [BAD] * len(blocks), [BAD] * len(blocks)  # the page's ends count as boilerplate
    for k in range(1, len(blocks)):
        before[k] = decided[k - 1] or before[k - 1]
        after[-1 - k] = decided[-k] or after[-k]
    for b, left, right in zip(blocks, before, after, strict=True):
        if b.label == NEAR:
            b.label = GOOD if GOOD in (left, right) else BAD
        elif b.label == SHORT_BLOCK:
            b.label = GOOD if left == right == GOOD or b.heading and right == GOOD else BAD


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    first_pass(blocks)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
