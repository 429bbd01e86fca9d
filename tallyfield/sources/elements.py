"""Score and profile pages read as element trees: nested tables, sibling steps, every character reference.

``pages.py`` reads flat pages with patterns inside the JVM, which is the cheaper way and the right one where tables do
not nest. Here every page is parsed once, by a small tolerant parser over Arrow batches that hands back the page's
tables, side names and labelled values as nested columns; all records are made from those by Spark expressions.

Defined results: a null or empty page has no sides and no tables; end tags without an element are ignored; elements
left open end with their parent, table cells and rows also where the next one begins. Cells are those of the row
itself, so a table inside a cell adds to the cell's text but not to the row's cells. The work is linear in the page's
length for a bounded depth of nested tables.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.functions.text import scrub
from tallyfield.sources import pages
from tallyfield.sources.plain import GAP, GIVEN, NAME, RAW_TEXT, TABLE_PARTS, VOID, attributes_of, in_parts, read_plain

CELL = "struct<text:string,link:string,spans:array<string>>"
ROW = f"struct<classes:array<string>,cells:array<{CELL}>>"
PARSED = (
    "struct<title:string,sides:array<string>,details:map<string,string>,about:string,"
    f"tables:array<struct<classes:array<string>,inside_div:boolean,rows:array<{ROW}>>>>"
)
PAGES_AT_ONCE = 32
#: The table of each innings and the side its rows belong to, among the batting and among the bowling tables.
BATTING_PICK, BOWLING_PICK = ((0, 0), (1, 1)), ((1, 1), (3, 0))

FREQUENT = frozenset(["", "a", "div", "p", "span", "td", "tr"])
#: A plain start or end tag and the text after it, or an element without others inside and the text after that.
TAG = re.compile(f"<(?:/({NAME}){GAP}*+|({NAME})({GIVEN}){GAP}*+/?)>([^<]*+)(?:</(\\2){GAP}*+>([^<]*+))?")


class _Tolerant(HTMLParser):
    """Tokens of a page whose markup is not plain: comments, declarations, scripts, bare values, stray brackets."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[list] = [["", "", {}, "", "", ""]]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tokens.append(["", tag, dict(attrs), "", "", ""])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tokens.append([tag, "", {}, "", "", ""])

    def handle_data(self, data: str) -> None:
        # Text is in one piece but for rare markup; each further piece is a token of its own, so none is copied twice.
        if self.tokens[-1][3]:
            self.tokens.append(["", "", {}, data, "", ""])
        else:
            self.tokens[-1][3] = data


def _tokens(html: str) -> tuple[Sequence[Sequence], bool]:
    """(end tag, start tag, attributes, text after it, end tag right after that, text after that) in page order, and
    whether the markup is plain.

    One pattern reads plain tags. A match has an opening bracket for each of its tags, so if they add up to those of the
    page, the matches cover it; attributes and texts are as written then.
    """
    plain = TAG.findall(html)
    whole = len(plain) + sum(1 for token in plain if token[4]) == html.count("<")
    if whole and RAW_TEXT.isdisjoint([token[1].lower() for token in plain if token[1] not in FREQUENT]):
        lead = html.find("<")
        return [("", "", "", html[:lead] if lead >= 0 else html, "", ""), *plain], True
    return _Tolerant(html).tokens, False


class Elements:
    """Elements of one page in page order; an element's descendants are the numbers up to its ``end``."""

    def __init__(self, html: str) -> None:
        self.tags: list[str] = []
        self.attributes: list[str | dict[str, str | None]] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.begins: list[int] = []
        self.stops: list[int] = []
        self.pieces: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self._read(*_tokens(html))

    def _read(self, tokens: Sequence[Sequence], plain: bool) -> None:
        tags, pieces, ends, stops, places = self.tags, self.pieces, self.ends, self.stops, self.places
        attributes, parents, begins = self.attributes, self.parents, self.begins
        opened = [-1]
        open_tags: dict[str, int] = defaultdict(int)
        open_parts: list[int] = []

        def leave() -> int:
            number = opened.pop()
            open_tags[tags[number]] -= 1
            if open_parts and open_parts[-1] == number:
                open_parts.pop()
            ends[number], stops[number] = len(tags), len(pieces)
            return number

        # Numbers of tags and pieces so far are kept beside the lists; this loop sees every tag of every page.
        number = texts = 0
        for end, start, given, text, closed, after in tokens:
            if start:
                tag = start.lower()
                depth = TABLE_PARTS.get(tag)
                if depth:
                    while open_parts and TABLE_PARTS[tags[open_parts[-1]]] >= depth:
                        part = open_parts[-1]
                        while leave() != part:
                            pass
                parents.append(opened[-1])
                tags.append(tag)
                attributes.append(given)
                begins.append(texts)
                stops.append(texts)
                places[tag].append(number)
                if closed:
                    number += 1
                    ends.append(number)
                    if text:
                        pieces.append(unescape(text) if "&" in text else text)
                        texts += 1
                        if tag not in VOID:
                            stops[-1] = texts
                    if after:
                        pieces.append(unescape(after) if "&" in after else after)
                        texts += 1
                    continue
                if tag not in VOID:
                    opened.append(number)
                    open_tags[tag] += 1
                    if depth is not None:
                        open_parts.append(number)
                number += 1
                ends.append(number)
            elif end:
                tag = end.lower()
                if open_tags.get(tag):
                    while tags[leave()] != tag:
                        pass
            if text:
                if plain:
                    pieces.append(unescape(text) if "&" in text else text)
                    texts += 1
                elif opened[-1] < 0 or tags[opened[-1]] not in ("script", "style"):
                    pieces.append(text)
                    texts += 1
        while len(opened) > 1:
            leave()

    def text(self, number: int | None) -> str | None:
        if number is None:
            return None
        begin, stop = self.begins[number], self.stops[number]
        return self.pieces[begin] if stop == begin + 1 else "".join(self.pieces[begin:stop])

    def attribute(self, number: int, name: str) -> str | None:
        """Value of an attribute; the last of equal names counts."""
        found = self.attributes[number]
        if isinstance(found, str):
            found = self.attributes[number] = attributes_of(found)
        return found.get(name)

    def classes(self, number: int) -> list[str]:
        return (self.attribute(number, "class") or "").split() if self.attributes[number] else []

    def first(self, tag: str, inside: int | None) -> int | None:
        """First descendant of that kind."""
        if inside is None or self.ends[inside] == inside + 1:
            return None
        places = self.places[tag]
        at = bisect_right(places, inside)
        return places[at] if at < len(places) and places[at] < self.ends[inside] else None

    def children(self, tag: str, parent: int) -> Iterator[int]:
        places = self.places[tag]
        for at in range(bisect_right(places, parent), bisect_left(places, self.ends[parent])):
            if self.parents[places[at]] == parent:
                yield places[at]

    def divs_after(self, number: int) -> Iterator[int]:
        """Following siblings that are divs; each step jumps over the whole sibling."""
        parent, places = self.parents[number], self.places["div"]
        stop = self.ends[parent] if parent >= 0 else len(self.tags)
        at = bisect_left(places, self.ends[number])
        while at < len(places) and places[at] < stop:
            if self.parents[places[at]] == parent:
                yield places[at]
                at = bisect_left(places, self.ends[places[at]])
            else:
                at += 1


def _sides(page: Elements) -> list[str]:
    """Names in the two divs after the details heading; the word for an innings is taken out where it is there."""
    seen = set()
    for div in page.places["div"]:
        heading = page.first("span", page.first("span", div))
        if heading is None or heading in seen:
            continue
        seen.add(heading)
        # Of divs around one heading, the outermost that has siblings with names counts.
        if (page.text(heading) or "").strip() != pages.HEADING:
            continue
        for around in _divs_around(page, heading):
            names = [page.text(page.first("span", page.first("span", after))) for after in page.divs_after(around)]
            found = [name.strip().removesuffix(pages.INNINGS_WORD).strip() for name in names if name and name.strip()]
            if len(found) >= 2:
                return found
        return []
    return []


def _divs_around(page: Elements, number: int) -> Iterator[int]:
    above = page.parents[number]
    while above >= 0:
        if page.tags[above] == "div":
            yield above
        above = page.parents[above]


def _cells(page: Elements, row: int) -> list[dict]:
    cells, ends, parents, places = [], page.ends, page.parents, page.places["td"]
    for at in range(bisect_right(places, row), bisect_left(places, ends[row])):
        cell = places[at]
        if parents[cell] != row:
            continue
        if ends[cell] == cell + 1:
            cells.append({"text": page.text(cell), "link": None, "spans": []})
            continue
        link = page.first("a", cell)
        outer = page.first("span", link)
        spans = [page.text(span) for span in (outer, page.first("span", outer)) if span is not None]
        href = page.attribute(link, "href") if link is not None else None
        cells.append({"text": page.text(cell), "link": href, "spans": spans})
    return cells


def _tables(page: Elements, wanted: Collection[str] | None = None) -> list[dict]:
    found = []
    for table in page.places["table"]:
        classes = page.classes(table)
        if wanted is not None and not any(name in classes for name in wanted):
            continue
        parent = page.parents[table]
        rows = [
            {"classes": page.classes(row), "cells": _cells(page, row)}
            for body in page.children("tbody", table)
            for row in page.children("tr", body)
        ]
        inside_div = parent >= 0 and page.tags[parent] == "div"
        found.append({"classes": classes, "inside_div": inside_div, "rows": rows})
    return found


def _details(page: Elements) -> dict[str, str]:
    """Label and value of the children of a profile grid; the first of equal labels counts."""
    values: dict[str, str] = {}
    for grid in page.places["div"]:
        if pages.PROFILE_GRID in page.classes(grid):
            for entry in page.children("div", grid):
                label = page.text(page.first("p", entry))
                if label is not None:
                    values.setdefault(label, page.text(page.first("span", entry)) or "")
    return values


def _about(page: Elements) -> str:
    for div in page.places["div"]:
        if pages.PROFILE_TEXT in page.classes(div):
            return page.text(page.first("p", div)) or ""
    return ""


def read_page(html: str | None, wanted: Collection[str] | None = None) -> dict:
    """What a page holds, with its tables of the classes ``wanted``, or all of them."""
    page = Elements(html or "")
    heads = page.places["h1"]
    return {
        "title": page.text(heads[0]) if heads else None,
        "sides": _sides(page),
        "details": list(_details(page).items()),
        "about": _about(page),
        "tables": _tables(page, wanted),
    }


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """An Arrow array, level by level: a struct from its fields' columns, a list from its values of all rows."""
    if pa.types.is_struct(kind):
        fields = [_column([value[field.name] for value in values], field.type) for field in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind))
    if pa.types.is_list(kind):
        offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
        return pa.ListArray.from_arrays(offsets, _column(list(chain.from_iterable(values)), kind.value_type), type=kind)
    return pa.array(values, kind)


def read_pages(texts: pa.Array, kind: pa.DataType, wanted: Collection[str] | None = None) -> pa.Array:
    """What each page holds as an Arrow struct: plain pages side by side, the others by ``read_page``, a few at a time."""
    trees, left = read_plain(texts, kind, wanted)
    others = np.flatnonzero(left)
    if not others.size:
        return trees
    pieces = [trees]
    for start in range(0, len(others), PAGES_AT_ONCE):
        few = texts.take(pa.array(others[start : start + PAGES_AT_ONCE]))
        pieces.append(_column([read_page(text.as_py(), wanted) for text in few], kind))
    places = np.arange(len(texts))
    places[others] = len(texts) + np.arange(len(others))
    return pa.concat_arrays(pieces).take(pa.array(places))


def _over_pages(df: DataFrame, html: str, keep: Sequence[str], found: str, wanted: Collection[str] | None, made: Callable) -> DataFrame:
    """``keep`` and the columns ``found`` that ``made`` gives for some pages at a time, with the place of each row's page among them."""
    source = df.select(*keep, F.col(html).cast("string").alias("_page"))
    from pyspark.sql.pandas.types import to_arrow_type

    added = StructType.fromDDL(found)
    target = StructType([*source.schema.fields[:-1], *added])
    kind = to_arrow_type(StructType.fromDDL(f"_page {PARSED}")[0].dataType)
    kinds = [to_arrow_type(field.dataType) for field in added]
    names = target.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in in_parts(batch, batch.num_columns - 1):
                places, columns = made(read_pages(few.column(few.num_columns - 1), kind, wanted))
                kept = few.columns[:-1] if places is None else [column.take(places) for column in few.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *[c.cast(k) if c.type != k else c for c, k in zip(columns, kinds, strict=True)]], names=names)

    return source.mapInArrow(read, target)


def parsed(df: DataFrame, html: str, keep: Sequence[str], into: str = "_page", wanted: Collection[str] | None = None) -> DataFrame:
    """``keep`` and one nested column with what the page holds. Pages are parsed some at a time, never held as a group.

    Rows and cells are handed back for tables of the classes ``wanted`` only, if any are given.
    """
    wanted = (wanted,) if isinstance(wanted, str) else wanted
    return _over_pages(df, html, keep, f"{into} {PARSED}", wanted, lambda trees: (None, [trees]))


def _tables_with(name: str) -> Column:
    return F.filter("_page.tables", lambda t: t["inside_div"] & F.array_contains(t["classes"], name))


def _checked(df: DataFrame, html: str, keep: Sequence[str], name: str, minimum: int) -> DataFrame:
    page = parsed(df, html, keep, wanted=[name]).select(*keep, F.col("_page.sides").alias("_sides"), _tables_with(name).alias("_tables"))
    reason = F.when(F.size("_sides") < 2, "no side names").when(F.size("_tables") < minimum, "too few tables")
    return page.withColumn("parse_error", reason)


def batting_pages(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    return _checked(df, html, keep, pages.BATTING_TABLE, 2)


def bowling_pages(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    return _checked(df, html, keep, pages.BOWLING_TABLE, 4)


def _bounds(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _full_rows(trees: pa.StructArray, name: str, minimum: int, pick: Sequence[tuple[int, int]], cells: int, spans: int, fields: Sequence[int]) -> dict:
    """Full rows of the chosen (table, side) pairs of usable pages, as flat columns: the page's place, the row's number in
    its page and in its innings, the title, the side, the player and the link of the first cell, the texts of ``fields``.
    """
    sides, tables = trees.field("sides"), trees.field("tables")
    sides_at, tables_at, every = _bounds(sides), _bounds(tables), tables.values
    classes = every.field("classes")
    own = np.repeat(np.arange(len(every)), np.diff(_bounds(classes)))
    named = np.bincount(own[pc.equal(classes.values, name).to_numpy(zero_copy_only=False)], minlength=len(every)) > 0
    listed = np.flatnonzero(named & every.field("inside_div").to_numpy(zero_copy_only=False))
    first = np.searchsorted(listed, tables_at)
    usable = np.flatnonzero((np.diff(sides_at) >= 2) & (np.diff(first) >= minimum))
    chosen = np.stack([listed[first[usable] + table] for table, _ in pick], 1).ravel()
    side = np.stack([sides_at[usable] + number for _, number in pick], 1).ravel()
    rows_of, rows_at = every.field("rows"), _bounds(every.field("rows"))
    many = rows_at[chosen + 1] - rows_at[chosen]
    row = np.repeat(rows_at[chosen] - np.cumsum(many) + many, many) + np.arange(many.sum())
    innings = np.repeat(np.arange(len(chosen)), many)
    cells_of = rows_of.values.field("cells")
    cells_at = _bounds(cells_of)
    full = cells_at[row + 1] - cells_at[row] >= cells
    innings, cell, page = innings[full], cells_at[row[full]], innings[full] // len(pick)
    number = np.arange(len(cell))
    text, link, inner = (cells_of.values.field(part) for part in ("text", "link", "spans"))
    inner_at = _bounds(inner)
    span = inner_at[cell] + spans - 1
    title = pc.binary_join_element_wise(sides.values.take(sides_at[usable]), sides.values.take(sides_at[usable] + 1), " Vs ")
    return {
        "page": pa.array(usable[page]),
        "seq": pa.array(number - np.searchsorted(page, page)),
        "match": title.take(pa.array(page)),
        "side": sides.values.take(pa.array(side[innings])),
        "place": pa.array(number - np.searchsorted(innings, innings) + 1),
        "player": inner.values.take(pa.array(span, mask=span >= inner_at[cell + 1])),
        "target": link.take(pa.array(cell)),
        "texts": [text.take(pa.array(cell + at)) for at in fields],
    }


def _score_rows(
    df: DataFrame, html: str, keep: Sequence[str], name: str, minimum: int, pick: Sequence[tuple[int, int]], cells: int, spans: int, fields: dict[str, int]
) -> DataFrame:
    """Full rows of the chosen (table, side) pairs, numbered through the page and inside their innings."""
    numbers = [*fields.values()]

    def made(trees: pa.StructArray) -> tuple[pa.Array, list[pa.Array]]:
        found = _full_rows(trees, name, minimum, pick, cells, spans, numbers)
        return found["page"], [*[found[part] for part in ("seq", "match", "side", "place", "player")], *found["texts"]]

    texts = ", ".join(f"`_{n}` string" for n in range(len(fields)))
    found = _over_pages(df, html, keep, f"_seq long, _match string, _side string, _place int, _player string, {texts}", [name], made)
    player = scrub(F.col("_player"), [pages.NO_BREAK_SPACE])
    columns = [F.col("_seq").alias("ingest_seq"), F.col("_match").alias("match"), "_side", "_place", player.alias("_player")]
    return found.select(*keep, *columns, *[F.col(f"_{n}").alias(field) for n, field in enumerate(fields)])


def batting_records(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Like ``pages.batting_records``, with ``ingest_seq`` counting the rows of a page without gaps.

    The name stands in the first cell's link: inside two spans here, inside one in bowling tables.
    """
    return _score_rows(df, html, keep, pages.BATTING_TABLE, 2, BATTING_PICK, 8, 2, pages.BATTING_CELLS).select(
        *keep, "ingest_seq", "match", F.col("_side").alias("teamInnings"), F.col("_place").cast("string").alias("battingPos"),
        F.col("_player").alias("batsmanName"), *pages.BATTING_CELLS, F.when(F.col("_player").isNull(), "no player name").alias("parse_error"),
    )


def bowling_records(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    return _score_rows(df, html, keep, pages.BOWLING_TABLE, 4, BOWLING_PICK, 11, 1, pages.BOWLING_CELLS).select(
        *keep, "ingest_seq", "match", F.col("_side").alias("bowlingTeam"), F.col("_player").alias("bowlerName"),
        *pages.BOWLING_CELLS, F.when(F.col("_player").isNull(), "no player name").alias("parse_error"),
    )


def _fields(numbers: dict[str, int]) -> list[Column]:
    return [F.get("cells", F.lit(i))["text"].alias(name) for name, i in numbers.items()]


def result_records(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Rows of the results tables as seven text fields, with the link in the last of them."""
    listed = F.filter("_page.tables", lambda t: F.array_contains(t["classes"], pages.RESULTS_TABLE))
    rows = F.flatten(F.transform(listed, lambda t: F.filter(t["rows"], lambda r: F.array_contains(r["classes"], pages.RESULTS_ROW))))
    every = parsed(df, html, keep, wanted=[pages.RESULTS_TABLE]).select(*keep, F.posexplode(rows).alias("_seq", "_row"))
    full = every.select(*keep, F.col("_seq").cast("long").alias("ingest_seq"), F.col("_row.cells").alias("cells"))
    link = F.get("cells", F.lit(pages.RESULT_CELLS["scorecard"]))["link"].alias("link")
    return full.where(F.size("cells") >= len(pages.RESULT_CELLS)).select(*keep, "ingest_seq", *_fields(pages.RESULT_CELLS), link)


def player_links(df: DataFrame, html: str, site: str) -> DataFrame:
    """Distinct (name, team, link) over the batting and the bowling tables; each page is parsed once for both."""

    def made(trees: pa.StructArray) -> tuple[pa.Array, list[pa.Array]]:
        batting = _full_rows(trees, pages.BATTING_TABLE, 2, BATTING_PICK, 8, 2, [])
        bowling = _full_rows(trees, pages.BOWLING_TABLE, 4, BOWLING_PICK, 11, 1, [])
        both = {part: pa.concat_arrays([batting[part], bowling[part]]) for part in ("page", "player", "side", "target")}
        return both.pop("page"), [*both.values()]

    people = _over_pages(df, html, [], "name string, team string, target string", [pages.BATTING_TABLE, pages.BOWLING_TABLE], made)
    rows = people.withColumn("name", scrub(F.col("name"), [pages.NO_BREAK_SPACE])).where("name IS NOT NULL AND length(target) > 0")
    return rows.select("name", "team", F.concat(F.lit(site), "target").alias("link")).distinct()


def profile_fields(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Styles, role and description of a profile page; missing ones are empty text."""
    values = [
        F.coalesce(F.element_at("_page.details", F.lit(label)), F.lit("")).alias(name)
        for name, label in pages.PROFILE_LABELS.items()
    ]
    return parsed(df, html, keep).select(*keep, *values, F.col("_page.about").alias("description"))


def titles(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Text of a page's first main heading; NULL where there is none."""
    return parsed(df, html, keep).select(*keep, F.col("_page.title").alias("title"))
