"""Element trees of many plain pages at once, as arrays: no Python object for a tag, a row or a cell.

Tags are found by their brackets, names are read as numbers of eight octets, and all pages of a batch are walked side by
side, the next tag of each in one step. What is found is what ``elements.read_page`` finds; pages that it is not
made for are named and left to that: stray brackets, comments, bare values, elements that hold raw text, names of over
eight letters, elements more than ``LEVELS`` deep, profile pages, and the longest pages of a batch, which few others keep company.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Collection, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyfield.sources import pages

# Elements without content, elements that hold text only, and how deep the parts of a table lie.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
TABLE_PARTS = {"table": 0, "thead": 1, "tbody": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3}
#: Parts of a plain tag; attributes are quoted and no part is tried twice.
NAME, GAP, VALUE = "[A-Za-z][A-Za-z0-9]*+", r"[ \t\n\r\f]", """(?:"[^"<>]*+"|'[^'<>]*+')"""
GIVEN = f"(?:{GAP}++[A-Za-z][A-Za-z0-9_:-]*+={VALUE})*+"
ATTRIBUTE = re.compile("""([A-Za-z][A-Za-z0-9_:-]*+)=(?:"([^"]*+)"|'([^']*+)')""")

#: Pages walked side by side and octets of them at most, the fewest worth a step, elements open at once.
PAGES, OCTETS, FEWEST, LEVELS = 4096, 1 << 23, 8, 64

_REST, _SPACE = re.compile(f"{GIVEN}{GAP}*+/?".encode()), re.compile(f"{GAP}*+".encode())
_LETTERS = 8
_NAMED = np.zeros(256, np.uint64)
for _code in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _NAMED[_code] = _NAMED[ord(chr(_code).upper())] = _code


_UP_TO = np.array([(1 << 8 * n) - 1 for n in range(_LETTERS)], np.uint64)
#: References to characters, as ``unescape`` finds them.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _key(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(name.encode(), "little"))


_PARTS = [(_key(name), depth) for name, depth in TABLE_PARTS.items()]
_VOID, _RAW = np.array([_key(name) for name in VOID]), np.array([_key(name) for name in RAW_TEXT if len(name) <= _LETTERS])
_FREQUENT = [_key(name) for name in ("a", "div", "p", "span", "strong", "table", "tbody", "td", "tr")]
_A, _DIV, _SPAN, _TABLE, _TBODY, _TR, _TD, _H1 = [_key(name) for name in ("a", "div", "span", "table", "tbody", "tr", "td", "h1")]


def attributes_of(given: str) -> dict[str, str]:
    """Attributes of a plain tag by their names in lower case; the last of equal names counts."""
    return {key.lower(): unescape(one or other) for key, one, other in ATTRIBUTE.findall(given)}


_character = lru_cache(4096)(unescape)


def _resolved(text: str) -> str:
    return _REFERENCE.sub(lambda found: _character(found[0]), text)


@lru_cache(4096)
def _classes(given: bytes) -> list[str]:
    return attributes_of(given.decode()).get("class", "").split()


def _href(given: bytes) -> str | None:
    if given[:7] == b' href="' and given[-1:] == b'"' and given.count(b'"') == 2:
        value = given[7:-1].decode()
        return unescape(value) if "&" in value else value
    return attributes_of(given.decode()).get("href")


def _listed(counts: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, type=kind)


class Pages:
    """Elements of the plain pages of ``texts``; the others are marked in ``left``."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.bounds, self.left = bounds - bounds[0], np.diff(bounds) > OCTETS
        # Eight more octets, so that a name is read from any of them.
        self.octets = np.zeros(self.bounds[-1] + _LETTERS, np.uint8)
        self.octets[:-_LETTERS] = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        self._find_tags()
        self._name_tags()
        self._walk()
        self._cut_texts()
        self._number()

    def _find_tags(self) -> None:
        marks = np.flatnonzero((self.octets | 2) == ord(">"))  # the brackets differ in that bit
        first = np.searchsorted(marks, self.bounds)
        page = np.repeat(np.arange(len(self.left)), np.diff(first))
        turns = (np.arange(len(marks)) - first[page]) % 2 == 0
        self.left[page[(self.octets[marks] == ord("<")) != turns]] = True
        self.left |= np.diff(first) % 2 == 1
        kept = ~self.left[page]
        self.starts, self.stops, self.page = marks[kept][::2], marks[kept][1::2], page[kept][::2]

    def _name_tags(self) -> None:
        octets, tags = self.octets, len(self.starts)
        self.ending = octets[self.starts + 1] == ord("/")
        begins = self.starts + 1 + self.ending
        lengths = self.stops - begins
        words = np.ndarray(len(octets) - _LETTERS, "<u8", octets, strides=(1,))[begins]
        self.keys = np.where(lengths < _LETTERS, words & _UP_TO[np.minimum(lengths, _LETTERS - 1)], np.uint64(0))
        rare = np.ones(tags, bool)
        for key in _FREQUENT:
            rare &= self.keys != key
        rare = np.flatnonzero(rare)
        self.keys[rare], lengths[rare] = 0, 0
        odd = np.zeros(tags, bool)
        odd[rare] = octets[begins[rare]] < ord("A")
        alive = rare
        for n in range(_LETTERS + 1):
            letters = _NAMED[octets[begins[alive] + n]]
            alive, letters = alive[letters != 0], letters[letters != 0]
            if n < _LETTERS:
                self.keys[alive] |= letters << np.uint64(8 * n)
                lengths[alive] += 1
        odd[alive] = True
        odd |= lengths == 0
        self.given: dict[int, bytes] = {}
        rests = begins + lengths
        more = rare[rests[rare] < self.stops[rare]]
        for tag, begin, stop, ending in zip(more.tolist(), rests[more].tolist(), self.stops[more].tolist(), self.ending[more].tolist(), strict=True):
            rest = octets[begin:stop].tobytes()
            if not (_SPACE if ending else _REST).fullmatch(rest):
                odd[tag] = True
            elif not ending:
                self.given[tag] = rest
        self.has_given = np.zeros(tags, bool)
        self.has_given[list(self.given)] = True
        self.void = np.zeros(tags, bool)
        self.void[rare] = np.isin(self.keys[rare], _VOID)
        odd[rare] |= np.isin(self.keys[rare], _RAW) & ~self.ending[rare]
        self.left[self.page[odd]] = True

    def _walk(self) -> None:
        """``above`` and ``closed``: the tags that open the element around a tag's element and that end it, -1 without one.

        Each step reads one tag of every page that has one left, or two where the next one ends what the first begins; more
        such pairs of that name right after it lie beside the first and are not read.
        """
        self.firsts = np.searchsorted(self.page, np.arange(len(self.left) + 1))
        leaf = ~self.ending & ~self.void
        leaf[:-1] &= self.ending[1:] & (self.keys[1:] == self.keys[:-1]) & (self.page[1:] == self.page[:-1])
        leaf[-1:] = False
        beside = leaf.copy()
        beside[:2] = False
        beside[2:] &= leaf[:-2] & (self.keys[2:] == self.keys[:-2]) & (self.page[2:] == self.page[:-2])
        read = ~self.left[self.page] & ~beside
        read[1:] &= ~leaf[:-1]
        many = np.bincount(self.page[read], minlength=len(self.left))
        longest = np.sort(many)[::-1]
        steps = min(int(longest[0]), 2 * int(longest[FEWEST - 1])) if len(many) >= FEWEST else 0
        self.left |= many > steps
        many[self.left] = 0
        read = np.flatnonzero(read & ~self.left[self.page])
        # Tags in the order of the steps, within one by the length of their pages, so that a step reads a slice.
        order = np.argsort(-many, kind="stable")
        rank = np.empty(len(many), np.int64)
        rank[order] = np.arange(len(many))
        width = np.searchsorted(-many[order], -np.arange(steps), "left")
        borders = np.concatenate([[0], np.cumsum(width)])
        page = self.page[read]
        tags = np.empty(len(read), np.int64)
        tags[borders[np.arange(len(read)) - np.searchsorted(page, page)] + rank[page]] = read
        part = np.full(len(self.keys), -1, np.int8)
        for name, depth in _PARTS:
            part[self.keys == name] = depth
        all_names, all_parts, all_ending = self.keys[tags], part[tags], self.ending[tags]
        all_closing, all_opening = ~all_ending & (all_parts > 0), ~(self.ending | leaf | self.void)[tags]
        above, closed = np.full(len(tags), -1, np.int32), np.full(len(tags), -1, np.int32)
        # Level 0 is the page itself. Of each open element: its number among the tags, its name, how deep a table part it
        # is, and the level of the innermost table part up to there; a level of all pages is one stretch.
        wide = int(width[0]) if steps else 0
        stack = (LEVELS + 1) * wide
        opened, names = np.full(stack, -1, np.int32), np.zeros(stack, np.uint64)
        depths, inner_part = np.full(stack, -1, np.int8), np.zeros(stack, np.int32)
        height, deep, pages_ = np.zeros(wide, np.int32), np.zeros(wide, bool), np.arange(wide, dtype=np.int32)
        for begin, stop in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            now = stop - begin
            name, depth, top = all_names[begin:stop], all_parts[begin:stop], height[:now]
            goal = top.copy()
            # Cells, rows and bodies end where the next one begins.
            closing = np.flatnonzero(all_closing[begin:stop])
            inner = inner_part[top[closing] * wide + closing]
            while (over := depths[inner * wide + closing] >= depth[closing]).any():
                closing, inner = closing[over], inner[over]
                goal[closing] = inner - 1
                inner = inner_part[(inner - 1) * wide + closing]
            # An end tag ends the innermost element of its name and all inside it.
            ends = np.flatnonzero(all_ending[begin:stop] & (top > 0))
            hit = names[top[ends] * wide + ends] == name[ends]
            goal[ends[hit]] -= 1
            missed = ends[~hit]
            if missed.size:
                high = int(top[missed].max())
                levels = np.arange(high, 0, -1)[:, None]
                same = (names[levels * wide + missed] == name[missed]) & (levels <= top[missed])
                found = same.any(0)
                goal[missed[found]] = high - 1 - np.argmax(same[:, found], 0)
            popped = np.flatnonzero(goal < top)
            level = top[popped]
            while popped.size:
                closed[opened[level * wide + popped]] = popped + begin
                level = level - 1
                more = level > goal[popped]
                popped, level = popped[more], level[more]
            above[begin:stop] = opened[goal * wide + pages_[:now]]
            begun = np.flatnonzero(all_opening[begin:stop])
            level = goal[begun] + 1
            if (level > LEVELS).any():
                deep[begun[level > LEVELS]] = True
                begun, level = begun[level <= LEVELS], level[level <= LEVELS]
            goal[begun] = level
            height[:now] = goal
            at, depth = level * wide + begun, depth[begun]
            opened[at], names[at], depths[at] = begun + begin, name[begun], depth
            inner_part[at] = np.where(depth >= 0, level, inner_part[at - wide])
        self.left[order[:wide][deep]] = True
        self.above, self.closed = np.full(len(self.keys), -1), np.where(leaf, np.arange(len(leaf)) + 1, -1)
        self.above[tags] = np.where(above >= 0, tags[above], -1)
        leading = np.maximum.accumulate(np.where(leaf & ~beside, np.arange(len(leaf)), 0))
        self.above[beside] = self.above[leading[beside]]
        ended = np.flatnonzero(closed >= 0)
        self.closed[tags[ended]] = tags[closed[ended]]

    def _cut_texts(self) -> None:
        """All text, tags out and references resolved piece by piece; ``places`` are where each page's and each tag's text begins in it."""
        octets, count = self.octets, len(self.left)
        begins = np.insert(self.stops + 1, self.firsts[:-1], self.bounds[:-1])
        stops = np.insert(self.starts, self.firsts[1:], self.bounds[1:])
        stops = np.where(self.left[np.insert(self.page, self.firsts[:-1], np.arange(count))], begins, stops)
        signs = np.flatnonzero(octets == ord("&"))
        piece = np.searchsorted(begins, signs, "right") - 1
        piece = piece[signs < stops[piece]]
        coded = piece[np.diff(piece, prepend=-1) > 0]
        whole = octets.tobytes()
        resolved = [_resolved(whole[b:e].decode()).encode() for b, e in zip(begins[coded].tolist(), stops[coded].tolist(), strict=True)]
        lengths = stops - begins
        lengths[coded] = [len(text) for text in resolved]
        begins[coded] = len(octets) + np.cumsum(lengths[coded]) - lengths[coded]
        self.places = np.concatenate([[0], np.cumsum(lengths)])
        source = np.frombuffer(whole + b"".join(resolved), np.uint8)
        self.text = source[np.repeat(begins - self.places[:-1], lengths) + np.arange(self.places[-1])]

    def _number(self) -> None:
        """Elements by number in page order: name, page, the element around it, the number after its last descendant, its text."""
        chosen = ~self.ending & ~self.left[self.page]
        before = np.concatenate([[0], np.cumsum(chosen)])
        self.tags = tags = np.flatnonzero(chosen)
        self.names, self.pages, above, closed = self.keys[tags], self.page[tags], self.above[tags], self.closed[tags]
        self.parents = np.where(above >= 0, before[above], -1)
        after, void, last = self.pages + 1, self.void[tags], closed < 0
        self.ends = np.where(void, np.arange(len(tags)) + 1, np.where(last, before[self.firsts[after]], before[closed]))
        own = tags + self.pages + 1
        self.begins = self.places[own]
        stops = self.places[np.where(last, self.firsts[after] + after, closed + self.pages + 1)]
        self.until = np.where(void, self.begins, stops)

    def of(self, name: np.uint64) -> np.ndarray:
        return np.flatnonzero(self.names == name)

    def first(self, places: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """First of the elements ``places`` inside each of the others; -1 without one, and where that is -1 itself."""
        at = np.searchsorted(places, inside, "right")
        found = np.append(places, len(self.tags))[at]
        return np.where((inside >= 0) & (found < self.ends[inside]), found, -1) if len(inside) else inside

    def string(self, number: int) -> str:
        return self.text[self.begins[number] : self.until[number]].tobytes().decode()

    def strings(self, numbers: np.ndarray) -> pa.Array:
        begins, lengths = self.begins[numbers], self.until[numbers] - self.begins[numbers]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        octets = self.text[np.repeat(begins - bounds[:-1], lengths) + np.arange(bounds[-1])]
        return pa.LargeStringArray.from_buffers(len(numbers), pa.py_buffer(bounds), pa.py_buffer(octets)).cast(pa.string())

    def classes(self, numbers: np.ndarray) -> list[list[str]]:
        found: list[list[str]] = [[]] * len(numbers)
        tags = self.tags[numbers]
        with_given = np.flatnonzero(self.has_given[tags])
        for at, tag in zip(with_given.tolist(), tags[with_given].tolist(), strict=True):
            found[at] = _classes(self.given[tag])
        return found

    def leave_profiles(self) -> None:
        """Pages with the parts of a profile are left."""
        divs = self.of(_DIV)
        divs = divs[self.has_given[self.tags[divs]]]
        wanted = {pages.PROFILE_GRID, pages.PROFILE_TEXT}
        for number, classes in zip(divs.tolist(), self.classes(divs), strict=True):
            if not wanted.isdisjoint(classes):
                self.left[self.pages[number]] = True

    def titles(self, kind: pa.DataType) -> pa.Array:
        heads = self.of(_H1)
        which, at = np.unique(self.pages[heads], return_index=True)
        title = np.full(len(self.left), -1)
        title[which] = np.arange(len(which))
        return self.strings(heads[at]).take(pa.array(title, mask=title < 0)).cast(kind)

    def sides(self) -> list[list[str]]:
        """As ``elements._sides``, for all pages; names are looked at beside the details headings only."""
        found: list[list[str]] = [[] for _ in self.left]
        divs, spans = self.of(_DIV), self.of(_SPAN)
        inner = self.first(spans, self.first(spans, divs))
        seen = np.unique(inner[inner >= 0])
        at = np.array([found.start() for found in re.finditer(re.escape(pages.HEADING).encode(), self.text.tobytes())], np.int64)
        seen = seen[np.searchsorted(at, self.begins[seen]) < np.searchsorted(at, self.until[seen])]
        headings = [number for number in seen.tolist() if self.string(number).strip() == pages.HEADING]
        which, at = np.unique(self.pages[divs[hits := np.isin(inner, headings)]], return_index=True)
        # Divs by the element around them; those of equal ones in page order. Pages stand for the missing elements.
        around = np.where(self.parents[divs] >= 0, self.parents[divs], -1 - self.pages[divs]) + len(self.left)
        size = len(self.tags) + 1
        order = np.argsort(around * size + divs)
        siblings, inner_of = (around * size + divs)[order].tolist(), inner[order].tolist()
        for page, heading in zip(which.tolist(), inner[hits][at].tolist(), strict=True):
            above = int(self.parents[heading])
            while above >= 0:
                if self.names[above] == _DIV:
                    parent = int(self.parents[above])
                    group = (parent if parent >= 0 else -1 - page) + len(self.left)
                    after, stop = bisect_left(siblings, group * size + int(self.ends[above])), bisect_left(siblings, (group + 1) * size)
                    names = [self.string(n) for n in inner_of[after:stop] if n >= 0]
                    names = [name.strip().removesuffix(pages.INNINGS_WORD).strip() for name in names if name.strip()]
                    if len(names) >= 2:
                        found[page] = names
                        break
                above = int(self.parents[above])
        return found

    def _members(self, name: np.uint64, groups: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements of that name in the order of their groups, and how many each group has; ``around`` gives an element's group element."""
        rank = np.full(len(self.tags) + 1, -1)
        rank[groups] = np.arange(len(groups))
        numbers = self.of(name)
        place = rank[around[numbers]]
        numbers, place = numbers[place >= 0], place[place >= 0]
        return numbers[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(groups))

    def tables(self, kind: pa.DataType, wanted: Collection[str] | None) -> pa.Array:
        table_kind = kind.value_type
        row_kind = table_kind.field("rows").type
        cell_kind = row_kind.value_type.field("cells").type
        tables = self.of(_TABLE)
        classes = self.classes(tables)
        if wanted is not None:
            chosen = [n for n, own in enumerate(classes) if not set(own).isdisjoint(wanted)]
            tables, classes = tables[chosen], [classes[n] for n in chosen]
        body = np.where((self.parents >= 0) & (self.names[self.parents] == _TBODY), self.parents, -1) if len(self.tags) else self.parents
        table_of_row = np.where(body >= 0, self.parents[body], -1) if len(self.tags) else body
        rows, rows_in = self._members(_TR, tables, table_of_row)
        cells, cells_in = self._members(_TD, rows, self.parents)
        links = self.first(self.of(_A), cells)
        outer = self.first(spans := self.of(_SPAN), links)
        both = np.column_stack([outer, self.first(spans, outer)])
        linked = np.flatnonzero(links >= 0)
        hrefs = [_href(self.given[tag]) if tag in self.given else None for tag in self.tags[links[linked]].tolist()]
        at = np.full(len(cells), -1)
        at[linked] = np.arange(len(linked))
        text, link, spans_kind = (cell_kind.value_type.field(name).type for name in ("text", "link", "spans"))
        columns = {
            "text": self.strings(cells).cast(text),
            "link": pa.array(hrefs, link).take(pa.array(at, mask=at < 0)),
            "spans": _listed((both >= 0).sum(1), self.strings(both[both >= 0]), spans_kind),
        }
        made = _listed(cells_in, _struct(columns, cell_kind.value_type), cell_kind)
        class_kind = row_kind.value_type.field("classes").type
        made = _struct({"classes": pa.array(self.classes(rows), class_kind), "cells": made}, row_kind.value_type)
        parents = self.parents[tables]
        inside = (parents >= 0) & (self.names[parents] == _DIV) if len(tables) else np.zeros(0, bool)
        columns = {"classes": pa.array(classes, class_kind), "inside_div": pa.array(inside), "rows": _listed(rows_in, made, row_kind)}
        return _listed(np.bincount(self.pages[tables], minlength=len(self.left)), _struct(columns, table_kind), kind)


def _struct(columns: dict[str, pa.Array], kind: pa.StructType) -> pa.Array:
    return pa.StructArray.from_arrays([columns[field.name] for field in kind], fields=list(kind))


def in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``PAGES`` rows and ``OCTETS`` octets of text, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + PAGES, int(np.searchsorted(ends, done + OCTETS, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def read_plain(texts: pa.Array, kind: pa.StructType, wanted: Collection[str] | None) -> tuple[pa.Array, np.ndarray]:
    """What the pages hold, as ``elements.parsed`` hands it back, and which of them are left to the other reader."""
    found = Pages(texts)
    found.leave_profiles()
    size = len(texts)
    columns = {
        "title": found.titles(kind.field("title").type),
        "sides": pa.array(found.sides(), kind.field("sides").type),
        "details": pa.array([[]] * size, kind.field("details").type),
        "about": pa.array([""] * size, kind.field("about").type),
        "tables": found.tables(kind.field("tables").type, wanted),
    }
    return _struct(columns, kind), found.left
