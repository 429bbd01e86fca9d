"""SentencePiece encoding and decoding: a batched Viterbi search in numpy over a given piece model.

A text becomes pieces as the model's own library makes them. Spaces turn into the space mark, one mark goes in front,
and the text is cut where no piece can cross: before a run of marks, and around characters that stand in no longer
piece. Words of equal length advance together, one end position at a time. For every start and length the hash
of the substring is looked up in the sorted hashes of all pieces, and the characters are compared; the best way to each
end keeps its last piece as backpointer, chosen by a maximum over all candidates of all words.

* In a unigram model a way's value is the sum of its pieces' scores; a character without a piece costs ten more
  than the lowest score.
* In a byte-pair model the library merges greedily, which is not the highest sum. But the result is the only way in
  which every two neighbouring pieces stay apart when merged on their own, so the search walks over
  such neighbours only, and each end has one last piece. How each piece merges is noted when the model is read.

Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece if the model has no byte pieces.

Defined results: a null text encodes to null, an empty one to no pieces. Decoding gives the text back, except that a space
mark written in the text itself comes back as a space. Repeated rows, ties and extra columns need no care: each row stands
for itself. An empty table gives an empty table. The model is read on the driver; its arrays, as large as the vocabulary, go
with the tasks. A task remembers a bounded number of words, and takes a bounded number of characters at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyfield.llm.common import free_name, query, table

#: Where the public piece model lies unless another path is given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: kinds of pieces and of models, the space mark, what an unknown piece decodes to.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BYTE_PAIR = 1, 2
MARK, UNKNOWN_SURFACE, UNKNOWN_COST = "▁", " ⁇ ", 10.0
#: Characters of words searched together, of texts split together, of new words learnt together, of texts whose new words are
#: gathered first; words remembered by a task, rows it holds encoded at once.
SEARCH_CHARS, SPLIT_CHARS, LEARN_CHARS, GATHER_CHARS = 1 << 17, 1 << 20, 1 << 21, 1 << 23
REMEMBERED_WORDS, ROWS_AT_ONCE = 200_000, 256
#: Substring hashes are polynomials in this odd base, mod 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = data[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and kinds of a model file, and the search over them."""

    def __init__(self, data: bytes):
        pieces, scores, kinds = [], [], []
        self.kind, self.dummy_prefix = UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                fields = dict(_fields(value))
                pieces.append(fields.get(1, b"").decode())
                scores.append(float(np.frombuffer(fields.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(fields.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                fields = dict(_fields(value))
                if fields.get(2) or fields.get(4, 1) or not fields.get(5, 1):
                    raise ValueError("only models that keep characters and spaces as they are can be used")
                self.dummy_prefix = bool(fields.get(3, 1))
        if self.kind not in (UNIGRAM, BYTE_PAIR):
            raise ValueError("only unigram and byte-pair models can be used")
        self.pieces, self.scores, self.kinds = pieces, np.array(scores), np.array(kinds)
        self.unknown = kinds.index(UNKNOWN)
        octets = {p: i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.byte_ids = [octets[f"<0x{b:02X}>"] for b in range(256)] if len(octets) == 256 else None
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED) and pieces[i]]
        self.longest = max(len(pieces[i]) for i in usable)
        self.rank = {pieces[i]: (-scores[i]) for i in usable}
        self.id_of = {pieces[i]: i for i in usable}
        self.char_cost = float(self.scores[usable].min()) - UNKNOWN_COST
        # sorted keys, and the characters behind each to rule out equal hashes of unequal strings
        self.bigrams = {pieces[i][k : k + 2] for i in usable for k in range(len(pieces[i]) - 1)}
        steps = {pieces[i]: list(self._merging(pieces[i])) for i in usable} if self.kind == BYTE_PAIR else {}
        every = usable
        if self.kind == BYTE_PAIR:  # pieces that greedy merging never ends with are no candidates
            usable = [i for i in usable if len(steps[pieces[i]][-1]) == 1]
        codes = np.zeros((len(usable), self.longest), np.uint32)
        for row, i in enumerate(usable):
            codes[row, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        lengths = np.array([len(pieces[i]) for i in usable])
        keys = self._hashes([pieces[i] for i in usable])
        order = np.argsort(keys, kind="stable")
        self.keys, self.codes, self.lengths = keys[order], codes[order], lengths[order]
        self.ids = np.array(usable)[order]
        self.occurs = np.zeros(1 << 20, bool)  # quick look before the search in the sorted keys
        self.occurs[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        if self.kind == BYTE_PAIR:
            self._note_merging(steps, [pieces[i] for i in every], [pieces[i] for i in self.ids])
        inner = sorted({c for i in usable if len(pieces[i]) > 1 for c in pieces[i]} - {MARK})
        crossing = any(MARK in pieces[i].lstrip(MARK) for i in usable)
        within = "".join(map(re.escape, inner)) or "\\0"
        self.words = re.compile("(?s).+" if crossing else f"(?s){MARK}*[{within}]+|{MARK}+|.")
        surfaces = [p.replace(MARK, " ").encode() for p in pieces]
        for i, k in enumerate(kinds):
            if k == BYTE:
                surfaces[i] = bytes([int(pieces[i][3:5], 16)])
            elif k == CONTROL:
                surfaces[i] = b""
            elif k == UNKNOWN:
                surfaces[i] = UNKNOWN_SURFACE.encode()
        self.surfaces = pa.array(surfaces, pa.large_binary())
        self.bigram_keys = np.unique(np.array([ord(b[0]) << 21 | ord(b[1]) for b in self.bigrams], np.int64))
        self._known: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str = MODEL_PATH) -> PieceModel:
        with open(path, "rb") as file:
            return cls(file.read())

    def _merging(self, text: str) -> Iterator[list[str]]:
        """Steps of merging a short string greedily: the best-scored neighbours first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        yield parts
        while len(parts) > 1:
            ranks = [rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == np.inf:
                return
            at = ranks.index(best)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield parts

    def _hashes(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(max(map(len, strings))):
                inside = np.array([i for i, t in enumerate(strings) if k < len(t)], np.int64)
                out[inside] = out[inside] * BASE + np.array([ord(strings[i][k]) + 1 for i in inside], np.uint64)
        return out

    def _note_merging(self, steps: dict[str, list[list[str]]], every: list[str], usable: list[str]) -> None:
        """How each usable piece is merged: score ranks of its steps, and its outer parts after each step.

        Candidates are numbered as in ``keys``; after them come single characters, for those without a piece.
        """
        characters = sorted({c for p in every for c in p})
        parts = [*usable, *characters]
        number = {p: i for i, p in reversed(list(enumerate(parts)))}
        inner = sorted({x for p in usable for state in steps[p] for x in (state[0], state[-1])} - number.keys())
        number |= {p: len(parts) + k for k, p in enumerate(inner)}
        names = [*parts, *inner]
        depth = max(len(steps[p]) for p in usable)
        self.step_rank = np.full((len(names), depth), np.inf)
        self.outer_left = np.tile(np.arange(len(names))[:, None], (1, depth))
        self.outer_right = self.outer_left.copy()
        for i, p in enumerate(usable):
            for k, state in enumerate(steps[p]):
                self.outer_left[i, k], self.outer_right[i, k] = number[state[0]], number[state[-1]]
                if k + 1 < len(steps[p]):
                    self.step_rank[i, k] = min(self.rank.get(x + y, np.inf) for x, y in zip(state, state[1:], strict=False))
        self.character_place = {c: len(usable) + k for k, c in enumerate(characters)}
        self.name_hash, name_length = self._hashes(names), np.array([len(x) for x in names])
        self.name_power = np.array([pow(int(BASE), int(n), 1 << 64) for n in name_length], np.uint64)
        joined = self._hashes(every)
        order = np.argsort(joined)
        self.joined, self.joined_rank = joined[order], np.array([self.rank[p] for p in every])[order]
        self.joins = np.zeros(1 << 20, bool)
        self.joins[(joined >> np.uint64(44)).astype(np.int64)] = True

    def _joint_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two parts make together, infinite if there is none."""
        with np.errstate(over="ignore"):
            wanted = self.name_hash[left] * self.name_power[right] + self.name_hash[right]
        out = np.full(len(wanted), np.inf)
        some = np.flatnonzero(self.joins[(wanted >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.joined, wanted[some]), len(self.joined) - 1)
        same = self.joined[place] == wanted[some]
        out[some[same]] = self.joined_rank[place[same]]
        return out

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces together ends with these two; a negative number stays alone.

        Both merge as they would alone until their outer parts make a piece that comes before what either does next; of
        equals the leftmost comes first.
        """
        apart = np.ones(len(left), bool)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        i, j = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        while len(rest):
            a, b = left[rest], right[rest]
            cross = self._joint_rank(self.outer_right[a, i], self.outer_left[b, j])
            of_left, of_right = self.step_rank[a, i], self.step_rank[b, j]
            meets = (cross < of_left) & (cross <= of_right) & np.isfinite(cross)
            apart[rest[meets]] = False
            goes_on = ~meets & (np.isfinite(of_left) | np.isfinite(of_right))
            first = of_left <= of_right
            rest, i, j = rest[goes_on], (i + first)[goes_on], (j + ~first)[goes_on]
        return apart

    def _found(self, hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Place among the sorted pieces of the substrings of ``codes`` that start at ``at``, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        rows, columns = np.nonzero(self.occurs[(hashes >> np.uint64(44)).astype(np.int64)])
        wanted = hashes[rows, columns]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[place] == wanted) & (self.lengths[place] == length))
        rows, columns, place = rows[hit], columns[hit], place[hit]
        same = np.ones(len(hit), bool)
        for k in range(length):
            same &= self.codes[place, k] == codes[rows, at[columns] + k]
        out[rows[same], columns[same]] = place[same]
        return out

    def _search(self, words: list[str]) -> list[bytes]:
        """Ids, as 32-bit octets, of words that all have the same length."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length)
        most = min(self.longest, length)
        # characters of the batch without a piece get numbers after the pieces
        strange = np.unique(codes)
        prefix = np.zeros((n, length + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                prefix[:, k + 1] = prefix[:, k] * BASE + (codes[:, k].astype(np.uint64) + np.uint64(1))
            found, power = [None], np.uint64(1)
            for size in range(1, most + 1):
                power = power * BASE
                found.append(self._found(prefix[:, size:] - prefix[:, : length + 1 - size] * power, codes, np.arange(length + 1 - size), size))
        first_strange = len(self.keys)
        single = found[1]
        missing = single < 0
        single[missing] = first_strange + np.searchsorted(strange, codes[missing])
        value = np.full((n, length + 1), -np.inf, np.float32)
        value[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        size_of = np.ones((n, length + 1), np.int64)
        pair_mode = self.kind == BYTE_PAIR
        if pair_mode:  # a character in no piece at all meets nothing
            places = np.concatenate([np.arange(first_strange), [self.character_place.get(chr(c), -1) for c in strange]]).astype(np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(min(most, end), 0, -1)  # of equal values the longest last piece wins
            piece = np.stack([found[s][:, end - s] for s in sizes], axis=1).astype(np.int64)
            before = value[:, end - sizes]
            open_ = (piece >= 0) & np.isfinite(before)
            if pair_mode:
                # exactly one last piece is right, so a row's only candidate needs no test
                left = open_.sum(axis=1)
                for column, size in enumerate(sizes):
                    rows = np.flatnonzero(open_[:, column] & (left > 1))
                    if len(rows) and size < end:
                        stays = self._stay_apart(places[last[rows, end - size]], places[piece[rows, column]])
                        open_[rows[~stays], column] = False
                        left[rows[~stays]] -= 1
                        rows = rows[stays]
                    open_[rows, column + 1 :] = False
                    left[rows] = 1
                gain = np.zeros(piece.shape, np.float32)
            else:
                ordinary = piece < first_strange
                gain = np.where(ordinary, self.scores[self.ids[np.where(ordinary, np.maximum(piece, 0), 0)]], self.char_cost)
            total = np.where(open_, before + gain.astype(np.float32), np.float32(-np.inf))
            best = total.argmax(axis=1)
            rows = np.arange(n)
            value[:, end], last[:, end], size_of[:, end] = total[rows, best], piece[rows, best], sizes[best]
        ids = np.zeros((n, length), np.int64)
        numbers, rows, ends = np.zeros(n, np.int64), np.arange(n), np.full(n, length)
        named = np.concatenate([self.ids, -1 - strange.astype(np.int64)])
        while len(rows):
            ids[rows, length - 1 - numbers[rows]] = named[last[rows, ends]]
            numbers[rows] += 1
            ends = ends - size_of[rows, ends]
            rows, ends = rows[ends > 0], ends[ends > 0]
        plain = (ids >= 0).all(axis=1)
        octets, width = ids.astype("<i4").tobytes(), 4 * length
        return [
            octets[(w + 1) * width - 4 * m : (w + 1) * width] if easy else self._spelled(ids[w, length - m :].tolist())
            for w, (m, easy) in enumerate(zip(numbers.tolist(), plain.tolist(), strict=True))
        ]

    def _spelled(self, ids: list[int]) -> bytes:
        """Characters without a piece (negative) become bytes if the model has byte pieces."""
        if self.byte_ids is not None:
            ids = [j for i in ids for j in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")])]
        return np.array(ids, "<i4").tobytes()

    def _unknown_runs(self, ids: np.ndarray) -> np.ndarray:
        """One unknown piece for each run of characters without a piece."""
        flat = np.where(ids >= 0, ids, self.unknown)
        return flat[~((flat == self.unknown) & (np.concatenate([[-1], flat[:-1]]) == self.unknown))].astype("<i4")

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``, cut further where no piece holds the two characters side by side."""
        if not words:
            return
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        opens = np.ones(len(codes), bool)
        for begin in range(0, len(codes) - 1, SEARCH_CHARS):  # in portions, for the sake of memory
            some = codes[begin : begin + SEARCH_CHARS + 1].astype(np.int64)
            pairs = some[:-1] << 21 | some[1:]
            at = np.minimum(np.searchsorted(self.bigram_keys, pairs), len(self.bigram_keys) - 1)
            opens[begin + 1 : begin + 1 + len(pairs)] = self.bigram_keys[at] != pairs
        firsts = np.cumsum([0, *map(len, words)])
        opens[firsts[:-1]] = True
        borders = np.concatenate([np.flatnonzero(opens), [len(codes)]])
        first_part = np.searchsorted(borders, firsts).tolist()
        parts = [text[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        by_length: dict[int, set[str]] = {}
        for part in parts:
            if part not in self._known:
                by_length.setdefault(len(part), set()).add(part)
        for length, group in by_length.items():
            group, step = list(group), max(1, SEARCH_CHARS // length)
            for begin in range(0, len(group), step):
                batch = group[begin : begin + step]
                self._known.update(zip(batch, self._search(batch), strict=True))
        for w, a, b in zip(words, first_part, first_part[1:], strict=False):
            if b > a + 1:
                self._known[w] = b"".join([self._known[part] for part in parts[a:b]])

    def _split(self, text: str | None) -> list[str]:
        marked = (text or "").replace(" ", MARK)
        return self.words.findall(MARK + marked if marked and self.dummy_prefix else marked)

    def gather(self, slices: Iterable[list[str | None]]) -> None:
        """Learn the words of many texts together, since the search costs least over many words of one length.

        Texts are split again when they are encoded, so that no more than one slice's words are held in order. If too many words
        are remembered, those that these texts do not use are forgotten.
        """
        seen: set[str] = set()
        for texts in slices:
            for text in texts:
                seen.update(self._split(text))
        if len(self._known) > REMEMBERED_WORDS:
            self._known = {w: self._known[w] for w in seen if w in self._known}
        new, chars = [], 0
        for word in seen:
            if word not in self._known:
                new.append(word)
                chars += len(word)
                if chars > LEARN_CHARS:
                    self._learn(new)
                    new, chars = [], 0
        self._learn(new)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece ids of each text."""
        out: list[np.ndarray | None] = []
        begin = 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars + len(texts[end] or "") <= SPLIT_CHARS):
                chars += len(texts[end] or "")
                end += 1
            split = [self._split(text) for text in texts[begin:end]]
            known = self._known
            self._learn(list({w for words in split for w in words if w not in known}))
            for text, words in zip(texts[begin:end], split, strict=True):
                ids = np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")
                if self.byte_ids is None:
                    ids = self._unknown_runs(ids)
                out.append(None if text is None else ids)
            begin = end
        return out

    def decode_all(self, ids: list[np.ndarray | None]) -> list[str | None]:
        """The texts of many lists of ids, whose surfaces are taken from one table together."""
        sizes = [0 if i is None else len(i) for i in ids]
        flat = np.concatenate([np.zeros(0, np.int64), *(i for i in ids if i is not None)]).astype(np.int64)
        taken = self.surfaces.take(pa.array(flat))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.cumsum([0, *sizes])].tolist()
        octets = memoryview(taken.buffers()[2] or b"")
        out: list[str | None] = []
        for i, begin, end in zip(ids, ends, ends[1:], strict=False):
            text = str(octets[begin:end], "utf-8", "replace")
            out.append(None if i is None else text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out

    def decode(self, ids: np.ndarray | list[int] | None) -> str | None:
        return self.decode_all([None if ids is None else np.asarray(ids, np.int64)])[0]


def _portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of few rows, together at most ``GATHER_CHARS`` octets of text, or one row."""
    for batch in batches:
        portion, chars, begin = [], 0, 0
        while begin < batch.num_rows:
            part = batch.slice(begin, ROWS_AT_ONCE)
            size = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if portion and chars + size > GATHER_CHARS:
                yield portion
                portion, chars = [], 0
            portion.append(part)
            chars, begin = chars + size, begin + ROWS_AT_ONCE
        if portion:
            yield portion


def _encoded_slices(batches: Iterator[pa.RecordBatch], text: int, model: PieceModel) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Each slice with its texts and their ids."""
    for portion in _portions(batches, text):
        model.gather(part.column(text).to_pylist() for part in portion)
        for part in portion:
            texts = part.column(text).to_pylist()
            yield part, texts, model.encode(texts)


def encoded(docs: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """``docs`` with piece_ids (array of int) and decoded (the ids turned back into text); names are freed if taken."""
    model = model or PieceModel.read()
    names = [free_name(docs, "piece_ids"), free_name(docs, "decoded")]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, ids in _encoded_slices(batches, at, model):
            lists = pa.array(ids, pa.list_(pa.int32()))
            texts = pa.array(model.decode_all(ids), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())])
    return docs.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """doc_id, n_pieces, piece_ids, SHA-256 of the text and of the decoded text, and whether they are equal."""
    model = model or PieceModel.read()

    def digest(text: str | None) -> str | None:
        return None if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, ids in _encoded_slices(batches, 1, model):
            decoded = model.decode_all(ids)
            columns = [
                batch.column(0),
                pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(map(digest, texts), pa.string()),
                pa.array(map(digest, decoded), pa.string()),
                pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "piece_ids", "text_sha256", "decoded_sha256", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "n_pieces long, piece_ids array<int>, text_sha256 string, decoded_sha256 string, same boolean"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return round_trips(table(spark, folder, "documents"))
