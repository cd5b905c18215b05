"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``compiled`` reads a model file into three machines and keeps them as arrays of states and arcs:

* the normaliser: states for the text's start, inside it and after a space; arcs read a space or another character and write word marks
  (dummy prefix, extra white space as the model says);
* the lexicon: one state for each prefix of a piece (a trie), an arc for each next character, and on the arc that completes a piece its
  id and weight, back to the start state;
* the bytes: from the start state, for a character that is no piece, arcs that write its UTF-8 bytes' pieces (or the unknown piece) at
  the weight ``FALLBACK``.

A text goes through the normaliser, is cut into units that no piece can span (user-defined pieces are units of their own, found first,
the longest one), and each unit is composed with lexicon and bytes: the states of the product are (place in the unit, lexicon state), followed
from the left, and the tropical-semiring shortest path from the unit's start to its end gives the ids.

For a unigram model an arc weighs minus its piece's score.  A BPE model's ids are not its best-scoring path; there the product is composed with one
more machine, whose states are the last piece and whose arcs weigh nothing if merging the two pieces' text, best score first, gives
just those two pieces, and infinity if not.  Such a path is the merge result itself.  Its arcs are made when first met, and kept.

A null or empty text has no ids.  Text that holds the word mark itself encodes, but decodes with a space there.  In decoding, control
pieces are empty and the unknown piece is ``UNKNOWN_TEXT``.  Models with a character map other than identity are refused.  Rows are
encoded alone; repeated rows give equal results; null doc_ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
INFINITE = float("inf")
UNIGRAM, BPE = 1, 2  # the model file's own numbers
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
FOLLOWERS = ".,;:!?"
UNKNOWN_TEXT = " \u2047 "
FALLBACK = 1e4
START, INSIDE, SPACE = 0, 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, raw[at : at + size]
            at += size


def normaliser(prefix: bool, extra: bool) -> dict[tuple[int, bool], tuple[str, bool, int]]:
    """(state, whether a space is read) -> (what is written, whether the character itself follows, next state); every state is final."""
    first = MARK if prefix else ""
    if extra:  # white space is written once, before what follows it; none at either end
        arcs = {(START, True): ("", False, START), (INSIDE, True): ("", False, SPACE), (SPACE, True): ("", False, SPACE), (SPACE, False): (MARK, True, INSIDE)}
    else:
        arcs = {(START, True): (first + MARK, False, INSIDE), (INSIDE, True): (MARK, False, INSIDE)}
    return arcs | {(START, False): (first, True, INSIDE), (INSIDE, False): ("", True, INSIDE)}


def trie(pieces: dict[str, int]) -> tuple[list[dict[str, int]], list[int]]:
    """(arcs of each state by character, the piece that each state completes or -1); state 0 is the start."""
    arcs, final = [{}], [-1]
    for text, piece in pieces.items():
        state = 0
        for c in text:
            after = arcs[state].get(c)
            if after is None:
                after = arcs[state][c] = len(arcs)
                arcs.append({})
                final.append(-1)
            state = after
        final[state] = piece
    return arcs, final


class Transducer:
    def __init__(self, raw: bytes):
        self.pieces: dict[str, int] = {}
        self.text, self.score, self.kinds, self.bytes_ = [], [], [], {}
        self.kind, self.unknown, self.prefix, self.extra, self.escape = UNIGRAM, 0, True, True, True
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
                at = len(self.text)
                self.text.append(text)
                self.kinds.append(kind)
                self.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                if kind in (NORMAL, USER):
                    self.pieces[text] = at
                elif kind == BYTE:
                    self.bytes_[int(text[3:5], 16)] = at
                elif kind == UNKNOWN:
                    self.unknown = at
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.extra, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.normal_arcs = normaliser(self.prefix, self.extra)
        self.space = MARK if self.escape else " "
        self.arcs, self.final = trie(self.pieces)
        self.fallback = {v: k for k, v in self.bytes_.items()}
        users = sorted((p for p, i in self.pieces.items() if self.kinds[i] == USER), key=len, reverse=True)
        self.users = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users else None
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cut_words = not any(inner.search(p) for p in self.pieces)
        after = {c for p in self.pieces for a, c in zip(p, p[1:]) if a.isalpha()}  # noqa: B905
        self.marks = "".join(c for c in FOLLOWERS if c not in after)  # no piece has one of these after a letter
        self.cut_lines = not any("\n" in p for p in self.pieces)
        self.pairs: dict[tuple[int, int], float] = {}
        self.memo = common.WordMemo(self._unit, 600_000)

    # --- normaliser
    def normalised(self, text: str) -> str:
        """The text through the normaliser; runs of one kind of character, where the state stays, are followed at once."""
        state, out, arcs = START, [], self.normal_arcs
        runs = text.split(" ")
        for i, run in enumerate(runs):
            if i:
                written, _, state = arcs[state, True]
                out.append(written)
            if run:
                written, _, state = arcs[state, False]
                out += (written, run)
        found = "".join(out)
        return found if self.escape else found.replace(MARK, " ")

    def units(self, text: str) -> list[str]:
        """Parts that no piece spans: a user-defined piece; a run of word marks and what follows it; a line's end."""
        if self.users:
            return [x for part in self.users.split(text) if part for x in ([part] if self.users.fullmatch(part) else self._units(part))]
        return self._units(text)

    def _units(self, text: str) -> list[str]:
        if not self.cut_words:
            return [text]
        if "\0" in text or MARK * 2 in text:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)
        text = text.replace(MARK, "\0" + MARK)
        return (text.replace("\n", "\0\n\0") if self.cut_lines else text).split("\0")

    # --- lexicon, context and shortest path
    def merged(self, text: str) -> list[str]:
        """A short text's symbols after merging: best piece first, leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = -INFINITE, -1
            for i in range(len(symbols) - 1):
                piece = self.pieces.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.score[piece] > best:
                    best, at = self.score[piece], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def weight(self, last: int, piece: int) -> float:
        """Of the arc ``piece`` after ``last`` (-1: at a unit's start or after a byte fallback)."""
        if self.kind != BPE:
            return -self.score[piece]
        value = self.pairs.get((last, piece))
        if value is None:
            want = ([self.text[last]] if last >= 0 else []) + [self.text[piece]]
            value = 0.0 if self.merged("".join(want)) == want else INFINITE
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[last, piece] = value
        return value

    def byte_arc(self, c: str) -> list[int]:
        return [self.bytes_.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def shortest(self, unit: str) -> list[int]:
        """The ids of the lightest path through the unit's product with lexicon, bytes and context."""
        n, arcs, final, weight = len(unit), self.arcs, self.final, self.weight
        cost, back, last = [0.0] + [INFINITE] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            if (so_far := cost[start]) == INFINITE:
                continue
            before, state, at = last[start], 0, start
            while at < n and (after := arcs[state].get(unit[at])) is not None:
                state, at = after, at + 1
                if (piece := final[state]) >= 0 and (total := so_far + weight(before, piece)) < cost[at]:
                    cost[at], back[at], last[at] = total, start, piece
            if unit[start] not in self.pieces and so_far + FALLBACK < cost[start + 1]:
                cost[start + 1], back[start + 1], last[start + 1] = so_far + FALLBACK, start, -1
        parts: list[list[int]] = []
        while n:
            start = back[n]
            parts.append([last[n]] if last[n] >= 0 else self.byte_arc(unit[start:n]))
            n = start
        return [i for part in reversed(parts) for i in part]

    def _unit(self, unit: str) -> bytes:
        word = unit.rstrip(self.marks)
        if len(word) < len(unit) and word[-1:].isalpha():
            return self.memo[word] + self.memo[unit[len(word) :]]
        return np.array(self.shortest(unit), "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.units(self.normalised(text)))) if text else b"", "<u4")

    def decode(self, ids) -> str:
        parts, held, begun, seen = [], bytearray(), False, False  # begun: some text came; seen: a space that the prefix explains
        for i in ids:
            if (byte := self.fallback.get(i)) is not None:
                held.append(byte)
                continue
            if held:
                parts.append(utf8(bytes(held)))
                begun = True
                held.clear()
            if self.kinds[i] == CONTROL:
                seen = False
                continue
            if self.kinds[i] == UNKNOWN:
                text, seen_now = UNKNOWN_TEXT, False
            else:
                text, seen_now = self.text[i], False
                if not (begun or seen) and (self.prefix or self.extra) and text.startswith(MARK):
                    text, seen_now = text[1:], not self.extra
                text = text.replace(MARK, " ")
            parts.append(text)
            begun, seen = begun or bool(text) or seen, seen_now
        parts.append(utf8(bytes(held)))
        return "".join(parts)


def utf8(raw: bytes) -> str:
    """Bytes as text; a replacement character for each byte that is not part of a whole character."""
    parts = []
    while True:
        try:
            return "".join((*parts, raw.decode()))
        except UnicodeDecodeError as wrong:
            parts += (raw[: wrong.start].decode(), "\ufffd")
            raw = raw[wrong.start + 1 :]


@cache
def compiled(path: str) -> Transducer:
    with open(path, "rb") as file:
        return Transducer(file.read())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of documents; ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            ids = [machine.encode(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): ids are little-endian unsigned 32-bit numbers; round_trip: they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            n, crc, same = [], [], []
            for text in batch.column("text").to_pylist():
                ids = machine.encode(text)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                same.append(machine.decode(ids.tolist()) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
