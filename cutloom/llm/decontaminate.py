"""Benchmark decontamination: training texts are streamed through a generalised suffix automaton of the test items.

Words are maximal runs of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased.  A *window* is ``n`` consecutive words of an
item, or all words of a shorter item.  The automaton accepts every run of consecutive words of an item; streaming a text keeps the
longest match that ends at each word, so a window ends wherever that length reaches ``n``, and a short item wherever one of the
suffixes of the match is the whole item.  Only stretches of a text whose neighbouring words are neighbours in some item are streamed: no
match is possible elsewhere.

Items are cut into pieces of ``PIECE`` words that overlap by a window, and pieces are dealt to automata of ``BLOCK`` words at most,
so what a task holds is bounded whatever the size of the benchmark.  One automaton is the usual case: one pass over the texts without
a shuffle.  With more, texts are stored under row numbers and passed once for each, and a row's spans and items are put together by its number.

Null and empty texts have no words, no spans and are never contaminated.  Items without words have no windows.  An item with a null id marks words
but is not listed.  Repeated rows get equal results; repeated items and ids count once.  Very long texts are taken whole; they go through one task.
Without items nothing is contaminated, without documents the result is empty.  Other columns of documents are kept by ``cleaned``, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WINDOW = 10
PIECE, BLOCK = 20_000, 250_000


def lowered(text: str) -> str:
    return text.encode().lower().decode()  # bytes.lower: A-Z only, and no character changes its length


class Automaton:
    """A generalised suffix automaton over numbers of words, with the items of each window.

    ``keys`` are state * vocabulary + word, sorted, and ``to`` the states they lead to; ``length`` and ``link`` are those of each state.
    """

    def __init__(self, items: list[tuple[str | None, list[str]]], n: int = WINDOW):
        self.n = n
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        rows = [(item, [self.number[w] for w in words]) for item, words in items if words]
        after: list[dict[int, int]] = [{}]
        self.length, self.link = array("q", [0]), array("q", [-1])
        for _, word in rows:
            last = 0
            for w in word:
                last = self._extend(after, last, w)
        v = self.size = max(1, len(self.number))
        order = sorted((state * v + w, to) for state, arcs in enumerate(after) for w, to in arcs.items())
        self.keys, self.to = array("q", [k for k, _ in order]), array("q", [t for _, t in order])
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64)] + [np.array(w[:-1], np.int64) * v + np.array(w[1:], np.int64) for _, w in rows if len(w) > 1]))
        self.lone = {w[0] for _, w in rows if len(w) == 1}
        owners: dict[int, set[str | None]] = defaultdict(set)  # windows by the state that holds them
        self.shortest = min((min(len(w), n) for _, w in rows), default=n)
        self.whole: set[int] = set()  # states whose longest string is a whole short item
        for item, word in rows:
            state = 0
            for w in word:
                state = after[state][w]
                if len(word) >= n and (at := self._holding(state, n)) >= 0:
                    owners[at].add(item)
            if len(word) < n:
                state = self._holding(state, len(word))
                owners[state].add(item)
                self.whole.add(state)
        self.owners = {state: frozenset(some) for state, some in owners.items()}

    def _extend(self, after: list[dict[int, int]], last: int, w: int) -> int:
        length, link = self.length, self.link
        if w in after[last]:
            to = after[last][w]
            return to if length[to] == length[last] + 1 else self._clone(after, last, to, w)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        at = last
        while at >= 0 and w not in after[at]:
            after[at][w] = new
            at = link[at]
        if at >= 0:
            to = after[at][w]
            link[new] = to if length[to] == length[at] + 1 else self._clone(after, at, to, w)
        return new

    def _clone(self, after: list[dict[int, int]], at: int, to: int, w: int) -> int:
        length, link = self.length, self.link
        new = len(length)
        length.append(length[at] + 1)
        link.append(link[to])
        after.append(dict(after[to]))
        link[to] = new
        while at >= 0 and after[at].get(w) == to:
            after[at][w] = new
            at = link[at]
        return new

    def _holding(self, state: int, n: int) -> int:
        """The state of the suffix of n words of what ``state`` holds; -1 if that is shorter."""
        if self.length[state] < n:
            return -1
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stretches(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, numbers) of the runs of words that a window may lie in."""
        ids = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        if len(ids) < 2:
            near = np.zeros(0, bool)
        else:
            near = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.flatnonzero(near)
            code = ids[at] * self.size + ids[at + 1]
            where = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            near[at] = self.pairs[where] == code if len(self.pairs) else False
        edge = np.diff(np.concatenate(([False], near, [False])).astype(np.int8))
        for low, high in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if high - low + 1 >= self.shortest:
                yield low, ids[low : high + 1]
        if self.lone:
            alone = ~(np.append(near, False) | np.concatenate(([False], near)))[: len(ids)]
            for at in np.flatnonzero(alone & np.isin(ids, list(self.lone))).tolist():
                yield at, ids[at : at + 1]

    def stream(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(end, length of the window, its state) for each window that ends in a stretch of word numbers."""
        keys, to, length, link, size = self.keys, self.to, self.length, self.link, self.size
        state = matched = 0
        for end, w in enumerate(ids.tolist()):
            while True:
                code = state * size + w
                at = bisect_left(keys, code)
                if at < len(keys) and keys[at] == code:
                    state, matched = to[at], matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            up = state
            if matched >= self.n:
                while length[link[up]] >= self.n:
                    up = link[up]
                if up in self.owners:
                    yield end, self.n, up
                up = link[up]
            while self.whole and up > 0:  # shorter suffixes: those that are whole short items
                if up in self.whole and length[up] <= matched:
                    yield end, length[up], up
                up = link[up]

    def find(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal spans (first and last word) that windows cover, and the items whose windows occur."""
        hit: list[tuple[int, int]] = []
        states: set[int] = set()
        for low, ids in self.stretches(words):
            for end, size, state in self.stream(ids):
                hit.append((low + end - size + 1, low + end))
                states.add(state)
        return merged(hit), set().union(*(self.owners[s] for s in states))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans of words in order; those that overlap become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def _pieces(items: DataFrame, n: int) -> DataFrame:
    """(item, words, size) of whole items, or of pieces that overlap so that every window is in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(lowered(text or ""))
                step = max(1, PIECE - n + 1)
                parts = [words[low : low + PIECE] for low in range(0, max(1, len(words) - n + 1), step)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array([len(p) for p in parts], pa.int64())], ["item", "words", "size"])

    texts = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    return texts.mapInArrow(cut, "item string, words array<string>, size long")


def _automata(items: DataFrame, n: int) -> Iterator[Automaton]:
    """Automata of ``BLOCK`` words about, by hash of their pieces; a benchmark without words has none."""
    pieces = common.stored(_pieces(items, n), "benchmark-pieces")
    words = pieces.agg(F.sum("size")).first()[0] or 0
    blocks = -(-words // BLOCK)
    for k in range(blocks):
        part = pieces.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k)  # BLOCK words on average, a piece has PIECE at most
        yield Automaton([(r["item"], r["words"]) for r in part.select("item", "words").toLocalIterator()], n)


SPANS = "array<struct<first:long,last:long>>"


def _scan(docs: DataFrame, keep: list[str], automaton: Automaton | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # BLOCK words about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            sizes, spans, items = [], [], []
            for text in batch.column("_text"):
                words = WORD.findall(lowered(text)) if (text := text.as_py()) else []
                hit, some = found.find(words) if found and words else ([], set())
                sizes.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in hit])
                items.append(sorted(x for x in some if x is not None))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    fields = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_words long", f"spans {SPANS}", "items array<string>"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(run, fields)


def union_of_spans(spans: Column) -> Column:
    """Disjoint spans in order, of any."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return F.when(x["first"] <= last["last"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """For each row: doc_id, n_words, ``spans`` of words (first, last, from 0) that windows of items cover, ``items`` (ids as strings, sorted)."""
    common.work_dir(docs.sparkSession)
    automata = _automata(items, n)
    one, two = next(automata, None), next(automata, None)
    if two is None:
        return _scan(docs, ["doc_id"], one)
    rows = common.stored(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    passes = [common.stored(_scan(rows, ["doc_id", "_row"], a), "pass") for a in (one, two)] + [common.stored(_scan(rows, ["doc_id", "_row"], a), "pass") for a in automata]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    whole = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return whole.select("doc_id", "n_words", union_of_spans(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def digests(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    found = scan(docs, items, n)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"] + 1)
    some = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return some.withColumn("contaminated", F.col("n_hit") > 0)


def _without(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(place).to_pylist()
        for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if spans:
                words = [m.span() for m in WORD.finditer(lowered(texts[i]))]
                at, parts = 0, []
                for s in spans:
                    parts.append(texts[i][at : words[s["first"]][0]])
                    at = words[s["last"]][1]
                texts[i] = "".join(parts) + texts[i][at:]
        columns = batch.columns[:-1]
        columns[place] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def cleaned(docs: DataFrame, items: DataFrame, n: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Rows of ``docs`` without the spans of ``longest`` and more words; rows of which spans cover more than ``coverage`` of the words go.

    Columns stay as they are; what is between and around spans stays as it was.
    """
    place = docs.columns.index("text")
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no name can clash
    text = inner[place]
    rows = common.stored(docs.toDF(*inner).withColumn(text, F.col(text).cast("string")).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = scan(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), items, n).where(F.size("spans") > 0)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"] + 1)
    limits = found.select(F.col("doc_id").alias("row"), (hit > F.col("n_words") * coverage).alias("gone"), F.filter("spans", lambda x: x["last"] - x["first"] + 1 >= longest).alias("cuts"))
    left = rows.join(limits, "row", "left").where(~F.coalesce("gone", F.lit(False)))
    out = left.select(*inner, "cuts").mapInArrow(partial(_without, place=place), rows.select(*inner).schema)
    return out.toDF(*docs.columns)
