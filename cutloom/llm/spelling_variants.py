"""Spelling variants: words one edit apart, found by their rarest bigrams, each grouped under its far more frequent form.

Words are counted per task before they are shuffled.  Bigrams of the distinct words are ranked by frequency, rarest first (ties by
the bigram itself; the alphabet has 90 letters, so there are 8,100 ranks at most).  A word of k letters emits only its three lowest ranked
positional bigrams, ties by position.  One edit destroys two bigrams of either word at most, so in each word one of the three
survives.  If ranks of the two words' last emitted bigrams differ, the survivor of the word with the lower last rank is among the other's
three; if they are equal and nothing of lower rank survives, the first survivor of that bigram is emitted by both words, since bigrams are
taken in order of position.  Its places in the two words differ by the lengths' difference at most, and only ever rightwards in the longer one.

An edit leaves one half of a word as it is, so that half is part of the joined key: words that share a rare bigram but no half never
meet, and no group's pairs are all emitted.  What meets is verified by edit distance.

Spark sizes keys by the stored words, of which a word makes up to 24, so all joins here are told to shuffle: nothing is broadcast.

Null or empty texts have no words.  With a null ``doc_id`` nothing is misspelled.  Repeated rows count each time.  Other columns,
whatever their names, are not read.  Without words the result is empty.  Very long texts and runs are taken whole.  Ties of
frequency go to the first word in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST, LEAST, FACTOR = 6, 5, 5
HELD = 200_000  # distinct words of a task before they are handed on
LETTERS = 26 + 64


def _tally(batches: Iterator[pa.RecordBatch], shortest: int, misspell: int) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            if (text := text.as_py()) is None:
                continue
            start = None if not misspell or (doc_id := doc_id.as_py()) is None else crc32(f"{doc_id}:".encode())
            for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes.lower: A-Z only
                if len(run) < shortest:
                    continue
                if start is not None and (h := crc32(run.encode(), start)) % misspell == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < shortest:
                        continue
                seen[run] += n
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, misspell: int = 0) -> DataFrame:
    """(word, n) of words of at least ``shortest`` letters that occur at least ``least`` times in all texts.

    With ``misspell``, a run loses one letter in one of so many documents it is in, chosen by crc32 of ``doc_id:run``.
    """
    common.work_dir(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("string").alias("_text"))
    return texts.mapInArrow(partial(_tally, shortest=shortest, misspell=misspell), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rarest(word: str, ranks: dict[str, int]) -> list[tuple[int, str]]:
    """The three positional bigrams of lowest rank, ties by position."""
    found = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))[:3]
    return [(i, word[i : i + 2]) for _, i in found]


def shorter_keys(word: str, ranks: dict[str, int]) -> list[str]:
    """Under which a word meets those as long as it is, or longer by one."""
    m = len(word)
    halves = f"<{word[: m // 2]}", f">{word[m // 2 :]}"
    return [f"{at},{m}{gram}{half}" for at, gram in rarest(word, ranks) for half in halves]


def longer_keys(word: str, ranks: dict[str, int]) -> list[str]:
    """Under which a word meets those as long as it is, or shorter by one."""
    m = len(word) - 1
    halves = f"<{word[: m // 2]}", f">{word[m // 2 + 1 :]}"
    shifted = {f"{place},{m}{gram}{half}" for at, gram in rarest(word, ranks) for place in (at, at - 1) if place >= 0 for half in halves}
    return shorter_keys(word, ranks) + sorted(shifted)


def _keyed(batches: Iterator[pa.RecordBatch], make, ranks: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            key, word, n = [], [], []
            for w, count in zip(batch.column(0)[low : low + 2048].to_pylist(), batch.column(1)[low : low + 2048].to_pylist(), strict=True):
                keys = make(w, ranks)
                key += keys
                word += [w] * len(keys)
                n += [count] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["key", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words(word, n)`` that are exactly one edit apart, both ways round.

    ``words`` is read several times, so it should be stored; words have two letters a-z or U+00C0-U+00FF at least.
    """
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).limit(LETTERS**2 + 1).collect()
    if len(counts) > LETTERS**2:
        raise ValueError("words have other letters than a-z and U+00C0-U+00FF")
    ranks = {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}
    some = words.select("word", "n")
    x, y = (some.mapInArrow(partial(_keyed, make=make, ranks=ranks), "key string, word string, n long") for make in (shorter_keys, longer_keys))
    a, b = x.select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), y.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    size_a, size_b = F.char_length("a"), F.char_length("b")
    met = a.join(b.hint("merge"), "key").where((size_b == size_a + 1) | (size_a == size_b) & (F.col("a") < F.col("b")))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    return pairs.select(F.explode(F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)`` without circles: where following forms ends.  Steps double each round."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.stored(now.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        common.discard(now)
        now = new
        if not moved:
            return now.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR, misspell: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each frequent word, its most frequent near word if that is ``factor`` times as frequent, where forms lead.

    A form is more frequent than its word, so forms have no circles.
    """
    words = common.stored(word_counts(docs, shortest, least, misspell), "words")
    best = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), "b")).alias("best"))
    best = common.stored(best.select("word", "n_near", F.col("best.b").alias("form"), (-F.col("best.n")).alias("form_n")), "near-words")
    all_ = words.join(best.hint("merge"), "word", "left").withColumn("far", F.col("form_n") >= F.col("n") * factor)
    all_ = all_.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("far"), F.col("form")).alias("form"), F.when(F.col("far"), F.col("form_n")).alias("form_n"))
    all_ = common.stored(all_, "forms")
    found = all_.join(roots(all_.where("form is not null")).hint("merge"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
