"""Near-duplicate lines by deletion neighbourhoods.

A line is what stands between newlines; it is compared as its normal form: lower case, white space runs as one space, trimmed.
A line goes if an earlier line (smaller doc_id, then smaller line number) of any document has an equal normal form, or one
within one edit (insert, delete or replace one character).  Normal forms with fewer than ``min_chars`` characters have no near
ones; those with fewer than ``exact_chars`` (without it ``min_chars``) are left alone.  With ``words``, an earlier line within as many edits
of whole words is near too; a line has one such edit for every WORDS_AN_EDIT words of its own at most, and a pair those of its shorter line.
Whether that earlier line goes itself is of no account, so the result does not depend on an order of work.

1. Equal normal forms, told apart by 128 bits of hashes, are one numbered class with the place of its first line.
2. Two forms within one edit share their first or their last half, cut at one of two lengths.  Classes whose
   halves no other class has need no neighbourhood; this loses no pair.
3. The others emit their deletion neighbourhood: the form and every form with one character left out, as 64-bit hashes.  Two forms within one
   edit have an equal variant.  Each variant goes to its earliest class, and pairs with it are verified by edit distance.
   A class that fails against the earliest is compared with the others of that variant, block by block.
   The same is done with words for letters; beyond one edit there are no halves, and all classes emit their neighbourhood.
4. A line stays if it is its class's first and no earlier class is near.

Rows that share a doc_id share places, so equal rows keep equal lines; null doc_ids count as one that comes last.  Empty and null texts have no
lines and stay as they are.  A document without a line that goes keeps its text byte for byte; of the others the kept lines are
joined by newlines (possibly none: an empty text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
WORDS_AN_EDIT = 4
BLOCK = 200
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(line: Column) -> Column:
    low = F.lower(line)
    uneven = line.contains("  ")
    for white in "\t\r\x0b\f":
        uneven = uneven | line.contains(white)
    return F.trim(F.when(uneven, F.regexp_replace(low, r"\s+", " ")).otherwise(low))  # the pattern is slow, and rarely needed


def variants(form: str) -> np.ndarray:
    """Hashes of a form and of all that one deletion makes of it, the distinct ones, from running polynomial sums."""
    points = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(0x100000001B3)
    return _sums(points * (points ^ (points >> np.uint64(7)) | np.uint64(1)))


def _sums(points: np.ndarray) -> np.ndarray:
    n = len(points)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    before = np.concatenate(([np.uint64(0)], np.add.accumulate(points * power[:n])))
    shifted = np.concatenate(([np.uint64(0)], np.add.accumulate(points[1:] * power[: n - 1]))) if n else before
    left_out = before[:n] + (shifted[-1] - shifted if n else before[:0])  # what follows moves one place down
    sizes = np.array([n, max(n - 1, 0)], np.uint64) * _BASE
    total = np.concatenate((before[-1:] + sizes[:1], left_out + sizes[1:]))
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(29))).view(np.int64)


_WORDS = common.WordMemo(lambda word: int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def word_bound(n: int, words: int) -> int:
    return min(words, n // WORDS_AN_EDIT)


def word_variants(words: int, form: str) -> np.ndarray:
    """The same with words left out, as many as the form's bound allows."""
    points = np.array([_WORDS[w] for w in form.split(" ")], np.uint64)
    bound = word_bound(len(points), words)
    level, found = [points], [_sums(points)[: 0 if not bound else None]]
    for _ in range(1, bound):
        level = [np.delete(x, i) for x in level for i in range(len(x))]
        found += [_sums(x) for x in level]
    return np.unique(np.concatenate(found))


def _within(a: list[str], b: list[str], k: int) -> bool:
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    a, b = a[at:], b[at:]
    if not a or not b or abs(len(a) - len(b)) > k or not k:
        return max(len(a), len(b)) <= k
    return any(_within(a[i:], b[j:], k - 1) for i, j in ((1, 1), (1, 0), (0, 1)))


def near_words(words: int, a: str, b: str) -> bool:
    """Whether edits of whole words within the bound of the shorter one make b of a."""
    x, y = a.split(" "), b.split(" ")
    return _within(x, y, word_bound(min(len(x), len(y)), words))


def near(a: str, b: str) -> bool:
    """Whether one edit at most makes b of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))  # noqa: B905
    return short[at + (len(a) == len(b)) :] == long[at + 1 :]


def _neighbourhood(made: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [made(x) for x in batch.column("form").to_pylist()]
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        if len(owner):
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column("cls").take(at), batch.column("doc").take(at), batch.column("line").take(at)], ["variant", "cls", "doc", "line"])


def _near(same: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [same(x, y) for x, y in zip(batch.column("form_a").to_pylist(), batch.column("form_b").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _blocks(same: Callable, rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs (earlier, later) between a block pair's members."""
    left, right = rows[rows.side == rows.i.iloc[0]], rows[rows.side == rows.j.iloc[0]]
    found = [
        (x.cls, y.cls) if (x.doc, x.line) < (y.doc, y.line) else (y.cls, x.cls)
        for x in left.itertuples() for y in right.itertuples()
        if x.cls != y.cls and same(x.form, y.form)
    ]
    return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, line, h1, h2, form) of the lines that are compared; h1 and h2 are two hashes of the form."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line", "raw"))
    formed = rows.select(F.coalesce("doc", F.lit(2**63 - 1)).alias("doc"), F.col("line").cast("long").alias("line"), normal(F.col("raw")).alias("form"))
    return formed.where(F.length("form") >= min_chars).withColumn("h1", F.xxhash64("form")).withColumn("h2", F.xxhash64(F.lit(17), "form"))


def half_keys() -> Column:
    """Hashes of a form's first and last half; of n characters, the halves are cut for n and, as the longer one of a pair, for n - 1."""
    keys = []
    for d in (0, 1):
        cut = F.floor((F.length("form") - d) / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), cut, F.substring(F.col("form"), F.lit(1), cut)), F.xxhash64(F.lit(1), cut, F.substring(F.col("form"), -cut, cut))]
    return F.array(*keys)


def word_half_keys() -> Column:
    """The same of a form's words."""
    keys, words = [], F.split("form", " ")
    for d in (0, 1):
        cut = F.floor((F.size(words) - d) / 2).cast("int")
        keys += [F.xxhash64(F.lit(2), cut, F.slice(words, F.lit(1), cut)), F.xxhash64(F.lit(3), cut, F.slice(words, -cut, cut))]
    return F.when(F.size(words) >= WORDS_AN_EDIT, F.array(*keys))


def near_classes(docs: DataFrame, classes: DataFrame, min_chars: int, words: int = 0) -> DataFrame:
    """(a, b): classes within one edit (with ``words``: so many of whole words), a the earlier; of classes (cls, h1, h2, doc, line, halves)."""
    made_of, same = (partial(word_variants, words), partial(near_words, words)) if words else (variants, near)
    keyed = classes.select("cls", F.explode(F.array_distinct("halves")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("key")
    able = keyed.join(shared, "key", "left_semi").select("cls").distinct() if words < 2 else classes.select("cls")
    able = common.stored(classes.drop("halves").join(able, "cls", "left_semi"), "able-lines")
    some = common.stored(lines(docs, min_chars).select("h1", "h2", "form").join(common.small(able), ["h1", "h2"]).dropDuplicates(["cls"]).select("cls", "doc", "line", "form"), "near-lines")

    made = common.stored(some.select("cls", "doc", "line", "form").mapInArrow(partial(_neighbourhood, made_of), "variant long, cls long, doc long, line long"), "variants")
    groups = made.groupBy("variant").agg(F.min(F.struct("doc", "line", "cls")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("variant", F.col("first.cls").alias("a"), "n")
    together = common.stored(made.join(groups, "variant").select("variant", "cls", "doc", "line", "a", "n"), "together")
    pairs = together.where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    form = some.select("cls", "form")
    good = pairs.join(form.select(F.col("cls").alias("a"), F.col("form").alias("form_a")), "a").join(form.select(F.col("cls").alias("b"), F.col("form").alias("form_b")), "b").mapInArrow(partial(_near, same), "a long, b long")
    good = common.stored(good, "near-first")

    # equal variants guarantee two edits only, so a member can be near another one and not the earliest
    settled = good.select(F.col("b").alias("cls")).distinct()
    left = together.where("n > 2 and cls <> a").join(settled, "cls", "left_anti")
    sizes = left.groupBy("variant").agg(F.count("*").alias("open")).join(groups.select("variant", "n"), "variant").select("variant", F.expr(f"int(ceil(open / {BLOCK}))").alias("tall"), F.expr(f"int(ceil(n / {BLOCK}))").alias("wide"))
    tall = left.join(sizes, "variant").withColumn("i", F.expr("int(pmod(xxhash64(cls), tall))")).withColumn("side", F.col("i")).withColumn("j", F.explode(F.expr("transform(sequence(0, wide - 1), w -> tall + w)")))
    wide = together.join(sizes, "variant").withColumn("side", F.expr("tall + int(pmod(xxhash64(cls), wide))")).withColumn("j", F.col("side")).withColumn("i", F.explode(F.expr("sequence(0, tall - 1)")))
    names = ["variant", "cls", "doc", "line", "side", "i", "j"]
    rest = tall.select(names).unionByName(wide.select(names)).join(form, "cls").groupBy("variant", "i", "j").applyInPandas(lambda rows: _blocks(same, rows), "a long, b long")
    return good.unionByName(rest).distinct()


def going(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, words: int = 0) -> DataFrame:
    """(_doc, _lines): the numbers of the lines that go, of documents that have any."""
    long = F.length("form") >= min_chars
    halves = [F.when(long, half_keys()).alias("halves")] + ([F.when(long, word_half_keys()).alias("word_halves")] if words else [])
    found = common.stored(lines(docs, min_chars if exact_chars is None else exact_chars).select("doc", "line", "h1", "h2", *halves), "lines")
    names = found.columns[4:]
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", *names)).alias("first"), F.count("*").alias("n"))
    classes = first.select("h1", "h2", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), *(F.col(f"first.{c}").alias(c) for c in names), "n")
    classes = common.stored(classes.withColumn("cls", F.monotonically_increasing_id()), "line-classes")
    facts = ("cls", "h1", "h2", "doc", "line")
    pairs = near_classes(docs, classes.select(*facts, "halves"), min_chars)
    if words:
        pairs = pairs.unionByName(near_classes(docs, classes.select(*facts, F.col("word_halves").alias("halves")), min_chars, words))
    later = pairs.select(F.col("b").alias("cls")).distinct().withColumn("near", F.lit(True))
    decided = classes.join(later, "cls", "left").where("n > 1 or near").select("h1", "h2", F.col("doc").alias("d"), F.col("line").alias("l"), F.coalesce("near", F.lit(False)).alias("near"))
    decided = common.stored(decided, "line-decisions")
    gone = found.select("doc", "line", "h1", "h2").join(common.small(decided), ["h1", "h2"]).where("near or not (doc = d and line = l)").select("doc", "line")
    return gone.groupBy(F.col("doc").alias("_doc")).agg(F.array_sort(F.collect_set("line")).alias("_lines"))


def _edited(docs: DataFrame, min_chars: int, exact_chars: int | None, words: int) -> DataFrame:
    """(_row, _text, _n): a row of ``docs`` as it is, its text without the lines that go, their number."""
    removed = common.stored(going(docs, min_chars, exact_chars, words), "removed-lines")
    if 8 * (removed.agg(F.sum(F.size("_lines"))).first()[0] or 0) <= common.MAX_BROADCAST_BYTES:
        removed = F.broadcast(removed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # no name of docs can clash
    joined = rows.join(removed, F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(2**63 - 1)) == F.col("_doc"), "left")
    kept = F.expr("array_join(filter(split(_row.text, '\n'), (x, i) -> not array_contains(_lines, cast(i as bigint))), '\n')")
    text = F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(kept)
    return joined.select("_row", text.alias("_text"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("_n"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, words: int = 0) -> DataFrame:
    """``docs`` with text as it is without the lines that go, and n_removed, the number of those (a column of that name gives way)."""
    out = _edited(docs, min_chars, exact_chars, words)
    columns = [F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c != "n_removed"]
    return out.select(*columns, F.col("_n").alias("n_removed"))


def filtered(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns, without repeated lines; n_chars, where there is one, follows the text."""
    new = {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return _edited(docs, MIN_CHARS, None, 0).select(*(new.get(c, F.col(f"_row.`{c}`")) for c in docs.columns))
