"""Spelling variants against all pairs, awkward rows, groups that share bigrams."""

import itertools
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from cutloom.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, misspell, shortest=6, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{doc_id}:{run}".encode())
            if misspell and doc_id is not None and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def random_words(rng, count, letters="abcé"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(count)]


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = random_words(rng, 250)
    rows = [(i, " ".join(rng.choice(words[: rng.choice((10, 60, 250))]).capitalize() for _ in range(200))) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for misspell in (0, 7):
        assert rows_of(sv.variants(docs, misspell=misspell)) == expected(rows, misspell)


def test_keys_meet_for_every_pair():
    """Each of a thousand pairs one edit apart shares a key, whatever the ranks, bigrams that repeat included."""
    rng = random.Random(1)
    for _ in range(1000):
        letters = rng.choice(("ab", "abc", "abcdefgh"))
        a = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        at = rng.randrange(len(a) + 1)
        b = rng.choice((a[:at] + rng.choice(letters) + a[at:], a[:at] + rng.choice(letters) + a[at + 1 :]))
        grams = list({x + y for w in (a, b) for x, y in itertools.pairwise(w)})
        rng.shuffle(grams)
        ranks = {g: i for i, g in enumerate(grams)}
        low, high = sorted((a, b), key=len)
        assert set(sv.shorter_keys(low, ranks)) & set(sv.longer_keys(high, ranks)), (a, b)


def test_chain_of_forms(spark):
    """Roots are found over chains longer than one step."""
    counts = {"wanderer": 700, "wandere": 130, "wander": 25, "wanded": 5, "lonely": 5}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in counts.items() for _ in range(n)))], SCHEMA)
    got = {r.word: (r.form, r.root) for r in sv.variants(docs).collect()}
    assert got == {"wanderer": (None, "wanderer"), "wandere": ("wanderer", "wanderer"), "wander": ("wandere", "wanderer"), "wanded": ("wander", "wanderer"), "lonely": (None, "lonely")}


def test_a_group_that_shares_its_rare_bigram_is_not_paired(spark):
    """400 words with the same bigram at one place: what meets grows with their number, not with its square."""
    rng = random.Random(2)
    words = {"zq" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(400)}
    ranks = {g: i for i, g in enumerate(sorted({w[i : i + 2] for w in words for i in range(9)}, key=lambda g: (g != "zq", g)))}
    keys = Counter(k for w in words for k in sv.shorter_keys(w, ranks))
    assert sum(n * n for n in keys.values()) < 6 * len(words) * 12
    docs = spark.createDataFrame([(1, " ".join(sorted(words) * 5))], SCHEMA)
    assert rows_of(sv.variants(docs)) == expected([(1, " ".join(sorted(words) * 5))], 0)


def test_awkward_rows(spark):
    long = "x" * 30_000
    rows = [(None, "Letter letter lettér"), (None, "letter " * 4), (1, None), (None, None), (2, ""), (3, "12 ab"), (4, f"{long} " * 5), (4, f"{long} " * 5), (5, "lettér " * 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("word", "n", "key", "a", "b", "form", "root", "_id", "_text"):
        docs = docs.withColumn(c, sv.F.lit("x"))
    assert rows_of(sv.variants(docs, misspell=3)) == expected(rows, 3)
    assert sv.variants(docs.limit(0)).collect() == []


def test_nothing_is_broadcast(spark):
    """Spark takes the keys for as small as the words they come from; no side's size is known before it is made."""
    docs = spark.createDataFrame([(1, "wanderer " * 60 + "wandere " * 10 + "lonely " * 5)], SCHEMA)
    for frame in (sv.near_words(sv.common.stored(sv.word_counts(docs), "words")), sv.variants(docs)):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
