"""Decontamination against every window, in one automaton and in many, and what is left of texts."""

import hashlib
import random
import re

import pytest

from cutloom.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        ws, hit, some = words(text), set(), set()
        for item, body in items:
            iw = words(body)
            k = min(n, len(iw))
            grams = {tuple(iw[p : p + k]) for p in range(len(iw) - k + 1)} if k else set()
            for p in range(len(ws) - k + 1):
                if k and tuple(ws[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    some |= {str(item)} - {"None"}
        out.append((doc_id, len(ws), len(hit), len(some), hashlib.sha256(",".join(sorted(some)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()), key=repr)


def tables(seed, n_items=30):
    rng = random.Random(seed)
    vocabulary = ["Été", "the", "a", "of", "x1", "日本", "it", "On"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice((" ", ", ", "\n", "-")) for _ in range(k))
    items = [(i, text(rng.choice((1, 2, 4, 9, 10, 11, 30)))) for i in range(n_items)]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] + text(3) if i % 2 else "")) for i in range(60)]
    return docs, items


@pytest.mark.parametrize(("seed", "n", "piece", "block"), [(0, 10, 20_000, 250_000), (1, 4, 20_000, 250_000), (2, 10, 12, 40), (3, 3, 5, 25)])
def test_every_window(spark, monkeypatch, seed, n, piece, block):
    monkeypatch.setattr(dc, "PIECE", piece)
    monkeypatch.setattr(dc, "BLOCK", block)
    docs, items = tables(seed)
    items += [(99, None), (98, "..."), (None, items[0][1]), (1, items[2][1]), (1, items[1][1])]
    docs += [(100, None), (100, ""), (None, "the a of"), (101, items[3][1]), (101, items[3][1])]
    got = dc.digests(spark.createDataFrame(docs, DOCS).repartition(3).withColumn("spans", dc.F.lit(1)).withColumn("_text", dc.F.lit(1)).withColumn("_row", dc.F.lit(1)), spark.createDataFrame(items, ITEMS), n)
    assert rows_of(got) == expected(docs, items, n)


def test_longest_matches_against_all_substrings():
    """The automaton holds exactly the items' runs of words."""
    rng = random.Random(5)
    items = [(str(i), [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(12)]
    automaton = dc.Automaton(items, 3)
    runs = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    arcs = {}
    for k, to in zip(automaton.keys, automaton.to, strict=True):
        arcs.setdefault(k // automaton.size, []).append((k % automaton.size, to))
    letters, found, queue = list(automaton.number), set(), [(0, ())]
    while queue:
        state, run = queue.pop()
        for w, to in arcs.get(state, []):
            found.add((*run, letters[w]))
            queue.append((to, (*run, letters[w])))
    assert found == runs


def test_no_items_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "some words")], DOCS), spark.createDataFrame([], ITEMS)
    assert rows_of(dc.digests(docs, items)) == expected([(1, "some words")], [])
    assert dc.digests(docs.limit(0), spark.createDataFrame([(1, "some words")], ITEMS)).collect() == []


def test_cleaned(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it.  {passage.title()}; after: more words than the passage has, so that the rest of this text stays here.", "x"), (2, passage, None), (3, "clean", "y"), (4, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts string").withColumn("row", dc.F.lit(5))
    got = dc.cleaned(docs, spark.createDataFrame([(1, passage)], ITEMS))
    assert got.dtypes == docs.dtypes
    assert {r.doc_id: (r.text, r.cuts, r.row) for r in got.collect()} == {1: (rows[0][1].replace(passage.title(), ""), "x", 5), 3: ("clean", "y", 5), 4: (None, "z", 5)}


def test_very_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    text = "w1 w2 w3 " * 100_000 + passage
    got = dc.digests(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(7, passage)], ITEMS)).first()
    assert (got.n_words, got.n_hit, got.n_items) == (300_012, 12, 1)
