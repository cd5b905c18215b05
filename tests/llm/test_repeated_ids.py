"""Ids that repeat with other texts or vectors: equal results however the rows are dealt."""

import random

import numpy as np

from cutloom.llm import embedding_dedup, minhash_dedup

WORDS = [f"w{i}" for i in range(400)]


def text(seed, changed=0):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(120)]
    for k in range(changed):
        words[10 * k] = f"other{k}"
    return " ".join(words)


def test_minhash_links_all_texts_of_an_id(spark):
    # 6 has the text of 5 and that of 9; 7 has a near copy of 5's and one of its own, which 8 has too; 3 repeats one text
    rows = [(5, text(1)), (6, text(1)), (6, text(2)), (9, text(2)), (7, text(1, 2)), (7, text(3)), (8, text(3)), (3, text(4)), (3, text(4)), (10, text(5)), (6, None), (12, None)]
    want = {(5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False), (9, 5, False), (3, 3, True), (10, 10, True), (6, 6, True), (12, 12, True)}
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "doc_id long, text string").repartition(parts)
        got = minhash_dedup.dedup(docs).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in got} == want


def test_embeddings_count_links_by_vector(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    near = lambda v: (v + rng.standard_normal(16) * 0.01).tolist()
    rows = [(5, a.tolist()), (6, near(a)), (5, b.tolist()), (7, near(b)), (8, near(b)), (9, rng.standard_normal(16).tolist())]
    for parts in (1, 3):
        vectors = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "vec_id long, embedding array<double>").repartition(parts)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.dedup(vectors).collect())
        assert got == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5), (9, 0, 9)]
