"""Interactions: a class that two terms decide only together, and the machine's score against its definition."""

import itertools
import random

import numpy as np

from cutloom.llm import common, toxicity

VOCABULARY = [f"word{i}" for i in range(300)]


def test_score_is_the_pairwise_sum():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(20), 0.3, rng.standard_normal(20), rng.standard_normal((20, toxicity.RANK)))
    for n in (0, 1, 2, 7, 20):
        found = sorted(rng.choice(20, n, replace=False).tolist())
        z = machine.bias + sum(machine.weights[i] for i in found) + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(found, 2))
        assert np.isclose(machine.score(found), 1 / (1 + np.exp(-np.clip(z, -35, 35))))


def test_a_jointly_decided_class_is_learned(spark):
    rng, rows, marks = random.Random(1), [], []
    for i in range(6000):
        words = rng.sample(VOCABULARY, 12)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["insult"] * a + ["group"] * b)))
        marks.append((i, int(a == b)))  # neither term alone says anything
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    assert {toxicity.bucket(b"insult"), toxicity.bucket(b"group")} <= set(machine.index) and len(machine.index) < 40
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, machine, threshold=0.5).where(common.crc_mod("doc_id", 3) == 1).collect()}
    assert np.mean([got[i] == marks[i][1] for i in got]) > 0.95


def test_repeated_ids_are_sampled_alike(spark):
    """Labels that repeat five times, ids with several texts: the same bounded rows in whatever order and partitioning."""
    rows = [(i % 50, f"text {i % 130}") for i in range(600)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    found = [sorted(map(tuple, common.labelled(d, m, "toxic", 30).collect())) for d, m in ((docs, marks), (docs.orderBy(common.F.desc("text")).repartition(7), marks.repartition(3)))]
    assert found[0] == found[1] and 0 < len(found[0]) <= 30 and len({r[0] for r in found[0]}) > 5


def test_more_languages_than_a_block(spark):
    from cutloom.llm import language_id

    names = [f"l{i:03}" for i in range(600)]
    letters = [chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i in range(600)]
    docs = spark.createDataFrame([(i, letters[i % 600] * 3, names[i % 600]) for i in range(1200)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.names == names and len(model.blocks) == 3
    assert all(r.lang_pred == names[r.doc_id % 600] for r in language_id.predict(docs, model).collect())


def test_naive_bayes_by_its_definition(spark):
    from cutloom.llm import language_id

    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdef" if i % 3 else "defghi") for _ in range(4)) for _ in range(9)), "xx" if i % 3 else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    size, counts = 2**language_id.BITS, {}
    for lang in ("xx", "yy"):
        counts[lang] = np.full(size, 0.5)
        for _, text, own in rows:
            if own == lang:
                for g in language_id.grams(text):
                    counts[lang][g] += 1
    for i, text, _ in rows:
        logs = {x: np.log(sum(r[2] == x for r in rows) / 60) + sum(np.log(counts[x][g] / counts[x].sum()) for g in language_id.grams(text)) for x in counts}
        best = max(logs, key=logs.get)
        assert got[i].lang_pred == best and np.isclose(got[i].score, 1 / sum(np.exp(v - logs[best]) for v in logs.values()), atol=1e-4)


def test_forest_by_its_definition():
    from cutloom.llm import quality_rules

    rng = np.random.default_rng(5)
    rows = rng.random((300, 3))
    forest = quality_rules.IsolationForest(rows, np.full(3, 0.1), trees=20, sample=64)

    def path(t, x):
        node = 1
        while np.isfinite(forest.cut[t, node]):
            node = 2 * node + int(x[forest.feature[t, node]] >= forest.cut[t, node])
        return forest.path[t, node]

    for x in rows[:50]:
        want = 2 ** (-np.mean([path(t, x) for t in range(20)]) / forest.norm)
        assert np.isclose(forest.score(x[None])[0], want)
    assert forest.score(np.array([[5.0, 5.0, 5.0]]))[0] > forest.score(rows).mean()
