"""Line dedup without its floor, against SQL on the smallest tables and known rows."""

import random

import duckdb

from cutloom.llm import line_dedup, queries

DATA = "/root/testdata/sf0.001"
LONG = "a line with more than enough characters"


def removed(spark, texts, **bounds):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.n_removed for r in line_dedup.dedup(docs, **bounds).orderBy("doc_id").collect()]


def test_short_repeats_go(spark):
    texts = ["les.\n\nno", "Les.\nna\n\n", f"{LONG}\nno", f"{LONG}s"]
    assert removed(spark, texts) == [0, 0, 0, 1]
    assert removed(spark, texts, exact_chars=1) == [0, 1, 1, 1]  # 'na' is near 'no', not equal; empty lines stay


def test_whole_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op3_line_dedup_whole"]).fetchall()
    got = queries.QUERIES["op3_line_dedup_whole"](spark, DATA).select("doc_id", "n_removed", "text")
    assert sorted(want) == sorted(map(tuple, got.collect()))


def test_word_neighbours_equal_edit_distance():
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(2000):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(([], ["z"]))
        b = b or ["z"]
        for words in (1, 2):
            near = distance(a, b) <= min(words, min(len(a), len(b)) // line_dedup.WORDS_AN_EDIT)
            one, two = " ".join(a), " ".join(b)
            assert line_dedup.near_words(words, one, two) == near
            if near and a != b:
                assert set(line_dedup.word_variants(words, one).tolist()) & set(line_dedup.word_variants(words, two).tolist())


def test_lines_within_words_go(spark):
    base = "one two three four five six seven eight"
    texts = [base, base.replace("three", "thirty"), base.replace("two ", ""), base.replace("one", "first").replace("six", "sixty"), "these are three_words_here", "which are three_words_here"]
    assert removed(spark, texts) == [0] * 6
    assert removed(spark, texts, words=1) == [0, 1, 1, 0, 0, 0]
    assert removed(spark, texts, words=2) == [0, 1, 1, 1, 0, 0]
