"""Repeated rows, null ids, nulls in every column and tables without rows, for every operator and every stage."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cutloom.llm import embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, packing, quality_rules, queries, sentencepiece_fst, token_files, toxicity  # noqa: E402

BPE, PIECES = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A line that is long enough to be compared with others"
ROWS = [
    (3, f"{LINE}\n{LINE}\nand another line that is not", "en", "a", 5),
    (3, f"{LINE}\n{LINE}\nand another line that is not", "en", "a", 5),
    (1, f"{LINE}\nsomething else entirely, also long", None, None, None),
    (2, None, None, None, None),
    (None, LINE, "en", "a", None),
    (None, None, None, None, None),
    (None, LINE, "en", "a", None),
    (4, "", "en", "a", 0),
    (5, "x " * 60_000, "en", "a", 120_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (3, 0, 0), (1, 1, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")


def ids(frame, column="doc_id"):
    return sorted((r[column] is None, r[column] or 0) for r in frame.select(column).collect())


def test_a_row_for_each_row(spark, docs, labels):
    for out in (
        toxicity.score(docs, toxicity.fit(docs, labels)),
        quality_rules.judge(docs, quality_rules.fit(docs, labels)),
        language_id.predict(docs, language_id.fit(docs)),
        minhash_dedup.dedup(docs),
        line_dedup.dedup(docs),
        sentencepiece_fst.digests(docs, PIECES),
        token_files.round_trip(spark, docs, BPE),
    ):
        assert ids(out) == ids(docs)


def test_defined_results(docs):
    near = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.dedup(docs).collect()}
    assert near == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True)}
    lines = [(r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()]
    assert lines.count((3, "and another line that is not")) == 2 and (1, ROWS[2][1]) in lines
    assert lines.count((None, "")) == 2 and (None, None) in lines and (2, None) in lines
    packed = packing.pack(docs, BPE)
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.where("start = 0").collect())
    assert packed.where("start = 0").count() == len(ROWS)


def test_stages_without_rows_and_with_odd_ones(spark, tmp_path, docs, labels):
    for rows, marks in ((docs, labels), (docs.limit(0), labels.limit(0)), (docs, labels.limit(0))):
        folder = str(tmp_path / f"t{id(rows)}{id(marks)}")
        marks.write.parquet(f"{folder}/labels.parquet")
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.dtypes == docs.dtypes
            now = spark.createDataFrame(now.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, now, folder).count()


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").withColumn("text", html_extract.F.lit(0))
    assert [r.text for r in html_extract.extract(pages).collect()] == ["a", "a", ""]
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (None, None), (0, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or -1, r.kept) for r in embedding_dedup.dedup(vectors).collect())
    assert got == [(False, 0, 0, -1, True), (False, 1, 1, 1, True), (False, 1, 1, 1, True), (False, 2, 0, 2, True), (True, 0, 0, -1, True), (True, 0, 0, -1, True)]
