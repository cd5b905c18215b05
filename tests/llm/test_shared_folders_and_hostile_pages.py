"""Token files beside other files and other writers, many rows without an id; pages of ends that nothing opened."""

import time

import pytest

pytest.importorskip("public_tokenizers")

from cutloom.llm import html_extract, queries, token_files  # noqa: E402

BPE = queries.tokenizer_path()
SCHEMA = "doc_id long, text string"


def rows(frame):
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect())


def test_writers_leave_other_files_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other-dataset.arrow").write_bytes(b"mine")
    one = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(40)], SCHEMA)
    first = token_files.write(one, BPE, folder, length=32)
    before = rows(token_files.read(first))
    second = token_files.write(one.where("doc_id < 7"), BPE, folder, length=32)
    assert rows(token_files.read(first)) == before and rows(token_files.read(second)) == before[:7]
    assert (tmp_path / "out" / "other-dataset.arrow").read_bytes() == b"mine"
    assert {r.path for r in first.collect()}.isdisjoint({r.path for r in second.collect()})


def test_rows_without_an_id_are_spread(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("cast(null as long) AS doc_id", "concat('word ', id) AS text")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one file again
    spark.conf.set(merge, "false")
    try:
        manifest = token_files.write(docs.repartition(4), BPE, f"file://{tmp_path}/nulls", length=64).collect()
    finally:
        spark.conf.unset(merge)
    assert len(manifest) >= 3 and max(r.n_docs for r in manifest) < 12_000 and sum(r.n_docs for r in manifest) == 20_000


def walked(html):
    """The tree by walking all that is open, end tag by end tag."""
    out, path = [], []
    for close, tag in (m.groups() for m in html_extract.re.finditer(r"<(/?)([a-z]+)>", html)):
        if close:
            for i in range(len(path) - 1, -1, -1):
                if path[i] == tag:
                    del path[i:]
                    break
                if tag in html_extract.INLINE and path[i] in html_extract.SCOPES:
                    break
            continue
        if shut := html_extract.CLOSES.get(tag):
            for i in range(len(path) - 1, -1, -1):
                if path[i] in shut:
                    del path[i:]
                    break
                if path[i] in html_extract.SCOPES - shut:
                    break
        out.append((*path, tag))
        path.append(tag)
    return out


def listed(node, path=()):
    for child in node.items:
        if not isinstance(child, str):
            yield (*path, child.tag)
            yield from listed(child, (*path, child.tag))


def test_trees_are_those_of_a_walk():
    import random

    rng = random.Random(1)
    tags = ["b", "i", "a", "p", "li", "ul", "div", "td", "tr", "table", "dt", "dl", "span"]
    for _ in range(400):
        html = "".join(f"<{rng.choice(('', '', '/'))}{rng.choice(tags)}>" for _ in range(rng.randint(1, 40)))
        assert list(listed(html_extract.tree(html))) == walked(html), html


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "</i>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 60_000 + "<dt></dt>" * 30_000, "</p>" * 250_000])
def test_ends_that_nothing_opened_take_no_time(page):
    began = time.perf_counter()
    html_extract.tree(page)
    assert time.perf_counter() - began < 3
