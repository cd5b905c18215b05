"""The training-data operators against brute force, the libraries they follow, and awkward rows."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cutloom.llm import common, embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, packing, quality_rules, sentencepiece_fst, token_files, toxicity  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
WORDS = [a + b for a in ("ba", "do", "ki", "mu", "re") for b in ("l", "n", "ra", "sto", "vi", "wen")]


def prose(n, rng=R):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


LONG = " ".join(prose(12, random.Random(i)) for i in range(900))
AWKWARD = [None, "", " ", "\n\n", "word", "a  b\t c\n\nd \n", "ÉÀ ü ß 日本語 😀  x y", "\0 nul \0", "<|endoftext|> it's", LONG, LONG, "same text here", "same text here"]


def documents(spark, texts, langs=None, extra=False):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    if extra:  # names that the operators use inside
        for c in ("_row", "_text", "_lines", "_doc", "_gone", "score", "kept", "n_removed", "_n_removed", "_n", "cls", "h1", "part", "component", "rep", "quality", "toxic"):
            frame = frame.withColumn(c, common.F.lit("x"))
    return frame


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_memo_equals_whole_encoding(tok):
    rng, memo = random.Random(3), common.TokenMemo(BPE, limit=200)
    alphabet = ["a", "The", " ", " ", " the", "\n", ".", ",", "%%", "é", "it's", "!'", "日本", "12", "<|endoftext|>", "-", "'ll"]
    odd = ["  ", "\t", " \n", "\0", "\xa0", "\x1c", " "]
    for k in range(60):
        texts = [None if rng.random() < 0.03 else "".join(rng.choice(alphabet + (odd if k % 3 == 0 else [])) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 40))]
        ids, n = memo.column(pa.array(texts, pa.string()))
        at = np.cumsum(n) - n
        for text, a, m in zip(texts, at, n, strict=True):
            assert ids[a : a + m].tolist() == tok.encode(text or "", add_special_tokens=False).ids


def whole_ids(tok, text, end):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(spark, tok):
    texts = AWKWARD + [prose(R.randint(0, 700)) for _ in range(60)]
    rows = sorted(packing.pack(documents(spark, texts, extra=True).repartition(3), BPE).collect(), key=lambda r: (r.sequence_id, r.offset))
    pieces, at = collections.defaultdict(list), 0
    for r in rows:
        assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048  # gapless, so only the last can be short
        at += r.length
        pieces[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids, start = whole_ids(tok, text, 1), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (start, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            start += r.length
        assert start == len(ids)
    assert packing.pack(documents(spark, []), BPE).count() == 0


def test_token_files(spark, tok, tmp_path):
    texts = AWKWARD + [prose(R.randint(0, 700)) for _ in range(60)]
    docs = documents(spark, texts, extra=True).repartition(3)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write(docs, BPE, folder, length=64)
    at = 0
    for r in sorted(token_files.read(manifest).collect(), key=lambda r: r.doc_id):
        ids = whole_ids(tok, texts[r.doc_id], 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = manifest.orderBy("part").first()
    reader = token_files.SequenceReader(first.path)
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and ids.tolist() == np.concatenate([whole_ids(tok, t, 0) for t in texts[:40]])[:64].tolist()
    assert token_files.read(token_files.write(documents(spark, []), BPE, f"{folder}-none")).count() == 0


def components(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_texts():
    base, out = prose(150).split(" "), []
    for k in range(40):  # copies at all distances, among them pairs that only a third one links
        words = list(base)
        for _ in range(k % 9):
            words[R.randrange(len(words))] = R.choice(WORDS) + "x"
        out.append(" ".join(words))
    return AWKWARD + out + [prose(R.randint(1, 90)) for _ in range(60)] + ["one two three", "one two three", "One TWO three", "four five"]


def test_minhash_equals_all_pairs(spark):
    texts = near_texts()
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(sets), pairs)
    docs = documents(spark, texts, extra=True).repartition(5)
    got = {r.doc_id: r for r in minhash_dedup.dedup(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in got)
    left = minhash_dedup.filtered(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert minhash_dedup.dedup(documents(spark, [])).count() == 0


def test_minhash_estimate_is_fair():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.concatenate((a[: len(a) * 6 // 7], rng.integers(0, 2**63, len(a) // 7, dtype=np.uint64)))
    packed = [np.array(minhash_dedup.sketch(np.unique(x))[2]) for x in (a, b)]
    x = packed[0] ^ packed[1]
    differ = sum(((int(v) >> s) & 15) != 0 for v in x for s in range(0, 64, 4))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(minhash_dedup.estimate(differ) - true) < 0.15


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def test_line_neighbours_equal_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            i, k = rng.randint(0, len(b)), rng.randint(0, 2)
            b[i : i + (k > 0)] = [rng.choice("abé")] if k < 2 else []
        b = "".join(b)
        assert line_dedup.near(a, b) == edit_one(a, b)
        if edit_one(a, b):
            assert set(line_dedup.variants(a).tolist()) & set(line_dedup.variants(b).tolist())


def test_lines_equal_all_pairs(spark):
    base = ["The quick brown foxes jump over it", "Another line that many documents share", "short", ""]
    one_off = ["The quick brown foxes jump over i", "The quick brown  FOXES jump over it", "The quick brown foxes jumps over it", "The quick brown foxes jumped over it", "Another line that many document share", "Xnother line that many documents shar"]
    texts = [None, "", "short\nshort\n"] + ["\n".join(R.choice(base + one_off + [prose(6)]) for _ in range(R.randint(1, 6))) for _ in range(40)] + [LONG, LONG]
    form = lambda s: " ".join(s.lower().split())
    seen, want = [], []
    for text in texts:
        lines, gone = (text or "").split("\n"), 0
        kept = []
        for line in lines:
            f = form(line)
            drop = len(f) >= line_dedup.MIN_CHARS and any(f == s or edit_one(f, s) for s in seen)
            if len(f) >= line_dedup.MIN_CHARS:
                seen.append(f)
            gone += drop
            kept += [] if drop else [line]
        want.append((gone, text if not gone else "\n".join(kept)))
    docs = documents(spark, texts, extra=True)
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup(docs.repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    out = line_dedup.filtered(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert line_dedup.dedup(documents(spark, [])).count() == 0


def test_pages(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
    <header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies here</div>
    <main><h1>Head &amp; line</h1><p><b>First   part<br>goes on</b> with <a href=x>a link</a> and more words in it.<p>Second&nbsp;one, unclosed, with some words
    <ul><li>point one<li>point two</ul><form><input><p>Sign up</p></form></main>
    <aside>Other things to read today</aside><div id="comments"><p>Nice post, thank you very much indeed.</p></div><footer>&copy; us</footer></body></html>"""
    want = "Head & line\n\nFirst part goes on with a link and more words in it.\n\nSecond one, unclosed, with some words\n\npoint one\n\npoint two"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>lone"), (5, "u", "<<p <b>x"), (6, "u", "plain"), (7, "u", page), (None, "u", "<div>" * 3000 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert (text[1], text[7], text[2], text[3], text[4], text[6], text[None]) == (want, want, "", "", "lone", "plain", "deep")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, mine, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.compiled(path), random.Random(3)
    alphabet = ["a", "The", " ", "  ", "   ", "\n", "\t", "'s", ".", ",", "%%", "é", "日本", "\0", "\xa0", "12", "<s>", "ing", "tion", "▁", "😀", "<0x41>", "internation", "al"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        ids = mine.encode(text).tolist()
        assert ids == lib.encode(text) and mine.decode(ids) == lib.decode(ids)
    texts = AWKWARD
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in sentencepiece_fst.digests(docs, path).collect()}
    assert all(got[i].n_tokens == len(lib.encode(t or "")) and got[i].round_trip for i, t in enumerate(texts))
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_unigram_path_has_the_best_score():
    def field(n, kind, raw):
        return bytes([n * 8 + kind]) + (bytes([len(raw)]) if kind == 2 else b"") + raw

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("ab", -1.0, 1), ("a", -4.0, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    machine = sentencepiece_fst.Transducer(model)
    assert [machine.text[i] for i in machine.encode("ab")] == ["▁", "ab"]  # -4 beats -4.5
    assert machine.decode(machine.encode("ab")) == "ab"


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    near = [base[i % 20] + rng.standard_normal(16) * s for i, s in enumerate(np.linspace(0.05, 0.6, 200))]
    vectors = [v.tolist() for v in (*base, *near)] + [base[0].tolist(), (base[1] * 7).tolist(), None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    good = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in good}
    pairs = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    links = collections.Counter(x for p in pairs for x in p)
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, rep string")).collect()}
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(vectors) and 0.9 * 2 * len(pairs) <= found <= 2 * len(pairs)
    assert all(got[i].n_links <= links[i] for i in got)
    if found == 2 * len(pairs):
        assert [got[i].component_id for i in range(len(vectors))] == components(len(vectors), pairs)
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embedding_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    vectors = [(i, (centre + rng.standard_normal(8) * 0.05).tolist()) for i in range(90)]
    got = embedding_dedup.dedup(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {89} and {r.component_id for r in got} == {0}


def test_plan_keeps_recall():
    for n in (0, 1, 1000, 10**6, 10**9, 10**12):
        p = embedding_dedup.plan(n)
        assert n / 2**p.bits <= embedding_dedup.CELL and p.least > embedding_dedup.LINES / 2 and 2 <= p.tables < 512


def test_counts_of_quality_rules():
    def brute(text):
        words = text.encode().split()
        tri = collections.Counter(zip(words, words[1:], words[2:]))  # noqa: B905
        hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        return [len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)]

    rng = random.Random(9)
    for text in [t or "" for t in AWKWARD] + ["".join(rng.choice(["a ", "b ", "\n", "é", "#", "|x ", " ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(500)]:
        assert quality_rules.measure(text)[0] == brute(text)


def test_quality_rejects_junk(spark):
    good = [" ".join(prose(9) for _ in range(12)) for _ in range(80)]
    junk = [" ".join(w + "%%%" for w in prose(90).split()) for _ in range(12)]
    docs = documents(spark, good + junk + AWKWARD, extra=True)
    marks = spark.createDataFrame([(i, int(i < len(good)), "x") for i in range(len(good) + len(junk))] + [(0, 1, "y"), (None, 1, "z"), (3, None, "z")], "doc_id long, quality int, score string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.fit(docs, marks)).collect()}
    assert np.mean([got[i].kept for i in range(len(good))]) >= 0.95
    assert not any(got[i].kept for i in range(len(good), len(good) + len(junk)))
    assert all(got[i].base_failed and not got[i].kept for i in range(len(good) + len(junk), len(good) + len(junk) + 5))
    left = quality_rules.filtered(docs, marks)
    assert left.columns == docs.columns
    none = quality_rules.judge(docs, quality_rules.fit(docs, marks.limit(0))).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality_rules.filtered(documents(spark, []), marks).count() == 0


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(2)
    texts, marks = [], []
    for i in range(600):
        words = prose(40, rng).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Vileword!", "vileword", "nastyterm,"])
        texts.append(" ".join(words))
        marks.append((i, int(toxic)))
    docs = documents(spark, texts + AWKWARD, extra=True)
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].predicted == marks[i][1] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[600].score == got[601].score
    left = toxicity.filtered(docs, labels)
    assert left.columns == docs.columns and left.count() == len(texts) + len(AWKWARD) - 150
    assert {r.score < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {True}

    # a pair that is toxic only together: each term alone is as often clean
    lists, y = [], []
    for i in range(800):
        a, b = i % 2, i // 2 % 2
        lists.append(np.array([t for t, on in ((1, a), (2, b), (3 + i % 5, 1)) if on]))
        y.append(float(a and b))
    m = toxicity.train(lists, np.array(y))
    index = lambda *terms: [m.index[t] for t in terms if t in m.index]
    assert m.score(index(1, 2)) > 0.7 > 0.3 > max(m.score(index(1)), m.score(index(2)))


def test_language(spark):
    alphabets = {"xx": "abcdef", "yy": "uvwxyz", "zz": "дежзик"}
    rng = random.Random(8)
    langs = [rng.choice(list(alphabets)) for _ in range(200)]
    texts = [" ".join("".join(rng.choice(alphabets[x]) for _ in range(5)) for _ in range(30)) for x in langs]
    docs = documents(spark, texts + AWKWARD + ["123 !?"], langs + [None] * (len(AWKWARD) + 1), extra=True)
    model = language_id.fit(docs.where(common.crc_mod("doc_id", 5) != 0))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(200)] == langs and len(got) == docs.count()
    assert {got[200 + AWKWARD.index(t)].lang_pred for t in (None, "", " ", "\n\n")} | {got[200 + len(AWKWARD)].lang_pred} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (5, 5), (2000, 1000)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and (got[1000], got[2000]) == (1000, 1000)
    assert common.components(edges.limit(0)).count() == 0
