"""The transducer's machines against the library: ids of every kind, odd bytes, user-defined pieces, long unbroken text."""

import itertools
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from cutloom.llm import sentencepiece_fst as S  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return S.compiled(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_any_ids_decode_as_the_library_has_them(both):
    mine, lib = both
    rng, n = random.Random(2), len(mine.text)
    special = [i for i in range(n) if mine.kinds[i] != S.NORMAL]
    spaces = [i for i, t in enumerate(mine.text) if t.startswith(S.MARK)]
    for ids in ([1, 2], [0], [1, 0, 2], [1, spaces[0]], []):
        assert mine.decode(ids) == lib.decode(ids)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(n), rng.choice(special), rng.choice(spaces))) for _ in range(rng.randint(0, 12))]
        assert mine.decode(ids) == lib.decode(ids), ids


def test_long_unbroken_text(both):
    mine, lib = both
    rng = random.Random(5)
    for alphabet in ("ab", "etaoinshrdlu", "aé日😀-=", "1234567890", "."):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        assert mine.encode(text).tolist() == lib.encode(text)


def test_the_trie_holds_just_the_pieces(both):
    mine, _ = both
    found, todo = {}, [(0, "")]
    while todo:
        state, text = todo.pop()
        if mine.final[state] >= 0:
            found[text] = mine.final[state]
        todo += [(after, text + c) for c, after in mine.arcs[state].items()]
    assert found == mine.pieces


def field(n, kind, raw):
    return bytes([n * 8 + kind]) + (bytes([len(raw)]) if kind == 2 else b"") + raw


def model(pieces, *spec):
    rows = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    return S.Transducer(rows + b"".join(spec))


def test_shortest_path_is_the_least_of_all_paths():
    rng = random.Random(7)
    texts = ["".join(x) for k in (1, 2, 3) for x in itertools.product("ab▁", repeat=k)]
    machine = model([("<unk>", 0.0, S.UNKNOWN)] + [(t, -rng.uniform(1, 9), S.NORMAL) for t in texts])

    def paths(unit):
        return [(p, *rest) for p in texts if unit.startswith(p) for rest in paths(unit[len(p) :])] if unit else [()]

    for _ in range(60):
        unit = "".join(rng.choice("ab▁") for _ in range(rng.randint(1, 7)))
        best = min(sum(-machine.score[machine.pieces[p]] for p in path) for path in paths(unit))
        assert sum(-machine.score[i] for i in machine.shortest(unit)) == pytest.approx(best)


def test_user_pieces_come_first():
    machine = model([("<unk>", 0.0, S.UNKNOWN), ("▁", -3.0, 1), ("a", -1.0, 1), ("ab", -0.5, 1), ("b", -1.0, 1), ("bb", 0.0, S.USER), ("bbc", 0.0, S.USER), ("c", -1.0, 1)])
    assert [machine.text[i] for i in machine.encode("abbc")] == ["▁", "a", "bbc"]
    assert [machine.text[i] for i in machine.encode("abba")] == ["▁", "a", "bb", "a"]
    assert machine.encode("z").tolist() == [1, 0] and machine.decode([1, 0]) == S.UNKNOWN_TEXT
