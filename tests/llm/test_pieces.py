import random

import pytest

from varloom.llm.pieces import MODEL, Pieces

sp = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def table():
    return Pieces(MODEL)


def brute(p, text, n):
    """All segmentations of a short text, by recursion over the whole lattice."""
    s = " " + text
    into = {}
    for i, j, payload, score in p.edges(s):
        into.setdefault(i, []).append((j, payload, score))
    out = []

    def go(at, score, path):
        if at == len(s):
            out.append((score, [x for e in path for x in p.ids_of(e)]))
        for j, payload, sc in into.get(at, []):
            go(j, score + sc, [*path, payload])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])[:n]


@pytest.mark.parametrize("text", ["the cat", "a  b", "idée!", "x\ny", "snow ☃", "aaa aaa"])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_n_best_equals_all_segmentations(table, text, n):
    found = table.encode(text, n)
    want = brute(table, text, n)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in want])
    assert len({tuple(ids) for _, ids in found}) == len(found)
    assert all(table.decode(ids) == text for _, ids in found)


def test_best_path_equals_library_reading_of_the_scores(table):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1  # read the same scores as a unigram model's
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(rng.choice("thearnsoidüé,.") for _ in range(rng.randint(1, 9))) for _ in range(12))
        ours = table.encode(text, 1)[0]
        theirs = lib.encode(text)
        score = sum(lib.get_score(i) for i in theirs if not lib.is_byte(i))
        assert ours[0] == pytest.approx(score) or any(lib.is_byte(i) for i in theirs)
        assert lib.decode(ours[1].tolist()) == text


@pytest.mark.parametrize("text", ["", None, " ", "   ", "▁x", "\n\n", "tab\tend ", "😀 a"])
def test_round_trip_of_odd_texts(table, text):
    for _, ids in table.encode(text, 3):
        assert table.decode(ids) == (text or "")


def test_long_text_without_spaces(table):
    text = "ab" * 3000
    found = table.encode(text, 3)
    assert len(found) == 3 and found[0][0] >= found[1][0] >= found[2][0]
    assert all(table.decode(ids) == text for _, ids in found)
