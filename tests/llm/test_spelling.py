"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from varloom.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form = {}
    for w, n in counts.items():
        some = sorted((-m, v) for v, m in counts.items() if near(w, v))
        best = some[0] if some and -some[0][0] >= 2 * n else None
        form[w] = (best[1] if best else None, len(some), -best[0] if best else None)
    out = {}
    for w, n in counts.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out[w] = (w, form[w][0], root, n, form[w][1], form[w][2])
    return out


def brute_counts(docs, least=3):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = ("ab", "abcé", "xyÿ")[seed]
    counts = {"".join(rng.choices(letters, k=rng.randint(1, 7))): rng.choice((1, 2, 3, 4, 8, 8, 16, 40, 100)) for _ in range(220)}
    d = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: tuple(r) for r in spelling.variants(d).collect()}
    assert found == brute_variants(counts)
    pairs = [tuple(r) for r in spelling.near_pairs(d).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if near(a, b)}


def test_a_long_chain_of_forms(spark):
    words = {"a" * (5 + k): 2**k for k in range(30)}
    found = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"a" * 34}


def test_counts_of_odd_documents(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcDEFéÿ×÷ñ", k=rng.randint(1, 70))) for _ in range(60)]
    docs = [(i, rng.choice((" ", "€", "\n", "7", "\x85")).join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(80)]
    docs += [(80, None), (81, ""), (None, " ".join(words)), (None, None), docs[3], docs[3], (82, "ÀÉabc Straße naïve " * 4000), (83, "q" * 300_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "form": F.lit(2)}).repartition(4)
    assert {r.word: r.n for r in spelling.word_counts(d).collect()} == brute_counts(docs)
    found = {r.word: tuple(r) for r in spelling.spelling_variants(d).collect()}
    assert found == brute_variants(brute_counts(docs))
    assert spelling.spelling_variants(d.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_cut_no_run(monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(200):
        text = "".join(rng.choices("abcXYZéÿ×÷ \n€😀1-ſK\x85\xa0", k=rng.randint(0, 120))) + "ab" * rng.randint(0, 40)
        found = [r.decode("latin-1") for some in spelling.runs_of(text) for r in some]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert found == re.findall("[a-zÀ-ÿ]+", low)
