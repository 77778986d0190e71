"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varloom.llm import images, licenses, mixing, nearcopies, pieces, quality, rules, shards, simhash, tokencount, toxicity

PROSE = "the quick brown fox jumps over a lazy dog while many other animals look on from the quiet hill "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key double, kept string, fp string, bucket int, n long"


@pytest.fixture(scope="module")
def docs(spark):
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: PROSE.upper().swapcase().replace("the", "zebra").replace("o", "uo") * 9000, 5: PROSE * 6, 6: PROSE * 6, 7: "word", 8: "stupid $$$ word !!! " * 30,
        9: "Released under the MIT License.\n" + PROSE, 10: "é ß 😀 ▁ " * 40, 11: "a\x00b   c",
    }
    rows = [(i, t, None if i == 5 else "en", None if i == 6 else f"s{i % 3}", None, 1, "r", 0.5, "k", "f", 2, 3) for i, t in texts.items()]
    rows += [rows[4], rows[4], (None, PROSE, None, None, None, None, None, None, None, None, None, None), (None, None) + (None,) * 10]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, 0), (4, 1, None), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPS = {
    "quality": lambda d, lab: quality.classify(d, lab),
    "mix": lambda d, lab: mixing.mix(d),
    "mixed": lambda d, lab: mixing.mixed_documents(d),
    "tokens": lambda d, lab: tokencount.token_counts(d, block=64),
    "toxicity": lambda d, lab: toxicity.judge(d, lab),
    "licenses": lambda d, lab: licenses.scan(d),
    "pieces": lambda d, lab: pieces.digests(d),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "dedup": lambda d, lab: nearcopies.deduplicated(d),
    "shards": lambda d, lab: shards.shard(d, shards.record_size(F.col("text")), 5),
    "rules": lambda d, lab: rules.judged(d),
    "rule_ids": lambda d, lab: rules.judged_ids(d),
}
#: Operators that return a row for each row.
WHOLE = {"quality", "mix", "tokens", "toxicity", "licenses", "pieces", "simhash", "shards", "rules", "rule_ids"}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(docs, labels, name):
    found = OPS[name](docs, labels).collect()
    if name in WHOLE:
        assert len(found) == docs.count()
        if name != "shards":
            assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(docs, labels, name):
    assert OPS[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(docs, labels, name):
    assert len(OPS[name](docs, labels.limit(0)).collect()) == docs.count()


def test_defined_values(docs, labels):
    counts = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] > 9000 * 15
    s = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert s[1].fp == s[2].fp == s[3].fp == 0 and {s[i].component_id for i in (1, 2, 3)} == {1} and s[6].component_id == 5
    p = {r.doc_id: r for r in pieces.digests(docs).collect()}
    assert all(r.round_trip for r in p.values()) and p[2].n_pieces == 0 and p[1].scores == [0.0]
    m = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert m[1].size == m[3].size == 0 and all(r.taken <= 3 * r.size for r in m.values())
    j = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert j[2].base_failed and not j[2].kept and j[1].n_words == 0 and j[1].row == "r"
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert found[9].license == "MIT" and found[9].first_word == 0 and found[9].n_words == 5 and found[4].license is None and found[1].n_matches == 0
    kept = nearcopies.deduplicated(docs).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(5) == 1 and 6 not in ids and 2 not in ids and ids.count(1) == 1 and ids.count(None) == 1


def test_stages_keep_the_columns(spark, tmp_path, docs, labels):
    few = docs.select("doc_id", "text", "lang", "source", "n_chars")
    few.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == few.columns, name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not round_trip").count() == 0


def test_image_edges(spark):
    img = images.render([[0.1 * ((i * 7) % 11 - 5) for i in range(64)]])[0]
    part = images.edited(img, 0)
    px = lambda a: bytearray(a.tobytes())
    rows = [
        (1, 80, 80, px(img), "x"), (2, 80, 80, px(img), "x"), (3, 64, 64, px(part), "x"), (4, 80, 80, None, "x"), (5, 10, 10, bytearray(100), "x"),
        (6, 80, 80, bytearray(3), "x"), (None, 80, 80, px(img), "x"), (7, None, 80, px(img), "x"), (1, 80, 80, px(img), "x"),
    ]
    d = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, key string")
    found = images.copies(d).collect()
    by = {r.image_id: r for r in found}
    assert len(found) == len(rows)
    assert by[2].class_id == 1 and by[3].component_id == 1 and by[4].component_id == 4 and by[5].component_id == 5
    assert images.copies(d.limit(0)).count() == 0


def test_different_texts_under_one_id_all_stay(spark):
    """Only near copies go: a text isn't left out for sharing its doc_id with another, or with one that goes."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(0, a), (1, a + " end"), (1, b), (2, c), (2, d), (2, d), (3, b), (None, c), (None, "alone")]
    kept = nearcopies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("0", a), ("1", b), ("2", c), ("2", d), ("None", "alone")])
