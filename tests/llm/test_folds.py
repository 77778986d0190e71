"""What labels teach stays inside the folds, the mix comes near its targets whatever the ids, and fences follow their groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import mixing, ngrams, quality, rules, toxicity

WORDS = [f"w{i}x{i * 7 % 13}" for i in range(300)]


def random_texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=60)) for _ in range(n)]


def test_quality_margins_of_random_labels_are_near_chance():
    y = np.random.default_rng(1).random(300) < 0.5
    margin, counts = quality.out_of_fold(random_texts(300, 2), y)
    assert 0.38 < ((margin > 0) == y).mean() < 0.62
    whole = ngrams.document_counts(random_texts(300, 2), y, **quality.HOW)
    assert all((a == b).all() for a, b in zip(counts, whole, strict=True))


def test_toxicity_chain_of_random_labels_is_near_chance():
    rng = np.random.default_rng(3)
    y = np.stack([rng.random(240) < 0.5, rng.random(240) < 0.5, rng.random(240) < 0.5], axis=1)
    before, _ = toxicity.out_of_fold(random_texts(240, 4), y)
    right = ((before > 0) == y).mean(axis=0)
    assert before.shape == (240, 3) and ((right > 0.36) & (right < 0.64)).all()


def test_toxicity_chain_follows_plain_replay():
    texts = [("rotten bin " if i % 3 == 0 else "kind words ") * (3 + i % 4) + WORDS[i % 50] for i in range(90)]
    model = toxicity.fit(__import__("pandas").DataFrame({"text": texts, "quality": [i % 2 for i in range(90)], "toxic": [int(i % 3 == 0) for i in range(90)]}))
    got = toxicity.predict(model, texts, ngrams.table(model["features"]))
    place = {int(f): k for k, f in enumerate(model["features"])}
    for t, row in zip(texts[:20], got[:20], strict=True):
        own = [place[f] for f in set(ngrams.indicators([t], **toxicity.HOW)[1].tolist()) if f in place]
        seen = []
        for w, bias, v in model["links"]:
            seen.append(float(np.clip(w[own].sum() + bias + np.dot(seen, v), -8, 8)))
        assert np.allclose(1 / (1 + np.exp(-np.array(seen))), row)
    assert all((p > 0.5) == (i % 3 == 0) for i, p in enumerate(got[:, 1]))


@pytest.mark.parametrize("alike", [False, True])
def test_null_and_repeated_ids_come_near_the_target(spark, alike):
    text = lambda i: " ".join(["word"] * 8) if alike else " ".join([f"t{i}"] * 8)
    rows = [(None, text(i), "a") for i in range(1000)] + [(7, text(i), "b") for i in range(1000)] + [(i, text(i), None) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    per = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()
    assert len(per) == 3 and all(abs(r.taken - r.target) <= 8 for r in per)
    assert any(r.target % r.size for r in per)
    assert sum(r.taken for r in per) == mixing.mixed_documents(d).count() * 8


def test_fences_differ_between_groups_and_follow_their_quantiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = rules.judged_ids(docs).where("not base_failed").groupBy("lang", "source").agg(
        *[F.max(c).alias(c) for c in ("symbol_rate_max", "n_repeat_words_max", "n_dup_lines_max", "repeat_rate_max", "word_length_max")]
    ).collect()
    for c in ("symbol_rate_max", "n_repeat_words_max", "repeat_rate_max", "word_length_max"):
        assert len({r[c] for r in t}) > 3, c
    # ten times as many symbols everywhere move the fence
    rng = random.Random(5)
    prose = lambda per: " ".join(w + ("%" if rng.random() < per else "") for w in rng.choices(WORDS, k=120))
    rows = [(i, prose(0.01 if i % 2 else 0.1), "en", "few" if i % 2 else "many") for i in range(400)]
    d = rules.judged_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    fence = {r.source: r.m for r in d.groupBy("source").agg(F.max("symbol_rate_max").alias("m")).collect()}
    assert fence["many"] > 2 * fence["few"] and d.where("kept").count() > 380
