"""Each method against brute force, exact round trips or held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.llm import golay, graph, images, licenses, mixing, ngrams, quality, rules, shards, simhash, tokencount, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_golay_code_is_perfect_and_neighbours_share_indices():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    index = golay.index(w)
    assert len(set(golay.index(np.arange(1 << 12, dtype=np.int32) << 11).tolist())) <= 4096
    e = 1 << rng.integers(0, 23, 3000)
    near = golay.near_indices(w)
    assert all(golay.index(np.array([w[i] ^ e[i]], np.int32))[0] in near[i] for i in range(3000))
    assert ((near >= 0).sum(axis=1) <= 6).all() and all(index[i] in near[i] for i in range(3000))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("dense", [10**9, 3])
def test_links_connect_exactly_what_three_bits_connect(spark, dense):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for s in seeds:  # chains and clusters around each seed
        for _ in range(rng.randint(0, 9)):
            for _ in range(rng.randint(1, 4)):
                s ^= 1 << rng.randrange(64)
            fps.add(s)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = groups([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3], signed)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in graph.components(simhash.links(df, dense)).collect()}
    assert {f: found.get(f, f) for f in signed} == want


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5), (3, 2)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(80))


def test_simhash_of_spark_hashes(spark, docs, texts):
    """Fingerprints from Spark's own 64-bit hash of the shingles, and components by comparing all pairs."""
    few = texts.head(150)
    rows = [(int(i), " ".join(w)) for i, t in zip(few.doc_id, few.text) for ws in [t.encode().lower().split()] for w in _shingles(ws)]
    h = spark.createDataFrame(rows, "doc_id long, s string").select("doc_id", F.xxhash64("s").alias("h")).toPandas()
    found = {r.doc_id: r.fp for r in simhash.fingerprints(docs.where("doc_id < 150")).collect()}
    for i, g in h.groupby("doc_id"):
        bits = np.unpackbits(g.h.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        assert found[i] & ((1 << 64) - 1) == sum(1 << b for b in np.flatnonzero(bits * 2 > len(g)).tolist())


def _shingles(ws):
    ws = [w.decode() for w in ws]
    return [ws[i : i + 3] for i in range(len(ws) - 2)] if len(ws) >= 3 else [ws] if ws else []


def test_near_duplicates_equal_all_pairs(docs, texts):
    f = {int(i): simhash.fingerprint(t) for i, t in zip(texts.doc_id, texts.text)}
    ids = sorted(f)
    v = np.array([f[i] for i in ids], np.uint64)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in (np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 3) + i + 1)]
    want = groups(pairs, ids)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == want and len(set(want.values())) < len(ids)


def test_quality_on_held_out_labels(docs, labels):
    r = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.quality).mean() > 0.95
    assert (r[r.quality == 1].predicted).mean() > 0.95


def test_dual_coordinate_descent_meets_the_primal(spark):
    """The dual and the primal objective of a small problem agree at the end."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    offsets, places = np.arange(0, 301, 5), np.tile(np.arange(5), 60)
    w, b = quality.descend(offsets, places, x.ravel(), y, np.full(60, 0.5), 2000, 5)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    assert all(primal(w + rng.normal(size=5) * s, b + rng.normal() * s) >= best - 1e-3 for s in (0.01, 0.1, 1) for _ in range(200))


def test_scores_equal_a_plain_nbsvm(texts):
    """Ratios, scaled indicators, margins and the curve of each text, feature by feature."""
    m = texts.merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id").head(150)
    model = quality.fit(m)
    y = m.quality.to_numpy() > 0
    sets = [set(ngrams.indicators([t], **quality.HOW)[1].tolist()) for t in m.text]
    place = {int(f): k for k, f in enumerate(model["features"])}
    for f in list(place)[::997]:
        yes, no = (sum(f in s for s, up in zip(sets, y) if up == side) for side in (True, False))
        assert math.isclose(model["r"][place[f]], math.log((yes + 1) / (y.sum() + 2)) - math.log((no + 1) / ((~y).sum() + 2)))
    want = []
    for s in sets[:60] + [set()]:
        at = [place[f] for f in s if f in place]
        length = max(math.sqrt(sum(model["r"][k] ** 2 for k in at)), model["floor"])
        margin = sum(model["w"][k] * model["r"][k] / length for k in at) + model["bias"]
        want.append(1 / (1 + math.exp(-(model["a"] * margin + model["b"]))))
    got = quality.predict(model, [*m.text.tolist()[:60], None], ngrams.table(model["features"]))
    assert np.allclose(got, want)


def test_marked_features_equal_sorted_ones():
    ts = ["ab cd ab", None, "xy " * 50, "ab"] * 40
    d, f = ngrams.indicators(ts, (2, 3), True, False)
    chosen = np.unique(f)[::2].astype(np.int32)
    keep = ngrams.table(chosen)
    got = ngrams.indicators(ts, (2, 3), True, False, keep)
    ok = keep[f] >= 0
    assert np.array_equal(got[0], d[ok]) and np.array_equal(got[1], keep[f][ok])
    assert len(ngrams.indicators(ts, (2,), False, False, ngrams.table(np.zeros(0, np.int32)))[0]) == 0


def test_indicators_equal_a_plain_count():
    ts = ["ab ab ab cd", "x x x x x y y y " + "z " * 30, "", None, "é ab", "x" * 50, "ab\tcd ab"]
    d, f = ngrams.indicators(ts, (2, 3), True, False)
    per = Counter(d.tolist())
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    for i, t in enumerate(ts):
        b = (t or "").encode()
        w = b.split()
        runs = sum(any(len(set(w[k : k + n])) == 1 for k in range(len(w) - n + 1)) for n in ngrams.RUNS)
        assert per[i] == len(grams(b, 2)) + len(grams(b, 3)) + len(set(w)) + len(set(zip(w, w[1:]))) + runs


def test_toxicity_on_held_out_labels(docs, labels):
    r = toxicity.judge(docs, labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").where("held_out").toPandas()
    assert ((r.said == 1) & (r.toxic == 0)).sum() <= 1
    assert r[r.toxic == 1].said.mean() >= 0.6
    assert {"p_low_form", "p_toxic", "p_toxic_low_form"} <= set(r.columns)


def test_targets_equal_repeated_sharing(spark):
    """Shares are handed out and the excess over the caps handed out again until there is none."""
    rng = random.Random(2)
    for trial in range(6):
        sizes = {None if i == 0 and trial % 2 else f"s{i:02d}": rng.choice([0, 3, 50, 1000, 40000]) for i in range(rng.randint(1, 12))}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        left, target, open_ = float(sum(sizes.values())), dict.fromkeys(names, 0.0), set(names)
        while left > 1e-9 and open_:
            total = sum(weight[s] for s in open_)
            add = {s: left * weight[s] / total for s in open_}
            left = 0.0
            for s in list(open_):
                target[s] += add[s]
                if target[s] >= 3 * sizes[s]:
                    left += target[s] - 3 * sizes[s]
                    target[s] = 3.0 * sizes[s]
                    open_.remove(s)
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert all(math.isclose(found[s], target[s], abs_tol=1e-4) for s in names)


def test_sampling_takes_the_smallest_keys_up_to_the_budget(docs):
    rows = mixing.sized(docs).toPandas()
    m = mixing.mix(docs).toPandas().merge(rows[["doc_id", "key"]], on="doc_id")
    for _, g in m.groupby("source"):
        target, size = g.target.iloc[0], g.source_size.iloc[0]
        epochs = min(int(target // size), 3) if size else 0
        rest = target - epochs * size
        g = g.sort_values(["key", "doc_id"])
        middle = g["size"].cumsum() - g["size"] / 2
        want = g["size"] * (epochs + ((middle <= rest) & (epochs < 3)))
        assert (g.taken == want).all()


def test_better_documents_are_taken_more_often(spark):
    r = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("w"))
    k = r.select("w", mixing.exponential_key(F.col("doc_id"), F.col("w")).alias("k")).toPandas()
    first = k.nsmallest(800, "k").w
    assert (first == 1.0).mean() > 0.75
    assert abs(k[k.w == 1.0].k.mean() - 1) < 0.1 and abs(k[k.w == 0.2].k.mean() - 5) < 0.5


def test_token_scan_equals_encoding(docs, texts):
    want = {int(i): len(tokencount.encode(t)) for i, t in zip(texts.doc_id, texts.text)}
    for block in (50, 4096):
        got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs.repartition(3), block=block).collect()}
        assert got == want


def test_flat_files_without_an_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for k, lengths in enumerate([[0, 5, 0, 0, 3000, 1], [70], [], [0], rng.integers(0, 400, 60).tolist()]):
        ids = np.concatenate([np.append(rng.integers(0, 9, n), 9) for n in lengths]) if lengths else np.zeros(0)
        if k == 4:
            ids = ids[:-1]  # the last document isn't closed
        (tmp_path / f"f{k}.bin").write_bytes(ids.astype("<u2").tobytes())
        want |= {(k, o): n for o, n in enumerate(lengths) if k != 4 or o < len(lengths) - 1 or n}
    for block in (7, 100, 1 << 19):
        scanned = tokencount.scan_blocks(tokencount.read_files(spark, str(tmp_path), block=block), end=9)
        got = {(int(Path(r.stream).stem[1:]), r.ordinal): r.n_tokens for r in tokencount.stitched(scanned).collect()}
        assert got == want


def plain_words(t):
    return re.findall(licenses.TOKEN, t.lower())


def plain_spans(text, t=licenses.THRESHOLD):
    """The best coefficient over all spans of a text, by template, counting bags of bigrams anew for each span."""
    w = plain_words(text)
    g = list(zip(w, w[1:]))
    out = {}
    for j, (_, template) in enumerate(licenses.TEMPLATES):
        tw = plain_words(template)
        bag = Counter(zip(tw, tw[1:]))
        a, best = bag.total(), None
        for i in range(len(g)):
            if g[i] not in bag:
                continue
            here, shared = Counter(), 0
            for k in range(i, min(len(g), i + int(a * (2 - t) / t + 1e-9))):
                here[g[k]] += 1
                shared += here[g[k]] <= bag[g[k]]
                b = k - i + 1
                if b >= a * t / (2 - t) - 1e-9 and (best is None or (2 * shared / (a + b), -i, -k) > best):
                    best = 2 * shared / (a + b), -i, -k
        if best and best[0] >= t:
            out[j] = best[0], -best[1], -best[2]
    return out


@pytest.fixture(scope="module")
def licensed():
    by = {}
    for name, t in licenses.TEMPLATES:
        by.setdefault(name, []).append(t)
    mit, nc = by["MIT"][2], by["CC-BY-NC-4.0"][1].split()
    code = "def f(x):\n    return x + 1\n" * 40
    header = "/*\n * " + "\n * ".join(by["Apache-2.0"][1][i : i + 60] for i in range(0, len(by["Apache-2.0"][1]), 60)) + "\n */\n"
    dropped = " ".join(w for i, w in enumerate(mit.split()) if i % 25)
    return {
        1: " ".join(nc[: len(nc) // 2]), 2: " ".join(nc[len(nc) // 2 :]), 3: mit + "\n\n" + code, 4: header + code, 5: code,
        6: "word " * 30 + by["BSD-2-Clause"][0] + " more", 7: by["BSD-3-Clause"][0], 8: "A note. " + dropped + code,
        9: "Sources: Released under the the MIT License. See LICENSE. " + by["ISC"][0], 10: "of the software and the software or the use " * 60,
        11: "Licensed under CC BY-NC", 12: by["GPL-3.0"][1] + " " + by["LGPL-2.1"][0],
    }


def test_spans_equal_a_plain_search(spark, licensed):
    d = spark.createDataFrame(list(licensed.items()), "doc_id int, text string")
    marks = {r.m: r.doc_id for r in d.select("doc_id", F.md5("text").alias("m")).collect()}
    got = {(marks[r.mark], r.template): (r.dice, r.first, r.last) for r in licenses.spans(d).collect()}
    want = {(i, j): v for i, t in licensed.items() for j, v in plain_spans(t).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0]) and got[k][1:] == want[k][1:] for k in want)


def test_licences_inside_longer_texts(spark, licensed):
    d = spark.createDataFrame(list(licensed.items()), "doc_id int, text string")
    r = {x.doc_id: x for x in licenses.scan(d).collect()}
    assert [r[i].license for i in (3, 4, 6, 7, 8)] == ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT"]
    assert all(r[i].license is None for i in (1, 2, 5, 10)) and r[7].licenses == "BSD-3-Clause"
    assert r[9].licenses == "ISC,MIT" and r[12].licenses == "GPL-3.0,LGPL-2.1" and r[6].first_word == 30
    # rows that share an id, or have none, are judged each for itself
    halves = [(i, licensed[k]) for i in (5, None) for k in (1, 2)]
    assert all(x.license is None for x in licenses.scan(spark.createDataFrame(halves, "doc_id int, text string")).collect())


def swapped(n, draws):
    p = list(range(n))
    for i in range(n - 1, 0, -1):
        r = draws[i] % (i + 1)
        p[i], p[r] = p[r], p[i]
    return p


def test_fisher_yates_equals_swapping(spark):
    d = spark.range(70).select(F.col("id").cast("int").alias("n"), "id")
    draws = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).select("id", "i", F.xxhash64(F.lit(7), "id", "i").alias("h")).collect()
    h = {(r.id, r.i): r.h for r in draws}
    for r in d.withColumn("perm", shards.fisher_yates(F.col("n"), F.col("id"), 7)).collect():
        assert list(r.perm) == swapped(r.n, {i: h[r.id, i] for i in range(r.n + 1)})
    many = spark.range(6000).select(shards.fisher_yates(F.lit(3), F.col("id"), 1).alias("perm")).groupBy("perm").count().collect()
    assert len(many) == 6 and all(850 < r["count"] < 1150 for r in many)


def test_shards_equal_a_replay(spark, monkeypatch):
    """The whole external shuffle again in plain Python, from Spark's hashes of records and steps alone."""
    monkeypatch.setattr(shards, "BUCKET_BYTES", 20_000)
    rows = [(i, None if i % 50 == 0 else f"text {i % 40} " * (i % 7)) for i in range(800)] + [(None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = d.select("doc_id", "text", shards.content_key(d, shards.SEED).alias("key"))
    size = sum(len((t or "").encode()) + 16 + shards.RECORD_BYTES for _, t in rows)
    buckets = -(-size // 20_000)
    at = F.pmod(F.xxhash64(F.lit(shards.SEED + 1), F.col("key"), F.lit(0).cast("long")), F.lit(buckets).cast("long"))
    held = {}
    for r in keyed.withColumn("bucket", at).collect():
        held.setdefault(r.bucket, []).append((r.key, (r.doc_id is not None, r.doc_id or 0), (r.text is not None, r.text or "")))
    steps = spark.createDataFrame([(b, i) for b, rs in held.items() for i in range(len(rs))], "bucket long, i int")
    h = {(r.bucket, r.i): r.h for r in steps.select("*", F.xxhash64(F.lit(shards.SEED + 2), "bucket", "i").alias("h")).collect()}
    order = []
    for b in sorted(held):
        rs = sorted(held[b])
        order += [rs[i] for i in swapped(len(rs), {i: h[b, i] for i in range(len(rs))})]
    each, extra = divmod(len(rows), 7)
    ends = np.cumsum([0] + [each + (k < extra) for k in range(7)])
    want = Counter((k, o - ends[k], r[1][1] if r[1][0] else None) for k in range(7) for o in range(ends[k], ends[k + 1]) for r in [order[o]])
    got = shards.shard(d.repartition(5), shards.record_size(F.col("text")), 7).select("shard", "slot", "row.doc_id").collect()
    assert len(held) > 5 and Counter(map(tuple, got)) == want


def test_many_equal_records_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 50_000)
    monkeypatch.setattr(shards, "REPEATS", 10)
    d = spark.range(600).select(F.when(F.col("id") < 300, F.lit(0)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    placed, n = shards.external_shuffle(d, shards.record_size(F.col("text")))
    load = placed.groupBy("bucket").count().toPandas()
    assert n == 600 and load["count"].sum() == 600 and load["count"].max() < 200


def test_shard_law_on_documents(spark, docs):
    s = shards.shard(docs, shards.record_size(F.col("text"))).select("row.doc_id", "shard", "slot").toPandas()
    assert sorted(s.doc_id) == list(range(1000)) and s.groupby("shard").size().max() - s.groupby("shard").size().min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in s.groupby("shard"))
    again = shards.shard(docs.repartition(7), shards.record_size(F.col("text"))).select("row.doc_id", "shard", "slot").toPandas()
    assert set(map(tuple, s.to_numpy())) == set(map(tuple, again.to_numpy()))
    assert s.sort_values(["shard", "slot"]).doc_id.is_monotonic_increasing is False


def rule_row(i, lang, source, repeat, symbols, dup, n=200, width=5):
    """A text with a given number of repeated windows, symbol words and repeated lines."""
    word = lambda k: f"{lang}{source}{i}x{k}".ljust(width, "q")[-width:] + str(k)
    w = [word(k) for k in range(n)]
    for k in range(repeat):
        w[n // 2 + k] = w[k]
    w += ["$#%"] * 1 if symbols else []
    text = " ".join(w[: n // 2]) + "\n" + " ".join(w[n // 2 :]) + " &" * symbols
    return i, text + "\nagain" * dup, lang, source


def test_fences_follow_the_group_and_fire(spark):
    """Each metric's fence differs between groups, lets what is usual there pass, and catches planted outliers."""
    rows, i = [], 0
    usual = {"plain": (0, 0, 0, 5), "loose": (8, 12, 4, 9)}
    for source, (rep, sym, dup, width) in usual.items():
        for k in range(300):
            rows.append(rule_row(i, "en", source, rep * (k % 3) // 2, sym * (k % 2), dup * (k % 2), width=width))
            i += 1
    first = i
    for source in usual:
        for rep, sym, dup, width in ((45, 0, 0, 0), (0, 90, 0, 0), (0, 0, 40, 0), (0, 0, 0, 40)):
            rows.append(rule_row(i, "en", source, rep, sym, dup, width=width or usual[source][3]))
            i += 1
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    j = rules.judged(d).select("doc_id", "source", "base_failed", "kept", *rules.METRICS).toPandas()
    assert not j.base_failed.any() and j[j.doc_id < first].kept.mean() > 0.99
    assert not j[j.doc_id >= first].kept.any()
    limits = {r.source: r for r in rules.thresholds(rules.sketches(rules._rates(rules.metrics(d).withColumn("base_failed", F.lit(False))))).collect()}
    for name in (*[f"{m}_max" for m in rules.METRICS], "word_length_min"):
        assert limits["plain"][name] != limits["loose"][name], name
    assert limits["plain"].symbol_rate_max < limits["loose"].symbol_rate_max and limits["plain"].repeat_rate_max < limits["loose"].repeat_rate_max


def test_merged_quantiles_equal_a_plain_merge(spark):
    """Weighted quantiles of own, language's and corpus's values, on both sides of any group size."""
    rng = np.random.default_rng(12)
    rows = []
    for lang, source, n, scale in (("a", "x", 1, 5), ("a", "y", 40, 20), ("a", None, 700, 9), (None, "x", 3, 30), ("b", "z", 200, 2)):
        rows += [(lang, source, "word_length", int(v), 1) for v in rng.exponential(scale, n)]
    s = spark.createDataFrame(rows, "lang string, source string, metric string, cell long, n long")
    found = {(r.lang, r.source): r for r in rules.quantiles(s).collect()}
    every = np.array([r[3] for r in rows])
    for lang, source in {r[:2] for r in rows}:
        own = np.array([r[3] for r in rows if r[:2] == (lang, source)])
        near = np.array([r[3] for r in rows if r[0] == lang])
        below = lambda c: (own <= c).sum() + (near <= c).mean() * rules.OF_LANGUAGE + (every <= c).mean() * rules.OF_ALL
        total = len(own) + rules.OF_LANGUAGE + rules.OF_ALL
        for q in rules.QUANTILES:
            assert found[lang, source][f"q{q}"] == min(c for c in every if below(c) * 100 >= total * q - 1e-6)


def image_rows(spark, pictures):
    rows = [(i, a.shape[1], a.shape[0], bytearray(np.ascontiguousarray(a).tobytes())) for i, a in pictures]
    return spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")


def image_groups(d):
    """Components by holding all pairs of images against each other, of those that the tables' rule admits."""
    c = {r.image_id: np.frombuffer(bytes(r.corners), images.CORNER) for r in images.descriptors(d).collect()}
    pairs = []
    for a in sorted(c):
        for b in sorted(c):
            if a < b:
                parts = [np.ascontiguousarray(c[i]["bits"]).view("<u4")[:, : images.TABLES] for i in (a, b)]
                close = np.bitwise_count(c[a]["bits"][:, None] ^ c[b]["bits"][None]).sum(axis=-1) <= images.CLOSE_BITS
                met = (parts[0][:, None] == parts[1][None]) & close[:, :, None]
                if met.sum() >= images.AGREED and images.same_scene(c[a], c[b], 80):
                    pairs.append((a, b))
    return groups(pairs, [r.image_id for r in d.select("image_id").collect()]), len(pairs)


@pytest.mark.parametrize("crowded", [None, 6])
def test_image_groups_equal_brute_force(spark, monkeypatch, crowded):
    """With the shipped settings, and with keys taken as crowded that have 7 corners or more."""
    if crowded:
        monkeypatch.setattr(images, "CROWDED", crowded)
    vectors = list(np.random.default_rng(8).normal(0, 0.125, (30, 64)))
    plain = images.render(vectors)
    d = image_rows(spark, [(2 * i, a) for i, a in enumerate(plain)] + [(2 * i + 1, images.edited(plain[i], i)) for i in range(0, 30, 2)] + [(100 + i, images.edited(plain[3], 16 * i)) for i in range(25)])
    want, n = image_groups(d)
    found = {r.image_id: r.component_id for r in images.copies(d).collect()}
    assert found == want and n > 100 and len(set(want.values())) >= 28


def test_edited_copies_are_found_and_others_left_alone(spark):
    """Crops, turns, shrunk copies and quarter turns with other light and noise: recall by kind, and no link between different pictures."""
    vectors = list(np.random.default_rng(9).normal(0, 0.125, (200, 64)))
    plain = images.render(vectors)
    d = image_rows(spark, [(2 * i, a) for i, a in enumerate(plain)] + [(2 * i + 1, images.edited(plain[i], i)) for i in range(0, 200, 4)] + [(1000, plain[7])])
    c = {r.image_id: r.component_id for r in images.copies(d).collect()}
    hit = {k: np.mean([c[2 * i + 1] == 2 * i for i in range(0, 200, 4) if i // 4 % 4 == k]) for k in range(4)}
    assert np.mean(list(hit.values())) >= 0.9 and min(hit[k] for k in (0, 2, 3)) >= 0.9
    assert all(c[2 * i] == 2 * i for i in range(200)) and c[1000] == 14


def test_a_large_group_of_crops_is_one_component(spark):
    img = images.render([np.random.default_rng(5).normal(0, 0.125, 64)])[0]
    found = images.copies(image_rows(spark, [(i, images.edited(img, 16 * i)) for i in range(400)])).toPandas()
    assert (found.component_id == 0).all()


def test_near_copies_equal_brute_force(spark, docs, texts):
    from varloom.llm import nearcopies

    s = {int(i): frozenset(nearcopies._shingles(t, 5).tolist()) for i, t in zip(texts.doc_id, texts.text)}
    by = {}
    for i, x in s.items():
        for h in sorted(x)[:40]:
            by.setdefault(h, set()).add(i)
    met = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    similar = [(a, b) for a, b in met if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    want = groups(similar, sorted(s))
    found = {r.doc_id: int(r["head"]) for r in nearcopies.grouped(docs).collect()}
    assert np.mean([found[a] == found[b] for a, b in similar]) >= 0.97
    assert all(want[i] == want[h] for i, h in found.items())


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Keys with more than CROWDED texts: similar ones become one group, others that share the keys stay apart."""
    from varloom.llm import nearcopies

    monkeypatch.setattr(nearcopies, "CROWDED", 20)
    rng = random.Random(3)
    words = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join(words[:60] + [f"x{i}"] + words[60:])) for i in range(150)]
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(30)] + [(None, rows[0][1]), (None, "alone " * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = nearcopies.deduplicated(d).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["0", "None", *map(str, range(200, 230))])


def test_crc_rule_of_held_out_rows(spark):
    from varloom.llm.labelled import held_out

    r = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(x.h == (zlib.crc32(str(x.id).encode()) % 4 == 2) for x in r)


def test_no_near_copies_are_missed_at_the_threshold(spark):
    """Texts of 13 words that differ in the last, 8 of 10 shingles alike, and long ones with a group of copies between them."""
    from varloom.llm import nearcopies

    rng = random.Random(11)
    rows = []
    for i in range(200):
        words = [f"w{rng.randrange(5000)}" for _ in range(13)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:12], "other"]))]
    base = [f"v{k}" for k in range(200)]
    for i in range(60):  # a word in 50 changed, then in 12: those are similar to the base, not to each other
        words = list(base)
        for k in rng.sample(range(200), 4 if i % 2 else 7):
            words[k] = f"u{i}-{k}"
        rows.append((1000 + i, " ".join(words)))
    sets = {i: set(nearcopies._shingles(t, 5).tolist()) for i, t in rows}
    ids = sorted(sets)
    similar = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {(2 * i, 2 * i + 1) for i in range(200)} <= set(similar)
    found = {r.doc_id: int(r["head"]) for r in nearcopies.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == groups(similar, ids)


def test_no_table_of_fingerprints_goes_through_the_driver(docs):
    found = simhash.near_duplicates(docs)
    found.collect()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_shingle_sets_are_not_kept(docs, monkeypatch):
    from varloom.llm import nearcopies

    kept, run = [], nearcopies.cut
    monkeypatch.setattr(nearcopies, "cut", lambda df: kept.append(df.dtypes) or run(df))
    assert nearcopies.deduplicated(docs).count() > 0
    assert len(kept) > 4 and not any(t.startswith("array") for c in kept for _, t in c)


def test_texts_that_meet_by_chance_are_not_cut_into_sets(spark, monkeypatch):
    """Long texts any two of which share a passage of their own: none is near another, and no set is made to see that."""
    from varloom.llm import nearcopies

    rng = random.Random(8)
    parts = [[[f"t{i}-{k}" for k in range(800)]] for i in range(30)]
    for i in range(30):
        for j in range(i):
            passage = [f"p{i}-{j}-{k}" for k in range(6)]
            parts[i].append(passage)
            parts[j].append(passage)
    rows = []
    for i, some in enumerate(parts):
        rng.shuffle(some)
        rows.append((i, " ".join(w for p in some for w in p)))
    rows += [(100 + i, f"new {i} " + rows[i][1]) for i in range(3)]
    wanted, run = [], nearcopies.with_line_of

    def seen(rows, lines, keys, *a):
        if keys == [("mark", "w")]:
            wanted.append(lines.count())
        return run(rows, lines, keys, *a)

    monkeypatch.setattr(nearcopies, "with_line_of", seen)
    kept = nearcopies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(30))
    assert sum(wanted) == 6


def test_sketches_differ_in_no_more_bits_than_sets():
    from varloom.llm import nearcopies

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 31, 33, 500, 3000):
        s = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for k in sorted({0, 1, n // 10, n // 3, n}):
            t = np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, k // 2, np.uint64)]))
            apart = len(np.setxor1d(s, t))
            bits = nearcopies.bits_apart(nearcopies.sketch(s).tobytes(), nearcopies.sketch(t).tobytes())
            assert bits <= apart and (bits - apart) % 2 == 0
            if n == 3000 and k == n // 3:
                assert bits > apart / 2


def test_similar_texts_share_as_many_keys_as_their_prefixes_hold():
    from varloom.llm import nearcopies

    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int8)
    for n in (1, 4, 9, 63, 64, 65, 200, 1000):
        for _ in range(40):
            s = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))
            t = np.sort(s[gone:] if rng.random() < 0.5 else np.delete(s, rng.choice(n, gone, replace=False)))  # the worst: all differences come first
            o = int(np.ceil(len(np.union1d(s, t)) * 0.8))
            if len(t) < o:
                continue
            met = np.intersect1d(nearcopies.first_shingles(s, none), nearcopies.first_shingles(t, none))
            assert len(met) > min(len(s), len(t)) // nearcopies.MORE


def test_points_and_keys_of_few_fingerprints_are_not_broadcast(spark):
    """A few fingerprints, which Spark knows to be small, have 2,146 points and 16 keys each; these don't go through the driver."""
    fps = spark.range(1, 200).select((F.col("id") * 8).alias("fp")).distinct()
    for found in (simhash.dense_links(fps), simhash.links(simhash.cut(fps))):
        assert found.count() > 0
        found = found.select("a", "b")
        found.collect()
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
