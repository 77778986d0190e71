"""Integer k-means and near-duplicate vectors against brute force, and over odd rows."""

import hashlib
import math

import numpy as np
import pytest

from varloom.llm import cells, centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, id int, n int, v string"


def random_rows(seed, n, components, spread=0.08, groups=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, components))
    rows = []
    for i in range(n):
        g = int(rng.integers(groups))
        v = base[g] * rng.uniform(0.5, 3) + rng.normal(size=components) * spread * (g % 4)
        rows.append((i * 3 % 1000 + i // 1000, v.tolist(), int(g % 3), "c", 1, 2, "v"))
    return rows


def brute_centroids(rows, components, clusters, rounds):
    v = [(i, [math.floor(64.0 * x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, k, strict=True)), i) for i, k in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in v]
        c = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [x for (_, x), k in zip(v, at, strict=True) if k == i]) else c[i] for i in range(len(c))]
    out = [(i, *reversed(near(x))) for i, x in v]
    per = {k: sum(d for _, kk, d in out if kk == k) for k in range(len(c))}
    mark = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, d, per[k], sum(per.values()), mark[k]) for i, k, d in out), key=str)


ODD = [
    (None, [0.5] * 64, 1), (1, None, 1), (2, [], 1), (3, [0.1] * 63, 1), (4, [0.1] * 63 + [None], 1), (5, [0.1] * 63 + [float("nan")], 1),
    (6, [0.1] * 63 + [float("inf")], 1), (7, [0.0] * 64, 1), (8, [-0.3] * 64, None), (9, [0.25] * 64, 2), (9, [0.25] * 64, 2), (9, [-0.25] * 64, 2),
    (10, [0.5] * 64, 1), (11, [1.0] * 64, 1), (12, [1e-300] * 64, 1), (13, [1e300] * 64, 1),
]


@pytest.mark.parametrize("case", ["many", "few", "odd"])
def test_centroids_equal_brute_force(spark, case):
    rows = [(*r, "c", 1, 2, "v") for r in ODD if r[0] != 13] if case == "odd" else random_rows(3, 150 if case == "many" else 5, 64)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in centroids.clustered(d).collect()), key=str)
    assert found == brute_centroids(rows, 64, 16, 3)


def test_huge_components_are_held_within_longs(spark):
    d = spark.createDataFrame([(i, [x] * 64, 1) for i, x in enumerate((1e300, -1e300, 0.0, 1.0))], "vec_id long, embedding array<double>, label int")
    found = centroids.clustered(d).collect()
    assert len(found) == 4 and all(r.distance >= 0 for r in found)
    assert centroids.clustered(d.limit(0)).collect() == [] and len(centroids.clustered(d.limit(0)).columns) == 6


def brute_links(rows, near):
    def unit(e):
        if e is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e) / max(map(abs, e))
        return x / math.sqrt((x * x).sum())

    u = [unit(r[1]) if r[2] is not None else None for r in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= near:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], n[i], least, r[0] is not None and r[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells_and_block", [(1, 4096), (12, 4096), (12, 7), (40, 3)])
def test_near_vectors_equal_brute_force(spark, cells_and_block):
    k, block = cells_and_block
    for components in (64, 3):
        rows = random_rows(5, 300, components)
        d = spark.createDataFrame(rows, SCHEMA).repartition(5)
        found = sorted((tuple(r) for r in cells.near_duplicates(d, cells=k, block=block).collect()), key=str)
        want = brute_links(rows, 0.98)
        assert found == want and sum(r[1] for r in want) > 500


def test_near_vectors_over_odd_rows(spark):
    rows = [(*r, "c", 1, 2, "v") for r in ODD]
    d = spark.createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in cells.near_duplicates(d, cells=2, block=2).collect()), key=str)
    assert found == brute_links(rows, 0.98)
    assert cells.near_duplicates(d.limit(0)).collect() == []


def test_visits_lose_no_pair():
    rng = np.random.default_rng(8)
    for components, k in ((2, 6), (8, 30), (64, 50)):
        u = rng.normal(size=(500, components))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = u + rng.normal(size=u.shape) * 0.19 / math.sqrt(components)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        c = cells.spherical(u, k)
        (h1, r1, c1), (h2, r2, c2) = cells.cells_of(u, c), cells.cells_of(v, c)
        a, b = set(zip(r1.tolist(), c1.tolist(), strict=True)), set(zip(r2.tolist(), c2.tolist(), strict=True))
        close = [i for i in range(500) if u[i] @ v[i] >= 0.98 and h1[i] != h2[i]]
        assert close and all(((i, h2[i]) in a) if h2[i] < h1[i] else ((i, h1[i]) in b) for i in close)
