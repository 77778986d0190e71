"""Integer k-means with native expressions.

Vectors become arrays of integers, so that distances, sums and means are exact and a lost
task made again gives the same. In each round the centroids are literal arrays of the
plan: ``zip_with`` and ``aggregate`` give a vector's distance to each, ``array_min`` of
(distance, number) its cluster, and one aggregation of 64 column sums a cluster's new
centroid. Only those sums, a line for each centroid, reach the driver; vectors are read
where they lie, once a round, and never shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import stored

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
SEED = "1:"
#: Integer components are held within this, so that squared distances stay below 2 ** 63. Only numbers beyond 2 ** 21 meet it.
MOST = 1 << 27


def whole(embedding: Column, components: int = COMPONENTS) -> Column:
    """Whether the vector has just so many components, none of them null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) == components) & F.forall(embedding, fine), F.lit(False))


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs."""
    held = lambda x: F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))
    return F.transform(embedding, lambda x: F.floor(held(x)).cast("long"))


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that count."""
    return vectors.where(whole(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("v"))


def _literal(centroid: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'bigint({c})' for c in centroid)})")  # one call instead of one for each number


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid; of equally near ones that with the smallest number.

    A squared distance is the sum of both squares less twice the product; the vector's
    square is the same for all centroids and the centroid's is a literal, so a component
    costs one product.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    square = total(F.transform(v, lambda x: x * x))

    def distance(c: list[int]) -> Column:
        product = total(F.zip_with(v, _literal([-2 * x for x in c]), lambda x, y: x * y))
        return product + F.lit(sum(x * x for x in c)).cast("long")

    least = F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))
    return F.transform(F.array(least), lambda m: F.struct((m["distance"] + square).alias("distance"), m["cluster"].alias("cluster")))[0]


def seeds(v: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    """The vectors with the smallest digests of seed and id, in order; equal digests by vector, null ids last."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = v.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(clusters).collect()
    return [r.v for r in rows]


def updated(v: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of the clusters' vectors; a centroid without vectors stays."""
    n = len(centroids[0])
    found = v.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v").groupBy("cluster")
    # one line for each centroid
    rows = found.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(n)]).collect()
    out = list(centroids)
    for r in rows:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(n)]
    return out


def fit(v: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> list[list[int]]:
    """Centroids of (vec_id, v) after some rounds; fewer vectors than clusters give as many centroids."""
    centroids = seeds(v, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = updated(v, centroids)
    return centroids


def assigned(v: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of (vec_id, v)."""
    return v.select("vec_id", nearest(F.col("v"), centroids).alias("at")).select("vec_id", "at.cluster", "at.distance")


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts.

    Vectors that are null, of another length or with null, NaN or infinite components are
    left out. Repeated rows count each; rows with a null vec_id take part and begin no
    cluster unless others are too few; equal distances go to the smaller number; an empty
    table gives an empty result; other columns are ignored. Sums beyond a long are null.
    """
    v = kept(vectors)
    centroids = fit(v, clusters, rounds)
    if not centroids:
        none = v.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    a = stored(assigned(v, centroids), "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in a.groupBy("cluster").agg(total.alias("s")).collect()}
    as_long = lambda x: x if abs(x) < 1 << 63 else None
    of = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return a.select(
        "vec_id", "cluster", "distance",
        of([as_long(sums.get(k, 0)) for k in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(as_long(sum(sums.values()))).cast("long").alias("inertia"),
        of(marks, "string").alias("centroid_sha256"),
    )
