"""SimHash near-duplicates met by Golay-code fuzzy keys.

Fingerprints are cut into segments of 23, 23 and 18 bits. If two differ in three bits at
most, some two of the three segments hold one flip each at most (drop the segment with
the most). For such a pair of segments one fingerprint files itself under every index
near its first segment and the index of its second, the other under the index of its
first and every index near its second; one key is then equal. Keys meet in an equality
join of about 16 narrow rows a side for each distinct fingerprint, whose condition also
checks the Hamming distance, so only true links leave it.

Equal fingerprints are one node, whatever their number. Keys under which very many
different fingerprints are filed (a large group of near copies) don't go through pairs:
there, fingerprints are joined through the points between them, see ``dense_links``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm import golay
from varloom.llm.common import cut, with_columns
from varloom.llm.graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Low bit and width of the segments.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: Keys with more fingerprints on a side than this go through points between instead.
DENSE = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 for null and blank texts."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lower() and split() of bytes know ASCII only
    if not w:
        return 0
    parts = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False)) if len(w) >= shingle else [b" ".join(w)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some digests."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        some = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""

    def make(texts: list) -> list:
        return [np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64)]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_columns(rows, "text", ["doc_id"], [("fp", T.LongType())], make)


def keys_of(fp: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of fingerprints: near indices of the first segment of each pair on side "q", of the second on side "i"."""
    segs = [((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int32) for lo, n in SEGMENTS]
    rows, keys = [], []
    for p, (a, c) in enumerate(combinations(range(3), 2)):
        wide, one = (a, c) if side == "q" else (c, a)
        near, single = golay.near_indices(segs[wide]), golay.index(segs[one])
        row, col = np.nonzero(near >= 0)
        first, second = near[row, col].astype(np.int64), single[row].astype(np.int64)
        if side == "i":
            first, second = second, first
        rows.append(row)
        keys.append((p << 24) | (first << 12) | second)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(fps: DataFrame, side: str) -> DataFrame:
    """(key, fp) of one side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 50_000):
                fp = b["fp"].to_numpy()[at : at + 50_000]
                row, key = keys_of(fp.astype(np.uint64), side)
                yield pd.DataFrame({"key": key, "fp": fp[row]})

    return fps.select("fp").mapInPandas(run, "key long, fp long")


def _hamming(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def dense_links(fps: DataFrame) -> DataFrame:
    """Links that connect all of ``fps`` within three bits, without pairs.

    Two fingerprints at most three bits apart have a point within one bit of the one and
    two bits of the other. Each fingerprint visits the 65 points within one bit ("near")
    and the 2,081 within two. At a point with a near visitor, all visitors are at most
    three bits from its smallest near visitor, and are linked to that one alone; whoever
    is linked through the point is so connected. Work is in proportion to the fingerprints.
    """

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = [0] + [1 << i for i in range(64)]
        two = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
        masks = np.array(one + two, np.uint64)
        near = np.arange(len(masks)) < len(one)
        for b in batches:
            for at in range(0, len(b), 200):
                u = b["fp"].to_numpy()[at : at + 200].astype(np.uint64)
                points = (u[:, None] ^ masks[None, :]).ravel().astype(np.int64)
                yield pd.DataFrame(
                    {"point": points, "fp": np.repeat(u.astype(np.int64), len(masks)), "near": np.tile(near, len(u))}
                )

    visits = fps.select("fp").mapInPandas(visit, "point long, fp long, near boolean")
    centre = visits.where("near").groupBy("point").agg(F.min("fp").alias("centre"))
    # merged: by the size of ``fps`` Spark would take 2,146 rows of each for few, and broadcast them through the driver
    return visits.hint("merge").join(centre.hint("merge"), "point").where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b) with the same connected components as all pairs of distinct ``fps`` within three bits."""
    q, i = _keys(fps, "q"), _keys(fps, "i")  # cheaper to make again than to keep
    load = q.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    full = cut(load.select("key"))
    if full.isEmpty():
        return _met(q, i)
    full = F.broadcast(full)  # one key for ``dense`` rows at most
    crowded = q.join(full, "key").select("fp").union(i.join(full, "key").select("fp")).distinct()
    return _met(q.join(full, "key", "left_anti"), i.join(full, "key", "left_anti")).union(dense_links(crowded))


def _met(q: DataFrame, i: DataFrame) -> DataFrame:
    i = i.withColumnRenamed("fp", "fp2")
    on = (q["key"] == i["key"]) & (F.col("fp") < F.col("fp2")) & (_hamming("fp", "fp2") <= MAX_BITS)
    return q.hint("merge").join(i.hint("merge"), on).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable.

    Null and blank texts have fingerprint 0 and are linked like any other; repeated rows
    and ties fall into one component; rows with a null doc_id take part, but do not name a
    component unless all its ids are null; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = cut(fingerprints(docs))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps))
    # tables of a row a fingerprint: merged, as a broadcast would hold them in the driver
    named = fps.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least.hint("merge"), "root").select(F.col("fp").alias("fp2"), "component_id")
    return rows.join(by_fp.hint("merge"), F.col("fp") == F.col("fp2"), "left").select("doc_id", "fp", "component_id")
