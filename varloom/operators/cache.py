"""Cache tables: values stored once and numbered, and bins for interval lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.ids import bin_of, bins
from varloom.operators.shared import stored


def numbered(rows: DataFrame, group: str, values: list[str], order: list[str], first_seen: str | None = None) -> DataFrame:
    """Distinct values of each group with an index from 0 in the given order, ties by first appearance.

    ``order``, or with ``first_seen`` the order and that, must tell the values of a group
    apart. They are sorted in ranges and stored once; an index is the place in its range and
    what earlier ranges hold of the group, so no task holds a whole group.
    """
    if first_seen is None:
        d, by = rows.select(group, *values).distinct(), order
    else:
        d, by = rows.groupBy(group, *values).agg(F.min(first_seen).alias("_first")), [*order, "_first"]
    # an id is the range's number and the place in the range
    d = d.repartitionByRange(group, *by).sortWithinPartitions(group, *by).select(group, *values, F.monotonically_increasing_id().alias("_id"))
    d = stored(d, "numbered").withColumn("_range", F.shiftright("_id", 33))
    parts = d.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.min("_id").alias("_begin"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_group").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    # stored, so that these lines, one for each group of a range, are known to be few before the values are shuffled to meet them
    parts = stored(parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "ranges")
    met = d.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return met.select(group, *values, (F.col("_id") - F.col("_begin") + F.col("_before")).alias("index"))


def binned(intervals: DataFrame) -> DataFrame:
    """One row for each 2^20-base bin that an interval (start, end) touches."""
    return intervals.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"))))


def overlaps(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Pairs of overlapping intervals (on, start, end; columns of b come with the prefix b_), met by bin and reported once.

    A pair is reported in the first bin that both touch, so none is repeated.
    """
    left = binned(a)
    right = binned(b)
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    met = left.join(right, (F.col(on) == F.col(f"b_{on}")) & (F.col("bin") == F.col("b_bin")) & (F.col("start") <= F.col("b_end")) & (F.col("b_start") <= F.col("end")))
    first = F.shiftright(F.greatest("start", "b_start").cast("long") - 1, 20)
    return met.where(F.col("bin") == first).drop("bin", "b_bin")


def overlap_sums(a: DataFrame, b: DataFrame, on: str, by: str, sums: dict[str, str]) -> DataFrame:
    """(by, n, ...): for each value of a column of ``a`` the number of pairs that ``overlaps`` has, and sums over them, without the pairs.

    Of the intervals that begin up to an end, those that end before the start are taken off.
    Both are read from running sums over the places of a 2^20-base bin, on top of what all
    earlier bins hold, so work grows with the intervals and not with the pairs. ``sums``
    names new columns and the whole numbers of ``b`` that they add up (nulls count as 0).
    Intervals whose end is before their start overlap nothing; values without a pair are left out.
    """
    held = {"n": F.lit(1)} | {k: F.coalesce(F.col(c), F.lit(0)) for k, c in sums.items()}
    sound = lambda d: d.where((F.col("start") <= F.col("end")) & F.col(on).isNotNull())

    def places(d: DataFrame, kind: int, at: Column, asks: bool) -> DataFrame:
        values = [(F.lit(0) if asks else v).cast("long").alias(f"_{k}") for k, v in held.items()]
        name = F.col(by) if asks else F.lit(None).cast(a.schema[by].dataType)
        return sound(d).select(F.col(on).alias("_on"), F.lit(kind).alias("_kind"), at.cast("long").alias("_at"), F.lit(asks).alias("_asks"), name.alias(by), *values)

    start, end = F.col("start"), F.col("end")
    rows = places(b, 0, start, False).union(places(b, 1, end + 1, False)).union(places(a, 0, end, True)).union(places(a, 1, start, True))
    rows = rows.withColumn("_bin", bin_of(F.col("_at")))
    bin_key, values = ["_on", "_kind", "_bin"], [f"_{k}" for k in held]
    earlier = W.partitionBy("_on", "_kind").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    # one line a bin, which comes before all places of its bin
    before = rows.groupBy(*bin_key).agg(*[F.sum(v).alias(v) for v in values]).withColumns({v: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values})
    before = before.withColumns({"_at": F.lit(None).cast("long"), "_asks": F.lit(False), by: F.lit(None).cast(a.schema[by].dataType)})
    upto = W.partitionBy(*bin_key).orderBy(F.col("_at").asc_nulls_first(), "_asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.unionByName(before).select(by, "_kind", "_asks", *[F.sum(v).over(upto).alias(v) for v in values]).where("_asks")
    signed = lambda v: F.sum(F.when(F.col("_kind") == 0, F.col(v)).otherwise(-F.col(v)))
    return found.groupBy(by).agg(*[signed(f"_{k}").alias(k) for k in held]).where("n > 0")


def in_order(transcripts: DataFrame) -> DataFrame:
    """Transcripts by chromosome, sorted by place within it."""
    return transcripts.repartitionByRange("ref_index", "start").sortWithinPartitions("ref_index", "start", "end")
