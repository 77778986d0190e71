"""Sharding by a two-pass external shuffle (native).

Pass one scatters whole records over buckets that fit in memory, by a seeded hash of their
content. Pass two gathers each bucket, orders it by a Fisher-Yates shuffle whose draws come
from a seeded hash of bucket and step, and writes it. Buckets in sequence make a uniform
permutation of all records; cutting it into equal runs gives shards whose counts differ by
one at most. Whole records are shuffled once; the numbers of a bucket's first record are
joined to them where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import cut, stored, with_line_of

SHARDS = 40
SEED = 9001
#: Memory of a bucket, and what a record takes beside its text.
BUCKET_BYTES, RECORD_BYTES = 16 << 20, 512
#: Equal records that may meet in one bucket; more are dealt over buckets by their place in the input.
REPEATS = 256
#: Chains of up to 2 ** LONGEST steps are followed; a bucket has fewer records.
LONGEST = 20
#: Buckets to a block in the two-level prefix sum of bucket sizes.
BLOCK = 4096


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """Permutation of 0..n-1 after swapping places i and r(i) = pmod(hash(seed, bucket, i), i + 1) for i = n-1..1.

    Arrays can't be changed in place, so the swaps are followed instead of made. After step
    i its place holds what stood at place r(i) then. That is whatever the last step before
    with the same draw put there, namely what stood at that step's own place j; and there
    stood what the last step before with draw j put there, and so on up to a place that no
    step had drawn. Two sorts find these steps, and chains are shortened by doubling, so n
    swaps cost n log n.
    """
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int")
    # draws (r, i, 0), and for each place p a question (p, p, 1): which step after in this order, before in time, drew p?
    drawn = lambda r: F.transform(r, lambda x, i: F.struct(x.alias("r"), i.alias("i"), F.lit(0).alias("asks")))
    asked = lambda r: F.transform(r, lambda _, i: F.struct(i.alias("r"), i.alias("i"), F.lit(1).alias("asks")))

    def following(s: Column, x: Column, k: Column) -> Column:
        one, two = F.get(s, k + 1), F.get(s, k + 2)
        nxt = F.when((x["asks"] == 0) & (one["asks"] == 1), two).otherwise(one)
        return F.struct(x["asks"].alias("asks"), x["i"].alias("i"), F.when(nxt["r"] == x["r"], nxt["i"]).alias("j"))

    def solved(r: Column, t: Column) -> Column:
        same = F.transform(F.slice(t, F.lit(1), F.size(r)), lambda x: x["j"])
        step = F.transform(F.slice(t, F.size(r) + 1, F.size(r)), lambda x: F.coalesce(x["j"], x["i"]))
        ends = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), step, lambda jump, _: F.transform(jump, lambda j: F.get(jump, j)))
        return _let(ends, lambda end: F.zip_with(r, same, lambda x, j: F.coalesce(F.get(end, j), x)))

    def ordered(r: Column) -> Column:
        steps = lambda s: F.sort_array(F.transform(s, lambda x, k: following(s, x, k)))
        return _let(F.sort_array(F.concat(drawn(r), asked(r))), lambda s: _let(steps(s), lambda t: solved(r, t)))

    return _let(F.transform(every, draw), ordered)


def content_key(df: DataFrame, seed: int) -> Column:
    """Seeded hash of all columns (as JSON where a type can't be hashed)."""
    plain = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(c) for c, t in df.dtypes]
    return F.xxhash64(F.lit(seed), *plain)


def external_shuffle(df: DataFrame, size: Column, seed: int = SEED) -> tuple[DataFrame, int]:
    """(row, bucket, place): ``row`` the whole record, ``place`` its place in its bucket; and the number of rows.

    A record's content alone decides its bucket and place, whatever the splits of the input.
    Only records that agree in all columns and come more than REPEATS times are dealt by
    their place in the input, which makes no difference to be seen; ``df`` should be read
    from a table, so that a lost task finds them in the same places again.
    """
    seen = df.select(content_key(df, seed).alias("key"), size.alias("size")).groupBy("key")
    seen = cut(seen.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    n, total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-(total + n * RECORD_BYTES) // BUCKET_BYTES))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), content_key(df, seed).alias("key"))
    often = cut(seen.where(F.col("n") > REPEATS).select(F.col("key").alias("o_key"), F.lit(True).alias("often")))
    dealt = F.lit(0).cast("long")
    if not often.isEmpty():
        rows = with_line_of(rows.withColumn("at", F.monotonically_increasing_id()), often, [("key", "o_key")])
        dealt = F.when(F.col("often"), F.col("at")).otherwise(dealt)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key"), dealt), F.lit(buckets).cast("long"))
    # records of equal keys stand in the order of their columns, so that no order of arrival shows
    gathered = rows.select(bucket.alias("bucket"), "key", "row").groupBy("bucket").agg(F.collect_list(F.struct("key", "row")).alias("rows"))
    ordered = F.array_sort("rows", _by_content) if any("map<" in t for _, t in df.dtypes) else F.sort_array("rows")
    gathered = gathered.select("bucket", ordered.alias("rows"), F.size("rows").alias("count"))
    # one column beside the records, as each projection copies these
    gathered = gathered.select("bucket", "rows", fisher_yates(F.col("count"), F.col("bucket"), seed + 2).alias("perm"))
    out = F.transform("perm", lambda i: F.when(i < F.size("rows"), F.get(F.col("rows"), i)["row"]))
    return gathered.select("bucket", F.posexplode(out).alias("place", "row")), n


def _by_content(a: Column, b: Column) -> Column:
    x, y = F.struct(a["key"], F.to_json(a["row"])), F.struct(b["key"], F.to_json(b["row"]))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def bucket_starts(placed: DataFrame) -> DataFrame:
    """First global place of each bucket; prefix sums within blocks of buckets and over the blocks."""
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("block", F.expr(f"bucket div {BLOCK}"))
    within = W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    over = W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    blocks = counts.groupBy("block").agg(F.sum("c").alias("bc"))
    blocks = blocks.select("block", (F.sum("bc").over(over) - F.col("bc")).alias("before"))
    counts = counts.withColumn("start", F.sum("c").over(within) - F.col("c"))
    return counts.join(blocks, "block").select(F.col("bucket").alias("s_bucket"), (F.col("start") + F.col("before")).alias("start"))


def shard(df: DataFrame, size: Column, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(row, shard, slot): all records by law ``rows``, shard counts at most one apart, slots gapless from 0.

    The shuffled records are stored in the shared folder once, as pass two writes them;
    bucket sizes are then counted there, and each bucket's start is joined to its records
    (one line a bucket: broadcast while these are few, see ``with_line_of``). Nulls in any
    column are kept and hash like other values, repeated rows are spread like different
    ones, an empty table gives an empty result, and whatever columns ``df`` has stay inside
    ``row``.
    """
    placed, n = external_shuffle(df, size, seed)
    placed = stored(placed, "shards")
    starts = cut(bucket_starts(placed.select("bucket")))
    # shards 0 .. extra-1 have one record more than the others
    each, extra = divmod(n, shards)
    placed = with_line_of(placed, starts, [("bucket", "s_bucket")]).withColumn("rank", F.col("start") + F.col("place"))
    longer = F.lit(extra * (each + 1)).cast("long")
    in_longer = F.col("rank") < longer
    number = F.when(in_longer, F.expr(f"rank div {each + 1}")).otherwise(
        F.lit(extra) + F.expr(f"(rank - {extra * (each + 1)}) div {max(each, 1)}")
    )
    slot = F.when(in_longer, F.col("rank") % (each + 1)).otherwise((F.col("rank") - longer) % max(each, 1))
    return placed.select("row", number.cast("int").alias("shard"), slot.cast("long").alias("slot"))
