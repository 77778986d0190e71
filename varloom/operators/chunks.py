"""Reference sequence as a chunked table, and variants placed on it.

A chromosome is cut into chunks that each carry a margin of their neighbours, so one
equality join on (chrom, chunk) gives a variant every base it may need: upstream bases
for left alignment and duplication checks, downstream ones for right rotation. Chunks
keep work even where chromosomes differ in length, and at any size both sides are
shuffled by the same key; only pure insertions and deletions need the join at all.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.text import common_prefix, common_suffix, head, tail
from varloom.operators.shared import stored

CHUNK = 1 << 20
MARGIN = 1 << 13
#: Bases looked at for right rotation, unless the allele is longer.
DOWNSTREAM = 500


def cut_sequences(sequences: DataFrame, size: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(chrom, chunk, lo, seq, length) of (chrom, seq): ``lo`` is the 0-based place of the first base in ``seq``."""
    n = F.length("seq")
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"cast(greatest(length(seq) - 1, 0) div {size} as int)")))
    s = sequences.select("chrom", "seq", n.alias("length"), chunk.alias("chunk"))
    lo = F.greatest(F.col("chunk") * size - margin, F.lit(0))
    hi = F.least((F.col("chunk") + 1) * size + margin, F.col("length"))
    return s.select(
        "chrom", "chunk", lo.cast("long").alias("lo"), F.substring(F.col("seq"), lo + 1, hi - lo).alias("seq"), F.col("length").cast("long").alias("length")
    )


def cut_pieces(pieces: DataFrame, lengths: DataFrame, size: int = CHUNK, margin: int = MARGIN, key: str = "chrom") -> DataFrame:
    """The chunks of ``cut_sequences`` from pieces (key, place, piece), ``place`` from 0, and one line a sequence (key, length, ...).

    A piece gives each chunk that it reaches its part, and a sequence each of its chunks a
    line with its other columns, so that pieces are shuffled once and joined with nothing;
    no row is longer than a piece or a chunk with its margins. Pieces without a line go.
    """
    more = [c for c in lengths.columns if c not in (key, "length")]
    first, last = (F.expr(f"cast(greatest({x}, 0) div {size} as int)") for x in (f"place - {margin}", f"place + length(piece) - 1 + {margin}"))
    p = pieces.where(F.length("piece") > 0).select(key, "place", "piece", F.explode(F.sequence(first, last)).alias("chunk"))
    at = F.col("chunk").cast("long") * size
    lo = F.greatest(at - margin, F.lit(0))
    begin = F.greatest(lo, F.col("place"))
    n = F.least(at + (size + margin), F.col("place") + F.length("piece")) - begin
    part = F.struct(begin.alias("at"), F.substring(F.col("piece"), (begin - F.col("place") + 1).cast("int"), n.cast("int")).alias("part"))
    line = F.struct("length", *more)
    whole = lengths.select(key, F.explode(F.sequence(F.lit(0), F.expr(f"cast(greatest(length - 1, 0) div {size} as int)"))).alias("chunk"), line.alias("line"))
    both = p.select(key, "chunk", part.alias("part")).unionByName(whole, allowMissingColumns=True)
    seq = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["part"]), "")
    met = both.groupBy(key, "chunk").agg(F.first("line", ignorenulls=True).alias("line"), seq.alias("seq")).where("line is not null")
    return met.select(key, *[f"line.{c}" for c in more], "chunk", lo.alias("lo"), "seq", "line.length")


def chunk_of(position: Column, size: int = CHUNK) -> Column:
    """Chunk of a 1-based position."""
    return F.floor((F.greatest(position, F.lit(1)) - 1) / size).cast("int")


def bases(lo: Column, seq: Column, start0: Column, n: Column) -> Column:
    """Bases (``seq`` as bytes) from 0-based ``start0``, clipped at the chunk's end; null outside of it."""
    inside = (start0 >= lo) & (start0 < lo + F.length(seq)) & (n > 0)
    return F.when(inside, F.substring(seq, (start0 - lo + 1).cast("int"), n.cast("int")).cast("string"))


def placed(variants: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds lo, seq and length of the variant's chunk (nulls where the chromosome or place is unknown).

    ``seq`` comes as bytes, as characters of a text are found by counting from its start.
    """
    c = chunks.select(F.col("chrom").alias("c_chrom"), F.col("chunk").alias("c_chunk"), "lo", F.col("seq").cast("binary").alias("seq"), "length")
    at = chunk_of(F.col("position"), size)
    return variants.join(c, (F.col("chrom") == F.col("c_chrom")) & (at == F.col("c_chunk")), "left").drop("c_chrom", "c_chunk")


def stretches(places: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds bases to (chrom, start, end, ...): those of a closed interval, put together from all chunks that it touches.

    A place's own chunk gives its part of the interval, so margins don't matter and an
    interval may be longer than a chunk; it is null where the chromosome ends before.
    """
    names = places.columns
    p = places.withColumn("_chunk", F.explode(F.sequence(chunk_of(F.col("start"), size), chunk_of(F.col("end"), size))))
    c = chunks.select(F.col("chrom").alias("c_chrom"), F.col("chunk").alias("c_chunk"), "lo", F.col("seq").cast("binary").alias("seq"), "length")
    p = p.join(c, (F.col("chrom") == F.col("c_chrom")) & (F.col("_chunk") == F.col("c_chunk")))
    begin = F.greatest(F.col("start") - 1, F.col("_chunk").cast("long") * size)
    stop = F.least(F.col("end").cast("long"), (F.col("_chunk").cast("long") + 1) * size)
    part = F.substring(F.col("seq"), (begin - F.col("lo") + 1).cast("int"), (stop - begin).cast("int")).cast("string")
    p = p.withColumn("_part", part).groupBy(*names).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))), lambda x: x["_part"]), "").alias("bases"), F.max("length").alias("_length")
    )
    return p.withColumn("bases", F.when(F.col("end") <= F.col("_length"), F.col("bases"))).drop("_length")


def left_shift(allele: Column, upstream: Column) -> Column:
    """How far an indel moves left: the end of ``upstream`` that repeats the allele."""
    times = F.ceil(F.length(upstream) / F.greatest(F.length(allele), F.lit(1))).cast("int") + 1
    return common_suffix(upstream, tail(F.repeat(allele, times), F.length(upstream)))


def right_shift(allele: Column, downstream: Column) -> Column:
    times = F.ceil(F.length(downstream) / F.greatest(F.length(allele), F.lit(1))).cast("int") + 1
    return common_prefix(downstream, head(F.repeat(allele, times), F.length(downstream)))


def left_aligned(v: DataFrame, moves: Column | None = None, window: int = 48) -> DataFrame:
    """Moves pure insertions and deletions (position, ref, alt; lo, seq) left to the fixpoint.

    A short window decides nearly all; where the whole window repeats, the bases of the
    chunk up to its margin are compared. ``open_left`` marks rows whose repeat reaches the
    start of the chunk but not of the chromosome; ``align`` moves these on. Rows where
    ``moves`` is false stay.
    """
    indel = ((F.col("ref") == "") != (F.col("alt") == "")) & F.col("seq").isNotNull()
    indel = indel if moves is None else indel & moves
    v = v.withColumns(
        {
            "_allele": F.when(indel, F.concat("ref", "alt")).otherwise(F.lit("")),
            "_before": F.when(indel, F.col("position") - 1 - F.col("lo")).otherwise(F.lit(0)).cast("int"),
        }
    )
    ahead = F.greatest(F.col("_before"), F.lit(0))  # none outside of the chunk
    near = F.substring(F.col("seq"), F.greatest(ahead - window, F.lit(0)) + 1, F.least(ahead, F.lit(window))).cast("string")
    v = v.withColumn("_near", near)
    v = v.withColumn("_shift", F.when(F.col("_allele") != "", left_shift(F.col("_allele"), F.col("_near"))).otherwise(F.lit(0)))
    far = (F.col("_allele") != "") & (F.col("_shift") == F.length("_near")) & (F.col("_before") > F.length("_near"))
    v = v.withColumn(
        "_shift", F.when(far, left_shift(F.col("_allele"), F.substring(F.col("seq"), F.lit(1), F.col("_before")).cast("string"))).otherwise(F.col("_shift"))
    )
    n = F.length("_allele")
    # the allele read from the moved place on: bases before, then the allele itself
    turn = F.col("_shift") % F.greatest(n, F.lit(1))
    turned = F.concat(tail(F.col("_allele"), turn), head(F.col("_allele"), n - turn))
    return v.withColumns(
        {
            "open_left": F.coalesce((F.col("_allele") != "") & (F.col("_shift") == F.col("_before")) & (F.col("lo") > 0), F.lit(False)),
            "position": F.col("position") - F.col("_shift"),
            "ref": F.when(F.col("ref") != "", F.when(F.col("_allele") != "", turned).otherwise(F.col("ref"))).otherwise(F.col("ref")),
            "alt": F.when((F.col("alt") != "") & (F.col("_allele") != ""), turned).otherwise(F.col("alt")),
        }
    ).drop("_before", "_near", "_shift")


def with_bases(v: DataFrame) -> DataFrame:
    """Puts the bases that names need in place of the chunk: at, before, down and open_right in place of lo, seq and length.

    ``at`` and ``before`` are the bases at the place and before it. ``down`` are the bases
    after an indel that it may rotate over: DOWNSTREAM, or as many as the allele has;
    ``open_right`` marks rows whose chunk ends before them and before the chromosome does.
    """
    lo, seq, start0 = F.col("lo"), F.col("seq"), F.col("position") - 1 + F.length("ref")
    want = F.when(F.col("_allele") != "", F.greatest(F.length("_allele"), F.lit(DOWNSTREAM)))
    v = v.withColumns(
        {
            "at": bases(lo, seq, F.col("position") - 1, F.lit(1)),
            "before": bases(lo, seq, F.col("position") - 2, F.lit(1)),
            "down": F.when(want.isNotNull(), F.coalesce(bases(lo, seq, start0, want), F.lit(""))),
            "_left": F.least(want.cast("long"), F.col("length") - start0),
        }
    )
    v = v.withColumn("open_right", F.coalesce(F.length("down") < F.col("_left"), F.lit(False)))
    return v.drop("lo", "seq", "_allele")


def widened(rows: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``down`` put together from all chunks that it reaches into.

    Rows that begin in the same chunk share one stretch, from their first to their last
    base, so what is gathered grows with the chunks that are reached, not with the rows.
    It is stored, so that it is known to be small, where it is, before rows meet it.
    """
    rows = rows.withColumn("_start", F.col("position") + F.length("ref")).withColumn("_begin", chunk_of(F.col("_start"), size))
    ends = rows.groupBy("chrom", "_begin").agg(F.min("_start").alias("start"), F.max(F.col("_start") + F.col("_left") - 1).alias("end"))
    found = stretches(ends, chunks, size)
    found = stored(found.select(F.col("chrom").alias("w_chrom"), F.col("_begin").alias("w_begin"), F.col("start").alias("w_start"), F.col("bases").cast("binary").alias("bases")), "stretches")
    made = rows.join(found, (F.col("chrom") == F.col("w_chrom")) & (F.col("_begin") == F.col("w_begin")), "left")
    down = F.substring(F.col("bases"), (F.col("_start") - F.col("w_start") + 1).cast("int"), F.col("_left").cast("int")).cast("string")
    return made.withColumn("down", F.coalesce(down, "down")).drop("_start", "_begin", "w_chrom", "w_begin", "w_start", "bases")


def align(variants: DataFrame, chunks: DataFrame, moves: Column | None = None, size: int = CHUNK) -> DataFrame:
    """``variants`` (chrom, position, ref, alt, ...) left-aligned, with at, before and down (see ``with_bases``).

    Rows whose repeat reaches the start of their chunk are joined again to the chunk of
    their new place, until none is open; each round moves them by the margin at least.
    Bases beyond the end of a chunk are gathered from the chunks after it, so alleles may
    be longer than margins and chunks. Each round's rows are stored without their chunk.
    """
    names, parts, rows = variants.columns, [], variants
    while True:
        done = stored(with_bases(left_aligned(placed(rows, chunks, size), moves)), "aligned")
        parts.append(done.where("not open_left"))
        rows = done.where("open_left").select(*names)
        if rows.isEmpty():
            break
    met = functools.reduce(DataFrame.unionByName, parts)
    wide = met.where("open_right")
    if not wide.isEmpty():
        met = met.where("not open_right").unionByName(widened(wide, chunks, size))
    return met.drop("open_left", "open_right", "length", "_left")


def rotated(v: DataFrame, window: int = 48) -> DataFrame:
    """Adds shift, turned and upstream for genomic HGVS of normalized variants (position, ref, alt; down).

    Indels rotate right as far as the bases after them repeat the allele, DOWNSTREAM bases
    or the allele's length at most; ``upstream`` are as many bases before the new place of
    an insertion as it has. Where it rotates by less than its length it isn't repeated
    there (it would have moved further left), and ``upstream`` is null.
    """
    indel = (F.col("ref") == "") != (F.col("alt") == "")
    v = v.withColumn("_allele", F.when(indel, F.concat("ref", "alt")).otherwise(F.lit("")))
    n = F.length("_allele")
    # a short window decides nearly all, as in left_aligned
    v = v.withColumn("_near", F.coalesce(head(F.col("down"), F.lit(window)), F.lit("")))
    v = v.withColumn("shift", F.when(F.col("_near") != "", right_shift(F.col("_allele"), F.col("_near"))).otherwise(F.lit(0)))
    far = (F.col("_near") != "") & (F.col("shift") == F.length("_near")) & (F.length("down") > F.length("_near"))
    v = v.withColumn("shift", F.when(far, right_shift(F.col("_allele"), F.col("down"))).otherwise(F.col("shift")))
    turn = F.col("shift") % F.greatest(n, F.lit(1))
    v = v.withColumn("turned", F.concat(F.substring(F.col("_allele"), turn + 1, n), head(F.col("_allele"), turn)))
    repeats = (F.col("ref") == "") & (n > 0) & (F.col("shift") >= n)
    return v.withColumn("upstream", F.when(repeats, F.substring(F.col("down"), F.col("shift") - n + 1, n))).drop("_allele", "_near")
