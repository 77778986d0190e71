"""Mixing sources to target weights with weighted sampling without replacement (native).

Every document gets an exponential key, ``-ln(u) / weight`` with ``u`` from a seeded
digest of its id and ``weight`` its quality weight; taking documents by rising key is
Efraimidis-Spirakis sampling. A source takes ``floor(target / size)`` complete epochs
of all its documents first; the fraction that is left goes to the documents with the
smallest keys whose prefix sum of words meets the remaining budget.

A source may hold a third of all rows, so no window runs over a whole source. Keys are
cut into cells of equal width in ``ln(key)``, about sqrt(rows) of them per unit; as
ln(key) has the same density whatever the weight, no cell holds more than
``0.37 / sqrt(rows)`` of a source. Word totals by (source, cell) are summed map-side, one
prefix sum over the cells finds the single cell in which the budget ends, and only the
rows of that cell are ordered one by one. What remains is one line for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import cut, with_line_of, word_count

#: Weights that the sources take in turn, ordered by code point with null last.
CYCLE = (5, 2, 1)
#: No target exceeds this many epochs of its source.
MAX_EPOCHS = 3
SEED = "mix-1"
SYMBOLS = r"[#*$%&|<>!]"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, falling with the symbols a word; never above 1 or 0."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1)).cast("double"))


def exponential_key(doc_id: Column, weight: Column, text: Column | None = None, seed: str = SEED) -> Column:
    """``-ln(u) / weight``; u in (0, 1) from 48 bits of an md5 of seed, id (null: empty) and the text's md5 (null or not given: that of no text)."""
    text = F.lit("") if text is None else text
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(u) / weight


def source_targets(totals: DataFrame, share: float = 1.0, cycle: tuple = CYCLE, cap: int = MAX_EPOCHS) -> DataFrame:
    """Word targets of the sources from (source, source_size).

    The sources share ``share`` of all words by weight; none gets more than ``cap`` times
    its size and the excess is shared again by weight until none is above. With sources
    ordered by cap over weight this has a closed form: the level is that of the first
    source whose share at the level of all sources from it on stays within its cap.
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    t = totals.select(
        "source",
        "source_size",
        F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(cycle) + 1)).alias("weight"),
        (F.col("source_size") * float(cap)).alias("cap"),
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.select(
        "*",
        F.row_number().over(order).alias("rank"),
        (F.sum("source_size").over(W.partitionBy()) * float(share)).alias("budget"),
        (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")).alias("capped_before"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("weight_from"),
    )
    t = t.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_from"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))
    level = F.min(fits).over(W.partitionBy()).getField("level")
    return t.select(
        "source",
        "source_size",
        F.round(F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))), 6).alias("target"),
    )


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Narrow rows (doc_id, source, size, key, row) of documents; ``row`` numbers them, to tell rows apart that are equal in all else."""
    size = word_count(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        quality_weight(F.col(text_col), size).alias("weight"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select("doc_id", "source", "size", exponential_key(F.col("doc_id"), F.col("weight"), F.col("text")).alias("key"), "row")


def cell(key: Column, cells: int) -> Column:
    return F.floor(F.log(key) * float(cells)).cast("long")


def plan_sources(rows: DataFrame, share: float = 1.0) -> tuple[DataFrame, int]:
    """One line for each source: sizes, target, epochs and where in key order its fraction ends."""
    n = rows.count()
    cells = max(16, int(n**0.5))
    rows = rows.withColumn("cell", cell(F.col("key"), cells))
    hist = cut(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    targets = source_targets(hist.groupBy("source").agg(F.sum("cell_size").alias("source_size")), share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(MAX_EPOCHS)).cast("int"))
    targets = cut(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    t = targets.withColumnRenamed("source", "t_source")
    running = F.sum("cell_size").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    edge = (
        hist.withColumn("end", running)
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("cell_size") <= F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct("cell", (F.col("end") - F.col("cell_size")).alias("before"), "rest")).alias("e"))
        .select(F.col("source").alias("e_source"), "e.*")
    )
    e = edge.withColumnRenamed("cell", "e_cell")
    # rows of one key and id are equal; what is taken of the group in which the budget ends is a number of its rows
    inner = (
        rows.join(e, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("cell") == F.col("e_cell")))
        .groupBy("e_source", "e_cell", "before", "rest", "key", "doc_id")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    )
    in_order = W.partitionBy("e_source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(in_order) - F.col("size")
    each = F.col("size").cast("double") / F.col("n")
    fits = F.floor((F.col("rest") - start) / each + 0.5)
    n_taken = F.when(each > 0, F.greatest(F.least(fits, F.col("n")), F.lit(0))).when(start <= F.col("rest"), F.col("n")).otherwise(F.lit(0))
    last = (
        inner.withColumn("n_taken", n_taken.cast("long"))
        .where("n_taken > 0")
        .groupBy("e_source")
        .agg(F.max(F.struct("key", "doc_id", "n_taken", "n")).alias("last"))
        .select(F.col("e_source").alias("l_source"), "last")
    )
    last = cut(last)
    end_row = _row_of(rows, last)
    plan = (
        t.join(edge.select("e_source", "cell"), F.col("t_source").eqNullSafe(F.col("e_source")), "left")
        .join(last, F.col("t_source").eqNullSafe(F.col("l_source")), "left")
        .join(end_row, F.col("t_source").eqNullSafe(F.col("r_source")), "left")
    )
    end_key = F.when(F.col("last").isNotNull(), F.struct("last.key", "last.doc_id"))
    return cut(
        plan.select("t_source", "source_size", "target", "epochs", F.col("cell").alias("end_cell"), end_key.alias("end_key"), "end_row")
    ), cells


def _row_of(rows: DataFrame, last: DataFrame) -> DataFrame:
    """(r_source, end_row): the last row to be taken of groups that are taken in part, by the rows' numbers.

    A group may hold very many equal rows, so those of each input partition are counted
    first, and only the partition in which the number is reached is ranked row by row.
    """
    part = F.shiftright(F.col("row"), 33)
    some = last.where(F.col("last.n_taken") < F.col("last.n")).select(
        F.col("l_source").alias("r_source"), F.col("last.key").alias("r_key"), F.col("last.doc_id").alias("r_id"), F.col("last.n_taken").alias("wanted")
    )
    on = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_id"))
    equal = rows.join(some, on).select("r_source", "wanted", "row", part.alias("part"))
    counts = equal.groupBy("r_source", "wanted", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("r_source").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    at = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
    at = at.select(F.col("r_source").alias("a_source"), F.col("part").alias("a_part"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("nth"))
    near = equal.join(at, F.col("r_source").eqNullSafe(F.col("a_source")) & (F.col("part") == F.col("a_part")))
    rank = F.row_number().over(W.partitionBy("r_source").orderBy("row"))
    return near.withColumn("rank", rank).where(F.col("rank") == F.col("nth")).select("r_source", F.col("row").alias("end_row"))


def with_copies(rows: DataFrame, plan: DataFrame, cells: int) -> DataFrame:
    """Adds source_size, target and copies (epochs, and one more where the fraction reaches)."""
    here = F.struct("key", "doc_id")
    at = cell(F.col("key"), cells)
    fraction = (
        F.when(F.col("end_cell").isNull(), F.lit(0))
        .when(at < F.col("end_cell"), F.lit(1))
        .when((at == F.col("end_cell")) & (here < F.col("end_key")), F.lit(1))
        .when((at == F.col("end_cell")) & here.eqNullSafe(F.col("end_key")) & (F.col("row") <= F.coalesce("end_row", F.col("row"))), F.lit(1))
        .otherwise(F.lit(0))
    )
    joined = with_line_of(rows, plan, [("source", "t_source")])
    return joined.withColumn("copies", F.col("epochs") + F.coalesce(fraction, F.lit(0))).drop(
        "t_source", "epochs", "end_cell", "end_key", "end_row", "row"
    )


def mix(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """Narrow result: doc_id, source, size, source_size, target, copies, taken.

    Defined cases: null or blank texts have size 0 and take nothing; a null source is a
    source of its own, last in order; rows that repeat an id, or have none, get keys of
    their own by their texts; of rows that are equal in id and text as many are taken as
    come near the target; an empty table gives an empty result; further columns of ``docs``
    are ignored.
    """
    rows = cut(sized(docs))
    plan, cells = plan_sources(rows, share)
    return with_copies(rows, plan, cells).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it (documents without words never).

    The decision is one line for each source, so whole texts stay where they are. Rows are
    read twice and numbered as they come, so ``docs`` should be a stored table.
    """
    rows = cut(sized(docs))
    plan, cells = plan_sources(rows, share)
    names = docs.columns
    size = word_count(F.col("text"))
    wide = docs.select(F.struct(*[F.col(c) for c in names]).alias("whole"))
    wide = wide.select(
        "whole",
        F.col("whole.doc_id").alias("doc_id"),
        F.col("whole.source").cast("string").alias("source"),
        word_count(F.col("whole.text")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    key = exponential_key(F.col("doc_id"), quality_weight(F.col("whole.text"), F.col("size")), F.col("whole.text"))
    wide = with_copies(wide.withColumn("key", key), plan, cells).where((F.col("size") > 0) & (F.col("copies") > 0))
    repeated = wide.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select([F.col("whole").getField(c).alias(c) for c in names])
