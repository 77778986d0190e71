"""What the corpus operators share: the word pattern, table reading and the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that Python works on at a time.
ROWS = 256
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: the rows are in the shared folder, the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_columns(docs: DataFrame, text_col: str, rest: list[str], added: list, make, rows: int = ROWS) -> DataFrame:
    """The columns ``rest`` of ``docs``, unchanged, and what ``make`` makes of lists of whole texts.

    ``make(texts)`` gives a list of values for each of ``added`` (name, type). Rows go to
    Python in Arrow batches of which ``rows`` at a time are worked on.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*docs.select(*rest).schema.fields, *[T.StructField(n, t) for n, t in added]])
    types = [to_arrow_type(t) for _, t in added]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                some = b.slice(at, rows)
                values = make(some.column(0).to_pylist())
                columns = [*some.columns[1:], *[pa.array(v, t) for v, t in zip(values, types, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names[1:], *[n for n, _ in added]])

    inner = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields[: len(rest)])] + list(schema.fields[len(rest) :]))
    out = docs.select(F.col(text_col).alias("_text"), *inner).mapInArrow(run, plain)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *[F.col(n) for n, _ in added])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast; lines of a key and a few numbers, so below 100 MB.
FEW = 1_000_000
#: Parts into which each key's rows are dealt where the other side is too large to broadcast.
SALTS = 16


def with_line_of(rows: DataFrame, lines: DataFrame, keys: list[tuple[str, str]], few: int = FEW) -> DataFrame:
    """``rows`` left-joined (null-safe) to ``lines``, which has one line a key; ``keys`` pairs a column of each.

    ``lines`` must be cut or stored. They are counted, and broadcast while they are few, so
    that whole texts stay where they are; beyond that both sides are shuffled with a salt
    from the row's content, so that a key with a third of all rows is spread over tasks.
    """
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys]
    if lines.count() <= few:
        return rows.join(F.broadcast(lines), on, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]), F.lit(SALTS)))
    copies = lines.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, F.col("_salt") == F.col("_copy")], "left").drop("_salt", "_copy")
