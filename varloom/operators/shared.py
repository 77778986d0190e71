"""The cluster's shared folder, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` computed once, whatever filters follow.

    A filter on a computed column is pushed below it and computes it again; it cannot pass
    a generator, so the columns leave here through one that makes one row of one.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: made once, whatever reads it, and columns are pruned."""
    path = f"{shared_folder(df.sparkSession)}/varloom-{name}-{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of tables that go at the end of a ``passing_tables``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are removed at its end; nothing that reads them may leave it."""
    mark, context = _PASSING.set([]), spark.sparkContext
    try:
        yield
    finally:
        for name in _PASSING.get():
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _PASSING.reset(mark)


def refuse(found: DataFrame, what: str) -> None:
    """Raises if there is any row, naming a few of them."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(", ".join(str(v) for v in r) for r in some))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that come more than once, and how often."""
    return rows.where(F.col(key[-1]).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
