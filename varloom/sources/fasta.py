"""FASTA in byte ranges: sequences as pieces of bounded length with their places, whatever a chromosome's size.

    spark.dataSource.register(FastaPieces)
    spark.read.format("fasta").load(path)      # split, record, place, header, piece

Each split reads the lines that begin in its byte range (BGZF, plain) and knows places only
from its own last header on; ``pieces`` adds what earlier splits hold of an open record, by
prefix sums over the splits, one line each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from varloom.operators.shared import stored
from varloom.sources.bgzf import SPLIT, lines_of, open_file, splits_of
from varloom.sources.flat import accession

#: Bases in a piece, at most.
PIECE = 1 << 18
#: Pieces in a batch: of short records many, of long ones few.
BATCH, BATCH_BASES = 2048, 8 << 20


class FastaPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "split long, record long, place long, header string, piece string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("splitBytes", SPLIT))
        self.piece = int(options.get("pieceBases", PIECE))

    def partitions(self):
        return splits_of(self.path, self.step)

    def read(self, split):
        import pyarrow as pa

        if split is None:  # no files
            return
        names = ["split", "record", "place", "header", "piece"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        with open_file(split.path) as f:
            rows = cut_lines(lines_of(f, split, split.lo, split.hi), self.piece, split.lo == 0)
            while held := list(islice(rows, max(1, min(BATCH, BATCH_BASES // self.piece)))):
                columns = [[split.number] * len(held), *zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def cut_lines(rows: Iterator[bytes], most: int, first: bool) -> Iterator[tuple[int, int, str | None, str]]:
    """(record, place, header, piece) of lines: records from 1 on, 0 being the one that is open before the lines.

    The header stands at a record's first piece, which may be empty; ``first`` says that no record can be open.
    """
    record, place, header, held, n = 0, 0, None, [], 0
    for line in rows:
        if line.startswith(b">"):
            if n or header is not None:
                yield record, place, header, b"".join(held).decode("ascii", "replace")
            record, place, held, n = record + 1, 0, [], 0
            header = line[1:].rstrip(b"\r").decode("utf-8", "replace")
            continue
        bases = b"".join(line.split()).upper()
        if bases and first and not record:
            raise ValueError("bases before the first header")
        while bases:
            part, bases = bases[: most - n], bases[most - n :]
            held.append(part)
            n += len(part)
            if n == most:
                yield record, place, header, b"".join(held).decode("ascii", "replace")
                place, header, held, n = place + n, None, [], 0
    if n or header is not None:
        yield record, place, header, b"".join(held).decode("ascii", "replace")


def pieces(spark: SparkSession, path: str, split_bytes: int = SPLIT, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(records, pieces) of a FASTA file or folder: (record, accession, header, length) and (record, place, piece).

    Records are numbered from 1 in the order of the files, places count from 0. The file is
    read once, into the shared folder.
    """
    spark.dataSource.register(FastaPieces)
    rows = spark.read.format("fasta").option("splitBytes", split_bytes).option("pieceBases", piece).load(path)
    rows = stored(rows.withColumn("n", F.length("piece").cast("long")), "pieces")
    ends = rows.groupBy("split").agg(F.max(F.struct("record", (F.col("place") + F.col("n")).alias("end"))).alias("last"))
    earlier = W.orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    # one line a split: records that begin before it, and bases that earlier splits hold of the record open at its start
    ends = ends.select(
        "split", F.col("last.record").alias("heads"), F.coalesce(F.sum("last.record").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("last.end").over(earlier), F.lit(0)).alias("bases"),
    )
    since = F.max(F.when(F.col("heads") > 0, F.col("bases"))).over(earlier)
    # stored, so that its size is known before pieces are shuffled to meet it
    ends = stored(ends.select("split", "before", (F.col("bases") - F.coalesce(since, F.lit(0))).alias("carried")), "splits")
    placed = rows.join(ends, "split").select(
        (F.col("record") + F.col("before")).alias("record"), (F.col("place") + F.when(F.col("record") == 0, F.col("carried")).otherwise(0)).alias("place"),
        "header", "piece", "n",
    )
    lengths = placed.groupBy("record").agg(F.sum("n").alias("length"), F.max("header").alias("header"))
    records = stored(lengths.select("record", accession(F.col("header")).alias("accession"), "header", "length"), "records")
    return records, placed.select("record", "place", "piece")
