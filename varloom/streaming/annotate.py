"""Variant lines as they arrive: the batch plan over each micro-batch, committed once, with counts and guards kept across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.chunks import CHUNK
from varloom.operators.shared import passing_tables, refuse, stored
from varloom.plans.positions import annotate_records, json_lines
from varloom.sources.vcf import informative, parse_lines, scattered_chromosomes, with_alias


def arrived(rows: DataFrame, aliases: DataFrame, number: int) -> DataFrame:
    """(chrom, first, last, positions, variants, skipped) of a batch's records (order, chrom, alts): one line a chromosome."""
    at, known = F.struct(F.lit(number).cast("long").alias("batch"), "order"), F.col("ref_index").isNotNull()
    return with_alias(rows.select("order", "chrom", "alts"), aliases).groupBy("chrom").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count_if(known).alias("positions"),
        F.coalesce(F.sum(F.when(known, F.size("alts").cast("long"))), F.lit(0)).cast("long").alias("variants"), F.count_if(~known).alias("skipped"),
    )


def carried(before: DataFrame, now: DataFrame) -> DataFrame:
    """Both batches' lines as one line a chromosome; as few as chromosomes have come."""
    sums = [F.sum(c).alias(c) for c in ("positions", "variants", "skipped")]
    return before.unionByName(now).groupBy("chrom").agg(F.min("first").alias("first"), F.max("last").alias("last"), *sums)


def returned(before: DataFrame, now: DataFrame) -> DataFrame:
    """(chrom) that come again after another chromosome, within a batch or across them."""
    spans = before.unionByName(now)
    return scattered_chromosomes(spans.select("chrom", F.explode(F.array("first", "last")).alias("at")), "at")


def annotate_stream(
    spark: SparkSession, source: str, target: str, progress: str, chunks: DataFrame, bands: DataFrame, aliases: DataFrame,
    n_samples: int = 0, size: int = CHUNK, one_file: bool = False, options: dict | None = None, **trigger,
):
    """Starts a query that reads new text files under ``source`` and writes JSON lines, as compressed text, to ``target``.

    Each micro-batch goes to a folder of its own number, so one that runs again after a
    failure replaces what it wrote before. So do the counts and places of chromosomes under
    ``<target>_state``: a batch adds to those of the batch before it, whatever was restarted
    in between. With ``one_file`` the files, by arrival and name, are parts of one file, and
    a chromosome that comes again after another ends the query before its batch is written.
    What a batch keeps in the shared folder on its way goes with it.
    ``options`` are those of the file source, such as ``maxFilesPerTrigger``.
    """
    lines = spark.readStream.options(**(options or {})).text(source).select("value", "_metadata.file_path", "_metadata.file_block_start")
    state = f"{target.rstrip('/')}_state"

    def batch(rows: DataFrame, number: int) -> None:
        with passing_tables(rows.sparkSession):
            written(rows, number)

    def written(rows: DataFrame, number: int) -> None:
        order = F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("line"))
        some = rows.select("value", order.alias("order")).where(~F.col("value").startswith("#"))
        records = stored(informative(parse_lines(some, n_samples)).drop("value", "error"), "arrived")
        now = stored(arrived(records, aliases, number), "chromosomes")
        before = rows.sparkSession.read.schema(now.schema).parquet(f"{state}/batch={number - 1}") if number else now.limit(0)
        if one_file:
            refuse(returned(before, now), "chromosomes that come again")
        positions = annotate_records(records, chunks, bands, aliases, size)
        json_lines(positions).select("value").write.mode("overwrite").option("compression", "gzip").text(f"{target}/batch={number}")
        carried(before, now).coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def stream_counts(spark: SparkSession, target: str) -> DataFrame:
    """(chrom, positions, variants, skipped) of all batches that ``annotate_stream`` has written so far."""
    rows = spark.read.parquet(f"{target.rstrip('/')}_state")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).select("chrom", "positions", "variants", "skipped")
