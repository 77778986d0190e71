"""Building the chunked reference from an assembly report, sequences, bands and miRNA regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.operators.chunks import CHUNK, MARGIN, cut_pieces

#: More unknown bases than this on chromosome Y mean a masked sequence (fixed value).
Y_UNKNOWN = 33_720_001


def as_pieces(sequences: DataFrame) -> DataFrame:
    """(accession, place, piece) of pieces, see ``sources.fasta``, or of whole sequences (accession, seq) as one piece each."""
    if "piece" in sequences.columns:
        return sequences.select("accession", "place", "piece")
    return sequences.select("accession", F.lit(0).cast("long").alias("place"), F.col("seq").alias("piece"))


def chromosomes(report: DataFrame, sequences: DataFrame, order: str) -> DataFrame:
    """Report rows that have a sequence (whole or in pieces, see ``as_pieces``), numbered from 0 in report order.

    Numbering happens over the report's rows, which are few; sequences stay where they are.
    """
    have = as_pieces(sequences).groupBy(F.col("accession").alias("refseq")).agg(F.max(F.col("place") + F.length("piece")).alias("bases"))
    r = report.join(have, "refseq")
    return r.withColumn("ref_index", F.row_number().over(W.orderBy(order)) - 1)


def problems(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """(refseq, problem) of chromosomes with another length than reported and of a masked Y."""
    unknown = F.sum(F.length("piece") - F.length(F.replace("piece", F.lit("N"), F.lit(""))))
    y = rows.join(as_pieces(sequences).groupBy(F.col("accession").alias("refseq")).agg(unknown.alias("unknown")), "refseq")
    problem = F.when(F.col("bases") != F.col("length"), "length").when((F.col("ensembl") == "Y") & (F.col("unknown") > Y_UNKNOWN), "masked Y")
    return y.select("refseq", problem.alias("problem")).where("problem is not null")


def aliases(rows: DataFrame) -> DataFrame:
    """(name, ref_index): all names of the chromosomes; of one name for two, the later counts."""
    names = F.explode(F.array_distinct(F.array("ucsc", "ensembl", "refseq", "genbank")))
    a = rows.select(names.alias("name"), "ref_index").where("name <> ''")
    return a.groupBy("name").agg(F.max("ref_index").alias("ref_index"))


def write_reference(rows: DataFrame, sequences: DataFrame, bands: DataFrame, mirna: DataFrame, path: str, size: int = CHUNK, margin: int = MARGIN) -> None:
    """Parquet tables chromosomes, chunks (by ref_index), bands and mirna; raises on a problem before anything is written."""
    bad = problems(rows, sequences).limit(5).collect()
    if bad:
        raise ValueError(", ".join(f"{r.refseq}: {r.problem}" for r in bad))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chromosomes")
    key = rows.select(F.col("refseq").alias("accession"), F.col("ensembl").alias("chrom"), "ref_index", F.col("bases").alias("length"))
    chunks = cut_pieces(as_pieces(sequences), key, size, margin, "accession").drop("accession")
    chunks.write.mode("overwrite").option("compression", "zstd").partitionBy("ref_index").parquet(f"{path}/chunks")
    # ideograms name chromosomes as the report's first names do
    bands.join(key.select("chrom"), "chrom", "left_semi").write.mode("overwrite").parquet(f"{path}/bands")
    mirna.join(key.select("accession", "chrom"), "accession").write.mode("overwrite").parquet(f"{path}/mirna")


def digests(chunks: DataFrame) -> DataFrame:
    """(chrom, chunks, bases, digest): an order-free digest of a chromosome's chunks (chrom, chunk, lo, seq), margins included.

    Each chunk is hashed where it is; sums of the hashes combine before the shuffle.
    """
    one = F.xxhash64("chunk", "lo", "seq").cast("decimal(20,0)")
    return chunks.groupBy("chrom").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.col("lo") + F.length("seq")).alias("bases"), F.sum(one).alias("digest"))


def verified(path: str, rows: DataFrame, sequences: DataFrame | None = None, size: int = CHUNK, margin: int = MARGIN) -> bool:
    """Whether the written chunks hold as many bases as each chromosome has and, with ``sequences``, the same bases."""
    spark = rows.sparkSession
    found = digests(spark.read.parquet(f"{path}/chunks"))
    key = rows.select(F.col("refseq").alias("accession"), F.col("ensembl").alias("chrom"), "bases")
    off = key.join(found.withColumnsRenamed({"bases": "end"}), "chrom", "left").where(~F.col("bases").eqNullSafe(F.col("end")))
    if sequences is None or not off.isEmpty():
        return off.isEmpty()
    given = digests(cut_pieces(as_pieces(sequences), key.withColumnRenamed("bases", "length"), size, margin, "accession"))
    same = given.select(F.col("chrom").alias("g_chrom"), F.col("chunks").alias("g_chunks"), F.col("digest").alias("g_digest"))
    met = found.join(same, F.col("chrom") == F.col("g_chrom"), "full")
    return met.where(~F.col("digest").eqNullSafe(F.col("g_digest")) | ~F.col("chunks").eqNullSafe(F.col("g_chunks"))).isEmpty()


def reference_chunks(spark: SparkSession, path: str, chroms: DataFrame | list[str] | None = None) -> DataFrame:
    """The written chunks, or those of ``chroms``: names, or rows (chrom) whose distinct names in the reference are looked up.

    No other chromosome's files are opened. The names that reach the driver are those of
    the reference's own chromosomes.
    """
    chunks = spark.read.parquet(f"{path}/chunks")
    if chroms is None:
        return chunks
    rows = spark.read.parquet(f"{path}/chromosomes").select(F.col("ensembl").alias("chrom"), "ref_index")
    if isinstance(chroms, DataFrame):
        rows = rows.join(chroms.select("chrom").distinct(), "chrom", "left_semi")
    else:
        rows = rows.where(F.col("chrom").isin(*chroms))
    return chunks.where(F.col("ref_index").isin([r.ref_index for r in rows.collect()]))
