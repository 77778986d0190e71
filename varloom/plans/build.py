"""Whole builds from files: the reference, and the cache of transcript models over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.chunks import CHUNK, MARGIN
from varloom.operators.evaluate import outcome_counts
from varloom.operators.shared import refuse, stored
from varloom.plans.models import model_counts, refuse_unresolved, transcript_models, write_cache
from varloom.plans.reference import aliases, chromosomes, reference_chunks, verified, write_reference
from varloom.sources import flat, gff3
from varloom.sources.bgzf import BgzfText
from varloom.sources.fasta import pieces

#: The chromosome that has its own code and whose transcripts take their bases from the reference.
MITOCHONDRION = "MT"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, order) of a text file: plain, gzip or BGZF."""
    spark.dataSource.register(BgzfText)
    return spark.read.format("bgzf").load(path)


def create_reference(
    spark: SparkSession, report: str, fasta: str, bands: str, mirna: str, path: str, size: int = CHUNK, margin: int = MARGIN
) -> dict:
    """The chunked reference from an assembly report, FASTA, ideogram and features; returns counts.

    Raises before anything is written on accessions or names that come twice, lengths that
    differ from the report's and a masked Y; afterwards if what is read back has another
    digest than the sequences.
    """
    records, found = pieces(spark, fasta)
    sequences = found.join(records.select("record", "accession"), "record").drop("record")
    refuse(records.where("accession is null").select("record", "length"), "records without an accession")
    flat.refuse_repeated(records, "accession", "accessions")
    listed = flat.report_rows(text_lines(spark, report))
    flat.refuse_repeated(listed.where("refseq <> ''"), "refseq", "accessions in the report")
    rows = stored(chromosomes(listed, sequences, "order"), "chromosomes")
    if rows.isEmpty():
        raise ValueError("no sequence is in the report")
    write_reference(rows, sequences, flat.band_rows(text_lines(spark, bands)), flat.mirna_rows(text_lines(spark, mirna)), path, size, margin)
    if not verified(path, rows, sequences, size, margin):
        raise ValueError("the written chunks are not those of the sequences")
    return rows.agg(F.count(F.lit(1)).alias("chromosomes"), F.sum("bases").alias("bases")).first().asDict()


@dataclass(frozen=True)
class CacheFiles:
    """Files of one annotation source: ``rna`` may be several, ``genbank`` is RefSeq's and ``regulatory`` Ensembl's."""

    style: str
    gff3: str
    rna: tuple[str, ...]
    protein: str
    genbank: str | None = None
    regulatory: str | None = None


def rna_sequences(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(tx, seq) of all files; an id that comes twice, in one file or two, is an error."""
    parts = [flat.read_fasta(spark, p).select(F.col("accession").alias("tx"), "seq") for p in paths]
    made = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    for p in parts[2:]:
        made = made.unionByName(p)
    return flat.refuse_repeated(stored(made, "rna"), "tx", "transcript ids")


def protein_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(protein_id, seq) with the stop at the end, and (tx, x_id) by the headers' transcripts; both without repeated ids."""
    tx = F.regexp_extract("header", r" transcript:(\S+)", 1)
    p = flat.read_fasta(spark, path).select(F.col("accession").alias("protein_id"), F.concat("seq", F.lit("*")).alias("seq"), F.nullif(tx, F.lit("")).alias("tx"))
    p = flat.refuse_repeated(stored(p, "proteins"), "protein_id", "protein ids")
    xref = flat.refuse_repeated(p.where("tx is not null"), "tx", "transcripts of proteins")
    return p.select("protein_id", "seq"), xref.select("tx", F.col("protein_id").alias("x_id"))


def stated_starts(spark: SparkSession, path: str) -> DataFrame:
    """(tx, stated_start) of GenBank records with a coding region; bad or repeated records are errors."""
    r = stored(flat.read_genbank(spark, path), "genbank")
    refuse(r.where("error is not null").select("id", "error"), "unreadable records")
    flat.refuse_repeated(r, "id", "record ids")
    return r.where("start is not null").select(F.col("id").alias("tx"), F.col("start").alias("stated_start"))


def sound_features(spark: SparkSession, path: str, names: DataFrame, style: str) -> DataFrame:
    """Features of a file, kept in the shared folder; a line that can't be read is an error."""
    f = stored(gff3.features(text_lines(spark, path), names, style, "order"), "features")
    refuse(f.where("error is not null").select("order", "error"), f"unreadable features of {path}")
    return f


def create_cache(spark: SparkSession, files: CacheFiles, gene_names: str, reference: str, path: str, size: int = CHUNK) -> dict:
    """The cache tables of one annotation source under ``path``, from files and a written reference; returns counts.

    Nothing is written if a feature can't be read or lacks its parent, an alignment its
    exon, or an id comes twice among features, sequences, proteins, records or gene names,
    or if a coding region can't be brought to agree with its protein. Only the
    mitochondrion's chunks of the reference are opened.
    """
    rows = spark.read.parquet(f"{reference}/chromosomes")
    names = aliases(rows)
    mt = rows.where(F.col("ensembl") == MITOCHONDRION).select("ref_index").first()
    features = sound_features(spark, files.gff3, names, files.style)
    parts = gff3.hierarchy(features, files.style)
    if files.style == "refseq":
        gff3.refuse_unsound(parts)
    else:
        refuse(parts["repeated"], "repeated ids")
    regulatory = gff3.regulatory(features)
    if files.regulatory is not None:
        regulatory = regulatory.unionByName(gff3.regulatory(sound_features(spark, files.regulatory, names, files.style)))
    lines = text_lines(spark, gene_names)
    known = flat.gene_names(flat.gene_name_rows(lines, "order"), "order")
    refuse(known["repeated"], "repeated gene name ids")
    rna = rna_sequences(spark, files.rna)
    proteins, xref = protein_sequences(spark, files.protein)
    stated = None if files.genbank is None else stated_starts(spark, files.genbank)
    chunks = None if mt is None else reference_chunks(spark, reference, [MITOCHONDRION])
    made = transcript_models(parts, rna, proteins, xref, files.style, stated, -1 if mt is None else mt.ref_index, known, chunks, size)
    made = {name: stored(df, name) for name, df in made.items()}
    refuse_unresolved(made)
    write_cache(made, path, regulatory)
    counts = model_counts(made).first().asDict()
    left_out = parts["transcripts"].count() - made["transcripts"].count()
    return counts | {"withoutSequence": left_out, "outcomes": outcome_counts(made["coding"]).first().asDict(), "regulatory": regulatory.count()}
