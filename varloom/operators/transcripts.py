"""Transcript models: exons with transcript coordinates, introns, coding regions, designations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.alleles import reverse_complement
from varloom.operators.chunks import stretches

KEY = ["ref_index", "tx"]


def exon_regions(exons: DataFrame) -> DataFrame:
    """Exons (ref_index, tx, reverse, start, end) with id and cdna_start, cdna_end in transcript order.

    A transcript has few exons, so the window of a transcript stays small.
    """
    along = F.when(F.col("reverse"), -F.col("start")).otherwise(F.col("start"))
    w = W.partitionBy(*KEY).orderBy(along, "end")
    upto = F.sum(F.col("end") - F.col("start") + 1).over(w.rowsBetween(W.unboundedPreceding, 0))
    e = exons.withColumns({"id": F.row_number().over(w), "cdna_end": upto.cast("int")})
    return e.withColumns(
        {
            "cdna_start": (F.col("cdna_end") - (F.col("end") - F.col("start"))).cast("int"),
            "kind": F.lit("exon"),
            "cigar": F.lit(None).cast("array<struct<op:string,length:int>>"),
        }
    ).select(*KEY, "reverse", "kind", "id", "start", "end", "cdna_start", "cdna_end", "cigar")


def matched_regions(matches: DataFrame) -> DataFrame:
    """Exons of alignment rows (ref_index, tx, reverse, start, end, target_start, target_end, cigar); ids run along the transcript."""
    n = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    at = F.row_number().over(W.partitionBy(*KEY).orderBy("start", "end"))
    m = matches.withColumn("id", F.when(F.col("reverse"), n - at + 1).otherwise(at).cast("int"))
    return m.select(
        *KEY, "reverse", F.lit("exon").alias("kind"), "id", "start", "end",
        F.col("target_start").alias("cdna_start"), F.col("target_end").alias("cdna_end"), "cigar",
    )


def with_introns(regions: DataFrame) -> DataFrame:
    """Exon regions and the introns in the gaps between neighbours."""
    w = W.partitionBy(*KEY).orderBy("start", "end")
    nxt = F.lead(F.struct("start", "cdna_start", "cdna_end", "id")).over(w)
    gaps = regions.withColumn("n", nxt).where(F.col("n.start") - F.col("end") > 1)
    pick = lambda back, fwd: F.when(F.col("reverse"), F.col(back)).otherwise(F.col(fwd))
    introns = gaps.select(
        *KEY, "reverse", F.lit("intron").alias("kind"), pick("n.id", "id").alias("id"),
        (F.col("end") + 1).alias("start"), (F.col("n.start") - 1).alias("end"),
        pick("n.cdna_end", "cdna_end").alias("cdna_start"), pick("cdna_start", "n.cdna_start").alias("cdna_end"),
        F.lit(None).cast("array<struct<op:string,length:int>>").alias("cigar"),
    )
    return regions.unionByName(introns)


def along_cigar(place: Column, start: Column, end: Column, cdna_start: Column, ops: Column, reverse: Column) -> Column:
    """Transcript place of a genomic place in an aligned exon.

    The walk keeps (steps taken on the genome, transcript place, whether arrived); on the
    reverse strand it starts past the exon's end and goes down. Inside a deletion the
    transcript stays where it was.
    """
    goal = F.when(reverse, end + 1 - place).otherwise(place - start + 1)
    first = F.struct(F.lit(0).alias("went"), (cdna_start - 1).cast("int").alias("cdna"), F.lit(False).alias("there"))

    def step(acc: Column, op: Column) -> Column:
        on_genome = F.when(op["op"] == "I", 0).otherwise(op["length"])
        on_cdna = F.when(op["op"] == "D", 0).otherwise(op["length"])
        arrives = acc["went"] + on_genome >= goal
        rest = F.when(op["op"] == "D", 0).otherwise(goal - acc["went"])
        return F.when(acc["there"], acc).otherwise(
            F.struct(
                F.when(arrives, acc["went"]).otherwise(acc["went"] + on_genome).cast("int").alias("went"),
                (acc["cdna"] + F.when(arrives, rest).otherwise(on_cdna)).cast("int").alias("cdna"),
                arrives.alias("there"),
            )
        )

    return F.aggregate(ops, first, step)["cdna"]


def to_cdna(places: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds cdna to (ref_index, tx, place): through the first exon that holds the place; null if none does."""
    e = regions.where("kind = 'exon'").withColumnsRenamed({"ref_index": "e_index", "tx": "e_tx"})
    on = (F.col("ref_index") == F.col("e_index")) & (F.col("tx") == F.col("e_tx")) & F.col("place").between(F.col("start"), F.col("end"))
    straight = F.col("cdna_start") + F.when(F.col("reverse"), F.col("end") - F.col("place")).otherwise(F.col("place") - F.col("start"))
    walked = along_cigar(F.col("place"), F.col("start"), F.col("end"), F.col("cdna_start"), F.col("cigar"), F.col("reverse"))
    names = places.columns
    met = places.join(e, on, "left").withColumn("c", F.when(F.col("cigar").isNotNull(), walked).otherwise(straight).cast("int"))
    return met.groupBy(*names).agg(F.min_by("c", "start").alias("cdna"))


def coding_regions(cds: DataFrame, regions: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """(ref_index, tx, start, end, cdna_start, cdna_end, cds_offset) of CDS parts (ref_index, tx, reverse, start, end).

    ``stated`` (tx, stated_start) are the coding starts that the records claim; the offset
    is how far the mapped start lies beyond.
    """
    spans = cds.groupBy(*KEY, "reverse").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ends = F.array(
        F.struct(F.lit("first").alias("which"), F.when(F.col("reverse"), F.col("end")).otherwise(F.col("start")).alias("place")),
        F.struct(F.lit("last").alias("which"), F.when(F.col("reverse"), F.col("start")).otherwise(F.col("end")).alias("place")),
    )
    places = spans.select(*KEY, F.explode(ends).alias("p")).select(*KEY, "p.which", "p.place")
    at = to_cdna(places, regions).groupBy(*KEY).agg(
        F.max(F.when(F.col("which") == "first", F.col("cdna"))).alias("cdna_start"),
        F.max(F.when(F.col("which") == "last", F.col("cdna"))).alias("cdna_end"),
    )
    out = spans.join(at, KEY)
    if stated is None:
        out = out.withColumn("stated_start", F.lit(None).cast("int"))
    else:
        out = out.join(stated, "tx", "left")
    offset = F.greatest(F.col("cdna_start") - F.coalesce("stated_start", "cdna_start"), F.lit(0))
    return out.select(*KEY, "start", "end", "cdna_start", "cdna_end", offset.cast("int").alias("cds_offset"))


FLAGS = ("mane_select", "mane_plus_clinical", "refseq_select", "ensembl_canonical")


def shared_designations(transcripts: DataFrame) -> DataFrame:
    """Sets each flag on all rows of a transcript id if any has it; adds newly_set, the flags a row gained."""
    union = transcripts.groupBy("tx").agg(*[F.bool_or(f).alias(f"u_{f}") for f in FLAGS])
    t = transcripts.join(union, "tx")
    gained = sum((F.when(F.col(f"u_{f}") & ~F.coalesce(F.col(f), F.lit(False)), 1).otherwise(0) for f in FLAGS), F.lit(0))
    t = t.withColumn("newly_set", gained)
    return t.withColumns({f: F.coalesce(f"u_{f}", F.lit(False)) for f in FLAGS}).drop(*[f"u_{f}" for f in FLAGS])


def first_takers(transcripts: DataFrame, sequences: DataFrame, order: str) -> DataFrame:
    """Transcripts with the sequence of their id (tx, seq): in file order the first takes it, later ones get none and go."""
    first = transcripts.groupBy("tx").agg(F.min(order).alias(order))
    return transcripts.join(first, ["tx", order], "left_semi").join(sequences, "tx")


def with_reference_bases(transcripts: DataFrame, sequences: DataFrame, chunks: DataFrame, ref_index: int, chrom: str, size: int) -> DataFrame:
    """``sequences`` (tx, seq), with those of transcripts on one chromosome (the mitochondrion) taken from the reference instead.

    Transcripts (ref_index, tx, start, end, reverse) of it have no introns; on the reverse strand the bases are complemented.
    """
    own = transcripts.where(F.col("ref_index") == ref_index).select("tx", F.lit(chrom).alias("chrom"), "start", "end", "reverse").distinct()
    own = stretches(own, chunks, size).where("bases is not null")
    own = own.select("tx", F.when(F.col("reverse"), reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("seq"))
    return sequences.join(own.select("tx"), "tx", "left_anti").select("tx", "seq").unionByName(own)


def named_genes(genes: DataFrame, by_ncbi: DataFrame | None = None, by_ensembl: DataFrame | None = None) -> DataFrame:
    """Genes with ids and symbol from the name table.

    By NCBI id the table's symbol, HGNC and Ensembl ids replace the gene's; by Ensembl id only
    missing ids are filled.
    """
    if by_ncbi is not None:
        n = by_ncbi.select(F.col("key").alias("n_key"), F.col("symbol").alias("n_symbol"), F.col("hgnc_id").alias("n_hgnc"), F.col("ensembl").alias("n_ensembl"))
        g = genes.join(n, F.col("ncbi") == F.col("n_key"), "left")
        return g.withColumns(
            {"symbol": F.coalesce("n_symbol", "symbol"), "hgnc_id": F.coalesce("n_hgnc", "hgnc_id"), "ensembl": F.coalesce("n_ensembl", "ensembl")}
        ).drop("n_key", "n_symbol", "n_hgnc", "n_ensembl")
    e = by_ensembl.select(F.col("key").alias("e_key"), F.col("hgnc_id").alias("e_hgnc"), F.col("ncbi").alias("e_ncbi"))
    g = genes.join(e, F.col("ensembl") == F.col("e_key"), "left")
    return g.withColumns({"hgnc_id": F.coalesce("e_hgnc", "hgnc_id"), "ncbi": F.coalesce("e_ncbi", "ncbi")}).drop("e_key", "e_hgnc", "e_ncbi")


def with_proteins(transcripts: DataFrame, proteins: DataFrame, xref: DataFrame, prefer_xref: bool) -> DataFrame:
    """Adds protein_id and protein (empty where the id has no sequence): from the CDS, or from the cross-reference (tx, x_id)."""
    t = transcripts.join(xref, "tx", "left")
    pick = F.coalesce("x_id", "cds_protein") if prefer_xref else F.coalesce("cds_protein", "x_id")
    t = t.withColumn("protein_id", pick).drop("x_id")
    p = proteins.select(F.col("protein_id").alias("p_id"), F.col("seq").alias("protein"))
    t = t.join(p, F.col("protein_id") == F.col("p_id"), "left").drop("p_id")
    return t.withColumn("protein", F.when(F.col("protein_id").isNotNull(), F.coalesce("protein", F.lit(""))))
