"""From features, sequences and names to evaluated transcripts and the cache tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.ids import gene_flags
from varloom.operators.cache import binned, in_order, numbered
from varloom.operators.chunks import CHUNK
from varloom.operators.evaluate import evaluated
from varloom.operators.shared import refuse
from varloom.operators.transcripts import (
    FLAGS,
    coding_regions,
    exon_regions,
    first_takers,
    matched_regions,
    named_genes,
    shared_designations,
    with_introns,
    with_proteins,
    with_reference_bases,
)


def transcript_models(
    parts: dict[str, DataFrame],
    rna: DataFrame,
    proteins: DataFrame,
    xref: DataFrame,
    style: str,
    stated: DataFrame | None = None,
    mt_index: int = -1,
    names: dict[str, DataFrame] | None = None,
    chunks: DataFrame | None = None,
    size: int = CHUNK,
) -> dict[str, DataFrame]:
    """genes, transcripts, regions, coding (evaluated), regulatory and proteins of the parts that ``hierarchy`` gives.

    ``rna`` (tx, seq) and ``proteins`` (protein_id, seq) are sequences, ``xref`` (tx, x_id)
    proteins by transcript, ``stated`` (tx, stated_start) coding starts in the records,
    ``names`` the indexes that ``gene_names`` gives. With ``chunks`` of the reference,
    transcripts of chromosome ``mt_index`` take their bases from it. The first transcript of
    an id, by the lines' order where it is there, takes its sequence.
    """
    tx = parts["transcripts"]
    name = F.coalesce(F.col("attr.transcript_id"), F.col("attr.name")) if style == "refseq" else F.concat(
        F.col("attr.transcript_id"), F.lit("."), F.coalesce(F.col("attr.version").cast("string"), F.lit("1"))
    )
    t = tx.select(
        "ref_index", F.col("attr.id").alias("id"), name.alias("tx"), F.col("g_id").alias("gene"), "coding", "code", "start", "end", "reverse",
        *[F.col(f"attr.{f}").alias(f) for f in FLAGS],
    )
    if "order" in tx.columns:
        order = tx.select("ref_index", F.col("attr.id").alias("id"), F.col("order").alias("file_order"))
        t = t.join(order, ["ref_index", "id"])
    else:
        t = t.withColumn("file_order", F.struct("ref_index", "start", "id"))
    if chunks is not None:
        rna = with_reference_bases(t, rna, chunks, mt_index, "MT", size)
    t = shared_designations(first_takers(t, rna.withColumnRenamed("seq", "cdna"), "file_order")).drop("file_order", "newly_set")
    genes = gene_rows(parts["genes"], style, names)
    t = t.join(genes.select("ref_index", F.col("id").alias("gene"), "hgnc_id"), ["ref_index", "gene"], "left")
    tx_of = t.select("ref_index", F.col("id").alias("p_id"), "tx", F.col("reverse").alias("tx_reverse"))

    def of(rows: DataFrame, *more: str) -> DataFrame:
        return rows.join(tx_of, ["ref_index", "p_id"]).select("ref_index", "tx", F.col("tx_reverse").alias("reverse"), "start", "end", *more)

    matches = of(parts["matches"].withColumns({c: F.col(f"attr.{c}") for c in ("target_start", "target_end", "cigar")}), "target_start", "target_end", "cigar")
    aligned = matches.select("ref_index", "tx").distinct()
    plain = exon_regions(of(parts["exons"]).join(aligned, ["ref_index", "tx"], "left_anti"))
    regions = with_introns(plain.unionByName(matched_regions(matches)))
    cds_name = parts["cds"].withColumn("cds_protein", F.col("attr.name" if style == "refseq" else "attr.protein_id"))
    cds = of(cds_name, "cds_protein")
    t = t.join(cds.groupBy("ref_index", "tx").agg(F.min("cds_protein").alias("cds_protein")), ["ref_index", "tx"], "left")
    t = with_proteins(t, proteins, xref, prefer_xref=style != "refseq")
    c = coding_regions(cds.drop("cds_protein"), regions, stated).withColumnsRenamed({"start": "cds_start", "end": "cds_end"})
    c = c.where("cdna_start is not null and cdna_end is not null")
    coding = t.where("coding and protein <> ''").join(c, ["ref_index", "tx"])
    coding = coding.withColumn("mt", F.col("ref_index") == mt_index)
    return {"genes": genes, "transcripts": t, "regions": regions, "coding": evaluated(coding)}


def gene_rows(genes: DataFrame, style: str, names: dict[str, DataFrame] | None = None) -> DataFrame:
    """(ref_index, id, start, end, reverse, symbol, ncbi, ensembl, hgnc_id, flags) of genes, named by the name table if there is one."""
    symbol = F.col("attr.symbol") if style == "refseq" else F.coalesce("attr.name", "attr.gene_id")
    ids = {"ncbi": F.col("attr.gene_id"), "ensembl": F.lit(None).cast("string")}
    if style != "refseq":
        ids = {"ncbi": F.lit(None).cast("string"), "ensembl": F.col("attr.gene_id")}
    g = genes.select(
        "ref_index", F.col("attr.id").alias("id"), "start", "end", "reverse", symbol.alias("symbol"), F.col("attr.hgnc_id").alias("hgnc_id"),
        *[c.alias(n) for n, c in ids.items()],
    )
    if names is not None:
        g = named_genes(g, by_ncbi=names["by_ncbi"]) if style == "refseq" else named_genes(g, by_ensembl=names["by_ensembl"])
    return g.withColumn("flags", gene_flags(F.col("reverse"), F.col("hgnc_id"), F.col("ncbi"), F.col("ensembl")))


def model_counts(models: dict[str, DataFrame]) -> DataFrame:
    """One row: transcripts with and without a coding region, and those that are coding but have none (skipped)."""
    c = models["coding"].select("ref_index", "tx", F.lit(True).alias("has"))
    t = models["transcripts"].join(c, ["ref_index", "tx"], "left")
    has = F.coalesce("has", F.lit(False))
    return t.agg(F.count_if(has).alias("coding"), F.count_if(~has).alias("noncoding"), F.count_if(F.col("coding") & ~has).alias("skipped"))


def refuse_unresolved(models: dict[str, DataFrame]) -> None:
    """Raises if a coding region could not be brought to agree with its protein."""
    refuse(models["coding"].where("outcome = 'unresolvable'").select("tx"), "unresolvable coding regions")


def cache_tables(models: dict[str, DataFrame], regulatory: DataFrame | None = None) -> dict[str, DataFrame]:
    """The cache as tables by chromosome: values stored once and numbered, and rows that hold their numbers.

    genes (by symbol), regions and sequences (cDNA and proteins) are numbered; transcripts
    hold the numbers of their gene, cDNA and protein; transcript_regions those of a
    transcript's regions in order; coding the evaluated coding regions; bins the 2^20-base
    bins of transcripts and regulatory features.
    """
    t, r = models["transcripts"], models["regions"]
    gene_values = [c for c in models["genes"].columns if c not in ("ref_index", "id")]
    g = numbered(models["genes"].withColumn("_symbol", F.coalesce("symbol", F.lit(""))), "ref_index", ["_symbol", *gene_values], ["_symbol", *gene_values]).drop("_symbol")
    region = ["kind", "id", "start", "end", "cdna_start", "cdna_end", "cigar"]
    regions = numbered(r.withColumn("seen", F.struct("tx", "kind", "id")), "ref_index", region, ["start", "end"], "seen")
    seqs = t.select("ref_index", F.col("cdna").alias("seq")).unionByName(t.select("ref_index", F.col("protein").alias("seq")).where("seq <> ''"))
    seqs = numbered(seqs.where("seq is not null"), "ref_index", ["seq"], ["seq"])

    def number_of(rows: DataFrame, values: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
        v = values.select(F.col("ref_index").alias("v_ref"), *[F.col(k).alias(f"v_{k}") for k in keys], F.col("index").alias(name))
        on = [F.col("ref_index") == F.col("v_ref"), *[F.col(c).eqNullSafe(F.col(f"v_{k}")) for k, c in keys.items()]]
        return rows.join(v, on, "left").drop("v_ref", *[f"v_{k}" for k in keys])

    ids = number_of(models["genes"], g, {c: c for c in gene_values}, "gene_index").select("ref_index", F.col("id").alias("gene"), "gene_index")
    rows = t.join(ids, ["ref_index", "gene"], "left")
    rows = number_of(number_of(rows, seqs, {"seq": "cdna"}, "cdna_index"), seqs, {"seq": "protein"}, "protein_index")
    held = number_of(r, regions, {c: c for c in region}, "region_index")
    held = held.groupBy("ref_index", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "region_index"))), lambda x: x["region_index"]).alias("region_indexes"))
    bins = binned(t.select("ref_index", F.lit("transcript").alias("what"), F.col("tx").alias("id"), "start", "end"))
    out = {
        "genes": g, "regions": regions, "sequences": seqs, "transcripts": in_order(rows.drop("cdna", "protein")),
        "transcript_regions": held, "coding": models["coding"].drop("cdna", "protein"),
    }
    if regulatory is not None:
        f = regulatory.select("ref_index", F.col("attr.id").alias("id"), "biotype", "code", "start", "end", F.col("attr.note").alias("note"))
        out["regulatory"] = in_order(f)
        bins = bins.unionByName(binned(f.select("ref_index", F.lit("regulatory").alias("what"), "id", "start", "end")))
    return out | {"bins": bins}


def write_cache(models: dict[str, DataFrame], path: str, regulatory: DataFrame | None = None) -> None:
    """The cache tables as Parquet by chromosome."""
    for name, df in cache_tables(models, regulatory).items():
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("ref_index").parquet(f"{path}/{name}")


def read_cached(spark: SparkSession, path: str, name: str, ref_index: int) -> DataFrame:
    """One table's rows of one chromosome; no other chromosome's files are opened."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("ref_index") == ref_index)
