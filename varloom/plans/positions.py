"""VCF lines to annotated positions and their JSON lines."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varloom.functions.ids import contig
from varloom.operators.chunks import CHUNK
from varloom.operators.shared import refuse, settled, stored
from varloom.plans.annotate import annotated, looked_up, shown_struct, with_variants
from varloom.sources.bgzf import BgzfText
from varloom.sources.records import read_vcf
from varloom.sources.vcf import infer_assembly, informative, parse_lines, read_header, scattered_chromosomes, with_alias, with_locus


def annotate_positions(
    lines: DataFrame, chunks: DataFrame, bands: DataFrame, aliases: DataFrame, n_samples: int = 0, size: int = CHUNK
) -> DataFrame:
    """Positions of data lines (value, order) with locus and annotated variants; rows of unknown chromosomes go."""
    return annotate_records(informative(parse_lines(lines, n_samples)).drop("value", "error"), chunks, bands, aliases, size)


def annotate_records(rows: DataFrame, chunks: DataFrame, bands: DataFrame, aliases: DataFrame, size: int = CHUNK) -> DataFrame:
    """Positions of records (order, chrom, pos, ref, alts, ...) with locus and annotated variants; rows of unknown chromosomes go.

    Rows are annotated where they are and kept in the shared folder. Those with a single
    allele that needs a base meet the genome as they are. Only those with several are
    exploded and put together again by their order, alleles in their order; all others are
    never shuffled for it.
    """
    rows = with_alias(rows, aliases).where(F.col("ref_index").isNotNull()).withColumn("chrom", contig(F.col("chrom")))
    names = rows.columns
    rows = stored(with_variants(rows), "positions")
    made = rows.where("variants is not null").drop("first")
    single = rows.where("first is not null").select(F.struct(*names).alias("_row"), "chrom", "pos", "end_pos", "first.*")
    # settled, as filters on variants would make the names again
    met = looked_up(single, chunks, size=size).select("_row.*", F.array(shown_struct()).alias("variants"))
    made = made.unionByName(settled(met, "variants"))
    open_rows = rows.where((F.size("alts") > 1) & F.col("variants").isNull()).select(*names)
    if not open_rows.isEmpty():
        made = made.unionByName(_put_together(open_rows, chunks, size))
    return with_locus(made.withColumn("chromosome", F.col("chrom")), bands)


def _put_together(open_rows: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Rows with several alleles, exploded, annotated and grouped again."""
    v = open_rows.select("order", "chrom", "pos", "ref", F.col("info.svtype").alias("svtype"), "end_pos", F.posexplode("alts").alias("k", "alt"))
    a = annotated(v, chunks, size=size)
    per = a.groupBy("order").agg(F.array_sort(F.collect_list(F.struct("k", shown_struct().alias("v")))).alias("vs"))
    per = per.select("order", F.transform("vs", lambda x: x["v"]).alias("variants"))
    return open_rows.join(per, "order")


def json_lines(positions: DataFrame, *more: Column) -> DataFrame:
    """(order, value, ...) with one JSON object a position: null fields, false flags and empty filters are left out; samples and variants always stay."""
    true_or_null = lambda c: F.when(c, F.lit(True))
    samples = F.transform(
        "samples",
        lambda s: F.struct(
            s["genotype"].alias("genotype"), s["variantFrequencies"].alias("variantFrequencies"), s["totalDepth"].alias("totalDepth"),
            s["genotypeQuality"].alias("genotypeQuality"), s["alleleDepths"].alias("alleleDepths"),
            true_or_null(s["failedFilter"]).alias("failedFilter"), true_or_null(s["isDeNovo"]).alias("isDeNovo"),
            true_or_null(s["lossOfHeterozygosity"]).alias("lossOfHeterozygosity"), s["binCount"].alias("binCount"),
            s["genotypeDosage"].alias("genotypeDosage"), s["genotypePosteriors"].alias("genotypePosteriors"),
        ),
    )
    row = F.struct(
        F.col("chromosome"), F.col("pos").alias("position"), F.col("ref").alias("refAllele"), F.col("alts").alias("altAlleles"), "quality",
        F.when(F.size("filters") > 0, F.col("filters")).alias("filters"), F.col("info.sb").alias("strandBias"),
        F.col("info.fs").alias("fisherStrandBias"), F.col("info.mq").alias("mappingQuality"), F.col("info.info").alias("imputeScore"),
        F.col("info.af").alias("alleleFrequency"), F.col("info.raf").alias("refPanelAlleleFrequency"), "locus", samples.alias("samples"), "variants",
    )
    return positions.select("order", F.to_json(row).alias("value"), *more)


def write_positions(positions: DataFrame, path: str) -> dict:
    """Writes block-compressed JSON lines in the order of the file and returns the counts of positions and variants, taken while writing.

    Parts are ranges of the order, sorted, so the parts one after the other are the whole, see ``bgzf.joined``.
    """
    positions.sparkSession.dataSource.register(BgzfText)
    seen = Observation("positions")
    # stored, as ranges are found by reading the rows once more than they are written
    lines = stored(json_lines(positions, F.size("variants").alias("n")), "lines").repartitionByRange("order").sortWithinPartitions("order")
    lines = lines.observe(seen, F.count(F.lit(1)).alias("positions"), F.coalesce(F.sum("n"), F.lit(0)).alias("variants"))
    _write(lines.select("value"), path)
    return seen.get


def _write(lines: DataFrame, path: str) -> None:
    lines.write.format("bgzf").mode("append").save(path)


#: Version of the metadata's form.
SCHEMA = 1


def annotate_file(
    spark: SparkSession, source: str, target: str, chunks: DataFrame, bands: DataFrame, aliases: DataFrame, assembly: str, size: int = CHUNK,
    data_sources: tuple[dict, ...] = (), created: datetime.datetime | None = None, **metadata: str,
) -> dict:
    """A VCF file from header to metadata: <target>_variants, <target>_genes (empty) and <target>_metadata, as JSON lines in BGZF parts.

    The file is read once: its records are parsed into a table of the shared folder, which
    the guards and the annotation read. Raises before anything is written under ``target``
    if the header's contigs are those of another assembly or a chromosome comes again after
    another. Returns the metadata: samples, what the input is, counts of positions,
    variants and skipped records, data sources (name, version, ...), and whatever is given.
    """
    header = read_header(source)
    found = infer_assembly(spark.createDataFrame(header.contigs, "name string, length long")).first().assembly
    if found not in ("unknown", assembly):
        raise ValueError(f"the file is of {found}, not of {assembly}")
    rows = stored(informative(read_vcf(spark, source)).drop("error"), "records")
    refuse(scattered_chromosomes(rows.select("order", "chrom"), "order"), "chromosomes that come again")
    skipped = with_alias(rows.select("chrom"), aliases).where("ref_index is null").count()
    counts = write_positions(annotate_records(rows, chunks, bands, aliases, size), f"{target}_variants")
    made = {
        "creationTime": (created or datetime.datetime.now(datetime.UTC)).isoformat(timespec="seconds"), "schemaVersion": SCHEMA, "assembly": assembly,
        "dataSources": list(data_sources), "samples": header.samples,
        "input": {
            "fileName": source.rstrip("/").rsplit("/", 1)[-1], "vcfVersion": header.file_format, "contigs": len(header.contigs),
            "samples": len(header.samples), "inferredAssembly": found,
        },
        "stats": {**counts, "skippedRecords": skipped}, **metadata,
    }
    _write(spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1), f"{target}_metadata")
    _write(spark.createDataFrame([], "value string"), f"{target}_genes")
    return made
