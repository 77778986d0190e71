"""VCF headers and rows: what lines say, which chromosomes they are of and where they lie."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.ids import contig
from varloom.sources.bgzf import splits_of
from varloom.sources.records import COLUMNS, header_lines, parsed

#: Contig lengths by build, chromosomes 1-22, X, Y (fixed values).
LENGTHS = {
    "GRCh37": (
        249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516,
        133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566,
        155270560, 59373566,
    ),
    "GRCh38": (
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622,
        133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468,
        156040895, 57227415,
    ),
}
NAMES = (*map(str, range(1, 23)), "X", "Y")


@dataclass
class Header:
    file_format: str
    contigs: list[tuple[str, int]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)


def parse_header(lines: list[str]) -> Header:
    """Header of the leading lines of a file; the format line and the column line are required."""
    found, columns, contigs = None, None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith("##fileformat="):
            found = line.partition("=")[2]
        elif line.startswith("##contig=<") and line.endswith(">"):
            pairs = dict(p.split("=", 1) for p in line[10:-1].split(",") if "=" in p)
            if "ID" in pairs and pairs.get("length", "").isdigit():
                contigs.append((pairs["ID"], int(pairs["length"])))
        elif line.startswith("#CHROM"):
            columns = line.split("\t")
            break
        elif not line.startswith("#"):
            break
    if found is None:
        raise ValueError("no ##fileformat line")
    if columns is None:
        raise ValueError("no #CHROM line")
    return Header(found, contigs, columns[9:])


def read_header(path: str) -> Header:
    """Header of a file, plain or compressed: only its leading lines are read, however many there are."""
    return parse_header(header_lines(path, splits_of(path, 1 << 62)[0]))


def assembly_table(spark: SparkSession) -> DataFrame:
    """(name, length, assembly) of the known contigs."""
    rows = [(n, x, a) for a, lengths in LENGTHS.items() for n, x in zip(NAMES, lengths, strict=True)]
    return spark.createDataFrame(rows, "name string, length long, assembly string")


def infer_assembly(contigs: DataFrame) -> DataFrame:
    """One row (assembly) of contigs (name, length): the build all known contigs agree on, else unknown; MT doesn't count."""
    known = F.broadcast(assembly_table(contigs.sparkSession).withColumnsRenamed({"name": "k_name", "length": "k_length"}))
    c = contigs.select(contig(F.col("name")).alias("name"), "length").where("name <> 'MT'")
    met = c.join(known, (F.col("name") == F.col("k_name")) & (F.col("length") == F.col("k_length")))
    found = met.agg(F.min("assembly").alias("a"), F.max("assembly").alias("b"))
    return found.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("unknown").alias("assembly"))


def parse_lines(lines: DataFrame, n_samples: int = 0, strict: bool = True, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """Typed rows of data lines (value, and whatever else is there), with those of a record's columns that are named.

    Columns: chrom, pos, id, ref, alts (informative ones), quality, filters, info,
    is_reference, end_pos, samples and error. Lines with too few columns, a bad place or
    another number of samples have an error; ``strict`` raises it. Reference records skip
    the sample check. A sample of one dot or nothing at all is empty. Null lines are left out.
    """
    data = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return parsed(data, n_samples, columns, strict)


def informative(rows: DataFrame) -> DataFrame:
    """Rows that are not reference records and keep an informative allele."""
    return rows.where(~F.col("is_reference") & (F.size("alts") > 0))


def scattered_chromosomes(rows: DataFrame, order: str) -> DataFrame:
    """(chrom) that come again after another chromosome, by the order column; none in a sound file.

    First and last places by chromosome are pre-aggregated; only those few rows meet in a window.
    """
    spans = rows.groupBy("chrom").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    after = F.lead("first").over(W.orderBy("first"))
    return spans.withColumn("next", after).where(F.col("next") < F.col("last")).select("chrom")


def with_alias(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows with the ref_index of their chromosome by any of its names; unknown names stay, with null.

    ``aliases`` (name, ref_index) has a few names for each chromosome of one genome and is small.
    """
    a = aliases.select(F.col("name").alias("a_name"), "ref_index")
    return rows.join(F.broadcast(a), F.col("chrom") == F.col("a_name"), "left").drop("a_name")


def with_locus(rows: DataFrame, bands: DataFrame, place: str = "pos") -> DataFrame:
    """Adds locus, the band (chrom, begin, end, name) that holds the place; null without one.

    Bands are joined by chromosome and 2^20-base bin, so that no row meets all bands.
    """
    b = bands.select(
        F.col("chrom").alias("b_chrom"), "begin", "end", F.col("name").alias("locus"),
        F.explode(F.sequence(F.shiftright(F.col("begin"), 20), F.shiftright(F.col("end"), 20))).alias("b_bin"),
    )
    on = (F.col("chrom") == F.col("b_chrom")) & (F.shiftright(F.col(place), 20) == F.col("b_bin"))
    on = on & F.col(place).between(F.col("begin"), F.col("end"))
    return rows.join(b, on, "left").drop("b_chrom", "b_bin", "begin", "end")
