"""Identifiers, flags, bins and other small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of assemblies and their codes (fixed values).
ASSEMBLIES = {"unknown": 0, "GRCh37": 1, "GRCh38": 2}


def assembly(name: Column) -> Column:
    """Canonical assembly name, whatever the case; null for others."""
    low = F.lower(name)
    return F.when(low == "grch37", "GRCh37").when(low == "grch38", "GRCh38").when(low == "unknown", "unknown")


def assembly_code(name: Column) -> Column:
    a = assembly(name)
    return F.when(a == "GRCh38", 2).when(a == "GRCh37", 1).when(a == "unknown", 0)


def contig(name: Column) -> Column:
    """Chromosome name without chr; chrM and chrMT become MT; all else stays."""
    bare = F.substring(name, 4, 1 << 20)
    return F.when(name.isin("chrM", "chrMT"), "MT").when(name.startswith("chr"), bare).otherwise(name)


def fingerprint_id(text: Column) -> Column:
    """First four bytes of the SHA-256, read little-endian."""
    h = F.sha2(text, 256)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


#: Spatial bins are 2^20 bases wide.
BIN_SHIFT = 20


def bin_of(position: Column) -> Column:
    return F.shiftright(position.cast("long") - 1, BIN_SHIFT).cast("int")


def bins(start: Column, end: Column) -> Column:
    """All bins that a closed interval touches."""
    return F.sequence(bin_of(start), bin_of(end))


def bin_count(length: Column) -> Column:
    return F.when(length <= 0, 0).otherwise(bin_of(length) + 1)


def ensembl_number(stable_id: Column) -> Column:
    """Digits at the end of a stable id, as a number below 2^32."""
    n = F.regexp_extract(stable_id, r"^[^0-9]*([0-9]+)$", 1)
    v = F.when(n != "", n.try_cast("long"))
    return F.when(v < (1 << 32), v)


def ncbi_number(gene_id: Column) -> Column:
    v = F.when(gene_id.rlike("^[0-9]+$"), gene_id.try_cast("long"))
    return F.when(v < (1 << 32), v)


def after_colon(x: Column) -> Column:
    """What follows the first colon (null without one)."""
    return F.when(F.instr(x, ":") > 0, F.substring(x, F.instr(x, ":") + 1, F.length(x)))


def before_colon(x: Column) -> Column:
    return F.when(F.instr(x, ":") > 0, F.substring(x, F.lit(1), F.instr(x, ":") - 1))


def versioned(stable_id: Column, version: Column) -> Column:
    return F.concat(stable_id, F.lit("."), F.coalesce(version.cast("string"), F.lit("1")))


def reverse_strand(sign: Column) -> Column:
    return sign == "-"


def _flags(*bits: Column) -> Column:
    total = F.lit(0)
    for i, b in enumerate(bits):
        total = total + F.when(b, 1 << i).otherwise(0)
    return total


def gene_flags(reverse: Column, hgnc: Column, ncbi: Column, ensembl: Column) -> Column:
    return _flags(reverse, hgnc.isNotNull(), ncbi.isNotNull(), ensembl.isNotNull())


def region_flags(is_intron: Column, has_cigar: Column) -> Column:
    return _flags(is_intron, has_cigar)


def transcript_flags(low: Column, coding: Column, plus_clinical: Column, mane: Column, refseq: Column, canonical: Column) -> Column:
    return _flags(low, coding, plus_clinical, mane, refseq, canonical)


def release_date(text: Column) -> Column:
    """struct(year, month, day) of YYYY-MM-DD without a range check; null unless there are three numbers."""
    parts = F.split(text, "-")
    num = lambda i: F.when(parts[i].rlike("^[0-9]+$"), parts[i].try_cast("int"))
    made = F.struct(num(0).alias("year"), num(1).alias("month"), num(2).alias("day"))
    ok = (F.size(parts) == 3) & made["year"].isNotNull() & made["month"].isNotNull() & made["day"].isNotNull()
    return F.when(ok, made)
