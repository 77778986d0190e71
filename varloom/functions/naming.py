"""Names of variants: identifiers and genomic HGVS notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.functions.alleles import SMALL, STR, is_reverse_complement

#: Types and their codes in identifiers (fixed values); any other type is SV.
CODES = {
    "deletion": "DEL",
    "insertion": "INS",
    "duplication": "DUP",
    "tandem_duplication": "DUP",
    "inversion": "INV",
    "copy_number_variation": "CNV",
    "copy_number_loss": "CNV",
    "copy_number_gain": "CNV",
    "run_of_homozygosity": "LOH",
}


def sv_code(kind: Column) -> Column:
    pairs = [v for kv in CODES.items() for v in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit("SV"))


def span(position: Column, end_position: Column, cat: Column, kind: Column, begin: Column, ref: Column) -> Column:
    """struct(begin, end): small variants by their alleles, translocations as given, others from the next base."""
    n = F.length(ref)
    return (
        F.when(cat == SMALL, F.struct(begin.cast("long").alias("begin"), (begin + F.greatest(n - 1, F.lit(0))).cast("long").alias("end")))
        .when(kind == "translocation", F.struct(position.cast("long").alias("begin"), end_position.cast("long").alias("end")))
        .otherwise(F.struct((position + 1).cast("long").alias("begin"), end_position.cast("long").alias("end")))
    )


def variant_id(chrom: Column, begin: Column, end: Column, ref: Column, alt: Column, cat: Column, kind: Column, base: Column) -> Column:
    """chrom-pos-ref-alt, with end and a code for structural variants.

    An empty allele takes ``base`` in front of both where that is known, and places one
    base earlier where the name has no end. A reference allele N becomes ``base``.
    """
    pad = F.when(((ref == "") | (alt == "")) & base.isNotNull(), base)
    plain = (cat == SMALL) | (kind == "translocation")
    at = F.when(pad.isNotNull() & plain, begin - 1).otherwise(begin).cast("string")
    # parts that are null are left out
    stop = F.when(~plain, end.cast("string"))
    code = F.when(~plain, F.when(cat == STR, F.lit("STR")).otherwise(sv_code(kind)))
    known = F.when((ref == "N") & base.isNotNull(), base).otherwise(ref)
    shown = lambda x: F.concat(F.coalesce(pad, F.lit("")), x)
    return F.concat_ws("-", chrom, at, stop, shown(known), shown(alt), code)


def _range(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("_", a.cast("string"), b.cast("string")))


def hgvs_genomic(accession: Column, position: Column, ref: Column, alt: Column, shift: Column, rotated: Column, upstream: Column) -> Column:
    """Genomic HGVS of a normalized small variant.

    ``shift`` and ``rotated`` are an indel's right rotation (0 and the allele itself for
    other variants); ``upstream`` the bases before the rotated place, as many as the
    allele has, or null where the chromosome starts before.
    """
    n_ref, n_alt = F.length(ref), F.length(alt)
    at = position + shift
    last = position + n_ref - 1
    insertion = F.when(
        upstream.isNotNull() & (upstream == rotated), F.concat(_range(at - n_alt, at - 1), F.lit("dup"))
    ).otherwise(F.concat((at - 1).cast("string"), F.lit("_"), at.cast("string"), F.lit("ins"), rotated))
    what = (
        F.when(ref == alt, F.concat(position.cast("string"), F.lit("=")))
        .when((n_ref == 1) & (n_alt == 1), F.concat(position.cast("string"), ref, F.lit(">"), alt))
        .when(n_alt == 0, F.concat(_range(at, at + n_ref - 1), F.lit("del")))
        .when(n_ref == 0, insertion)
        .when(
            (n_ref == n_alt) & is_reverse_complement(ref, alt),
            F.concat(position.cast("string"), F.lit("_"), last.cast("string"), F.lit("inv")),
        )
        .otherwise(F.concat(_range(position, last), F.lit("delins"), alt))
    )
    return F.when((accession != "") & ((n_ref > 0) | (n_alt > 0)), F.concat(accession, F.lit(":g."), what))
