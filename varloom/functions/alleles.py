"""Allele operations: trimming, categories, variant types, complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.text import common_prefix, common_suffix

SMALL, SV, CNV, STR = "small", "sv", "cnv", "repeat_expansion"


def trim(position: Column, ref: Column, alt: Column) -> Column:
    """struct(position, ref, alt) without the common prefix, then without the common suffix of what is left.

    For whole tables ``trimmed`` does the same in steps and is faster.
    """
    lead = common_prefix(ref, alt)
    r1, a1 = F.substring(ref, lead + 1, F.length(ref)), F.substring(alt, lead + 1, F.length(alt))
    back = common_suffix(r1, a1)
    as_is = F.struct(position.cast("long").alias("position"), ref.alias("ref"), alt.alias("alt"))
    cut = F.struct(
        (position + lead).cast("long").alias("position"),
        F.substring(r1, F.lit(1), F.length(r1) - back).alias("ref"),
        F.substring(a1, F.lit(1), F.length(a1) - back).alias("alt"),
    )
    return F.when(untrimmed(ref, alt), as_is).otherwise(cut)


def untrimmed(ref: Column, alt: Column) -> Column:
    """Single bases, equal alleles and alleles that differ at both ends stay as they are."""
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    ends_differ = (F.substring(ref, 1, 1) != F.substring(alt, 1, 1)) & (F.substring(ref, -1, 1) != F.substring(alt, -1, 1))
    return single | ends_differ | (ref == alt)


def trimmed(v: DataFrame, position: str = "pos") -> DataFrame:
    """Replaces ref and alt of ``v`` by the trimmed alleles and adds ``position``, one step a projection."""
    v = v.withColumn("_go", ~untrimmed(F.col("ref"), F.col("alt")))
    v = v.withColumn("_lead", F.when(F.col("_go"), common_prefix(F.col("ref"), F.col("alt"))).otherwise(0))
    v = v.withColumns({c: F.substring(F.col(c), F.col("_lead") + 1, F.length(c)) for c in ("ref", "alt")})
    v = v.withColumn("_back", F.when(F.col("_go"), common_suffix(F.col("ref"), F.col("alt"))).otherwise(0))
    v = v.withColumns({c: F.substring(F.col(c), F.lit(1), F.length(c) - F.col("_back")) for c in ("ref", "alt")})
    return v.withColumn("position", (F.col(position) + F.col("_lead")).cast("long")).drop("_lead", "_back", "_go")


def is_breakend(alt: Column) -> Column:
    return alt.contains("[") | alt.contains("]")


def is_symbolic(alt: Column) -> Column:
    return alt.startswith("<") & alt.endswith(">")


def category(alt: Column, svtype: Column) -> Column:
    return (
        F.when(is_breakend(alt), SV)
        .when(is_symbolic(alt) & alt.startswith("<STR"), STR)
        .when(is_symbolic(alt) & F.coalesce(svtype.isin("CNV", "LOH"), F.lit(False)), CNV)
        .when(is_symbolic(alt), SV)
        .otherwise(SMALL)
    )


def repeat_count(alt: Column) -> Column:
    """The number after <STR, if it is one."""
    inner = F.regexp_extract(alt, r"^<STR([+-]?[0-9]+)>$", 1)
    return F.when(inner != "", inner.try_cast("int"))


def small_type(n_ref: Column, n_alt: Column) -> Column:
    return (
        F.when((n_ref == 1) & (n_alt == 1), "SNV")
        .when((n_ref == n_alt) & (n_ref > 1), "MNV")
        .when((n_alt == 0) & (n_ref > 0), "deletion")
        .when((n_ref == 0) & (n_alt > 0), "insertion")
        .otherwise("delins")
    )


#: SVTYPE values and the types they stand for (fixed values); DUP also looks at the allele.
SV_TYPES = {
    "DEL": "deletion",
    "INS": "insertion",
    "DUP": "duplication",
    "TDUP": "tandem_duplication",
    "INV": "inversion",
    "BND": "translocation",
    "CNV": "copy_number_variation",
    "STR": "short_tandem_repeat_variation",
    "ALU": "mobile_element_insertion",
    "LINE1": "mobile_element_insertion",
    "SVA": "mobile_element_insertion",
    "LOH": "copy_number_variation",
}


def _choose(x: Column, table: dict, default) -> Column:
    pairs = [v for kv in table.items() for v in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), F.lit(default))


def variant_type(alt: Column, svtype: Column, n_ref: Column, n_alt: Column, cat: Column | None = None) -> Column:
    """Type by category (computed where it isn't given); the lengths are those of trimmed alleles."""
    cat = category(alt, svtype) if cat is None else cat
    tandem = (svtype == "DUP") & (alt == "<DUP:TANDEM>")
    sv = F.when(tandem, "tandem_duplication").otherwise(_choose(F.coalesce(svtype, F.lit("")), SV_TYPES, "unknown"))
    cnv = _choose(alt, {"<DEL>": "copy_number_loss", "<DUP>": "copy_number_gain"}, "copy_number_variation")
    return (
        F.when(cat == SMALL, small_type(n_ref, n_alt))
        .when(is_breakend(alt), "translocation")
        .when(cat == STR, "short_tandem_repeat_variation")
        .when(cat == CNV, cnv)
        .otherwise(sv)
    )


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def is_reverse_complement(a: Column, b: Column) -> Column:
    """Whether b is the reverse complement of a; any base but ACGT, or another case, makes it false."""
    return a.rlike("^[ACGTacgt]*$") & (reverse_complement(a) == b)


def shown(allele: Column) -> Column:
    return F.when(allele == "", "-").otherwise(allele)
