"""Annotation of variants and positions.

Most variants (substitutions, and anything that keeps both alleles) need no reference
base and are finished by expressions alone. Only indels, alleles that trimming leaves
empty and unknown reference bases meet the chunked genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions.naming import hgvs_genomic, span, variant_id
from varloom.operators.chunks import CHUNK, align, rotated
from varloom.operators.shared import settled, stored


def classified(v: DataFrame) -> DataFrame:
    """Adds position, ref, alt (trimmed), category, variant_type, repeat_count to (chrom, pos, ref, alt, svtype, end_pos)."""
    v = A.trimmed(v.withColumn("_alt", F.col("alt")))
    v = v.withColumns({"category": A.category(F.col("_alt"), F.col("svtype")), "repeat_count": A.repeat_count(F.col("_alt"))})
    kind = A.variant_type(F.col("_alt"), F.col("svtype"), F.length("ref"), F.length("alt"), F.col("category"))
    v = v.withColumn("variant_type", kind).drop("_alt")
    return settled(v, "position", "ref", "alt", "category", "repeat_count", "variant_type")


def _finished(v: DataFrame, accession: Column) -> DataFrame:
    """Names of variants that have base, shift, turned and upstream."""
    v = v.withColumn(
        "_span", span(F.col("pos"), F.col("end_pos"), F.col("category"), F.col("variant_type"), F.col("position"), F.col("ref"))
    )
    v = v.withColumns({"begin": F.col("_span.begin"), "end": F.col("_span.end")})
    c = {x: F.col(x) for x in ("ref", "alt", "position", "category", "variant_type", "begin", "end", "shift", "turned", "upstream")}
    hgvs = hgvs_genomic(accession, c["position"], c["ref"], c["alt"], c["shift"], c["turned"], c["upstream"])
    vid = variant_id(F.col("chrom"), c["begin"], c["end"], c["ref"], c["alt"], c["category"], c["variant_type"], F.col("base"))
    return v.withColumns(
        {
            "vid": vid,
            "hgvsg": F.when(c["category"] == A.SMALL, hgvs),
            "ref_allele": A.shown(c["ref"]),
            "alt_allele": A.shown(c["alt"]),
        }
    )


def settled_alleles(rows: DataFrame, accession: Column | None = None) -> Column:
    """Annotated alleles of (chrom, pos, ref, end_pos, alts, info) in their order, as ``SHOWN`` says; null if any needs a base.

    Alleles stay in their row: each step is one pass over the array, so that no step's
    result is computed twice, and nothing is exploded, shuffled or joined.
    """
    accession = default_accession() if accession is None else accession
    pos, end_pos, ref, svtype = F.col("pos"), F.col("end_pos"), F.col("ref"), F.col("info.svtype")
    to = lambda a, f: F.transform(a, lambda x: F.struct(*[v.alias(k) for k, v in f(x).items()]))
    rest = lambda x, n: F.substring(x, n + 1, F.length(x))
    go = lambda given: ~A.untrimmed(ref, given)
    a = to(F.col("alts"), lambda x: {"given": x, "lead": F.when(go(x), A.common_prefix(ref, x)).otherwise(0)})
    a = to(a, lambda x: {"given": x["given"], "lead": x["lead"], "ref": rest(ref, x["lead"]), "alt": rest(x["given"], x["lead"])})
    a = to(a, lambda x: {n: x[n] for n in ("given", "lead", "ref", "alt")} | {"back": F.when(go(x["given"]), A.common_suffix(x["ref"], x["alt"])).otherwise(0)})
    short = lambda x, n: F.substring(x[n], F.lit(1), F.length(x[n]) - x["back"])
    a = to(a, lambda x: {"given": x["given"], "position": (pos + x["lead"]).cast("long"), "ref": short(x, "ref"), "alt": short(x, "alt")})
    a = to(a, lambda x: {n: x[n] for n in ("given", "position", "ref", "alt")} | {"category": A.category(x["given"], svtype)})
    kind = lambda x: A.variant_type(x["given"], svtype, F.length(x["ref"]), F.length(x["alt"]), x["category"])
    a = to(a, lambda x: {n: x[n] for n in ("position", "ref", "alt", "category")} | {"kind": kind(x)})
    whole = lambda x: {n: x[n] for n in ("position", "ref", "alt", "category", "kind")}
    a = to(a, lambda x: whole(x) | {"span": span(pos, end_pos, x["category"], x["kind"], x["position"], x["ref"])})
    text = F.lit(None).cast("string")

    def shown(x: Column) -> dict[str, Column]:
        hgvs = hgvs_genomic(accession, x["position"], x["ref"], x["alt"], F.lit(0), F.concat(x["ref"], x["alt"]), text)
        begin, end = x["span"]["begin"], x["span"]["end"]
        return {
            "vid": variant_id(F.col("chrom"), begin, end, x["ref"], x["alt"], x["category"], x["kind"], text), "chromosome": F.col("chrom"),
            "begin": begin, "end": end, "refAllele": A.shown(x["ref"]), "altAllele": A.shown(x["alt"]), "variantType": x["kind"],
            "hgvsg": F.when(x["category"] == A.SMALL, hgvs),
        }

    # the lambda's argument is evaluated once, for the test and for what follows
    out = F.transform(F.array(a), lambda v: F.when(~F.exists(v, lambda x: (x["ref"] == "") | (x["alt"] == "") | (x["ref"] == "N")), to(v, shown)))
    return F.get(out, F.lit(0))


def with_variants(rows: DataFrame, accession: Column | None = None) -> DataFrame:
    """Adds variants, as of ``settled_alleles``, to rows, and first: the trimmed allele of a row with a single one that needs a base.

    Single alleles, which most rows have, go by columns in steps; only rows with several by passes over their array.
    """
    accession = default_accession() if accession is None else accession
    v = rows.withColumn("_several", F.when(F.size("alts") != 1, settled_alleles(rows, accession)))
    row = F.struct(*rows.columns).alias("_row")
    v = classified(v.select(row, "_several", "chrom", "pos", "end_pos", "ref", F.col("info.svtype").alias("svtype"), F.get("alts", F.lit(0)).alias("alt")))
    single = F.size("_row.alts") == 1
    first = F.struct("position", "ref", "alt", "category", "repeat_count", "variant_type")
    found = _finished(v.withColumns({"first": F.when(single & _needs(), first), **_plain()}), accession)
    made = F.when(single, F.when(~_needs(), F.array(shown_struct()))).otherwise(F.col("_several"))
    return settled(found.select("_row.*", made.alias("variants"), "first"), "variants", "first")


def shown_struct() -> Column:
    return F.struct(*[F.col(c).alias(n) for c, n in SHOWN.items()])


def _needs() -> Column:
    """Whether a trimmed allele needs a base."""
    return (F.col("ref") == "") | (F.col("alt") == "") | (F.col("ref") == "N")


def _plain() -> dict[str, Column]:
    """What ``_finished`` wants of alleles that need no base."""
    text = F.lit(None).cast("string")
    return {"base": text, "shift": F.lit(0), "turned": F.concat("ref", "alt"), "upstream": text}


def looked_up(v: DataFrame, chunks: DataFrame, accession: Column | None = None, vid_anchor: str = "compat", size: int = CHUNK) -> DataFrame:
    """Names of classified variants that need a base, as of ``annotated``; whatever else is there stays."""
    # only small variants move left; the others just need a base
    met = align(v, chunks, F.col("category") == A.SMALL, size)
    met = met.withColumn("base", F.col({"compat": "at", "anchored": "before"}[vid_anchor]))
    met = settled(rotated(met), "base", "shift", "turned", "upstream")
    return _finished(met, default_accession() if accession is None else accession)


def default_accession() -> Column:
    return F.concat(F.lit("NC_"), F.lpad("chrom", 6, "0"), F.lit(".1"))


#: What is shown of an annotated variant: columns of ``annotated`` and their names.
SHOWN = {
    "vid": "vid", "chrom": "chromosome", "begin": "begin", "end": "end", "ref_allele": "refAllele", "alt_allele": "altAllele",
    "variant_type": "variantType", "hgvsg": "hgvsg",
}


def annotated(
    variants: DataFrame,
    chunks: DataFrame,
    accession: Column | None = None,
    vid_anchor: str = "compat",
    size: int = CHUNK,
) -> DataFrame:
    """variants (chrom, pos, ref, alt, svtype, end_pos, ...) with begin, end, vid, hgvsg, category, variant_type
    and the alleles as shown.

    ``vid_anchor`` names the base that pads an empty allele: "compat" takes the one at the
    variant's place, "anchored" the one before it. ``accession`` names the chromosome in
    HGVS; where it is empty there is none.
    """
    accession = default_accession() if accession is None else accession
    # stored, as both ways below read them
    v = stored(classified(variants), "classified")
    direct = _finished(v.where(~_needs()).withColumns(_plain()), accession)
    met = looked_up(v.where(_needs()), chunks, accession, vid_anchor, size)
    keep = [*v.columns, "begin", "end", "vid", "hgvsg", "ref_allele", "alt_allele"]
    return direct.select(*keep).unionByName(met.select(*keep))
