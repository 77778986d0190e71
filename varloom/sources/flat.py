"""Smaller text formats: FASTA, GenBank, gene names, assembly reports, bands, miRNA regions, configurations."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.text import strict_int
from varloom.operators.shared import refuse, repeated


def accession(header: Column) -> Column:
    """Accession of a FASTA header: gi|n|ref|X|, ref|X|, or the first word; null if there is none."""
    p = F.split(header, r"\|", -1)
    first = F.regexp_extract(header, r"^\s*(\S+)", 1)
    get = lambda i: F.nullif(F.trim(F.get(p, i)), F.lit(""))
    gi = F.when(header.startswith("gi|") & (F.get(p, 2) == "ref"), get(3))
    ref = F.when(header.startswith("ref|"), get(1))
    return F.coalesce(gi, ref, F.nullif(first, F.lit("")))


def fasta_records(records: DataFrame) -> DataFrame:
    """(accession, header, seq) of texts (value) that each hold one record, with or without the leading >."""
    text = F.regexp_replace(F.col("value"), "^>", "")
    header = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    body = F.substring(text, F.length(F.substring_index(text, "\n", 1)) + 2, F.length(text))
    seq = F.upper(F.regexp_replace(body, r"\s+", ""))
    return records.where(F.length(F.trim("value")) > 0).select(
        accession(header).alias("accession"), header.alias("header"), F.when(F.instr(text, "\n") > 0, seq).otherwise("").alias("seq")
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_records(spark.read.text(path, lineSep="\n>"))


def cds_range(text: Column) -> Column:
    """struct(start, end) of a..b or join(a..b,...): first start and last end; null if it isn't plain numbers."""
    join = F.regexp_extract(F.trim(text), r"^join\(\s*([0-9]+)(?:\.\.[^,]*)?(?:,.*)?\)$", 1)
    last = F.regexp_extract(F.trim(text), r"^join\((?:.*[.,(])?\s*([0-9]+)\s*\)$", 1)
    one = F.regexp_extract(F.trim(text), r"^([0-9]+)\s*\.\.\s*([0-9]+)$", 1)
    two = F.regexp_extract(F.trim(text), r"^([0-9]+)\s*\.\.\s*([0-9]+)$", 2)
    start, end = F.when(join != "", join).otherwise(F.nullif(one, F.lit(""))), F.when(join != "", F.nullif(last, F.lit(""))).otherwise(F.nullif(two, F.lit("")))
    made = F.struct(start.try_cast("int").alias("start"), end.try_cast("int").alias("end"))
    return F.when(made["start"].isNotNull() & made["end"].isNotNull(), made)


def genbank_records(records: DataFrame) -> DataFrame:
    """(id, start, end, codon_start, error) of GenBank records (value, one a row); predicted ones (XM, XR) go.

    ``start`` is null for records without a coding region; a region that isn't plain
    numbers or has no codon start is an error.
    """
    v = F.col("value")
    ident = F.trim(F.regexp_extract(v, r"(?m)^VERSION\s+(.*)$", 1))
    features = F.regexp_extract(v, r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|\n//|$)", 1)
    block = F.regexp_extract(features, r"(?s)(?:^|\n) {5}CDS {13}(.*?)(?=\n {5}\S|$)", 1)
    place = F.regexp_extract(block, r"^([^\n]*)", 1)
    codon = F.regexp_extract(block, r"/codon_start=([0-9]+)", 1)
    d = records.where(v.rlike("^\\s*LOCUS")).select(
        ident.alias("id"), (block != "").alias("coding"), cds_range(place).alias("r"), F.nullif(codon, F.lit("")).try_cast("int").alias("codon_start")
    )
    d = d.where(~F.substring_index("id", "_", 1).isin("XM", "XR"))
    error = F.when(F.col("id") == "", "no VERSION").when(F.col("coding") & F.col("r").isNull(), "range").when(F.col("coding") & F.col("codon_start").isNull(), "codon_start")
    return d.select("id", "r.start", "r.end", "codon_start", error.alias("error"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    return genbank_records(spark.read.text(path, lineSep="\n//\n"))


def gene_names(rows: DataFrame, order: str) -> dict[str, DataFrame]:
    """Gene name table (hgnc_id, symbol, entrez_id, ensembl_gene_id, refseq_accession as text) as its three indexes.

    ``by_ncbi`` and ``by_ensembl`` keep the last row of each id; ``repeated`` has HGNC ids that come twice.
    """
    ident = strict_int(F.regexp_replace("hgnc_id", "^HGNC:", ""), "long")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    d = rows.select(
        ident.alias("hgnc_id"), "symbol", blank("entrez_id").alias("ncbi"), blank("ensembl_gene_id").alias("ensembl"),
        F.split(blank("refseq_accession"), r"\|").alias("refseq"), F.col(order).alias("_order"),
    )
    whole = F.struct("hgnc_id", "symbol", "ncbi", "ensembl", "refseq")
    last = lambda key: d.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(whole, "_order").alias("r")).select("key", "r.*")
    repeated = d.groupBy("hgnc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {"all": d.drop("_order"), "by_ncbi": last("ncbi"), "by_ensembl": last("ensembl"), "repeated": repeated}


GENE_NAME_COLUMNS = ("hgnc_id", "symbol", "entrez_id", "ensembl_gene_id", "refseq_accession")


def gene_name_rows(lines: DataFrame, order: str) -> DataFrame:
    """Columns of a tab-separated gene name table (value, ``order``) found by its header line, the first; short rows go."""
    first = lines.orderBy(order).first()
    if first is None:
        raise ValueError("no header line")
    header = first["value"].split("\t")
    missing = [c for c in GENE_NAME_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    c = F.split("value", "\t", -1)
    last = max(header.index(n) for n in GENE_NAME_COLUMNS)
    rows = lines.where((F.col(order) > F.lit(first[order])) & (F.size(c) > last))
    return rows.select(*[F.get(c, header.index(n)).alias(n) for n in GENE_NAME_COLUMNS], order)


def refuse_repeated(rows: DataFrame, key: str, what: str) -> DataFrame:
    """``rows``, after raising if a key comes more than once."""
    refuse(repeated(rows, key), f"repeated {what}")
    return rows


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables, after raising if they share a key or one repeats it."""
    return refuse_repeated(a.unionByName(b), key, key)


def report_rows(lines: DataFrame) -> DataFrame:
    """(ensembl, genbank, refseq, length, ucsc) of assembly report lines (value); na means nothing."""
    c = F.split("value", "\t", -1)
    clean = lambda i: F.when(F.lower(F.get(c, i)) == "na", "").otherwise(F.get(c, i))
    return lines.where(~F.col("value").startswith("#") & (F.size(c) >= 10)).select(
        "*", clean(0).alias("ensembl"), clean(4).alias("genbank"), clean(6).alias("refseq"),
        strict_int(F.get(c, 8), "long").alias("length"), clean(9).alias("ucsc"),
    )


def band_rows(lines: DataFrame) -> DataFrame:
    """(chrom, begin, end, name) of ideogram lines (value): chromosome, arm, band, _, _, begin, end."""
    c = F.split("value", "\t", -1)
    return lines.where(~F.col("value").startswith("#") & (F.size(c) >= 7)).select(
        F.get(c, 0).alias("chrom"), strict_int(F.get(c, 5), "long").alias("begin"), strict_int(F.get(c, 6), "long").alias("end"),
        F.concat(F.get(c, 1), F.get(c, 2)).alias("name"),
    )


def mirna_rows(lines: DataFrame) -> DataFrame:
    """(accession, begin, end) of miRNA features; a line of fewer than nine columns is an error, raised when it is read."""
    c = F.split("value", "\t", -1)
    d = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    short = F.when(F.size(c) < 9, F.raise_error(F.concat(F.lit("fewer than nine columns: "), "value")).cast("boolean"))
    d = d.where(F.coalesce(short, F.get(c, 2) == "miRNA"))
    return d.select(F.get(c, 0).alias("accession"), strict_int(F.get(c, 3), "long").alias("begin"), strict_int(F.get(c, 4), "long").alias("end"))


def mirna_regions(rows: DataFrame) -> DataFrame:
    """(accession, regions): an accession's regions, by begin."""
    return rows.groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("regions"))


@dataclass
class Source:
    url: str
    md5: str


def read_config(path: str, need: tuple[str, ...], may_lack_md5: bool = False) -> dict[str, Source]:
    """Sources (url, md5) of a JSON configuration, checked: assembly known, sums of 32 hex digits, at least one source."""
    raw = json.loads(Path(path).read_text())
    if raw.get("genomeAssembly", "").lower() not in ("grch37", "grch38"):
        raise ValueError("unknown assembly")
    found = {}
    for name in need:
        if name in raw:
            s = Source(raw[name]["url"], raw[name]["md5"])
            if not (re.fullmatch("[0-9a-fA-F]{32}", s.md5) or (may_lack_md5 and not s.md5)):
                raise ValueError(f"{name}: md5 must have 32 hex digits")
            found[name] = s
    if not found:
        raise ValueError("no sources")
    return found


def file_name(url: str) -> str:
    name = re.split(r"[?#]", url)[0].rsplit("/", 1)[-1]
    if name in ("", "..", ".") or "\\" in name:
        raise ValueError(f"no file name in {url}")
    return name


def md5_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def highest_patch(names: list[str], assembly: str) -> str | None:
    """Of names like GRCh38.p14.dat, that of the assembly with the highest patch."""
    hits = [(int(m[1]), n) for n in names if (m := re.fullmatch(rf"{re.escape(assembly)}\.p([0-9]+)\.dat", n, re.I))]
    return max(hits)[1] if hits else None


def latest(names: list[str], assembly: str) -> str | None:
    """The last by date of names that hold the assembly's, whatever the case."""
    hits = [n for n in names if assembly.lower() in n.lower()]
    return max(hits, default=None)
