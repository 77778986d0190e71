"""GFF3 lines to features, and features to genes, transcripts and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.text import strict_int, unescape
from varloom.operators.shared import refuse, repeated, settled, stored
from varloom.sources.biotypes import dimension

#: Attribute keys that are known and passed over (fixed values).
REFSEQ_SKIPPED = """
align_id allele anticodon assembly_bases_aln assembly_bases_seq batch_id bio-material bit_score blast_aligner blast_score bound_moiety
cell-line chromosome codons common_component consensus_splices country crc32 curated_alignment description direction end_range
exception exon_identity exon_number e_value feat_class filter_score for_remapping function gap_count gbkey gene_biotype gene_synonym
genome hsp_percent_coverage identity idty inference inversion_merge_aligner isolate isolation-source Is_circular
lxr_locAcc_currStat_120 lxr_locAcc_currStat_35 map matchable_bases matched_bases matches merge_aligner mobile_element_type
model_evidence mol_type not_for_annotation number num_ident num_mismatch part partial pct_coverage pct_coverage_hiqual
pct_identity_gap pct_identity_gapopen_only pct_identity_ungap product product_coverage promoted_rank protein_id pseudo qtaxid rank
recombination_class regulatory_class rpt_family rpt_type rpt_unit_range rpt_unit_seq satellite sex splices standard_name start_range
tissue-type transl_except transl_table weighted_identity
""".split()
REFSEQ_READ = "ID Parent Name gene Dbxref tag Target Gap transcript_id Note note experiment".split()
ENSEMBL_SKIPPED = """
Alias ccdsid constitutive description ensembl_end_phase external_name havana_transcript havana_version logic_name rank bound_end
bound_start color extended_end extended_start feature_type gene_biotype gene_name transcript_support_level
""".split()
ENSEMBL_READ = "ID Parent Name gene_id transcript_id protein_id version biotype tag ensembl_phase exon_id Note note".split()


def pairs(attributes: Column) -> Column:
    """array of struct(k, v) of key=value;... with v null where there is no equals sign; empty parts are left out."""
    parts = F.filter(F.transform(F.split(attributes, ";", -1), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.when(
            F.instr(p, "=") > 0,
            F.struct(
                F.substring_index(p, "=", 1).alias("k"),
                F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)).alias("v"),
            ),
        ).otherwise(F.struct(p.alias("k"), F.lit(None).cast("string").alias("v"))),
    )


def last_value(a: Column, *keys: str) -> Column:
    hits = F.filter(a, lambda p: p["k"].isin(*keys))
    return F.try_element_at(hits, F.lit(-1))["v"]


def any_value(a: Column, key: str, value: str) -> Column:
    return F.exists(a, lambda p: (p["k"] == key) & (p["v"] == value))


def cigar(gap: Column) -> Column:
    """array of struct(op, length) of a Gap attribute (M, I and D)."""
    return F.transform(
        F.filter(F.split(gap, " "), lambda t: t != ""),
        lambda t: F.struct(F.substring(t, 1, 1).alias("op"), strict_int(F.substring(t, 2, 20)).alias("length")),
    )


def dbxref(text: Column, prefix: str) -> Column:
    """What follows the last colon of the last entry whose text before it is the prefix."""
    hits = F.filter(F.split(text, ",", -1), lambda t: F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, ":", -1)) - 1) == prefix)
    return F.substring_index(F.try_element_at(hits, F.lit(-1)), ":", -1)


def target(text: Column) -> Column:
    t = F.split(text, " ")
    return F.struct(F.get(t, 0).alias("id"), strict_int(F.get(t, 1)).alias("start"), strict_int(F.get(t, 2)).alias("end"))


def experiment(text: Column) -> Column:
    """struct(eco, pubmed) of bracketed ids; eco is null without one, pubmed null if empty."""
    inside = F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    eco = F.try_element_at(F.filter(inside, lambda x: x.startswith("ECO")), F.lit(-1))
    lists = F.transform(F.filter(inside, lambda x: x.startswith("PMID")), lambda x: F.split(F.replace(x, F.lit("%2C"), F.lit(",")), ", "))
    ids = F.transform(F.filter(F.flatten(lists), lambda p: F.length(p) > 5), lambda p: strict_int(F.substring(p, 6, 20), "long"))
    return F.struct(
        strict_int(F.substring(eco, 5, 20), "long").alias("eco"), F.when(F.size(ids) > 0, ids).alias("pubmed")
    )


def joined_parts(attributes: Column) -> Column:
    """The parts of key=value;... without spaces around them, a semicolon before and after each."""
    t = F.concat(F.lit(";"), attributes, F.lit(";"))
    return F.when(t.contains("; ") | t.contains(" ;"), F.regexp_replace(t, " *; *", ";")).otherwise(t)


def is_plain(parts: Column) -> Column:
    """Whether all joined parts are read or passed over keys with a value, and notes are spelled in one way."""
    odd = parts.rlike(";(?!;|\\z|(?:" + "|".join([*REFSEQ_READ, *REFSEQ_SKIPPED]) + ")=)")
    return ~odd & ~(parts.contains(";Note=") & parts.contains(";note="))


def part_value(parts: Column, key: str) -> Column:
    """What ``last_value`` gives, of plain parts; found in the text itself, without looking through an array."""
    return F.when(parts.contains(f";{key}="), F.substring_index(F.substring_index(parts, f";{key}=", -1), ";", 1))


def refseq_attributes(a: Column, parts: Column) -> Column:
    """Attributes of joined parts, or of the pairs where these are not null, both columns of their own.

    Pairs are wanted only where parts aren't plain, see ``is_plain``.
    """

    def read(value, has, unknown) -> Column:
        xref = value("Dbxref")
        t = target(value("Target"))
        return F.struct(
            value("ID").alias("id"),
            value("Parent").alias("parent"),
            value("Name").alias("name"),
            value("gene").alias("symbol"),
            dbxref(xref, "GeneID").alias("gene_id"),
            strict_int(dbxref(xref, "HGNC:HGNC"), "long").alias("hgnc_id"),
            value("transcript_id").alias("transcript_id"),
            F.lit(None).cast("string").alias("protein_id"),
            F.lit(None).cast("int").alias("version"),
            F.lit(None).cast("string").alias("biotype_attr"),
            has("MANE Select").alias("mane_select"),
            has("MANE Plus Clinical").alias("mane_plus_clinical"),
            has("RefSeq Select").alias("refseq_select"),
            F.lit(False).alias("ensembl_canonical"),
            t["id"].alias("target_id"),
            t["start"].alias("target_start"),
            t["end"].alias("target_end"),
            cigar(value("Gap")).alias("cigar"),
            unescape(value("Note", "note")).alias("note"),
            experiment(value("experiment")).alias("experiment"),
            unknown.alias("unknown_key"),
        )

    plain = read(
        lambda *keys: F.coalesce(*[part_value(parts, k) for k in keys]), lambda tag: parts.contains(f";tag={tag};"), F.lit(None).cast("string")
    )
    known = [*REFSEQ_READ, *REFSEQ_SKIPPED]
    unknown = F.try_element_at(F.filter(a, lambda p: ~p["k"].isin(*known) | p["v"].isNull()), F.lit(1))["k"]
    return F.when(a.isNull(), plain).otherwise(read(lambda *keys: last_value(a, *keys), lambda tag: any_value(a, "tag", tag), unknown))


def ensembl_attributes(a: Column, parts: Column) -> Column:
    tags = F.flatten(F.transform(F.filter(a, lambda p: p["k"] == "tag"), lambda p: F.split(p["v"], ",")))
    has = lambda t: F.array_contains(tags, t)
    none = F.lit(None).cast("string")
    known = [*ENSEMBL_READ, *ENSEMBL_SKIPPED]
    return F.struct(
        F.coalesce(F.nullif(last_value(a, "ID"), F.lit("")), F.concat(F.lit("exon:"), last_value(a, "exon_id"))).alias("id"),
        last_value(a, "Parent").alias("parent"),
        last_value(a, "Name").alias("name"),
        none.alias("symbol"),
        last_value(a, "gene_id").alias("gene_id"),
        F.lit(None).cast("long").alias("hgnc_id"),
        last_value(a, "transcript_id").alias("transcript_id"),
        last_value(a, "protein_id").alias("protein_id"),
        strict_int(last_value(a, "version")).alias("version"),
        last_value(a, "biotype").alias("biotype_attr"),
        has("MANE_Select").alias("mane_select"),
        has("MANE_Plus_Clinical").alias("mane_plus_clinical"),
        F.lit(False).alias("refseq_select"),
        has("Ensembl_canonical").alias("ensembl_canonical"),
        none.alias("target_id"),
        F.lit(None).cast("int").alias("target_start"),
        F.lit(None).cast("int").alias("target_end"),
        F.lit(None).cast("array<struct<op:string,length:int>>").alias("cigar"),
        last_value(a, "Note", "note").alias("note"),
        F.lit(None).cast("struct<eco:bigint,pubmed:array<bigint>>").alias("experiment"),
        F.try_element_at(F.filter(a, lambda p: ~p["k"].isin(*known) | p["v"].isNull()), F.lit(1))["k"].alias("unknown_key"),
    )


def features(lines: DataFrame, aliases: DataFrame, style: str, order: str | None = None) -> DataFrame:
    """Features of lines (value, ...): ref_index, biotype, category, coding, code, start, end, reverse, attr, error.

    Comments and lines of unknown chromosomes go before their type is looked at; types that
    aren't of use go too. Lines with another number of columns, unknown types, no ID or an
    unknown attribute key keep an error. RefSeq files end at the first ### line, by ``order``.
    """
    d = lines
    if style == "refseq" and order is not None:
        stop = d.where(F.col("value").startswith("###")).agg(F.min(order)).first()[0]  # one number
        d = d if stop is None else d.where(F.col(order) < F.lit(stop))
    d = d.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    d = d.withColumn("_c", F.split("value", "\t", -1))
    a = F.broadcast(aliases.select(F.col("name").alias("a_name"), "ref_index"))  # a few names a chromosome
    d = d.join(a, F.get(F.col("_c"), 0) == F.col("a_name"), "left").where(F.col("a_name").isNotNull() | (F.size("_c") != 9))
    t = F.broadcast(dimension(lines.sparkSession))
    d = d.join(t, F.get(F.col("_c"), 2) == F.col("spelling"), "left")
    d = d.where(F.coalesce(~F.col("category").isin("not_useful", "unsupported"), F.lit(True)))
    read = refseq_attributes if style == "refseq" else ensembl_attributes
    d = d.withColumn("_parts", joined_parts(F.coalesce(F.get(F.col("_c"), 8), F.lit(""))))
    made = pairs(F.col("_parts"))
    d = d.withColumn("_pairs", F.when(~is_plain(F.col("_parts")), made) if style == "refseq" else made)
    d = d.withColumns(
        {
            "attr": read(F.col("_pairs"), F.col("_parts")),
            "start": strict_int(F.get(F.col("_c"), 3)),
            "end": strict_int(F.get(F.col("_c"), 4)),
            "reverse": F.coalesce(F.get(F.col("_c"), 6) == "-", F.lit(False)),
        }
    )
    error = (
        F.when(F.size("_c") != 9, "columns")
        .when(F.col("biotype").isNull(), "type")
        .when(F.col("start").isNull() | F.col("end").isNull(), "place")
        .when(F.coalesce(F.col("attr.id"), F.lit("")) == "", "no ID")
        .when(F.col("attr.unknown_key").isNotNull(), F.concat(F.lit("key "), F.col("attr.unknown_key")))
    )
    d = d.withColumn("error", error).drop("_c", "_parts", "_pairs", "a_name", "spelling")
    return settled(d, "attr", "start", "end", "reverse", "error")


def regulatory(f: DataFrame) -> DataFrame:
    return f.where("category = 'regulatory'").orderBy("ref_index", "start", "end")


def hierarchy(f: DataFrame, style: str) -> dict[str, DataFrame]:
    """genes, transcripts, exons, cds, matches and orphans of features, by equality joins on (ref_index, parent id).

    RefSeq keeps genes and pseudogenes, and transcripts named NM or NR; Ensembl ids have a
    prefix before the colon, and artefacts go. Children of dropped transcripts go with
    them; ``orphans`` are children whose parent is nowhere in the file, ``unmatched``
    alignments that no exon stands for, ``repeated`` ids that several genes or transcripts
    have (see ``refuse_unsound``).
    """
    rows = f.where(F.col("error").isNull()).select("ref_index", "biotype", "category", "coding", "code", "start", "end", "reverse", "attr", *[c for c in ("order",) if c in f.columns])
    rows = stored(rows, "features")  # read many times below, each time for a few columns
    genes = rows.where("category = 'gene'")
    tx = rows.where("category = 'transcript'")
    if style == "refseq":
        genes = genes.where("biotype in ('gene', 'pseudogene')")
        kept = tx.where(F.substring_index("attr.name", "_", 1).isin("NM", "NR"))
    else:
        genes = genes.where(F.substring_index("attr.id", ":", 1) == "gene")
        kept = tx.where(~F.coalesce(F.col("attr.biotype_attr").isin("artifact", "unconfirmed_transcript"), F.lit(False)))
    g = genes.select(F.col("ref_index").alias("g_index"), F.col("attr.id").alias("g_id"))
    kept = kept.join(g, (F.col("ref_index") == F.col("g_index")) & (F.col("attr.parent") == F.col("g_id"))).drop("g_index")
    parents = kept.select(F.col("ref_index").alias("p_index"), F.col("attr.id").alias("p_id"))

    def under(children: DataFrame) -> DataFrame:
        on = (F.col("ref_index") == F.col("p_index")) & (F.col("attr.parent") == F.col("p_id"))
        return children.join(parents, on).drop("p_index")

    children = rows.where("category = 'child'")
    exons = under(children.where("biotype = 'exon'"))
    everyone = rows.where("category in ('gene', 'transcript')").select(F.col("ref_index").alias("q_index"), F.col("attr.id").alias("q_id"))
    orphans = children.join(everyone, (F.col("ref_index") == F.col("q_index")) & (F.col("attr.parent") == F.col("q_id")), "left_anti")
    aligned = rows.where("category = 'alignment'").withColumnRenamed("start", "m_start")
    x = exons.select(F.col("ref_index").alias("x_index"), F.col("attr.transcript_id").alias("x_tx"), F.col("start").alias("x_start"), "p_id")
    on = (F.col("ref_index") == F.col("x_index")) & (F.col("attr.target_id") == F.col("x_tx")) & (F.col("m_start") == F.col("x_start"))
    matches = aligned.join(x, on).drop("x_index", "x_tx", "x_start").withColumnRenamed("m_start", "start")
    # exons of transcripts that are not kept stand for their alignments too
    any_exon = children.where("biotype = 'exon'").select(F.col("ref_index").alias("x_index"), F.col("attr.transcript_id").alias("x_tx"), F.col("start").alias("x_start"))
    unmatched = aligned.join(any_exon, on, "left_anti").withColumnRenamed("m_start", "start")
    twice = repeated(rows.where("category in ('gene', 'transcript')").select("ref_index", F.col("attr.id").alias("id")), "ref_index", "id")
    return {
        "genes": genes, "transcripts": kept, "exons": exons, "cds": under(children.where("biotype = 'CDS'")), "matches": matches,
        "orphans": orphans, "unmatched": unmatched, "repeated": twice,
    }


def refuse_unsound(parts: dict[str, DataFrame]) -> None:
    """Raises on children without a parent, alignments without an exon and repeated ids (RefSeq files)."""
    refuse(parts["orphans"].select("ref_index", "attr.id", "attr.parent"), "children without a parent")
    refuse(parts["unmatched"].select("ref_index", "attr.id", "attr.target_id", "start"), "alignments without an exon")
    refuse(parts["repeated"], "repeated ids")
