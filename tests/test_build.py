"""Whole builds from files on disk: reference, cache and annotation over the pruned reference."""

import gzip

import pytest
from pyspark.sql import functions as F

from varloom.functions.codons import STANDARD
from varloom.operators.evaluate import protein_of
from varloom.plans.annotate import annotated
from varloom.plans.build import CacheFiles, create_cache, create_reference
from varloom.plans.models import read_cached
from varloom.plans.reference import reference_chunks, verified

#: The coding bases are 14 to 40 and 61 to 69: a start codon, ten others and a stop codon.
SEQ, MT = "ACGTTGCA" + "CAGGC" + "ATG" + "GCT" * 8 + "CAGTTGCATT" * 2 + "GAAGAC" + "TAA" + "ACGTTGCA" * 31, "ATGGCCTAA" * 20
FEATURES = [
    "NC_1\tx\tgene\t1\t300\t.\t+\t.\tID=g1;Dbxref=GeneID:77,HGNC:HGNC:5;gene=ABC",
    "NC_1\tx\tmRNA\t1\t300\t.\t+\t.\tID=t1;Parent=g1;Name=NM_1.1;transcript_id=NM_1.1;tag=MANE Select",
    "NC_1\tx\texon\t11\t40\t.\t+\t.\tID=e1;Parent=t1;transcript_id=NM_1.1",
    "NC_1\tx\texon\t61\t100\t.\t+\t.\tID=e2;Parent=t1;transcript_id=NM_1.1",
    "NC_1\tx\tCDS\t14\t40\t.\t+\t0\tID=c1;Parent=t1;Name=NP_1.1",
    "NC_1\tx\tCDS\t61\t69\t.\t+\t0\tID=c1b;Parent=t1;Name=NP_1.1",
    "NC_1\tx\tmRNA\t1\t300\t.\t+\t.\tID=t3;Parent=g1;Name=NM_3.1;transcript_id=NM_3.1",
    "NC_1\tx\tenhancer\t5\t9\t.\t+\t.\tID=r1",
    "###",
]
ENSEMBL = [
    "1\tx\tgene\t1\t300\t.\t+\t.\tID=gene:G1;Name=ABC;gene_id=ENSG7;version=2",
    "1\tx\tmRNA\t1\t300\t.\t+\t.\tID=transcript:T1;Parent=gene:G1;transcript_id=T1;version=3",
    "1\tx\texon\t11\t40\t.\t+\t.\tParent=transcript:T1;exon_id=E1",
    "1\tx\texon\t61\t100\t.\t+\t.\tParent=transcript:T1;exon_id=E2",
    "1\tx\tCDS\t14\t40\t.\t+\t0\tID=CDS:P1;Parent=transcript:T1;protein_id=P1",
    "1\tx\tCDS\t61\t69\t.\t+\t0\tID=CDS:P1;Parent=transcript:T1;protein_id=P1",
]
CDNA = SEQ[10:40] + SEQ[60:100]
PROTEIN = protein_of(CDNA[3:39].encode(), STANDARD).decode()


def put(path, lines, sep="\n"):
    with gzip.open(path, "wt") as f:
        f.write(sep.join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def reference(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("reference")
    report = ["# c", f"1\tx\tx\tx\tCM1\t=\tNC_1\tx\t{len(SEQ)}\tchr1", f"MT\tx\tx\tx\tna\t=\tNC_2\tx\t{len(MT)}\tchrM", "U\tx\tx\tx\tna\t=\tNC_3\tx\t9\tna"]
    files = {
        "report": put(d / "report.gz", report), "fasta": put(d / "fa.gz", [">NC_1 one", SEQ[:100], SEQ[100:], ">NC_2 m", MT]),
        "bands": put(d / "bands.gz", ["1\tp\t36\t0\t0\t1\t200"]), "mirna": put(d / "mirna.gz", ["NC_1\tx\tmiRNA\t5\t9\t.\t+\t.\tID=1"]),
    }
    return files, str(d / "made"), create_reference(spark, **files, path=str(d / "made"), size=64, margin=8)


def files_of(d, features=FEATURES, **other):
    """A RefSeq source; ``other`` replaces the lines of a file."""
    given = {
        "rna": [">NM_1.1 x", CDNA[:30], CDNA[30:]], "protein": [">NP_1.1 x", PROTEIN.rstrip("*")],
        "genbank": ["LOCUS X", "VERSION     NM_1.1", "FEATURES             Location/Qualifiers", "     CDS             4..39", "                     /codon_start=1", "ORIGIN", "//"],
        "names": ["hgnc_id\tsymbol\tentrez_id\tensembl_gene_id\trefseq_accession", "HGNC:9\tDIO\t77\tENSG7\t"],
    } | other
    made = {k: put(d / f"{k}.gz", v) for k, v in given.items()}
    return CacheFiles("refseq", put(d / "gff.gz", features), (made["rna"],), made["protein"], made["genbank"]), made["names"]


def test_reference_from_files(spark, reference, tmp_path):
    files, path, counts = reference
    assert counts == {"chromosomes": 2, "bases": len(SEQ) + len(MT)}
    rows, whole = spark.read.parquet(f"{path}/chromosomes"), spark.createDataFrame([("NC_1", SEQ), ("NC_2", MT)], "accession string, seq string")
    assert verified(path, rows, whole, 64, 8)
    changed = spark.createDataFrame([("NC_1", SEQ[:200] + "G" + SEQ[201:]), ("NC_2", MT)], "accession string, seq string")
    assert SEQ[200] != "G" and not verified(path, rows, changed, 64, 8)
    twice = files | {"fasta": put(tmp_path / "fa.gz", [">NC_1", SEQ, ">NC_1", SEQ])}
    with pytest.raises(ValueError, match="repeated accessions"):
        create_reference(spark, **twice, path=str(tmp_path / "none"))
    short = files | {"fasta": put(tmp_path / "fb.gz", [">NC_1", SEQ[:-1]])}
    with pytest.raises(ValueError, match="length"):
        create_reference(spark, **short, path=str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_only_present_chromosomes_are_opened(spark, reference):
    """Annotation over the pruned chunks equals that over all, and reads one chromosome's files."""
    v = spark.createDataFrame([("1", p, SEQ[p - 1], SEQ[p - 1] + x, None, p) for p in range(2, 300, 7) for x in ("A", "TTG")], "chrom string, pos long, ref string, alt string, svtype string, end_pos long")
    part, every = reference_chunks(spark, reference[1], v), reference_chunks(spark, reference[1])
    opened = lambda d: {f.split("ref_index=")[1][0] for f in d.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert opened(part) == {"0"} and opened(every) == {"0", "1"}
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ref_index" in scan or "PartitionFilters: [ref_index" in scan
    names = lambda c: sorted((r.pos, r.alt, r.vid, r.hgvsg) for r in annotated(v, c, size=64).collect())
    assert names(part) == names(every)


def test_cache_from_files(spark, reference, tmp_path):
    files, names = files_of(tmp_path)
    got = create_cache(spark, files, names, reference[1], str(tmp_path / "cache"), 64)
    assert (got["coding"], got["noncoding"], got["skipped"], got["withoutSequence"], got["regulatory"]) == (1, 0, 0, 1, 1)
    assert got["outcomes"]["perfect"] == 1 and sum(got["outcomes"].values()) == 1
    t, g = (read_cached(spark, str(tmp_path / "cache"), n, 0).first() for n in ("transcripts", "genes"))
    assert t.tx == "NM_1.1" and (g.symbol, g.hgnc_id, g.ensembl) == ("DIO", 9, "ENSG7")


def test_ensembl_cache_takes_both_regulatory_files(spark, reference, tmp_path):
    gff = put(tmp_path / "ens.gz", ENSEMBL)
    _, names = files_of(tmp_path)
    more = put(tmp_path / "reg.gz", ["1\tx\tenhancer\t50\t90\t.\t.\t.\tID=enhancer:R1", "1\tx\tpromoter\t20\t30\t.\t.\t.\tID=promoter:R2"])
    rna = (put(tmp_path / "cdna.gz", [">T1.3 cdna", CDNA]), put(tmp_path / "nc.gz", [">T9.1 nc", "ACGT"]))
    files = CacheFiles("ensembl", gff, rna, put(tmp_path / "pep.gz", [">P1.1 pep transcript:T1.3 x", PROTEIN.rstrip("*")]), regulatory=more)
    got = create_cache(spark, files, names, reference[1], str(tmp_path / "cache"), 64)
    assert got["coding"] == 1 and got["regulatory"] == 2 and got["outcomes"]["perfect"] == 1
    assert read_cached(spark, str(tmp_path / "cache"), "transcripts", 0).first().protein_id == "P1.1"
    both = CacheFiles("ensembl", gff, (rna[0], rna[0]), files.protein)
    with pytest.raises(ValueError, match="repeated transcript ids"):
        create_cache(spark, both, names, reference[1], str(tmp_path / "none"), 64)


@pytest.mark.parametrize(
    ("what", "features", "other"),
    [
        ("unreadable features", [*FEATURES[:6], "NC_1\tx\texon\tone\t9\t.\t+\t.\tID=e9;Parent=t1"], {}),
        ("children without a parent", [*FEATURES[:6], "NC_1\tx\texon\t1\t9\t.\t+\t.\tID=e9;Parent=nobody"], {}),
        ("repeated protein ids", FEATURES, {"protein": [">NP_1.1", "MA", ">NP_1.1", "MA"]}),
        ("repeated transcripts of proteins", FEATURES, {"protein": [">NP_1.1 x transcript:a", "MA", ">NP_2.1 x transcript:a", "MA"]}),
        ("repeated gene name ids", FEATURES, {"names": ["hgnc_id\tsymbol\tentrez_id\tensembl_gene_id\trefseq_accession", "HGNC:9\tD\t1\tE\t", "HGNC:9\tF\t2\tH\t"]}),
        ("unreadable records", FEATURES, {"genbank": ["LOCUS X", "VERSION     NM_1.1", "FEATURES             Location", "     CDS             4..39", "ORIGIN", "//"]}),
    ],
)
def test_what_stops_a_cache_build(spark, reference, tmp_path, what, features, other):
    files, names = files_of(tmp_path, features, **other)
    with pytest.raises(ValueError, match=what):
        create_cache(spark, files, names, reference[1], str(tmp_path / "none"), 64)
    assert not (tmp_path / "none").exists()
