"""Text sources on small files of our own wording."""

import json

import pytest
from pyspark.sql import functions as F

from varloom.functions.ids import contig
from varloom.operators import transcripts as X
from varloom.operators.cache import numbered
from varloom.plans.models import model_counts, read_cached, refuse_unresolved, transcript_models, write_cache
from varloom.plans.positions import annotate_file, annotate_positions, json_lines, write_positions
from varloom.plans.reference import aliases, chromosomes, problems, verified, write_reference
from varloom.operators.chunks import cut_sequences
from varloom.sources import flat, gff3, vcf
from varloom.streaming.annotate import annotate_stream

SEQ = "ACGTTGCA" * 40
LINES = [
    "chr1\t10\trs1\tC\tG\t50\tPASS\tMQ=3.5;SB=1;AF=0.1,x\tGT:AD:DP\t0/1:3,7:10",
    "chr1\t20\t.\tT\t.\t.\t.\t.\tGT\t0/0",
    "chr1\t30\t.\tGC\tG,<NON_REF>\t.\tq1;q2\tCIPOS=-1,2;END=44\tGT:VF:MCN:CN:FT\t1/2:0.5:0:2:bad",
    "chrU\t40\t.\tA\tC\t1\tPASS\t.\tGT\t0/1",
]


def as_lines(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "order long, value string")


def test_header_and_assembly(spark):
    h = vcf.parse_header(["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=248956422>", "##contig=<ID=x>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"])
    assert h.samples == ["S1", "S2"] and h.contigs == [("chr1", 248956422)]
    for bad in (["#CHROM\tPOS"], ["##fileformat=V", "chr1\t1"]):
        with pytest.raises(ValueError):
            vcf.parse_header(bad)
    infer = lambda c: vcf.infer_assembly(spark.createDataFrame(c, "name string, length long")).first().assembly
    assert infer(h.contigs) == "GRCh38" and infer([("1", 249250621), ("2", 242193529)]) == "unknown"
    assert infer([("chrM", 16569)]) == "unknown"


def test_records(spark):
    r = {x.order: x for x in vcf.parse_lines(as_lines(spark, LINES), 1).collect()}
    assert r[0].quality == 50 and r[0].info.mq == 3.5 and r[0].info.af is None and r[0].samples[0].variantFrequencies == [0.7]
    assert r[1].is_reference and r[1].filters == [] and r[1].samples == []
    s = r[2].samples[0]
    assert r[2].alts == ["G"] and r[2].end_pos == 44 and tuple(r[2].info.cipos) == (-1, 2) and r[2].filters == ["q1", "q2"]
    assert s.variantFrequencies == [0.5] and s.lossOfHeterozygosity and s.failedFilter
    bad = ["chr1\tx\t.\tA\tC\t.\t.\t.\tGT\t0/1", "chr1\t5\t.\tA", "chr1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\t0/1"]
    errors = [x.error for x in vcf.parse_lines(as_lines(spark, bad), 1, strict=False).orderBy("order").collect()]
    assert errors[0].startswith("bad position") and errors[1].startswith("fewer") and errors[2].startswith("samples")
    with pytest.raises(Exception):  # noqa: B017
        vcf.parse_lines(as_lines(spark, bad), 1).collect()


@pytest.fixture(scope="module")
def parts(spark):
    chunks = cut_sequences(spark.createDataFrame([("1", SEQ)], "chrom string, seq string"))
    bands = spark.createDataFrame([("1", 1, 25, "p1"), ("1", 26, 29, "p2")], "chrom string, begin long, end long, name string")
    names = spark.createDataFrame([("chr1", 0), ("1", 0)], "name string, ref_index int")
    return chunks, bands, names


def test_json_positions(spark, parts, tmp_path):
    p = annotate_positions(as_lines(spark, LINES), *parts, n_samples=1)
    out = [json.loads(r.value) for r in json_lines(p).orderBy("order").collect()]
    assert [o["position"] for o in out] == [10, 30]
    assert out[0]["locus"] == "p1" and "locus" not in out[1] and out[0]["filters"] == ["PASS"]
    assert out[0]["variants"][0]["vid"] == "1-10-C-G" and out[0]["variants"][0]["hgvsg"].endswith(":g.10C>G")
    assert out[1]["variants"][0]["variantType"] == "deletion" and "isDeNovo" not in out[1]["samples"][0] and out[1]["samples"][0]["failedFilter"] is True
    counts = write_positions(p, str(tmp_path / "o"))
    assert counts == {"positions": 2, "variants": 2}


def test_stream_equals_batch(spark, parts, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(["##x", *LINES]) + "\n")
    q = annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), *parts, n_samples=1)
    q.awaitTermination(60)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "*")).collect())
    want = sorted(r.value for r in json_lines(annotate_positions(as_lines(spark, LINES), *parts, n_samples=1)).collect())
    assert got == want


def test_scattered_chromosomes(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate("aabbbaccd")], "order long, chrom string")
    assert [r.chrom for r in vcf.scattered_chromosomes(d, "order").collect()] == ["a"]
    assert vcf.scattered_chromosomes(d.where("order > 1"), "order").count() == 0


GFF = [
    "NC_1\tx\tgene\t1\t300\t.\t+\t.\tID=g1;Dbxref=GeneID:77,HGNC:HGNC:5;gene=ABC",
    "NC_1\tx\tmRNA\t1\t300\t.\t+\t.\tID=t1;Parent=g1;Name=NM_1.1;transcript_id=NM_1.1;tag=MANE Select",
    "NC_1\tx\tmRNA\t1\t300\t.\t+\t.\tID=t2;Parent=g1;Name=XM_2.1;transcript_id=XM_2.1",
    "NC_1\tx\texon\t11\t40\t.\t+\t.\tID=e1;Parent=t1;transcript_id=NM_1.1;Note=a%252Cb",
    "NC_1\tx\texon\t61\t100\t.\t+\t.\tID=e2;Parent=t1;transcript_id=NM_1.1",
    "NC_1\tx\texon\t61\t100\t.\t+\t.\tID=e3;Parent=t2;transcript_id=XM_2.1",
    "NC_1\tx\tCDS\t14\t40\t.\t+\t0\tID=c1;Parent=t1;Name=NP_1.1",
    "NC_1\tx\tCDS\t61\t69\t.\t+\t0\tID=c1b;Parent=t1;Name=NP_1.1",
    "NC_9\tx\twhatever\t1\t2\t.\t+\t.\tID=z",
    "NC_1\tx\tcentromere\t1\t2\t.\t+\t.\tID=y",
    "NC_1\tx\tenhancer\t5\t9\t.\t+\t.\tID=r1;experiment=COORDINATES: x [ECO:0000269][PMID:12%2C PMID:34]",
    "###",
    "NC_1\tx\tgene\t1\t300\t.\t+\t.\tID=late",
]


def test_refseq_models(spark, tmp_path):
    names = spark.createDataFrame([("NC_1", 0)], "name string, ref_index int")
    f = gff3.features(as_lines(spark, GFF), names, "refseq", "order").cache()
    assert f.where("error is not null").count() == 0 and f.where("attr.id = 'late'").count() == 0
    r = gff3.regulatory(f).first()
    assert r.attr.experiment.eco == 269 and r.attr.experiment.pubmed == [12, 34]
    assert f.where("attr.id = 'e1'").first().attr.note == "a,b"
    g = f.where("attr.id = 'g1'").first().attr
    assert (g.gene_id, g.hgnc_id) == ("77", 5)
    h = gff3.hierarchy(f, "refseq")
    assert {k: v.count() for k, v in h.items()} == {"genes": 1, "transcripts": 1, "exons": 2, "cds": 2, "matches": 0, "orphans": 0, "unmatched": 0, "repeated": 0}
    gff3.refuse_unsound(h)
    cdna = SEQ[10:40] + SEQ[60:100]
    from varloom.functions.codons import STANDARD
    from varloom.operators.evaluate import protein_of

    protein = protein_of(cdna[3:39].encode(), STANDARD).decode()
    m = transcript_models(
        h,
        spark.createDataFrame([("NM_1.1", cdna)], "tx string, seq string"),
        spark.createDataFrame([("NP_1.1", protein)], "protein_id string, seq string"),
        spark.createDataFrame([], "tx string, x_id string"),
        "refseq",
        spark.createDataFrame([("NM_1.1", 3)], "tx string, stated_start int"),
        names=flat.gene_names(spark.createDataFrame([(1, "HGNC:2884", "DIO", "77", "ENSG7", "")], "line int, hgnc_id string, symbol string, entrez_id string, ensembl_gene_id string, refseq_accession string"), "line"),
    )
    c = m["coding"].first()
    assert (c.cdna_start, c.cdna_end, c.cds_offset, c.outcome) == (4, 39, 1, "perfect") and c.mane_select
    regions = sorted((r.start, r.kind, r.cdna_start, r.cdna_end) for r in m["regions"].collect())
    assert regions == [(11, "exon", 1, 30), (41, "intron", 30, 31), (61, "exon", 31, 70)]
    assert tuple(model_counts(m).first()) == (1, 0, 0) and c.hgnc_id == 2884 and c.seleno
    refuse_unresolved(m)
    write_cache(m, str(tmp_path / "cache"), gff3.regulatory(f))
    of = lambda n: read_cached(spark, str(tmp_path / "cache"), n, 0).collect()
    assert len(of("bins")) == 2 and of("regulatory")[0].id == "r1"
    g, t, seqs = of("genes")[0], of("transcripts")[0], {r["index"]: r.seq for r in of("sequences")}
    assert (g.symbol, g.ensembl, g["index"], g.flags) == ("DIO", "ENSG7", 0, 14)
    assert t.gene_index == 0 and seqs[t.cdna_index] == cdna and seqs[t.protein_index] == protein
    numbers = {r["index"]: r.start for r in of("regions")}
    assert [numbers[i] for i in of("transcript_regions")[0].region_indexes] == [11, 41, 61]


def test_unsound_features_are_refused(spark):
    names = spark.createDataFrame([("NC_1", 0)], "name string, ref_index int")
    more = {
        "parent": "NC_1\tx\texon\t1\t9\t.\t+\t.\tID=e9;Parent=nobody",
        "exon": "NC_1\tx\tcDNA_match\t12\t40\t.\t+\t.\tID=m1;Target=NM_1.1 1 29;Gap=M29",
        "repeated": "NC_1\tx\tgene\t5\t300\t.\t+\t.\tID=g1",
    }
    for word, line in more.items():
        h = gff3.hierarchy(gff3.features(as_lines(spark, [*GFF[:11], line]), names, "refseq", "order"), "refseq")
        with pytest.raises(ValueError, match=word):
            gff3.refuse_unsound(h)


def test_mitochondrial_bases_and_file_order(spark):
    chunks = cut_sequences(spark.createDataFrame([("MT", SEQ)], "chrom string, seq string"), 16, 4)
    t = spark.createDataFrame([(5, "a", 3, 50, False), (5, "b", 3, 50, True), (0, "c", 1, 9, False), (5, "d", 300, 900, False)], "ref_index int, tx string, start int, end int, reverse boolean")
    rna = spark.createDataFrame([("a", "TTT"), ("c", "GGG"), ("d", "CC")], "tx string, seq string")
    got = {r.tx: r.seq for r in X.with_reference_bases(t, rna, chunks, 5, "MT", 16).collect()}
    part = SEQ[2:50]
    assert got == {"a": part, "b": part[::-1].translate(str.maketrans("ACGT", "TGCA")), "c": "GGG", "d": "CC"}


def test_a_file_from_header_to_metadata(spark, parts, tmp_path):
    chunks, bands, names = parts
    head = ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=248956422>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]
    (tmp_path / "a.vcf").write_text("\n".join([*head, *LINES]) + "\n")
    run = lambda name, assembly="GRCh38": annotate_file(spark, str(tmp_path / name), str(tmp_path / f"out-{name}"), chunks, bands, names, assembly, release="x")
    m = run("a.vcf")
    assert m["stats"] == {"positions": 2, "variants": 2, "skippedRecords": 1} and m["samples"] == ["S1"] and m["release"] == "x"
    assert m["input"] == {"fileName": "a.vcf", "vcfVersion": "VCFv4.2", "contigs": 1, "samples": 1, "inferredAssembly": "GRCh38"}
    read = lambda what: [r.value for r in spark.read.format("bgzf").load(str(tmp_path / f"out-a.vcf_{what}")).orderBy("order").collect()]
    assert json.loads(read("metadata")[0]) == m and read("genes") == []
    assert [json.loads(x)["position"] for x in read("variants")] == [10, 30]
    with pytest.raises(ValueError, match="GRCh38"):
        run("a.vcf", "GRCh37")
    (tmp_path / "b.vcf").write_text("\n".join([*head, *LINES, LINES[0]]) + "\n")
    with pytest.raises(ValueError, match="come again"):
        run("b.vcf")


def test_name_table_and_uniqueness(spark):
    lines = as_lines(spark, ["symbol\thgnc_id\tx\tentrez_id\tensembl_gene_id\trefseq_accession", "A\tHGNC:5\t\t1\tE1\tN1", "short\tHGNC:6"])
    r = flat.gene_name_rows(lines, "order").collect()
    assert len(r) == 1 and (r[0].hgnc_id, r[0].symbol, r[0].entrez_id) == ("HGNC:5", "A", "1")
    with pytest.raises(ValueError, match="no columns"):
        flat.gene_name_rows(as_lines(spark, ["symbol\thgnc_id"]), "order")
    a, b = (spark.createDataFrame([(x, "A")], "tx string, seq string") for x in "ab")
    assert flat.disjoint_union(a, b, "tx").count() == 2
    with pytest.raises(ValueError, match="repeated"):
        flat.disjoint_union(a, a, "tx")
    with pytest.raises(Exception, match="nine"):
        flat.mirna_rows(as_lines(spark, ["NC_1\tx\tmiRNA\t5\t9"])).collect()
    m = flat.mirna_regions(flat.mirna_rows(as_lines(spark, [f"NC_1\tx\tmiRNA\t{k}\t9\t.\t+\t.\tID=1" for k in (7, 5)])))
    assert [tuple(x) for x in m.first().regions] == [(5, 9), (7, 9)]


def test_bad_features(spark):
    names = spark.createDataFrame([("1", 0)], "name string, ref_index int")
    bad = ["1\tx\tnope\t1\t2\t.\t+\t.\tID=a", "1\tx\texon\t1\t2\t.\t+\t.\tParent=a;exon_id=E1", "1\tx\texon\t1\t2\t.\t+\t.\tID=a;zzz=1", "1\tx\texon\t1"]
    f = gff3.features(as_lines(spark, bad), names, "ensembl").orderBy("order").collect()
    assert [r.error for r in f] == ["type", None, "key zzz", "columns"] and f[1].attr.id == "exon:E1"


def test_cigar_walk_against_steps(spark):
    ops = [("M", 5), ("I", 2), ("M", 4), ("D", 3), ("M", 6)]

    def walk(place, start, end, cdna, reverse):
        g, c = (end + 1, cdna - 1) if reverse else (start - 1, cdna - 1)
        for op, n in ops:
            step = 0 if op == "I" else (-n if reverse else n)
            if (g + step <= place) if reverse else (g + step >= place):
                return c + (0 if op == "D" else abs(place - g))
            g, c = g + step, c + (0 if op == "D" else n)
        return c

    d = spark.createDataFrame([(p, r) for p in range(100, 118) for r in (True, False)], "p int, r boolean")
    col = X.along_cigar(F.col("p"), F.lit(100), F.lit(117), F.lit(31), gff3.cigar(F.lit("M5 I2 M4 D3 M6")), F.col("r"))
    assert all(x.c == walk(x.p, 100, 117, 31, x.r) for x in d.select("p", "r", col.alias("c")).collect())


def test_small_formats(spark):
    fa = spark.createDataFrame([(">gi|1|ref|NC_1|x\nacg\nt",), ("ref|NM_2|\nAA\n",), ("NR_3 more\n",)], "value string")
    assert [(r.accession, r.seq) for r in flat.fasta_records(fa).collect()] == [("NC_1", "ACGT"), ("NM_2", "AA"), ("NR_3", "")]
    ranges = ["5..9", "join(3..4,6..8)", "join(7,9..12)", "<5..9", "complement(1..2)"]
    got = spark.createDataFrame([(x,) for x in ranges], "x string").select(flat.cds_range(F.col("x")).alias("r")).collect()
    assert [tuple(r.r) if r.r else None for r in got] == [(5, 9), (3, 8), (7, 12), None, None]
    gb = "LOCUS X\nVERSION     NM_7.1\nFEATURES             Location\n     gene            1..9\n     CDS             5..9\n                     /codon_start=2\nORIGIN\n"
    rows = [(gb,), (gb.replace("NM_", "XM_"),), (gb.replace("                     /codon_start=2\n", ""),)]
    out = flat.genbank_records(spark.createDataFrame(rows, "value string")).collect()
    assert len(out) == 2 and tuple(out[0])[:4] == ("NM_7.1", 5, 9, 2) and out[1].error == "codon_start"
    names = spark.createDataFrame(
        [(0, "HGNC:5", "A", "1", "E1", "N1|N2"), (1, "6", "B", "1", "", ""), (2, "6", "C", "", "E1", "")],
        "line int, hgnc_id string, symbol string, entrez_id string, ensembl_gene_id string, refseq_accession string",
    )
    n = flat.gene_names(names, "line")
    assert n["by_ncbi"].first().symbol == "B" and n["by_ensembl"].first().symbol == "C" and n["repeated"].first().hgnc_id == 6
    assert flat.highest_patch(["GRCh38.p9.dat", "GRCh38.p14.dat", "GRCh37.p20.dat"], "GRCh38") == "GRCh38.p14.dat"
    assert flat.file_name("http://a/b.gz?x#y") == "b.gz"
    for bad in ("http://a/..", "http://a/", "http://a/x\\y"):
        with pytest.raises(ValueError):
            flat.file_name(bad)


def test_designations_and_first_takers(spark):
    t = spark.createDataFrame([("a", 1, True, False), ("a", 2, False, True), ("b", 3, False, False)], "tx string, o int, mane_select boolean, refseq_select boolean")
    t = t.withColumns({"mane_plus_clinical": F.lit(False), "ensembl_canonical": F.lit(None).cast("boolean")})
    d = {r.o: r for r in X.shared_designations(t).collect()}
    assert d[1].newly_set == d[2].newly_set == 1 and d[2].mane_select and not d[3].mane_select
    s = spark.createDataFrame([("a", "ACG")], "tx string, seq string")
    assert [(r.tx, r.o) for r in X.first_takers(t, s, "o").collect()] == [("a", 1)]
    v = spark.createDataFrame([("x", "T", 3), ("x", "A", 2), ("x", "T", 1)], "g string, v string, seen int")
    assert sorted((r.v, r["index"]) for r in numbered(v, "g", ["v"], ["v"], "seen").collect()) == [("A", 0), ("T", 1)]


def test_reference_build(spark, tmp_path):
    report = as_lines(spark, ["# c", "1\tx\tx\tx\tCM1\t=\tNC_1\tx\t320\tchr1", "Y\tx\tx\tx\tna\t=\tNC_2\tx\t9\tchrY", "U\tx\tx\tx\tna\t=\tNC_3\tx\t9\tna"])
    seqs = spark.createDataFrame([("NC_1", SEQ), ("NC_2", "N" * 9)], "accession string, seq string")
    rows = chromosomes(flat.report_rows(report), seqs, "order")
    assert sorted((r.ensembl, r.ref_index) for r in rows.collect()) == [("1", 0), ("Y", 1)]
    assert {r.name: r.ref_index for r in aliases(rows).collect()} == {"chr1": 0, "1": 0, "NC_1": 0, "CM1": 0, "chrY": 1, "Y": 1, "NC_2": 1}
    assert problems(rows, seqs).count() == 0
    short = spark.createDataFrame([("NC_1", SEQ[:-1])], "accession string, seq string")
    assert problems(chromosomes(flat.report_rows(report), short, "order"), short).first().problem == "length"
    bands = flat.band_rows(as_lines(spark, ["1\tp\t36\t0\t0\t1\t200", "1\tq\t1\t0\t0\t201\t320"]))
    mirna = flat.mirna_rows(as_lines(spark, ["NC_1\tx\tmiRNA\t5\t9\t.\t+\t.\tID=1", "NC_1\tx\texon\t5\t9\t.\t+\t.\tID=2"]))
    write_reference(rows, seqs, bands, mirna, str(tmp_path / "ref"), 64, 32)
    assert verified(str(tmp_path / "ref"), rows) and spark.read.parquet(str(tmp_path / "ref/mirna")).count() == 1


def test_configuration(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"genomeAssembly": "grch38", "fasta": {"url": "http://x/y.gz", "md5": "0" * 32}}))
    assert flat.read_config(str(p), ("fasta", "bands"))["fasta"].url.endswith("y.gz")
    p.write_text(json.dumps({"genomeAssembly": "GRCh38", "fasta": {"url": "u", "md5": ""}}))
    with pytest.raises(ValueError):
        flat.read_config(str(p), ("fasta",))
    assert flat.read_config(str(p), ("fasta",), may_lack_md5=True)


def test_contig_names(spark):
    got = [r.x for r in spark.createDataFrame([(c,) for c in ("chr1", "chrMT", "NC_1", "MT", "chrUn_1")], "c string").select(contig(F.col("c")).alias("x")).collect()]
    assert got == ["1", "MT", "NC_1", "MT", "Un_1"]
