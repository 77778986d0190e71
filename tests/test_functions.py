"""Allele, naming, codon and text functions against plain Python on worked and random cases."""

import random

import pytest
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import codons, ids, text
from varloom.operators.chunks import cut_sequences
from varloom.operators.evaluate import best_offset, judge, protein_of, slippage
from varloom.plans.annotate import annotated


def plain_trim(p, r, a):
    if r == a or (len(r) == 1 and len(a) == 1):
        return p, r, a
    while r and a and r[0] == a[0]:
        p, r, a = p + 1, r[1:], a[1:]
    while r and a and r[-1] == a[-1]:
        r, a = r[:-1], a[:-1]
    return p, r, a


def test_trim_in_one_expression_and_in_steps(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("AC") for _ in range(rng.randint(1, 7)))
    rows = [(i, rng.randint(1, 99), word(), word()) for i in range(600)] + [(600, 5, "A" * 60, "A" * 61), (601, 5, "ACGT", "ACGT")]
    d = spark.createDataFrame(rows, "i int, pos long, ref string, alt string")
    one = {r.i: tuple(r.t) for r in d.select("i", A.trim(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).collect()}
    steps = {r.i: (r.position, r.ref, r.alt) for r in A.trimmed(d).collect()}
    want = {i: plain_trim(p, r, a) for i, p, r, a in rows}
    assert one == want and steps == want


def test_common_prefix(spark):
    rows = [("", ""), ("a", ""), ("abc", "abd"), ("abc", "abc"), ("ab", "abc"), ("x" * 700, "x" * 699 + "y"), ("[", "<"), ("a.b", "a.c")]
    d = spark.createDataFrame(rows, "x string, y string")
    got = [r.n for r in d.select(text.common_prefix(F.col("x"), F.col("y")).alias("n")).collect()]
    assert got == [0, 0, 2, 3, 2, 699, 0, 2]


@pytest.mark.parametrize(
    "alt, svtype, category, kind",
    [
        ("A[2:5[", None, "sv", "translocation"),
        ("<DEL>", "DEL", "sv", "deletion"),
        ("<DUP:TANDEM>", "DUP", "sv", "tandem_duplication"),
        ("<DUP>", "DUP", "sv", "duplication"),
        ("<DEL>", "CNV", "cnv", "copy_number_loss"),
        ("<CN3>", "LOH", "cnv", "copy_number_variation"),
        ("<INS:ME>", "ALU", "sv", "mobile_element_insertion"),
        ("<STR12>", None, "repeat_expansion", "short_tandem_repeat_variation"),
        ("<X>", None, "sv", "unknown"),
        ("AC", None, "small", "insertion"),
    ],
)
def test_categories(spark, alt, svtype, category, kind):
    d = spark.createDataFrame([(alt, svtype)], "alt string, svtype string")
    row = d.select(
        A.category(F.col("alt"), F.col("svtype")).alias("c"), A.variant_type(F.col("alt"), F.col("svtype"), F.lit(0), F.lit(2)).alias("t"), A.repeat_count(F.col("alt")).alias("n")
    ).first()
    assert (row.c, row.t) == (category, kind) and row.n == (12 if alt == "<STR12>" else None)


def plain_annotate(seq, p, r, a):
    """Normalized place and alleles, and genomic HGVS, by walking single bases."""
    p, r, a = plain_trim(p, r, a)
    if (r == "") != (a == ""):
        x = r or a
        while p > 1 and seq[p - 2] == x[-1]:
            x, p = x[-1] + x[:-1], p - 1
        r, a = (x, "") if r else ("", x)
        at, y, n = p, x, 0
        nxt = p - 1 + len(r)
        while nxt + n < len(seq) and n < max(500, len(x)) and seq[nxt + n] == y[0]:
            y, n, at = y[1:] + y[0], n + 1, at + 1
        if r:
            h = f"{at}del" if len(r) == 1 else f"{at}_{at + len(r) - 1}del"
        elif at - 1 - len(y) >= 0 and seq[at - 1 - len(y) : at - 1] == y:
            h = f"{at - 1}dup" if len(y) == 1 else f"{at - len(y)}_{at - 1}dup"
        else:
            h = f"{at - 1}_{at}ins{y}"
    elif r == a:
        h = f"{p}="
    elif len(r) == len(a) == 1:
        h = f"{p}{r}>{a}"
    elif len(r) == len(a) and r[::-1].translate(str.maketrans("ACGT", "TGCA")) == a:
        h = f"{p}_{p + len(r) - 1}inv"
    else:
        h = (f"{p}" if len(r) == 1 else f"{p}_{p + len(r) - 1}") + f"delins{a}"
    return p, r or "-", a or "-", f"NC:g.{h}"


def test_normalized_names_over_chunk_edges(spark):
    """Repeats longer than a chunk and its margin move across several chunks."""
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(60)) + "A" * 400 + "".join(rng.choice("AAC") for _ in range(300)) + "CA" * 200 + "G"
    rows = []
    for i in range(500):
        p = rng.randint(2, len(seq) - 12)
        r = seq[p - 1 : p - 1 + rng.randint(1, 5)]
        a = rng.choice([r[0], r[0] + seq[p : p + rng.randint(1, 4)], "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 4))), r + "T"])
        rows.append((i, "1", p, r, a, None, p + len(r) - 1))
    v = spark.createDataFrame(rows, "i int, chrom string, pos long, ref string, alt string, svtype string, end_pos long")
    chunks = cut_sequences(spark.createDataFrame([("1", seq)], "chrom string, seq string"), 64, 520)
    got = {r.i: (r.begin, r.ref_allele, r.alt_allele, r.hgvsg) for r in annotated(v, chunks, F.lit("NC"), size=64).collect()}
    for i, _, p, r, a, _, _ in rows:
        assert got[i] == plain_annotate(seq, p, r, a), (p, r, a)


def long_alleles(rng):
    """A chromosome with long repeats, and alleles of up to 20,000 bases around the edges of 4,096-base chunks."""
    unit = "".join(rng.choice("ACGT") for _ in range(20_000))
    seq = "".join(rng.choice("ACGT") for _ in range(9_000)) + unit + unit + unit[:7_000] + "".join(rng.choice("ACGT") for _ in range(25_000))
    rows = []
    for i in range(24):
        p = rng.choice([9_001, 12_280, 16_384, 29_000, 29_001, 40_960, 61_440, 70_000]) + rng.randint(-3, 3)
        n = rng.choice([600, 5_000, 19_999, 20_000])
        if i % 3 == 0:
            r, a = seq[p - 1 : p + n], seq[p - 1]
        elif i % 3 == 1:
            r, a = seq[p - 1], seq[p - 1] + seq[p : p + n]
        else:
            r, a = seq[p - 1], seq[p - 1] + "".join(rng.choice("ACGT") for _ in range(n))
        rows.append((i, "1", p, r, a, None, p + len(r) - 1))
    return seq, rows


def test_alleles_longer_than_chunks_and_margins(spark):
    """Names of long alleles near chunk edges are those of a run with the chromosome as one chunk, and of single steps."""
    seq, rows = long_alleles(random.Random(4))
    v = spark.createDataFrame(rows, "i int, chrom string, pos long, ref string, alt string, svtype string, end_pos long")
    one = spark.createDataFrame([("1", seq)], "chrom string, seq string")
    shown = lambda size, margin: {
        r.i: (r.begin, r.ref_allele, r.alt_allele, r.hgvsg, r.vid) for r in annotated(v, cut_sequences(one, size, margin), F.lit("NC"), size=size).collect()
    }
    cut, whole = shown(4_096, 16), shown(1 << 20, 16)
    assert cut == whole and len(cut) == len(rows)
    for i, _, p, r, a, _, _ in rows:
        assert cut[i][:4] == plain_annotate(seq, p, r, a), (p, len(r), len(a))
    assert {"dup", "del", "ins"} <= {k for k in ("dup", "del", "ins") for x in cut.values() if k in x[3]}


def test_identifier_anchors(spark):
    """The base at the place pads an empty allele by default; "anchored" takes the one before."""
    seq = "C" * 98 + "GATCC" + "G" * 50
    v = spark.createDataFrame([("1", 100, "A", "ACGT", None, 100), ("1", 100, "N", "<DEL>", "DEL", 120)], "chrom string, pos long, ref string, alt string, svtype string, end_pos long")
    chunks = cut_sequences(spark.createDataFrame([("1", seq)], "chrom string, seq string"))
    vids = lambda **k: [r.vid for r in annotated(v, chunks, **k).orderBy("end").collect()]
    assert vids() == ["1-100-T-TCGT", "1-101-120-A-<DEL>-DEL"]
    assert vids(vid_anchor="anchored")[0] == "1-100-A-ACGT"


def test_codons(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGTUNacgt") for _ in range(rng.randint(0, 14))), rng.random() < 0.5) for _ in range(200)]
    d = spark.createDataFrame(rows, "s string, mt boolean").select("s", "mt", codons.translate(F.col("s"), F.col("mt")).alias("p"))
    assert all(r.p == protein_of(r.s.encode(), codons.mitochondrial() if r.mt else codons.STANDARD).decode() for r in d.collect())
    assert protein_of(b"ATGTGATAAA", codons.STANDARD) == b"M**X" and protein_of(b"ATATGA", codons.mitochondrial()) == b"MW"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.unescape(F.lit("a%252Cb%3D"))) == "a,b="
    assert one(ids.fingerprint_id(F.lit("GRCh38.p14"))) == 478983680
    assert one(ids.contig(F.lit("chrM"))) == "MT" and one(ids.contig(F.lit("M"))) == "M"
    assert one(ids.ensembl_number(F.lit("ENSG00000141510"))) == 141510 and one(ids.ensembl_number(F.lit("ENSG1.2"))) is None
    assert [one(text.strict_int(F.lit(x))) for x in ("5", " 5", "5.0", "+7", "99999999999")] == [5, None, None, 7, None]
    assert [one(text.strict_double(F.lit(x))) for x in ("1.5", "1d", ".5", "1e3", "1.")] == [1.5, None, 0.5, 1000.0, 1.0]
    assert one(ids.bins(F.lit(1), F.lit((1 << 20) + 1))) == [0, 1]
    assert one(A.is_reverse_complement(F.lit("AACG"), F.lit("CGTT"))) and not one(A.is_reverse_complement(F.lit("AN"), F.lit("NT")))


def test_alignment_and_levels():
    assert best_offset(b"AAMKVLAA", b"MKVL") == 2 and best_offset(b"MKMK", b"MK") == 0 and best_offset(b"MK", b"MKV") is None
    cds = "ATGAAAGTTCTGGCTGCATGGCGTGATTTCCATGAAAAACAGTCTACCTGGGTTAACTGA"
    want = protein_of(cds.encode(), codons.STANDARD).decode()
    run = lambda cdna, s, e, p, seleno=False: judge(cdna, s, e, p, False, seleno)["outcome"]
    assert run("GG" + cds, 3, 2 + len(cds), want) == "perfect"
    assert run(cds, 1, len(cds), want[:5] + "?" + want[6:]) == "edits"
    assert run(cds, 1, len(cds), "MM" + want) == "contained"
    assert run(cds, 1, len(cds) + 5, want) == "unresolvable"
    found = judge("C" + cds, 3, 1 + len(cds), want, False, False)
    assert found["wrong_frame"] and found["padding"] == 1
    assert run(cds, 1, len(cds), "W" * len(want)) == "unresolvable"
    edits = list(want)
    for i in (2, 5, 8, 11):
        edits[i] = "?"
    assert run(cds, 1, len(cds), "".join(edits), True) == "edits"


def test_slip_of_one_base():
    rng = random.Random(6)
    code = "".join(rng.choice("ACG") for _ in range(300))
    first, second = code[:150], code[151:]
    want = protein_of((first + second).encode()[: 297], codons.STANDARD)
    got = protein_of(code.encode()[:297], codons.STANDARD)
    place = slippage(code.encode()[:298], want, got)
    assert place is None or place[0] >= 150


def test_coding_regions_are_judged_together_as_each_alone():
    import random

    from varloom.functions.codons import STANDARD
    from varloom.operators.evaluate import best_offsets, judged

    r = random.Random(3)
    pick = lambda n, letters: "".join(r.choices(letters, k=n))
    rows = []
    for k in range(400):
        cdna = pick(r.choice((0, 4, 120, 121, 300)), "ACGTN")
        start, end = r.choice((0, 1, 2, 10)), r.choice((len(cdna), len(cdna) - 3, len(cdna) + 1))
        p = protein_of(cdna[max(start - 1, 0) : end].encode(), STANDARD).decode().rstrip("X")
        other = protein_of(cdna[max(start - 2, 0) : end].encode(), STANDARD).decode()
        p = r.choice((p, p[3:40], p[:5] + "?" + p[6:], p[::-1], other[1:30], "", pick(70, STANDARD)))
        rows.append((cdna, start, end, p, k % 7 == 0, k % 5 == 0))
    one = [judge(*x) for x in rows]
    assert judged(rows) == one and judged([]) == []
    assert {"perfect", "contained", "edits", "unresolvable"} <= {x["outcome"] for x in one}
    pairs = [(pick(90, "AC").encode(), pick(r.choice((0, 30, 90, 91)), "A" * 12 + "C").encode()) for _ in range(200)]
    pairs += [(long, long[7:67]) for long, _ in pairs]
    assert best_offsets(pairs) == [best_offset(*x) for x in pairs]


def test_translation_of_odd_texts(spark):
    rows = [(1, None, False), (2, "", True), (3, "ATAa", True), (4, "auaTG", None), (5, "éAAATG", False), (6, "ATéATGc", True)]
    d = spark.createDataFrame(rows, "k int, s string, mt boolean").coalesce(1)
    got = {x.k: x.p for x in d.select("k", codons.translate(F.col("s"), F.col("mt")).alias("p")).collect()}
    assert got == {1: None, 2: "", 3: "MX", 4: "IX", 5: "XM", 6: "XMX"}
