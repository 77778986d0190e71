"""The record parser and the vcf source: pushdown, column pruning, headers of any length and splits."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from varloom.sources.bgzf import END, BgzfText, joined, packed
from varloom.sources.records import integer, number, read_vcf, schema_of
from varloom.sources.vcf import parse_lines, read_header

HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=248956422>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"]


def random_lines(seed, n):
    rng = random.Random(seed)
    pick = rng.choice
    value = lambda: pick((".", "", "1", "-3", "2.5", "x", "1,2", "1,x", "0/1", "1|2", "PASS", "DeNovo", "9" * 12, "1e3", "inf"))
    out = []
    for i in range(n):
        keys = rng.sample(["GT", "DP", "AD", "GQ", "VF", "CN", "MCN", "REPCN", "FT", "SR", "PR", "DN", "SQ", "DS", "GP", "BC", "ZZ"], 6)
        info = ";".join(pick(("END=9", "END=x", "SVTYPE=DEL", "SVLEN=-7", "CIPOS=-1,2", "CIEND=3", "AF=0.1,0.2", "MQ=3", "IMPRECISE", "REF=5", "RU=AC", "Q")) for _ in range(4))
        samples = [":".join(value() for _ in range(rng.randint(1, 7))) for _ in range(2)]
        alt = pick(("A", ".", "<NON_REF>", "C,<NON_REF>", "*", "G,T"))
        out.append("\t".join([f"chr{i % 5}", str(10 + i), pick((".", "rs1")), "AC", alt, pick((".", "5", "5x")), pick((".", "PASS", "a;b")), info, ":".join(keys), *samples]))
    return out


@pytest.mark.parametrize("kind", ["text", "gzip", "bgzf"])
def test_source_equals_parsed_lines(spark, tmp_path, kind):
    lines, p = random_lines(1, 700), tmp_path / "a.vcf.gz"
    data = ("\n".join([*HEAD, *lines]) + "\n").encode()
    p.write_bytes(data if kind == "text" else gzip.compress(data) if kind == "gzip" else b"".join(packed(data[i : i + 3000]) for i in range(0, len(data), 3000)) + END)
    want = parse_lines(spark.createDataFrame([(i + len(HEAD), x) for i, x in enumerate(lines)], "order long, value string"), 2).drop("value")
    found = read_vcf(spark, str(p), splitBytes=20_000)
    plain = lambda d: [str(r) for r in d.drop("order").orderBy("pos").collect()]
    assert found.columns == want.columns and plain(found) == plain(want)
    order = [r.pos for r in found.orderBy("order").select("pos").collect()]
    assert order == sorted(order) and len(order) == 700


def test_comparisons_are_pushed_and_columns_pruned(spark, tmp_path):
    lines = random_lines(2, 300)
    (tmp_path / "a.vcf").write_text("\n".join([*HEAD, *lines, "chr9\tbad"]) + "\n")
    rows = read_vcf(spark, str(tmp_path / "a.vcf"), "pos", "chrom").where("chrom in ('chr1', 'chr2') and pos > 50 and pos <= 200 and pos % 2 = 0")
    want = {p for i in range(300) if i % 5 in (1, 2) and 50 < (p := 10 + i) <= 200 and p % 2 == 0}
    # the bad line is of another chromosome, so it isn't parsed; the rest of a line isn't either
    assert {r.pos for r in rows.collect()} == want and rows.columns == ["chrom", "pos"]
    # Spark is left with the one test that the source can't make
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "% 2" in plan and "50" not in plan and "chr1" not in plan.replace("PushedFilters", "")
    with pytest.raises(Exception):  # noqa: B017
        read_vcf(spark, str(tmp_path / "a.vcf")).collect()
    loose = read_vcf(spark, str(tmp_path / "a.vcf"), "chrom", "error", strict="false").where("error is not null").collect()
    assert [r.chrom for r in loose] == ["chr9"]


def test_headers_have_no_length_limit(spark, tmp_path):
    more = [f"##contig=<ID=c{i},length={i + 1}>" for i in range(120_000)]
    data = ("\n".join([HEAD[0], *more, HEAD[2], "c5\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1\t0/0"]) + "\n").encode()
    (tmp_path / "a.gz").write_bytes(b"".join(packed(data[i : i + 60_000]) for i in range(0, len(data), 60_000)) + END)
    h = read_header(str(tmp_path / "a.gz"))
    assert len(h.contigs) == 120_000 and h.samples == ["S1", "S2"]
    assert read_vcf(spark, str(tmp_path / "a.gz")).count() == 1


def test_numbers():
    assert [integer(x) for x in ("5", "+5", "-5", "5 ", "", None, "2147483648", "٣")] == [5, 5, -5, None, None, None, None, None]
    assert integer("9" * 40, 64) is None and integer("-9223372036854775808", 64) == -(1 << 63) and integer("0" * 30 + "7", 64) == 7
    assert [number(x) for x in ("1.", ".5", "1e3", "inf", "-Infinity", "1d", " 1", None)] == [1.0, 0.5, 1000.0, float("inf"), float("-inf"), None, None, None]
    assert len(schema_of().fields) == 12


def _values(spark, path):
    return [r.value for r in spark.read.format("bgzf").load(path).orderBy("order").collect()]


def test_appends_keep_all_rows_and_overwrite_replaces(spark, tmp_path):
    spark.dataSource.register(BgzfText)
    out = str(tmp_path / "o")
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("r"), "id").alias("value"))
    rows(0, 500).repartition(3).write.format("bgzf").mode("append").save(out)
    rows(500, 900).coalesce(1).write.format("bgzf").mode("append").save(out)
    assert sorted(_values(spark, out)) == sorted(f"r{i}" for i in range(900))
    rows(0, 5).write.format("bgzf").mode("overwrite").save(out)
    assert sorted(_values(spark, out)) == [f"r{i}" for i in range(5)]
    rows(0, 0).write.format("bgzf").mode("append").save(out)
    assert len(_values(spark, out)) == 5


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(BgzfText)
    out = str(tmp_path / "o")
    spark.createDataFrame([("kept",)], "value string").write.format("bgzf").mode("append").save(out)
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("string").alias("value"))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("bgzf").mode("append").save(out)
    assert _values(spark, out) == ["kept"]
    # a task that was killed while it began may leave its folder until the next job
    (tmp_path / "o" / next(f.name for f in (tmp_path / "o").iterdir() if f.name.startswith("_void")).replace("_void", "_job")).mkdir(exist_ok=True)
    spark.createDataFrame([("more",)], "value string").write.format("bgzf").mode("append").save(out)
    assert sorted(_values(spark, out)) == ["kept", "more"]
    assert not [f for f in (tmp_path / "o").iterdir() if f.name.startswith(("_job", "_void"))]


def test_ordered_parts_join_to_one_file(spark, tmp_path):
    spark.dataSource.register(BgzfText)
    out, lines = str(tmp_path / "o"), [f"line {i} " + "é" * (i * 97 % 4000) for i in range(2500)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "order long, value string").repartition(7)
    d.repartitionByRange(4, "order").sortWithinPartitions("order").select("value").write.format("bgzf").mode("append").save(out)
    n = joined(spark, out, str(tmp_path / "one.gz"))
    data = (tmp_path / "one.gz").read_bytes()
    assert len(data) == n and data.endswith(END) and data.count(END) == 1
    assert gzip.decompress(data).decode().splitlines() == lines and _values(spark, str(tmp_path / "one.gz")) == lines == _values(spark, out)


def test_settled_positions_are_not_shuffled(spark):
    from varloom.plans.annotate import settled_alleles

    lines = ["1\t10\t.\tC\tG,T\t.\t.\tEND=10", "1\t20\t.\tACG\tATG,CCC\t.\t.\t.", "1\t30\t.\tA\tAT,C\t.\t.\t.", "1\t40\t.\tA\t<DUP>\t.\t.\tSVTYPE=DUP;END=90"]
    rows = parse_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "order long, value string"))
    made = rows.withColumn("variants", settled_alleles(rows))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.order: r.variants and [(v.vid, v.hgvsg) for v in r.variants] for r in made.collect()}
    assert got[0] == [("1-10-C-G", "NC_000001.1:g.10C>G"), ("1-10-C-T", "NC_000001.1:g.10C>T")]
    assert got[1] == [("1-21-C-T", "NC_000001.1:g.21C>T"), ("1-20-ACG-CCC", "NC_000001.1:g.20_22delinsCCC")] or got[1][0][0] == "1-21-C-T"
    assert got[2] is None and got[3] == [("1-41-90-A-<DUP>-DUP", None)]


def test_single_alleles_meet_the_genome_as_rows(spark):
    from varloom.operators.chunks import cut_sequences
    from varloom.plans.annotate import SHOWN, annotated
    from varloom.plans.positions import annotate_records
    from varloom.sources.vcf import informative

    seq = "ACGGTTAAAACCCATG" * 20
    alleles = ["G", "GT", "GTTT", "G,GT", "GT,GTTT,C", "<DUP>", "<DEL>,G", "*,GA", "N"]
    lines = [f"1\t{p}\t.\t{seq[p - 1 : p + n]}\t{a}\t.\t.\tEND={p + 9}" for p in (3, 4, 9, 40, 44) for n in (0, 2) for a in alleles] + ["1\t7\t.\tN\tA\t.\t.\t."]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "order long, value string")
    rows = informative(parse_lines(lines)).drop("value", "error").localCheckpoint()
    chunks = cut_sequences(spark.createDataFrame([("1", seq)], "chrom string, seq string"), 64, 32).localCheckpoint()
    aliases = spark.createDataFrame([("1", 0)], "name string, ref_index int")
    bands = spark.createDataFrame([("1", 1, 300, "p1")], "chrom string, begin long, end long, name string")
    run = lambda r: annotate_records(r, chunks, bands, aliases, 64)
    each = rows.select("order", "chrom", "pos", "ref", F.col("info.svtype").alias("svtype"), "end_pos", F.posexplode("alts").alias("k", "alt"))
    want = {(a.order, a.k): tuple(a[c] for c in SHOWN) for a in annotated(each, chunks, size=64).collect()}
    got = {(r.order, k): tuple(v[c] for c in SHOWN.values()) for r in run(rows).collect() for k, v in enumerate(r.variants)}
    assert got == want and len(got) > 100
    # nothing is grouped where no row has several alleles
    assert "Aggregate" not in run(rows.where(F.size("alts") == 1))._jdf.queryExecution().optimizedPlan().toString()
