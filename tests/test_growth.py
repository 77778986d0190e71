"""Work that grows with the rows, not with their pairs or with one task's share."""

import random

from pyspark.sql import functions as F

from varloom.operators.cache import overlap_sums, overlaps


def test_sums_over_overlaps_need_no_pairs(spark):
    r = random.Random(5)
    place = lambda: r.choice((1, 1 << 20, (1 << 20) + 1, 3 << 20, r.randrange(1, 5 << 20)))
    width = lambda: r.choice((0, 1, 1 << 20, r.randrange(1 << 21)))
    some = lambda n: [(i % (n - 3), i % 3, p := place(), p + width()) for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "id long, chrom int, start long, end long")
    a, b = make([*some(120), (999, 7, 5, 9)]), make([*some(90), (50, 2, 4, 4)])
    want = {tuple(x) for x in overlaps(a, b, "chrom").groupBy("id").agg(F.count(F.lit(1)), F.sum("b_id")).collect()}
    found = overlap_sums(a, b, "chrom", "id", {"ids": "id"})
    assert {tuple(x) for x in found.collect()} == want and len(want) > 50
    assert overlap_sums(a, b.limit(0), "chrom", "id", {"ids": "id"}).count() == 0
    # all overlap all: the plan makes a few lines for each interval and no join
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_bases_over_chunks_are_gathered_once_a_chunk(spark):
    from varloom.operators import chunks as C

    r = random.Random(8)
    seq = "".join(r.choices("ACGT", k=3000))
    c = C.cut_sequences(spark.createDataFrame([("1", seq)], "chrom string, seq string"), 64, 16).localCheckpoint()
    rows = [(i, "1", p := r.randrange(1, 2900), seq[p - 1 : p - 1 + n], n, min(n, 2980 - p)) for i in range(500) for n in (r.randrange(1, 40),)]
    d = spark.createDataFrame(rows, "i int, chrom string, position long, ref string, n int, _left long").withColumn("down", F.lit(""))
    found = C.widened(d, c, 64)
    for x in found.collect():
        at = x.position - 1 + len(x.ref)
        assert x.down == seq[at : at + x._left]
    # rows with the same chunk make one line, not one for each row and chunk
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_positions_are_numbered_without_gathering_lines(spark, monkeypatch):
    from varloom import queries

    seen, run = [], queries.annotate_positions
    monkeypatch.setattr(queries, "annotate_positions", lambda lines, *a: seen.append(lines) or run(lines, *a))
    queries.position_json(spark, "/root/testdata/sf0.001")
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_stream_files_are_of_bounded_length(spark, monkeypatch):
    from varloom import queries

    want = sorted(tuple(r) for r in queries.streamed_counts(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(queries, "LINES_A_FILE", 500)
    seen, run = [], queries.annotate_stream
    monkeypatch.setattr(queries, "annotate_stream", lambda s, source, *a, **k: seen.append(source) or run(s, source, *a, **k))
    assert sorted(tuple(r) for r in queries.streamed_counts(spark, "/root/testdata/sf0.001").collect()) == want
    lines = spark.read.text(seen[0]).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert lines <= 500


def test_attributes_of_plain_lines_are_read_without_pairs(spark):
    from varloom.sources import gff3

    r = random.Random(11)
    parts = ["ID=a", "ID=b ", " Parent=p", "Name=NM_1", "gene=S", "tag=MANE Select", "tag= MANE Select", "tag=RefSeq Select ", "Dbxref=GeneID:7,HGNC:HGNC:9",
             "Target=t 4 9 +", "Gap=M3 D2", "Note=a%2Cb", "note=c", "transcript_id=", "experiment=x [ECO:0000269] [PMID:123456, PMID:7]", "gbkey=x", "", "  "]
    odd = ["ID", "tag", "novel=1", "=x", "ID =x", "xID=4", "Gap"]
    texts = [";".join(r.choices(parts + odd * (i % 4 == 0), k=r.randrange(1, 9))) for i in range(600)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", gff3.joined_parts(F.col("t"))).withColumn("a", gff3.pairs(F.col("t")))
    d = d.withColumn("plain", gff3.is_plain(F.col("p"))).localCheckpoint()
    none = F.lit(None).cast("array<struct<k:string,v:string>>")
    both = d.select("t", "plain", gff3.refseq_attributes(F.col("a"), F.col("p")).alias("x"), gff3.refseq_attributes(none, F.col("p")).alias("y")).collect()
    assert all(b.x == b.y for b in both if b.plain) and sum(b.plain for b in both) > 200
    # what isn't plain is what has an unknown key or both kinds of notes
    assert all(b.plain == (b.x.unknown_key is None) for b in both if not ("Note=" in b.t and "note=" in b.t))


def test_parts_of_features_read_only_their_columns(spark):
    from varloom import queries
    from varloom.sources import gff3

    genes = gff3.hierarchy(queries.gff3_features(spark, "/root/testdata/sf0.001"), "refseq")["genes"]
    plan = genes.groupBy("ref_index").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ref_index:int,biotype:string,category:string>" in plan


def test_a_stream_keeps_only_compressed_lines_and_its_state(spark, monkeypatch):
    """Tables of a micro-batch go with it, lines that come and go are compressed, and batches are of a bounded number of files."""
    from pathlib import Path

    from varloom import queries
    from varloom.operators.shared import shared_folder

    monkeypatch.setattr(queries, "LINES_A_FILE", 900)
    monkeypatch.setattr(queries, "FILES_A_BATCH", 2)
    seen, run = [], queries.annotate_stream
    monkeypatch.setattr(queries, "annotate_stream", lambda s, source, target, *a, **k: seen.append((source, target)) or run(s, source, target, *a, **k))
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("varloom-*"))
    found = queries.streamed_counts(spark, "/root/testdata/sf0.001")
    (source, target), left = seen[0], set(folder.glob("varloom-*")) - before
    assert [p.name.rsplit("-", 1)[0] for p in left] == ["varloom-stream"]
    source, target = (Path(x.removeprefix("file://")) for x in (source, target))
    files = [p for f in (source, *target.glob("batch=*")) for p in f.glob("part-*")]
    assert len(list(target.glob("batch=*"))) > 2 and files and all(p.name.endswith(".gz") for p in files)
    counts = found.agg(F.sum("positions")).first()[0]
    assert spark.read.text(f"{target}/*").count() == counts > 0
