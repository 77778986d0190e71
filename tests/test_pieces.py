"""FASTA in byte ranges, chunks from pieces, and numbers without a window over a group."""

import gzip
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.operators.cache import numbered
from varloom.operators.chunks import cut_pieces, cut_sequences
from varloom.sources.bgzf import packed
from varloom.sources.fasta import cut_lines, pieces
from varloom.sources.flat import read_fasta


def _records():
    rng = random.Random(5)
    sizes = [700, 0, 1, 64, 5000, 3, 1200]
    return [(f"NC_{i}.1", "".join(rng.choices("ACGTn", k=n))) for i, n in enumerate(sizes)]


def _text(width, end="\n"):
    out = ""
    for name, seq in _records():
        out += f">{name} some words{end}" + "".join(seq[i : i + width] + end for i in range(0, len(seq), width)) + end
    return out.encode()


@pytest.mark.parametrize("kind", ["plain", "windows", "one line", "gzip", "bgzf"])
@pytest.mark.parametrize("split", [37, 400, 1 << 20])
def test_pieces_make_the_sequences_of_whole_records(spark, tmp_path, kind, split):
    text = _text({"one line": 10_000}.get(kind, 60), "\r\n" if kind == "windows" else "\n")
    path = tmp_path / "x.fa"
    blocks = b"".join(packed(text[i : i + 500]) for i in range(0, len(text), 500))
    path.write_bytes({"gzip": gzip.compress(text), "bgzf": blocks}.get(kind, text))
    records, found = pieces(spark, str(path), split, 100)
    assert [(r.record, r.accession, r.length) for r in records.orderBy("record").collect()] == [(i + 1, n, len(s)) for i, (n, s) in enumerate(_records())]
    rows = found.join(records, "record").collect()
    assert max(len(r.piece) for r in rows) <= 100
    made = {n: "" for n, _ in _records()}
    for r in sorted(rows, key=lambda r: (r.record, r.place, len(r.piece))):
        assert r.place == len(made[r.accession])
        made[r.accession] += r.piece
    assert made == {n: s.upper() for n, s in _records()}


def test_chunks_of_pieces_are_those_of_whole_sequences(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(_text(70))
    whole = read_fasta(spark, str(tmp_path / "x.fa")).withColumnRenamed("accession", "chrom")
    records, found = pieces(spark, str(tmp_path / "x.fa"), 333, 90)
    lines = records.select("record", F.col("accession").alias("chrom"), "length")
    columns = ["chrom", "chunk", "lo", "seq", "length"]
    for size, margin in ((64, 16), (256, 640), (100, 0), (1 << 20, 1 << 13)):
        want, got = (sorted(map(tuple, d.select(columns).collect())) for d in (cut_sequences(whole, size, margin), cut_pieces(found, lines, size, margin, "record")))
        assert got == want


def test_bases_without_a_header_and_several_files(spark, tmp_path):
    with pytest.raises(ValueError, match="before the first header"):
        list(cut_lines(iter([b"", b"ACGT"]), 10, True))
    assert list(cut_lines(iter([b"AC", b">x", b">y", b"a c"]), 10, False)) == [(0, 0, None, "AC"), (1, 0, "x", ""), (2, 0, "y", "AC")]
    folder = tmp_path / "some"
    folder.mkdir()
    (folder / "a.fa").write_text(">a\nACGT\nAC\n")
    (folder / "b.fa").write_text("\n>b\nGG\n")
    records, found = pieces(spark, str(folder), 4)
    got = {}
    for r in sorted(found.join(records, "record").collect(), key=lambda r: (r.record, r.place, len(r.piece))):
        got[r.accession] = got.get(r.accession, "") + r.piece
    assert got == {"a": "ACGTAC", "b": "GG"}


def test_numbers_are_those_of_a_window_over_each_group(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") * 37 % 1009).alias("v"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 5).alias("w"), "id",
    )
    found = numbered(rows.repartition(5), "g", ["v", "w"], ["v", "w"])
    want = rows.select("g", "v", "w").distinct().withColumn("index", F.row_number().over(W.partitionBy("g").orderBy("v", "w")) - 1)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    seen = rows.groupBy("g", "v", "w").agg(F.min("id").alias("first"))
    want = seen.withColumn("index", F.row_number().over(W.partitionBy("g").orderBy("w", "first")) - 1).drop("first")
    found = numbered(rows.repartition(3), "g", ["v", "w"], ["w"], "id")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    assert numbered(rows.limit(0), "g", ["v"], ["v"]).count() == 0
