"""State of streams over micro-batches and restarts, and alignment by convolution."""

import random

import numpy as np
import pytest

from varloom.operators.chunks import cut_sequences
from varloom.operators.evaluate import PLAIN, agreeing, best_offset, matches, slippage
from varloom.streaming.annotate import annotate_stream, stream_counts


def _file(folder, name, chroms):
    rows = [f"{c}\t{10 + i}\t.\tC\tG,A\t50\tPASS\t." for i, c in enumerate(chroms)]
    (folder / name).write_text("\n".join(["##x", *rows]) + "\n")


def test_counts_and_chromosomes_are_kept_over_batches_and_restarts(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    chunks = cut_sequences(spark.createDataFrame([(c, "ACGTTGCA" * 40) for c in "123"], "chrom string, seq string"))
    bands = spark.createDataFrame([("1", 1, 300, "p1")], "chrom string, begin long, end long, name string")
    names = spark.createDataFrame([("chr1", 0), ("chr2", 1), ("chr3", 2)], "name string, ref_index int")

    def run():
        annotate_stream(spark, str(source), target, str(tmp_path / "progress"), chunks, bands, names, one_file=True).awaitTermination(120)
        return sorted(map(tuple, stream_counts(spark, target).collect()))

    _file(source, "a.txt", ["chr1", "chr1", "chr2"])
    assert run() == [("chr1", 2, 4, 0), ("chr2", 1, 2, 0)]
    # the chromosome that is open goes on, one that nobody knows is counted as skipped
    _file(source, "b.txt", ["chr2", "chrU", "chr3"])
    want = [("chr1", 2, 4, 0), ("chr2", 2, 4, 0), ("chr3", 1, 2, 0), ("chrU", 0, 0, 1)]
    assert run() == want
    written = spark.read.text(f"{target}/*").count()
    assert written == 5
    _file(source, "c.txt", ["chr3", "chr1"])
    for _ in range(2):  # the batch is tried again and ends in the same way
        with pytest.raises(Exception, match="chromosomes that come again"):
            run()
    assert sorted(map(tuple, stream_counts(spark, target).collect())) == want and spark.read.text(f"{target}/*").count() == written


def test_matches_by_convolution_are_those_of_every_place():
    rng = random.Random(3)
    for n, m in ((4000, 900), (1200, 1200), (3000, 300)):
        long = np.frombuffer("".join(rng.choices("ACDEFGHIKLMNPQRSTVWY*", k=n)).encode(), np.uint8)
        at = rng.randrange(n - m + 1)
        short = long[at : at + m].copy()
        short[::50] = ord("?")
        plain = np.array([(long[k : k + m] == short).sum() for k in range(n - m + 1)])
        assert (matches(long, short) == plain).all()
        assert best_offset(long.tobytes(), short.tobytes()) == at
    assert (4000 - 900 + 1) * 900 > PLAIN
    other = np.full(900, ord("?"), np.uint8)
    assert not matches(np.full(4000, ord("A"), np.uint8), other).any()
    # of equal places the first
    assert best_offset(b"M" * 5000, b"M" * 1000) == 0 and best_offset(b"M", b"") is None and best_offset(b"M", b"MM") is None


def test_common_beginnings_and_slips():
    assert [agreeing(*x) for x in ((b"", b"A"), (b"AB", b"AC"), (b"AB", b"ABC"), (b"X", b"Y"))] == [0, 1, 2, 0]
    rng = random.Random(8)
    codons = ["GCT", "GAA", "AAA", "CTG", "TCA", "GGT", "CCA", "ACC", "GTT", "CAC"]
    from varloom.functions.codons import STANDARD
    from varloom.operators.evaluate import protein_of

    head, rest = "".join(rng.choices(codons, k=20)), "".join(rng.choices(codons, k=30))
    cds = ("ATG" + head + "C" + rest).encode()
    want = protein_of(("ATG" + head + rest).encode(), STANDARD)
    place, length = slippage(cds, want, protein_of(cds, STANDARD))
    assert length <= 2 and abs(place - 64) <= 6
