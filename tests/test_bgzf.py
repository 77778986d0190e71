import gzip
import random

import pytest

from varloom.sources.bgzf import END, BgzfText, packed


@pytest.fixture(scope="module")
def text(spark):
    spark.dataSource.register(BgzfText)
    return [f"line {i} " + "x" * (i * 37 % 900) for i in range(3000)]


def blocks(text, size):
    data = ("\n".join(text) + "\n").encode()
    return b"".join(packed(data[i : i + size]) for i in range(0, len(data), size)) + END


@pytest.mark.parametrize("split", [5_000, 40_000, 1 << 25])
@pytest.mark.parametrize("size", [700, 0xFF00])
def test_every_line_is_read_once_whatever_the_splits(spark, text, tmp_path, split, size):
    p = tmp_path / "a.vcf.gz"
    p.write_bytes(blocks(text, size))
    rows = spark.read.format("bgzf").option("splitBytes", split).load(str(p)).orderBy("order").collect()
    assert [r.value for r in rows] == text


@pytest.mark.parametrize("seed", range(2))
def test_lines_longer_than_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    some = ["a", "".join(rng.choices("ACGT", k=600_000)), "b", "c", "".join(rng.choices("ACGT", k=90_000)), "", "d"]
    some += ["".join(rng.choices("ACGT", k=rng.choice((0, 5, 70_000)))) for _ in range(12)]
    (tmp_path / "a.gz").write_bytes(blocks(some, rng.choice((900, 20_000, 0xFF00))))
    (tmp_path / "b.txt").write_text("\n".join(some) + "\n")
    for name in ("a.gz", "b.txt"):
        for split in (rng.randint(30_000, 60_000), 200_000):
            rows = spark.read.format("bgzf").option("splitBytes", split).load(str(tmp_path / name)).orderBy("order").collect()
            assert [r.value for r in rows] == some, (name, split)


def test_plain_text_in_splits(spark, text, tmp_path):
    (tmp_path / "p.txt").write_text("\n".join(text))
    for split in (60_001, 400_000):
        rows = spark.read.format("bgzf").option("splitBytes", split).load(str(tmp_path / "p.txt")).orderBy("order").collect()
        assert [r.value for r in rows] == text


def test_plain_gzip_with_members_and_plain_text(spark, text, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress("\n".join(text[:10]).encode() + b"\n") + gzip.compress("\n".join(text[10:20]).encode()))
    (tmp_path / "b.txt").write_text("\n".join(text[20:30]) + "\n")
    rows = spark.read.format("bgzf").load(str(tmp_path)).orderBy("order").collect()
    assert [r.value for r in rows] == text[:30]


def test_written_blocks_are_gzip_and_read_back(spark, text, tmp_path):
    out = str(tmp_path / "out")
    spark.createDataFrame([(t,) for t in text], "value string").repartition(3).write.format("bgzf").mode("append").save(out)
    files = sorted((tmp_path / "out").glob("part-*"))  # beside the mark of the job
    assert len(files) == 3 and all(f.read_bytes().endswith(END) for f in files)
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files).decode().splitlines()
    assert sorted(whole) == sorted(text)
    assert sorted(r.value for r in spark.read.format("bgzf").load(out).collect()) == sorted(text)


def test_broken_chain_is_an_error(spark, text, tmp_path):
    data = blocks(text, 700)
    (tmp_path / "c.gz").write_bytes(data[:5000] + b"junk" + data[5004:])
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("bgzf").load(str(tmp_path / "c.gz")).count()
