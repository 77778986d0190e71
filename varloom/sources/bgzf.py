"""Block-compressed text (BGZF) as a Spark data source: splittable reads and parallel writes.

    spark.dataSource.register(BgzfText)
    spark.read.format("bgzf").load(path)          # value, order
    df.write.format("bgzf").mode("append").save(path)

A file is a chain of small gzip members that state their own length, so a reader can begin
at any block. Each split inflates the blocks that start in its byte range; a line belongs
to the split in whose blocks it begins. Plain gzip is one split; uncompressed files are
split by bytes, a line belonging to the split in which it begins.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The empty block that ends a file (fixed value of the format).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT = 32 << 20
#: Bytes of text in a block that is written.
BLOCK = 0xFF00
#: Bytes fetched at once, and the greatest size of a block.
READ, LARGEST = 4 << 20, 1 << 16
#: Bytes of text that a task packs at once.
WRITTEN = 1 << 22
#: Names of parts and of their jobs' marks.
_PART, _MARK = re.compile(r"part-\d+-([0-9a-f]{32})\.bgz"), re.compile(r"_done-([0-9a-f]{32})")
_VOID = re.compile(r"_void-([0-9a-f]{32})")
#: Lines in a batch.
ROWS = 4096
#: A line's order is its split's number times this, plus its number in the split.
LINES = 1 << 40


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """Length of the block whose first bytes are given, if they are those of a block."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= 12 + extra and at + 6 <= len(head):
        if head[at : at + 2] == b"BC" and head[at + 2 : at + 4] == b"\x02\x00":
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + struct.unpack("<H", head[at + 2 : at + 4])[0]
    return None


def block_at(f, size: int, lo: int) -> int:
    """Start of the first block at or after ``lo``; blocks are at most 64 KB long and followed by another or the end."""
    window = f.read_at(min(size - lo, 3 << 16), lo)
    at = window.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = block_size(window[at : at + 1024])
        after = at + n if n else 0
        if n and (lo + after == size or block_size(window[after : after + 1024])):
            return lo + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def blocks(f, size: int, lo: int, upto: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(start, text) of the blocks from ``lo`` on; a broken chain is an error.

    Bytes are fetched READ at a time up to ``upto``, and by a block's greatest size beyond,
    where little more than one line's rest is wanted.
    """
    held, begin, at = b"", lo, lo
    while at < size:
        left = held[at - begin :]
        if len(left) < min(LARGEST, size - at):
            want = READ if upto is None or at < upto else LARGEST
            held = left + f.read_at(min(want, size - at - len(left)), at + len(left))
            begin, left = at, held
        n = block_size(left[:1024])
        if n is None or at + n > size:
            raise ValueError(f"no block at byte {at}")
        d = zlib.decompressobj(31)
        yield at, d.decompress(left[:n]) + d.flush()
        at += n


def lines(f, size: int, lo: int, hi: int) -> Iterator[bytes]:
    """Lines that begin in the blocks that start in [lo, hi): those after the first line end, on to the line open at hi.

    A split in which no line ends has none of its own: the line that runs through it began before.
    """
    rest, skip = b"", lo > 0
    for at, text in blocks(f, size, block_at(f, size, lo) if lo else 0, hi):
        if at >= hi and skip:
            return
        parts = (rest + text).split(b"\n")
        rest = parts.pop()
        # past the end only the line that is open counts
        if at >= hi:
            if parts:
                yield parts[0]
                return
            continue
        if parts and skip:
            parts, skip = parts[1:], False
        yield from parts
        if skip:
            rest = b""  # still inside a line that began before
    if rest and not skip:
        yield rest


def batches(rows: Iterator[bytes], number: int) -> Iterator:
    """Arrow batches (value, order) of some ROWS lines each."""
    import pyarrow as pa

    first = number * LINES
    while held := list(islice(rows, ROWS)):
        text = [r.rstrip(b"\r").decode("utf-8", "replace") for r in held]
        order = pa.array(range(first, first + len(held)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), order], names=["value", "order"])
        first += len(held)


@dataclass
class Split(InputPartition):
    path: str
    kind: str
    size: int
    lo: int
    hi: int
    number: int


class BgzfText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string, order long"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def splits_of(target: str, step: int) -> list[Split]:
    """Splits of a file, or of the files of a folder in order of their names.

    Files that begin with _ or . don't count, nor do parts whose job hasn't left its mark.
    """
    from pyarrow import fs

    system, path = _filesystem(target)
    info = system.get_file_info(path)
    infos = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
    done = {m[1] for i in infos if (m := _MARK.fullmatch(i.base_name))}
    found = []
    for i in sorted(infos, key=lambda i: i.path):
        part = _PART.fullmatch(i.base_name)
        if i.type != fs.FileType.File or i.base_name.startswith(("_", ".")) or part and part[1] not in done:
            continue
        if i.size < 2:
            raise ValueError(f"{i.path} has fewer than two bytes")
        with system.open_input_file(i.path) as f:
            head = f.read_at(min(1024, i.size), 0)
        kind = "bgzf" if block_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "text"
        width = i.size if kind == "gzip" else step
        for lo in range(0, i.size, width):
            found.append(Split(i.path if "://" not in target else f"{target.partition('://')[0]}://{i.path}", kind, i.size, lo, min(lo + width, i.size), len(found)))
    return found


def open_file(path: str):
    system, inner = _filesystem(path)
    return system.open_input_file(inner)


def lines_of(f, split: Split, lo: int, hi: int) -> Iterator[bytes]:
    """Lines of an open file of the split's kind that begin in [lo, hi)."""
    if split.kind == "bgzf":
        return lines(f, split.size, lo, hi)
    return _members(f) if split.kind == "gzip" else _plain(f, split.size, lo, hi)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("splitBytes", SPLIT))

    def partitions(self):
        return splits_of(self.path, self.step)

    def read(self, split):
        if split is None:  # no files
            return
        with open_file(split.path) as f:
            yield from batches(iter(lines_of(f, split, split.lo, split.hi)), split.number)


def _members(f) -> Iterator[bytes]:
    """Lines of a gzip file of any number of members."""
    rest, d = b"", zlib.decompressobj(31)
    while chunk := f.read(1 << 20):
        while chunk:
            text, chunk = d.decompress(chunk), d.unused_data
            if d.eof:  # the next member follows
                d = zlib.decompressobj(31)
            *parts, rest = (rest + text).split(b"\n")
            yield from parts
    if rest:
        yield rest


def _plain(f, size: int, lo: int, hi: int) -> Iterator[bytes]:
    """Lines of an uncompressed file that begin in [lo, hi)."""
    at = lo
    if lo:  # a line that begins at lo follows a line end
        at = lo - 1
        while at < size:
            chunk = f.read_at(min(1 << 16, size - at), at)
            end = chunk.find(b"\n")
            at += end + 1 if end >= 0 else len(chunk)
            if end >= 0:
                break
    rest = b""
    begin = at
    while begin < hi and at < size:
        chunk = f.read_at(min(1 << 20, size - at), at)
        at += len(chunk)
        *parts, rest = (rest + chunk).split(b"\n")
        for line in parts:
            if begin >= hi:
                return
            yield line
            begin += len(line) + 1
    if rest and begin < hi:
        yield rest


def packed(text: bytes) -> bytes:
    """One block of at most BLOCK bytes of text."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(text) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


@dataclass
class _Part(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    """Parts of a job, in the order of its partitions, that count once all are there.

    Each task attempt writes a file of its own into a folder of the job. ``commit`` moves
    those of the tasks that count to names with the job's id, so that no job meets another's,
    and then leaves the job's mark; readers pass over parts without one. So an append adds
    all its rows or none. Tasks without rows leave no part. In overwrite mode the parts of
    other jobs go after the mark is there.

    Tasks may still run when their job is ended: ``abort`` leaves a mark that the job is
    void, and a task that sees it drops what it has begun. What a task that was killed in
    between has left goes with the next job that is committed.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, batches):
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        number = TaskContext.get().partitionId()
        part = _Part(f"{path}/_job-{self.job}/{number:06d}-{uuid.uuid4().hex}", f"{path}/part-{number:06d}-{self.job}.bgz")
        out, held = None, []
        size = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append((text or "").encode())
                size += len(held[-1]) + 1
                if size >= WRITTEN:
                    out = out or self._opened(system, path, part)
                    held = [self._packed(out, held)]
                    size = len(held[0])
        if held or out:
            out = out or self._opened(system, path, part)
            self._packed(out, held, last=True)
            out.write(END)
            out.close()
        return part if out else _Part("", "")

    def _opened(self, system, path: str, part: _Part):
        self._refuse_void(system, path)
        system.create_dir(f"{path}/_job-{self.job}", recursive=True)
        out = system.open_output_stream(part.temporary)
        try:
            self._refuse_void(system, path)
        except ValueError:
            out.close()
            self._tidy(system, path, self.job)
            raise
        return out

    def _refuse_void(self, system, path: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{path}/_void-{self.job}").type != fs.FileType.NotFound:
            raise ValueError(f"job {self.job} was ended")

    @staticmethod
    def _packed(out, held: list[bytes], last: bool = False) -> bytes:
        """Writes full blocks of the lines; what is left begins the next one and stands as a line without its end."""
        text = b"\n".join(held) + (b"\n" if last and held else b"")
        upto = len(text) if last else len(text) // BLOCK * BLOCK
        for at in range(0, upto, BLOCK):
            out.write(packed(text[at : min(at + BLOCK, upto)]))
        return text[upto:]

    def commit(self, messages):
        from pyarrow import fs

        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        for m in messages:
            if m is not None and m.final:
                system.move(m.temporary, m.final)
        with system.open_output_stream(f"{path}/_done-{self.job}") as out:
            out.write(b"")
        if self.overwrite:
            self._drop(system, path, lambda job: job != self.job)
        self._tidy(system, path, self.job)
        for i in system.get_file_info(fs.FileSelector(path)):
            if m := _VOID.fullmatch(i.base_name):
                self._tidy(system, path, m[1])
                system.delete_file(i.path)

    def abort(self, messages):
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_void-{self.job}") as out:
            out.write(b"")
        self._drop(system, path, lambda job: job == self.job)
        self._tidy(system, path, self.job)

    @staticmethod
    def _tidy(system, path, job):
        from pyarrow import fs

        folder = f"{path}/_job-{job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    @staticmethod
    def _drop(system, path, gone):
        """Deletes marks, and then parts, of some jobs."""
        from pyarrow import fs

        names = [i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        for pattern in (_MARK, _PART):
            for name in names:
                if (m := pattern.fullmatch(name)) and gone(m[1]):
                    system.delete_file(f"{path}/{name}")


def joined(spark, folder: str, target: str) -> int:
    """One file of all parts of a folder in their order, with one end mark; gives its size in bytes.

    Each part is copied by a task of its own to the place where it belongs, so no task reads
    the whole. For folders of a file system that all executors share and that writes at a
    given place; in other stores the parts, one after the other, are such a file as well.
    """
    import os

    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("parts can be joined on a shared file system only")
    parts = sorted({(s.path, s.size) for s in splits_of(folder, 1 << 62)})
    places, at = [], 0
    for path, size in parts:
        places.append((path, at, size - len(END)))
        at += size - len(END)
    target = target.removeprefix("file://")
    temporary = f"{target}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        out.truncate(at)
        out.seek(at)
        out.write(END)

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, place, size in zip(b["path"], b["place"], b["size"], strict=True):
                with open_file(path) as f, open(temporary, "r+b") as out:
                    out.seek(place)
                    for lo in range(0, size, READ):
                        out.write(f.read_at(min(READ, size - lo), lo))
            yield pd.DataFrame({"n": [len(b)]})

    if places:
        rows = spark.createDataFrame(places, "path string, place long, size long").repartition(min(len(places), 1000), "path")
        rows.mapInPandas(run, "n long").agg({"n": "sum"}).collect()
    os.replace(temporary, target)
    return at + len(END)
