"""VCF records as Arrow columns: one parser for lines that Spark holds and for files, and a data source over the latter.

    register(spark)
    spark.read.format("vcf").load(path)                                        # all columns
    spark.read.format("vcf").schema(schema_of("chrom", "pos")).load(path)      # only these are parsed

Columns that aren't wanted are not parsed, which matters most for samples and INFO.
Comparisons of ``chrom`` and ``pos`` are pushed into the source and looked at before the
rest of a line is. A file's header is read from its leading blocks when the scan is planned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from varloom.sources.bgzf import LINES, SPLIT, Split, lines_of, open_file, splits_of

#: Alternative alleles that say nothing (fixed values).
UNINFORMATIVE = frozenset(("*", "<*>", "<M>", "<NON_REF>"))
#: INFO keys that are read, and the columns that they become (fixed values); others are passed over.
INFO_FIELDS = {
    "END": ("end", "long"), "SVTYPE": ("svtype", "text"), "SVLEN": ("svlen", "length"), "CIPOS": ("cipos", "pair"), "CIEND": ("ciend", "pair"),
    "AF": ("af", "doubles"), "RAF": ("raf", "doubles"), "EVENT": ("event", "text"), "FS": ("fs", "double"), "MQ": ("mq", "double"),
    "SB": ("sb", "double"), "INFO": ("info", "double"), "RU": ("ru", "text"), "REF": ("ref_count", "int"),
}
#: FORMAT keys that are read, and the columns that they become (fixed values); others are passed over.
SAMPLE_FIELDS = {
    "GT": ("genotype", "text"), "DP": ("totalDepth", "int"), "GQ": ("genotypeQuality", "double"), "CN": ("copyNumber", "int"),
    "MCN": ("minorHaplotypeCopyNumber", "int"), "REPCN": ("repeatUnitCounts", "repeats"), "AD": ("alleleDepths", "ints"),
    "SR": ("splitReadCounts", "ints"), "PR": ("pairedEndReadCounts", "ints"), "SQ": ("somaticQuality", "double"),
    "DS": ("genotypeDosage", "double"), "GP": ("genotypePosteriors", "doubles"), "BC": ("binCount", "int"),
}

_PAIR = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
_KINDS = {
    "text": pa.string(), "int": pa.int32(), "long": pa.int64(), "length": pa.int64(), "double": pa.float64(), "pair": _PAIR,
    "ints": pa.list_(pa.int32()), "repeats": pa.list_(pa.int32()), "doubles": pa.list_(pa.float64()), "flag": pa.bool_(),
}
INFO = pa.struct([*[(name, _KINDS[kind]) for name, kind in INFO_FIELDS.values()], ("imprecise", pa.bool_())])
_SAMPLE_ORDER = (
    ("genotype", "text"), ("variantFrequencies", "doubles"), ("totalDepth", "int"), ("genotypeQuality", "double"), ("copyNumber", "int"),
    ("minorHaplotypeCopyNumber", "int"), ("repeatUnitCounts", "ints"), ("alleleDepths", "ints"), ("failedFilter", "flag"), ("splitReadCounts", "ints"),
    ("pairedEndReadCounts", "ints"), ("isDeNovo", "flag"), ("lossOfHeterozygosity", "flag"), ("somaticQuality", "double"), ("isEmpty", "flag"),
    ("genotypeDosage", "double"), ("genotypePosteriors", "doubles"), ("binCount", "int"),
)
SAMPLE = pa.struct([(name, _KINDS[kind]) for name, kind in _SAMPLE_ORDER])
#: What a record has.
COLUMNS = {
    "chrom": pa.string(), "pos": pa.int64(), "id": pa.string(), "ref": pa.string(), "alts": pa.list_(pa.string()), "quality": pa.float64(),
    "filters": pa.list_(pa.string()), "info": INFO, "is_reference": pa.bool_(), "end_pos": pa.int64(), "samples": pa.list_(SAMPLE), "error": pa.string(),
}

#: Texts of fields whose values are kept by a task, as few texts come very often.
CACHED = 1 << 14
_INTEGER = re.compile(r"[+-]?[0-9]+", re.ASCII)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|infinity)|nan", re.ASCII | re.IGNORECASE)


@lru_cache(CACHED)
def integer(x: str | None, bits: int = 32) -> int | None:
    """Digits with an optional sign and nothing else; None for all else and out of range."""
    if x is None or not _INTEGER.fullmatch(x):
        return None
    n = int(x) if len(x) <= 20 else int(x.lstrip("+-").lstrip("0")[:20] or 0) * (-1 if x[0] == "-" else 1)
    return n if -(1 << bits - 1) <= n < 1 << bits - 1 else None


@lru_cache(CACHED)
def number(x: str | None) -> float | None:
    """Decimal, exponent, infinity and not-a-number spellings; no white space, no type suffix."""
    return float(x) if x is not None and _NUMBER.fullmatch(x) else None


def _every(values: list) -> list | None:
    return None if None in values else values


@lru_cache(CACHED)
def _pair(x: str | None) -> dict | None:
    parts = x.split(",") if x is not None else ()
    if len(parts) != 2 or None in (found := [integer(p, 64) for p in parts]):
        return None
    return {"lo": found[0], "hi": found[1]}


def _length(x: str | None) -> int | None:
    return None if (n := integer(x, 64)) is None else abs(n)


@lru_cache(CACHED)
def _integers(x: str | None, sign: str = ",") -> list | None:
    return None if x is None else _every([integer(v) for v in x.split(sign)])


@lru_cache(CACHED)
def _numbers(x: str | None) -> list | None:
    return None if x is None else _every([number(v) for v in x.split(",")])


_READ: dict[str, Callable] = {
    "text": lambda x: x,
    "int": integer,
    "long": lambda x: integer(x, 64),
    "length": _length,
    "double": number,
    "pair": _pair,
    "ints": _integers,
    "repeats": lambda x: _integers(x, "/"),
    "doubles": _numbers,
}


def _info(text: str) -> tuple[dict, bool]:
    """Last texts of the INFO keys, and whether the flag is there."""
    found, flag = {}, False
    for token in text.split(";"):
        key, sign, value = token.partition("=")
        if sign:
            found[key] = value
        elif token == "IMPRECISE":
            flag = True
    return found, flag


def _frequencies(vf: float | None, depths: list | None, total: int | None, n_alts: int) -> list | None:
    """The stated frequency of a single allele, else each allele's depth over the total."""
    if vf is not None and n_alts == 1:
        return [vf]
    if depths is None or len(depths) < 2:
        return None
    every = sum(depths) if total is None else total
    return [d / every for d in depths[1:]] if every > 0 else None


class Records:
    """Collects records and gives them as Arrow columns; ``wanted`` names the columns, others are not parsed."""

    def __init__(self, n_samples: int, wanted: tuple[str, ...], strict: bool):
        self.n_samples, self.wanted, self.strict = n_samples, [c for c in COLUMNS if c in wanted], strict
        self.needs_info = "info" in wanted or "end_pos" in wanted
        self.clear()

    def clear(self):
        self.values = {c: [] for c in self.wanted if c not in ("info", "samples")}
        self.infos, self.flags = [], []
        self.sizes, self.fields = [0], {name: [] for name, _ in _SAMPLE_ORDER}

    def add(self, line: str) -> None:
        c = line.split("\t")
        n, alt = len(c), None
        ref = n > 4 and (alt := c[4]) in (".", "<NON_REF>")
        pos = integer(c[1], 64) if n > 1 else None
        count, error = max(n - 9, 0), None
        if n < (9 if self.n_samples else 8):
            error = f"fewer columns than {9 if self.n_samples else 8}"
        elif pos is None:
            error = f"bad position {c[1]}"
        elif not ref and self.n_samples > 0 and count > 0 and count != self.n_samples:
            # lines without sample columns are taken as having no samples
            error = f"samples: {count}"
        if error and self.strict:
            raise ValueError(error)
        alts = None if alt is None else [a for a in alt.split(",") if a not in UNINFORMATIVE]
        tokens, flag = _info(c[7]) if self.needs_info and n > 7 else ({}, False)
        v = self.values
        if "chrom" in v:
            v["chrom"].append(c[0])
        if "pos" in v:
            v["pos"].append(pos)
        if "id" in v:
            v["id"].append(c[2] if n > 2 and c[2] != "." else None)
        if "ref" in v:
            v["ref"].append(c[3] if n > 3 else None)
        if "alts" in v:
            v["alts"].append(alts)
        if "quality" in v:
            v["quality"].append(number(c[5]) if n > 5 else None)
        if "filters" in v:
            v["filters"].append(None if n < 7 else [] if c[6] in (".", "") else c[6].split(";"))
        if "is_reference" in v:
            v["is_reference"].append(ref)
        if "end_pos" in v:
            end = integer(tokens.get("END"), 64)
            v["end_pos"].append(pos + len(c[3]) - 1 if end is None and pos is not None and n > 3 else end)
        if "error" in v:
            v["error"].append(error)
        if "info" in self.wanted:
            self.infos.append(tokens)
            self.flags.append(flag)
        if "samples" in self.wanted:
            texts = [] if ref else c[9:]
            self.sizes.append(self.sizes[-1] + len(texts))
            if texts:
                at = {}
                for i, key in enumerate(c[8].split(":")):
                    at.setdefault(key, i)
                for text in texts:
                    self._sample(text.split(":"), at, len(alts))

    def _sample(self, values: list[str], at: dict[str, int], n_alts: int) -> None:
        n, got, add = len(values), {}, self.fields

        def text(key: str) -> str | None:
            i = at.get(key)
            return None if i is None or i >= n or values[i] in (".", "") else values[i]

        for key, (name, kind) in SAMPLE_FIELDS.items():
            i = at.get(key)
            x = None if i is None or i >= n else values[i]
            got[key] = v = None if x is None or x == "." or x == "" else _READ[kind](x)
            add[name].append(v)
        add["variantFrequencies"].append(_frequencies(number(text("VF")), got["AD"], got["DP"], n_alts))
        filters = text("FT")
        add["failedFilter"].append(filters is not None and filters != "PASS")
        add["isDeNovo"].append(text("DN") == "DeNovo")
        add["lossOfHeterozygosity"].append(got["MCN"] == 0 and got["CN"] is not None and got["CN"] >= 2 and got["GT"] in ("1/2", "1|2"))
        add["isEmpty"].append(got["GT"] is None)

    def columns(self) -> list[pa.Array]:
        out = []
        for name in self.wanted:
            if name == "info":
                n, seen = len(self.infos), set().union(*self.infos)
                made = lambda key, kind: pa.array([_READ[kind](t.get(key)) for t in self.infos], _KINDS[kind]) if key in seen else pa.nulls(n, _KINDS[kind])
                parts = [made(key, kind) for key, (_, kind) in INFO_FIELDS.items()]
                out.append(pa.StructArray.from_arrays([*parts, pa.array(self.flags, pa.bool_())], fields=list(INFO)))
            elif name == "samples":
                parts = [pa.array(self.fields[f], _KINDS[kind]) for f, kind in _SAMPLE_ORDER]
                out.append(pa.ListArray.from_arrays(pa.array(self.sizes, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(SAMPLE))))
            else:
                out.append(pa.array(self.values[name], COLUMNS[name]))
        self.clear()
        return out


def schema_of(*names: str) -> T.StructType:
    """Spark schema of some columns, in the order of a record; of all with none named."""
    from pyspark.sql.pandas.types import from_arrow_type

    return T.StructType([T.StructField(c, from_arrow_type(t)) for c, t in COLUMNS.items() if not names or c in names])


#: Records in an Arrow batch.
ROWS = 2048


def parsed(lines: DataFrame, n_samples: int, wanted: tuple[str, ...], strict: bool) -> DataFrame:
    """``lines`` (value, and whatever else is there, unchanged) with the wanted columns of its records."""
    rest = [c for c in lines.columns if c not in wanted]
    fields = [T.StructField(f"c{i}", lines.schema[c].dataType) for i, c in enumerate(rest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = Records(n_samples, wanted, strict)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                for line in some.column(0).to_pylist():
                    records.add(line)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *records.columns()], names=[*some.schema.names[1:], *records.wanted])

    made = schema_of(*wanted)
    out = lines.select(lines["value"].alias("_line"), *[lines[c].alias(f"c{i}") for i, c in enumerate(rest)])
    out = out.mapInArrow(run, T.StructType([*fields, *made.fields]))
    return out.select(*[out[f"c{i}"].alias(c) for i, c in enumerate(rest)], *[out[f.name] for f in made.fields])


def header_lines(path: str, info) -> list[str]:
    """The leading lines of a file that begin with #, however many, and none of the rest."""
    found = []
    with open_file(path) as f:
        for line in lines_of(f, info, 0, info.size):
            if not line.startswith(b"#"):
                break
            found.append(line.rstrip(b"\r").decode("utf-8", "replace"))
    return found


class Vcf(DataSource):
    """Records of a file or a folder of files, plain, gzip or block-compressed, with their order; ``strict`` raises bad lines."""

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("order", T.LongType()), *schema_of().fields])

    def reader(self, schema):
        return _Reader(self.options, schema)


_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.step = options["path"], int(options.get("splitBytes", SPLIT))
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.names, self.tests = [f.name for f in schema.fields], []
        if odd := [c for c in self.names if c != "order" and c not in COLUMNS]:
            raise ValueError(f"no such columns: {', '.join(odd)}")

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of chrom and pos are made here, before the rest of a line is parsed."""
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in _TESTS and f.attribute in (("chrom",), ("pos",)) and value is not None:
                self.tests.append((f.attribute[0], type(f), value))
            else:
                yield f

    def partitions(self):
        """Splits of the files, each with its file's number of samples."""
        from varloom.sources.vcf import parse_header

        found, samples = [], {}
        for s in splits_of(self.path, self.step):
            if s.path not in samples:
                samples[s.path] = len(parse_header(header_lines(s.path, s)).samples)
            found.append((s, samples[s.path]))
        return [_Part(s.path, s.kind, s.size, s.lo, s.hi, s.number, n) for s, n in found]

    def _passes(self, line: bytes) -> bool:
        parts = line.split(b"\t", 2)
        for name, kind, value in self.tests:
            text = parts[0 if name == "chrom" else 1].decode("utf-8", "replace") if len(parts) > 1 else None
            x = text if name == "chrom" else integer(text, 64)
            if x is None or not _TESTS[kind](x, value):
                return False
        return True

    def read(self, split):
        if split is None:  # no files
            return
        records, order = Records(split.n_samples, tuple(self.names), self.strict), split.number * LINES
        with open_file(split.path) as f:
            rows = lines_of(f, split, split.lo, split.hi)
            while held := list(islice(rows, ROWS)):
                places = []
                for line in held:
                    if line and not line.startswith(b"#") and line != b"\r" and (not self.tests or self._passes(line)):
                        places.append(order)
                        records.add(line.rstrip(b"\r").decode("utf-8", "replace"))
                    order += 1
                made = dict(zip(records.wanted, records.columns(), strict=True)) | {"order": pa.array(places, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[c] for c in self.names], names=self.names)


class _Part(Split):
    def __init__(self, path, kind, size, lo, hi, number, n_samples):
        super().__init__(path, kind, size, lo, hi, number)
        self.n_samples = n_samples


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets Python sources take filters."""
    spark.dataSource.register(Vcf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_vcf(spark: SparkSession, path: str, *columns: str, **options) -> DataFrame:
    """Records of ``path``; with columns named, only these (``order`` among them where named)."""
    register(spark)
    reader = spark.read.format("vcf").options(**options)
    if columns:
        first = [T.StructField("order", T.LongType())] if "order" in columns else []
        reader = reader.schema(T.StructType([*first, *schema_of(*[c for c in columns if c != "order"]).fields]))
    return reader.load(path)
