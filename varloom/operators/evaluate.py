"""Translated coding regions held against the expected proteins.

Rows go to Python once, in Arrow batches: a batch is translated as a whole, and those of
its proteins that don't agree at once are aligned with numpy, those of equal lengths together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from varloom.functions.codons import STANDARD, is_selenoprotein, residues

#: Alignment scores and the mean score that is enough (fixed values).
MATCH, MISMATCH, ENOUGH = 15, -7, 10.0
EDITS, SELENO_EDITS = 2, 10
OUTCOMES = ("perfect", "contained", "edits", "slippage", "unresolvable")
_DIGIT = {ord("A"): 0, ord("C"): 1, ord("G"): 2, ord("T"): 3, ord("U"): 3, ord("a"): 0, ord("c"): 1, ord("g"): 2, ord("t"): 3, ord("u"): 3}
_CODE = np.full(256, 64, np.int64)
for _b, _d in _DIGIT.items():
    _CODE[_b] = _d


def protein_of(bases: bytes, code: str) -> bytes:
    """Translation of whole codons, X for a rest and for codons with an unknown base."""
    d = _CODE[np.frombuffer(bases, np.uint8)]
    n = len(d) // 3
    c = d[: n * 3].reshape(n, 3)
    place = np.where((c < 4).all(axis=1), c @ np.array([16, 4, 1]), 64)
    table = np.frombuffer((code + "X").encode(), np.uint8)
    return table[place].tobytes() + (b"X" if len(d) % 3 else b"")


#: Comparisons of residues beyond which matches are counted by convolution.
PLAIN = 1 << 18


def matches(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Equal residues of ``short`` laid at each place of ``long``.

    Long proteins take a convolution of each common residue's indicators, n log n in all;
    its sums are whole numbers far below what doubles tell apart.
    """
    n, m = len(long), len(short)
    if (n - m + 1) * m <= PLAIN:
        return (np.lib.stride_tricks.sliding_window_view(long, m) == short).sum(axis=1)
    size, total = 1 << n.bit_length(), 0.0
    for residue in np.intersect1d(long, short):
        total = total + np.fft.rfft(long == residue, size) * np.conj(np.fft.rfft(short == residue, size))
    if np.isscalar(total):
        return np.zeros(n - m + 1, np.int64)
    return np.rint(np.fft.irfft(total, size)[: n - m + 1]).astype(np.int64)


def best_offset(long: bytes, short: bytes) -> int | None:
    """Where ``short`` lies best in ``long`` without gaps, the first place on ties; null if the mean score is too low."""
    m = len(short)
    if not m or m > len(long):
        return None
    same = matches(np.frombuffer(long, np.uint8), np.frombuffer(short, np.uint8))
    at = int(same.argmax())
    score = int(same[at]) * MATCH + (m - int(same[at])) * MISMATCH
    return at if score / m >= ENOUGH else None


def agreeing(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    off = np.flatnonzero(np.frombuffer(a, np.uint8)[:n] != np.frombuffer(b, np.uint8)[:n])
    return int(off[0]) if len(off) else n


def _edits(outer: bytes, inner: bytes, offset: int, want_outer: bool) -> list[tuple[int, str]]:
    """Differences of ``inner`` laid at ``offset`` in ``outer``: 1-based place in inner, and the expected residue."""
    n = min(len(inner), len(outer) - offset)
    return [
        (i + 1, chr((outer if want_outer else inner)[offset + i if want_outer else i])) for i in range(n) if outer[offset + i] != inner[i]
    ]


def slippage(cds: bytes, expected: bytes, got: bytes) -> tuple[int, int] | None:
    """(place, length) of a ribosomal slip: exactly one end of the protein agrees, and the rest reads on in another frame."""
    if len(expected) <= 10 or len(got) <= 10:
        return None
    if (expected[1:11] == got[1:11]) == (expected[-11:] == got[-11:]):
        return None
    head = 1 + agreeing(expected[1:], got[1:])
    rests = [protein_of(cds[head * 3 + skip :], STANDARD) for skip in (1, 2) if head * 3 + skip < len(cds)]
    tail = max((agreeing(r[::-1], expected[::-1]) for r in rests), default=0)
    return head * 3 + 1, min(max(len(cds) - head * 3 - tail * 3, 0), 255)


def best_offsets(pairs: list[tuple[bytes, bytes]]) -> list[int | None]:
    """``best_offset`` of many (long, short); pairs of the same two lengths are laid on each other together."""
    out: list[int | None] = [None] * len(pairs)
    alike = defaultdict(list)
    for i, (long, short) in enumerate(pairs):
        if short and len(short) <= len(long):
            alike[len(long), len(short)].append(i)
    for (n, m), places in alike.items():
        if len(places) == 1 or (n - m + 1) * m > PLAIN:
            for i in places:
                out[i] = best_offset(*pairs[i])
            continue
        step = max(1, PLAIN // n)
        for first in range(0, len(places), step):
            some = places[first : first + step]
            long, short = (np.frombuffer(b"".join(pairs[i][k] for i in some), np.uint8).reshape(len(some), -1) for k in (0, 1))
            same = np.stack([np.count_nonzero(long[:, k : k + m] == short, axis=1) for k in range(n - m + 1)], axis=1)
            at = same.argmax(axis=1)
            top = same[np.arange(len(some)), at]
            enough = (top * MATCH + (m - top) * MISMATCH) / m >= ENOUGH
            for k in np.flatnonzero(enough).tolist():
                out[some[k]] = int(at[k])
    return out


def proteins_of(parts: list[bytes], mt: list[bool]) -> list[bytes]:
    """``protein_of`` of many coding sequences, without the X at their ends."""
    length = np.array([len(p) for p in parts], np.int64)
    out, ends = residues(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length, np.array(mt, np.int64))
    held = out.tobytes()
    return [held[a:b].rstrip(b"X") for a, b in pairwise(ends.tolist())]


def judge(cdna: str, start: int, end: int, expected: str, mt: bool, seleno: bool) -> dict:
    """Outcome of one coding region: outcome, frame padding, protein offset, edits, slip place and length."""
    return judged([(cdna, start, end, expected, mt, seleno)])[0]


def judged(rows: list[tuple[str, int, int, str, bool, bool]]) -> list[dict]:
    """Outcomes of coding regions (cdna, start, end, expected, mt, seleno); each step takes all rows that no step before has settled."""
    out = [
        {"outcome": "unresolvable", "wrong_frame": False, "padding": 0, "offset": 0, "edits": [], "slip_place": None, "slip_length": None} for _ in rows
    ]
    bases, want = [r[0].encode() for r in rows], [r[3].encode() for r in rows]

    def translations(left: list[int], parts: list[bytes]) -> list[bytes]:
        return proteins_of(parts, [rows[i][4] for i in left])

    def fitted(left: list[int], proteins: list[bytes], keep_reverse_offset: bool, more: dict) -> list[int]:
        """Settles rows whose protein fits and returns the others; the shorter of both proteins is laid on the longer."""
        forward = [len(p) <= len(want[i]) for i, p in zip(left, proteins, strict=True)]
        ways = [(want[i], p) if f else (p, want[i]) for i, p, f in zip(left, proteins, forward, strict=True)]
        others = []
        for i, (outer, inner), f, at in zip(left, ways, forward, best_offsets(ways), strict=True):
            e = None if at is None else [] if outer[at : at + len(inner)] == inner else _edits(outer, inner, at, f)
            if e is None or len(e) > (SELENO_EDITS if rows[i][5] else EDITS):
                others.append(i)
            else:
                out[i] |= {"outcome": "edits" if e else "contained", "edits": e, "offset": at if f or keep_reverse_offset else 0, **more}
        return others

    left = [i for i, (_, start, end, *_) in enumerate(rows) if not (start - 1 >= len(bases[i]) or end > len(bases[i]) or start < 1)]
    cds = {i: bases[i][rows[i][1] - 1 : rows[i][2]] for i in left}
    got = dict(zip(left, translations(left, [cds[i] for i in left]), strict=True))
    for i in left:
        if got[i] == want[i]:
            out[i]["outcome"] = "perfect"
    left = [i for i in left if got[i] != want[i]]
    left = fitted(left, [got[i] for i in left], False, {})
    others = []
    for i in left:
        slip = slippage(cds[i], want[i], got[i])
        if slip and slip[1] <= 2:
            out[i] |= {"outcome": "slippage", "slip_place": slip[0], "slip_length": slip[1]}
        else:
            others.append(i)
    left = others
    for padding in (1, 2):
        first = [rows[i][1] - 1 - padding for i in left]
        longer = [b"N" * max(-k, 0) + bases[i][max(k, 0) : rows[i][2]] for i, k in zip(left, first, strict=True)]
        found = dict(zip(left, translations(left, longer), strict=True))
        for i, p in found.items():
            if not rows[i][5] and b"*" in p:
                found[i] = p[: p.index(b"*") + 1]
        for skip in (0, 1):
            left = fitted(left, [found[i][skip:] for i in left], True, {"padding": padding, "wrong_frame": True})
    return out


#: Coding regions that are evaluated together.
ROWS = 4096


def evaluated(coding: DataFrame) -> DataFrame:
    """Adds outcome, wrong_frame, padding, offset, edits, slip_place, slip_length to coding transcripts.

    Needs tx, cdna, cdna_start, cdna_end, protein, mt and hgnc_id; other columns are kept.
    Rows go to Python once, in Arrow batches.
    """
    d = coding.withColumn("seleno", is_selenoprotein(F.col("hgnc_id")))
    kinds = T.StructType.fromDDL(
        "outcome string, wrong_frame boolean, padding int, offset int, edits array<struct<position:int,residue:string>>, slip_place int, slip_length int"
    )
    needed, types = ("cdna", "cdna_start", "cdna_end", "protein", "mt", "seleno"), [to_arrow_type(f.dataType) for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                given = zip(*(some.column(c).to_pylist() for c in needed), strict=True)
                found = judged([(c or "", int(s or 0), int(e or 0), p or "", bool(m), bool(x)) for c, s, e, p, m, x in given])
                for f in found:
                    f["edits"] = [{"position": p, "residue": r} for p, r in f["edits"]]
                made = [pa.array([f[k.name] for f in found], t) for k, t in zip(kinds, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], names=[*some.schema.names, *kinds.names])

    return d.mapInArrow(run, T.StructType([*d.schema.fields, *kinds.fields]))


def outcome_counts(e: DataFrame) -> DataFrame:
    """One row of counts; wrong_frame overlaps with contained and edits."""
    return e.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if("wrong_frame").alias("wrong_frame"))
