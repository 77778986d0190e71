"""Translation, in Arrow batches, and protein helpers as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Amino acids by codon, first base slowest, bases in the order A, C, G, T (fixed values).
STANDARD = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
#: Places that differ in the vertebrate mitochondrial code (fixed values).
MITOCHONDRIAL_CHANGES = {8: "*", 10: "*", 12: "M", 56: "W"}


def mitochondrial() -> str:
    code = list(STANDARD)
    for place, residue in MITOCHONDRIAL_CHANGES.items():
        code[place] = residue
    return "".join(code)


#: HGNC numbers of genes whose stop codons may code for selenocysteine (fixed values).
SELENOPROTEINS = (2884, 4555, 4556, 10751, 10752, 14133, 15999, 17705, 18136, 18251, 29361, 30394, 30395, 30396, 30397, 30399)


#: Digits of bases, in either case; 4 for anything else.
_DIGITS = np.full(256, 4, np.uint8)
for _bases, _digit in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    for _base in _bases:
        _DIGITS[ord(_base)] = _digit
#: Residues of the standard and the mitochondrial code, each with X for codons that hold an unknown base.
_TABLES = np.frombuffer((STANDARD + "X" + mitochondrial() + "X").encode(), np.uint8)


def residues(data: np.ndarray, start: np.ndarray, length: np.ndarray, mt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the translations of many stretches of ``data``; X for unknown bases and for a partial last codon."""
    n = length // 3
    offsets = np.concatenate([[0], np.cumsum(n + (length % 3 > 0))])
    every = np.arange(n.sum())
    before = np.cumsum(n) - n
    at = np.repeat(start - 3 * before, n) + 3 * every
    a, b, c = (_DIGITS[data[at + k]] for k in range(3))
    place = np.where((a | b | c) < 4, a * 16 + b * 4 + c, 64) + np.repeat(mt * 65, n)
    out = np.full(offsets[-1], ord("X"), np.uint8)
    out[np.repeat(offsets[:-1] - before, n) + every] = _TABLES[place]
    return out, offsets


def _translated(text: str | None, mt: bool | None) -> str | None:
    """One text's translation by characters; only texts with other than ASCII characters need it."""
    if text is None:
        return None
    data = np.frombuffer(text.upper().encode("ascii", "replace"), np.uint8)
    n = len(data) // 3 * 3
    out, _ = residues(data, np.array([0]), np.array([n]), np.array([int(bool(mt))]))
    return out.tobytes().decode() + ("X" if len(text) % 3 else "")


def _translate(bases: pa.Array, mt: pa.Array) -> pa.Array:
    bases = bases.cast(pa.string())
    offsets = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset : bases.offset + len(bases) + 1].astype(np.int64) if len(bases) else np.zeros(1, np.int64)
    held = bases.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    if (data[offsets[0] : offsets[-1]] > 127).any():
        return pa.array([_translated(x, m) for x, m in zip(bases.to_pylist(), mt.to_pylist(), strict=True)], pa.string())
    other = mt.fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
    out, ends = residues(data, offsets[:-1], np.diff(offsets), other)
    valid = pa.array(bases.is_valid()).buffers()[1] if bases.null_count else None
    return pa.Array.from_buffers(pa.string(), len(bases), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


_udf = F.arrow_udf(_translate, T.StringType())


def translate(bases: Column, mt: Column | None = None) -> Column:
    """Residues of all codons; unknown bases and a partial last codon give X; stops don't end it.

    Arrow batches are translated as a whole: a codon's place in the table is arithmetic on its bases' digits.
    """
    return _udf(bases.cast("string"), F.lit(False) if mt is None else mt)


def without_trailing_x(protein: Column) -> Column:
    return F.regexp_replace(protein, "X+$", "")


def is_selenoprotein(hgnc: Column) -> Column:
    return F.coalesce(hgnc.isin(*SELENOPROTEINS), F.lit(False))


def residue_edits(expected: Column, translated: Column, offset: Column) -> Column:
    """array of struct(position, residue): where ``translated`` departs from ``expected`` at ``offset``; 1-based in translated."""
    n = F.least(F.length(translated), F.length(expected) - offset)
    all_places = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(
            (i <= n) & (F.substring(translated, i, F.lit(1)) != F.substring(expected, offset + i, F.lit(1))),
            F.struct(i.alias("position"), F.substring(expected, offset + i, F.lit(1)).alias("residue")),
        ),
    )
    return F.filter(all_places, lambda e: e.isNotNull())
