"""Hashed indicator features of whole texts: byte n-grams, words, word pairs and word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 20
#: Bytes of text that one vectorised step works on, few enough for a processor's cache; a longer text takes several steps.
STEP = 1 << 17
#: Texts whose features are marked in one table.
MARKED = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)
#: Lengths of runs of one word that are features of their own.
RUNS = (3, 4, 5, 6, 8, 10, 12)


def _pieces(texts: list[str | None], lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, document number of each byte) of some texts at a time, a 0 byte after each piece."""
    held, owner, total = [], [], 0
    for d, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        b = b.lower() if lower else b
        at = 0
        while at < len(b):
            end = at + STEP
            if end < len(b):  # cut long texts at white space, if there is any near
                space = b.rfind(b" ", at + STEP // 2, end)
                end = space + 1 if space > 0 else end
            held.append(b[at:end] + b"\0")
            owner.append(d)
            total += len(held[-1])
            at = end
            if total >= STEP:
                yield _joined(held, owner)
                held, owner, total = [], [], 0
    if held:
        yield _joined(held, owner)


def _joined(held: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(held), np.uint8), np.repeat(owner, [len(x) for x in held])


def _hash(codes: np.ndarray, kind: int) -> np.ndarray:
    x = (codes + np.uint64(kind)) * _MIX
    x ^= x >> np.uint64(29)
    return ((x * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def _word_codes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit code of each run of bytes that are neither white space nor 0."""
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)) | (b == 0))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else None
    if place is None:
        place = np.arange(len(b)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(b)]))))
    weighted = np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * _POW[place & 255], np.uint64(0))
    return start, np.add.reduceat(weighted, start)


def indicators(
    texts: list[str | None], orders: tuple[int, ...], pairs: bool, lower: bool, keep: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each pair once and in order. With ``keep`` (a table from hashed
    features to places or -1) only features with a place remain, as that place."""
    found = []
    for b, doc in _pieces(texts, lower):
        wide = b.astype(np.uint64)
        for n in orders:
            if len(b) < n:
                continue
            code = np.zeros(len(b) - n + 1, np.uint64)
            ok = np.ones(len(code), bool)
            for k in range(n):
                part = wide[k : k + len(code)]
                code = (code << np.uint64(8)) | part
                ok &= part != 0
            found.append(_kept(doc[: len(code)][ok], _hash(code[ok], n), keep))
        start, code = _word_codes(b)
        if len(start):
            of = doc[start]
            found.append(_kept(of, _hash(code, 101), keep))
            same = (of[1:] == of[:-1]) & (code[1:] == code[:-1])
            at = np.arange(len(of))
            begun = np.maximum.accumulate(np.where(np.append(False, same), 0, at))
            for k, n in enumerate(RUNS):
                run = np.flatnonzero(at - begun == n - 1)
                found.append(_kept(of[run], np.full(len(run), k + 1, np.int32), keep))
            if pairs:
                two = of[1:] == of[:-1]
                found.append(_kept(of[1:][two], _hash((code[:-1] * _MIX + code[1:])[two], 102), keep))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if keep is None:
        key = np.unique(np.concatenate([(d.astype(np.int64) << BITS) | f for d, f in found]))
        return key >> BITS, key & ((1 << BITS) - 1)
    # with few features a table of marks is cheaper than sorting; texts come in order, so their pairs can be cut into runs
    wide, docs, places = int(keep.max()) + 1, [], []
    d, f = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    for lo in range(0, len(texts), MARKED):
        some = (d >= lo) & (d < lo + MARKED) if len(texts) > MARKED else slice(None)
        marks = np.zeros(MARKED * wide, bool)
        marks[(d[some] - lo) * wide + f[some]] = True
        key = np.flatnonzero(marks)
        docs.append(key // max(wide, 1) + lo)
        places.append(key % max(wide, 1))
    return np.concatenate(docs), np.concatenate(places)


def _kept(doc: np.ndarray, feature: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if keep is None:
        return doc, feature
    place = keep[feature]
    ok = place >= 0
    return doc[ok], place[ok]


def table(features: np.ndarray) -> np.ndarray:
    keep = np.full(1 << BITS, -1, np.int32)
    keep[features] = np.arange(len(features))
    return keep


def document_counts(texts: list, y: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each feature, among those with y true and y false."""
    yes, no = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for at in range(0, len(texts), 200):
        d, f = indicators(texts[at : at + 200], **how)
        up = y[at + d]
        yes += np.bincount(f[up], minlength=1 << BITS)
        no += np.bincount(f[~up], minlength=1 << BITS)
    return yes, no


def rows(texts: list, keep: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
    """Compressed rows (offsets, places) of the texts."""
    counts, places = [], []
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        d, f = indicators(some, keep=keep, **how)
        counts.append(np.bincount(d, minlength=len(some)))
        places.append(f)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
    return offsets, np.concatenate(places) if places else np.zeros(0, np.int64)
