"""SentencePiece encoding and decoding with the n best segmentations of whole texts.

A text's lattice has a node at each character and an edge for each piece. The forward
Viterbi pass gives every node the score of the best path to it; a best-first search
backward from the end, with that score as the (exact) estimate of what is missing, then
meets whole paths in order of their score: A* over the piece lattice.

No piece crosses from a word into the space before the next, so the lattice of a text is
a chain of cells, one a word. Cells are solved once and kept in a bounded cache; the
chain itself is searched the same way, with a cell's alternatives as edges. Of the chain
only the n - 1 cells count whose second path costs least: a text's n best paths exist
that leave the best path nowhere else. A vocabulary with pieces that do cross makes one
cell of the whole text.

Scores are those of the model file. A character without a piece is an unknown edge and
is written as its UTF-8 bytes. Decoding the identifiers gives back the text, to the byte.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of a text.
N_BEST = 3
#: An unknown character scores the least score of a piece less this.
UNKNOWN_PENALTY = 10.0
#: Cells in a worker's cache.
CACHE = 1_000_000
#: Texts whose new cells are solved together; the more, the more prefixes they share.
TEXTS = 1024
CELL = re.compile(" *[^ ]+| +")


def n_best_paths(edges_to: Callable[[int], list], reach: list, end: int, n: int) -> list[tuple[float, list]]:
    """The n best paths 0 .. end as (score, payloads in order), best first.

    ``edges_to(p)`` lists (start, payload, score) of the edges into p; ``reach[p]`` is the
    best score from 0 to p. Paths of equal score come in the order in which the search
    meets them, which is the same each time.
    """
    found, order = [], count()
    agenda = [(-reach[end], next(order), end, 0.0, None)]
    while agenda and len(found) < n:
        _, _, at, done, tail = heapq.heappop(agenda)
        if at == 0:
            path = []
            while tail:
                payload, tail = tail
                path.append(payload)
            found.append((done, path))
            continue
        for start, payload, score in edges_to(at):
            sofar = done + score
            heapq.heappush(agenda, (-(sofar + reach[start]), next(order), start, sofar, (payload, tail)))
    return found


class Pieces:
    """Piece table of a model file, as a trie, with a bounded cache of solved cells."""

    def __init__(self, path: str = MODEL, model=None):
        import sentencepiece

        m = model or sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        normal = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.text = [b""] * m.get_piece_size()
        for i in normal:
            self.text[i] = m.id_to_piece(i).replace("▁", " ").encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        self.packed = [i.to_bytes(4, "little") for i in ids]
        self.unknown = min((m.get_score(i) for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.unk_id = m.unk_id()
        self.crossing = False
        # nodes [id, score, children], pieces read from their last character to their first
        self.ends: list = [0, None, {}]
        for i in normal:
            piece = m.id_to_piece(i).replace("▁", " ")
            self.crossing |= " " in piece.lstrip(" ")
            node = self.ends
            for ch in reversed(piece):
                node = node[2].setdefault(ch, [0, None, {}])
            node[0], node[1] = i, m.get_score(i)
        self.forget()

    def forget(self) -> None:
        """Empties the cache: cells by number, and by number their scores, costs and places in the pool of identifiers."""
        self.number: dict[str, int] = {}
        self.score, self.cost = np.zeros(0), np.zeros(0)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def ids_of(self, payload) -> list[int]:
        """Identifiers of an edge: a piece, or an unknown character's bytes."""
        if isinstance(payload, int):
            return [payload]
        return [self.byte.get(b, self.unk_id) for b in payload.encode("utf-8", "surrogatepass")]

    def edges(self, s: str) -> Iterator[tuple[int, int, object, float]]:
        """(start, end, payload, score), by end and then by length."""
        for j in range(1, len(s) + 1):
            node, i, single = self.ends, j, False
            while i:
                node = node[2].get(s[i - 1])
                if node is None:
                    break
                i -= 1
                if node[1] is not None:
                    single |= i == j - 1
                    yield i, j, node[0], node[1]
            if not single:
                yield j - 1, j, s[j - 1], self.unknown

    def solve(self, cells: list[str]) -> Iterator[tuple[str, tuple[bytes, float, float]]]:
        """Each cell with its best path's identifiers (4 bytes each) and score, and what its second path costs more (inf: none).

        What the forward pass has at a node depends on the characters before it alone, so
        cells are taken in order and go on from the prefix they share with the one before.
        """
        low, ends, unknown = float("-inf"), self.ends, self.unknown
        best, second, back = [0.0], [low], [(0, 0)]
        before = ""
        for s in sorted(cells):
            n, k = len(s), 0
            most = min(n, len(before))
            while k < most and s[k] == before[k]:
                k += 1
            del best[k + 1 :], second[k + 1 :], back[k + 1 :]
            before = s
            for j in range(k + 1, n + 1):
                first, next_, link, node, i, single = low, low, None, ends, j, False
                while i:
                    node = node[2].get(s[i - 1])
                    if node is None:
                        break
                    i -= 1
                    score = node[1]
                    if score is not None:
                        x = best[i] + score
                        if x > first:
                            y = second[i] + score
                            next_ = y if y > first else first
                            first, link = x, (i, node[0])
                        elif x > next_:
                            next_ = x
                        if i == j - 1:
                            single = True
                if not single:
                    x = best[j - 1] + unknown
                    if x > first:
                        y = second[j - 1] + unknown
                        next_ = y if y > first else first
                        first, link = x, (j - 1, s[j - 1])
                    elif x > next_:
                        next_ = x
                best.append(first)
                second.append(next_)
                back.append(link)
            path, at = [], n
            while at:
                at, payload = back[at]
                path.append(payload)
            yield s, (self.bytes_of(path[::-1]), best[n], best[n] - second[n])

    def bytes_of(self, path: list) -> bytes:
        try:
            return b"".join([self.packed[p] for p in path])
        except TypeError:  # unknown characters
            return b"".join([self.packed[i] for p in path for i in self.ids_of(p)])

    def alternatives(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths of a cell, best first."""
        into: list[list] = [[] for _ in range(len(s) + 1)]
        reach = [float("-inf")] * (len(s) + 1)
        reach[0] = 0.0
        for i, j, payload, score in self.edges(s):
            into[j].append((i, payload, score))
            reach[j] = max(reach[j], reach[i] + score)
        paths = n_best_paths(into.__getitem__, reach, len(s), n)
        return [(score, self.bytes_of(path)) for score, path in paths]

    def cells(self, text: str) -> list[str]:
        return [] if not text else [" " + text] if self.crossing else CELL.findall(" " + text)

    def learn(self, cells: set[str]) -> None:
        """Solves what the cache lacks of some cells; a cache that would grow too large starts anew with these."""
        missing = [c for c in cells if c not in self.number]
        if len(self.number) + len(missing) > CACHE and self.number:
            self.forget()
            missing = list(cells)
        if not missing:
            return
        names, found = zip(*self.solve(missing), strict=True)
        ids, scores, costs = zip(*found, strict=True)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.start = np.append(self.start, len(self.pool) + np.cumsum(length) - length)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        self.length, self.score, self.cost = np.append(self.length, length), np.append(self.score, scores), np.append(self.cost, costs)
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """Up to n best segmentations (score, identifiers) of a whole text; a null or empty text has one, without pieces."""
        cells = self.cells(text or "")
        self.learn(set(cells))
        return [(score, np.frombuffer(ids, "<u4")) for score, ids in self.assembled(cells, n)[0]]

    def assembled(self, cells: list[str], n: int) -> tuple[list[tuple[float, bytes]], bool]:
        """Up to n best segmentations of a chain of known cells, and whether all but the best give their cells' text."""
        if not cells:
            return [(0.0, b"")], True
        k = np.fromiter(map(self.number.__getitem__, cells), np.int64, len(cells))
        length = self.length[k]
        ends = np.cumsum(length)
        total = float(self.score[k].sum())
        best = self.pool[np.repeat(self.start[k] - ends + length, length) + np.arange(ends[-1])].tobytes()
        found, sound = [(total, best)], True
        if n <= 1:
            return found, sound
        gaps = self.cost[k]
        few = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else np.arange(len(gaps))
        chosen = sorted(k for k in few.tolist() if gaps[k] != np.inf)
        ways = [self.alternatives(cells[k], n) for k in chosen]
        reach = [total - sum(w[0][0] for w in ways)]
        for w in ways:
            reach.append(reach[-1] + w[0][0])
        spans = [(4 * int(ends[k] - length[k]), 4 * int(ends[k])) for k in chosen]
        steps = lambda p: [(p - 1, way, way[0]) for way in ways[p - 1]]
        for rank, (score, path) in enumerate(n_best_paths(steps, reach, len(ways), n)):
            if rank == 0:
                continue  # the best path of every cell
            own, at = [], 0
            for k, (start, end), way in zip(chosen, spans, path, strict=True):
                own += [best[at:start], way[1]]
                at = end
                sound &= self.raw(way[1]) == cells[k].encode("utf-8", "surrogatepass")
            found.append((reach[0] + score, b"".join([*own, best[at:]])))
        return found, sound

    def raw(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids) -> str:
        """The text of identifiers; control and unknown identifiers have none."""
        return b"".join(map(self.text.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace").removeprefix(" ")


_loaded: dict[str, Pieces] = {}


def pieces(path: str = MODEL) -> Pieces:
    """The worker's table of the model at ``path``, with what its cache holds from earlier tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str = MODEL, n: int = N_BEST) -> DataFrame:
    """The rows of ``docs`` without text, with the best segmentation's identifiers and a digest of the n best.

    Added: ids array<int>, n_pieces, scores (best first), crcs (CRC-32 of each
    segmentation's identifiers as 4-byte little-endian numbers) and round_trip (decoding
    each gives the text back). Null and empty texts have no pieces and one segmentation
    of score 0; repeated rows are encoded alike; an empty table gives an empty result;
    columns of these names are replaced.
    """
    added = ["ids", "n_pieces", "scores", "crcs", "round_trip"]
    rest = [c for c in docs.columns if c not in (*added, "text")]
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType()), T.BooleanType())

    def make(texts: list) -> list:
        p = pieces(path)
        chains = [p.cells(t or "") for t in texts]
        p.learn(set().union(*chains))
        ids, scores, crcs, same = [], [], [], []
        for t, cells in zip(texts, chains, strict=True):
            ways, sound = p.assembled(cells, n)
            ids.append(np.frombuffer(ways[0][1], "<i4"))
            scores.append([w[0] for w in ways])
            crcs.append([zlib.crc32(w[1]) for w in ways])
            # the others differ from the best in cells that were looked at one by one
            same.append(sound and p.raw(ways[0][1]) == (" " + t if t else "").encode("utf-8", "surrogatepass"))
        return [ids, [len(x) for x in ids], scores, crcs, same]

    return with_columns(docs, "text", rest, list(zip(added, kinds, strict=True)), make, TEXTS)


def digests(docs: DataFrame, path: str = MODEL, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, best_score, scores, crcs, round_trip) of every row."""
    e = encoded(docs.select("doc_id", "text"), path, n).drop("ids")
    return e.withColumn("best_score", F.get("scores", F.lit(0)))
