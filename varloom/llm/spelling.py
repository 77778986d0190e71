"""Spelling variants grouped by permuterm rotations.

A word with its terminator, turned so that the character after an edited one comes first,
has the edited character last. So words that differ in one replaced character have a
rotation each that begins alike and differs in its last character only; a word with one
more character has a rotation that is a whole rotation of the shorter word and one
character beyond. Every word files its rotations without their last character ("long"
side) and whole ("short" side); sorted by that prefix, a group's rows are one range, which
is scanned for its members' neighbours.

A group holds one word for each letter that can stand at the edited place, and one shorter
word, so at most one more than the alphabet's letters, however common its words. Rows and
not pairs leave a group: each member's number of neighbours there and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import ROWS, cut, stored

#: Letters of a word; only A-Z is lower-cased.
LETTER, RUN = re.compile("[A-Za-zÀ-ÿ]"), re.compile("[A-Za-zÀ-ÿ]*")
#: Latin-1 bytes: letters, A-Z as a-z, and all else as spaces.
LETTERS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else c if c >= 0xC0 else 32 for c in range(256))
#: One in so many occurrences of a run loses a character.
TYPO = 97
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: A form is at least this many times as frequent as its variant.
TIMES = 2
#: Ends a word; no letter.
TERMINATOR = "$"
#: Different runs that a task counts before it passes them on, and characters of a text that are cut into runs at once.
HELD, PIECE = 400_000, 1 << 20
#: Runs that are counted at once.
MANY = 1 << 20
#: Digests of as many zero bytes, for runs below SIZES bytes; longer ones are digested each time.
SIZES = 48
ZEROS = [bytes(k) for k in range(SIZES)]
NOTHING = [zlib.crc32(z) for z in ZEROS]


def misspelt(run: bytes, h: int) -> bytes:
    """The run (Latin-1) without the character that its digest ``h`` names."""
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str) -> Iterator[list[bytes]]:
    """The runs of letters of a text in Latin-1, in lists of bounded length; characters beyond Latin-1 are no letters."""
    for at in range(0, len(text), PIECE):
        # a piece begins after the run that is open where the piece before ends, and ends with its own
        lo = at if at == 0 else _after(text, at)
        hi = _after(text, at + PIECE) if at + PIECE < len(text) else len(text)
        yield text[lo:hi].encode("latin-1", "replace").translate(LETTERS).split()


def _after(text: str, at: int) -> int:
    """The first place from ``at`` on where no run that began before goes on."""
    if not LETTER.match(text[at - 1]):
        return at
    return RUN.match(text, at).end()


class Numbers(dict):
    """Numbers of runs, given as they come."""

    def __init__(self):
        super().__init__()
        self.runs: list[bytes] = []

    def __missing__(self, run: bytes) -> int:
        self[run] = n = len(self.runs)
        self.runs.append(run)
        return n


class Tally:
    """How often each word comes in some documents.

    The digest of ``<doc_id>:<run>`` is that of the run, exclusive-or what the digest of
    the first part becomes when as many zero bytes follow it; that depends on the length
    alone, so a run's bytes are digested once, and not again in every document.
    """

    def __init__(self):
        self.numbers = Numbers()
        self.size, self.digest, self.times = (np.zeros(0, np.int64) for _ in range(3))

    def _grown(self):
        if new := self.numbers.runs[len(self.size) :]:
            texts = [r.decode("latin-1").encode() for r in new]
            self.size = np.append(self.size, np.fromiter(map(len, texts), np.int64, len(new)))
            self.digest = np.append(self.digest, np.fromiter(map(zlib.crc32, texts), np.int64, len(new)))
            self.times = np.append(self.times, np.zeros(len(new), np.int64))

    def add(self, docs: list[tuple[str, str]]) -> None:
        """Counts the words of documents (id as text, text), some MANY runs at a time."""
        held, n = [], 0
        for doc_id, text in docs:
            start = zlib.crc32(f"{doc_id}:".encode())
            after = np.array([zlib.crc32(z, start) ^ k for z, k in zip(ZEROS, NOTHING, strict=True)], np.int64)
            for some in runs_of(text):
                held.append((start, after, np.fromiter(map(self.numbers.__getitem__, some), np.int64, len(some))))
                n += len(some)
                if n >= MANY:
                    self._counted(held)
                    held, n = [], 0
        self._counted(held)

    def _counted(self, held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self._grown()
        runs = self.numbers.runs
        for start, after, i in held:
            size = self.size[i]
            h = self.digest[i] ^ after[np.minimum(size, SIZES - 1)]
            for k in np.flatnonzero(size >= SIZES):
                h[k] = zlib.crc32(runs[i[k]].decode("latin-1").encode(), start)
            for k in np.flatnonzero(h % TYPO == 0):
                i[k] = self.numbers[misspelt(runs[i[k]], int(h[k]))]
        self._grown()
        if held:
            self.times += np.bincount(np.concatenate([i for _, _, i in held]), minlength=len(self.times))

    def counts(self) -> tuple[list[str], np.ndarray]:
        """Words of LEAST_LETTERS code points or more, and their numbers."""
        runs = self.numbers.runs
        some = [k for k in np.flatnonzero(self.times) if len(runs[k]) >= LEAST_LETTERS]
        return [runs[k].decode("latin-1") for k in some], self.times[some]


def word_counts(docs: DataFrame, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of all words with ``least`` occurrences or more in all documents, counted in tasks before they are shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def passed(tally: Tally):
            words, n = tally.counts()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        tally = Tally()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                tally.add(list(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)))
                if len(tally.numbers) >= HELD:
                    yield passed(tally)
                    tally = Tally()
        yield passed(tally)

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, whole, first, word, n): every rotation of (word, n) with its terminator, whole and without its last character.

    ``whole`` tells the two apart. Of rotations without their last character, ``first``
    marks those whose edited character doesn't repeat the one before it: leaving out any of
    a run of equal characters gives the same shorter word, which counts once.
    """
    w = F.concat("word", F.lit(TERMINATOR))
    turned = lambda i: F.concat(w.substr(i + 1, F.length(w)), w.substr(F.lit(1), i))
    letter = lambda i: F.col("word").substr(i, F.lit(1))
    row = lambda prefix, whole, first: F.struct(prefix.alias("prefix"), F.lit(whole).alias("whole"), first.alias("first"))
    whole = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: row(turned(i), True, F.lit(False)))
    without = F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: row(turned(i).substr(F.lit(1), F.length("word")), False, (i == 1) | (letter(i) != letter(i - 1))),
    )
    return words.select(F.inline(F.concat(whole, without)), "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of (word, n), how many words are one edit away and the most frequent of these; words with none are left out.

    ``best`` is (rare, word) with ``rare`` the negative of its frequency; of equally frequent words the smallest counts.
    """
    r = rotations(words.where("word <> ''")).select("prefix", "whole", "first", F.struct((-F.col("n")).alias("rare"), "word").alias("me"))
    side = F.when(~F.col("whole"), F.col("me"))
    # one sort: the range of a prefix, by frequency
    group = W.partitionBy("prefix").orderBy("me").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    r = r.select(
        "whole", "first", "me",
        F.count(side).over(group).alias("n_long"),
        F.count(F.when(F.col("first"), 1)).over(group).alias("n_first"),
        F.min(side).over(group).alias("top"),
        F.nth_value(side, 2, True).over(group).alias("second"),
        F.min(F.when(F.col("first"), F.col("me"))).over(group).alias("top_first"),
        F.max(F.when(F.col("whole"), F.col("me"))).over(group).alias("short"),
    )
    short = F.when(F.col("first"), F.col("short"))
    other = F.when(F.col("top") == F.col("me"), F.col("second")).otherwise(F.col("top"))
    near = F.when(F.col("whole"), F.col("n_first")).otherwise(F.col("n_long") - 1 + short.isNotNull().cast("long"))
    best = F.when(F.col("whole"), F.col("top_first")).otherwise(F.least(other, short))
    r = r.select("me.word", near.alias("n_near"), best.alias("best")).where("n_near > 0")
    return r.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to (word, form, ...): the last word that forms lead to, the word itself if it has none.

    Paths are halved each round, as every word takes over where its form has got to; a
    form is TIMES as frequent as its variant, so no path is longer than the logarithm of a
    frequency, and none is a circle.
    """
    at = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut(at.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("open")))
        at = moved.select("word", "root")
        if moved.where("open").isEmpty():
            break
    return forms.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n), which must be cut or stored."""
    near = neighbours(words)
    best_n = -F.col("best.rare")
    has = best_n >= F.col("n") * times
    forms = words.join(near, "word", "left").select(
        "word", "n",
        F.when(has, F.col("best.word")).alias("form"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, best_n).alias("form_n"),
    )
    return with_roots(stored(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of all documents with their forms, see ``variants``.

    Null and empty texts have no words; a null doc_id counts as empty text where runs are
    digested; repeated rows count each; of equally frequent near words the smallest by
    code point is the form; an empty table gives an empty result; other columns are
    ignored.
    """
    return variants(stored(word_counts(docs), "words"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): the neighbours themselves, each pair in both directions, for those who want them listed."""
    r = rotations(words.where("word <> ''"))
    long = r.where("not whole").select("prefix", "first", "word")
    other: Column = F.col("o_word")
    same = long.join(long.select("prefix", other_name("word")), "prefix").where(F.col("word") != other).select("word", other.alias("near"))
    short = long.where("first").join(r.where("whole").select("prefix", other_name("word")), "prefix").select("word", other.alias("near"))
    return same.union(short).union(short.select("near", "word"))


def other_name(name: str) -> Column:
    return F.col(name).alias(f"o_{name}")
