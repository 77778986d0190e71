"""Token counts by scanning flat token files for the end-of-document identifier.

A flat token file is a run of fixed-width identifiers, documents one after the other,
each closed by the end-of-document identifier, and nothing that says where they begin.
Files come in blocks of a bounded number of tokens that know only their stream and their
number in it; a document may span any number of blocks. Each block is searched with one
vectorised comparison and reports its inner counts, the tokens before its first
separator and those after its last. A prefix scan over the blocks of a stream (separator
counts, and tokens since the last separator) then numbers the documents and stitches
those that cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's free identifier closes a document.
END = 50256
#: Tokens in a block.
BLOCK = 1 << 19
#: Blocks in a chunk of the two-level prefix scan.
CHUNK = 1024
#: Split pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters handed to the encoder at a time; longer texts are cut before white space.
PIECE = 1 << 18

_encoder = {}


def encoder(path: str = VOCABULARY):
    if path not in _encoder:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoder[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoder[path]


def encode(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Identifiers of a whole text (none for null and empty texts)."""
    text, enc = text or "", encoder(path)
    if len(text) <= PIECE:
        return np.asarray(enc.encode_ordinary(text), np.uint16)
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            # a single space before a letter starts a new split whatever stands before it
            space = end
            while space > at and not (text[space] == " " and text[space + 1 : space + 2].isalpha() and not text[space - 1].isspace()):
                space -= 1
            end = space if space > at else len(text)
        parts.append(np.asarray(enc.encode_ordinary(text[at:end]), np.uint16))
        at = end
    return np.concatenate(parts)


def flat_blocks(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Token stream of each partition of docs (doc_id, text) in blocks, and the order of its documents.

    Rows are (stream, number, tokens binary, null) for blocks and (stream, null, null,
    doc_id) in order, with ``ordinal`` counting documents; neither holds a length.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"stream int, number long, tokens binary, ordinal long, doc_id {kind}"
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        stream, ordinal, number = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def batch(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns["stream"] = [stream] * n
            made = [columns.get(f.name, pa.nulls(n, f.type)) for f in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, fields, strict=True)], schema=fields)

        def out(tokens: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return batch(number=[number - 1], tokens=[tokens.astype("<u2").tobytes()])

        for b in batches:
            yield batch(ordinal=list(range(ordinal, ordinal + b.num_rows)), doc_id=b.column(0))
            ordinal += b.num_rows
            for t in b.column(1):
                held += [encode(t.as_py(), path), np.array([END], np.uint16)]
                size += len(held[-2]) + 1
                if size >= block:
                    flat = np.concatenate(held)
                    whole = len(flat) // block * block
                    for at in range(0, whole, block):
                        yield out(flat[at : at + block])
                    held, size = [flat[whole:]], len(flat) - whole
        if size:
            yield out(np.concatenate(held))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(stream, number, tokens) of the flat files under ``path``; each file is a stream, its name the stream's.

    Files are read whole by one task each, so writers should roll them at some 100 MB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                step = block * width
                for n, at in enumerate(range(0, len(content), step)):
                    yield pd.DataFrame({"stream": [name], "number": [n], "tokens": [content[at : at + step]]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "stream string, number long, tokens binary")


def scan_blocks(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(stream, number, separators, head, tail, inner): tokens before the first and after the last separator
    (without any, ``tail`` is the whole block), and those between consecutive ones."""
    kind = blocks.schema["stream"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for stream, number, content in zip(b["stream"], b["number"], b["tokens"], strict=True):
                ids = np.frombuffer(content, f"<u{width}")
                at = np.flatnonzero(ids == end)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (0, len(ids))
                rows.append((stream, number, len(at), head, tail, (np.diff(at) - 1).tolist()))
            yield pd.DataFrame(rows, columns=["stream", "number", "separators", "head", "tail", "inner"])

    return blocks.select("stream", "number", "tokens").mapInPandas(
        run, f"stream {kind}, number long, separators long, head long, tail long, inner array<long>"
    )


def stitched(scanned: DataFrame) -> DataFrame:
    """(stream, ordinal, n_tokens) of all documents, by a prefix scan over blocks.

    The scan has two levels: within chunks of blocks, and over the chunks of a stream.
    ``carry`` is what a run of blocks leaves open: tokens since its last separator. An
    unclosed rest at the end of a stream is a document too, if it has tokens.
    """
    s = scanned.withColumn("chunk", F.expr(f"number div {CHUNK}"))
    inside = W.partitionBy("stream", "chunk").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("stream").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)

    def open_after(part: str):
        """Tokens open after the run before this row: all since the last row that has a separator."""
        w, key = (inside, "number") if part == "number" else (over, "chunk")
        last = F.last(F.when(F.col("separators") > 0, F.col("upto") - F.col("tail")), ignorenulls=True).over(w)
        return F.coalesce(F.sum("tail").over(w), F.lit(0)) - F.coalesce(last, F.lit(0)), F.last(
            F.when(F.col("separators") > 0, F.lit(1)), ignorenulls=True
        ).over(w)

    def scan(rows: DataFrame, part: str, w_incl) -> DataFrame:
        w = inside if part == "number" else over
        rows = rows.withColumn("upto", F.sum("tail").over(w_incl))
        opened, closed = open_after(part)
        return rows.withColumns(
            {
                "docs_before": F.coalesce(F.sum("separators").over(w), F.lit(0)),
                "open_before": opened,
                "closed_before": closed.isNotNull(),
            }
        )

    incl = W.partitionBy("stream", "chunk").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    s = scan(s, "number", incl)
    at_end = F.max_by(
        F.struct(
            (F.col("docs_before") + F.col("separators")).alias("separators"),
            F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("open_before") + F.col("tail")).alias("tail"),
        ),
        "number",
    )
    chunks = s.groupBy("stream", "chunk").agg(at_end.alias("e"), F.max("number").alias("last")).select("stream", "chunk", "last", "e.*")
    chunks = scan(chunks, "chunk", W.partitionBy("stream").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0))
    c = chunks.select(
        "stream",
        "chunk",
        F.col("docs_before").alias("docs_start"),
        F.col("open_before").alias("open_start"),
    )
    s = s.join(c, ["stream", "chunk"])
    opened = F.col("open_before") + F.when(F.col("closed_before"), F.lit(0)).otherwise(F.col("open_start"))
    s = s.withColumns({"first": F.col("docs_start") + F.col("docs_before"), "opened": opened})
    counts = F.concat(F.array(F.col("opened") + F.col("head")), F.col("inner"))
    docs = s.where("separators > 0").select("stream", "first", F.posexplode(counts).alias("k", "n_tokens"))
    docs = docs.select("stream", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    final = s.groupBy("stream").agg(
        F.max_by(
            F.struct(
                (F.col("first") + F.col("separators")).alias("ordinal"),
                F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("opened") + F.col("tail")).alias("n_tokens"),
            ),
            "number",
        ).alias("r")
    )
    return docs.union(final.where("r.n_tokens > 0").select("stream", "r.ordinal", "r.n_tokens"))


def token_counts(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every row: texts are written as flat token blocks to the shared folder and counted there.

    Null and empty texts count 0; repeated rows are counted each; an empty table gives an
    empty result; other columns are ignored.
    """
    flat = stored(flat_blocks(docs, path, block), "tokens")
    counts = stitched(scan_blocks(flat.where("number is not null")))
    names = flat.where("ordinal is not null").select("stream", "ordinal", "doc_id")
    return names.join(counts, ["stream", "ordinal"]).select("doc_id", "n_tokens")
