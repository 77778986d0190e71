"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id) -> object:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Up to ``bound`` rows (doc_id, text, quality, toxic) with labels, none of them held out.

    The labelled ids are taken in order of a seeded hash before texts are read. Rows with a
    null id or label don't count; where an id has several labels its smallest count.
    """
    ids = labels.where("doc_id is not null and quality is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most `bound` ids
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """The model that ``fit`` makes of a bounded sample, in one task; a retry makes the same."""

    def run(batches):
        held = [b for b in batches]
        if held:
            some = pd.concat(held).sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)
            yield pd.DataFrame({"model": [pickle.dumps(fit(some))]})

    # only the sampled rows move
    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(pd.DataFrame(columns=["doc_id", "text", "quality", "toxic"]))
