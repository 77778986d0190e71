"""The registered queries of the corpus operators, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.llm import cells, centroids, images, licenses, mixing, pieces, quality, rules, shards, simhash, spelling, tokencount, toxicity
from varloom.llm.common import table


def op1_nbsvm_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_separator_scan(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_image_copies(spark, sf_dir):
    return images.copies(images.pictures(table(spark, sf_dir, "embeddings")))


def op7_nbest_pieces(spark, sf_dir):
    d = pieces.digests(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_pieces", "best_score", "scores", "crcs", "round_trip")


def op8_simhash_golay(spark, sf_dir):
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_external_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    placed = shards.shard(docs, shards.record_size(F.col("text")))
    text = F.col("row.text")
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        shards.record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_adaptive_rules(spark, sf_dir):
    d = rules.judged_ids(table(spark, sf_dir, "documents"))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return d.select("doc_id", *own)


def op11_permuterm_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_integer_centroids(spark, sf_dir):
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_spherical_dedup(spark, sf_dir):
    return cells.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_nbsvm_quality": op1_nbsvm_quality,
    "op2_mix_sources": op2_mix_sources,
    "op3_separator_scan": op3_separator_scan,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_license_scan": op5_license_scan,
    "op6_image_copies": op6_image_copies,
    "op7_nbest_pieces": op7_nbest_pieces,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_external_shuffle": op9_external_shuffle,
    "op10_adaptive_rules": op10_adaptive_rules,
    "op11_permuterm_spelling": op11_permuterm_spelling,
    "op12_integer_centroids": op12_integer_centroids,
    "op13_spherical_dedup": op13_spherical_dedup,
}
