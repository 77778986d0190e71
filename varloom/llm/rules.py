"""Quality rules with adaptive thresholds (native).

Metrics of every whole text; then, for each language and source, a mergeable quantile
sketch of each metric: counts over log-linear cells (exact below 64, then 64 cells an
octave, so a quantile is off by 1/64 at most). Sketches of groups add up to those of
languages and of the corpus; a group too small for quantiles of its own takes those of
its language or of the corpus. Thresholds are fences made of a group's quantiles, and
joining them to the documents filters these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import SPACE, cut, stored, with_line_of, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Documents of its language, and of the whole corpus, that count in a group's sketch beside its own.
OF_LANGUAGE, OF_ALL = 50.0, 10.0
#: Quantiles that fences are made of, in hundredths.
QUANTILES = (25, 75, 95, 99)
#: Fence of word length, which spreads around a middle: 3 interquartile ranges and a slack beyond the quartiles.
MIDDLE, RANGES = {"word_length": 100}, 3
#: Fences of metrics that are zero in most documents and have a long tail: this many times the 95th percentile of the
#: rate. A document may also have as many as the 99th percentile of its group's counts, whatever its length.
TAIL, TIMES = {"repeat_rate": "n_repeat_words", "dup_rate": "n_dup_lines"}, 3
#: Fences of metrics that are zero but in documents of another kind: between the upper quartile and the 99th percentile
#: by their geometric mean, and TIMES the upper quartile at least.
APART = ("symbol_rate",)
METRICS = (*APART, *MIDDLE, *TAIL)


def _windows(w: Column) -> Column:
    """64-bit digests of the 3-word windows of an array of words."""
    at = lambda k: F.get(w, k)
    return F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))),
    ).otherwise(F.array().cast("array<long>"))


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts.

    Windows found more than once are met by sorting (digest, position) within the row;
    the words they cover are the sum of min(3, distance to the next such window). A row
    whose digests are all different skips the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    d = docs.withColumns({"_w": words(F.col(text_col)), "_lines": lines})
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": _windows(F.col("_w")),
        }
    ).drop("_w", "_lines")
    d = d.withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
    keyed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("_s", F.when(F.col("_twice"), F.sort_array(keyed)).otherwise(none)).drop("_h")
    d = d.withColumn("_hs", F.transform("_s", lambda x: x["h"]))
    again = F.filter(
        "_s",
        lambda x, j: F.coalesce(F.get(F.col("_hs"), j - 1) == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_hs"), j + 1) == x["h"], F.lit(False)),
    )
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    d = d.drop("_s", "_hs", "_twice")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
    )
    return d.withColumn("n_repeat_words", covered["n"]).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)


def _rates(d: DataFrame) -> DataFrame:
    """Metrics as whole numbers: per 10,000 words, and hundredths of a character."""
    per = lambda c, k: F.expr(f"({c} * {k}) div greatest(n_words, 1)")
    return d.withColumns(
        {
            "symbol_rate": per("n_symbols", 10000),
            "dup_rate": per("n_dup_lines", 10000),
            "repeat_rate": per("n_repeat_words", 10000),
            "word_length": per("word_chars", 100),
        }
    )


def sketch_cell(v: Column) -> Column:
    """Lower end of the value's cell: v itself below 64, else v without all but its top 7 bits."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), shift.cast("double")).cast("long")
    return v - v % step


def sketches(d: DataFrame) -> DataFrame:
    """(lang, source, metric, cell, n) of the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), sketch_cell(F.col(m)).alias("cell")) for m in (*METRICS, *TAIL.values())])
    return (
        d.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(pairs).alias("x"))
        .groupBy("lang", "source", "x.metric", "x.cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, q25, q75, q95) of each group's sketch, merged with those of its language and of all.

    The language's documents count as OF_LANGUAGE documents and the corpus's as OF_ALL
    beside the group's own, whatever their number: a large group's quantiles are its own,
    a small one's come close to its language's, and no size is a switch.
    """
    own = sketch.groupBy("lang", "source", "metric", "cell").agg(F.sum("n").alias("n"))
    own = cut(own)  # read three times below; cells by group, no rows
    by_lang = own.groupBy("lang", "metric", "cell").agg(F.sum("n").alias("n"))
    of_all = own.groupBy("metric", "cell").agg(F.sum("n").alias("n"))
    groups = own.select("lang", "source", "metric").distinct()
    none = F.lit(0).cast("long")
    key = ["lang", "source", "metric"]
    l = by_lang.select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), "cell", "n")
    of_lang = groups.join(l, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    # at most 64 cells an octave for each metric, whatever the corpus
    everywhere = groups.join(F.broadcast(of_all), "metric")
    rows = (
        own.select(*key, "cell", F.col("n").alias("own"), none.alias("lang_n"), none.alias("all_n"))
        .unionByName(of_lang.select(*key, "cell", none.alias("own"), F.col("n").alias("lang_n"), none.alias("all_n")))
        .unionByName(everywhere.select(*key, "cell", none.alias("own"), none.alias("lang_n"), F.col("n").alias("all_n")))
    )
    levels = ("own", "lang_n", "all_n")
    rows = rows.groupBy(*key, "cell").agg(*[F.sum(c).alias(c) for c in levels])
    w = W.partitionBy(*key)
    upto = w.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(
        *key, "cell", *[F.sum(c).over(upto).alias(f"{c}_upto") for c in levels], *[F.sum(c).over(w).alias(f"{c}_total") for c in levels]
    )
    share = lambda c: F.col(f"{c}_upto").cast("double") / F.col(f"{c}_total").cast("double")
    below = F.col("own_upto").cast("double") + share("lang_n") * OF_LANGUAGE + share("all_n") * OF_ALL
    total = F.col("own_total").cast("double") + (OF_LANGUAGE + OF_ALL)
    at = lambda q: F.min(F.when(below * 100.0 >= total * float(q) - 1e-6, F.col("cell"))).alias(f"q{q}")
    return rows.groupBy(*key).agg(*[at(q) for q in QUANTILES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <metric>_max, word_length_min) of each group."""
    spread = F.col("q75") - F.col("q25")
    is_ = lambda *names: F.col("metric").isin(*names)
    slack = F.coalesce(*[F.when(is_(m), F.lit(s)) for m, s in MIDDLE.items()])
    between = F.floor(F.sqrt(((F.col("q75") + 1) * (F.col("q99") + 1)).cast("double")))
    upper = (
        F.when(is_(*TAIL), F.col("q95") * TIMES)
        .when(is_(*TAIL.values()), F.col("q99"))
        .when(is_(*APART), F.greatest(F.col("q75") * TIMES, between))
        .otherwise(F.col("q75") + spread * RANGES + slack)
    )
    q = quantiles(sketch).select("lang", "source", "metric", upper.alias("hi"), (F.col("q25") - spread * RANGES - slack).alias("lo"))
    return q.groupBy("lang", "source").agg(
        *[F.max(F.when(is_(m), F.col("hi"))).alias(f"{m}_max") for m in (*METRICS, *TAIL.values())],
        F.max(F.when(is_("word_length"), F.col("lo"))).alias("word_length_min"),
    )


def verdicts(d: DataFrame) -> DataFrame:
    """Joins thresholds to documents with metrics and adds kept. One line a group is joined, see ``with_line_of``."""
    t = cut(thresholds(sketches(d)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}))
    inside = (F.col("symbol_rate") <= F.col("symbol_rate_max")) & F.col("word_length").between(F.col("word_length_min"), F.col("word_length_max"))
    for m, count in TAIL.items():
        inside = inside & ((F.col(count) <= F.col(f"{count}_max")) | (F.col(m) <= F.col(f"{m}_max")))
    # groups all of whose documents fail the base rules have no thresholds and need none
    joined = with_line_of(d, t, [("lang", "t_lang"), ("source", "t_source")])
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def judged(docs: DataFrame) -> DataFrame:
    """All columns of docs (documents), with the metrics, base_failed and kept.

    The metrics are computed once and stored in the shared folder; the sketches and the
    filter both read them there. Null texts count as empty and fail the base rules; null
    languages and sources are groups of their own; repeated rows are judged alike; an
    empty table gives an empty result. Columns of ``docs`` named like a metric are
    replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS]
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(F.struct(*rest).alias("row"), "lang", "source", "text")
    d = metrics(packed).drop("text")
    d = verdicts(stored(_rates(d.withColumn("base_failed", base_failed())), "rules"))
    return d.select(*[F.col("row").getField(c).alias(c) for c in rest], *own)


def judged_ids(docs: DataFrame) -> DataFrame:
    """As ``judged`` for (doc_id, lang, source), without storing texts."""
    d = metrics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return verdicts(stored(_rates(d.withColumn("base_failed", base_failed())), "rules"))
