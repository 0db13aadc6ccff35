"""Quality rules with thresholds that adapt to language and source.

Each text gets a fixed set of base measures.  Four ratios of them are summarised per
(language, source) by a quantile sketch with relative accuracy: a value's bucket is the
rounded-up logarithm of the value, and a sketch is the count of each bucket.  Sketches
merge by adding counts, so they are built with partial aggregation, cost one row per
bucket, and give the same thresholds whatever the partitioning or a task's retry.
The language's sketch is the sum of its sources' sketches; a source's quantile is pulled
towards its language's by the number of its documents, so small sources are judged by
their language.  A document is rejected by a ratio beyond the outer fence
(upper quartile + ``spread`` times the interquartile range).  The range is at least that
of ``RATIOS``, which decides where three quarters of a group have the same value.  Ratios of few
words vary more: below ``STEADY_WORDS`` words the fence is wider by the root of
``STEADY_WORDS`` / words.  Repeated words have the base rule alone: texts labelled as good
reach its cutoff, so a fence below it would reject them and one above it nothing.

Defined cases: a null or empty text has zero words and fails the base rule; null
languages and sources are groups of their own; repeated rows are judged each; extra
columns are carried along, and those with a name that this operator adds are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raremetrics.llm import common, grams

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same_words")
#: Ratio, least interquartile range, whether values far below are rejected too.
RATIOS = (("symbol_ratio", 0.01, False), ("word_length", 0.1, True),
          ("dup_line_ratio", 0.01, False), ("same_word_ratio", 0.005, False))
STEADY_WORDS = 200
ACCURACY = 0.01
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Base measures of each text; equality of lines and word windows is that of 64-bit hashes."""
    hashed = grams.Hashed(buf)
    start, end, first = grams.words(buf, off)
    n = len(off) - 1
    inside = ~grams.SPACE[buf]
    out = {"n_words": np.diff(first),
           "word_chars": grams.per_text(inside & ((buf & 0xC0) != 0x80), off),
           "n_symbols": grams.per_text(SYMBOLS[buf], off)}

    line_start, line_end = grams.spans(buf != 10, off)
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    own = np.searchsorted(off, line_start, "right") - 1
    _, at = np.unique(grams.keyed(own, hashed.of(line_start, line_end)), return_index=True)
    out["n_dup_lines"] = np.bincount(own, minlength=n) - np.bincount(own[at], minlength=n)

    word = hashed.of(start, end)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < len(word)]] = False
    out["n_same_words"] = grams.per_text(same, first)

    pos, text, h = grams.windows(word, first, WINDOW)
    _, group, count = np.unique(grams.keyed(text, h), return_inverse=True, return_counts=True)
    change = np.zeros(len(start) + 1, np.int64)
    again = pos[count[group] > 1]
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    out["n_repeat_words"] = grams.per_text(np.cumsum(change)[:-1] > 0, first)
    return out


def with_measures(docs: DataFrame, text: bool = False) -> DataFrame:
    """``docs`` with the base measures as long columns and ``base_failed``; with the text only if ``text``."""
    added = (*MEASURES, "base_failed", "kept")
    carried = [c for c in docs.columns if c not in added and (text or c != "text")]
    schema = docs.select(*carried).schema
    for name in MEASURES:
        schema = schema.add(name, "long")

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                values = measure(buf, off)
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried]
                arrays += [pa.array(values[m], pa.int64()) for m in MEASURES]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *MEASURES])

    measured = docs.select(*carried, *([] if text else ["text"])).transform(common.in_tasks, run, schema)
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                               | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def _ratio(name: str) -> Column:
    per = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / per, "word_length": F.col("word_chars") / per,
            "dup_line_ratio": F.col("n_dup_lines") / per,
            "same_word_ratio": F.col("n_same_words") / per}[name]


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): mergeable quantile sketches of the texts that pass the base rule."""
    log_gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("x")) for r, _, _ in RATIOS]))
    return (measured.filter(~F.col("base_failed")).select("lang", "source", values.alias("v"))
            .select("lang", "source", "v.ratio",
                    F.when(F.col("v.x") > 0, F.ceil(F.log(F.col("v.x")) / log_gamma)).alias("bucket"))
            .groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n")))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lower and upper quartile and count of each sketch; zero values have the null bucket."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    rows = Window.partitionBy(*keys, "ratio").orderBy(F.col("bucket").asc_nulls_first())
    value = F.coalesce(2 * F.pow(F.lit(gamma), F.col("bucket").cast("double")) / (gamma + 1), F.lit(0.0))
    at = merged.select(*keys, "ratio", value.alias("x"), F.sum("n").over(rows).alias("upto"),
                       F.sum("n").over(Window.partitionBy(*keys, "ratio")).alias("total"))
    return at.groupBy(*keys, "ratio").agg(
        F.min(F.when(F.col("upto") >= 0.25 * F.col("total"), F.col("x"))).alias("q1"),
        F.min(F.when(F.col("upto") >= 0.75 * F.col("total"), F.col("x"))).alias("q3"),
        F.max("total").alias("total"))


def thresholds(sketch: DataFrame, spread: float = 6.0, prior: float = 200.0) -> DataFrame:
    """One row per (lang, source): lower and upper bound of each ratio, and the width of its fence.

    ``prior`` is the number of documents at which a source's own quartiles weigh as much
    as its language's.
    """
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(sketch, ["lang"]).select(
        F.col("lang").alias("lang_"), F.col("ratio").alias("ratio_"), F.col("q1").alias("q1_"), F.col("q3").alias("q3_"))
    both = own.join(lang, own.lang.eqNullSafe(lang.lang_) & (own.ratio == lang.ratio_))
    share = F.col("total") / (F.col("total") + F.lit(prior))
    both = both.select("lang", "source", "ratio", (share * F.col("q1") + (1 - share) * F.col("q1_")).alias("q1"),
                       (share * F.col("q3") + (1 - share) * F.col("q3_")).alias("q3"))
    least = F.create_map(*[F.lit(x) for r, width, _ in RATIOS for x in (r, width)])[F.col("ratio")]
    width = F.lit(spread) * F.greatest(F.col("q3") - F.col("q1"), least)
    both = both.select("lang", "source", "ratio", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"), width.alias("width"))
    columns = []
    for r, _, two_sided in RATIOS:
        columns.append(F.max(F.when(F.col("ratio") == r, F.col("width"))).alias(f"wid_{r}"))
        columns.append(F.max(F.when(F.col("ratio") == r, F.col("high"))).alias(f"max_{r}"))
        if two_sided:
            columns.append(F.max(F.when(F.col("ratio") == r, F.col("low"))).alias(f"min_{r}"))
    return both.groupBy("lang", "source").agg(*columns)


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` with ``kept``, by the bounds of each row's language and source."""
    names = [c for c in bounds.columns if c[:4] in ("min_", "max_")]
    rule = dict(zip(bounds.columns, common.fresh(measured.columns, *(f"rule_{c}" for c in bounds.columns)), strict=True))
    bounds = bounds.withColumnsRenamed(rule)
    joined = measured.join(bounds, measured.lang.eqNullSafe(bounds[rule["lang"]])
                           & measured.source.eqNullSafe(bounds[rule["source"]]), "left")
    within = F.lit(True)
    wider = F.greatest(F.sqrt(STEADY_WORDS / F.greatest(F.col("n_words"), F.lit(1))), F.lit(1.0)) - 1
    for name in names:
        value, bound, more = _ratio(name[4:]), F.col(rule[name]), wider * F.col(rule[f"wid_{name[4:]}"])
        within &= F.coalesce(value <= bound + more if name.startswith("max_") else value >= bound - more, F.lit(True))
    return joined.select(*measured.columns, (~F.col("base_failed") & within).alias("kept"))


def quality_rules(docs: DataFrame, spread: float = 6.0, prior: float = 200.0) -> DataFrame:
    """``docs`` without the text, with the base measures, ``base_failed`` and ``kept``."""
    measured = common.materialise(with_measures(docs), "quality-measures")
    return judged(measured, thresholds(sketches(measured), spread, prior))


def filtered(docs: DataFrame, spread: float = 6.0, prior: float = 200.0) -> DataFrame:
    """The documents that the rules keep.  Texts are measured twice rather than shuffled."""
    bounds = common.materialise(thresholds(sketches(with_measures(docs)), spread, prior), "quality-bounds")
    return judged(with_measures(docs, text=True), bounds).filter("kept").select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept")
