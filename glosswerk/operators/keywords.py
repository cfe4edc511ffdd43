"""Keyword preservation: mentions of each keyword in references and hypotheses.

A keyword's pattern is a literal, so that Java compiles it once a task; it runs only over texts that have
the keyword's first character.  One scan of the pairs counts all keywords, keywords without a mention never
become rows, and only sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, rates

_SUMS = ("reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives")


def mention_counts(pairs: DataFrame, keywords, josa_list: Sequence[str] | None = None, eomi_list: Sequence[str] | None = None) -> DataFrame:
    """``(definition_index, keyword, label, r, h)`` of each pair and keyword with a mention."""
    entries, _ = patterns.definitions(keywords)
    particles = patterns.affixes(josa_list, patterns.PARTICLES, "josa_list")
    endings = patterns.affixes(eomi_list, patterns.ENDINGS, "eomi_list")
    parts = []
    for k, (keyword, label) in enumerate(entries):
        p = F.lit(patterns.keyword_pattern(keyword, particles, endings))
        parts.append(
            F.struct(
                F.lit(k).alias("definition_index"), F.lit(keyword).alias("keyword"), F.lit(label).cast("string").alias("label"),
                *[F.when(F.col(c).contains(patterns.compact(keyword)[0]), F.regexp_count(c, p)).otherwise(0).alias(c[0]) for c in ("reference", "hypothesis")],
            )
        )
    return pairs.select(F.explode(F.filter(F.array(*parts), lambda x: x["r"] + x["h"] > 0)).alias("x")).select("x.*")


def evaluate_keywords(pairs: DataFrame, keywords: str | Sequence[str] | Mapping[str, str | Sequence[str]], josa_list: Sequence[str] | None = None, eomi_list: Sequence[str] | None = None) -> DataFrame:
    """Rows of level ``keyword``, ``label`` (if there are labels) and ``total`` with counts, precision, recall and f1.

    Texts are taken as they are, without normalisation.  ``position`` is the order of keywords and
    of labels by their first keyword.  Keywords that are never mentioned have zeros.
    """
    entries, labelled = patterns.definitions(keywords)
    counted = mention_counts(pairs, keywords, josa_list, eomi_list).groupBy("definition_index").agg(
        F.sum("r").alias("reference_count"), F.sum("h").alias("hypothesis_count"), F.sum(F.least("r", "h")).alias("true_positives"),
        F.sum(F.greatest(F.col("h") - F.col("r"), F.lit(0))).alias("false_positives"), F.sum(F.greatest(F.col("r") - F.col("h"), F.lit(0))).alias("false_negatives"),
    )
    dim = pairs.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(entries)], "definition_index int, keyword string, label string")
    full = dim.join(counted, "definition_index", "left").na.fill(0, list(_SUMS))
    sets = [["keyword"], ["label"], []] if labelled else [["keyword"], []]
    grouped = full.groupingSets(sets, *(["keyword", "label"] if labelled else ["keyword"])).agg(
        F.grouping("keyword").alias("gk"), (F.grouping("label") if labelled else F.lit(1)).alias("gl"),
        F.min("definition_index").alias("position"), *[F.sum(c).alias(c) for c in _SUMS],
    )
    if not labelled:
        grouped = grouped.withColumn("label", F.lit(None).cast("string"))
    level = F.when(F.col("gk") == 0, "keyword").when(F.col("gl") == 0, "label").otherwise("total")
    return grouped.select(
        level.alias("level"), F.coalesce("keyword", "label").alias("name"), F.col("position"), *_SUMS,
        *rates.classification(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")),
    )


def sentence_keyword_errors(pairs: DataFrame, keywords: Sequence[str], josa_list: Sequence[str] | None, eomi_list: Sequence[str] | None = None) -> DataFrame:
    """Sentences that lose a keyword: ``(keyword, total, correct, errors, accuracy, error_rate)``, and the sums with a NULL keyword.

    A keyword counts once a sentence; repeated keywords are one.  Rates have four digits and are 0 for keywords without a sentence.
    """
    words = list(dict.fromkeys(keywords))
    if not words:
        return pairs.sparkSession.createDataFrame([(None, 0, 0, 0, 0.0, 0.0)], "keyword string, total long, correct long, errors long, accuracy double, error_rate double")
    particles = patterns.affixes(josa_list, patterns.PARTICLES, "josa_list")
    has = {w: F.lit(patterns.keyword_pattern(w, particles, eomi_list)) for w in words}
    sums = [F.struct(
        F.lit(w).alias("keyword"),
        F.coalesce(F.sum(F.regexp_like("reference", p).cast("long")), F.lit(0)).alias("total"),
        F.coalesce(F.sum((F.regexp_like("reference", p) & F.regexp_like("hypothesis", p)).cast("long")), F.lit(0)).alias("correct"),
    ) for w, p in has.items()]
    rows = pairs.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    summed = rows.groupBy(F.lit(None).cast("string").alias("keyword")).agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    both = rows.unionByName(summed).withColumn("errors", F.col("total") - F.col("correct"))
    return both.select(
        "keyword", "total", "correct", "errors",
        rates.half_even(rates.share(F.col("correct"), F.col("total")), 4).alias("accuracy"), rates.half_even(rates.share(F.col("errors"), F.col("total")), 4).alias("error_rate"),
    )
