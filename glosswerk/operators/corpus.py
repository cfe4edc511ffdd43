"""Error rates of sentence pairs and of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edit, rates, text
from ..options import rate_mode as resolve_mode
from ..options import unicode_form

_NAMES = ("hits", "substitutions", "deletions", "insertions")


def aligned(references: DataFrame, hypotheses: DataFrame, key: str = "utterance_id") -> DataFrame:
    """Pairs of two tables ``(key, text)``; an utterance on one side only raises an error when the result is read."""
    a, b = references.select(key, F.col("text").alias("reference")), hypotheses.select(F.col(key).alias("__gw_key"), F.col("text").alias("hypothesis"))
    both = a.join(b, a[key] == b["__gw_key"], "full_outer")
    one_sided = F.col(key).isNull() | F.col("__gw_key").isNull()
    checked = F.when(one_sided, F.raise_error(F.lit("references and hypotheses must have the same utterances"))).otherwise(F.col(key))
    return both.select(checked.alias(key), "reference", "hypothesis")


def _strict(c: Column, name: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"{name} must be text"))).otherwise(c)


def measured(pairs: DataFrame, rm_punctuation: bool = True, unicode_normalization: str | None = None, cer: bool = True, wer: bool = True, strict: bool = True) -> DataFrame:
    """``pairs`` with the edit counts ``cer_counts`` and ``wer_counts``; with ``strict`` a NULL text raises an error."""
    form = unicode_form(unicode_normalization)
    r, h = F.col("reference"), F.col("hypothesis")
    if strict:
        r, h = _strict(r, "reference"), _strict(h, "hypothesis")
    out = pairs
    if cer:
        out = out.withColumn("cer_counts", edit.edit_counts(text.cer_text(r, rm_punctuation, form), text.cer_text(h, rm_punctuation, form)))
    if wer:
        out = out.withColumn("wer_counts", edit.edit_counts(text.wer_text(r, rm_punctuation, form), text.wer_text(h, rm_punctuation, form), words=True))
    return out


def _rate(counts: str, mode: str) -> Column:
    return rates.error_rate(*[F.col(f"{counts}.{n}") for n in _NAMES], mode)


def with_metrics(pairs: DataFrame, rm_punctuation: bool = True, rate_mode: str = "normalized", unicode_normalization: str | None = None, strict: bool = True) -> DataFrame:
    """``pairs`` with structs ``cer``, ``wer`` and ``crr`` of ``(value, hits, substitutions, deletions, insertions)``.

    The recognition rate is 1 less the character error rate, to two digits; it can be negative in standard mode.
    """
    mode = resolve_mode(rate_mode)
    out = measured(pairs, rm_punctuation, unicode_normalization, strict=strict)
    struct = lambda value, c: F.struct(value.alias("value"), *[F.col(f"{c}.{n}") for n in _NAMES])
    cer = _rate("cer_counts", mode)
    return out.select(
        *pairs.columns,
        struct(cer, "cer_counts").alias("cer"),
        struct(_rate("wer_counts", mode), "wer_counts").alias("wer"),
        struct(rates.half_even(1 - cer, 2), "cer_counts").alias("crr"),
    )


def summary(counted: DataFrame, counts: str, mode: str) -> list[Column]:
    """Aggregates: micro rate of summed counts, macro mean of rates, and the sums."""
    sums = {n: F.sum(f"{counts}.{n}") for n in _NAMES}
    return [
        F.struct(
            rates.error_rate(*sums.values(), mode).alias("micro"), F.avg(_rate(counts, mode)).alias("macro"), *[c.alias(n) for n, c in sums.items()]
        ).alias(counts.removesuffix("_counts"))
    ]


def corpus_report(pairs: DataFrame, rm_punctuation: bool = True, rate_mode: str = "normalized", unicode_normalization: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each group of ``by``): utterances, cer and wer structs, perfect sentences, sentence error rate.

    A sentence is perfect if it has no character error.  An empty corpus raises an error when read.
    """
    mode = resolve_mode(rate_mode)
    counted = measured(pairs, rm_punctuation, unicode_normalization)
    perfect = F.sum((F.col("cer_counts.substitutions") + F.col("cer_counts.deletions") + F.col("cer_counts.insertions") == 0).cast("long"))
    n = F.count("*")
    counted_n = n if by else F.when(n == 0, F.raise_error(F.lit("a corpus needs a sentence pair"))).otherwise(n)
    return counted.groupBy(*by).agg(
        counted_n.alias("utterances"), *summary(counted, "cer_counts", mode), *summary(counted, "wer_counts", mode),
        perfect.alias("perfect_sentences"), rates.share(n - perfect, n).alias("sentence_error_rate"),
    )


def _one(reference: str, hypothesis: str, words: bool, rm_punctuation: bool, rate_mode: str, unicode_normalization: str | None) -> dict:
    mode, form = resolve_mode(rate_mode), unicode_form(unicode_normalization)
    if words:
        a, b = (text.plain_wer_text(x, rm_punctuation, form).split() for x in (reference, hypothesis))
    else:
        a, b = (text.plain_cer_text(x, rm_punctuation, form) for x in (reference, hypothesis))
    h, s, d, i = edit.counts(a, b)
    return {"value": rates.plain_error_rate(h, s, d, i, mode), "substitutions": s, "deletions": d, "insertions": i}


def get_cer(reference: str, hypothesis: str, rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """The character error rate and edit counts of one pair."""
    out = _one(reference, hypothesis, False, rm_punctuation, rate_mode, unicode_normalization)
    return {"cer": out.pop("value"), **out}


def get_wer(reference: str, hypothesis: str, rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """The word error rate and edit counts of one pair."""
    out = _one(reference, hypothesis, True, rm_punctuation, rate_mode, unicode_normalization)
    return {"wer": out.pop("value"), **out}


def get_crr(reference: str, hypothesis: str, rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """The character recognition rate, to two digits, and edit counts of one pair."""
    out = _one(reference, hypothesis, False, rm_punctuation, rate_mode, unicode_normalization)
    return {"crr": round(1 - out.pop("value"), 2), **out}
