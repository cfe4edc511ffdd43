"""Rates over edit and mention counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_rate(hits: Column, substitutions: Column, deletions: Column, insertions: Column, mode: str) -> Column:
    """Errors by all edits and hits, or in ``standard`` mode by the reference's length; of an empty one, its insertions."""
    errors = substitutions + deletions + insertions
    base = hits + substitutions + deletions
    if mode == "standard":
        return F.when(base == 0, insertions.cast("double")).otherwise(errors.cast("double") / F.nullif(base, F.lit(0)))
    return F.when(base + insertions == 0, F.lit(0.0)).otherwise(errors.cast("double") / F.nullif(base + insertions, F.lit(0)))


def plain_error_rate(hits: int, substitutions: int, deletions: int, insertions: int, mode: str) -> float:
    base = hits + substitutions + deletions + (0 if mode == "standard" else insertions)
    return (substitutions + deletions + insertions) / base if base else float(insertions)


def share(part: Column, whole: Column) -> Column:
    """A quotient that is 0 for a whole of 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def half_even(x: Column, digits: int) -> Column:
    """Rounded on the exact binary value, ties to even, as ``round`` and ``bround`` don't."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def classification(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 and preservation_rate (the recall)."""
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), recall.alias("preservation_rate")]
