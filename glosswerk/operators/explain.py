"""Alignments of pairs and the frequencies of their errors."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edit, rates, text
from ..options import rate_mode as resolve_mode
from ..options import unicode_form

_UNITS = {"character": False, "char": False, "cer": False, "word": True, "wer": True}
_KINDS = ("equal", "substitute", "delete", "insert")


def by_words(unit: str) -> bool:
    if not isinstance(unit, str):
        raise TypeError("unit must be text")
    if unit.lower() not in _UNITS:
        raise ValueError("unit is 'character' or 'word'")
    return _UNITS[unit.lower()]


def _is(kind: str):
    return lambda edit: edit["type"] == kind


def explain(pairs: DataFrame, unit: str = "character", rm_punctuation: bool = True, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> DataFrame:
    """``pairs`` with processed texts, the alignment, its counts and rate."""
    words, mode, form = by_words(unit), resolve_mode(rate_mode), unicode_form(unicode_normalization)
    clean = text.wer_text if words else text.cer_text
    out = pairs.withColumns({f"processed_{s}": clean(F.col(s), rm_punctuation, form) for s in ("reference", "hypothesis")})
    out = out.withColumn("alignment", edit.edit_alignment(F.col("processed_reference"), F.col("processed_hypothesis"), words))
    for name, kind in zip(("hits", "substitutions", "deletions", "insertions"), _KINDS):
        out = out.withColumn(name, F.size(F.filter("alignment", _is(kind))).cast("long"))
    return out.withColumn("rate", rates.error_rate(*map(F.col, ("hits", "substitutions", "deletions", "insertions")), mode))


def error_frequencies(explained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(type, reference, hypothesis, count, rank)`` of a result of :func:`explain`, most frequent first, then by token.

    Errors are ranked within (type, count, the reference's first two characters); those before come from the sizes of such
    parts, a small table.  So no task sorts all errors of a type.
    """
    errors = explained.select(*by, F.explode("alignment").alias("e")).where("e.type <> 'equal'").select(*by, "e.type", "e.reference", "e.hypothesis")
    head = F.substring("reference", 1, 2).alias("head")
    counted = errors.groupBy(*by, "type", "reference", "hypothesis").agg(F.count("*").alias("count")).select("*", head)
    part = [*by, "type", "count", "head"]
    sizes = counted.groupBy(*part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by, "type").orderBy(F.desc("count"), "head").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("reference", "hypothesis"))
    placed = counted.withColumn("own", own).alias("a").join(sizes.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in part])
    return placed.select(*[F.col(f"a.{c}") for c in [*by, "type", "reference", "hypothesis", "count"]], (F.col("b.before") + F.col("a.own")).cast("int").alias("rank"))


def explain_errors(reference: str, hypothesis: str, unit: str = "character", rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """The explanation of one pair as nested dicts and lists."""
    words, mode, form = by_words(unit), resolve_mode(rate_mode), unicode_form(unicode_normalization)
    clean = text.plain_wer_text if words else text.plain_cer_text
    shown = [clean(x, rm_punctuation, form) for x in (reference, hypothesis)]
    steps = edit.alignment(*[x.split() if words else x for x in shown])
    h, s, d, i = (sum(x[0] == kind for x in steps) for kind in _KINDS)
    ranked = lambda kind, pick: sorted(Counter(pick(x) for x in steps if x[0] == kind).items(), key=lambda x: (-x[1], x[0]))
    return {
        "metric": "wer" if words else "cer",
        "unit": "word" if words else "character",
        "rate_mode": mode,
        "rate": rates.plain_error_rate(h, s, d, i, mode),
        "processed_reference": shown[0],
        "processed_hypothesis": shown[1],
        "counts": {"hits": h, "substitutions": s, "deletions": d, "insertions": i},
        "alignment": [{"type": x[0], "reference": x[1], "hypothesis": x[2]} for x in steps],
        "error_frequencies": {
            "substitutions": [{"reference": a, "hypothesis": b, "count": n} for (a, b), n in ranked("substitute", lambda x: x[1:3])],
            "deletions": [{"reference": a, "count": n} for a, n in ranked("delete", lambda x: x[1])],
            "insertions": [{"hypothesis": b, "count": n} for b, n in ranked("insert", lambda x: x[2])],
        },
    }
