"""Reports of evaluations: metrics, options and fingerprints, without the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators.corpus import with_metrics
from ..options import rate_mode as resolve_mode
from ..options import unicode_form

SCHEMA_VERSION, NAME = "1.0", "glosswerk"


def evaluation_reports(pairs: DataFrame, rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> DataFrame:
    """``pairs`` of ``reference`` and ``transcript`` (or ``hypothesis``) with ``report``, a JSON document.

    Absent values have no key.  The transcript's provenance goes in as ``provenance.source.details``.
    """
    from .. import __version__

    if not isinstance(rm_punctuation, bool):
        raise TypeError("rm_punctuation must be a bool")
    mode, form = resolve_mode(rate_mode), unicode_form(unicode_normalization)
    own = "transcript" in pairs.columns
    rows = pairs.withColumn("hypothesis", F.col("transcript.text")) if own else pairs
    scored = with_metrics(rows, rm_punctuation, mode, form)
    entry = lambda c: F.struct(F.col(f"{c}.value"), F.col(f"{c}.substitutions"), F.col(f"{c}.deletions"), F.col(f"{c}.insertions")).alias(c)
    details = F.when(F.col("transcript.provenance") != "{}", F.parse_json("transcript.provenance")) if own else F.lit(None).cast("variant")
    source = F.struct((F.col("transcript.source_format") if own else F.lit("text")).alias("format"), details.alias("details"))
    report = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.lit(NAME).alias("name"), F.lit(__version__).alias("version")).alias("evaluator"),
        F.struct(F.lit(mode).alias("rate_mode"), F.lit(rm_punctuation).alias("rm_punctuation"), F.lit(form).cast("string").alias("unicode_normalization")).alias("options"),
        F.struct(entry("cer"), entry("wer"), entry("crr")).alias("metrics"),
        F.struct(source.alias("source"), fingerprint(F.col("reference")).alias("reference"), fingerprint(F.col("hypothesis")).alias("hypothesis")).alias("provenance"),
    )
    return scored.withColumn("report", F.to_json(report)).select(*pairs.columns, "report")
