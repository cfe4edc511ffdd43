"""Error rates over a stream of sentence pairs, by event-time windows.

Counts of a pair need no state; sums by window do, until the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import measured, summary
from ..options import rate_mode as resolve_mode


def windowed_report(pairs: DataFrame, time_col: str = "ts", window: str = "10 minutes", late: str = "10 minutes", rate_mode: str = "normalized", rm_punctuation: bool = True) -> DataFrame:
    """``(window, utterances, cer, wer)``; pairs later than the watermark are left out."""
    mode = resolve_mode(rate_mode)
    counted = measured(pairs.withWatermark(time_col, late), rm_punctuation)
    return counted.groupBy(F.window(time_col, window)).agg(F.count("*").alias("utterances"), *summary(counted, "cer_counts", mode), *summary(counted, "wer_counts", mode))
