"""SQL functions of this package."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import edit, text
from .operators.corpus import get_cer, get_crr, get_wer
from .sources.transcripts import parse_segments


def register(spark: SparkSession) -> None:
    """Make ``gw_cer``, ``gw_wer``, ``gw_crr``, ``gw_edit_counts`` and the table function ``gw_segments`` known to SQL."""

    def rate(one, key):
        @F.pandas_udf("double")
        def run(r: pd.Series, h: pd.Series) -> pd.Series:
            return pd.Series([None if a is None or b is None else one(a, b)[key] for a, b in zip(r, h)], dtype="float64")

        return run

    for name, one in (("cer", get_cer), ("wer", get_wer), ("crr", get_crr)):
        spark.udf.register(f"gw_{name}", rate(one, name))

    @F.pandas_udf(edit.COUNTS)
    def edit_counts(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = edit.counts_by_batch([None if a is None or b is None else (text.plain_cer_text(a), text.plain_cer_text(b)) for a, b in zip(r, h)])
        return pd.DataFrame(out, columns=["hits", "substitutions", "deletions", "insertions"]).astype("Int64")

    spark.udf.register("gw_edit_counts", edit_counts)

    @F.udtf(returnType="segment int, start string, end string, text string")
    class Segments:
        def eval(self, content: str, source_format: str):
            shown = lambda x: None if x is None else str(x)
            for k, own in enumerate(parse_segments(content, source_format, json_text_policy="segments_fallback")[1]):
                yield k, shown(own.start), shown(own.end), own.text

    spark.udtf.register("gw_segments", Segments)
