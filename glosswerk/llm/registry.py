"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, lines, mixing, packing, phrases, secrets, simhash, tokens, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_templates": lambda s, d: urls.templates(_table(s, d, "pages"), urls.document_labels(_table(s, d, "labels"))),
        "op2_packing": lambda s, d: packing.packed(_table(s, d, "documents")),
        "op3_mixing": lambda s, d: mixing.mix(_table(s, d, "documents")),
        "op4_token_counts": lambda s, d: tokens.token_counts(_table(s, d, "documents")),
        "op5_simhash": lambda s, d: simhash.decisions(_table(s, d, "documents")),
        "op6_phrase_fingerprints": lambda s, d: phrases.fingerprints(_table(s, d, "documents")),
        "op7_secret_scan": lambda s, d: secrets.document_secrets(_table(s, d, "documents")),
        "op8_neighbours": lambda s, d: ann.neighbours(_table(s, d, "embeddings")),
        "op9_toxicity": lambda s, d: toxicity.toxicity(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_line_dedup": lambda s, d: lines.repeated_lines(_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_templates": urls.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op7_secret_scan": secrets.ORACLE_SQL,
        "op10_line_dedup": lines.ORACLE_SQL,
    }
