"""A training corpus from raw documents, in stages; each takes (spark, docs, sf_dir) and gives a DataFrame.

Every stage's result is written as Parquet to the shared folder and reread as the next one's input,
so a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswerk.llm import lines, mixing, packing, simhash, toxicity
from glosswerk.llm.common import made, remove, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon finds toxic go.

    Rows with a NULL id or text, empty texts and all rows of an empty table stay; repeated rows go or stay alike.  Without labels none goes.
    """
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing else is left.

    Equal lines go at any length, near ones from 5 words on: of shorter ones an edit is a quarter or more.
    Rows with a NULL id or text and empty texts stay as they are; of repeated rows each loses the same lines.
    """
    kept = lines.drop_lines(docs)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays.

    Line dedup leaves of a near copy the lines in which it differs, which resemble nothing any more.  So
    documents that are still there are compared as they came, whole, too: first the near copies among these go,
    then those among the texts as they are now.  Rows with a NULL id or without words stay; each text of an id
    goes or stays on its own.
    """
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.near_dedup(docs, away=simhash.copies_as_came(docs, whole))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their tempered weights; a document may come more than once.

    NULL is a source; documents without tokens ride along; rows of the same id are drawn together; an empty table stays empty.
    """
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into training sequences.

    Documents without tokens have no piece; repeated rows and copies are packed each; documents longer than a bin are cut.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can express neither the lexicon's walks nor fingerprints; the tests hold the stages' results against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote in between is removed once its result is written, and so is its input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        remove(spark, [p for p in made()[:-1] if p not in before])
    return docs
