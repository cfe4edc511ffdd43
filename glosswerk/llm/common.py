"""Helpers shared by the training-data operators.

Tokens: :func:`words` lower-cases a text, turns ASCII punctuation and control
characters into blanks and splits on blanks.  Digits count as word characters.
Of scripts that are written without blanks each character is a word.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters and digits stay, other ASCII bytes part words, other bytes stay.
_TABLE = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

#: Thai and Lao, Burmese, Khmer, kana and Chinese characters: written without blanks between words.
DENSE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFD))
_DENSE = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in DENSE) + "])")
_HIGH = bytes(range(0xE0, 0x100))

#: Rows of an Arrow batch that are taken at a time.
_SLICE_ROWS = 512


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; none for NULL, empty or blank texts."""
    if not text:
        return []
    low = text.lower()
    raw = low.encode("utf-8", "surrogatepass")
    if len(raw) != len(text) and len(raw.translate(None, _HIGH)) != len(raw):
        raw = _DENSE.sub(r" \1 ", low).encode("utf-8", "surrogatepass")
    return raw.translate(_TABLE).split()


def slices(batches, rows: int = _SLICE_ROWS):
    """Arrow batches in slices of few rows, so that long texts don't pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``, or that of ``setCheckpointDir``; in local mode without either, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="glosswerk-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths in the shared folder that this process made and hasn't removed.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs no more than reading."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The paths that :func:`stored` and others made so far."""
    return list(_made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that no result still reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _made:
            _made.remove(path)


def col(df: DataFrame, name: str) -> Column:
    """A column by its very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def cols(df: DataFrame) -> list[Column]:
    """All columns, in order."""
    return [col(df, c) for c in df.columns]


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def id_type(df: DataFrame, id_col: str) -> str:
    """The type of the id column, as DDL."""
    return df.schema[id_col].dataType.simpleString()


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)``: the id in its own type, the text as a string."""
    require(docs, id_col, text_col)
    return docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).cast("string").alias("text"))


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError for missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def md5_long(*columns: Column | str) -> Column:
    """A 60-bit hash of the columns' texts that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Tokens of a text, taken as its runs of anything but ASCII blanks; 0 for NULL."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")
