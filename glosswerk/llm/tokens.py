"""Token counts by a separator scan over flat token files.

A token file is a run of little-endian token identifiers without an index; a document ends with an
end-of-document identifier.  Files are cut into blocks of equal size, and a block is searched for
the identifier by one vectorised comparison.  A block tells how many documents end in it, the tokens
after its last end, and where the ends are.  A prefix scan over the
blocks of a file then numbers the documents and stitches the one that spans a boundary: it begins
after the last end of all the blocks before the one where it ends.  Only the blocks' few numbers
are in that scan, however many documents a file has.

:func:`write` makes such files from documents with a public byte-pair vocabulary.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, id_type, require, slices, slim, stored

VOCABULARY, EOD, BLOCK_TOKENS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 1 << 22
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(vocabulary: str = VOCABULARY, eod: int = EOD) -> dict[bytes, int]:
    """The ranks of a vocabulary file; ValueError if identifiers don't fit 16 bits or one of them is ``eod``."""
    with open(vocabulary, "rb") as lines:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(*found.values(), eod) > 0xFFFF or eod in found.values():
        raise ValueError("identifiers must fit 16 bits, and none be that of the end of a document")
    return found


def encoder(found: dict[bytes, int] | None = None):
    """The tokenizer of ranks: ``encoder(...)(text)`` gives identifiers; special tokens' names are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found or ranks(), special_tokens={}).encode_ordinary


def _open(path: str):
    if "://" not in path and ":/" not in path:
        path = "file://" + path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))


def _written(batches, folder: str, shipped, eod: int):
    encode = encoder(shipped.value)
    path = f"{folder}/{uuid.uuid4().hex}.tokens"
    fs, inner = _open(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    number = 0
    with fs.open_output_stream(inner) as out:
        for batch in slices(batches, 64):
            first = number
            for text in batch.column(1).to_pylist():
                ids = encode(text) if text else []
                ids.append(eod)
                out.write(np.array(ids, "<u2").tobytes())
                number += 1
            n = number - first
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(first, number)), batch.column(0)], ["file", "document", "doc_id"])


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """Write token files of 16-bit identifiers to a shared folder and give ``(file, document, doc_id)``.

    The vocabulary is read where the driver runs and goes to the tasks by value.  NULL and empty texts are documents without
    tokens.  The result is stored: a task that is run again writes another file, and only the files that the result names count.
    """
    rows, shipped = slim(docs, id_col, text_col), docs.sparkSession.sparkContext.broadcast(ranks(vocabulary, eod))
    return stored(rows.mapInArrow(lambda b: _written(b, folder, shipped, eod), f"file string, document long, doc_id {id_type(docs, id_col)}"), "token-order")


def _blocks(batches, block: int, width: int):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = _open(path)
            size = fs.get_file_info(inner).size
            if size is None or size % width:
                raise ValueError(f"{path} isn't a whole number of tokens")
            offsets = list(range(0, size // width, block)) or [0]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets)), pa.array(offsets, pa.int64())], ["file", "offset"])


def _scanned(batches, block: int, width: int, eod: int):
    for batch in batches:
        for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, inner = _open(path)
            with fs.open_input_file(inner) as source:
                ids = np.frombuffer(source.read_at(block * width, offset * width), f"<u{width}")
            ends = np.flatnonzero(ids == eod) + offset
            row = [[path], [offset], [len(ids)], [len(ends)], [int(ends[-1]) + 1 if len(ends) else None], [ends]]
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["file", "offset", "n", "documents", "after", "ends"])


def scan(files: DataFrame, eod: int = EOD, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, document, start, tokens)`` for each document of ``files(file)``: its number in the file, its first token, its length.

    The separator doesn't count.  Two in a row make a document of no tokens.  Tokens after the last
    separator are a document too; an empty file has none.  NULL and repeated paths count once at most, and
    an empty table gives an empty one.  Files and documents may be of any length.
    """
    require(files, "file")
    if width not in (1, 2, 4, 8) or block < 1:
        raise ValueError("width must be 1, 2, 4 or 8 bytes and block positive")
    spark = files.sparkSession
    paths = files.select("file").where("file IS NOT NULL").distinct()
    cuts = paths.mapInArrow(lambda b: _blocks(b, block, width), "file string, offset long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(
        cuts.repartition(parts, "file", "offset")
        .mapInArrow(lambda b: _scanned(b, block, width, eod), "file string, offset long, n long, documents long, after long, ends array<long>"),
        "token-blocks",
    )
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    prefix = blocks.select("file", "offset", "documents", "after").select(
        "file", "offset", F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("after").over(before), F.lit(0)).alias("since"),
        (F.max("offset").over(whole) == F.col("offset")).alias("final"),
    )
    at = blocks.join(prefix, ["file", "offset"])
    size = F.col("offset") + F.col("n")
    ends = F.when(F.col("final") & (size > F.coalesce("after", "since")), F.concat("ends", F.array(size))).otherwise(F.col("ends"))
    at = at.select("file", "first", "since", ends.alias("ends"))
    starts = F.transform("ends", lambda x, i: F.when(i == 0, F.col("since")).otherwise(F.get("ends", i - 1) + 1))
    found = at.select("file", "first", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("k", "x"))
    return found.select("file", (F.col("first") + F.col("k")).alias("document"), F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("tokens"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, eod: int = EOD, block: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, document, start, tokens)``, by writing token files and scanning them.

    ``document`` and ``start`` are the document's number and first token in its file.  Each row of
    ``docs`` gives one, with a NULL id too; NULL and empty texts have 0 tokens.  Ids keep their type.  An empty
    table gives an empty one; texts of any length are read whole; other columns are ignored, whatever their names.
    """
    order = write(docs, fresh_path(docs.sparkSession, "tokens"), id_col, text_col, vocabulary, eod)
    return order.join(scan(order.select("file"), eod, 2, block), ["file", "document"]).select("doc_id", "document", "start", "tokens")


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """``(file)`` of a folder's token files."""
    fs, inner = _open(folder)
    found = [x.path for x in fs.get_file_info(pafs.FileSelector(inner)) if x.is_file]
    return spark.createDataFrame([(folder.rstrip("/") + "/" + p.rsplit("/", 1)[1],) for p in found], "file string")
