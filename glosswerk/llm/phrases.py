"""Document fingerprints from Lempel-Ziv phrases.

A document's words are parsed as in LZ78: each phrase is the shortest run of words that isn't a
phrase yet.  (Over bytes the parse takes long to find back after an edit, and near copies of short
documents look unlike.)  The set of its phrases is hashed, and its minimum-hash signature holds the least hash
of each of ``BINS`` bins, a byte of it.  The share of bins in which two signatures agree estimates
the Jaccard similarity of the phrase sets, a measure of how well one text helps to compress the
other (Lempel-Ziv Jaccard distance).

Documents of equal signatures are one node.  Others meet if one of ``BINS / ROWS`` bands of their
signatures is equal; there signatures are compared in full, and pairs of at least the least
similarity are linked; :mod:`.cells` splits large bands and hands on forests and numbers of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import SPLIT, links
from .common import id_type, slices, slim, stored, words
from .components import components

BINS, ROWS, LEAST = 64, 4, 0.65
_MIX = 0x9E3779B97F4A7C15


def parse(tokens: list[bytes]) -> set[bytes]:
    """The phrases, their words parted by blanks; a rest that is a phrase already isn't one more."""
    seen: set[bytes] = set()
    add, phrase = seen.add, b""
    for word in tokens:
        phrase = phrase + b" " + word if phrase else word
        if phrase not in seen:
            add(phrase)
            phrase = b""
    return seen


def signature(hashes: np.ndarray) -> bytes:
    """The least hash of each bin, as a byte; an empty bin takes that of the next one that isn't."""
    place = (hashes >> np.uint64(58)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, hashes & np.uint64((1 << 58) - 1))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    if len(full) < BINS:
        source = full[np.searchsorted(full, np.arange(BINS)) % len(full)]
        far = (np.arange(BINS) != source).astype(np.uint64)
        least = least[source] + far * (np.arange(BINS, dtype=np.uint64) - source.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((least * np.uint64(_MIX)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(batches):
    for batch in slices(batches):
        count, found = [], []
        for text in batch.column(1).to_pylist():
            own = parse(words(text))
            count.append(len(own))
            found.append(signature(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))) if own else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "phrases", "signature"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, phrases, signature)`` for each row; NULL, empty and wordless texts have no phrases and a NULL signature."""
    rows = slim(docs, id_col, text_col)
    return rows.mapInArrow(_signatures, f"doc_id {id_type(docs, id_col)}, phrases long, signature binary")


def similarity(agree):
    """From the share of bins that agree; a byte agrees by chance once in 256."""
    return (agree - 1 / 256) / (1 - 1 / 256)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of the pairs of signatures of at least the least similarity."""
    same, over, across = np.zeros((len(a), len(b)), np.uint8), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for k in range(BINS):
        same += over[k][:, None] == across[k][None]
    return np.nonzero(similarity(same / BINS) >= least)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, split: int = SPLIT) -> DataFrame:
    """``(doc_id, phrases, fingerprint, group_id, similarity, links)`` for each distinct document id and signature.

    ``fingerprint`` is the signature in hexadecimal; ``group_id`` is the least doc_id of the
    documents linked by similar signatures, and ``similarity`` the estimate for the two.  ``links`` is the
    number of other signatures found at least as similar as ``least``; documents of equal signatures have the same.
    NULL, empty and wordless texts have a NULL fingerprint and are their own group with a NULL similarity and no links; so are rows
    with a NULL id, whose group is NULL.  Repeated rows give one row.  Of an id with several texts
    each is placed; if the group's least id has several in it, that of the least signature is compared with.  Ids keep
    their type.  An empty table gives an empty one; very long texts are read whole.  Other columns are ignored, whatever their names.
    """
    signed = stored(signatures(docs, id_col, text_col).distinct(), "phrases")
    ided = signed.where("signature IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(ided.groupBy("signature").agg(F.min("doc_id").alias("own")).withColumn("node", F.monotonically_increasing_id()), "phrases-nodes")
    bands = [F.xxhash64(F.substring("signature", 1 + k, ROWS)) for k in range(0, BINS, ROWS)]
    cells = nodes.select(F.posexplode(F.array(*bands)).alias("grid", "cell"), "node")

    def earlier(grid, sigs):
        return [np.ascontiguousarray(sigs[:, k * ROWS : (k + 1) * ROWS]).view(f"u{ROWS}")[:, 0] for k in range(grid)]

    found = links(cells, lambda a, b: alike(a, b, least), earlier, nodes.select("node", F.col("signature").alias("sig")), split)
    roots = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = nodes.join(roots, nodes["node"] == roots["id"], "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min(F.struct("own", "signature")).alias("head"))
    agree = F.lit(0)
    for k in range(BINS):
        agree = agree + (F.substring("signature", k + 1, 1) == F.substring("head.signature", k + 1, 1)).cast("int")
    grouped = placed.join(heads, "root").join(counts, "node", "left").select(
        "signature", F.col("head.own").alias("head"), similarity(agree / F.lit(float(BINS))).alias("similarity"), "links"
    )
    alone = F.col("doc_id").isNull() | F.col("signature").isNull()
    return signed.join(grouped, "signature", "left").select(
        "doc_id", "phrases", F.lower(F.hex("signature")).alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head")).alias("group_id"),
        F.when(~alone, F.col("similarity")).alias("similarity"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("links"),
    )
