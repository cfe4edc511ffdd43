"""Best-fit packing of documents into training sequences under several capacities.

A bin holds at most ``capacity`` tokens and ``max_docs`` pieces, and the attention cost of its
pieces, the sum of their squared lengths, is at most ``max_attention``.  A piece's demand and a
bin's residual are vectors of these three, each as a fraction of its capacity.  Pieces go, largest
first, into the open bin that fits under every constraint and has

* the least weighted norm of what it would leave (``rule="norm"``), or
* the greatest weighted dot product of demand and residual (``rule="dot"``);

ties go to the oldest bin, and without a bin that fits a new one opens.  Documents longer than a
bin holds are cut into pieces of the length of which bins can be filled best: as many to a bin as
leave the least of it.

Best fit is sequential, so pieces are hashed to shards of about ``shard_docs``, each packed on
its own.  Rows that repeat an id and pieces of one document go to shards of their own hashes, so none is
larger for them.  A shard leaves a few bins unfilled, whatever the size of the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_type, require, stored, token_count

CAPACITY, MAX_DOCS, MAX_ATTENTION, SHARD = 8192, 64, 8192 * 8192 // 2, 4096


def pack(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Each piece's bin; pieces come largest first, none longer than a bin holds."""
    caps, w = np.array([capacity, max_docs, max_attention], float), np.array(weights, float)
    n = len(lengths)
    left, bins, used = np.empty((3, n)), np.empty(n, np.int64), 0
    demands = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2])
    scale = (np.sqrt(w) / caps)[:, None] if rule == "norm" else (w / caps**2)[:, None]
    for k in range(n):
        d = demands[:, k : k + 1]
        rest = left[:, :used] - d
        fits = np.flatnonzero((rest >= 0).all(0))
        if not len(fits):
            at, used = used, used + 1
            left[:, at] = caps
        elif rule == "norm":
            at = fits[np.argmin(((rest[:, fits] * scale) ** 2).sum(0))]
        else:
            at = fits[np.argmax((left[:, fits] * (d * scale)).sum(0))]
        left[:, at] -= d[:, 0]
        bins[k] = at
    return bins


def piece_length(capacity: int, max_docs: int, max_attention: int) -> int:
    """The length of the pieces of long documents: that of which k fill a bin best, for the least such k."""
    best = (0, 0)
    for k in range(1, max_docs + 1):
        own = min(capacity // k, math.isqrt(max_attention // k))
        if own and k * own > best[0]:
            best = (k * own, own)
        if k * own == capacity:
            break
    return best[1]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_attention: int = MAX_ATTENTION, rule: str = "norm", weights=(1.0, 1.0, 1.0), shard_docs: int = SHARD) -> DataFrame:
    """``(bin_id, doc_id, piece, start, tokens)`` for each piece: the tokens of the document from ``start`` on.

    Tokens are counted by :func:`~.common.token_count`.  Documents without any (NULL, empty, blank)
    have no piece.  Repeated rows are packed each; a NULL id is kept as one.  Documents that a bin holds stay whole, longer
    ones of any length are cut.  Pieces of equal length go by id, then by number.  Ids keep their type.  An empty table gives
    an empty one.  Other columns are ignored, whatever their names.
    """
    require(docs, id_col, text_col)
    longest = min(capacity, math.isqrt(max_attention))
    if longest < 1 or max_docs < 1 or rule not in ("norm", "dot"):
        raise ValueError("capacities must hold a token, and rule be 'norm' or 'dot'")
    part = piece_length(capacity, max_docs, max_attention)
    counted = docs.select(col(docs, id_col).alias("doc_id"), token_count(col(docs, text_col)).alias("tokens")).where("tokens > 0")
    same = stored(counted.groupBy("doc_id", "tokens").agg(F.count("*").alias("copies")), "pack-docs")
    parts = F.when(F.col("tokens") <= longest, F.lit(1)).otherwise(F.ceil(F.col("tokens") / F.lit(part))).cast("long")
    total = same.agg(F.sum(parts * F.col("copies"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_docs))
    cut = (
        same.select("doc_id", "tokens", parts.alias("parts"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .select("doc_id", "tokens", "parts", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("piece"))
        .select(
            "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * part).alias("start"),
            F.when(F.col("parts") == 1, F.col("tokens")).otherwise(F.least(F.col("tokens") - F.col("piece") * part, F.lit(part).cast("long"))).alias("tokens"),
            F.pmod(F.xxhash64(F.lit(29), F.col("doc_id").cast("string"), "tokens", "copy", "piece"), F.lit(shards)).alias("shard"),
        )
    )

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins = pack(np.asarray(table.column("tokens")).astype(np.int64), capacity, max_docs, max_attention, rule, weights)
        where = (np.int64(table.column("shard")[0].as_py()) << 32) + bins
        return pa.table({"bin_id": pa.array(where), **{c: table.column(c) for c in ("doc_id", "piece", "start", "tokens")}})

    return cut.groupBy("shard").applyInArrow(one, f"bin_id long, doc_id {id_type(docs, id_col)}, piece int, start long, tokens long")
