"""Connected components of an edge list, by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import union
from .common import made, remove, stored

#: Edges, 16 bytes each, that are joined on the driver: for so few a round of jobs costs more than the whole.
LOCAL = 10_000


def components(edges: DataFrame, rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """``(id, root)`` for each id in ``edges(a, b)``: root is the least id of its component.

    Every round links neighbours to a node's least neighbour: first the larger ones, then the
    smaller ones and the node itself.  Both steps keep connectivity; they end in stars.  Each
    round's table is written to the shared folder, so a lost executor costs one round, and those
    before it are removed.  Self-loops and repeated edges are harmless, rows with NULL are left
    out; an empty table gives an empty table.  No more than ``local`` edges are joined on the driver, with the same result.  More rounds than ``rounds`` raise RuntimeError
    (they grow as the logarithm of the longest path).
    """
    spark, before = edges.sparkSession, len(made())
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    if mark[0] <= local:
        table = now.toArrow()
        u, v = (np.asarray(table.column(c)) for c in ("u", "v"))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = np.arange(len(ids))
        union(parent, at[: len(u)], at[len(u) :])
        return spark.createDataFrame(pa.table({"id": ids, "root": ids[parent]})) if len(ids) else spark.createDataFrame([], "id long, root long")
    for _ in range(rounds if mark[0] else 0):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        now = stored(small, "edges")
        remove(spark, [p for p in made()[before:-1] if "/edges-" in p])
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
