"""Links between the members of the same cells, counted once each and reduced to spanning forests.

Candidates of a similarity join are nodes that share a cell of one of several grids.  Cells without a
second member are dropped before any signature travels.  A cell of more than ``split`` members is cut into
parts by a hash, and every pair of parts is a group of its own, so that no task holds more than
two parts however hot a cell is.  Within a group pairs are compared in blocks; of the pairs that
hold only a spanning forest leaves the task, with each node's number of links.  A pair that an
earlier grid has brought together isn't counted again: ``earlier`` gives the members' cells in the grids before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SPLIT, _BLOCK = 4096, 256
Near = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Earlier = Callable[[int, np.ndarray], list[np.ndarray]]


def union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j, pair by pair; every entry is its root afterwards."""
    while True:
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])


def group_links(grid: int, within: bool, right: np.ndarray, sigs: np.ndarray, near: Near, earlier: Earlier) -> tuple[np.ndarray, np.ndarray]:
    """Each member's root in the forest and its number of new links; pairs are of any two members if ``within``, or else of a left and a right one."""
    n = len(sigs)
    parent, links = np.arange(n), np.zeros(n, np.int64)
    left, other = np.flatnonzero(~right), np.flatnonzero(right)
    codes = None
    for lo in range(0, len(left), _BLOCK):
        own = left[lo : lo + _BLOCK]
        against = left[lo:] if within else other
        i, j = near(sigs[own], sigs[against])
        i, j = own[i], against[j]
        if within:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        union(parent, i, j)
        if codes is None:
            codes = earlier(grid, sigs)
        new = np.ones(len(i), bool)
        for code in codes:
            new &= code[i] != code[j]
        links += np.bincount(i[new], minlength=n) + np.bincount(j[new], minlength=n)
    return parent, links


def _links(batches, near: Near, earlier: Earlier):
    """Rows come sorted by grid, cell and parts; a group may span batches."""
    key, held = None, []

    def flush():
        right, node = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        sigs = np.concatenate([h[2] for h in held])
        parent, links = group_links(int(key[0]), key[2] == key[3], right, sigs, near, earlier)
        at, some = np.flatnonzero(parent != np.arange(len(parent))), np.flatnonzero(links)
        return np.concatenate([node[at], node[some]]), np.concatenate([node[parent[at]], node[some]]), np.concatenate([np.zeros(len(at), np.int64), links[some]])

    def out(found):
        a, b, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "links"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)], 1)
        right, node = np.asarray(batch.column(4).cast(pa.int8())).astype(bool), np.asarray(batch.column(5))
        raw = b"".join(batch.column(6).to_pylist())
        sigs = np.frombuffer(raw, np.uint8).reshape(len(node), -1)
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            now = tuple(keys[lo].tolist())
            if now != key:
                if sum(len(h[1]) for h in held) > 1:
                    found.append(flush())
                key, held = now, []
            held.append((right[lo:hi].copy(), node[lo:hi].copy(), sigs[lo:hi].copy()))
        yield out(found)
    if sum(len(h[1]) for h in held) > 1:
        yield out([flush()])


def links(cells: DataFrame, near: Near, earlier: Earlier, nodes: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """``(a, b, links)`` from ``(grid, cell, node, sig)``: edges of forests, with a <> b, and numbers of links, with a = b.

    With ``nodes(node, sig)`` the cells come without signatures, which are joined to what shares a
    cell.  An empty table gives an empty one.
    """
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.select("grid", "cell", F.ceil(F.col("n") / split).cast("int").alias("parts")), "cells")
    shared = cells.join(sizes, ["grid", "cell"])
    if nodes is not None:
        shared = shared.join(nodes.select("node", "sig"), "node")
    own = F.pmod(F.xxhash64("node", "grid"), F.col("parts")).cast("int")
    parted = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = parted.select(
        "grid", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("right"), "node", "sig"
    )
    # With own = other = x = y no member is right; a part meets itself only there.
    return stored(
        rows.repartition("grid", "cell", "x", "y").sortWithinPartitions("grid", "cell", "x", "y")
        .mapInArrow(lambda b: _links(b, near, earlier), "a long, b long, links long"),
        "links",
    )
