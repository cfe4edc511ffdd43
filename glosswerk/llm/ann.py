"""Approximate nearest neighbours: an inverted file of product-quantised residuals.

Coarse centroids part the vectors into lists; a vector is coded by its residual to its list's
centroid, a byte for each of ``m`` subspaces.  A query probes the lists of its nearest centroids;
its distances to their members come from tables of its residuals' distances to the code words, and
the best of them are reranked by exact distance.  Queries are the vectors whose id is divisible by
``every``; all vectors are indexed and searched.

Centroids and code words are trained by Lloyd's iterations on a sample of about ``train`` vectors, those of the
least hashes, in one task; it bounds their number, which is what travels to the tasks.  There are about as many lists as
the square root of the number of vectors, of ``LIST`` members or more, and no more than a 32nd of the sample.

How many lists a query probes is measured, not set: true neighbours of ``sample`` vectors are found
by comparing them with all others, and as many lists are probed as hold the share ``recall`` of them.

Members move once.  Lists are grouped to ``chunk`` members, larger ones are split by a hash, and a
query goes to each group that holds one of its lists, once.  Groups that more than ``_SLICE``
queries ask are repeated, so that no task holds more than a group and a slice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, require, stored

K, RECALL, RERANK, CHUNK, EVERY, TRAIN, LIST = 10, 0.97, 64, 8192, 20, 131_072, 512

_SLICE, _BLOCK = 32_768, 256


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat).astype(np.float32).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of x to all of y."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * (x @ y.T) + (y**2).sum(1), 0)


def nearest_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x the place of the nearest row of y."""
    half = (y**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(half - x[lo : lo + 4096] @ y.T).argmin(1) for lo in range(0, len(x), 4096)]])


def lloyd(x: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after some rounds; one that loses all its rows stays where it is."""
    now = start.astype(np.float32).copy()
    for _ in range(rounds):
        at = nearest_rows(x, now)
        order = np.argsort(at, kind="stable")
        full, first = np.unique(at[order], return_index=True)
        count = np.diff(np.r_[first, len(x)])
        now[full] = np.add.reduceat(x[order].astype(np.float64), first, 0) / count[:, None]
    return now


def trained(x: np.ndarray, lists: int, m: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids, and code words for the residuals: subspace x word x dimension."""
    coarse = lloyd(x, x[:lists], rounds)
    rest = x - coarse[nearest_rows(x, coarse)]
    return coarse, np.stack([lloyd(part, part[:256], rounds) for part in np.split(rest, m, 1)])


def train_index(vectors: DataFrame, n: int, dim: int, lists: int, m: int, rounds: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`trained` on a sample of about ``bound`` of n vectors, in one task."""
    some = vectors.select("vec_id", "embedding")
    if n > bound:
        some = some.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * bound / n))

    def fit(batches):
        tables = [b for b in batches if b.num_rows]
        ids, x = np.concatenate([np.asarray(b.column(0)) for b in tables]), np.concatenate([_matrix(b.column(1)) for b in tables])
        order = np.random.default_rng(5).permutation(len(ids))
        coarse, words = trained(x[np.argsort(ids)][order], lists, m, rounds)
        rows = [coarse.ravel(), *[w.ravel() for w in words]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.float32()))], ["k", "v"])

    rows = [np.array(r["v"], np.float32) for r in stored(some.repartition(1).mapInArrow(fit, "k long, v array<float>"), "ann-index").orderBy("k").collect()]
    return rows[0].reshape(-1, dim), np.stack([r.reshape(-1, dim // m) for r in rows[1:]])


def _assigned(batches, coarse, words):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        home = nearest_rows(x, coarse).astype(np.int32)
        rest = np.split(x - coarse[home], len(words), 1)
        codes = np.stack([nearest_rows(r, w) for r, w in zip(rest, words)], 1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(home), pa.array([c.tobytes() for c in codes], pa.binary())],
            ["vec_id", "embedding", "home", "code"],
        )


def _asked(batches, coarse, probed: int, groups: dict[tuple[int, int], list[int]]):
    """(grp, query_id, query, lists): a query at each group that holds lists it probes, with these."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            some = batch.slice(lo, 1024)
            order = np.argsort(distances(_matrix(some.column(1)), coarse), 1, kind="stable")[:, :probed]
            asks = np.zeros((some.num_rows, len(coarse)), bool)
            np.put_along_axis(asks, order, True, 1)
            for (first, parts), own in groups.items():
                at = np.flatnonzero(asks[:, own].any(1))
                if not len(at):
                    continue
                row, of = np.nonzero(asks[np.ix_(at, own)])
                ends = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(own, np.int32)[of]))
                picked = some.take(pa.array(at))
                for g in range(first, first + parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), picked.column(0), picked.column(1), lists], ["grp", "query_id", "query", "lists"])


def probes_for(coded: DataFrame, coarse: np.ndarray, k: int, recall: float, sample: int) -> int:
    """As many lists as hold the share ``recall`` of the k nearest others of ``sample`` vectors, which are compared with all."""
    picked = coded.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).toArrow()
    qid, q = np.asarray(picked.column("vec_id")), _matrix(picked.column("embedding"))

    def near(batches):
        kept: list[np.ndarray] = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int32)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                some = batch.slice(lo, 8192)
                d = distances(q, _matrix(some.column(1)))
                d[qid[:, None] == np.asarray(some.column(0))[None]] = np.inf
                d = np.concatenate([kept[0], d], 1)
                home = np.concatenate([kept[1], np.broadcast_to(np.asarray(some.column(2)), (len(q), some.num_rows))], 1)
                best = np.argpartition(d, k - 1, 1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                kept = [np.take_along_axis(d, best, 1), np.take_along_axis(home, best, 1)]
        row, at = np.nonzero(np.isfinite(kept[0]))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(kept[0][row, at]), pa.array(kept[1][row, at])], ["q", "d", "home"])

    found = coded.select("vec_id", "embedding", "home").mapInArrow(near, "q long, d double, home int")
    true = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "home"))), 1, k)["home"].alias("home"))
    place = np.argsort(np.argsort(distances(q, coarse), 1, kind="stable"), 1, kind="stable")
    needed = np.sort(np.concatenate([place[r["q"], r["home"]] for r in true.collect()]))
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def search_group(home, ids, x, codes, qid, q, asker, asked, coarse, words, k: int, rerank: int):
    """The k nearest members of a group for each query among those of the lists it asks, as (query, member, squared distance).

    ``asker`` and ``asked`` are the pairs of a query's place and a list.  A query isn't its own neighbour; ties go to the lesser id.
    """
    order = np.argsort(home, kind="stable")
    home, ids, x, codes = home[order], ids[order], x[order], codes[order]
    lists, first = np.unique(home, return_index=True)
    ends, top, out = np.r_[first[1:], len(ids)], k * rerank, []
    at = {c: np.sort(asker[asked == c]) for c in lists.tolist()}
    for lo in range(0, len(q), _BLOCK):
        part, own = q[lo : lo + _BLOCK], qid[lo : lo + _BLOCK]
        rough = np.full((len(part), len(ids)), np.inf, np.float32)
        for c, a, b in zip(lists.tolist(), first, ends):
            who = at[c][np.searchsorted(at[c], lo) : np.searchsorted(at[c], lo + len(part))] - lo
            if len(who):
                rest = np.split(part[who] - coarse[c], len(words), 1)
                total = np.zeros((len(who), b - a), np.float32)
                for s, w in enumerate(words):
                    total += np.take(distances(rest[s], w), codes[a:b, s], axis=1)
                rough[who, a:b] = total
        rough[own[:, None] == ids[None]] = np.inf
        best = np.argpartition(rough, top - 1, 1)[:, :top] if top < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
        d = ((x[best].astype(np.float64) - part[:, None]) ** 2).sum(2)
        d[~np.isfinite(np.take_along_axis(rough, best, 1))] = np.inf
        near = np.lexsort((ids[best], d), 1)[:, :k]
        d, member = np.take_along_axis(d, near, 1), np.take_along_axis(ids[best], near, 1)
        row, place = np.nonzero(np.isfinite(d))
        out.append((own[row], member[row, place], d[row, place]))
    return tuple(map(np.concatenate, zip(*out)))


def group_lists(counts: dict[int, int], chunk: int) -> dict[tuple[int, int], list[int]]:
    """The lists of each (first group, groups): small lists share a group, a large one has several to itself."""
    out, used, room = {}, 0, 0
    for one, n in sorted(counts.items()):
        parts = math.ceil(n / chunk)
        if parts > 1:
            out[used, parts], used, room = [one], used + parts, 0
        elif n > room:
            out[used, 1], used, room = [one], used + 1, chunk - n
        else:
            out[used - 1, 1].append(one)
            room -= n
    return out


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, probes: float | None = None, rerank: int = RERANK, chunk: int = CHUNK, m: int = 8, rounds: int = 6, recall: float = RECALL, sample: int = 512, train: int = TRAIN, members: int = LIST) -> DataFrame:
    """``(vec_id, rank, neighbour_id, distance)``: the k nearest others, by Euclidean distance, of each vector whose id ``every`` divides.

    ``probes`` is the fraction of the lists that a query looks into; without it, :func:`probes_for`
    finds what ``recall`` needs.  Ids are whole numbers, or ValueError is raised.  Rows with a NULL id, a NULL or
    empty vector, NULL, NaN or infinite elements, or another dimension than the most frequent one
    have no result and are no neighbours, as they have no distance to the rest.  An id that repeats counts once, with the vector that
    sorts first.  Ties go to the lesser id.  Fewer than two vectors give an empty result.  Other columns are ignored, whatever their names.
    """
    require(vectors, id_col, vector_col)
    if vectors.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be whole numbers")
    out = "vec_id long, rank int, neighbour_id long, distance double"
    spark = vectors.sparkSession
    clean = vectors.select(col(vectors, id_col).cast("long").alias("vec_id"), col(vectors, vector_col).cast("array<float>").alias("embedding"))
    clean = clean.where("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < float('inf'))")
    if clean.groupBy("vec_id").count().where("count > 1").limit(1).count():
        clean = stored(clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-vectors")
    usual = clean.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None or usual["count"] < 2:
        return spark.createDataFrame([], out)
    n, dim = usual["count"], usual["dim"]
    clean = clean.where(F.size("embedding") == dim)
    m = max(x for x in range(1, min(m, dim) + 1) if dim % x == 0)
    lists = max(1, min(round(math.sqrt(n)), math.ceil(n / members), train // 32))
    index = [spark.sparkContext.broadcast(x) for x in train_index(clean, n, dim, lists, m, rounds, train)]
    coarse, words = index[0].value, index[1].value
    coded = stored(clean.mapInArrow(lambda b: _assigned(b, index[0].value, index[1].value), "vec_id long, embedding array<float>, home int, code binary"), "ann-coded")
    probed = probes_for(coded, coarse, k, recall, sample) if probes is None else max(1, math.ceil(len(coarse) * probes))
    groups = group_lists({r["home"]: r["count"] for r in coded.groupBy("home").count().collect()}, chunk)
    held = spark.createDataFrame([(one, first, parts) for (first, parts), own in groups.items() for one in own], "home int, first int, parts int")
    asked = stored(
        coded.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
        .mapInArrow(lambda b: _asked(b, index[0].value, probed, groups), "grp int, query_id long, query array<float>, lists array<int>"),
        "ann-asked",
    )
    busy = asked.groupBy("grp").agg(F.ceil(F.count("*") / _SLICE).cast("int").alias("slices")).where("slices > 1")
    placed = coded.join(F.broadcast(held), "home").withColumn("grp", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    slices = F.coalesce("slices", F.lit(1))
    left = (
        placed.join(busy, "grp", "left")
        .select("grp", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "home", "vec_id", "embedding", "code")
    )
    right = asked.join(busy, "grp", "left").withColumn("slice", F.pmod(F.xxhash64("query_id", F.lit(7)), slices).cast("int")).drop("slices")

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(-1, m)
        asks = right.column("lists").combine_chunks()
        asker, asks = np.repeat(np.arange(right.num_rows), np.asarray(asks.value_lengths())), np.asarray(asks.flatten())
        a, b, d = search_group(
            np.asarray(left.column("home")), np.asarray(left.column("vec_id")), _matrix(left.column("embedding")), codes,
            np.asarray(right.column("query_id")), _matrix(right.column("query")), asker, asks, index[0].value, index[1].value, k, rerank,
        )
        return pa.table({"vec_id": a, "neighbour_id": b, "d": d})

    found = left.groupBy("grp", "slice").cogroup(right.groupBy("grp", "slice")).applyInArrow(one, "vec_id long, neighbour_id long, d double")
    best = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour_id"))), 1, k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("rank", "x")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.neighbour_id"), F.sqrt("x.d").alias("distance"))
