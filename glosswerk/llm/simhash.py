"""SimHash near-dedup through a segment-popcount embedding.

A document's fingerprint has 128 bits: bit i is the majority of bit i over the hashes of its
distinct words.  Cut into segments of ``segment_bits`` bits, it embeds as the vector of the
segments' bit counts.  The Manhattan distance of two vectors never exceeds the Hamming distance
of the fingerprints, so it rejects pairs before the exact comparison.

Candidates come from grids over the embedding, and none is lost.  The segments are cut into blocks, so many
that a pair within the bound differs in no more than ``spare`` segments of one block at least
(the counts of a segment differ only where bits do).  A block has a grid for each choice of ``spare`` of
its segments to leave out, of unit cells over the others; two documents meet in a grid when
all its counts agree, so every pair within the bound meets in one.  The default is segments
of one bit, whose cells are the smallest.  Without ``spare`` there are few grids of large cells, with
each more many grids of small ones; which costs least follows from the number of fingerprints, the result doesn't.

Within a cell the Manhattan distance of every pair is taken, as the Hamming distance of the
embedding in unary, and only pairs that it lets pass are verified exactly.  Pairs found join
fingerprints to groups (connected components).  Equal fingerprints are one node, so copies cost
nothing; :mod:`.cells` splits large cells and hands on forests and numbers of links, not pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import SPLIT, links
from .common import col, cols, free, id_type, slices, slim, stored, words
from .components import components

BITS = 128
#: A pair of words' hashes agrees in the count of a two-bit segment by chance this often, and so on by width.
_CHANCE = {1: 0.5, 2: 0.375, 4: 70 / 256, 8: 12870 / 65536}
#: Moving a row to a cell costs as much as comparing so many pairs: some 9 microseconds and 9 to 14 nanoseconds as measured.
_ROW = 1000
#: So many segments of a block are looked at: their cells are small enough and their numbers fit 64 bits.
_WIDE = 24


def _fingerprint(batches):
    rows: dict[bytes, int] = {}
    digests: list[bytes] = []
    bits = np.zeros((0, BITS), np.uint8)
    for batch in slices(batches):
        texts = batch.column(2).to_pylist()
        if len(rows) > 400_000:
            rows, digests, bits = {}, [], np.zeros((0, BITS), np.uint8)
        docs = []
        for text in texts:
            distinct = set(words(text))
            for w in distinct:
                if w not in rows:
                    rows[w] = len(digests)
                    digests.append(xxhash.xxh3_128_digest(w))
            docs.append(np.fromiter(map(rows.__getitem__, distinct), np.int64, len(distinct)))
        if len(digests) > len(bits):
            new = np.frombuffer(b"".join(digests[len(bits):]), np.uint8).reshape(-1, 16)
            bits = np.concatenate([bits, np.unpackbits(new, axis=1)])
        out = np.zeros((len(docs), 16), np.uint8)
        for i, d in enumerate(docs):
            if len(d):
                ones = np.zeros(BITS, np.int64)
                for s in range(0, len(d), 4096):
                    ones += bits[d[s : s + 4096]].sum(0, dtype=np.uint32)
                out[i] = np.packbits(2 * ones > len(d))
        halves = out.view(">i8").astype(np.int64)
        none = np.array([not len(d) for d in docs], bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(halves[:, 0], mask=none), pa.array(halves[:, 1], mask=none)], ["doc_id", "text_hash", "fp0", "fp1"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp0, fp1)`` for each row.

    NULL, empty and wordless texts have NULL fingerprints; a NULL text has a NULL hash too.  Texts
    of any length are read whole.  An empty table gives an empty one.
    """
    rows = slim(docs, id_col, text_col).select("doc_id", _text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprint, f"doc_id {id_type(docs, id_col)}, text_hash long, fp0 long, fp1 long")


def _text_hash(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def blocks(max_distance: int, segment_bits: int, spare: int) -> list[list[int]]:
    """Grids in which every pair within max_distance meets: each block of segments without any ``spare`` of them."""
    total, parts = BITS // segment_bits, max_distance // (spare + 1) + 1
    if total // parts <= spare:
        return [[]]
    bounds = [total * k // parts for k in range(parts + 1)]
    own = [range(lo, min(hi, lo + _WIDE)) for lo, hi in zip(bounds[:-1], bounds[1:])]
    return [list(kept) for block in own for kept in itertools.combinations(block, len(block) - spare)]


def grid_plan(n: int, max_distance: int, segment_bits: int = 1, split: int = SPLIT, spare: int | None = None) -> list[list[int]]:
    """Each grid's segments; any plan finds all pairs within max_distance, and unless ``spare`` is given that of the least cost among n fingerprints is taken."""
    if BITS % segment_bits or segment_bits not in _CHANCE:
        raise ValueError("segment_bits must be 1, 2, 4 or 8")
    if spare is not None:
        return blocks(max_distance, segment_bits, spare)

    def cost(plan: list[list[int]]) -> float:
        members = [n * _CHANCE[segment_bits] ** len(segments) for segments in plan]
        return sum(_ROW * math.ceil(m / split) + m / 2 for m in members)

    return min([[[]], *(blocks(max_distance, segment_bits, k) for k in range(3))], key=cost)


@functools.lru_cache(maxsize=1 << 14)
def _masks(segments: tuple[int, ...]) -> tuple[int, int]:
    """The bits of segments of one bit, by half of the fingerprint."""
    return tuple(sum(1 << (63 - s % 64) for s in segments if s // 64 == half) for half in (0, 1))


def _cell(segments: list[int], segment_bits: int):
    """The cell's number: the counts as digits, or of segments of one bit the bits where they are."""
    if segment_bits == 1 and not operator.and_(*_masks(tuple(segments))):
        a, b = (F.lit(m - (m >> 63 << 64)).cast("long") for m in _masks(tuple(segments)))
        return F.col("fp0").bitwiseAND(a).bitwiseOR(F.col("fp1").bitwiseAND(b))
    per, value = 64 // segment_bits, F.lit(0).cast("long")
    for s in segments:
        word = F.col("fp0" if s < per else "fp1")
        part = F.shiftrightunsigned(word, 64 - segment_bits * (s % per + 1)).bitwiseAND(F.lit((1 << segment_bits) - 1))
        value = value * F.lit(segment_bits + 1) + F.bit_count(part)
    return value


def _cells(u: np.ndarray, segments: list[int], segment_bits: int) -> np.ndarray:
    """The same over an array of fingerprints."""
    if segment_bits == 1 and not operator.and_(*_masks(tuple(segments))):
        a, b = map(np.uint64, _masks(tuple(segments)))
        return (u[:, 0] & a) | (u[:, 1] & b)
    per, value = 64 // segment_bits, np.zeros(len(u), np.int64)
    for s in segments:
        part = (u[:, int(s >= per)] >> np.uint64(64 - segment_bits * (s % per + 1))) & np.uint64((1 << segment_bits) - 1)
        value = value * (segment_bits + 1) + np.bitwise_count(part)
    return value


def unary(u: np.ndarray) -> np.ndarray:
    """The embedding with segments of two bits in unary, as uint64 words: the XOR's bits are the Manhattan distance."""
    high, low = np.uint64(0xAAAAAAAAAAAAAAAA), np.uint64(0x5555555555555555)
    return ((u | (u << np.uint64(1))) & high) | (u & (u >> np.uint64(1)) & low)


def near_pairs(u: np.ndarray, w: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in u, j in w) of all pairs within max_distance; pairs whose Manhattan distance, a lower bound, is larger aren't verified."""
    a, b = unary(u), unary(w)
    low = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    low += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    i, j = np.nonzero(low <= max_distance)
    near = np.bitwise_count(u[i] ^ w[j]).sum(1, dtype=np.int32) <= max_distance
    return i[near], j[near]


def near_groups(prints: DataFrame, max_distance: int = 17, segment_bits: int = 1, split: int = SPLIT, spare: int | None = None) -> DataFrame:
    """``(fp0, fp1, head, links)`` for each distinct fingerprint of ``prints(doc_id, text_hash, fp0, fp1)``.

    ``head`` is the least (doc_id, text_hash) of the fingerprint's group, ``links`` the number of all other fingerprints within max_distance.
    """
    ided = prints.where("fp0 IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(
        ided.groupBy("fp0", "fp1").agg(F.min(F.struct("doc_id", "text_hash")).alias("own")).withColumn("node", F.monotonically_increasing_id()), "simhash-nodes"
    )
    plan = grid_plan(nodes.count(), max_distance, segment_bits, split, spare)

    def near(a, b):
        return near_pairs(a.view(">u8").astype(np.uint64), b.view(">u8").astype(np.uint64), max_distance)

    def earlier(grid, sigs):
        u = sigs.view(">u8").astype(np.uint64)
        return [_cells(u, segments, segment_bits) for segments in plan[:grid]]

    sig = F.unhex(F.concat(F.lpad(F.hex("fp0"), 16, "0"), F.lpad(F.hex("fp1"), 16, "0")))
    cells = nodes.select(F.posexplode(F.array(*[_cell(s, segment_bits) for s in plan])).alias("grid", "cell"), "node", sig.alias("sig"))
    met = links(cells, near, earlier, split=split)
    roots = components(met.where("a <> b").select("a", "b"))
    counts = met.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = nodes.join(roots, nodes["node"] == roots["id"], "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("own").alias("head"))
    return placed.join(heads, "root").join(counts, "node", "left").select("fp0", "fp1", "head", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def _prints(docs: DataFrame, id_col: str, text_col: str, among: DataFrame | None = None, away: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_hash, fp0, fp1, n, away)`` for each distinct document id and text: n rows have them; ``away`` tells whether both are in that table."""
    prints = fingerprints(docs, id_col, text_col)
    if among is not None:
        prints = prints.join(among.select(col(among, id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    prints = prints.groupBy("doc_id", "text_hash", "fp0", "fp1").agg(F.count("*").alias("n"))
    if away is None:
        prints = prints.withColumn("away", F.lit(False))
    else:
        gone = away.select("doc_id", "text_hash", F.lit(True).alias("away")).distinct()
        prints = prints.join(gone, ["doc_id", "text_hash"], "left").withColumn("away", F.coalesce("away", F.lit(False)))
    return stored(prints, "simhash-prints")


def _placed(prints: DataFrame, options: dict) -> DataFrame:
    """``(doc_id, text_hash, n, away, head, links)`` for each row of ``prints``; head and links are NULL without a fingerprint or id, or where ``away``."""
    groups = near_groups(prints.where("NOT away"), **options)
    a, b = prints.alias("a"), groups.alias("b")
    on = (F.col("a.fp0") == F.col("b.fp0")) & (F.col("a.fp1") == F.col("b.fp1")) & F.col("a.doc_id").isNotNull() & ~F.col("a.away")
    return a.join(b, on, "left").select("a.doc_id", "a.text_hash", "a.n", "a.away", "b.head", "b.links")


def _own() -> Column:
    return F.struct("doc_id", "text_hash")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 17, among: DataFrame | None = None, **grid) -> DataFrame:
    """``(doc_id, group_id, links, kept)`` for each distinct document id and text; with ``among``, of ids in that table only.

    A group's least doc_id is its ``group_id``; only that document has ``kept`` (of an id with
    several texts in a group, the one of the least hash).  ``links`` is the number of all other
    fingerprints within ``max_distance``; documents of equal fingerprints are copies and have the same
    links.  Documents without words (NULL, empty, punctuation) are their own group, without links, and stay.  A NULL
    doc_id has a NULL ``group_id`` and stays, as it can't be told from others.  Repeated rows give
    one row, and each text of an id is placed on its own.  Ids keep their type.  An empty table
    gives an empty one; very long texts are read whole; other columns are ignored, whatever their names.
    """
    found = _placed(_prints(docs, id_col, text_col, among), {"max_distance": max_distance} | grid)
    return found.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("head.doc_id", "doc_id")).alias("group_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.coalesce(F.col("head") == _own(), F.lit(True)).alias("kept"),
    )


def copies_as_came(docs: DataFrame, whole: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 17, **grid) -> DataFrame:
    """``(doc_id, text_hash)`` of the texts of ``docs`` that go as near copies when all are compared as ``whole`` has them, before lines were dropped.

    Only texts that are still there are compared, and of a group the least stays as in :func:`decisions`.  Of an id with several texts each
    goes or stays on its own: a text that ``whole`` has with that id is that one, any other is what :func:`.lines.drop_lines` left
    of the id's least text, the only one that loses lines.  NULL texts and ids and ids that ``whole`` lacks aren't in the result.
    """
    prints = _prints(whole, id_col, text_col, among=docs)
    one = prints.groupBy("doc_id").agg(F.count("*").alias("texts"), F.min("text_hash").alias("only"))
    now = slim(docs, id_col, text_col).select("doc_id", _text_hash(F.col("text")).alias("text_hash")).where("doc_id IS NOT NULL AND text_hash IS NOT NULL").distinct()
    same = prints.select("doc_id", "text_hash", F.col("text_hash").alias("same"))
    met = stored(now.join(same, ["doc_id", "text_hash"], "left").join(one, "doc_id"), "simhash-met")
    # Written first, so that Spark has its size and needn't move all texts for a few ids.
    several = stored(met.where("same IS NULL AND texts > 1").select("doc_id").distinct(), "simhash-several")
    least = slim(whole, id_col, text_col).join(several, "doc_id", "left_semi").groupBy("doc_id").agg(_text_hash(F.min("text")).alias("least"))
    came = stored(met.join(least, "doc_id", "left").select("doc_id", "text_hash", F.coalesce("same", "least", "only").alias("came")), "simhash-came")
    there = came.select("doc_id", F.col("came").alias("text_hash")).distinct()
    found = _placed(prints.join(there, ["doc_id", "text_hash"], "left_semi"), {"max_distance": max_distance} | grid)
    goes = found.where(F.col("head") != _own()).select("doc_id", F.col("text_hash").alias("came"))
    return came.join(goes, ["doc_id", "came"], "left_semi").select("doc_id", "text_hash")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", away: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group; columns are unchanged.

    Rows that go are told by id and text together, so an id with several texts loses the copies among them only.
    Rows that repeat an id and its text are one row in the result: the one that sorts first as JSON.  Rows with an id and text in
    ``away(doc_id, text_hash)`` go and are compared with none.  See :func:`decisions` for NULLs and texts without words, all of which
    stay; an empty table stays empty.  What goes is found without the texts, which then move once.
    """
    prints = _prints(docs, id_col, text_col, away=away)
    goes = F.col("away") | F.coalesce(F.col("head") != _own(), F.lit(False))
    found = _placed(prints, options).withColumn("goes", goes).where("doc_id IS NOT NULL AND (goes OR n > 1)")
    text = _text_hash(col(docs, text_col).cast("string"))
    # A NULL text has a key too: equal keys, not null-safe ones, are what join and aggregation can share a shuffle by.
    h, t, i, g, s, n, row = free(docs, "h", "t", "i", "g", "s", "n", "row")
    rows = docs.select(*cols(docs), F.coalesce(text, F.lit(0).cast("long")).alias(h), text.isNull().alias(t))
    told = (
        found.select(F.col("doc_id").alias(i), F.coalesce("text_hash", F.lit(0).cast("long")).alias(g), F.col("text_hash").isNull().alias(s), "n", "goes")
        .groupBy(i, g, s)
        .agg(F.when(~F.max("goes"), F.sum("n")).alias(n))
    )
    same = (col(rows, id_col) == told[i]) & (rows[h] == told[g]) & (rows[t] == told[s])
    if not prints.where("doc_id IS NOT NULL AND n > 1").limit(1).count():
        return rows.join(told, same, "left_anti").select(*[col(rows, c) for c in docs.columns])
    both = rows.join(told, same, "left")
    single = both.where(told[i].isNull()).select(*[col(rows, c) for c in docs.columns])
    whole = F.struct(*[col(rows, c) for c in docs.columns])
    # Rows of a group have the same text: without it they sort the same.
    short = F.struct(*[(F.when(col(rows, c).isNotNull(), F.lit("")) if c == text_col else col(rows, c)).alias(c) for c in docs.columns])
    first = both.where(told[n].isNotNull()).groupBy(col(rows, id_col), rows[h], rows[t]).agg(F.min_by(whole, F.to_json(short)).alias(row))
    return single.unionByName(first.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))
