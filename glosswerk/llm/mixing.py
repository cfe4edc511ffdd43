"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised.  The exponent
is bisected between 0 (all sources alike) and 1 (their own shares): it is the largest at which the
weights' entropy meets the target, or, if that would repeat a source too often, the smallest at
which none is repeated beyond the limit.

The weights are realised as block permutations under a budget of tokens.  A source's documents are
hashed to blocks of about ``block_docs``; an epoch is a permutation of the source's blocks and of
the documents in each.  A source gives whole epochs while its budget lasts, and of the last epoch
the longest beginning that the budget holds.  So each document's copies follow from the numbers of
its source and its own hash: texts are never shuffled, and no window is larger than a block or the
list of a source's blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cols, id_type, md5_long, require, stored, token_count

#: The production parameters of the registered query.
ENTROPY, REPEATS, BLOCK, SEED = 0.998, 4.0, 4096, 17


def exponent(tokens: np.ndarray, entropy: float, repeats: float, budget: float, rounds: int = 60) -> float:
    """The exponent for shares of tokens; ``entropy`` is a fraction of the greatest possible.

    Raises ValueError if the budget is more than ``repeats`` times all tokens, which no weights can meet.
    """
    if budget > repeats * tokens.sum():
        raise ValueError("the budget repeats the sources more often than the limit allows, whatever their weights")
    total = tokens.sum()
    share, goal = tokens / total, entropy * math.log(len(tokens))

    def state(a):
        z = (share**a).sum()
        h = math.log(z) - a * (share**a * np.log(share)).sum() / z
        return h, (share**a / tokens).max() * budget / z

    if state(1.0)[0] >= goal:
        return 1.0
    lo, hi, low, high = 0.0, 1.0, 0.0, 1.0
    for _ in range(rounds):
        mid, other = (lo + hi) / 2, (low + high) / 2
        lo, hi = (mid, hi) if state(mid)[0] >= goal else (lo, mid)
        low, high = (low, other) if state(other)[1] <= repeats else (other, high)
    return max(lo, high)


def _source(docs: DataFrame, source_col: str) -> Column:
    """The source as a key that tells NULL from any text."""
    return F.coalesce(F.concat(F.lit("s"), col(docs, source_col).cast("string")), F.lit("n"))


def _keys(seed: int, epoch: Column | str) -> tuple[Column, Column]:
    block = md5_long(F.lit(f"{seed}-block"), F.col(epoch) if isinstance(epoch, str) else epoch, "__gw_s", "__gw_block")
    return block, md5_long(F.lit(f"{seed}-doc"), F.col(epoch) if isinstance(epoch, str) else epoch, F.coalesce(F.col("__gw_id"), F.lit("null")))


def _block(seed: int) -> Column:
    return F.pmod(md5_long(F.lit(f"{seed}-place"), F.coalesce(F.col("__gw_id"), F.lit("null"))), F.col("__gw_blocks"))


def plan(slim: DataFrame, entropy: float, repeats: float, budget: int | None, block_docs: int, seed: int) -> DataFrame:
    """For each source its blocks, whole epochs, and where the last epoch is cut, from ``(__gw_id, __gw_s, tokens)``."""
    if budget is not None and budget > repeats * (slim.agg(F.sum("tokens")).first()[0] or 0) > 0:
        raise ValueError("the budget repeats the sources more often than the limit allows, whatever their weights")
    sums = slim.groupBy("__gw_s").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).where("n > 0")

    def weigh(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by("__gw_s")
        n, docs = (np.asarray(table.column(c)).astype(np.int64) for c in ("n", "docs"))
        limit = int(n.sum()) if budget is None else budget
        share = n / n.sum()
        power = share ** exponent(n.astype(float), entropy, repeats, float(limit))
        own = np.floor(power / power.sum() * limit).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [table.column("__gw_s").combine_chunks(), pa.array(-(-docs // block_docs)), pa.array(own // n), pa.array(own % n)],
            ["__gw_s", "__gw_blocks", "__gw_full", "__gw_rest"],
        )

    base = stored(sums.coalesce(1).mapInArrow(weigh, "__gw_s string, __gw_blocks long, __gw_full long, __gw_rest long"), "mix-weights")
    block_key, doc_key = _keys(seed, "__gw_full")
    placed = (
        slim.join(base, "__gw_s").withColumn("__gw_block", _block(seed))
        .select("__gw_s", "__gw_rest", "tokens", block_key.alias("bk"), doc_key.alias("dk"))
    )
    by_block = Window.partitionBy("__gw_s").orderBy("bk").rangeBetween(Window.unboundedPreceding, 0)
    cut = (
        placed.groupBy("__gw_s", "__gw_rest", "bk").agg(F.sum("tokens").alias("t"))
        .withColumn("upto", F.sum("t").over(by_block)).where("upto > __gw_rest")
        .groupBy("__gw_s").agg(F.min_by(F.struct("bk", (F.col("__gw_rest") - F.col("upto") + F.col("t")).alias("left")), "bk").alias("c"))
        .select("__gw_s", "c.bk", "c.left")
    )
    by_doc = Window.partitionBy("__gw_s").orderBy("dk").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        placed.join(cut, ["__gw_s", "bk"]).withColumn("upto", F.sum("tokens").over(by_doc)).where("upto <= left")
        .groupBy("__gw_s").agg(F.max("dk").alias("dk"))
    )
    return stored(
        base.join(cut, "__gw_s", "left").join(last, "__gw_s", "left")
        .select("__gw_s", "__gw_blocks", "__gw_full", F.coalesce("bk", F.lit(-1)).alias("__gw_bk"), F.coalesce("dk", F.lit(-1)).alias("__gw_dk")),
        "mix-plan",
    )


def _copies(seed: int) -> Column:
    block_key, doc_key = _keys(seed, "__gw_full")
    extra = (block_key < F.col("__gw_bk")) | ((block_key == F.col("__gw_bk")) & (doc_key <= F.col("__gw_dk")))
    return F.col("__gw_full") + extra.cast("long")


def _slim(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    require(docs, id_col, source_col, text_col)
    return stored(
        docs.select(col(docs, id_col).cast("string").alias("__gw_id"), _source(docs, source_col).alias("__gw_s"), token_count(col(docs, text_col)).alias("tokens")),
        "mix-docs",
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_docs: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, epoch, block, position, tokens)`` for each copy of a document in the mixture.

    ``entropy`` is a fraction of the greatest possible; ``budget`` counts tokens, by default those
    of all documents.  The order is that of epoch, then of a hash of the block, then ``position``.
    NULL is a source of its own.  Documents without tokens (NULL, empty, blank) ride along with
    their block; sources without any token, and so empty tables, give nothing.  Rows of the same id
    have the same hash: they are drawn together and share a position.  A NULL id counts as one id.
    Sources of equal tokens have equal weights.  Ids keep their type.  A budget beyond ``repeats`` times all tokens
    raises ValueError.  Texts of any length are counted whole; other columns are ignored, whatever their names.
    """
    slim = _slim(docs, id_col, source_col, text_col)
    found = slim.join(plan(slim, entropy, repeats, budget, block_docs, seed), "__gw_s").withColumn("__gw_block", _block(seed))
    found = found.withColumn("copies", _copies(seed)).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    _, doc_key = _keys(seed, "epoch")
    order = Window.partitionBy("__gw_s", "epoch", "__gw_block").orderBy("dk")
    return found.withColumn("dk", doc_key).select(
        F.col("__gw_id").cast(id_type(docs, id_col)).alias("doc_id"),
        F.when(F.col("__gw_s") != "n", F.expr("substring(__gw_s, 2)")).alias("source"),
        "epoch",
        F.col("__gw_block").alias("block"),
        F.rank().over(order).cast("long").alias("position"),
        "tokens",
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_docs: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as many times as :func:`mix`, which see for NULLs and the like, has copies of it; columns are unchanged."""
    slim = _slim(docs, id_col, source_col, text_col)
    table = plan(slim, entropy, repeats, budget, block_docs, seed)
    own = docs.select(*[c.alias(f"__gw_{k}") for k, c in enumerate(cols(docs))], col(docs, id_col).cast("string").alias("__gw_id"), _source(docs, source_col).alias("__gw_s"))
    both = own.join(table, "__gw_s").withColumn("__gw_block", _block(seed))
    both = both.withColumn("__gw_copies", _copies(seed)).where("__gw_copies > 0").withColumn("__gw_copy", F.explode(F.sequence(F.lit(1), F.col("__gw_copies"))))
    return both.select(*[F.col(f"__gw_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _md5(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


#: The registered query with the parameters above, on a table ``documents`` without NULL ids.
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS s, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS tokens FROM documents
), src AS (
  SELECT s, sum(tokens)::BIGINT AS n, count(*) AS docs FROM docs GROUP BY s HAVING sum(tokens) > 0
), shares AS (
  SELECT s, n, docs, n::DOUBLE / (SELECT sum(n) FROM src)::DOUBLE AS p, (SELECT sum(n) FROM src)::DOUBLE AS total FROM src
), goal AS (
  SELECT {ENTROPY} * ln(count(*)) AS goal, ln(sum(p)) - sum(p * ln(p)) / sum(p) AS own_entropy FROM shares
), bisect(i, lo, hi, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN h >= goal THEN m ELSE lo END, CASE WHEN h >= goal THEN hi ELSE m END,
    CASE WHEN rep <= {REPEATS} THEN low ELSE o END, CASE WHEN rep <= {REPEATS} THEN o ELSE high END
  FROM (
    SELECT i, lo, hi, low, high, (lo + hi) / 2 AS m, (low + high) / 2 AS o,
      ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS h,
      max(pow(p, (low + high) / 2) / n) * max(total) / sum(pow(p, (low + high) / 2)) AS rep
    FROM bisect, shares WHERE i < 60 GROUP BY i, lo, hi, low, high
  ), goal
), power AS (
  SELECT CASE WHEN own_entropy >= goal THEN 1 ELSE greatest(lo, high) END AS a FROM bisect, goal WHERE i = 60
), budget AS (
  SELECT s, n, (docs + {BLOCK - 1}) // {BLOCK} AS blocks, floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, power) * total)::BIGINT AS own FROM shares, power
), placed AS (
  SELECT d.doc_id, d.s, d.tokens, b.own // b.n AS whole, b.own % b.n AS rest, {_md5(f"'{SEED}-place'", "d.doc_id")} % b.blocks AS block
  FROM docs d JOIN budget b USING (s)
), keyed AS (
  SELECT *, {_md5(f"'{SEED}-block'", "whole", "s", "block")} AS bk, {_md5(f"'{SEED}-doc'", "whole", "doc_id")} AS dk FROM placed
), upto AS (
  SELECT s, bk, rest, t, sum(t) OVER (PARTITION BY s ORDER BY bk RANGE UNBOUNDED PRECEDING) AS upto
  FROM (SELECT s, bk, rest, sum(tokens) AS t FROM keyed GROUP BY s, bk, rest)
), edge AS (
  SELECT s, min(bk) AS bk, min_by(rest - upto + t, bk) AS left_over FROM upto WHERE upto > rest GROUP BY s
), final AS (
  SELECT s, max(dk) AS dk FROM (
    SELECT k.s, k.dk, e.left_over, sum(k.tokens) OVER (PARTITION BY k.s ORDER BY k.dk RANGE UNBOUNDED PRECEDING) AS upto FROM keyed k JOIN edge e USING (s, bk)
  ) WHERE upto <= left_over GROUP BY s
), copies AS (
  SELECT k.doc_id, k.s, k.tokens, k.block, k.whole + (k.bk < coalesce(e.bk, -1) OR (k.bk = coalesce(e.bk, -1) AND k.dk <= coalesce(l.dk, -1)))::BIGINT AS n
  FROM keyed k LEFT JOIN edge e USING (s) LEFT JOIN final l USING (s)
), drawn AS (
  SELECT doc_id, s, tokens, block, unnest(range(n)) AS epoch FROM copies
)
SELECT doc_id, CASE WHEN s <> 'n' THEN substr(s, 2) END AS source, epoch, block,
  rank() OVER (PARTITION BY s, epoch, block ORDER BY {_md5(f"'{SEED}-doc'", "epoch", "doc_id")}) AS position, tokens
FROM drawn
"""
