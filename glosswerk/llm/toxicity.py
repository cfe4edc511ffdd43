"""Toxicity by lexicon induction.

Seeds are the words whose presence tells labelled toxic documents from the others.  Around them
lies a word graph: two words are linked by the positive pointwise mutual information of their
occurring in the same document, counted over all documents.  A random walk from each word ends
in toxic seeds with one chance and in neutral seeds with another, which give the word its polarity;
a document's score adds its words' weights.  The threshold is the one that best tells the labelled documents apart.

What is bounded, by a parameter: the labelled rows that seeds and the threshold are learned from
(``max_labelled``, those of the least hash).  All counts behind the graph are over all documents,
and every document is scored over its whole text.

Beside the seeds, words become nodes if toxic seeds are in ``min_share`` of their documents, or in
significantly more than twice the share of all documents, by a bar that rises with the number of
words tested.  There is no limit to how many.  Words that stand with other nodes only, and with no
seed, aren't found.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free, id_type, require, slices, slim, stored, words

#: Word counters are handed on when they grow beyond this, so that a task's memory is bounded.
_FLUSH = 400_000


def labelled_sample(labels: DataFrame, max_labelled: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, toxic)`` of at most max_labelled ids; an id with several labels is toxic if one says so; NULLs are left out."""
    require(labels, id_col, label_col)
    one = (
        labels.select(col(labels, id_col).alias("doc_id"), (col(labels, label_col).cast("int") > 0).cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def _counts(batches, marked):
    """(word, docs, sketch): unmarked documents by word, and the sketches of the marked ones; the word '' is in all."""
    docs, some = Counter(), set()

    def out():
        w, k = [*docs, *(x for x, _ in some)], len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array(w, pa.binary()), pa.array([*docs.values(), *[0] * k], pa.int64()), pa.array([*[None] * len(docs), *(x for _, x in some)], pa.int64())],
            ["word", "docs", "sketch"],
        )

    for batch in slices(batches):
        for k, text in enumerate(batch.column(0).to_pylist()):
            tokens = words(text)
            own = set(tokens)
            if not own:
                continue
            if marked(own, batch, k):
                runs = map(b" ".join, zip(tokens, tokens[1:], tokens[2:])) if len(tokens) > 3 else [b" ".join(tokens)]
                sketch = min(map(xxhash.xxh3_64_intdigest, runs)) >> 1
                own.add(b"")
                some.update((w, sketch) for w in own)
            else:
                own.add(b"")
                docs.update(own)
        if len(docs) + len(some) > _FLUSH:
            yield out()
            docs, some = Counter(), set()
    yield out()


def word_counts(texts: DataFrame, marked) -> DataFrame:
    """``(word, docs, some)``: a word's documents, and the marked ones among them.

    Marked documents whose least hash of three words in a row agrees count once, or copies of a toxic document would
    make all of its words look toxic.
    """
    return (
        texts.mapInArrow(lambda b: _counts(b, marked), "word binary, docs long, sketch long")
        .repartition("word")
        .groupBy("word", "sketch").agg(F.sum("docs").alias("docs"))
        .groupBy("word").agg((F.sum("docs") + F.count("sketch")).alias("docs"), F.count("sketch").alias("some"))
    )


def seeds(counts: DataFrame, n_seeds: int = 128, min_docs: int = 5) -> tuple[list[bytes], list[bytes]]:
    """Toxic seeds, the surest first, and neutral ones, the most frequent first, from ``(word, docs, some)`` over labelled documents.

    All words that pass the bar are toxic seeds; there are as many neutral ones, ``n_seeds`` if that is more.
    """
    total = counts.where(F.length("word") == 0).first()
    if not total or not total["some"] or total["some"] == total["docs"]:
        return [], []
    share = total["some"] / total["docs"]
    scored = counts.where((F.length("word") > 0) & (F.col("docs") >= min_docs)).withColumn(
        "z", (F.col("some") - F.col("docs") * share) / F.sqrt(F.col("docs") * share + 1)
    )
    sure = (F.col("some") + 1) / (F.col("docs") + 2)
    bad = scored.where((sure >= max(0.75, min(0.9, 2 * share))) & (F.col("z") >= 4)).orderBy(F.desc("z"), "word")
    toxic = [bytes(r["word"]) for r in bad.collect()]
    good = scored.where(sure <= 1.25 * share).orderBy(F.desc("docs"), "word").limit(max(n_seeds, len(toxic)))
    return toxic, [bytes(r["word"]) for r in good.collect()]


def associated(counts: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Words of ``(word, docs, some)`` that stand with toxic seeds: in min_share of their documents, or significantly more than twice as often as all do."""
    total = counts.where(F.length("word") == 0).first()
    share = max(total["some"], 1) / total["docs"]
    tested = counts.where((F.length("word") > 0) & (F.col("docs") >= min_docs))
    bar = max(4.0, math.sqrt(2 * math.log(max(tested.count(), 2))))
    base = min(2 * share, (1 + share) / 2)
    z = (F.col("some") - F.col("docs") * base) / F.sqrt(F.col("docs") * base * (1 - base) + 1)
    return tested.where((F.col("some") > F.col("docs") * share) & ((F.col("some") >= F.col("docs") * min_share) | (z >= bar)))


def _pairs(batches, node: dict):
    """(i, j, documents) for nodes i < j that share documents."""
    n, held, kept = len(node), [], 0

    def out():
        pair, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((pair // n).astype(np.int32)), pa.array((pair % n).astype(np.int32)), pa.array(times)], ["i", "j", "docs"])

    names = node.keys()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            own = names & set(words(text))
            if len(own) > 1:
                at = np.sort(np.fromiter(map(node.__getitem__, own), np.int64, len(own)))
                i, j = np.triu_indices(len(at), 1)
                held.append(at[i] * n + at[j])
                kept += len(i)
        if kept > 4_000_000:
            yield out()
            held, kept = [], 0
    if held:
        yield out()


def walk(edges: DataFrame, n: int, ends: np.ndarray, damping: float = 0.85, rounds: int = 40) -> np.ndarray:
    """Each of n nodes' chances that a random walk from it over the undirected ``edges(i, j, weight)`` ends in each column of ``ends``.

    Before each step the walk ends with chance 1 - damping; at a node without edges it always does.  Walks of more than
    ``rounds`` steps, a chance of 0.0015, are left out.  Each step is an aggregation of the edges by node.
    """
    width = ends.shape[1]

    def gathered(values: np.ndarray) -> np.ndarray:
        shipped = edges.sparkSession.sparkContext.broadcast(values)

        def part(batches):
            total = np.zeros((n, values.shape[1]))
            for b in batches:
                i, j, w = (np.asarray(b.column(k)) for k in range(3))
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(i, w * shipped.value[j, k], n) + np.bincount(j, w * shipped.value[i, k], n)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, k]) for k in range(total.shape[1])]], ["node", *[f"v{k}" for k in range(total.shape[1])]])

        names = [f"v{k}" for k in range(values.shape[1])]
        sums = edges.mapInArrow(part, "node long, " + ", ".join(f"{c} double" for c in names)).groupBy("node").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        out = np.zeros((n, values.shape[1]))
        out[np.asarray(sums.column("node"))] = np.stack([np.asarray(sums.column(c)) for c in names], 1)
        shipped.destroy()
        return out

    degree = gathered(np.ones((n, 1)))
    lonely = degree == 0
    degree[lonely] = 1
    at = ends * np.where(lonely, 1.0, 1 - damping)
    found = at.reshape(n, width).copy()
    for _ in range(0 if lonely.all() else rounds):
        found = at + damping * gathered(found) / degree
    return found


def lexicon(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_seeds: int = 128, min_docs: int = 10, min_share: float = 0.75, damping: float = 0.85, sharpness: float = 3.0) -> dict[bytes, float]:
    """Words with their polarity weights, from -1 (neutral) to 1 (toxic); empty without labels of both kinds.

    Edges weigh their mutual information to the power ``sharpness``, so that a shared language, which
    links a word to very many others weakly, doesn't outweigh the few that it stands with in particular.
    The weight of a toxic word is lessened by the labelled documents that have it and aren't toxic.
    """
    rows = slim(docs, id_col, text_col)
    labelled = rows.join(F.broadcast(sample), "doc_id")
    first = stored(word_counts(labelled.select("text", "toxic"), lambda own, batch, k: batch.column(1)[k].as_py() == 1), "toxic-labelled")
    bad, good = seeds(first, n_seeds)
    if not bad:
        return {}
    texts, known = rows.select("text"), frozenset(bad)
    counts = stored(
        word_counts(texts, lambda own, batch, k: not known.isdisjoint(own))
        .where(F.length("word").eqNullSafe(0) | (F.col("docs") >= min_docs) | F.col("word").isin([*bad, *good])),
        "toxic-counts",
    )
    total = counts.where(F.length("word") == 0).first()
    n_docs, near = total["docs"], associated(counts, min_docs, min_share)
    df = {bytes(r["word"]): r["docs"] for r in counts.where(F.col("word").isin([*bad, *good])).collect()}
    df |= {bytes(r["word"]): r["docs"] for r in near.collect()}
    names = sorted(df)
    node = {w: k for k, w in enumerate(names)}
    n, size = len(names), np.array([df[w] for w in names], float)
    if not n:
        return {}
    ppmi = F.pow(F.ln(F.col("docs") * n_docs / (F.col("si") * F.col("sj"))), F.lit(sharpness)).alias("weight")
    sizes = docs.sparkSession.createDataFrame(pa.table({"k": pa.array(range(n), pa.int32()), "s": size}))
    edges = stored(
        texts.mapInArrow(lambda b: _pairs(b, node), "i int, j int, docs long")
        .groupBy("i", "j").agg(F.sum("docs").alias("docs")).where("docs >= 2")
        .join(sizes.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").join(sizes.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
        .where(F.col("docs") * n_docs > F.col("si") * F.col("sj")).select("i", "j", ppmi),
        "toxic-edges",
    )
    ends = np.array([[w in s for s in (frozenset(bad), frozenset(good))] for w in names], float)
    chance = walk(edges, n, ends, damping)
    mass = chance.sum(1)
    weight = {w: (c[0] - c[1]) / m for w, c, m in zip(names, chance.tolist(), mass.tolist()) if m > 0}
    up = sorted(w for w, x in weight.items() if x > 0)
    for r in first.where(F.col("word").isin(up)).collect() if up else []:
        weight[bytes(r["word"])] *= ((r["some"] + 1) / (r["docs"] + 1)) ** 2
    return weight


def _scores(batches, weight: dict):
    get = weight.get
    for batch in slices(batches):
        n_words, distinct, hits, score = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = words(text)
            kinds = set(own)
            found = [x for x in map(get, kinds) if x is not None]
            n_words.append(len(own))
            distinct.append(len(kinds))
            hits.append(len(found))
            score.append(sum(sorted(found)) if found else 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(distinct, pa.int64()), pa.array(hits, pa.int64()), pa.array(score, pa.float64())],
            ["doc_id", "n_words", "distinct_words", "toxic_words", "weight"],
        )


def scored(docs: DataFrame, weight: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, distinct_words, toxic_words, weight)`` for each row: distinct toxic words and the sum of their weights."""
    up = {w: x for w, x in weight.items() if x > 0}
    schema = f"doc_id {id_type(docs, id_col)}, n_words long, distinct_words long, toxic_words long, weight double"
    return slim(docs, id_col, text_col).mapInArrow(lambda b: _scores(b, up), schema)


def usual_weight(found: DataFrame, sample: DataFrame) -> float:
    """The toxic weight of a distinct word in labelled documents that aren't toxic, on average."""
    row = found.join(F.broadcast(sample.where("toxic = 0")), "doc_id").agg(F.sum("weight").alias("w"), F.sum("distinct_words").alias("n")).first()
    return row["w"] / row["n"] if row["n"] else 0.0


def threshold(scores: DataFrame, sample: DataFrame) -> float:
    """The score from which on labelled documents are best (by F1) taken for toxic; infinite without a toxic one that scores."""
    both = scores.join(F.broadcast(sample), "doc_id").groupBy(F.round("score", 4).alias("score")).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    rows = sorted(both.collect(), reverse=True)
    total, hit, seen, best, at = sum(r["bad"] for r in rows), 0, 0, 0.0, math.inf
    for k, r in enumerate(rows):
        hit, seen = hit + r["bad"], seen + r["n"]
        f1 = 2 * hit / (seen + total)
        if r["score"] > 0 and f1 > best:
            below = rows[k + 1]["score"] if k + 1 < len(rows) else 0.0
            best, at = f1, (r["score"] + max(below, 0.0)) / 2
    return at


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, **induction) -> DataFrame:
    """``(doc_id, n_words, toxic_words, score, toxic)`` for each row of ``docs``.

    NULL, empty and wordless texts score 0 and aren't toxic.  A NULL doc_id is kept and scored.
    Repeated rows are scored each.  Without labels of both kinds, or on an empty table, nothing is
    toxic.  Labels' ids are compared with documents' in their own types.  Words of equal evidence are taken in their order as bytes.
    Texts of any length are read whole.  Other columns are ignored, whatever their names.  ``induction`` goes to :func:`lexicon`.
    """
    require(docs, id_col, text_col)
    sample = stored(labelled_sample(labels, max_labelled, label_col=label_col), "toxic-sample")
    weight = lexicon(docs, sample, text_col, id_col, **induction)
    raw = stored(scored(docs, weight, id_col, text_col), "toxic-scores")
    usual = usual_weight(raw, sample) if weight else 0.0
    score = F.greatest(F.col("weight") - usual * F.col("distinct_words"), F.lit(0.0)).alias("score")
    found = raw.select("doc_id", "n_words", "toxic_words", score)
    least = threshold(found, sample) if weight else math.inf
    return found.withColumn("toxic", F.col("score") >= F.lit(least))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity` doesn't find toxic; columns are unchanged.

    Rows with a NULL id stay, as no decision can be joined to them.  Of an id with several texts, all go if one is toxic.
    """
    (name,) = free(docs, "id_")
    bad = toxicity(docs, labels, id_col, text_col, **options).where("toxic AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, col(docs, id_col) == bad[name], "left_anti")
