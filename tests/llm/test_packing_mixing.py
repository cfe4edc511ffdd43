import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswerk.llm import mixing
from glosswerk.llm.packing import pack, packed, piece_length

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_pack(lengths, capacity, max_docs, max_attention, rule, weights):
    caps, bins, out = (capacity, max_docs, max_attention), [], []
    for n in lengths:
        demand, best = (n, 1, n * n), None
        for k, left in enumerate(bins):
            if any(a > b for a, b in zip(demand, left)):
                continue
            if rule == "norm":
                score = -sum(w * ((b - a) / c) ** 2 for w, a, b, c in zip(weights, demand, left, caps))
            else:
                score = sum(w * (a / c) * (b / c) for w, a, b, c in zip(weights, demand, left, caps))
            if best is None or score > best[0] + 1e-12:
                best = (score, k)
        if best is None:
            bins.append(list(caps))
            best = (0, len(bins) - 1)
        bins[best[1]] = [b - a for a, b in zip(demand, bins[best[1]])]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pack_brute_force(rule):
    rnd = random.Random(3)
    for _ in range(20):
        lengths = sorted((rnd.randint(1, 70) for _ in range(120)), reverse=True)
        weights = (1.0, rnd.choice([0.5, 1.0]), 2.0)
        assert pack(np.array(lengths), 100, 5, 5000, rule, weights).tolist() == brute_pack(lengths, 100, 5, 5000, rule, weights)


def test_packed(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.randint(0, 1) + "x" for _ in range(rnd.randint(0, 300))), "en", "s", 0) for i in range(400)]
    rows += [(400, " ".join("y" for _ in range(5000)), "en", "s", 0), (401, None, None, None, None), (402, "", "", "", 0), (None, "a b", "", "", 0), (5, rows[5][1], "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tokens", F.lit("x")).withColumn("bin_id", F.lit(1)).withColumn("shard", F.lit(1))
    got = packed(docs, capacity=256, max_docs=6, max_attention=256 * 128, shard_docs=64).collect()
    bins, whole = {}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.tokens)
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
    assert all(sum(b) <= 256 and len(b) <= 6 and sum(x * x for x in b) <= 256 * 128 for b in bins.values())
    want = {}
    for i, text, *_ in rows:
        if text and text.split():
            want[i] = want.get(i, 0) + len(text.split())
    assert whole == want and len({r.bin_id >> 32 for r in got}) > 3
    one = sorted((r for r in got if r.doc_id == 400), key=lambda r: r.piece)
    assert piece_length(256, 6, 256 * 128) == 128
    assert [r.start for r in one] == [k * 128 for k in range(len(one))] and sum(r.tokens for r in one) == 5000
    assert packed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packed(docs, rule="best")


def test_piece_length():
    assert piece_length(8192, 64, 8192 * 8192 // 2) == 4096 and piece_length(100, 9, 10**6) == 100 and piece_length(100, 1, 400) == 20
    for capacity, docs, attention in ((100, 7, 3000), (64, 64, 100), (10, 3, 10)):
        fill = max((k * n, -k, n) for k in range(1, docs + 1) for n in range(1, capacity + 1) if k * n <= capacity and k * n * n <= attention)
        own = piece_length(capacity, docs, attention)
        assert own * min(docs, capacity // own, attention // own**2) >= fill[0]


def test_fill_and_hot_rows(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["x"] * min(3000, int(rnd.paretovariate(0.6) * 20))), "en", "s", 0) for i in range(3000)]
    rows += [(None, "a b c", "", "", 0)] * 1500 + [(7, rows[7][1], "", "", 0)] * 500 + [(9000, "y " * 300_000, "", "", 0)]
    got = packed(spark.createDataFrame(rows, DOCS), shard_docs=512).collect()
    bins, shards = {}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.tokens)
        shards[r.bin_id >> 32] = shards.get(r.bin_id >> 32, 0) + 1
    assert all(sum(b) <= 8192 and len(b) <= 64 and sum(x * x for x in b) <= 8192 * 8192 // 2 for b in bins.values())
    assert sum(r.tokens for r in got) == sum(len(r[1].split()) for r in rows)
    assert max(shards.values()) < 700 and sum(r.doc_id is None for r in got) == 1500
    prose = [(i, "x " * rnd.randint(50, 3000), "en", "s", 0) for i in range(1000)] + [(9000, "y " * 300_000, "", "", 0)]
    fill = [(r.bin_id, r.tokens) for r in packed(spark.createDataFrame(prose, DOCS), shard_docs=512).collect()]
    assert sum(t for _, t in fill) / (8192 * len({b for b, _ in fill})) >= 0.95
    named = spark.createDataFrame([("u-1", "a b"), ("u-2", "c")], "id string, text string").withColumn("a.b", F.lit(1))
    assert sorted((r.doc_id, r.tokens) for r in packed(named, "id").collect()) == [("u-1", 2), ("u-2", 1)]


def test_exponent_meets_targets():
    tokens = np.array([1000.0, 100.0, 10.0])
    for goal in (0.7, 0.9, 0.99):
        a = mixing.exponent(tokens, goal, 1e9, tokens.sum())
        q = (tokens / tokens.sum()) ** a
        q /= q.sum()
        assert -(q * np.log(q)).sum() / math.log(3) == pytest.approx(goal, abs=1e-9)
    a = mixing.exponent(tokens, 1.0, 3.0, tokens.sum())
    q = (tokens / tokens.sum()) ** a
    q /= q.sum()
    assert (q * tokens.sum() / tokens).max() == pytest.approx(3.0, abs=1e-9)
    assert mixing.exponent(np.array([5.0]), 0.5, 2, 5.0) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent(tokens, 0.5, 2.0, 10 * tokens.sum())


def test_mixture(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("x" * rnd.randint(1, 40)), "en", "big", 0) for i in range(600)]
    rows += [(1000 + i, " ".join("x" * rnd.randint(1, 40)), "en", "small", 0) for i in range(60)]
    rows += [(2000 + i, "a b c", "en", None, 0) for i in range(20)] + [(3000, None, "en", "small", 0), (3001, "", "", "none", 0), (None, "q", "", "small", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("bk", F.lit(1)).withColumn("epoch", F.lit("x")).withColumn("upto", F.lit(1)).withColumn("meta.url", F.lit(1)).withColumn("__gw_kept", F.lit(1))
    with pytest.raises(ValueError):
        mixing.mix(docs, budget=10**9)
    got = mixing.mix(docs, entropy=0.8, repeats=4.0, block_docs=16).collect()
    count = lambda t: len(t.split()) if t else 0
    own = {}
    for _, text, _, source, _ in rows:
        own[source] = own.get(source, 0) + count(text)
    n = np.array([own[s] for s in ("big", "small", None)], float)
    q = (n / n.sum()) ** mixing.exponent(n, 0.8, 4.0, n.sum())
    budget = np.floor(q / q.sum() * n.sum())
    drawn = {s: sum(r.tokens for r in got if r.source == s) for s in ("big", "small", None)}
    for s, b in zip(("big", "small", None), budget):
        assert b - 40 < drawn[s] <= b
    assert not any(r.source == "none" for r in got)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    small = [r for r in got if r.source == "small"]
    whole = int(budget[1] // n[1])
    assert whole >= 1 and all(sum(r.epoch == e for r in small) == 62 for e in range(whole))
    for e in range(whole):
        for b in {r.block for r in small}:
            assert [r.position for r in sorted((r for r in small if (r.epoch, r.block) == (e, b)), key=lambda r: r.position)] == list(range(1, 1 + sum((r.epoch, r.block) == (e, b) for r in small)))
    out = mixing.mixed(docs, entropy=0.8, repeats=4.0, block_docs=16)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == sorted((r.doc_id or -1) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
