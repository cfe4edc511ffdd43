import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswerk.llm import phrases, secrets, simhash, tokens, toxicity, urls
from glosswerk.llm.common import fresh_path, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu", "ti") for b in ("ra", "so", "ve", "xi") for c in ("", "n", "st", "ld")]


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCAB) + rnd.choice(VOCAB) for _ in range(n))


def edges_of(spark):
    return spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (3, " !? \n", "", "", 0), (None, "lone words of a row without an id", "", "", 0)], DOCS)


def copies(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(i, sentence(rnd, rnd.randint(60, 200)), "en", "s", 0) for i in range(150)]
    for k in range(40):
        own = rows[k][1].split()
        for j in range(1 + (k == 0) * 30):
            new = list(own)
            if j % 2 == 0:
                new[rnd.randrange(len(new))] = "zzz" + str(j)
            rows.append((1000 + 100 * k + j, " ".join(new), "en", "s", 0))
    return rows


def groups(n, pairs):
    """Each of n nodes' group, as the least member's number, and its number of links."""
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        links[i] += 1
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(k) for k in range(n)], links


def test_simhash_groups_and_brute_force(spark):
    rows = copies(spark)
    docs = spark.createDataFrame(rows, DOCS).unionByName(edges_of(spark).withColumn("doc_id", F.col("doc_id") + 9000)).withColumn("fp0", F.lit(1)).withColumn("node", F.lit("x")).withColumn("kept", F.lit(0)).withColumn("i", F.lit(0)).withColumn("meta.url", F.lit("u"))
    prints = sorted({(r.doc_id, r.fp0, r.fp1) for r in simhash.fingerprints(docs).collect() if r.fp0 is not None and r.doc_id is not None})
    own = sorted({p[1:] for p in prints})
    u = np.array(own, np.int64).view(np.uint64)
    far = np.bitwise_count(u[:, None] ^ u[None]).sum(2, dtype=int)
    group, links = groups(len(own), [(i, j) for i, j in zip(*np.nonzero(far <= 17)) if i != j])
    least = {}
    for i, *fp in prints:
        g = group[own.index(tuple(fp))]
        least[g] = min(least.get(g, i), i)
    want = {i: (least[group[own.index(tuple(fp))]], links[own.index(tuple(fp))]) for i, *fp in prints}
    for split in (4096, 11):
        got = {r.doc_id: (r.group_id, r.links) for r in simhash.decisions(docs, split=split).collect()}
        assert sum(got[k][0] == v[0] for k, v in want.items()) / len(want) >= 0.97
        assert all(got[k][1] <= v[1] for k, v in want.items()) and sum(x[1] for x in got.values()) >= 0.97 * sum(x[1] for x in want.values())
        assert all(got[1000 + 100 * k][0] == k for k in range(1, 40)) and got[None] == (None, 0) and got[9002] == (9002, 0)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(range(40)) | {9001, 9002, 9003} <= set(ids) and None in ids and not [x for x in ids if x and 1000 <= x < 9000]
    assert simhash.near_dedup(docs.limit(0)).count() == 0 and simhash.decisions(docs.limit(0)).count() == 0


def test_simhash_exact_with_one_grid_of_all(spark):
    """With a single cell the join is exact: every link is found and counted once."""
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, sentence(rnd, 4) + " same words in all of these rows and more of them", "", "", 0) for i in range(120)], DOCS)
    prints = {r.doc_id: (r.fp0, r.fp1) for r in simhash.fingerprints(docs).collect()}
    own = sorted(set(prints.values()))
    u = np.array(own, np.int64).view(np.uint64)
    far = np.bitwise_count(u[:, None] ^ u[None]).sum(2, dtype=int)
    _, links = groups(len(own), [(i, j) for i, j in zip(*np.nonzero(far <= 30)) if i != j])
    assert sum(links) > 100
    for options in ({}, {"split": 7}, {"spare": 0}, {"spare": 1, "split": 3}):
        got = {r.doc_id: r.links for r in simhash.decisions(docs, max_distance=30, **options).collect()}
        assert got == {i: links[own.index(fp)] for i, fp in prints.items()}


def test_simhash_keeps_each_text_of_an_id(spark):
    rnd = random.Random(3)
    one, two, other = sentence(rnd, 80), sentence(rnd, 80), sentence(rnd, 80)
    near = lambda t: t + " extra"
    rows = [(3, near(two)), (5, one), (5, two), (10, near(one)), (7, other), (7, other), (8, "!"), (8, None), (8, "")]
    docs = spark.createDataFrame([(*r, "en", "s", k) for k, r in enumerate(rows)], DOCS)
    found = {(r.doc_id, r.group_id, r.links, r.kept) for r in simhash.decisions(docs).collect()}
    assert found == {(3, 3, 1, True), (5, 3, 1, False), (5, 5, 1, True), (10, 5, 1, False), (7, 7, 0, True), (8, 8, 0, True)}
    got = sorted(((r.doc_id, r.text) for r in simhash.near_dedup(docs).collect()), key=str)
    assert got == sorted([(3, near(two)), (5, one), (7, other), (8, "!"), (8, None), (8, "")], key=str)
    named = docs.withColumn("doc_id", F.concat(F.lit("u-"), "doc_id"))
    assert {r.doc_id for r in simhash.near_dedup(named).collect()} == {"u-10", "u-3", "u-7", "u-8"}


def test_dense_scripts_have_words():
    assert words("語りA b") == ["語".encode(), "り".encode(), b"a", b"b"] and words("café – x") == ["café".encode(), "–".encode(), b"x"]


def test_recall_of_grids():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 2**63, (4000, 2)).astype(np.uint64)
    bits = np.unpackbits(a.view(np.uint8).reshape(-1, 16), axis=1)
    for row in bits:
        row[rnd.choice(128, 17, replace=False)] ^= 1
    b = np.packbits(bits, axis=1).reshape(-1, 16).copy().view(np.uint64)
    for n in (10**4, 10**6, 10**8):
        plan = simhash.grid_plan(n, 17)
        met = np.zeros(len(a), bool)
        for segments in plan:
            met |= simhash._cells(a, segments, 1) == simhash._cells(b, segments, 1)
        assert met.all()


def test_no_grid_plan_loses_a_pair():
    """Differences spread over the blocks as evenly as can be, at the bound and with each number of fingerprints or width of segments."""
    rnd = np.random.default_rng(6)
    a = rnd.integers(0, 2**63, (128, 2)).astype(np.uint64)
    for distance in (0, 1, 3, 17, 30):
        bits = np.unpackbits(a.astype(">u8").view(np.uint8).reshape(-1, 16), axis=1)
        for k, row in enumerate(bits):
            row[(k + np.arange(distance) * 128 // max(distance, 1)) % 128] ^= 1
        b = np.packbits(bits, axis=1).reshape(-1, 16).copy().view(">u8").astype(np.uint64)
        assert (np.bitwise_count(a ^ b).sum(1) == distance).all()
        plans = [(1, simhash.grid_plan(n, distance)) for n in (0, 10**3, 10**5, 10**7, 10**9)]
        plans += [(w, simhash.grid_plan(10**5, distance, w, spare=k)) for w in (1, 2, 4, 8) for k in (0, 1, 2)]
        for width, plan in plans:
            met = np.zeros(len(a), bool)
            for segments in plan:
                met |= simhash._cells(a, segments, width) == simhash._cells(b, segments, width)
            assert met.all()
    assert [len(simhash.grid_plan(n, 17)) for n in (10**3, 10**5, 10**7)] == [1, 18, 128]


def test_simhash_finds_every_link_at_the_bound(spark):
    """Copies with just 17 bits changed: groups and links are those of all pairs."""
    rnd = np.random.default_rng(8)
    own = np.unpackbits(rnd.integers(0, 256, (30, 16)).astype(np.uint8), axis=1)
    near = [row.copy() for row in own for _ in range(6)]
    for row in near:
        row[rnd.choice(128, 17, replace=False)] ^= 1
    u = np.packbits(np.concatenate([own, near]), axis=1).view(">i8").astype(np.int64)
    prints = spark.createDataFrame([(i, i, int(x), int(y)) for i, (x, y) in enumerate(u)], "doc_id long, text_hash long, fp0 long, fp1 long")
    far = np.bitwise_count(u.view(np.uint64)[:, None] ^ u.view(np.uint64)[None]).sum(2, dtype=int)
    group, links = groups(len(u), [(i, j) for i, j in zip(*np.nonzero(far <= 17)) if i != j])
    assert min(links) >= 1
    at = {tuple(map(int, x)): i for i, x in enumerate(u)}
    for options in ({}, {"spare": 0}, {"spare": 1, "split": 50}):
        found = {at[r.fp0, r.fp1]: (r.head.doc_id, r.links) for r in simhash.near_groups(prints, **options).collect()}
        assert found == {i: (group[i], links[i]) for i in range(len(u))}


def test_components_both_ways(spark):
    from glosswerk.llm.components import components

    rnd = random.Random(9)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(3, 3), (None, 1), (5, None)]
    want, _ = groups(1100, [x for x in edges if None not in x])
    df = spark.createDataFrame(edges + edges[:20], "a long, b long")
    for local in (10_000, 0):
        got = {r.id: r.root for r in components(df, local=local).collect()}
        assert got == {k: want[k] for k in range(1100) if k in {x for e in edges if None not in e and e[0] != e[1] for x in e}}
        assert components(df.limit(0), local=local).count() == 0


def test_cells_count_every_link_once(spark):
    from glosswerk.llm import cells

    rnd = np.random.default_rng(1)
    sigs = rnd.integers(0, 3, (300, 8)).astype(np.uint8)
    rows = [(g, int(sigs[k, 2 * g]) * 4 + int(sigs[k, 2 * g + 1]), k, bytearray(sigs[k].tobytes())) for g in range(4) for k in range(300)]
    df = spark.createDataFrame(rows, "grid int, cell long, node long, sig binary")
    near = lambda a, b: np.nonzero((a[:, None] == b[None]).sum(2) >= 6)
    earlier = lambda grid, s: [s[:, 2 * g].astype(int) * 4 + s[:, 2 * g + 1] for g in range(grid)]
    same = (sigs[:, None] == sigs[None]).sum(2) >= 6
    group, links = groups(300, [(i, j) for i, j in zip(*np.nonzero(same)) if i != j and any((sigs[i, 2 * g : 2 * g + 2] == sigs[j, 2 * g : 2 * g + 2]).all() for g in range(4))])
    for split in (4096, 5):
        found = cells.links(df, near, earlier, split=split).collect()
        count = [0] * 300
        for r in found:
            if r.a == r.b:
                count[r.a] += r.links
        assert count == links
        assert groups(300, [(r.a, r.b) for r in found if r.a != r.b])[0] == group
        assert cells.links(df.drop("sig"), near, earlier, df.select("node", "sig").distinct(), split).count() == len(found)
    assert cells.links(df.limit(0), near, earlier).count() == 0


def test_manhattan_is_a_lower_bound():
    rnd = np.random.default_rng(0)
    u = rnd.integers(0, 2**63, (300, 2)).astype(np.uint64)
    v = simhash.unary(u)
    low, far = np.bitwise_count(v[:, None] ^ v[None]).sum(2), np.bitwise_count(u[:, None] ^ u[None]).sum(2)
    bits = np.unpackbits(u.view(np.uint8).reshape(300, 16), axis=1, bitorder="little").reshape(300, 64, 2).sum(2).astype(int)
    assert (low <= far).all() and (low == np.abs(bits[:, None] - bits[None]).sum(2)).all()


def test_toxicity_on_held_out_labels(spark):
    rnd = random.Random(2)
    bad = ["vile", "foul", "grim", "rank"]
    rows, labels = [], []
    for i in range(900):
        own = sentence(rnd, 80).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                own[rnd.randrange(80)] = rnd.choice(bad)
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS).unionByName(edges_of(spark).withColumn("doc_id", F.col("doc_id") + 5000)).withColumn("toxic", F.lit("x")).withColumn("word", F.lit(1)).withColumn("score", F.lit(1))
    known = spark.createDataFrame([x for x in labels if x[0] < 500] + [(None, 1), (7, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [x for x in labels if x[0] >= 500]
    assert sum(got[i].toxic == bool(t) for i, t in held) / len(held) >= 0.97
    assert not got[5001].toxic and got[5001].score == 0 and not got[None].toxic and len(got) == 904
    out = toxicity.reject_toxic(docs, known)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, r in got.items() if not r.toxic}
    assert not any(r.toxic for r in toxicity.toxicity(docs, known.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def test_lexicon_has_no_fixed_caps(spark):
    counts = [(b"", 1000, 300)] + [(b"bad%d" % k, 20, 20) for k in range(200)] + [(b"fine%d" % k, 50, 0) for k in range(300)]
    bad, good = toxicity.seeds(spark.createDataFrame(counts, "word binary, docs long, some long"))
    assert len(bad) == 200 and len(good) == 200
    rnd = random.Random(4)
    rows = []
    for i in range(1500):
        own = sentence(rnd, 60).split()
        if i % 10 == 0:
            own[:3] = rnd.choices(["vile", "foul", "grim", "rank"], k=3)
        if i >= 500 and (i % 10 == 0 and i < 1100 or i % 10 == 5 and i < 1100):
            own[5] = "murk"
        rows.append((i, " ".join(own), "en", "s", 0))
    known = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "doc_id long, toxic int")
    weight = toxicity.lexicon(spark.createDataFrame(rows, DOCS), known)
    assert weight[b"vile"] > 0 and weight.get(b"murk", 0) > 0


def test_walk_against_power_series(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0)], "i int, j int, weight double").repartition(2)
    p = np.array([[0, 1, 0, 0], [0.25, 0, 0.75, 0], [0, 1, 0, 0], [0, 0, 0, 0]])
    ends = np.array([[1.0, 0, 0, 1], [0, 0, 1, 0]]).T
    want = sum(0.15 * np.linalg.matrix_power(0.85 * p, k) @ ends for k in range(31))
    want[3] = [1, 0]
    np.testing.assert_allclose(toxicity.walk(edges, 4, ends, rounds=30), want)
    np.testing.assert_allclose(toxicity.walk(edges.limit(0), 4, ends), ends)


def plain_toxicity(rows, labels, n_seeds=128, min_docs=10, min_share=0.75):
    """The same from first principles: sets of words, dictionaries of counts, a dense matrix for the walk."""
    import math

    import xxhash

    def counted(rows, marked):
        docs, some = {}, {}
        for i, text in rows:
            tokens = words(text)
            if not tokens:
                continue
            runs = [b" ".join(tokens[k : k + 3]) for k in range(len(tokens) - 2)] if len(tokens) > 3 else [b" ".join(tokens)]
            key = min(map(xxhash.xxh3_64_intdigest, runs)) >> 1
            for w in {*tokens, b""}:
                if marked(i, set(tokens)):
                    some.setdefault(w, set()).add(key)
                else:
                    docs[w] = docs.get(w, 0) + 1
        return {w: (docs.get(w, 0) + len(some.get(w, ())), len(some.get(w, ()))) for w in {*docs, *some}}

    first = counted([(i, t) for i, t in rows if i in labels], lambda i, own: labels[i] == 1)
    n, bad_n = first.pop(b"")
    share = bad_n / n
    sure = {w: (k + 1) / (d + 2) for w, (d, k) in first.items() if d >= 5}
    z = {w: (first[w][1] - first[w][0] * share) / math.sqrt(first[w][0] * share + 1) for w in sure}
    bad = [w for w in sure if sure[w] >= max(0.75, min(0.9, 2 * share)) and z[w] >= 4]
    good = sorted((w for w in sure if sure[w] <= 1.25 * share), key=lambda w: (-first[w][0], w))[: max(n_seeds, len(bad))]
    every = counted(rows, lambda i, own: bool(own & set(bad)))
    n_docs, near = every.pop(b"")
    tested = {w: x for w, x in every.items() if x[0] >= min_docs or w in bad or w in good}
    tested = {w: x for w, x in tested.items() if x[0] >= min_docs}
    share, bar = near / n_docs, max(4.0, math.sqrt(2 * math.log(max(len(tested), 2))))
    base = min(2 * share, (1 + share) / 2)
    nodes = sorted({*bad, *good} | {w for w, (d, k) in tested.items() if k > d * share and (k >= d * min_share or (k - d * base) / math.sqrt(d * base * (1 - base) + 1) >= bar)})
    together = np.zeros((len(nodes), len(nodes)))
    for _, text in rows:
        own = [k for k, w in enumerate(nodes) if w in set(words(text))]
        together[np.ix_(own, own)] += 1
    size = np.array([every[w][0] for w in nodes], float)
    with np.errstate(divide="ignore"):
        weight = np.where(together >= 2, np.maximum(np.log(together * n_docs / np.outer(size, size)), 0) ** 3, 0)
    np.fill_diagonal(weight, 0)
    degree = weight.sum(1)
    p = weight / np.where(degree == 0, 1, degree)[:, None]
    ends = np.array([[w in bad, w in good] for w in nodes], float)
    chance = at = ends * np.where(degree == 0, 1, 0.15)[:, None]
    for _ in range(40):
        chance = at + 0.85 * p @ chance
    polarity = {w: (a - b) / (a + b) for w, (a, b) in zip(nodes, chance) if a + b > 0}
    up = {w: x * ((first[w][1] + 1) / (first[w][0] + 1)) ** 2 if w in first else x for w, x in polarity.items() if x > 0}
    kinds = {i: set(words(t)) for i, t in rows}
    raw = {i: sum(sorted(up[w] for w in own if w in up)) for i, own in kinds.items()}
    clean = [i for i in raw if labels.get(i) == 0]
    usual = sum(raw[i] for i in clean) / sum(len(kinds[i]) for i in clean)
    score = {i: max(raw[i] - usual * len(kinds[i]), 0.0) for i in raw}
    tried = sorted({round(score[i], 4) for i in labels if i in score}, reverse=True)
    f1 = lambda t: 2 * sum(labels[i] == 1 for i in labels if round(score[i], 4) >= t) / (sum(round(score[i], 4) >= t for i in labels) + sum(labels.values()))
    best = max((t for t in tried if t > 0), key=lambda t: (f1(t), t))
    below = max([t for t in tried if t < best], default=0.0)
    return up, score, {i for i in score if score[i] >= (best + max(below, 0)) / 2}


def test_toxicity_against_plain_python(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(700):
        own = sentence(rnd, rnd.choice([20, 60, 400])).split()
        if i % 9 == 0:
            for w in rnd.choices(["vile", "foul", "grim", "rank", "murk"], k=4):
                own[rnd.randrange(len(own))] = w
        elif i % 50 == 7:
            own[3] = "murk"
        rows.append((i, " ".join(own)))
    rows += [(1000 + k, rows[9][1]) for k in range(5)]
    labels = {i: int(i % 9 == 0) for i in range(400)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    up, score, toxic = plain_toxicity(rows, labels)
    weight = {w: x for w, x in toxicity.lexicon(docs, toxicity.labelled_sample(known, 20_000)).items() if x > 0}
    assert weight.keys() == up.keys() and b"vile" in up
    for w in up:
        assert weight[w] == pytest.approx(up[w], rel=1e-9)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(score, abs=1e-9)
    assert {i for i, r in got.items() if r.toxic} == toxic
    assert {i for i in range(400, 700) if i % 9 == 0} <= toxic and not [i for i in toxic if i < 1000 and i % 9 and i % 50 != 7]


def test_phrases(spark):
    assert phrases.parse(b"x y x y x".split()) == {b"x", b"y", b"x y"} and phrases.parse([]) == set()
    rows = copies(spark, 3)
    docs = spark.createDataFrame(rows, DOCS).unionByName(edges_of(spark).withColumn("doc_id", F.col("doc_id") + 9000)).withColumn("signature", F.lit(1)).withColumn("cell", F.lit("x")).withColumn("a.b", F.lit("x"))
    got = {r.doc_id: r for r in phrases.fingerprints(docs).collect()}
    assert sum(got[1000 + 100 * k].group_id == k for k in range(40)) == 40 and got[9001].fingerprint is None and got[9001].group_id == 9001 and got[None].group_id is None
    sets = {i: phrases.parse(text.lower().encode().split()) for i, text, *_ in rows}
    off = [abs(r.similarity - len(sets[i] & sets[r.group_id]) / len(sets[i] | sets[r.group_id])) for i, r in got.items() if i is not None and i < 9000 and i != r.group_id]
    assert np.mean(off) < 0.08
    assert phrases.fingerprints(docs.limit(0)).count() == 0


def test_phrase_groups_against_all_pairs(spark):
    rows = copies(spark, 6)
    rows += [(0, rows[5][1] + " z", "", "", 0), (0, rows[5][1] + " z", "", "", 0), (7, "", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    signed = {(r.doc_id, bytes(r.signature)) for r in phrases.signatures(docs).collect() if r.signature is not None}
    own = sorted({s for _, s in signed})
    m = np.array([list(s) for s in own], np.uint8)
    same = phrases.similarity((m[:, None] == m[None]).mean(2)) >= phrases.LEAST
    met = (m[:, None].reshape(len(m), 1, 16, 4) == m[None].reshape(1, len(m), 16, 4)).all(3).any(2)
    group, links = groups(len(own), [(i, j) for i, j in zip(*np.nonzero(same & met)) if i != j])
    assert (same & met).sum() >= 0.995 * same.sum()
    least = {}
    for i, s in signed:
        g = group[own.index(s)]
        least[g] = min(least.get(g, i), i)
    want = {(i, s.hex()): (least[group[own.index(s)]], links[own.index(s)]) for i, s in signed}
    for split in (4096, 9):
        got = {(r.doc_id, r.fingerprint): (r.group_id, r.links) for r in phrases.fingerprints(docs, split=split).collect() if r.fingerprint}
        assert got == want


def test_secrets_ledger(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [("a", 1, f"x {key} y"), ("a", 2, "nothing"), ("b", 1, f"x {key} y"), ("c", 1, None), ("d", 1, ""), (None, None, "password=abcdefgh1"), ("a", 1, f"x {key} y")]
    history = spark.createDataFrame(rows, "path string, version long, content string").withColumn("blob", F.lit(1)).withColumn("seen", F.lit(1)).withColumn("a.b", F.lit(1))
    ledger = secrets.Ledger(spark, fresh_path(spark, "ledger"))
    found = ledger.update(history).collect()
    assert sorted(((r.path, r.version, r.rule) for r in found), key=str) == sorted([("a", 1, "aws-key"), ("a", 1, "aws-key"), ("b", 1, "aws-key"), (None, None, "password")], key=str)
    n = ledger.pairs().count()
    assert n == 4 * len(secrets.RULES)
    done, hits, _ = secrets.scan(history, ledger.pairs())
    assert done.count() == 0 and hits.count() == 0
    later = spark.createDataFrame([("e", 1, "token = abcdefghijklmnop1"), ("f", 1, "nothing")], "path string, version long, content string")
    assert [r.path for r in ledger.update(later).collect()] == ["e"] and ledger.pairs().count() == n + len(secrets.RULES)
    changed = tuple(r._replace(version=3, anchors=("noth",), pattern="noth[a-z]*") if r.name == "slack" else r for r in secrets.RULES)
    assert [(r.path, r.rule_version) for r in ledger.update(later, changed).where("rule = 'slack'").collect()] == [("f", 3)]
    assert ledger.update(history.limit(0)).count() == 0


def test_secret_names():
    import re

    found = lambda text: [r.name for r in secrets.RULES if any(a in text for a in r.anchors) and re.search(r.pattern, text)]
    key = "abcdefghijklmnop12"
    for text, rule in ((f"aws_secret_access_key = {key}", "token"), ('{"password": "hunter2hunter"}', "password"), (f"Api-Key: {key}", "token"), (f"API-KEY={key}", "token"), (f"apiKey = '{key}'", "token"), (f"auth_token_v2:{key}", "token"), ("PWD=aaaabbbbcc", "password")):
        assert found(text) == [rule], text
    assert not found("the secret of the token is short: no") and not found("")


def test_secrets_of_documents(spark):
    rows = [(1, "Api-Key: abcdefghijklmnop12", "en", "s", 0), (2, "password=abcdefgh1", "en", "s", 0), (3, None, "en", "s", 0), (4, "password=abcdefgh1", "en", "t", 0), (5, "x " * 50000 + "token=abcdefghijklmnop12", "en", None, 0)]
    got = secrets.document_secrets(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.path, r.rule, r.rule_version) for r in got) == [(1, "s/0", "token", 2), (2, "s/0", "password", 2), (4, "t/1", "password", 2), (5, "1", "token", 2)]
    assert len({r.blob for r in got}) == 3


def test_urls(spark):
    pages, labels = [], []
    for i in range(60):
        kind = ("good", "news", "spam")[i % 3]
        pages.append((i, f"https://Site.example/{kind}/{i}?q=1#x", "h"))
        labels.append((i, int(kind != "spam")))
    pages += [(100, None, None), (101, "no url", ""), (102, "https://other.example", ""), (None, "https://site.example/good/9", ""), (103, "https://deep.example/" + "/".join("abcdefghij"), ""), (5, "https://site.example/good/1", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("good", F.lit("x")).withColumn("path", F.lit(0)).withColumn("a.b", F.lit(0))
    got = urls.templates(df, spark.createDataFrame(labels + [(None, 1), (100, None)], "page_id long, good int")).collect()
    by = {r.page_id: r for r in got if r.page_id not in (None, 5)}
    assert len(got) == len(pages)
    assert by[2].template == "/spam/{n}" and by[2].rejected and not by[0].rejected and by[0].purity > 0.9
    assert by[100].host is None and by[101].template is None and by[102].template == "" and by[103].template == "/a/b/c/d/e/**" and not by[100].rejected
    none = urls.templates(df, spark.createDataFrame([], "page_id long, good int")).collect()
    assert not any(r.rejected for r in none) and {r.template for r in none if r.host == "site.example"} == {"/*/{n}"}
    assert urls.templates(df.limit(0), spark.createDataFrame(labels, "page_id long, good int")).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan(spark, block, tmp_path):
    rnd = random.Random(block)
    want = {}
    for name in "ab":
        ids = [rnd.choice([9, 1, 2]) for _ in range(50)] + [1] * (name == "b") * 20
        np.array(ids, "<u2").tofile(tmp_path / f"{name}.tokens")
        start = 0
        for k, x in enumerate(" ".join(map(str, ids)).replace("9", "|").split("|")):
            n = len(x.split())
            want[name, k] = (start, n)
            start += n + 1
        if not n:
            del want[name, k]
    (tmp_path / "empty.tokens").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / f),) for f in ("a.tokens", "b.tokens", "empty.tokens", "a.tokens")] + [(None,)], "file string")
    got = {(r.file.rsplit("/", 1)[1][0], r.document): (r.start, r.tokens) for r in tokens.scan(files, eod=9, block=block).collect()}
    assert got == want


def test_token_counts(spark):
    rows = [(1, "Hello world, it's <|endoftext|> 12 of them", "", "", 0), (2, None, None, None, None), (3, "", "", "", 0), (None, "x y", "", "", 0), (1, "twice", "", "", 0), (4, "long " * 20000, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("file", F.lit(1)).withColumn("document", F.lit("x"))
    encode = tokens.encoder()
    with pytest.raises(ValueError):
        tokens.ranks(eod=0)
    with pytest.raises(ValueError):
        tokens.ranks(eod=1 << 16)
    got = sorted(((r.doc_id or 0, r.tokens) for r in tokens.token_counts(docs, block=64).collect()))
    assert got == sorted(((i or 0), len(encode(t)) if t else 0) for i, t, *_ in rows)
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage's rows against plain Python: planted toxic documents, repeated lines, near copies, uneven sources."""
    import corpus_pipeline
    from glosswerk.llm import mixing

    from test_lines import brute

    rnd = random.Random(8)
    text = lambda n: "\n".join(sentence(rnd, n) for _ in range(6))
    rows = [(i, text(14), "en", "big" if i % 5 else "small", 0) for i in range(240)]
    toxic = [i for i in range(240) if i % 6 == 1]
    for i in toxic:
        own = rows[i][1].split(" ")
        for w in rnd.choices(["vile", "foul", "grim", "rank"], k=4):
            own[rnd.randrange(len(own))] = w
        rows[i] = (i, " ".join(own), *rows[i][2:])
    clean = [i for i in range(240) if i % 6 != 1]
    for k, i in enumerate(clean[:20]):
        own = rows[i][1].split("\n")
        changed = [" ".join(w + "q" if n == k % 9 else w for n, w in enumerate(x.split())) for x in own[:3]]
        rows.append((1000 + i, "\n".join([*changed, *own[3:]]), "en", "big", 0))
    for i in clean[20:30]:
        rows.append((2000 + i, text(10) + "\n" + rows[i][1].split("\n")[0], "en", "small", 0))
    rows += [(3000 + i, rows[i][1], "en", "big", 0) for i in clean[30:40]]
    rows += [(300, None, None, None, None), (301, "", "en", "big", 0), (None, "q w", "en", "small", 3), (302, "---", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    after, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, str(tmp_path)).persist()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        seen.append(sorted(((r.doc_id, r.text, r.source) for r in after.collect()), key=str))
    one = sorted(((i, t, s) for i, t, _, s, _ in rows if i not in toxic), key=str)
    assert seen[0] == one
    gone = {}
    for i, n, *_ in brute([(i, t) for i, t, _ in one]):
        gone.setdefault(i, set()).add(n)
    two = []
    for i, t, s in one:
        left = t if i not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if i not in gone or left.strip():
            two.append((i, left, s))
    assert seen[1] == sorted(two, key=str) and len(two) < len(one)
    three = seen[2]
    assert {x[0] for x in three} == {x[0] for x in two} - {1000 + i for i in clean[:20]} and set(three) <= set(two)
    count = lambda t: len(t.split()) if t else 0
    sources = sorted({s for _, t, s in three if count(t)}, key=str)
    own = np.array([sum(count(t) for _, t, x in three if x == s) for s in sources], float)
    q = (own / own.sum()) ** mixing.exponent(own, mixing.ENTROPY, mixing.REPEATS, own.sum())
    longest = max(count(t) for _, t, _ in three)
    for s, budget in zip(sources, np.floor(q / q.sum() * own.sum())):
        assert budget - longest < sum(count(t) for _, t, x in seen[3] if x == s) <= budget
    assert set(seen[3]) <= set(three)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {}
    for i, t, _ in seen[3]:
        if count(t):
            total[i] = total.get(i, 0) + count(t)
    packed = {}
    for r in out:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.tokens
    assert packed == total
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r.tokens)
    assert all(sum(b) <= 8192 and len(b) <= 64 and sum(x * x for x in b) <= 8192 * 8192 // 2 for b in bins.values())
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_near_dedup_leaves_no_near_pair(spark, tmp_path):
    """Of copies up to the bound only the least id of each group by all pairs stays."""
    import corpus_pipeline

    rnd = random.Random(12)
    rows = []
    for i in range(150):
        own = sentence(rnd, 60).split()
        rows.append((i, " ".join(own), "en", "s", 0))
        for k in range(2):
            new = list(own)
            for at in rnd.sample(range(len(new)), 3):
                new[at] += f"q{k}"
            rows.append((1000 + 10 * i + k, " ".join(new), "en", "s", 0))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    prints = sorted((r.doc_id, r.fp0, r.fp1) for r in simhash.fingerprints(docs).collect())
    u = np.array([p[1:] for p in prints], np.int64).view(np.uint64)
    far = np.bitwise_count(u[:, None] ^ u[None]).sum(2, dtype=int)
    assert ((far >= 14) & (far <= 17)).sum() > 100
    group, _ = groups(len(prints), [(i, j) for i, j in zip(*np.nonzero(far <= 17)) if i != j])
    want = {prints[g][0] for g in group}
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, str(tmp_path)).collect()} == want


def test_pipeline_near_dedup_places_each_text_of_an_id(spark, tmp_path):
    """Ids with several texts, lines dropped before: no near pair of texts that are still there is left, and none goes for a text that isn't."""
    import corpus_pipeline

    rnd = random.Random(14)
    text = lambda: [sentence(rnd, 12) for _ in range(8)]

    def near(lines, k):
        """One line has other words: line dedup leaves this line only."""
        return [" ".join(w + "q" * (n % 3 == k % 3) for n, w in enumerate(x.split())) if at == k % 8 else x for at, x in enumerate(lines)]

    texts = []
    for i in range(40):
        own = text()
        texts += [(i, own), (200 + i, near(own, i)), (200 + i, text())]  # a near copy and another text
        if i % 4 == 0:
            texts.append((300 + i, near(own, i + 1)))  # a near copy alone
        if i % 4 == 1:
            # Line by line a copy of two texts, so it goes, and a near copy of it whose id is larger.
            mixed = [a if k % 2 else b for k, (a, b) in enumerate(zip(own, texts[0][1]))]
            texts += [(100 + i, mixed), (100 + i, text()), (400 + i, near(mixed, i))]
    rows = [(i, "\n".join(x), str(k), "s", 0) for k, (i, x) in enumerate(texts)]  # lang tells rows apart
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    two = corpus_pipeline.dedup_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).persist()
    changed = {r.lang: r.text for r in two.collect()}

    def stay(present):
        """Those that stay of (lang, id, text): the least of each group by all pairs."""
        present = sorted((i, h, k) for k, i, h in present)
        u = np.array([prints[h] for _, h, _ in present], np.int64).view(np.uint64)
        far = np.bitwise_count(u[:, None] ^ u[None]).sum(2, dtype=int)
        group, _ = groups(len(u), [(a, b) for a, b in zip(*np.nonzero(far <= 17)) if a != b])
        return {present[g][2] for g in group}

    everything = spark.createDataFrame([(0, t) for t in {r[1] for r in rows} | set(changed.values())], "doc_id long, text string")
    hashes = {r.text: r.h for r in everything.select("text", F.xxhash64("text").alias("h")).collect()}
    prints = {r.text_hash: (r.fp0, r.fp1) for r in simhash.fingerprints(everything).collect()}
    first = stay([(k, i, hashes[t]) for i, t, k, *_ in rows if k in changed])
    want = stay([(k, i, hashes[changed[k]]) for i, t, k, *_ in rows if k in first])
    whole = {k: (i, t) for i, t, k, *_ in rows}
    assert sum(k not in first and changed[k] != whole[k][1] and 200 <= whole[k][0] < 300 for k in changed) > 10
    assert sum(k not in changed for k in whole) >= 3
    assert {r.lang for r in corpus_pipeline.dedup_near(spark, two, str(tmp_path)).collect()} == want


def test_pipeline_near_dedup_moves_texts_once(spark, tmp_path):
    """A table that repeats rows and ids loses the right rows, and its texts aren't shuffled again and again for it."""
    import corpus_pipeline

    rnd = random.Random(13)
    rows = []
    for i in range(400):
        own = [f"{rnd.getrandbits(64):x}" for _ in range(300)]
        rows.append((i, " ".join(own), "en", "s", 0))
        if i % 2:
            rows.append((i, " ".join(own), "en", "s", 0))  # the same row
            rows.append((i, " ".join(own), "de", "s", 0))  # the same id and text
        if i % 5 == 0:
            rows.append((i, " ".join(own[::-1] + [f"{rnd.getrandbits(256):x}" for _ in range(300)]), "en", "s", 0))  # another text
        if i % 7 == 0:
            rows.append((1000 + i, " ".join(own[:-1]), "en", "s", 0))  # a near copy
    rows += [(None, rows[0][1], "en", "s", 0)] * 2 + [(3000, None, "en", "s", 0)] * 2 + [(3001, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def shuffled():
        done = spark.sparkContext._jsc.sc()
        done.listenerBus().waitUntilEmpty(30_000)
        groups = done.statusStore().executorList(False)
        return sum(groups.apply(k).totalShuffleWrite() for k in range(groups.size()))

    before = shuffled()
    out = corpus_pipeline.dedup_near(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.lang) for r in out.collect())
    moved = shuffled() - before
    least = {}
    for i, text, lang, *_ in rows:
        if i is not None and not 1000 <= i < 3000:
            least[i, text] = min(lang, least.get((i, text), lang))
    want = Counter((i, text, lang) for (i, text), lang in least.items()) + Counter({(None, rows[0][1], "en"): 2})
    assert got == want
    assert moved < 1.6 * sum(len(r[1] or "") for r in rows), moved
