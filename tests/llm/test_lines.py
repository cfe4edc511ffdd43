import random

from pyspark.sql import functions as F

from glosswerk.llm.common import words
from glosswerk.llm.lines import drop_lines, marks, repeated_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows, near_words=5):
    lines = []
    for i, text in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        lines += [((i, n), x.strip(" \t\r\x0b\x0c"), words(x)) for n, x in enumerate(text.split("\n")) if words(x)]
    out = set()
    for k, (at, x, a) in enumerate(lines):
        for first, y, b in lines[:k]:
            if x == y or min(len(a), len(b)) >= near_words and marks(x) == marks(y) and near(a, b):
                out.add((*at, *first))
                break
    return out


def corpus(seed, n=40):
    rnd = random.Random(seed)
    vocab = ["wa", "wb", "wc", "wd", "we", "ß", "é", "7", "x.y", "+", "-1", "'q'", "語り", "(wa)", "Wa,"]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 14))] for _ in range(30)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(base))
            kind, at = rnd.random(), rnd.randrange(len(line))
            if kind < 0.2:
                line[at] = rnd.choice(vocab)
            elif kind < 0.4:
                line.insert(at, rnd.choice(vocab))
            elif kind < 0.6 and len(line) > 1:
                del line[at]
            own.append(" ".join(line) + rnd.choice(["", ".", "  "]))
        rows.append((i, "\n".join(own)))
    return rows


def test_brute_force(spark):
    for seed, near_words in ((0, 5), (1, 5), (2, 5), (9, 2)):
        rows = corpus(seed)
        got = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), near_words=near_words).collect()
        assert {tuple(r) for r in got} == brute(rows, near_words) and len(got) == len(set(got))


def test_code_and_numbers_are_not_near(spark):
    code = ["x = a + b * c - d / e", "x = a - b / c * d + e", "the sum of all is 15 here now", "the sum of all is 16 here now", "if a < b then go to c", "if a > b then go to c", "}", "}", "---", "return x", "return  x", "Return x", "see f(a,b) for all of this", "see f(a b) for all of that"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(code)], "doc_id long, text string")
    assert [tuple(r) for r in repeated_lines(docs).collect()] == []
    prose = ["We thank you, all of you.", "we thank you all of you", "  We thank him all of you!\r", "We \"thank\" you all of 'you'"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(prose)], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc) for r in repeated_lines(docs).collect()} == {(1, 0), (2, 0), (3, 0)}


def test_a_variant_that_very_many_share(spark):
    base = "thank you for your order {} and please come again to us soon"
    letters = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(600)]
    docs = spark.createDataFrame([(k, base.format(x)) for k, x in enumerate(letters)] + [(1000, base.format("") + "\nown")], "doc_id long, text string")
    got = repeated_lines(docs).collect()
    assert len(got) == 600 and {r.first_doc for r in got} == {0}
    assert [(r.doc_id, r.text) for r in drop_lines(docs).orderBy("doc_id").collect()] == [(0, base.format("aa")), (1000, "own")]


def test_edges(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    rows = [
        (1, "a b c d e f\nown words of the first one", "en", "s", 1), (2, "A, b c d e f!\nb c d", None, None, None), (2, "A, b c d e f!\nb c d", None, None, None),
        (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 1), (5, long, "en", "s", 1), (6, long + " more", "en", "s", 1),
        (7, "a b c d e f\n\n", "en", "s", 1), (8, "b c d\n\nb c d", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit(1)).withColumn("h0", F.lit("x")).withColumn("first", F.lit(0)).withColumn("meta.url", F.lit("u")).withColumn("gone", F.lit(1)).withColumn("kept", F.lit(1)).withColumn("id_", F.lit(1))
    assert {tuple(r) for r in repeated_lines(docs).collect()} == {(2, 0, 1, 0), (6, 0, 5, 0), (7, 0, 1, 0), (8, 0, 2, 1), (8, 2, 2, 1)}
    out = drop_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "b c d"), (2, "b c d"), (3, None), (4, ""), (None, "a b c d e f"), (5, long)], key=str)


def test_several_texts_and_empty(spark):
    rows = [(1, "q w e r t y", "", "", 0), (2, "q w e r t y\nkeep", "", "", 0), (2, "z w e r t y\nkeep", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [(r.doc_id, r.line) for r in repeated_lines(docs).collect()] == [(2, 0)]
    assert sorted(r.text for r in drop_lines(docs).collect()) == ["keep", "q w e r t y", "z w e r t y\nkeep"]
    assert repeated_lines(docs.limit(0)).count() == 0 and drop_lines(docs.limit(0)).count() == 0


def test_pipeline_drops_short_lines(spark):
    import corpus_pipeline

    rows = [
        (1, "All rights reserved.\nStop\none two three four five\nown of one\n---"), (2, "All rights reserved.  \nown of two\n\n---"),
        (3, "one two three four six\nStop\nGo\nown of three"), (4, "Stop"), (5, "one two four five\none two three\nAll rights\nall wrongs"),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    want = {1: rows[0][1], 2: "own of two\n\n---", 3: "Go\nown of three", 5: rows[4][1]}
    assert got == {i: (text, len(text)) for i, text in want.items()}


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("u-2", "a b c d e f"), ("u-1", "a b c d e g\nown")], "doc_id string, text string")
    assert [tuple(r) for r in repeated_lines(docs).collect()] == [("u-2", 0, "u-1", 0)]
    assert [r.doc_id for r in drop_lines(docs).collect()] == ["u-1"]
