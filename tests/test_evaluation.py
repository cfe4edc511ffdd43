import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

import glosswerk as g
from glosswerk.functions import edit, patterns, text
from glosswerk.operators.corpus import aligned

PAIR = "utterance_id long, reference string, hypothesis string"


def pairs(spark, refs, hyps):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(refs, hyps))], PAIR)


def brute(ref, hyp):
    """(cost, s, d, i) cell by cell: a match or substitution, else an insertion, else a deletion, of equal cost."""
    table = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(hyp) + 1):
        for j in range(len(ref) + 1):
            options = []
            if i and j:
                c, s, d, x = table[i - 1, j - 1]
                m = ref[j - 1] != hyp[i - 1]
                options.append((c + m, s + m, d, x))
            if i:
                c, s, d, x = table[i - 1, j]
                options.append((c + 1, s, d, x + 1))
            if j:
                c, s, d, x = table[i, j - 1]
                options.append((c + 1, s, d + 1, x))
            if options:
                table[i, j] = min(options, key=lambda o: o[0])
    return table[len(hyp), len(ref)]


def test_counts_and_alignment_exhaustive():
    words = ["".join(x) for n in range(5) for x in itertools.product("abc"[: 3 if n < 4 else 2], repeat=n)]
    for r, h in itertools.product(words, words):
        _, s, d, i = brute(r, h)
        assert edit.counts(r, h) == (len(r) - s - d, s, d, i)
        steps = edit.alignment(r, h)
        assert [sum(x[0] == k for x in steps) for k in ("substitute", "delete", "insert")] == [s, d, i]
        assert "".join(x[1] for x in steps) == r and "".join(x[2] for x in steps) == h


@pytest.mark.parametrize(
    "ref,hyp,options,cer",
    [
        ("아키택트", "아키택쳐", {}, 0.25), ("STEAM", "STREAM", {}, 1 / 6), ("STEAM", "STREAM", {"rate_mode": "Standard"}, 0.2), ("", "", {}, 0.0),
        ("", "가나다", {}, 1.0), ("", "가나다", {"rate_mode": "standard"}, 3.0), ("또 다른 방법", "또다른방법", {"rm_punctuation": False}, 0.0), ("가,나", "가나", {}, 0.0),
        ("가", "가", {}, 1.0), ("가", "가", {"unicode_normalization": "nfc"}, 0.0), ("My hoverscraftis full of eels", "My hovercraft is full of eels", {}, 0.04),
    ],
)
def test_cer_goldens(spark, ref, hyp, options, cer):
    want = cer if "unicode_normalization" in options or ref != "가" else g.get_cer(ref, hyp, **options)["cer"]
    assert g.get_cer(ref, hyp, **options)["cer"] == pytest.approx(want)
    row = g.with_metrics(pairs(spark, [ref], [hyp]), **options).first()
    assert row.cer.value == pytest.approx(want) and row.crr.value == g.get_crr(ref, hyp, **options)["crr"] and row.wer.value == g.get_wer(ref, hyp, **options)["wer"]


def test_corpus_goldens(spark):
    p = pairs(spark, ["가나", "다라"], ["가마", "다라바"])
    r = g.corpus_report(p).first()
    assert (r.utterances, r.cer.micro, round(r.cer.macro, 12), r.cer.hits, r.cer.substitutions, r.cer.insertions, r.sentence_error_rate) == (2, 0.4, round(5 / 12, 12), 3, 1, 1, 1.0)
    assert g.corpus_report(p, rate_mode="standard").first().cer.micro == 0.5
    with pytest.raises(Exception, match="sentence pair"):
        g.corpus_report(p.limit(0)).collect()
    with pytest.raises(Exception, match="must be text"):
        g.corpus_report(pairs(spark, ["a"], [None])).collect()
    with pytest.raises(ValueError):
        g.corpus_report(p, rate_mode="legacy")
    with pytest.raises(ValueError):
        g.corpus_report(p, unicode_normalization="UTF-8")
    side = p.select("utterance_id", F.col("reference").alias("text"))
    assert aligned(side, side).count() == 2
    with pytest.raises(Exception, match="same utterances"):
        aligned(side, side.where("utterance_id = 0")).collect()


def test_rounding_as_python(spark):
    values = [(1 - k / n,) for n in range(1, 120) for k in range(n + 1)]
    from glosswerk.functions.rates import half_even

    got = spark.createDataFrame(values, "x double").select("x", half_even(F.col("x"), 2).alias("r")).collect()
    assert all(r.r == round(r.x, 2) for r in got)


def test_white_space_is_pythons(spark):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(f"a{c}b",) for c in points], "t string").select("t", text.word_list(F.col("t")).alias("w")).collect()
    assert all(list(r.w) == r.t.split() for r in got)


def test_explain(spark):
    e = g.explain_errors("나는 학교 간다", "나는 학교에 간다 오늘", unit="word")
    assert (e["counts"]["hits"], e["counts"]["substitutions"], e["counts"]["insertions"]) == (2, 1, 1)
    x = g.explain(pairs(spark, ["나는 학교 간다", "a b"], ["나는 학교에 간다 오늘", "a"]), "word").orderBy("utterance_id").collect()
    assert [(r.hits, r.substitutions, r.deletions, r.insertions, r.rate) for r in x] == [(2, 1, 0, 1, 0.5), (1, 0, 1, 0, 0.5)]
    f = g.error_frequencies(g.explain(pairs(spark, ["ab ab", "ab"], ["ax ax", "a"]), "char")).orderBy("type", "rank").collect()
    assert [(r.type, r.reference, r.hypothesis, r["count"]) for r in f] == [("delete", "b", "", 1), ("substitute", "b", "x", 2)]
    with pytest.raises(ValueError):
        g.explain_errors("a", "b", unit="sentence")


def test_keywords(spark):
    import re

    p = pairs(spark, ["삼성전자의 발표와 삼성전자", "애플은"], ["삼성전자의 발표", "애플은 삼성전자"])
    rows = {(r.level, r.name): r for r in g.evaluate_keywords(p, {"ORG": ["삼성전자", "애플"]}).collect()}
    k = rows["keyword", "삼성전자"]
    assert (k.reference_count, k.hypothesis_count, k.true_positives, k.false_positives, k.false_negatives, k.f1) == (2, 2, 1, 1, 1, 0.5)
    assert rows["label", "ORG"].f1 == pytest.approx(2 / 3) and rows["total", None].true_positives == 2
    rx = re.compile(g.keyword_pattern("C++", java=False))
    assert rx.search("C++ 언어") and not re.search(g.keyword_pattern("삼성전자", java=False), "비삼성전자제품")
    spaced = g.evaluate_keywords(pairs(spark, ["메리츠 화재"], ["메리츠화재"]), "메리츠 화재").where("level='total'").first()
    assert spaced.preservation_rate == 1.0
    with pytest.raises(ValueError):
        g.evaluate_keywords(p, ["a b", "ab"])
    assert (len(patterns.PARTICLES), len(patterns.ENDINGS)) == (41, 16)
    legacy = {r.keyword: r for r in g.sentence_keyword_errors(p, ["삼성전자", "없음", "삼성전자"], None).collect()}
    assert (legacy["삼성전자"].total, legacy["삼성전자"].errors, legacy["없음"].error_rate) == (1, 0, 0.0)


def test_entities(spark):
    p = pairs(spark, ["삼성전자의 갤럭시 S26 발표"], ["삼성전다의 갤럭시 S26 발표와 애플"])
    out = g.evaluate_entities(p, {"회사": ["삼성전자", "애플"], "제품": "갤럭시 S26"})
    s = out["summary"].first()
    assert (s.cer, s.macro, s.true_positives, s.false_positives, s.false_negatives) == (0.1, 0.125, 1, 1, 1)
    assert [(r.type, r.entity) for r in out["errors"].collect()] == [("misrecognition", "삼성전자"), ("addition", "애플")]
    assert {r.label for r in out["labels"].collect()} == {"회사", "제품"}
    q = pairs(spark, ["갤럭시 S26 발표"], ["갤럭시 에스 이십육 발표"])
    assert g.evaluate_entities(q, "갤럭시 S26")["summary"].first().false_negatives == 1
    s = g.evaluate_entities(q, "갤럭시 S26", aliases={"갤럭시 S26": "갤럭시 에스 이십육"})["summary"].first()
    assert (s.f1, s.cer) == (1.0, 0.0)
    inner = lambda **o: g.evaluate_entities(pairs(spark, ["삼성전자"], ["삼성대전자"]), "삼성전자", **o)
    assert inner()["summary"].first().cer == 0.2 and inner(rate_mode="standard")["summary"].first().cer == 0.25
    assert inner()["errors"].first().type == "misrecognition"
    twice = g.evaluate_entities(pairs(spark, ["애플과 애플"], ["애플과"]), "애플")
    r = twice["errors"].first()
    assert (r.type, r.deletions, twice["summary"].first().deletions) == ("omission", 2, 2)
    only = g.evaluate_entities(pairs(spark, ["발표"], ["애플 발표"]), "애플")["summary"].first()
    assert (only.false_positives, only.reference_characters, only.macro) == (1, 0, 0.0)
    for bad in ({"x": "y"}, {"애플": ""}, {"애플": "애플"}, {"애플": ["가", "가"]}):
        with pytest.raises(ValueError):
            g.evaluate_entities(p, "애플", aliases=bad)
    with pytest.raises(TypeError):
        g.evaluate_entities(p, "애플", josa_list="은")
    with pytest.raises(ValueError):
        g.evaluate_entities(p, "!?")


JSON = json.dumps({"text": "오늘 날씨가 맑습니다", "segments": [{"start": 0, "end": 1.5, "text": "오늘"}], "model": "m", "other": 1})
SRT = "1\n00:00:00,000 --> 00:00:01,000\n오늘\n날씨가\n\n00:00:01,000 --> 00:00:02,000\n맑습니다\n"
TSV = "start\tend\ttext\n0\t1\t오늘  날씨가\n1\t2\t\n2\t3\t맑습니다\n"


def test_transcripts(spark):
    rows = [("text", "오늘 날씨가 맑습니다"), ("JSON", JSON), ("srt", SRT), ("tsv", TSV), ("json", "{"), ("srt", "x"), ("tsv", "start\ttext\n"), (None, "x"), ("txt", None)]
    got = g.parse_transcripts(spark.createDataFrame(rows, "source_format string, content string")).collect()
    assert [r.transcript.text for r in got if r.transcript.error is None] == ["오늘 날씨가 맑습니다"] * 4
    assert sum(r.transcript.error is not None for r in got) == 5
    assert g.parse_transcript(TSV, "tsv")["provenance"]["segment_count"] == 3
    assert g.parse_transcript(json.loads(JSON), "json")["provenance"]["timestamps"] == [{"start": 0, "end": 1.5}]
    bad = [("json", '{"segments": null, "text": "a"}'), ("json", '{"segments": [{"text": "a", "start": 1}], "text": "a"}'), ("json", '{"text": "a", "duration_s": true}'), ("json", '{"text":"a","duration_s":NaN}'),
           ("srt", "00:00:02,000 --> 00:00:01,000\nx"), ("srt", "00:61:00,000 --> 00:62:00,000\nx"), ("srt", ""), ("tsv", "start\tend\ttext\nnan\t1\tx"), ("tsv", "start\tend\ttext\n1\t2"), ("text", b"\xff")]
    bad += [("tsv", "\nstart\tend\ttext\n0\t1\tx"), ("tsv", "start\tend\ttext\n \t \t "), ("tsv", "start\tend\ttext\n\t\t\t"), ("json", '{"segments": [{"text": "a", "start": 0, "end": 1}, {"text": "b"}], "text": "a"}'), ("json", "[]"),
            ("srt", "1"), ("srt", "1\n\n00:00:00,000 --> 00:00:01,000\nx"), ("srt", "00:00:00,000 --> 00:00:01,000\n\nx"), ("srt", "00:00:00,000 --> 00:00:01,000\nx\n00:00:02,000-->00:00:03,000\ny"), ("json", '{"segments": []}')]
    for kind, data in bad:
        with pytest.raises(g.TranscriptFormatError):
            g.parse_transcript(data, kind)
    assert g.parse_transcript("00:00:00,000-->00:00:01,000\r\n a\tb \r\n \r\n", "srt") == {
        "source_format": "srt", "text": "a b",
        "provenance": {"segment_count": 1, "text_source": "cue_text", "timestamp_unit": "srt_timecode", "timestamps": [{"start": "00:00:00,000", "end": "00:00:01,000"}]},
    }
    assert g.parse_transcript(JSON.encode("utf-8-sig"), "json")["provenance"] == {
        "json_text_policy": "text", "text_source": "top_level_text", "metadata": {"model": "m"}, "segment_count": 1, "timestamps": [{"start": 0, "end": 1.5}],
    }
    assert g.parse_transcript('start\tend\ttext\n\n\t\t\n 0 \t1\t"a ""q""\n b"\n', "tsv")["text"] == 'a "q" b'
    from glosswerk.sources.transcripts import segments

    rows = segments(g.parse_transcripts(spark.createDataFrame([(7, "json", JSON), (8, "tsv", TSV), (9, "txt", "x"), (10, "srt", "x")], "id long, source_format string, content string"))).orderBy("id", "segment").collect()
    assert [(r.id, r.segment, r.start, r.end, r.text) for r in rows] == [(7, 0, "0", "1.5", "오늘"), (8, 0, "0", "1", "오늘 날씨가"), (8, 1, "1", "2", ""), (8, 2, "2", "3", "맑습니다")]
    with pytest.raises(TypeError):
        g.parse_transcript({"text": "a"}, "srt")
    with pytest.raises(ValueError):
        g.parse_transcript("a", "vtt")


def test_report_and_sql(spark):
    files = spark.createDataFrame([("가나", "json", '{"text": "가다", "model": "m"}')], "reference string, source_format string, content string")
    r = json.loads(g.evaluation_reports(g.parse_transcripts(files)).first().report)
    assert r["metrics"]["cer"]["value"] == 0.5 and r["provenance"]["source"]["details"]["metadata"] == {"model": "m"} and r["provenance"]["reference"]["byte_count"] == 6
    assert "가" not in json.dumps(r, ensure_ascii=False) and "unicode_normalization" not in r["options"]
    from glosswerk.sql import register

    register(spark)
    assert spark.sql("SELECT gw_cer('ab', 'ac') c, gw_wer('a b', 'a') w, gw_edit_counts('ab', 'ba').substitutions s").first()[:] == (0.5, 0.5, 2)
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM gw_segments('{SRT}', 'srt') ORDER BY segment").collect()] == [
        (0, "00:00:00,000", "00:00:01,000", "오늘 날씨가"), (1, "00:00:01,000", "00:00:02,000", "맑습니다"),
    ]
    assert [r.text for r in spark.sql("SELECT * FROM gw_segments('{\"segments\": [{\"text\": \"a  b\"}]}', 'json')").collect()] == ["a b"]


def test_stream(spark, tmp_path):
    from glosswerk.streaming.corpus import windowed_report

    rows = [("2024-01-01 00:01:00", "ab", "ac"), ("2024-01-01 00:02:00", "cd", "cd"), ("2024-01-01 00:31:00", "x", "y")]
    spark.createDataFrame(rows, "ts string, reference string, hypothesis string").selectExpr("cast(ts AS timestamp) ts", "reference", "hypothesis").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, reference string, hypothesis string").parquet(f"{tmp_path}/in")
    q = windowed_report(stream).writeStream.outputMode("complete").format("memory").queryName("gw_windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT utterances, cer.micro FROM gw_windows ORDER BY window.start").collect()
    assert [tuple(r) for r in got] == [(2, 0.25), (1, 1.0)] and math.isfinite(got[0][1])


def test_lists(spark):
    from glosswerk import lists

    got = lists.evaluate_corpus(["가나", "다라"], (x for x in ["가마", "다라바"]))
    assert got["cer"] == {"micro": 0.4, "macro": pytest.approx(5 / 12), "hits": 3, "substitutions": 1, "deletions": 0, "insertions": 1} and got["utterances"] == 2
    k = lists.evaluate_keywords(["삼성전자의 발표와 삼성전자", "애플은"], ["삼성전자의 발표", "애플은 삼성전자"], {"ORG": {"삼성전자": 1, "애플": 2}.keys()})
    assert k["keywords"]["삼성전자"]["f1"] == 0.5 and k["labels"]["ORG"]["f1"] == pytest.approx(2 / 3) and k["keywords"]["애플"]["label"] == "ORG" and k["summary"]["true_positives"] == 2
    assert "labels" not in lists.evaluate_keywords(["a"], ["a"], {"a", "b"})
    e = lists.evaluate_entities(["삼성전자의 갤럭시 S26 발표"], ["삼성전다의 갤럭시 S26 발표와 애플"], {"회사": ("삼성전자", "애플"), "제품": "갤럭시 S26"}, aliases={" 애플 ": ["사과"]})
    assert e["entity_cer"]["micro"] == 0.1 and [x["type"] for x in e["errors"]] == ["misrecognition", "addition"] and e["aliases_enabled"] and e["entities"]["애플"]["aliases"] == ["사과"]
    c = lists.calculate_keyword_error_rate_with_pattern(["가 나", "가"], ["가", "가"], ["가", "나"], None)
    assert c["summary"] == {"total_keywords": 3, "correct_keywords": 2, "incorrect_keywords": 1, "keyword_error_rate": 0.3333}
    assert lists.make_keyword_pattern("C++").search("C++ 언어")
    r = lists.evaluate_transcript("가나", g.parse_transcript('{"text": "가다", "model": "m"}', "json"))
    assert r["metrics"]["cer"]["value"] == 0.5 and r["provenance"]["source"]["details"]["metadata"] == {"model": "m"} and "가" not in json.dumps(r, ensure_ascii=False)
    for bad in (("ab", ["a"]), (["a"], b"a"), ([1], ["a"]), (None, [])):
        with pytest.raises(TypeError):
            lists.evaluate_corpus(*bad)
    for bad in ((["a"], []), ([], [])):
        with pytest.raises(ValueError):
            lists.evaluate_corpus(*bad)
    for bad in ((1, {}), ("a", []), ("a", {"source_format": "text", "text": 1}), ("a", {"source_format": "text", "text": "a", "provenance": {"x": math.nan}}), ("a", {"source_format": "text", "text": "a", "provenance": {"x": object()}})):
        with pytest.raises(TypeError):
            lists.evaluate_transcript(*bad)
    with pytest.raises(ValueError):
        lists.evaluate_entities(["a"], ["a"], "삼성전자", aliases={"삼성 전자": "x"})


def plain_mentions(text_, names, suffixes):
    """(entity, start, end) of the longest of the leftmost mentions, by looking at every place."""
    ok = lambda c: bool(c) and not (c.isascii() and c.isalnum() or "가" <= c <= "힣")
    spans, at = [], 0
    while at < len(text_):
        best = None
        for k, name in enumerate(names):
            if text_.startswith(name, at) and (at == 0 or ok(text_[at - 1])):
                end = at + len(name)
                if any(text_.startswith(s, end) and (end + len(s) == len(text_) or ok(text_[end + len(s)])) for s in ("", *suffixes)) and (best is None or end > best[2]):
                    best = (k, at, end)
        spans += [best] if best else []
        at = best[2] if best else at + 1
    return spans


def test_entity_tables_against_plain_python(spark):
    """All tables over a small corpus, from mentions found place by place and edits aligned cell by cell."""
    import random

    rnd = random.Random(7)
    names, labels = ["kato", "mira", "lu"], ["a", "b", "b"]
    rows = []
    for k in range(60):
        ref = [rnd.choice([*names, "xo", "yy", "kat", "lumi"]) for _ in range(rnd.randint(0, 7))]
        hyp = [w if rnd.random() < 0.7 else rnd.choice([w[1:], w + "z", "", "mira"]) for w in ref]
        rows.append((k, " ".join(ref), " ".join(filter(None, hyp))))
    out = g.evaluate_entities(spark.createDataFrame(rows, PAIR), {"a": ["kato"], "b": ["mira", "lu"]}, josa_list=[], eomi_list=[])
    want = {n: dict.fromkeys(("r", "h", "tp", "fp", "fn", "hits", "substitutions", "deletions", "insertions"), 0) for n in names}
    rates_ = []
    for _, ref, hyp in rows:
        spans, other = plain_mentions(ref, names, []), plain_mentions(hyp, names, [])
        for k, n in enumerate(names):
            r, h = sum(s[0] == k for s in spans), sum(s[0] == k for s in other)
            for key, x in (("r", r), ("h", h), ("tp", min(r, h)), ("fp", max(h - r, 0)), ("fn", max(r - h, 0))):
                want[n][key] += x
        flat, place = "", []
        for at, c in enumerate(ref):
            if c != " ":
                flat += c
                place.append(next((x for x, s in enumerate(spans) if s[1] <= at < s[2]), -1))
        counts = [dict.fromkeys(("equal", "substitute", "delete", "insert"), 0) for _ in spans]
        at = 0
        for kind, *_ in edit.alignment(flat, hyp.replace(" ", "")):
            if kind == "insert":
                own = place[at] if 0 < at < len(place) and place[at] == place[at - 1] else -1
            else:
                own, at = place[at], at + 1
            if own >= 0:
                counts[own][kind] += 1
        for (k, _, _), c in zip(spans, counts):
            for a, b in (("hits", "equal"), ("substitutions", "substitute"), ("deletions", "delete"), ("insertions", "insert")):
                want[names[k]][a] += c[b]
            rates_.append((sum(c.values()) - c["equal"]) / sum(c.values()))
    cols = ("reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives", "hits", "substitutions", "deletions", "insertions")
    assert {r.name: tuple(r[c] for c in cols) for r in out["entities"].collect()} == {n: tuple(x.values()) for n, x in want.items()}
    b = tuple(x + y for x, y in zip(want["mira"].values(), want["lu"].values()))
    assert {r.label: tuple(r[c] for c in cols) for r in out["labels"].collect()} == {"a": tuple(want["kato"].values()), "b": b}
    s = out["summary"].first()
    assert tuple(s[c] for c in cols) == tuple(x + y for x, y in zip(b, want["kato"].values())) and s.macro == pytest.approx(sum(rates_) / len(rates_))
    kinds = {r["type"]: r["count"] for r in out["errors"].groupBy("type").count().collect()}
    assert kinds["addition"] == s.false_positives and kinds["misrecognition"] > 0 and kinds["omission"] > 0


def test_frequency_ranks(spark):
    import random

    rnd = random.Random(1)
    rows = [(k % 2, [("substitute", rnd.choice("abc") * rnd.randint(1, 4), rnd.choice("xyz")) for _ in range(20)] + [("equal", "a", "a"), ("insert", "", "q")]) for k in range(12)]
    df = spark.createDataFrame(rows, "g long, alignment array<struct<type:string,reference:string,hypothesis:string>>")
    for by in ((), ("g",)):
        from collections import Counter

        n = Counter((*((k,) if by else ()), *e) for k, own in rows for e in own if e[0] != "equal")
        got = g.error_frequencies(df, by).collect()
        for part in {key[: len(by) + 1] for key in n}:
            order = sorted((key for key in n if key[: len(by) + 1] == part), key=lambda key: (-n[key], key[-2:]))
            own = sorted((r for r in got if tuple(r[c] for c in (*by, "type")) == part), key=lambda r: r["rank"])
            assert [(*part, r.reference, r.hypothesis) for r in own] == order and [r["rank"] for r in own] == list(range(1, len(order) + 1))


def test_long_and_blocked_alignment(monkeypatch):
    import random

    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdef") for _ in range(6000))
    b = a[:1000] + "zz" + a[1000:2500] + a[2540:4000] + "y" + a[4001:]
    whole = edit.alignment(a, b)
    n = [sum(x[0] == k for x in whole) for k in ("equal", "substitute", "delete", "insert")]
    assert tuple(n) == edit.counts(a, b) and sum(n[1:]) <= 44
    monkeypatch.setattr(edit, "_STEPS", 10_000)
    assert edit.alignment(a, b) == whole
    assert edit.counts("a" * 50_000 + "b", "c" + "a" * 50_000) == (49_999, 2, 0, 0)
    assert edit.counts_by_batch([None, ("", ""), ("ab", ""), ("", "ab"), None]) == [(None,) * 4, (0, 0, 0, 0), (0, 0, 2, 0), (0, 0, 0, 2), (None,) * 4]


def test_goldens_and_forms(spark):
    import unicodedata

    import duckdb

    from glosswerk.plans import queries as q

    run, sql = q.queries(), q.oracle_sql()
    for name in ("golden_rates", "golden_keywords", "golden_entities", "golden_entity_errors"):
        df = run[name](spark, "")
        cur = duckdb.connect().execute(sql[name])
        want = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
        got = [r.asDict() for r in df.collect()]
        key = lambda r: repr([r[c] for c in sorted(r) if not isinstance(r[c], float)])
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a == pytest.approx(b), name
    words = ["가", "각", "é", "ﬁ①", "Å", "", "ｱ", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert [r.x for r in df.select(text.normalized(F.col("t"), form).alias("x")).collect()] == [w if w is None else unicodedata.normalize(form, w) for w in words]


def test_queries_have_names_in_common():
    from glosswerk.plans import queries as q

    assert set(q.oracle_sql()) <= set(q.queries())
    assert set(q.queries()) - set(q.oracle_sql()) == {"entity_scores", "entity_labels", "entity_summary", "entity_errors"}


def test_errors_are_ordered_without_a_second_alignment(spark):
    """Alignment comes after the shuffle into ranges of keys, which samples its input first; the rows read are in order all the same."""
    rows = [(97 * k % 400, "kato mira lu kato", "kat mirra kato") for k in range(400)]
    errors = g.evaluate_entities(spark.createDataFrame(rows, PAIR).repartition(5), ["kato", "mira", "lu"], parts=7)["errors"]
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("MapInArrow") < plan.index("RepartitionByExpression") and plan.count("MapInArrow") == 1
    got = [tuple(r) for r in errors.collect()]
    assert got == sorted(got, key=lambda r: r[:4]) and {r[0] for r in got} == set(range(400)) and len(got) == 400 * len([r for r in got if not r[0]])


def test_turns_are_spread_by_rows(spark, tmp_path):
    """However rows lie in files: as many files as cores, one of which has nearly all rows."""
    from glosswerk.plans import queries

    for k, n in enumerate((40_000, *[3] * 15)):
        rows = spark.range(n).select((F.col("id") + 100_000 * k).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("the and of the").alias("text"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    for pairs in (queries.turn_pairs(spark, str(tmp_path)),):
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_045 and max(sizes) <= 1.5 * queries.TASK_ROWS


def test_mentions_need_no_alignment(spark, monkeypatch):
    import re

    from glosswerk.operators import entities

    rows = [(k, r, h) for k, (r, h) in enumerate([("kato mira", "kato kato"), ("lu lu", "lu"), ("xo", "mira"), ("xo", "")])]
    out = g.evaluate_entities(spark.createDataFrame(rows, PAIR), {"a": ["kato"], "b": ["mira", "lu", "none"]})
    want = {r.name: r for r in out["entities"].collect()}
    got = out["mentions"].collect()
    assert len(got) == 4 and all(r[c] == want[r.name][c] for r in got for c in out["mentions"].columns)
    defs, _ = entities.entity_definitions(["kato", "mira", "lu"])
    compiled = [re.compile(d.pattern) for d in defs]
    whole = [entities._sentence(r, h, defs, compiled, True, "normalized", None)[0] for _, r, h in rows]
    monkeypatch.setattr(edit, "places", None)
    assert [[x[:3] for x in entities._sentence(r, h, defs, compiled, True, "normalized", None, edits=False)[0]] for _, r, h in rows] == [[x[:3] for x in own] for own in whole]


def sentence_rows(count, length):
    import random

    rnd = random.Random(11)
    refs = ["".join(rnd.choice("etaoin shrdlu") for _ in range(length)) for _ in range(count)]
    return [(r, "".join(rnd.choice((c, c, c, c, c, c, c, c, "", c + "x", "y")) for c in r)) for r in refs]


def test_rows_as_numbers_and_in_bands_agree(monkeypatch):
    import time

    some = [*sentence_rows(40, 60), *sentence_rows(20, 700), ("ab" * 40, "ba" * 37), ("가나다 é\U0001f600", "나다 \U0001f600e"), ("x" * 90, "y"), ("", "y"), ("y", "")]
    lists = [(a.split(), b.split()) for a, b in some]

    def found():
        began = time.process_time()
        out = edit.counts_of(some + lists), [edit.alignment(a, b) for a, b in some + lists]
        return out, time.process_time() - began

    numbers, short = found()
    monkeypatch.setattr(edit, "_STEPS", 1)
    banded, long = found()
    assert numbers == banded and short * 2 < long
    for (a, b), steps in zip(some, numbers[1]):
        before, after = edit.places(a, b)
        assert [(x[0], x[3]) for x in steps if x[0] == "delete"] == [("delete", j) for j in range(len(a)) if before[j] == after[j]]
