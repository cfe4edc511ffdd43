"""Queries over the test tables, and their SQL.

Sentence pairs are made from whole texts of ``conversations`` and ``benchmark``: the hypothesis is
the text with a few systematic errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..operators import corpus, entities, explain, keywords
from ..sources.transcripts import parse_transcripts, segments
from ..sql import register
from .report import evaluation_reports

KEYWORDS = {"function": ["the", "with", "que"], "content": ["worthless", "tion", "der"]}
LEGACY = ["the", "that", "les", "und", "unseen"]
ENTITIES = {"en": ["of the", "and"], "de": ["die"]}
ALIASES = {"and": ["und"]}


def _with_errors(ref):
    hyp = F.regexp_replace(F.regexp_replace(ref, "th", "t"), "e ", "a ")
    return F.replace(F.replace(hyp, F.lit(" de "), F.lit(" ")), F.lit(" of "), F.lit(" of of "))


#: Rows of a task, at most on average: an alignment takes far more time than its texts have bytes, and bytes that repeat hardly count in a file.
TASK_ROWS = 4096


def _parts(table: DataFrame) -> int:
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def _turn_pairs(t: DataFrame) -> DataFrame:
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance_id"), F.col("text").alias("reference"), _with_errors(F.col("text")).alias("hypothesis"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """In parts of near as many rows: files may be few, and hold groups of rows that no scan splits."""
    t = turns(spark, d)
    return _turn_pairs(t.repartition(_parts(t)))


def item_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/benchmark.parquet")
    return t.select(F.col("item_id").alias("utterance_id"), F.col("text").alias("reference"), _with_errors(F.col("text")).alias("hypothesis"))


def _flat(df: DataFrame, *structs: str) -> DataFrame:
    plain = [c for c in df.columns if c not in structs]
    return df.select(*plain, *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in structs for f in df.schema[s].dataType.names])


def _per_row(pairs: DataFrame, mode: str) -> DataFrame:
    m = corpus.with_metrics(pairs, rate_mode=mode)
    return _flat(m.select("utterance_id", "cer", "wer", F.col("crr.value").alias("crr")), "cer", "wer")


def _wer(pairs: DataFrame, mode: str) -> DataFrame:
    m = corpus.measured(pairs, cer=False)
    return m.select("utterance_id", "wer_counts.*", corpus._rate("wer_counts", mode).alias("wer"))


def _corpus_wer(pairs: DataFrame, mode: str) -> DataFrame:
    m = corpus.measured(pairs, cer=False)
    return _flat(m.agg(F.count("*").alias("utterances"), *corpus.summary(m, "wer_counts", mode)).withColumn("wer", F.col("wer").withField("macro", F.round("wer.macro", 9))), "wer")


def _corpus(pairs: DataFrame, mode: str) -> DataFrame:
    r = corpus.corpus_report(pairs, rate_mode=mode)
    for c in ("cer", "wer"):
        r = r.withColumn(c, F.col(c).withField("macro", F.round(f"{c}.macro", 9)))
    return _flat(r, "cer", "wer")


def _alignment(pairs: DataFrame, unit: str) -> DataFrame:
    e = explain.explain(pairs, unit)
    return e.select("utterance_id", F.posexplode("alignment").alias("step", "e")).select("utterance_id", "step", "e.type", "e.reference", "e.hypothesis")


def _aligned(pairs: DataFrame) -> DataFrame:
    side = lambda c: pairs.select("utterance_id", F.col(c).alias("text"))
    return corpus.aligned(side("reference"), side("hypothesis"))


def _indices(pairs: DataFrame) -> DataFrame:
    """Edits with the place of the reference's word, or, of an extra word, where it would stand."""
    e = explain.explain(pairs, "word").select("utterance_id", F.posexplode("alignment").alias("step", "e"))
    return e.select("utterance_id", "step", "e.type", "e.reference_index", "e.reference_position")


def _explained(pairs: DataFrame) -> DataFrame:
    e = explain.explain(pairs, "character", rate_mode="standard")
    return e.select("utterance_id", "processed_reference", "processed_hypothesis", "hits", "substitutions", "deletions", "insertions", "rate")


def _sql_rates(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """The same rates by this package's SQL functions."""
    register(spark)
    call = lambda f: F.call_function(f, F.col("reference"), F.col("hypothesis"))
    return pairs.select("utterance_id", *[call(f"gw_{m}").alias(m) for m in ("cer", "wer", "crr")], call("gw_edit_counts").alias("n")).select("utterance_id", "cer", "wer", "crr", "n.*")


def _keywords(pairs: DataFrame, level: str) -> DataFrame:
    k = keywords.evaluate_keywords(pairs, KEYWORDS)
    return k.where(F.col("level") == level).drop("level") if level != "total" else k.where("level = 'total'").drop("level", "name", "position")


def _parsed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each conversation as a transcript of its turns, parsed again: a turn lasts a second, quotes and newlines are kept where a format can hold them."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    one = lambda x: F.regexp_replace(x["text"], "[ \\t\\n\\r]+", " ")
    if kind == "json":
        segments = F.transform("x", lambda x: F.struct(x["turn"].alias("start"), (x["turn"] + 1).alias("end"), x["text"].alias("text")))
        body = F.to_json(F.struct(segments.alias("segments"), F.concat(F.lit("m"), "conv_id").alias("model")))
    elif kind == "srt":
        stamp = lambda n: F.concat(F.lit("00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":00,000"))
        cue = lambda x: F.concat(x["turn"].cast("string"), F.lit("\n"), stamp(x["turn"]), F.lit("-->"), stamp(x["turn"] + 1), F.lit("\n"), one(x))
        body = F.array_join(F.transform("x", cue), "\n\n")
    elif kind == "tsv":
        cell = lambda x: F.concat(F.lit('"'), F.replace(x["text"], F.lit('"'), F.lit('""')), F.lit('"'))
        rows = F.array_join(F.transform("x", lambda x: F.concat_ws("\t", x["turn"].cast("string"), (x["turn"] + 1).cast("string"), cell(x))), "\n")
        body = F.concat(F.lit("start\tend\ttext\n"), rows)
    else:
        body = F.concat(F.lit("\ufeff"), F.array_join(F.transform("x", lambda x: x["text"]), "\n"))
    files = turns.select("conv_id", body.alias("content"), F.lit(kind).alias("source_format"))
    return parse_transcripts(files.withColumn("content", F.encode("content", "utf-8")) if kind == "json" else files, json_text_policy="segments_fallback")


def _transcripts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    p = _parsed(spark, d, kind)
    about = lambda path: F.get_json_object("transcript.provenance", path)
    return p.select(
        "conv_id", F.col("transcript.text").alias("text"), about("$.segment_count").cast("long").alias("segments"), about("$.text_source").alias("text_source"),
        about("$.timestamp_unit").alias("unit"), about("$.metadata.model").alias("model"), F.col("transcript.error").alias("error"),
    )


def _segments(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return segments(_parsed(spark, d, kind)).select("conv_id", "segment", "start", "end", "text")


def _refused(spark: SparkSession, d: str) -> DataFrame:
    """Turns as transcripts in formats that they don't keep to."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z]+", " ").alias("text"))
    forms = {
        "srt": F.concat(F.lit("1\n00:00:02,000 --> 00:00:0"), (F.col("turn") % 4).cast("string"), F.lit(",000\nx "), "text"),
        "tsv": F.concat(F.lit("start\tend\ttext\n2\t"), (F.col("turn") % 4).cast("string"), F.lit("\tx "), "text"),
        "json": F.concat(F.lit('{"text": "x '), "text", F.lit('", "segments": [{"text": "x", "start": 2, "end": '), (F.col("turn") % 4).cast("string"), F.lit("}]}")),
    }
    rows = t.select("conv_id", "turn", F.explode(F.array(*[F.struct(F.lit(k).alias("source_format"), c.alias("content")) for k, c in forms.items()])).alias("f")).select("conv_id", "turn", "f.*")
    return parse_transcripts(rows).select("conv_id", "turn", "source_format", F.col("transcript.error").isNotNull().alias("refused"))


def _report(pairs: DataFrame) -> DataFrame:
    r = evaluation_reports(pairs).select("utterance_id", "report")
    field = lambda path: F.get_json_object("report", "$." + path)
    values = [field(f"metrics.{m}.{f}").cast("double" if f == "value" else "long").alias(f"{m}_{f}") for m in ("cer", "wer", "crr") for f in ("value", "substitutions", "deletions", "insertions")]
    marks = [field(f"provenance.{t}.{f}").cast("string" if f == "sha256" else "long").alias(f"{t}_{f}") for t in ("reference", "hypothesis") for f in ("sha256", "character_count", "byte_count")]
    return r.select(
        "utterance_id", field("schema_version").alias("schema_version"), field("options.rate_mode").alias("rate_mode"), field("options.rm_punctuation").cast("boolean").alias("rm_punctuation"),
        field("provenance.source.format").alias("format"), *values, *marks,
    )


#: Korean pairs and what the rates of each are: (reference, hypothesis, cer, cer in standard mode, wer).
GOLDEN = [
    ("아키택트", "아키택쳐", 0.25, 0.25, 1.0), ("STEAM", "STREAM", 1 / 6, 0.2, 1.0), ("", "가나다", 1.0, 3.0, 1.0), ("", "", 0.0, 0.0, 0.0), ("가,나", "가나", 0.0, 0.0, 0.0),
    ("또 다른 방법", "또다른방법", 0.0, 0.0, 1.0), ("대한민국은 주권 국가 입니다.", "대한민국은 주권국가 입니다.", 0.0, 0.0, 0.5), ("가나", "가마", 0.5, 0.5, 1.0), ("다라", "다라바", 1 / 3, 0.5, 1.0),
]
#: Korean sentences, their keywords and entities.
SENTENCES = [("삼성전자의 발표와 삼성전자", "삼성전자의 발표"), ("애플은", "애플은 삼성전자"), ("메리츠 화재가", "메리츠화재"), ("비삼성전자제품", "비삼성전자제품"), ("C++ 언어", "C 언어")]
ENTITY_SENTENCES = [("삼성전자의 갤럭시 S26 발표", "삼성전다의 갤럭시 S26 발표와 애플"), ("애플과 애플", "애플과"), ("삼성전자", "삼성대전자"), ("갤럭시 S26 발표", "갤럭시 에스 이십육 발표")]


def _golden_pairs(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "utterance_id long, reference string, hypothesis string")


def _golden_rates(spark: SparkSession) -> DataFrame:
    p = _golden_pairs(spark, GOLDEN)
    both = corpus.with_metrics(corpus.with_metrics(p).select("*", F.col("cer.value").alias("cer_1"), F.col("wer.value").alias("wer_1")).drop("cer", "wer", "crr"), rate_mode="standard")
    return both.select("utterance_id", F.col("cer_1").alias("cer"), F.col("cer.value").alias("cer_standard"), F.col("wer_1").alias("wer"))


def _golden_keywords(spark: SparkSession) -> DataFrame:
    k = keywords.evaluate_keywords(_golden_pairs(spark, SENTENCES), {"ORG": ["삼성전자", "애플", "메리츠 화재"], "LANG": "C++"})
    return k.select("level", "name", "reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives", "f1")


def _golden_entities(spark: SparkSession) -> DataFrame:
    e = entities.evaluate_entities(_golden_pairs(spark, ENTITY_SENTENCES), {"회사": ["삼성전자", "애플"], "제품": "갤럭시 S26"}, aliases={"갤럭시 S26": "갤럭시 에스 이십육"})
    return e["entities"].select("name", "label", "reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives", "cer", "hits", "substitutions", "deletions", "insertions")


def _golden_errors(spark: SparkSession) -> DataFrame:
    e = entities.evaluate_entities(_golden_pairs(spark, ENTITY_SENTENCES), {"회사": ["삼성전자", "애플"], "제품": "갤럭시 S26"}, aliases={"갤럭시 S26": "갤럭시 에스 이십육"})
    return e["errors"].select("sentence_index", "type", "entity", "label", "reference", "hypothesis", "substitutions", "deletions", "insertions")


def _entities(pairs: DataFrame, table: str) -> DataFrame:
    return entities.evaluate_entities(pairs, ENTITIES, aliases=ALIASES)[table]


def _entity_errors(t: DataFrame) -> DataFrame:
    n = _parts(t)
    return entities.evaluate_entities(_turn_pairs(t.repartition(n)), ENTITIES, aliases=ALIASES, parts=n)["errors"]


def _entity_mentions(pairs: DataFrame) -> DataFrame:
    e = entities.evaluate_entities(pairs, {k: v for k, v in ENTITIES.items()})["mentions"]
    return e.select("name", "label", "reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t, b = turn_pairs, item_pairs
    return {
        "corpus_report_normalized": lambda s, d: _corpus(b(s, d), "normalized"),
        "corpus_report_standard": lambda s, d: _corpus(b(s, d), "standard"),
        "metrics_per_row_normalized": lambda s, d: _per_row(b(s, d), "normalized"),
        "metrics_per_row_standard": lambda s, d: _per_row(b(s, d), "standard"),
        "wer_per_row_normalized": lambda s, d: _wer(b(s, d), "normalized"),
        "wer_per_row_standard": lambda s, d: _wer(b(s, d), "standard"),
        "corpus_wer_normalized": lambda s, d: _corpus_wer(b(s, d), "normalized"),
        "corpus_wer_standard": lambda s, d: _corpus_wer(b(s, d), "standard"),
        "corpus_report_turns": lambda s, d: _corpus(t(s, d), "normalized"),
        "perfect_sentences": lambda s, d: t(s, d).agg(F.count("*").alias("utterances"), F.sum((text.cer_text(F.col("reference")) == text.cer_text(F.col("hypothesis"))).cast("long")).alias("perfect_sentences")),
        "alignment_words": lambda s, d: _alignment(b(s, d), "word"),
        "alignment_characters": lambda s, d: _alignment(b(s, d), "character"),
        "alignment_indices": lambda s, d: _indices(b(s, d)),
        "aligned_turns": lambda s, d: _aligned(t(s, d)),
        "explained_items": lambda s, d: _explained(b(s, d)),
        "sql_rates": lambda s, d: _sql_rates(s, b(s, d)),
        "error_frequencies_words": lambda s, d: explain.error_frequencies(explain.explain(b(s, d), "word")),
        "keyword_mentions": lambda s, d: _keywords(t(s, d), "keyword"),
        "keyword_labels": lambda s, d: _keywords(t(s, d), "label"),
        "keyword_summary": lambda s, d: _keywords(t(s, d), "total"),
        "sentence_keyword_errors": lambda s, d: keywords.sentence_keyword_errors(t(s, d), LEGACY, None),
        "entity_mentions": lambda s, d: _entity_mentions(t(s, d)),
        "entity_scores": lambda s, d: _entities(t(s, d), "entities").drop("aliases"),
        "entity_labels": lambda s, d: _entities(t(s, d), "labels"),
        "entity_summary": lambda s, d: _entities(t(s, d), "summary"),
        "entity_errors": lambda s, d: _entity_errors(turns(s, d)),
        "entity_scores_items": lambda s, d: _entities(b(s, d), "entities").drop("aliases"),
        "entity_labels_items": lambda s, d: _entities(b(s, d), "labels"),
        "entity_summary_items": lambda s, d: _entities(b(s, d), "summary"),
        "entity_errors_items": lambda s, d: _entities(b(s, d), "errors").drop("start", "seq"),
        "transcript_text": lambda s, d: _transcripts(s, d, "text"),
        "transcript_json": lambda s, d: _transcripts(s, d, "json"),
        "transcript_srt": lambda s, d: _transcripts(s, d, "srt"),
        "transcript_tsv": lambda s, d: _transcripts(s, d, "tsv"),
        **{f"transcript_segments_{k}": lambda s, d, k=k: _segments(s, d, k) for k in ("json", "srt", "tsv")},
        "transcript_refused": _refused,
        "evaluation_report": lambda s, d: _report(b(s, d)),
        "golden_rates": lambda s, d: _golden_rates(s),
        "golden_keywords": lambda s, d: _golden_keywords(s),
        "golden_entities": lambda s, d: _golden_entities(s),
        "golden_entity_errors": lambda s, d: _golden_errors(s),
        "fingerprints": lambda s, d: t(s, d).select("utterance_id", text.fingerprint(F.col("reference")).alias("f")).select("utterance_id", "f.*"),
        "nfc_fingerprints": lambda s, d: t(s, d).select("utterance_id", F.sha2(text.normalized(F.col("reference"), "NFC"), 256).alias("sha256")),
        "code_points": lambda s, d: t(s, d).select("utterance_id", text.code_points(F.col("reference")).alias("codes")),
    }


def _hyp(c: str) -> str:
    return f"replace(replace(regexp_replace(regexp_replace({c}, 'th', 't', 'g'), 'e ', 'a ', 'g'), ' de ', ' '), ' of ', ' of of ')"


_TURNS = f"pairs AS (SELECT conv_id * 1000 + turn AS utterance_id, text AS reference, {_hyp('text')} AS hypothesis FROM conversations)"
_ITEMS = f"pairs AS (SELECT item_id AS utterance_id, text AS reference, {_hyp('text')} AS hypothesis FROM benchmark)"


def _clean(c: str) -> str:
    return rf"regexp_replace({c}, '\p{{P}}', '', 'g')"


def _bare(c: str) -> str:
    return _clean(rf"regexp_replace({c}, '[ \t\n\r\x0B\f]', '', 'g')")


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex({_clean(c)}, '[ \t\n\r\x0B\f]+'), lambda w: w <> '')"


def _chars(c: str) -> str:
    return f"list_filter(string_split({_bare(c)}, ''), lambda w: w <> '')"


_ONE, _KINDS, _INSERTED = 1 << 22, ~(3 << 20), (1 << 20) - 1


def _dp(name: str, tokens, keep: bool = False, share: int = 8) -> str:
    """CTEs that give ``name(utterance_id, hits, substitutions, deletions, insertions)``.

    A cell is a number: the cost, then the kind of step (0 a match or substitution, 1 an insertion, 2 a deletion), which decides among
    equal costs, then the insertions so far.  Cells are filled by anti-diagonals within a band; a cost that the band can't vouch for is an error.
    With ``keep`` all anti-diagonals stay in ``name_dp``, for the way back.
    """
    lo = lambda x: f"greatest(0, {x} - m, ({x} - band + 1) // 2)"
    hi = lambda x: f"least({x}, n, ({x} + band) // 2)"
    diagonal = f"(b[i - {lo('(x - 1)')}] & {_KINDS}) + CASE WHEN r[x + 1 - i] = h[i] THEN 0 ELSE {_ONE} END"
    down, across = f"(a[i - {lo('x')}] & {_KINDS}) + {_ONE + (1 << 20) + 1}", f"(a[i - {lo('x')} + 1] & {_KINDS}) + {_ONE + (2 << 20)}"
    return f"""{name}_tokens AS (
  SELECT *, len(r)::BIGINT AS m, len(h)::BIGINT AS n, 40 + abs(len(r) - len(h)) + len(r) // {share} AS band
  FROM (SELECT utterance_id, {tokens("reference")} AS r, {tokens("hypothesis")} AS h FROM pairs)
), {name}_dp(utterance_id, x, a, b) {"" if keep else "USING KEY (utterance_id) "}AS (
  SELECT utterance_id, 0::BIGINT, [0::BIGINT], []::BIGINT[] FROM {name}_tokens
  UNION{" ALL" if keep else ""}
  SELECT utterance_id, x + 1, list_transform(range({lo("(x + 1)")}, {hi("(x + 1)")} + 1), lambda i: least({diagonal}, {down}, {across})), a
  FROM {name}_dp JOIN {name}_tokens USING (utterance_id) WHERE x < n + m
), {name} AS (
  SELECT utterance_id, (m - cost + ins)::BIGINT AS hits, (cost - ins - dels)::BIGINT AS substitutions, dels::BIGINT AS deletions, ins::BIGINT AS insertions FROM (
    SELECT utterance_id, m, CASE WHEN a[1] // {_ONE} <= band THEN a[1] // {_ONE} ELSE error('the band is too narrow')::BIGINT END AS cost,
      a[1] & {_INSERTED} AS ins, (a[1] & {_INSERTED}) + m - n AS dels
    FROM {name}_dp JOIN {name}_tokens USING (utterance_id) WHERE x = n + m)
)"""


def _rate_sql(mode: str, pick=lambda c: c) -> str:
    h, s, d, i = (pick(c) for c in ("hits", "substitutions", "deletions", "insertions"))
    if mode == "standard":
        return f"CASE WHEN {h} + {s} + {d} = 0 THEN ({i})::DOUBLE ELSE ({s} + {d} + {i})::DOUBLE / ({h} + {s} + {d}) END"
    return f"CASE WHEN {h} + {s} + {d} + {i} = 0 THEN 0::DOUBLE ELSE ({s} + {d} + {i})::DOUBLE / ({h} + {s} + {d} + {i}) END"


def _wer_sql(mode: str) -> str:
    return f"WITH RECURSIVE {_ITEMS}, {_dp('w', _words, share=2)} SELECT *, {_rate_sql(mode)} AS wer FROM w"


def _sums_sql(name: str, mode: str, out: str) -> str:
    total = lambda c: f"sum({name}.{c})::BIGINT"
    own = lambda c: f"{name}.{c}"
    return f"{_rate_sql(mode, total)} AS {out}_micro, round(avg({_rate_sql(mode, own)}), 9) AS {out}_macro, " + ", ".join(
        f"{total(c)} AS {out}_{c}" for c in ("hits", "substitutions", "deletions", "insertions")
    )


def _corpus_sql(mode: str, pairs: str = "") -> str:
    perfect = "sum((c.substitutions + c.deletions + c.insertions = 0)::INT)::BIGINT"
    return f"""WITH RECURSIVE {pairs or _ITEMS}, {_dp("c", _chars)}, {_dp("w", _words, share=2)}
SELECT count(*) AS utterances, {_sums_sql("c", mode, "cer")}, {_sums_sql("w", mode, "wer")}, {perfect} AS perfect_sentences,
  (count(*) - {perfect})::DOUBLE / count(*) AS sentence_error_rate FROM c JOIN w USING (utterance_id)"""


def _rows_sql(mode: str) -> str:
    part = lambda n, out: f"{_rate_sql(mode, lambda c: f'{n}.{c}')} AS {out}_value, " + ", ".join(f"{n}.{c} AS {out}_{c}" for c in ("hits", "substitutions", "deletions", "insertions"))
    return f"""WITH RECURSIVE {_ITEMS}, {_dp("c", _chars)}, {_dp("w", _words, share=2)}
SELECT utterance_id, {part("c", "cer")}, {part("w", "wer")}, round((1 - {_rate_sql(mode, lambda c: f'c.{c}')})::DECIMAL(38, 20), 2)::DOUBLE AS crr FROM c JOIN w USING (utterance_id)"""


def _steps_sql(tokens) -> str:
    lo = "greatest(0, x - m, (x - band + 1) // 2)"
    return f"""{_dp("a", tokens, True, 2)}, a_cells AS MATERIALIZED (
  SELECT utterance_id * 4294967296 + x * 65536 + {lo} + unnest(range(len(a))) AS cell, unnest(list_transform(a, lambda v: (v >> 20) & 3))::TINYINT AS kind
  FROM a_dp JOIN a_tokens USING (utterance_id)
), way(utterance_id, i, j, back, kind) AS (
  SELECT utterance_id, n, m, 0::BIGINT, NULL::TINYINT FROM a_tokens
  UNION ALL
  SELECT utterance_id, i - (c.kind <> 2)::INT, j - (c.kind <> 1)::INT, back + 1, c.kind
  FROM way JOIN a_cells c ON c.cell = utterance_id * 4294967296 + (i + j) * 65536 + i WHERE i + j > 0
), edits AS (
  SELECT utterance_id, (max(back) OVER (PARTITION BY utterance_id) - back)::INTEGER AS step,
    CASE WHEN kind = 1 THEN 'insert' WHEN kind = 2 THEN 'delete' WHEN r[j + 1] = h[i + 1] THEN 'equal' ELSE 'substitute' END AS type,
    CASE WHEN kind = 1 THEN '' ELSE r[j + 1] END AS reference, CASE WHEN kind = 2 THEN '' ELSE h[i + 1] END AS hypothesis, j::INTEGER AS place
  FROM way JOIN a_tokens USING (utterance_id) WHERE kind IS NOT NULL
)"""


_T = patterns.TOKEN


def _mention_sql(keyword: str, side: str, particles: bool = True) -> str:
    """Mentions, with each boundary character doubled, as DuckDB has no look-around."""
    blank = r"[ \t\n\r\f\x0B]"
    own = f"{blank}*".join(keyword.replace(" ", ""))
    tail = sorted({*patterns.PARTICLES, *patterns.ENDINGS}, key=lambda x: (-len(x), x))
    return f"len(regexp_extract_all(regexp_replace(' ' || {side} || ' ', '([^{_T}])', '\\1\\1', 'g'), '[^{_T}]{own.replace(blank + '*', f'{blank}*')}(?:{blank}*(?:{'|'.join(tail)}))?[^{_T}]'))"


def _entity_forms() -> list[tuple[int, str, str, str, str]]:
    """(number, name, label, scorable characters, pattern within marks) of each entity; \\x1E and \\x1F stand around all that isn't in a token."""
    blank = r"(?:\x1E[ \t\n\r\f\x0B]\x1F)*"
    tail = sorted({*patterns.PARTICLES, *patterns.ENDINGS}, key=lambda x: (-len(x), x))
    out = []
    for k, (name, label) in enumerate(patterns.definitions(ENTITIES)[0]):
        forms = sorted((name, *ALIASES.get(name, [])), key=lambda x: (-len(patterns.compact(x)), x))
        own = "|".join(blank.join(patterns.compact(x)) for x in forms)
        out.append((k, name, label, patterns.compact(name), rf"\x1F({own})(?:{blank}(?:{'|'.join(tail)}))?\x1E"))
    return out


def _entity_sql(table: str) -> str:
    """The entity tables over ``benchmark``: mentions become characters of the private use area, an alignment goes over the canonical texts."""
    defs = _entity_forms()
    apart = lambda c: rf"regexp_replace(' ' || {c} || ' ', '([^{_T}])', chr(30) || '\1' || chr(31), 'g')"
    mention, first, rest = (lambda k, base=base: f"chr({base + k})" for base in (0xE000, 0xE100, 0xE200))

    def marked(c: str) -> str:
        out = apart(c)
        for k, _, _, _, pattern in defs:
            out = f"regexp_replace({out}, '{pattern}', chr(31) || {mention(k)} || chr(30), 'g')"
        return rf"regexp_replace(regexp_replace({out}, '[\x1E\x1F \t\n\r\x0B\f]', '', 'g'), '\p{{P}}', '', 'g')"

    def put(c: str, what) -> str:
        for k, _, _, own, _ in defs:
            c = f"replace({c}, {mention(k)}, {what(k, own)})"
        return c

    surfaces = ", ".join(rf"list_transform(regexp_extract_all({apart('hypothesis')}, '{pattern}', 1), lambda x: regexp_replace(x, '[\x1E\x1F]', '', 'g')) AS h{k}" for k, *_, pattern in defs)
    dim = ", ".join(f"({k}, '{name}', '{label}', '{own}')" for k, name, label, own, _ in defs)
    hyps = " UNION ALL ".join(f"SELECT utterance_id, {k} AS k, h{k} AS surfaces FROM marked" for k, *_ in defs)
    split = lambda c: f"list_filter(string_split({c}, ''), lambda w: w <> '')"
    head = f"""WITH RECURSIVE raw AS (SELECT * FROM (WITH {_ITEMS} SELECT * FROM pairs)), dim(k, name, label, own) AS (VALUES {dim}), marked AS (
  SELECT utterance_id, {marked("reference")} AS r, {marked("hypothesis")} AS h, {surfaces} FROM raw
), pairs AS (
  SELECT utterance_id, {put("r", lambda k, own: f"'{own}'")} AS reference, {put("h", lambda k, own: f"'{own}'")} AS hypothesis FROM marked
), {_steps_sql(split)}, places AS (
  SELECT utterance_id, unnest(range(1, len(c) + 1)) AS p, unnest(c) AS c FROM (SELECT utterance_id, {split(put("r", lambda k, own: f"{first(k)} || repeat({rest(k)}, {len(own) - 1})"))} AS c FROM marked)
), spans AS (
  SELECT utterance_id, p, (unicode(c) & 255) AS k, sum((unicode(c) BETWEEN {0xE100} AND {0xE1FF})::INT) OVER (PARTITION BY utterance_id ORDER BY p) AS span
  FROM places WHERE unicode(c) BETWEEN {0xE100} AND {0xE2FF}
), touched AS (
  SELECT w.utterance_id, w.back, w.kind, w.i, w.j, s.k, s.span FROM way w JOIN spans s ON s.utterance_id = w.utterance_id AND s.p = w.j + 1
  LEFT JOIN spans b ON b.utterance_id = w.utterance_id AND b.p = w.j WHERE w.kind IS NOT NULL AND (w.kind <> 1 OR b.span = s.span)
), each AS (
  SELECT utterance_id, k, span, sum((kind = 0 AND r[j + 1] = h[i + 1])::INT) AS hits, sum((kind = 0 AND r[j + 1] <> h[i + 1])::INT) AS substitutions, sum((kind = 2)::INT) AS deletions, sum((kind = 1)::INT) AS insertions,
    coalesce(string_agg(r[j + 1], '' ORDER BY back DESC) FILTER (WHERE kind <> 1), '') AS reference, coalesce(string_agg(h[i + 1], '' ORDER BY back DESC) FILTER (WHERE kind <> 2), '') AS hypothesis
  FROM touched JOIN a_tokens USING (utterance_id) GROUP BY ALL
), counted AS (
  SELECT utterance_id, k, coalesce(any_value(n.r), 0) AS r, coalesce(any_value(n.e), 0) AS e, len(any_value(s.surfaces)) AS h, any_value(s.surfaces) AS surfaces
  FROM ({hyps}) s LEFT JOIN (SELECT utterance_id, k, count(*) AS r, sum((substitutions + deletions + insertions > 0)::INT) AS e FROM each GROUP BY ALL) n USING (utterance_id, k) GROUP BY ALL
), """
    if table == "errors":
        return head + """listed AS (
  SELECT utterance_id, k, CASE WHEN hypothesis = '' THEN 'omission' ELSE 'misrecognition' END AS type, reference, hypothesis, substitutions, deletions, insertions FROM each WHERE substitutions + deletions + insertions > 0
  UNION ALL SELECT utterance_id, k, 'omission', own, '', 0, len(own), 0 FROM (SELECT *, unnest(range(greatest(r - h - e, 0)::BIGINT)) FROM counted) JOIN dim USING (k)
  UNION ALL SELECT utterance_id, k, 'addition', '', s, 0, 0, len(own) FROM (SELECT utterance_id, k, unnest(surfaces[least(r, h)::BIGINT + 1:]) AS s FROM counted) JOIN dim USING (k)
) SELECT utterance_id AS sentence_index, type, name AS entity, label, reference, hypothesis, substitutions::INT AS substitutions, deletions::INT AS deletions, insertions::INT AS insertions FROM listed JOIN dim USING (k)"""
    by = {"entities": ", k AS definition_index, name, label", "labels": ", label, min(k) AS position", "summary": ""}[table]
    group = {"entities": "GROUP BY k, name, label", "labels": "GROUP BY label", "summary": ""}[table]
    sums = lambda c: f"coalesce(sum({c}), 0)::BIGINT"
    macro = f", coalesce((SELECT avg({_rate_sql('normalized')}) FROM each), 0) AS macro" if table == "summary" else ""
    return head + f"""chars AS (
  SELECT k, sum(hits) AS hits, sum(substitutions) AS substitutions, sum(deletions) AS deletions, sum(insertions) AS insertions FROM each GROUP BY k
), mentions AS (
  SELECT k, sum(r) AS r, sum(h) AS h, sum(least(r, h)) AS tp, sum(greatest(h - r, 0)) AS fp, sum(greatest(r - h, 0)) AS fn FROM counted GROUP BY k
), total AS (
  SELECT {sums("r")} AS reference_count, {sums("h")} AS hypothesis_count, {sums("tp")} AS true_positives, {sums("fp")} AS false_positives, {sums("fn")} AS false_negatives,
    {sums("hits")} AS hits, {sums("substitutions")} AS substitutions, {sums("deletions")} AS deletions, {sums("insertions")} AS insertions{by}
  FROM dim LEFT JOIN mentions USING (k) LEFT JOIN chars USING (k) {group}
), rated AS (
  SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 0 ELSE true_positives::DOUBLE / (true_positives + false_positives) END AS precision,
    CASE WHEN true_positives + false_negatives = 0 THEN 0 ELSE true_positives::DOUBLE / (true_positives + false_negatives) END AS recall FROM total
) SELECT *, recall AS preservation_rate, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
  {_rate_sql("normalized")} AS cer, hits + substitutions + deletions AS reference_characters{macro} FROM rated"""


def _keyword_sql(groups: dict, last: str) -> str:
    entries = [(k, w, label) for k, (w, label) in enumerate(patterns.definitions(groups)[0])]
    rows = " UNION ALL ".join(
        f"SELECT {k} AS k, '{w}' AS keyword, '{label}' AS label, {_mention_sql(w, 'reference')} AS r, {_mention_sql(w, 'hypothesis')} AS h FROM pairs" for k, w, label in entries
    )
    counts = "sum(r)::BIGINT AS reference_count, sum(h)::BIGINT AS hypothesis_count, sum(least(r, h))::BIGINT AS true_positives, sum(greatest(h - r, 0))::BIGINT AS false_positives, sum(greatest(r - h, 0))::BIGINT AS false_negatives"
    return f"""WITH {_TURNS}, m AS ({rows}), n AS (SELECT {last}, {counts} FROM m GROUP BY ALL), p AS (
  SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 0 ELSE true_positives::DOUBLE / (true_positives + false_positives) END AS precision,
    CASE WHEN true_positives + false_negatives = 0 THEN 0 ELSE true_positives::DOUBLE / (true_positives + false_negatives) END AS recall FROM n)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1"""


def _legacy_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{w}' AS keyword, {_mention_sql(w, 'reference')} > 0 AS r, {_mention_sql(w, 'hypothesis')} > 0 AS h FROM pairs" for w in LEGACY)
    return f"""WITH {_TURNS}, m AS ({rows}), n AS (
  SELECT keyword, sum(r::INT)::BIGINT AS total, sum((r AND h)::INT)::BIGINT AS correct FROM m GROUP BY GROUPING SETS ((keyword), ())
) SELECT keyword, total, correct, total - correct AS errors, CASE WHEN total = 0 THEN 0 ELSE round(correct::DOUBLE / total, 4) END AS accuracy, CASE WHEN total = 0 THEN 0 ELSE round((total - correct)::DOUBLE / total, 4) END AS error_rate FROM n"""


_SQUEEZED = r"trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))"
_ABOUT = {"text": ("NULL", "NULL", "NULL"), "json": ("'segments'", "NULL", "'m' || conv_id"), "srt": ("'cue_text'", "'srt_timecode'", "NULL"), "tsv": ("'text_column'", "'seconds'", "NULL")}


def _transcript_sql(kind: str) -> str:
    about = ", ".join(f"({x})::VARCHAR AS {n}" for x, n in zip(_ABOUT[kind], ("text_source", "unit", "model"))) + ", NULL::VARCHAR AS error"
    if kind == "text":
        return f"SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, NULL::BIGINT AS segments, {about} FROM conversations GROUP BY conv_id"
    return f"SELECT conv_id, string_agg({_SQUEEZED}, ' ' ORDER BY turn) FILTER (WHERE {_SQUEEZED} <> '') AS text, count(*) AS segments, {about} FROM conversations GROUP BY conv_id"


def _segments_sql(kind: str) -> str:
    stamp = "'00:' || lpad((({}) % 60)::VARCHAR, 2, '0') || ':00,000'" if kind == "srt" else "({})::VARCHAR"
    return f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS segment,
  {stamp.format("turn")} AS start, {stamp.format("turn + 1")} AS "end", {_SQUEEZED} AS text FROM conversations"""


def _values(rows, names: str) -> str:
    shown = lambda x: "NULL" if x is None else repr(x) + "::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else f"'{x}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names})"


def _report_sql() -> str:
    part = lambda n, out, value: f"{value} AS {out}_value, " + ", ".join(f"{n}.{c} AS {out}_{c}" for c in ("substitutions", "deletions", "insertions"))
    rate = lambda n: _rate_sql("normalized", lambda c: f"{n}.{c}")
    mark = lambda c: f"sha256({c}) AS {c}_sha256, length({c})::BIGINT AS {c}_character_count, strlen({c})::BIGINT AS {c}_byte_count"
    return f"""WITH RECURSIVE {_ITEMS}, {_dp("c", _chars)}, {_dp("w", _words, share=2)}
SELECT utterance_id, '1.0' AS schema_version, 'normalized' AS rate_mode, true AS rm_punctuation, 'text' AS format, {part("c", "cer", rate("c"))}, {part("w", "wer", rate("w"))},
  {part("c", "crr", f"round((1 - {rate('c')})::DECIMAL(38, 20), 2)::DOUBLE")}, {mark("reference")}, {mark("hypothesis")}
FROM c JOIN w USING (utterance_id) JOIN pairs USING (utterance_id)"""


def oracle_sql() -> dict[str, str]:
    frequencies = f"""WITH RECURSIVE {_ITEMS}, {_steps_sql(_words)}, n AS (SELECT type, reference, hypothesis, count(*) AS count FROM edits WHERE type <> 'equal' GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY type ORDER BY count DESC, reference, hypothesis))::INTEGER AS rank FROM n"""
    return {
        "corpus_report_normalized": _corpus_sql("normalized"),
        "corpus_report_standard": _corpus_sql("standard"),
        "metrics_per_row_normalized": _rows_sql("normalized"),
        "metrics_per_row_standard": _rows_sql("standard"),
        "wer_per_row_normalized": _wer_sql("normalized"),
        "wer_per_row_standard": _wer_sql("standard"),
        **{f"corpus_wer_{m}": f"WITH RECURSIVE {_ITEMS}, {_dp('w', _words, share=2)} SELECT count(*) AS utterances, {_sums_sql('w', m, 'wer')} FROM w" for m in ("normalized", "standard")},
        "corpus_report_turns": _corpus_sql("normalized", _TURNS),
        "alignment_characters": f"WITH RECURSIVE {_ITEMS}, {_steps_sql(_chars)} SELECT * EXCLUDE (place) FROM edits",
        **{f"transcript_segments_{k}": _segments_sql(k) for k in ("json", "srt", "tsv")},
        "transcript_refused": "SELECT conv_id, turn, unnest(['srt', 'tsv', 'json']) AS source_format, turn % 4 < 2 AS refused FROM conversations",
        "evaluation_report": _report_sql(),
        "golden_rates": _values([(k, *r[2:]) for k, r in enumerate(GOLDEN)], "utterance_id, cer, cer_standard, wer"),
        "golden_keywords": _values([
            ("keyword", "삼성전자", 2, 2, 1, 1, 1, 0.5), ("keyword", "애플", 1, 1, 1, 0, 0, 1.0), ("keyword", "메리츠 화재", 1, 1, 1, 0, 0, 1.0), ("keyword", "C++", 1, 0, 0, 0, 1, 0.0),
            ("label", "ORG", 4, 4, 3, 1, 1, 0.75), ("label", "LANG", 1, 0, 0, 0, 1, 0.0), ("total", None, 5, 4, 3, 1, 2, 2 / 3),
        ], "level, name, reference_count, hypothesis_count, true_positives, false_positives, false_negatives, f1"),
        "golden_entities": _values([
            ("삼성전자", "회사", 2, 0, 0, 0, 2, 2 / 9, 7, 1, 0, 1), ("애플", "회사", 2, 2, 1, 1, 1, 0.5, 2, 0, 2, 0), ("갤럭시 S26", "제품", 2, 2, 2, 0, 0, 0.0, 12, 0, 0, 0),
        ], "name, label, reference_count, hypothesis_count, true_positives, false_positives, false_negatives, cer, hits, substitutions, deletions, insertions"),
        "golden_entity_errors": _values([
            (0, "misrecognition", "삼성전자", "회사", "삼성전자", "삼성전다", 1, 0, 0), (0, "addition", "애플", "회사", "", "애플", 0, 0, 2),
            (1, "omission", "애플", "회사", "애플", "", 0, 2, 0), (2, "misrecognition", "삼성전자", "회사", "삼성전자", "삼성대전자", 0, 0, 1),
        ], "sentence_index, type, entity, label, reference, hypothesis, substitutions, deletions, insertions"),
        "perfect_sentences": f"WITH {_TURNS} SELECT count(*) AS utterances, sum(({_bare('reference')} = {_bare('hypothesis')})::INT)::BIGINT AS perfect_sentences FROM pairs",
        "alignment_words": f"WITH RECURSIVE {_ITEMS}, {_steps_sql(_words)} SELECT * EXCLUDE (place) FROM edits",
        "alignment_indices": f"WITH RECURSIVE {_ITEMS}, {_steps_sql(_words)} SELECT utterance_id, step, type, CASE WHEN type <> 'insert' THEN place END AS reference_index, place AS reference_position FROM edits",
        "aligned_turns": f"WITH {_TURNS} SELECT * FROM pairs",
        "explained_items": f"WITH RECURSIVE {_ITEMS}, {_dp('c', _chars)} SELECT c.*, {_bare('reference')} AS processed_reference, {_bare('hypothesis')} AS processed_hypothesis, {_rate_sql('standard')} AS rate FROM c JOIN pairs USING (utterance_id)",
        "sql_rates": f"""WITH RECURSIVE {_ITEMS}, {_dp('c', _chars)}, {_dp('w', _words, share=2)} SELECT c.*, {_rate_sql('normalized', lambda c: f'c.{c}')} AS cer, {_rate_sql('normalized', lambda c: f'w.{c}')} AS wer,
  round((1 - {_rate_sql('normalized', lambda c: f'c.{c}')})::DECIMAL(38, 20), 2)::DOUBLE AS crr FROM c JOIN w USING (utterance_id)""",
        "error_frequencies_words": frequencies,
        "keyword_mentions": _keyword_sql(KEYWORDS, "keyword AS name, k AS position") + ", recall AS preservation_rate FROM p",
        "keyword_labels": _keyword_sql(KEYWORDS, "label AS name, min(k) AS position") + ", recall AS preservation_rate FROM p",
        "keyword_summary": _keyword_sql(KEYWORDS, "count(*) - count(*) AS zero").replace("SELECT *, CASE WHEN precision + recall", "SELECT * EXCLUDE (zero), CASE WHEN precision + recall") + ", recall AS preservation_rate FROM p",
        "sentence_keyword_errors": _legacy_sql(),
        "entity_mentions": _keyword_sql(ENTITIES, "keyword AS name, label") + " FROM p",
        **{f"entity_{k}_items": _entity_sql("entities" if k == "scores" else k) for k in ("scores", "labels", "summary", "errors")},
        **{f"transcript_{k}": _transcript_sql(k) for k in ("text", "json", "srt", "tsv")},
        "fingerprints": f"WITH {_TURNS} SELECT utterance_id, sha256(reference) AS sha256, length(reference)::INTEGER AS character_count, strlen(reference)::INTEGER AS byte_count FROM pairs",
        "nfc_fingerprints": f"WITH {_TURNS} SELECT utterance_id, sha256(nfc_normalize(reference)) AS sha256 FROM pairs",
        "code_points": rf"WITH {_TURNS} SELECT utterance_id, coalesce(array_to_string(list_transform(list_filter(string_split(reference, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE '\u' || lower(to_hex(unicode(c))) END), ''), '') AS codes FROM pairs",
    }
