"""The same evaluations over Python lists of sentences, as nested dicts; each is a DataFrame query underneath.

For what fits the driver; larger corpora go through the functions over DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions import patterns
from .operators import corpus, entities, keywords
from .options import rate_mode as resolve_mode
from .options import unicode_form
from .plans.report import NAME, SCHEMA_VERSION
from .sources.transcripts import _format

_MENTIONS = ("reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1", "preservation_rate")
_EDITS = ("hits", "substitutions", "deletions", "insertions")


def sentence_pairs(references: Iterable[str], hypotheses: Iterable[str], empty: bool = False) -> DataFrame:
    """``(utterance_id, reference, hypothesis)``; TypeError for what isn't text, ValueError for lists of unlike length or, without ``empty``, none at all."""
    if any(isinstance(x, (str, bytes)) or not isinstance(x, Iterable) for x in (references, hypotheses)):
        raise TypeError("references and hypotheses must be iterables of texts")
    both = [list(references), list(hypotheses)]
    if len(both[0]) != len(both[1]) or not (both[0] or empty):
        raise ValueError("there must be as many hypotheses as references, and one at least")
    if not all(isinstance(x, str) for own in both for x in own):
        raise TypeError("references and hypotheses must be texts")
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.createDataFrame([(k, *x) for k, x in enumerate(zip(*both))], "utterance_id long, reference string, hypothesis string")


def _picked(row, names: Sequence[str]) -> dict:
    return {n: row[n] for n in names}


def evaluate_corpus(reference_sentences: Iterable[str], hypothesis_sentences: Iterable[str], rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """Micro and macro error rates, edit counts and perfect sentences."""
    pairs, mode, form = sentence_pairs(reference_sentences, hypothesis_sentences), resolve_mode(rate_mode), unicode_form(unicode_normalization)
    r = corpus.corpus_report(pairs, rm_punctuation, mode, form).first()
    rates = {c: _picked(r[c], ("micro", "macro", *_EDITS)) for c in ("cer", "wer")}
    return {"utterances": r.utterances, "rate_mode": mode, "unicode_normalization": form, **rates, **_picked(r, ("perfect_sentences", "sentence_error_rate"))}


def evaluate_keywords(reference_sentences: Iterable[str], hypothesis_sentences: Iterable[str], keywords_: str | Iterable[str] | Mapping, josa_list: Sequence[str] | None = None, eomi_list: Sequence[str] | None = None) -> dict:
    """Mention scores by keyword and in all, and by label if there are labels."""
    pairs = sentence_pairs(reference_sentences, hypothesis_sentences)
    entries, labelled = patterns.definitions(keywords_)
    given = {label: [k for k, own in entries if own == label] for _, label in entries} if labelled else [k for k, _ in entries]
    rows = keywords.evaluate_keywords(pairs, given, josa_list, eomi_list).orderBy("position").collect()
    of = {(r.level, r.name): _picked(r, _MENTIONS) for r in rows}
    out = {"keywords": {k: of["keyword", k] | ({"label": label} if labelled else {}) for k, label in entries}, "summary": of["total", None]}
    if labelled:
        out["labels"] = {r.name: of["label", r.name] for r in rows if r.level == "label"}
    return out


def calculate_keyword_error_rate_with_pattern(reference_sentences: Sequence[str], hypothesis_sentences: Sequence[str], keywords_: Sequence[str], josa_list: Sequence[str], eomi_list: Sequence[str] | None = None) -> dict:
    """Sentences that lose a keyword, by keyword and in all."""
    pairs = sentence_pairs(reference_sentences, hypothesis_sentences, empty=True)
    rows = {r.keyword: r for r in keywords.sentence_keyword_errors(pairs, list(keywords_), josa_list, eomi_list).collect()}
    total = rows.pop(None)
    return {
        "keywords": {k: _picked(r, ("total", "correct", "errors", "accuracy", "error_rate")) for k, r in rows.items()},
        "summary": {"total_keywords": total.total, "correct_keywords": total.correct, "incorrect_keywords": total.errors, "keyword_error_rate": total.error_rate},
    }


def evaluate_entities(reference_sentences: Iterable[str], hypothesis_sentences: Iterable[str], entities_: str | Iterable[str] | Mapping, josa_list: Sequence[str] | None = None, eomi_list: Sequence[str] | None = None, rm_punctuation: bool = True, *, aliases: Mapping | None = None, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """Mention scores and error rates within spans, by entity and label and in all, and the list of errors."""
    pairs, mode, form = sentence_pairs(reference_sentences, hypothesis_sentences), resolve_mode(rate_mode), unicode_form(unicode_normalization)
    entries, labelled = patterns.definitions(entities_)
    given = {label: [k for k, own in entries if own == label] for _, label in entries} if labelled else [k for k, _ in entries]
    if isinstance(aliases, Mapping):
        aliases = {k: list(v) if isinstance(v, Iterable) and not isinstance(v, (str, bytes, Mapping)) else v for k, v in aliases.items()}
    found = entities.evaluate_entities(pairs, given, josa_list, eomi_list, rm_punctuation, aliases=aliases, rate_mode=mode, unicode_normalization=form)
    spans = ("cer", *_EDITS, "reference_characters")
    rows = found["entities"].orderBy("definition_index").collect()
    total = found["summary"].first()
    errors = [
        {"sentence_index": r.sentence_index, "type": r.type, "entity": r.entity, **_picked(r, ("reference", "hypothesis", "substitutions", "deletions", "insertions"))} | ({"label": r.label} if labelled else {})
        for r in found["errors"].collect()
    ]
    out = {
        "rate_mode": mode, "rm_punctuation": rm_punctuation, "unicode_normalization": form, "aliases_enabled": any(r.aliases for r in rows),
        "entity_cer": {"micro": total.cer, "macro": total.macro, **_picked(total, (*_EDITS, "reference_characters"))},
        "entities": {r.name: _picked(r, (*_MENTIONS, *spans)) | {"aliases": list(r.aliases)} | ({"label": r.label} if labelled else {}) for r in rows},
        "summary": _picked(total, _MENTIONS), "errors": errors,
    }
    if labelled:
        out["labels"] = {r.label: _picked(r, (*_MENTIONS, *spans)) for r in found["labels"].orderBy("position").collect()}
    return out


def make_keyword_pattern(keyword: str, josa_list: Sequence[str] | None = None, eomi_list: Sequence[str] | None = None) -> re.Pattern:
    """The keyword's pattern, compiled."""
    return re.compile(patterns.keyword_pattern(keyword, josa_list, eomi_list, java=False))


def evaluate_transcript(reference: str, transcript: Mapping, rm_punctuation: bool = True, *, rate_mode: str = "normalized", unicode_normalization: str | None = None) -> dict:
    """The report of one parsed transcript; TypeError for what isn't of the right type or can't be written as JSON."""
    from . import __version__

    if not isinstance(reference, str) or not isinstance(transcript, Mapping) or not isinstance(rm_punctuation, bool):
        raise TypeError("a reference text, a parsed transcript and a bool are needed")
    kind, hypothesis, about = _format(transcript.get("source_format")), transcript.get("text"), transcript.get("provenance", {})
    if not isinstance(hypothesis, str) or not isinstance(about, Mapping):
        raise TypeError("a transcript has a text and, as a mapping, its provenance")
    try:
        about = json.loads(json.dumps(dict(about), allow_nan=False, sort_keys=True))
    except ValueError as e:
        raise TypeError("a transcript's provenance must be fit for JSON") from e
    mode, form = resolve_mode(rate_mode), unicode_form(unicode_normalization)
    options = {"rate_mode": mode, "rm_punctuation": rm_punctuation, "unicode_normalization": form}
    metrics = {}
    for name, one in (("cer", corpus.get_cer), ("wer", corpus.get_wer), ("crr", corpus.get_crr)):
        found = one(reference, hypothesis, **options)
        metrics[name] = {"value": found.pop(name), **found}
    mark = lambda t: {"sha256": hashlib.sha256(t.encode()).hexdigest(), "character_count": len(t), "byte_count": len(t.encode())}
    return {
        "schema_version": SCHEMA_VERSION, "evaluator": {"name": NAME, "version": __version__}, "options": options, "metrics": metrics,
        "provenance": {"source": {"format": kind} | ({"details": about} if about else {}), "reference": mark(reference), "hypothesis": mark(hypothesis)},
    }
