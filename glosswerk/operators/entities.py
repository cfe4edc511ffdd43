"""Entity spans: mention scores, character error rate within spans, and a list of errors.

Finding mentions, aligning and attributing edits is one Arrow kernel a sentence; it gives small
structs, from which four tables are made by ordinary aggregations.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import compress
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edit, patterns, rates
from ..functions.text import is_punctuation, plain_text
from ..options import rate_mode as resolve_mode
from ..options import unicode_form

_BLANKS = frozenset(" \t\n\r\x0b\x0c")
_COUNTS = ("hits", "substitutions", "deletions", "insertions")
_STATS = "array<struct<definition_index:int,r:bigint,h:bigint,hits:bigint,substitutions:bigint,deletions:bigint,insertions:bigint,rate_sum:double,occurrences:bigint>>"
_ERRORS = "array<struct<start:int,seq:int,type:string,definition_index:int,reference:string,hypothesis:string,substitutions:int,deletions:int,insertions:int>>"


class Entity(NamedTuple):
    name: str
    label: str | None
    text: str
    aliases: tuple[str, ...]
    pattern: str
    scorable: str
    heads: frozenset[str]


def entity_definitions(entities, aliases: Mapping[str, str | Sequence[str]] | None = None, josa_list=None, eomi_list=None, rm_punctuation: bool = True, unicode_normalization: str | None = None) -> tuple[list[Entity], bool]:
    """Checked definitions and whether they have labels; ValueError or TypeError for what can't be scored or told apart."""
    entries, labelled = patterns.definitions(entities)
    form = unicode_form(unicode_normalization)
    particles, endings = patterns.affixes(josa_list, patterns.PARTICLES, "josa_list"), patterns.affixes(eomi_list, patterns.ENDINGS, "eomi_list")
    surfaces: dict[str, list[str]] = {name: [] for name, _ in entries}
    if aliases is not None and not isinstance(aliases, Mapping):
        raise TypeError("aliases must map entities to texts")
    for entity, values in (aliases or {}).items():
        if not isinstance(entity, str):
            raise TypeError("aliases are of entities' names")
        name = entity.strip()
        if name not in surfaces:
            raise ValueError(f"aliases of {entity!r}, which is no entity")
        values = patterns.texts([values] if isinstance(values, str) else values, "aliases")
        for v in values:
            if not v.strip():
                raise ValueError("aliases must not be blank")
            surfaces[name].append(plain_text(v.strip(), form))
    owner: dict[str, str] = {}
    for name, _ in entries:
        if owner.setdefault(patterns.compact(plain_text(name, form)), name) != name:
            raise ValueError("entities must differ after normalisation")
    for name, own in surfaces.items():
        for v in own:
            key = patterns.compact(v)
            if key in owner:
                raise ValueError(f"alias {v!r} of {name!r} is taken by {owner[key]!r}")
            owner[key] = name
    found, tail = [], patterns.suffix(particles, endings, r"\s")
    for name, label in entries:
        canonical = plain_text(name, form)
        forms = sorted((canonical, *surfaces[name]), key=lambda x: (-len(patterns.compact(x)), x))
        pattern = f"(?<![{patterns.TOKEN}])({'|'.join(patterns.spaced(x, chr(92) + 's') for x in forms)}){tail}(?![{patterns.TOKEN}])"
        scorable = _scorable(canonical, rm_punctuation)[0]
        if not scorable:
            raise ValueError(f"entity {name!r} has no character to score")
        found.append(Entity(name, label, canonical, tuple(surfaces[name]), pattern, scorable, frozenset(patterns.compact(x)[0] for x in forms)))
    return found, labelled


class _Scored(dict):
    """Whether a character counts; each is looked up once."""

    def __init__(self, rm_punctuation: bool):
        self.rm_punctuation = rm_punctuation

    def __missing__(self, c: str) -> bool:
        self[c] = found = c not in _BLANKS and not (self.rm_punctuation and is_punctuation(c))
        return found


_SCORED = {x: _Scored(x) for x in (False, True)}


def _scorable(text: str, rm_punctuation: bool) -> tuple[str, list[int]]:
    """The characters that count, and where they stood."""
    own = list(map(_SCORED[bool(rm_punctuation)].__getitem__, text))
    return "".join(compress(text, own)), list(compress(range(len(text)), own))


def _mentions(text: str, compiled: list[re.Pattern], entities: list[Entity]) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The text with canonical mentions, and (entity, start, end, surface) of each: from the left, the longest, the first defined."""
    own = set(text)
    found = sorted((m.start(1), m.start(1) - m.end(1), k, m.group(1)) for k, p in enumerate(compiled) if not own.isdisjoint(entities[k].heads) for m in p.finditer(text))
    out, spans, since, length = [], [], 0, 0
    for start, minus, k, surface in found:
        if start < since:
            continue
        out += (text[since:start], entities[k].text)
        length += start - since
        spans.append((k, length, length + len(entities[k].text), surface))
        length += len(entities[k].text)
        since = start - minus
    return "".join(out) + text[since:], spans


def _sentence(reference: str, hypothesis: str, entities: list[Entity], compiled: list[re.Pattern], rm_punctuation: bool, mode: str, form: str | None, edits: bool = True):
    ref, ref_spans = _mentions(plain_text(reference, form), compiled, entities)
    hyp, hyp_spans = _mentions(plain_text(hypothesis, form), compiled, entities)
    if not ref_spans and not hyp_spans:
        return [], []
    stats: dict[int, list] = {}
    row = lambda k: stats.setdefault(k, [0, 0, 0, 0, 0, 0, 0.0, 0])
    if not edits:
        for side, spans in enumerate((ref_spans, hyp_spans)):
            for k, *_ in spans:
                row(k)[side] += 1
        return [(k, *v) for k, v in sorted(stats.items())], []
    errors, reported = [], Counter()
    if ref_spans:
        shown, at = _scorable(ref, rm_punctuation)
        other = _scorable(hyp, rm_punctuation)[0]
        before, after = edit.places(shown, other)
        for k, start, end, _ in ref_spans:
            # An extra character is in a span only between two of its characters.
            lo, hi = bisect_left(at, start), bisect_left(at, end)
            a, b = shown[lo:hi], other[before[lo] : after[hi - 1]]
            met = [x for x in range(lo, hi) if before[x] < after[x]]
            hits = sum(shown[x] == other[before[x]] for x in met)
            c = (hits, len(met) - hits, hi - lo - len(met), len(b) - len(met))
            own = row(k)
            own[0] += 1
            for x in range(4):
                own[2 + x] += c[x]
            own[6] += rates.plain_error_rate(*c, mode)
            own[7] += 1
            if c[1] or c[2] or c[3]:
                errors.append((start, "misrecognition" if b else "omission", k, a, b, c[1], c[2], c[3]))
                reported[k] += 1
    for k, *_ in hyp_spans:
        row(k)[1] += 1
    for k in sorted(stats):
        r, h, size = stats[k][0], stats[k][1], len(entities[k].scorable)
        missing = max(r - h - reported[k], 0)
        for _, start, _, _ in [s for s in ref_spans if s[0] == k][r - missing :]:
            errors.append((start, "omission", k, entities[k].scorable, "", 0, size, 0))
        for _, start, _, surface in [s for s in hyp_spans if s[0] == k][min(r, h) :]:
            errors.append((start, "addition", k, "", surface, 0, 0, size))
    return [(k, *v) for k, v in sorted(stats.items())], [(e[0], n, *e[1:]) for n, e in enumerate(errors)]


def sentence_scores(pairs: DataFrame, entities: list[Entity], rm_punctuation: bool, mode: str, form: str | None, key: str = "utterance_id", edits: bool = True) -> DataFrame:
    """``(key, stats, errors)`` of each pair, and nothing of pairs without a mention; without ``edits`` mentions are counted only."""
    stat_names = [x.split(":")[0] for x in _STATS.removeprefix("array<struct<").removesuffix(">>").split(",")]
    error_names = [x.split(":")[0] for x in _ERRORS.removeprefix("array<struct<").removesuffix(">>").split(",")]

    def kernel(batches):
        compiled = [re.compile(e.pattern) for e in entities]
        for batch in batches:
            keys, stats, errors = [], [], []
            for n, (r, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if r is None or h is None:
                    raise TypeError("references and hypotheses must be text")
                a, b = _sentence(r, h, entities, compiled, rm_punctuation, mode, form, edits)
                if a:
                    keys.append(n)
                    stats.append([dict(zip(stat_names, x)) for x in a])
                    errors.append([dict(zip(error_names, x)) for x in b])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keys, pa.int64())),
                pa.array(stats, pa.list_(pa.struct([("definition_index", pa.int32()), *[(c, pa.int64()) for c in stat_names[1:7]], ("rate_sum", pa.float64()), ("occurrences", pa.int64())]))),
                pa.array(errors, pa.list_(pa.struct([("start", pa.int32()), ("seq", pa.int32()), ("type", pa.string()), ("definition_index", pa.int32()), ("reference", pa.string()), ("hypothesis", pa.string()), *[(c, pa.int32()) for c in error_names[6:]]]))),
            ], ["key", "stats", "errors"])

    return pairs.select(F.col(key).cast("long").alias("key"), "reference", "hypothesis").mapInArrow(kernel, f"key long, stats {_STATS}, errors {_ERRORS}")


def _statistics(mode: str) -> list[Column]:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return [
        "reference_count", "hypothesis_count", "true_positives", "false_positives", "false_negatives", *rates.classification(tp, fp, fn),
        rates.error_rate(*map(F.col, _COUNTS), mode).alias("cer"), *_COUNTS, (F.col("hits") + F.col("substitutions") + F.col("deletions")).alias("reference_characters"),
    ]


def _sums(scores: DataFrame) -> DataFrame:
    s = scores.select(F.explode("stats").alias("s")).select("s.*")
    return s.groupBy("definition_index").agg(
        F.sum("r").alias("reference_count"), F.sum("h").alias("hypothesis_count"), F.sum(F.least("r", "h")).alias("true_positives"),
        F.sum(F.greatest(F.col("h") - F.col("r"), F.lit(0))).alias("false_positives"), F.sum(F.greatest(F.col("r") - F.col("h"), F.lit(0))).alias("false_negatives"),
        *[F.sum(c).alias(c) for c in _COUNTS], F.sum("rate_sum").alias("rate_sum"), F.sum("occurrences").alias("occurrences"),
    )


def _by_key(pairs: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Pairs in ranges of their keys: what is made of them is in order once each part is sorted, and only the texts are read twice.

    The number of parts is given, as by their bytes too much work would be put into one.
    """
    spark = pairs.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartitionByRange(parts or least, F.col(key).cast("long"))


def evaluate_entities(pairs: DataFrame, entities, josa_list=None, eomi_list=None, rm_punctuation: bool = True, *, aliases=None, rate_mode: str = "normalized", unicode_normalization: str | None = None, key: str = "utterance_id", parts: int | None = None) -> dict[str, DataFrame]:
    """The tables ``entities``, ``labels``, ``summary``, ``errors`` and ``mentions``, which is ``entities`` without what needs an alignment.

    ``summary`` has the micro rate as ``cer`` and ``macro``, the mean over reference mentions (0
    without any).  ``errors`` is in order of ``sentence_index``, ``start``, ``type`` and ``seq``,
    made in so many ``parts`` of near as many pairs, by default as many as a shuffle has.
    """
    mode, form = resolve_mode(rate_mode), unicode_form(unicode_normalization)
    defs, labelled = entity_definitions(entities, aliases, josa_list, eomi_list, rm_punctuation, form)
    spark = pairs.sparkSession
    dim = spark.createDataFrame([(k, e.name, e.label, list(e.aliases)) for k, e in enumerate(defs)], "definition_index int, name string, label string, aliases array<string>")
    scores = lambda of, **o: sentence_scores(of, defs, rm_punctuation, mode, form, key, **o)
    sums = _sums(scores(pairs))
    names = sums.columns[1:]
    filled = lambda found: dim.join(found, "definition_index", "left").na.fill(0, names)
    full = filled(sums)
    total = [F.sum(c).alias(c) for c in names]
    macro = rates.share(F.col("rate_sum"), F.col("occurrences")).alias("macro")
    out = {
        "entities": full.select("definition_index", "name", "label", "aliases", *_statistics(mode)),
        "summary": full.agg(*total).select(*_statistics(mode), macro),
        "mentions": filled(_sums(scores(pairs, edits=False))).select("definition_index", "name", "label", "aliases", *_statistics(mode)[:9]),
        "errors": scores(_by_key(pairs, key, parts)).select(F.col("key").alias("sentence_index"), F.explode("errors").alias("e")).select("sentence_index", "e.*")
        .join(F.broadcast(dim.select("definition_index", F.col("name").alias("entity"), "label")), "definition_index")
        .select("sentence_index", "start", "type", "seq", "entity", "label", "reference", "hypothesis", "substitutions", "deletions", "insertions")
        .sortWithinPartitions("sentence_index", "start", "type", "seq"),
    }
    if labelled:
        out["labels"] = full.groupBy("label").agg(F.min("definition_index").alias("position"), *total).select("label", "position", *_statistics(mode))
    return out
