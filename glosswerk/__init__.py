"""Evaluation of speech transcripts on Spark: error rates, explanations, keywords, entities, transcript formats."""

from .functions.patterns import ENDINGS, PARTICLES, keyword_pattern
from .operators.corpus import corpus_report, get_cer, get_crr, get_wer, with_metrics
from .operators.entities import evaluate_entities
from .operators.explain import error_frequencies, explain, explain_errors
from .operators.keywords import evaluate_keywords, sentence_keyword_errors
from .plans.report import evaluation_reports
from .sources.transcripts import TranscriptFormatError, parse_transcript, parse_transcripts

__all__ = [
    "ENDINGS", "PARTICLES", "TranscriptFormatError", "corpus_report", "error_frequencies", "evaluate_entities", "evaluate_keywords",
    "evaluation_reports", "explain", "explain_errors", "get_cer", "get_crr", "get_wer", "keyword_pattern", "parse_transcript",
    "parse_transcripts", "sentence_keyword_errors", "with_metrics",
]
__version__ = "0.1.0"
