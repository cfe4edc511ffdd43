"""Normalisation and tokens, as Column expressions and, for Arrow kernels, as plain functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that Python takes for white space, for Java's regular expressions.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What a character rate leaves out: ASCII white space only.
ASCII_WS = r"[ \t\n\r\x0B\f]"
_ASCII_BLANKS = dict.fromkeys(map(ord, " \t\n\r\x0b\x0c"))


def normalized(text: Column, form: str | None) -> Column:
    """Unicode normalisation; Spark has none, so an Arrow UDF, unless ``form`` is None."""
    if form is None:
        return text

    @F.pandas_udf("string")
    def to_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return to_form(text)


def cer_text(text: Column, rm_punctuation: bool = True, form: str | None = None) -> Column:
    """Without ASCII white space and, if asked, without punctuation."""
    out = F.regexp_replace(normalized(text, form), ASCII_WS, "")
    return F.regexp_replace(out, r"\p{P}", "") if rm_punctuation else out


def wer_text(text: Column, rm_punctuation: bool = True, form: str | None = None) -> Column:
    """Without punctuation, if asked; white space stays."""
    out = normalized(text, form)
    return F.regexp_replace(out, r"\p{P}", "") if rm_punctuation else out


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+"), lambda x: x != "")


def char_list(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def single_spaced(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, WS + "+", " "), "^ | $", "")


def code_points(text: Column) -> Column:
    r"""ASCII as it is, other characters as ``\u`` and their hexadecimal code."""
    return F.array_join(F.transform(char_list(text), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lower(F.hex(F.ascii(c)))))), "")


def fingerprint(text: Column) -> Column:
    """``(sha256, character_count, byte_count)`` of a text's UTF-8."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.length(text).alias("character_count"), F.octet_length(text).alias("byte_count"))


def is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


def plain_text(text: str, form: str | None) -> str:
    return unicodedata.normalize(form, text) if form else text


def plain_cer_text(text: str, rm_punctuation: bool = True, form: str | None = None) -> str:
    out = plain_text(text, form).translate(_ASCII_BLANKS)
    return "".join(c for c in out if not is_punctuation(c)) if rm_punctuation else out


def plain_wer_text(text: str, rm_punctuation: bool = True, form: str | None = None) -> str:
    out = plain_text(text, form)
    return "".join(c for c in out if not is_punctuation(c)) if rm_punctuation else out
