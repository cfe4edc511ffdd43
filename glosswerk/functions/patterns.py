"""Keyword patterns that bear spacing and one Korean suffix, for Java's and for Python's regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from .text import WS

#: Particles after nouns, by length.
PARTICLES = tuple(
    "가 과 께 나 는 도 로 를 만 며 에 와 은 을 의 이 "
    "까지 도만 든지 라도 마저 밖에 부터 에게 에도 에서 와도 으로 이나 조차 한테 "
    "까지도 라도나 밖에도 에게서 이나마 이라도 조차도 치고는 에서부터 으로부터".split()
)
#: Verb endings, by length.
ENDINGS = tuple("다 니다 하고 하니 한다 했다 하는데 하더니 하려면 하여도 한다면 합니다 했었다 했었지 하더라도 한다니까".split())

TOKEN = "0-9A-Za-z가-힣"


def compact(text: str) -> str:
    return re.sub(r"\s+", "", text)


def literal(text: str) -> str:
    """Escaped for Java and Python alike."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in text)


def spaced(text: str, blank: str) -> str:
    return f"{blank}*".join(map(literal, compact(text)))


def suffix(particles: Sequence[str], endings: Sequence[str], blank: str) -> str:
    """An optional suffix, longest first; nothing without suffixes."""
    own = sorted({x for x in (*particles, *endings) if x}, key=lambda x: (-len(x), x))
    return f"(?:{blank}*(?:{'|'.join(map(literal, own))}))?" if own else ""


def keyword_pattern(keyword: str, particles: Sequence[str] | None = None, endings: Sequence[str] | None = None, java: bool = True) -> str:
    """The pattern of a keyword that isn't part of a longer token.

    Spaces in the keyword and between its characters don't matter.  Particles are the default ones
    if None; endings are none.  With ``java=False`` it is for Python's ``re``.
    """
    if not isinstance(keyword, str):
        raise TypeError("keyword must be text")
    if not compact(keyword):
        raise ValueError("keyword must hold more than blanks")
    blank = WS if java else r"\s"
    tail = suffix(PARTICLES if particles is None else particles, endings or (), blank)
    return f"(?<![{TOKEN}]){spaced(keyword, blank)}{tail}(?![{TOKEN}])"


def definitions(keywords: str | Sequence[str] | Mapping[str, str | Sequence[str]]) -> tuple[list[tuple[str, str | None]], bool]:
    """(keyword, label) in the order given, and whether there are labels; raises for what isn't text, empty or repeated."""
    labelled = isinstance(keywords, Mapping)
    groups = list(keywords.items()) if labelled else [(None, keywords)]
    found, seen = [], set()
    for label, values in groups:
        if labelled:
            if not isinstance(label, str):
                raise TypeError("labels must be text")
            label = label.strip()
            if not label:
                raise ValueError("labels must not be blank")
        if isinstance(values, str):
            values = [values]
        if isinstance(values, (bytes, Mapping)) or not isinstance(values, Iterable):
            raise TypeError("keywords must be text or an iterable of it")
        for value in values:
            if not isinstance(value, str):
                raise TypeError("keywords must be text")
            key = compact(value)
            if not key:
                raise ValueError("keywords must not be blank")
            if key in seen:
                raise ValueError(f"keyword {value!r} is there twice, blanks aside")
            seen.add(key)
            found.append((value.strip(), label))
    if not found:
        raise ValueError("there must be a keyword")
    return found, labelled


def affixes(values: Sequence[str] | None, default: Sequence[str], name: str) -> tuple[str, ...]:
    if values is None:
        return tuple(default)
    return texts(values, name)


def texts(values: Iterable[str], name: str) -> tuple[str, ...]:
    """An iterable of texts, but not a text itself; TypeError for others."""
    found = () if isinstance(values, (str, bytes, Mapping)) or not isinstance(values, Iterable) else (tuple(values),)
    if not found or not all(isinstance(x, str) for x in found[0]):
        raise TypeError(f"{name} must be texts")
    return found[0]
