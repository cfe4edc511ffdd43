"""Options that all metrics share."""

from __future__ import annotations

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def rate_mode(value: str) -> str:
    """``normalized`` (insertions in the denominator too) or ``standard``, in any case."""
    if not isinstance(value, str):
        raise TypeError("rate_mode must be text")
    if value.lower() not in ("normalized", "standard"):
        raise ValueError("rate_mode is 'normalized' or 'standard'")
    return value.lower()


def unicode_form(value: str | None) -> str | None:
    """A Unicode normalization form in upper case, or None."""
    if value is None:
        return None
    if not isinstance(value, str):
        raise TypeError("unicode_normalization must be text or None")
    if value.upper() not in FORMS:
        raise ValueError("unicode_normalization is None or one of " + ", ".join(FORMS))
    return value.upper()
