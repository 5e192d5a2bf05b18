"""Text helpers for reasons, summaries and intake, as SQL expression text."""

from __future__ import annotations


def quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def whole(value: str) -> str:
    """A number without decimals, halves rounded to even."""
    return f"cast(cast(bround({value}, 0) AS decimal(38,0)) AS string)"


def present(*items: str) -> str:
    """Array of the non-null items, in the given order."""
    return f"array_compact(array({', '.join(items)}))"


# Fixed value: the characters Unicode calls white space.
WHITE_SPACE = (
    "\\u0009\\u000a\\u000b\\u000c\\u000d\\u0020\\u0085\\u00a0\\u1680"
    "\\u2000\\u2001\\u2002\\u2003\\u2004\\u2005\\u2006\\u2007\\u2008\\u2009\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)


def strip(value: str) -> str:
    """Remove leading and trailing white space of any kind (not only spaces)."""
    return f"trim(BOTH '{WHITE_SPACE}' FROM {value})"
