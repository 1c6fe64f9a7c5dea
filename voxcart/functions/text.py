"""Text columns: trims, regex captures, apostrophes, file keys, prompts."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# File-name patterns that carry keys, and the text clean-up rules.
KEY_DIGITS = 3
PAGE_PATTERN = r"_Page_([0-9]+)\.png$"
BULLETS = "[•●]"
APOSTROPHE_ENTITY = "&#39;"


def trim_space(text: Column | str) -> Column:
    """Strip every kind of whitespace from both ends (plain trim strips blanks only)."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(WHITESPACE))


def trim_set(text: Column, characters: str) -> Column:
    """Strip any of ``characters`` from both ends: a set, not a phrase."""
    return F.trim(text, F.lit(characters))


def capture(text: Column, pattern: str) -> Column:
    """First capture group, NULL when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def uri_key(uri: Column | str, digits: int | None = KEY_DIGITS, tail: bool = False) -> Column:
    """The key a ``.png`` file name ends with: its digits, if there are ``digits`` of them.

    A longer number is another key and gives NULL, as ``1007`` is not ``007``; with ``tail``
    its last ``digits`` count.  Without ``digits`` a number of any length is the key.
    """
    uri = F.col(uri) if isinstance(uri, str) else uri
    if digits is None:
        return capture(uri, r"([0-9]+)\.png$")
    return capture(uri, rf"{'' if tail else '(?<![0-9])'}([0-9]{{{digits}}})\.png$")


def page_number(uri: Column, pattern: str = PAGE_PATTERN) -> Column:
    return capture(uri, pattern).cast("bigint")


def unescape_apostrophes(text: Column) -> Column:
    return F.replace(text, F.lit(APOSTROPHE_ENTITY), F.lit("'"))


def clean_page_text(text: Column) -> Column:
    """Newlines become blanks and bullet characters go."""
    return F.regexp_replace(F.translate(text, "\n", " "), BULLETS, "")


def unquote(text: Column) -> Column:
    """Strip whitespace, then double quotes, from both ends."""
    return trim_set(trim_space(text), '"')


def number_text(value: Column) -> Column:
    """Number as text without trailing zeros: 2.0 -> 2, 100.50 -> 100.5."""
    plain = value.cast("decimal(38,2)").cast("string")
    return F.regexp_replace(plain, r"\.?0+$", "")


def join_uri(*parts: Column | str) -> Column:
    """Concatenate literal and column parts to a URI, NULL if any part is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# How a missing optional part of a prompt reads.
MISSING = "None"


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` by columns; NULL as soon as one value is NULL.

    The text stays a column expression, so one plan serves every row.
    """
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)
