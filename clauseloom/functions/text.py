"""White space, stripping and cleaning of document text.

Character classes are spelled out: Java's short forms cover ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, for use inside a character class (one look-up, where ranges would be tried in turn), and as the characters themselves.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def replace(text: Column | str, pattern: str, by: str) -> Column:
    return F.regexp_replace(_column(text), F.lit(pattern), F.lit(by))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    # no pattern: only the ends are looked at
    return F.trim(_column(text), F.lit(BLANKS))


def is_blank(text: Column | str) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(~_column(text).rlike(rf"[^{WS}]"), F.lit(True))


def clean_text(text: Column | str) -> Column:
    """Normalised line ends, at most one empty line in a row, single spaces, no white space at the ends. Null gives ''."""
    out = F.coalesce(_column(text), F.lit(""))
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = replace(out, r"\n{3,}", "\n\n")
    out = replace(F.replace(out, F.lit("\t"), F.lit(" ")), r" {2,}", " ")
    return strip(out)
