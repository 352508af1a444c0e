"""Date parsing with an ordered list of formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yy", "d-M-yy")
TIMESTAMP_FORMATS = ("yyyy-M-d H:m:s[.SSSSSSSSS][XXX]", "yyyy-M-d'T'H:m:s[.SSSSSSSSS][XXX]")
DATE_SHAPE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|[A-Z][a-z]{2,8} \d{1,2}, \d{4}|\d{1,2} [A-Z][a-z]{2,8} \d{4}"
# What the letters of a format stand for in text.
_LETTERS = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Z][a-z]{2,8}", "MMM": "[A-Z][a-z]{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}",
    "m": r"\d{1,2}", "s": r"\d{1,2}", "SSSSSSSSS": r"\d{1,9}", "XXX": r"(Z|[+-]\d{2}:\d{2})", "[": "(", "]": ")?", ".": r"\.",
}


def _shape(fmt: str) -> str:
    """A regular expression for text that can fit ``fmt``; the parser is only
    called on such text, since every failed parse costs an exception."""
    words = (m.group() for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", fmt))
    return "^" + "".join(w.strip("'") if w.startswith("'") else _LETTERS.get(w, w) for w in words) + "$"


def parse_date(col: str | Column, formats: Sequence[str] = DATE_FORMATS + TIMESTAMP_FORMATS) -> Column:
    """The first format that fits wins. A column whose rows mix several formats
    is read in full; pass only one format to accept just that one."""
    c = F.trim(F.col(f"`{col}`") if isinstance(col, str) else col)
    some = "|".join(f"(?:{_shape(f)})" for f in formats)  # one look at most texts that are no dates
    return F.when(c.rlike(some), F.coalesce(*[F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats]))
