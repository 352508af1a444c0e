"""Label text: title case, acronyms, display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acronyms that are always written in capitals.
ACRONYMS = ("HR", "IT", "ID", "PR", "AI", "ML", "BI", "USA", "UK", "EU")


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital and goes on in lower case.

    Unlike ``initcap`` a new word also starts after a hyphen, an apostrophe or
    a digit."""
    marked = F.regexp_replace(c, r"(?<!\p{L})(?=\p{L})", "\u0001")
    parts = F.split(marked, "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def format_label(c: Column) -> Column:
    """SQ-12: how a label is shown: blank is ``unspecified``, known brands and
    acronyms keep their form, all-lower text becomes Title Case."""
    t = F.trim(c)
    low = F.lower(t)
    return (
        F.when(c.isNull() | (t == ""), F.lit("unspecified"))
        .when(low == "paypal", F.lit("PayPal"))
        .when(low == "credit card", F.lit("Credit Card"))
        .when(F.upper(t).isin(*ACRONYMS), F.upper(t))
        .when((t == low) & (t != F.upper(t)), title_case(t))
        .otherwise(t)
    )
