"""Numbers, sentences and phrases in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is blanked before numbers are read (dates, codes, bullets,
# step references), what a number looks like, and the years that are not numbers.
IGNORED = (
    r"(?U)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"(?U)\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"(?U)\b[A-Za-z0-9]+-\d+\b",
    r"(?U)(?:^|(?<=[.!?\n]))\s*\(?\d+\)?[.\-:]\s+",
    r"(?Ui)\b(?:step|round|stage|source|insight|item|phase)\s+\d+\b",
)
NUMBER = r"(?U)[-+]?\$?\b(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?\b"
YEARS = (2020.0, 2021.0, 2022.0, 2023.0, 2024.0, 2025.0, 2026.0)
PLAIN_DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
PLAIN_NUMBER = r"(?U)(?<![\w\.-])-?\d{1,3}(?:,\d{3})*(?:\.\d+)?(?!\w)|(?<![\w\.-])-?\d+\.\d+(?!\w)"
SENTENCE_END = r"(?<=[.!?])\s+"
# Wording that is replaced, and its replacement.
FORBIDDEN_TERMS = (
    (r"\bstable\b", "consistent"),
    (r"\bnot\s+concentrated\b", "distributed across categories"),
    (r"\bno\s+effect\b", "no statistically significant difference detected"),
    (r"\borganic\b", "unadjusted"),
)
CAUSAL_TERMS = (
    (r"\bleads\s+to\b", "is associated with"),
    (r"\bcaused\s+by\b", "correlated with"),
    (r"\bcauses\b", "is correlated with"),
    (r"\bdriven\s+by\b", "associated with"),
    (r"\bdrives\b", "is associated with"),
    (r"\bresulting\s+in\b", "accompanied by"),
    (r"\bbecause\s+of\b", "in the presence of"),
)
# Generic phrases that betray an unfilled template.
PLACEHOLDERS = (
    "metric across segment", "in metric across", "highest metric", "lowest metric", "median none", "mean none",
    "across segment", "none recorded", "compared to none", "for none", "none vs none",
)


def numbers_in(text: Column) -> Column:
    """TX-01: the numbers of a text as an array of doubles, in order."""
    t = text
    for p in IGNORED:
        t = F.regexp_replace(t, p, " ")
    raw = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))
    values = F.transform(raw, lambda r: F.regexp_replace(r, r"[$%,]", "").try_cast("double"))
    return F.filter(values, lambda v: v.isNotNull() & ~v.isin(*YEARS))


def plain_tokens_in(text: Column) -> Column:
    """TX-01, the audit variant: number tokens as written; only ISO dates are
    skipped by the caller if wanted."""
    return F.regexp_extract_all(text, F.lit(PLAIN_NUMBER), F.lit(0))


def token_value(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").try_cast("double")


def plain_numbers_in(text: Column) -> Column:
    """TX-01, the audit variant: numbers outside ISO dates as doubles."""
    tokens = plain_tokens_in(F.regexp_replace(text, PLAIN_DATE, " "))
    return F.filter(F.transform(tokens, token_value), lambda v: v.isNotNull())


def normalize_key(key: Column) -> Column:
    """TX-02: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def sentences(text: Column) -> Column:
    """TX-04: sentences with their closing punctuation."""
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), SENTENCE_END)


def phrase_hits(text: Column) -> Column:
    """TX-06: the patterns that occur in a text."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("(?U)" + p), F.lit(p)) for p, _ in FORBIDDEN_TERMS + CAUSAL_TERMS]))


def replace_phrases(text: Column) -> Column:
    """TX-06: every forbidden or causal phrase replaced; sentences in which one
    is still left afterwards are dropped."""
    t = text
    for p, repl in FORBIDDEN_TERMS + CAUSAL_TERMS:
        t = F.regexp_replace(t, "(?Ui)" + p, repl)
    any_left = "(?Ui)" + "|".join(p for p, _ in FORBIDDEN_TERMS + CAUSAL_TERMS)
    kept = F.array_join(F.filter(F.split(t, SENTENCE_END), lambda s: ~s.rlike(any_left)), " ")
    return F.trim(F.when(t.rlike(any_left), kept).otherwise(t))


def has_placeholder(text: Column) -> Column:
    """IN-11: empty text, a generic phrase, or a None/nan/null token; ``IS NULL``
    and the like are allowed."""
    low = F.lower(text)
    generic = low.rlike("(?U)" + r"\b(" + "|".join(PLACEHOLDERS) + r")\b")
    tokens = text.rlike(r"(?U)\b(None|nan|NaN)\b")
    null_word = low.rlike(r"(?U)\bnull\b") & ~low.rlike(r"(?U)\b(is\s+not\s+null|is\s+null|not\s+null|set\s+null)\b")
    return F.coalesce(text.isNull() | (text == "") | generic | tokens | null_word, F.lit(True))
