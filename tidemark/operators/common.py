"""Pieces several analysis operators share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_double, is_numeric

# Currency signs and separators removed before a number is parsed.
CURRENCY = "$,€£¥"
# What a number looks like without them; the JVM alone would also read ``12D`` or ``Infinity``.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Text that stands for a missing label in rate analysis.
NULL_TOKENS = ("nan", "none", "<na>", "")


@dataclass
class ToolResult:
    """What an analysis tool returns: a status, a one-row ``summary`` and named
    detail tables. ``summary`` is None unless the status is ``success``."""

    tool: str
    status: str
    message: str = ""
    summary: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)


def currency_to_double(col: str | Column) -> Column:
    """CL-11: text such as ``$1,200.50`` as a double, NULL if it is no number."""
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    bare = F.trim(F.translate(c, CURRENCY, ""))
    return as_double(F.when(bare.rlike(NUMBER), bare.try_cast("double")))


def numeric_frame(ds: Dataset, columns: Sequence[str] | None, min_rate: float, coerce: bool = True) -> list[tuple[str, Column]]:
    """Numeric columns, plus text columns of which more than ``min_rate`` of all
    rows parse as numbers. One aggregate decides for all text columns."""
    wanted = [c for c in (columns or ds.columns) if c in ds.columns]
    texts = [c for c in wanted if ds.df.schema[c].dataType.simpleString() == "string"]
    rates: dict[str, float] = {}
    if coerce and texts:
        row = ds.df.agg(
            F.count("*").alias("_n"), *[F.count(currency_to_double(c)).alias(f"r{i}") for i, c in enumerate(texts)]
        ).first()
        rates = {c: (row[f"r{i}"] / row["_n"] if row["_n"] else 0.0) for i, c in enumerate(texts)}
    out = []
    for c in wanted:
        if is_numeric(ds.df, c):
            out.append((c, as_double(c)))
        elif rates.get(c, 0.0) > min_rate:
            out.append((c, currency_to_double(c)))
    return out


def usable(ds: Dataset, col: str, value: Column) -> Column:
    """``value`` where the cell was observed, NULL where it was imputed."""
    return F.when(~ds.mask(col), value) if col in ds.mask_cols else value


def any_of(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def long_rows(structs: Sequence[Column]) -> Column:
    return F.explode(F.array(*structs))
