"""The unit every analysis works on: a table plus the marks of imputed cells."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK_PREFIX = "_imputed_"


@dataclass
class Dataset:
    """``df`` holds the data columns and, per imputed column, a boolean
    ``_imputed_<column>``. ``report`` holds small cleaning facts by name."""

    df: DataFrame
    mask_cols: list[str] = field(default_factory=list)
    report: dict[str, Any] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(MASK_PREFIX)]

    @property
    def numeric_columns(self) -> list[str]:
        return [c for c in self.columns if is_numeric(self.df, c)]

    def mask(self, col: str) -> Column:
        """True where the cell of ``col`` was filled in by cleaning."""
        if col in self.mask_cols:
            return F.col(f"`{MASK_PREFIX}{col}`")
        return F.lit(False)

    def clean(self) -> DataFrame:
        return self.df.select([F.col(f"`{c}`") for c in self.columns])

    def observed(self) -> DataFrame:
        """CL-26: the table with every imputed cell set back to NULL."""
        return self.df.select(
            [F.when(~self.mask(c), F.col(f"`{c}`")).alias(c) if c in self.mask_cols else F.col(f"`{c}`") for c in self.columns]
        )


def as_dataset(data: "Dataset | DataFrame") -> Dataset:
    if isinstance(data, Dataset):
        return data
    masks = [c[len(MASK_PREFIX):] for c in data.columns if c.startswith(MASK_PREFIX)]
    return Dataset(data, masks)


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def is_temporal(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def as_double(col: str | Column) -> Column:
    """A double with NaN turned into NULL: NaN counts as missing here."""
    c = (F.col(f"`{col}`") if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c), c)
