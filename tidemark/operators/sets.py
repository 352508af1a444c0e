"""ST-*, IO-17: unions, distinct rows and column differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import any_of


def union_tagged(dfs: dict[str, DataFrame], tag: str = "source_table") -> DataFrame:
    """ST-01: tables of one schema, each row tagged with its table."""
    return reduce(DataFrame.unionByName, [d.withColumn(tag, F.lit(name)) for name, d in dfs.items()])


def combine_tables(dfs: dict[str, DataFrame], tag: str = "_sheet") -> DataFrame:
    """IO-17: tagged union when all tables have the same columns, else the table
    with the most cells."""
    names = [set(d.columns) for d in dfs.values()]
    if all(n == names[0] for n in names):
        return union_tagged(dfs, tag)
    sizes = {name: d.count() * len(d.columns) for name, d in dfs.items()}
    return dfs[max(sizes, key=sizes.get)]


def column_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST-02: columns only one side has, with the number of values they hold."""
    parts = []
    for side, d, other in (("left", a, b), ("right", b, a)):
        only = [c for c in d.columns if c not in other.columns]
        if only:
            wide = d.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(only)])
            parts.append(wide.select(F.explode(F.array(*[
                F.struct(F.lit(side).alias("side"), F.lit(c).alias("column"), F.col(f"c{i}").alias("values")) for i, c in enumerate(only)
            ])).alias("s")).select("s.*"))
    if not parts:
        return a.sparkSession.createDataFrame([], "side string, column string, values bigint")
    return reduce(DataFrame.unionByName, parts)


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """ST-03."""
    return (df.select(*cols) if cols else df).distinct()


def union_flags(df: DataFrame, flags: dict[str, object]) -> DataFrame:
    """ST-04: rows for which any flag holds; an OR in one scan instead of a
    distinct union of row sets."""
    return df.filter(any_of([F.coalesce(f, F.lit(False)) for f in flags.values()]))
