"""CL-06, CL-07: one canonical spelling per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import ACRONYMS, title_case
from tidemark.functions.quantiles import bounded_broadcast
from tidemark.operators.cleaning import col, collapse_spaces, string_columns
from tidemark.operators.common import long_rows

MAP_ROWS = 50_000


def spelling_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, key, spelling, n): how often each space-collapsed spelling of a
    lower-case key occurs. Counted before the shuffle, so hot labels cost one
    row per task."""
    cols = list(string_columns(df) if cols is None else cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, key string, spelling string, n bigint")
    cells = df.select(long_rows([F.struct(F.lit(c).alias("column"), collapse_spaces(col(c)).alias("spelling")) for c in cols]).alias("s")).select("s.*")
    return cells.filter("spelling is not null").groupBy("column", "spelling").agg(F.count("*").alias("n")).select(
        "column", F.lower("spelling").alias("key"), "spelling", "n"
    )


def case_candidates(counts: DataFrame, rows: Column) -> DataFrame:
    """CL-07: which columns get canonical labels: distinct/rows < 0.85, or at
    most 250 distinct values, or case variants."""
    per_key = counts.groupBy("column", "key").agg(F.count("*").alias("spellings"))
    t = per_key.groupBy("column").agg(F.sum("spellings").alias("distinct_values"), F.count("*").alias("distinct_keys"))
    variants = F.col("distinct_values") > F.col("distinct_keys")
    chosen = (F.col("distinct_values") / F.greatest(rows, F.lit(1)) < 0.85) | (F.col("distinct_values") <= 250) | variants
    return t.select("column", "distinct_values", "distinct_keys", variants.alias("has_case_variants"), chosen.alias("is_categorical"))


def _upper_after_first(c: Column) -> Column:
    return F.substr(c, F.lit(2)).rlike(r"\p{Lu}")


def _is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def _is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def best_spelling(counts: DataFrame) -> DataFrame:
    """WN-02: the winner of a key: most frequent, then upper case after the
    first character, then an upper-case start, then by character order. A
    min over a struct, so it combines before the shuffle."""
    s = F.col("spelling")
    rank = F.struct(
        (-F.col("n")).alias("n"), F.when(_upper_after_first(s), 0).otherwise(1).alias("inner"),
        F.when(s.rlike(r"^\p{Lu}"), 0).otherwise(1).alias("first"), s.alias("spelling"),
    )
    titled = s.rlike(r"^\p{Lu}") & ~_upper_after_first(s) | (s == title_case(F.col("key")))
    return counts.groupBy("column", "key").agg(
        F.min(rank)["spelling"].alias("winner"),
        F.min(F.when(titled, F.struct((-F.col("n")).alias("n"), s.alias("spelling"))))["spelling"].alias("best_title"),
        F.max(s == F.upper(F.col("key"))).alias("has_upper_form"), F.sum("n").alias("n"),
    )


def canonical_map(counts: DataFrame) -> DataFrame:
    """CL-06: (column, key, canonical, n).

    The winner stays if it is a short all-caps token or has inner capitals. An
    all-lower winner becomes upper case for known acronyms and for keys of at
    most 3 letters whose upper form occurs, else the most frequent title-case
    spelling, else Title Case."""
    w, key = F.col("winner"), F.col("key")
    acronym = F.upper(w).isin(*ACRONYMS) | ((F.length(w) <= 3) & w.rlike(r"^[\p{L}\p{N}]+$") & F.col("has_upper_form"))
    canonical = (
        F.when(_is_upper(w) & (F.length(w) <= 4), w)
        .when(_upper_after_first(w), w)
        .when(_is_lower(w), F.when(acronym, F.upper(w)).otherwise(F.coalesce("best_title", title_case(w))))
        .otherwise(w)
    )
    return best_spelling(counts).select("column", "key", canonical.alias("canonical"), "n")


def changed_spellings(counts: DataFrame) -> DataFrame:
    """(column, spelling, canonical) only for spellings that change."""
    m = canonical_map(counts).select("column", "key", "canonical")
    return counts.join(m, ["column", "key"]).filter("spelling <> canonical").select("column", "spelling", "canonical")


def apply_map(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """JN-01: left equi-join of a label map; labels not in it stay as they are
    (with spaces collapsed). The map is broadcast only behind a row check."""
    m = mapping.filter(F.col("column") == column).select(F.col("spelling").alias("_spelling"), F.col("canonical").alias("_canonical"))
    m = bounded_broadcast(m, MAP_ROWS)
    c = collapse_spaces(col(column))
    out = df.withColumn("_spelling", c).join(m, "_spelling", "left")
    return out.select([F.coalesce("_canonical", "_spelling").alias(column) if x == column else col(x) for x in df.columns])


def small_map(changed: DataFrame) -> list | None:
    """The rows of a label map if it is proven small, else None."""
    rows = changed.limit(MAP_ROWS + 1).collect()
    return rows if len(rows) <= MAP_ROWS else None


def canonical_case(df: DataFrame, cols: Sequence[str] | None = None, changed: DataFrame | None = None, rows: list | None = None) -> DataFrame:
    """CL-06 on every given text column. ``rows`` are those of ``changed`` if the
    caller has them already."""
    cols = list(string_columns(df) if cols is None else cols)
    if not cols:
        return df
    if changed is None:
        changed = changed_spellings(spelling_counts(df, cols))
    rows = small_map(changed) if rows is None else rows
    if rows is None:
        for c in cols:
            df = apply_map(df, changed, c)
        return df
    out = df
    for c in cols:
        mine = [(r["spelling"], r["canonical"]) for r in rows if r["column"] == c]
        spelled = collapse_spaces(col(c))
        if not mine:
            out = out.withColumn(c, spelled)
            continue
        small = F.broadcast(df.sparkSession.createDataFrame(mine, "_spelling string, _canonical string"))
        out = out.withColumn("_spelling", spelled).join(small, "_spelling", "left").withColumn(c, F.coalesce("_canonical", "_spelling")).drop("_spelling", "_canonical")
    return out.select([col(c) for c in df.columns])
