"""CL-01..16: projections, filters and row rules of the cleaner."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import as_double, is_numeric, is_string
from tidemark.functions.dates import DATE_FORMATS, DATE_SHAPE, TIMESTAMP_FORMATS, parse_date
from tidemark.operators.common import currency_to_double, long_rows

# Name parts that select a rule.
DATE_NAMES = ("date", "time", "year", "month", "day", "dob", "period")
RETURN_NAMES = ("quantity", "count")
# What ``\\s`` stands for in a pattern.
SPACES = " \t\n\v\f\r"
NON_NEGATIVE_NAMES = ("salary", "price", "spend", "revenue", "amount")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def has_word(name: str, words: Sequence[str], substring: bool = False) -> bool:
    """Whether a ``_``-separated part of ``name`` is one of ``words``. With
    ``substring`` any occurrence counts, so ``count`` also fits ``discount``."""
    low = name.lower()
    if substring:
        return any(w in low for w in words)
    return bool(set(low.replace(" ", "_").split("_")) & set(words))


def string_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_string(df, c)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def guard_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """CL-01: raise when the table is larger than allowed."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"Dataset exceeds maximum supported row count ({max_rows:,} rows). Provided dataset has {n:,} rows.")
    return df


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """CL-02: a repeatable sample of ``n`` rows in the order of a key hash. An
    option; the engine otherwise uses every row."""
    whole = df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = col(key).cast("long") if whole else F.xxhash64(col(key)).bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.pmod(number.cast("decimal(20,0)") + F.lit(seed), F.lit(1 << 31)).cast("long")  # so that the product fits a long
    mixed = F.pmod(low * F.lit(2654435761), F.lit(4294967296))
    return df.orderBy(mixed, col(key)).limit(n)


def sampling_disclosure(n: int, total: int, seed: int = 42) -> dict[str, object]:
    """CL-02: the rate and the sentence that discloses a sample."""
    return {
        "is_sampled": n < total, "sampling_rate": round(n / total, 4) if total else 1.0,
        "sampling_disclosure": f"random sample of {n:,} of {total:,} rows (seed {seed})" if n < total else None,
    }


def trim_headers(df: DataFrame) -> DataFrame:
    """CL-03."""
    return df.toDF(*[c.strip() for c in df.columns])


def stripped(c: Column) -> Column:
    """``c`` without what the pattern ``^\\s+|\\s+$`` finds; the pattern itself runs only
    where its ``$`` stands before a line end that is no white space."""
    ended = c.endswith("\u0085") | c.endswith("\u2028") | c.endswith("\u2029")
    return F.when(ended, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(SPACES)))


def trim_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CL-04: strip leading and trailing white space from text cells."""
    cols = set(string_columns(df) if cols is None else cols)
    return df.select([stripped(col(c)).alias(c) if c in cols else col(c) for c in df.columns])


def collapse_spaces(c: Column) -> Column:
    """CL-05: trim, then turn inner white space into single blanks."""
    inner = reduce(lambda a, b: a | b, [c.contains(x) for x in ("  ", *SPACES[1:])])  # few cells need the pattern
    return F.when(inner, F.regexp_replace(stripped(c), r"\s+", " ")).otherwise(stripped(c))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """CL-08."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """CL-08: rows, distinct rows and the difference, from one grouping."""
    keys = [col(c) for c in df.columns]
    g = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    return g.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
    )


def column_facts(df: DataFrame) -> DataFrame:
    """CL-09, CL-10: per column its null share and whether it is constant (one
    distinct value, NULL counting as a value). One aggregate, no distinct."""
    q = [c.replace("`", "``") for c in df.columns]
    names = [c.replace("\\", "\\\\").replace("'", "\\'") for c in df.columns]
    wide = df.selectExpr("count(*) AS n", *[e for i, c in enumerate(q) for e in (f"count(`{c}`) AS k{i}", f"min(`{c}`) AS a{i}", f"max(`{c}`) AS z{i}")])
    rows = ", ".join(
        f"named_struct('column', '{c}', 'rows', n, 'null_count', n - k{i}, 'null_share', CASE WHEN n > 0 THEN (n - k{i}) / n ELSE 0D END, "
        f"'is_constant', k{i} = 0 OR (k{i} = n AND a{i} = z{i}))" for i, c in enumerate(names)
    )
    return wide.selectExpr(f"inline(array({rows}))")


def columns_to_drop(facts: Sequence, threshold: float = 0.80, constant: bool = True) -> tuple[list[str], list[str]]:
    """CL-09, CL-10: (mostly null, constant) column names; never all columns."""
    nulls: list[str] = []
    for r in facts:
        if r["null_share"] >= threshold and len(facts) > 1:
            nulls.append(r["column"])
    if len(nulls) == len(facts):
        nulls = nulls[1:]
    rest = [r for r in facts if r["column"] not in nulls]
    consts = [r["column"] for r in rest if r["is_constant"]] if constant else []
    return nulls, ([] if len(consts) == len(rest) else consts)


def drop_null_columns(df: DataFrame, threshold: float = 0.80) -> DataFrame:
    """CL-09."""
    return df.drop(*columns_to_drop(column_facts(df).collect(), threshold, False)[0])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """CL-10."""
    return df.drop(*columns_to_drop(column_facts(df).collect(), 2.0)[1])


def coercion_rates(df: DataFrame, formats: Sequence[str] = DATE_FORMATS + TIMESTAMP_FORMATS) -> DataFrame:
    """CL-12, CL-13: per text column the non-null count and the shares that
    parse as numbers, look like dates and parse as dates. One aggregate."""
    cols = string_columns(df)
    wide = df.agg(*[
        x for i, c in enumerate(cols) for x in (
            F.count(col(c)).alias(f"k{i}"), F.count(currency_to_double(c)).alias(f"n{i}"),
            F.count_if(col(c).rlike(DATE_SHAPE)).alias(f"s{i}"), F.count(parse_date(c, formats)).alias(f"d{i}"),
        )
    ])
    share = lambda a, i: F.coalesce(F.try_divide(F.col(f"{a}{i}"), F.col(f"k{i}")), F.lit(0.0))
    return wide.select(long_rows([
        F.struct(
            F.lit(c).alias("column"), F.col(f"k{i}").alias("non_null"), share("n", i).alias("numeric_rate"),
            share("s", i).alias("date_shape_rate"), share("d", i).alias("date_rate"),
        ) for i, c in enumerate(cols)
    ]).alias("s")).select("s.*")


def choose_types(rates: Sequence, min_rate: float = 0.60, dates: bool = True) -> dict[str, str]:
    """CL-12, CL-13: ``numeric`` or ``datetime`` per text column that qualifies."""
    out = {}
    for r in rates:
        if r["non_null"] == 0:
            continue
        if r["numeric_rate"] >= min_rate:
            out[r["column"]] = "numeric"
        elif dates and (any(w in r["column"].lower() for w in DATE_NAMES) or r["date_shape_rate"] > 0.5) and r["date_rate"] >= min_rate:
            out[r["column"]] = "datetime"
    return out


def apply_types(df: DataFrame, types: dict[str, str], formats: Sequence[str] = DATE_FORMATS + TIMESTAMP_FORMATS) -> DataFrame:
    """CL-12, CL-13: one projection; what does not parse becomes NULL."""
    def cast(c: str) -> Column:
        kind = types.get(c)
        if kind == "numeric":
            return currency_to_double(c).alias(c)
        if kind == "datetime":
            return parse_date(c, formats).alias(c)
        return col(c)
    return df.select([cast(c) for c in df.columns])


def coerce_numeric(df: DataFrame, min_rate: float = 0.60) -> DataFrame:
    """CL-12."""
    return apply_types(df, choose_types(coercion_rates(df).collect(), min_rate, dates=False))


def coerce_dates(df: DataFrame, formats: Sequence[str] = DATE_FORMATS + TIMESTAMP_FORMATS, min_rate: float = 0.60) -> DataFrame:
    """CL-13. All ``formats`` are tried in order, so a column that mixes them is
    read in full; pass a single format to accept only that one."""
    types = choose_types(coercion_rates(df, formats).collect(), min_rate)
    return apply_types(df, {c: k for c, k in types.items() if k == "datetime"}, formats)


def domain_rule(name: str, substring: bool = False) -> str | None:
    """CL-14, CL-15: which sign rule a column name selects."""
    if has_word(name, RETURN_NAMES, substring):
        return "returns"
    if has_word(name, NON_NEGATIVE_NAMES, substring):
        return "non_negative_constraint"
    return None


def is_age(name: str) -> bool:
    return "age" in name.lower().split("_")


def domain_findings(df: DataFrame, substring: bool = False) -> DataFrame:
    """CL-14..16: per column and rule how many values break it (rows > 0)."""
    checks = []
    for c in numeric_columns(df):
        rule = domain_rule(c, substring)
        if rule:
            checks.append((c, rule, col(c) < 0))
        if is_age(c):
            bad = (col(c) < 0) | (col(c) > 100)
            if rule == "non_negative_constraint":
                bad = col(c) > 100
            checks.append((c, "age_bounds_0_100", bad))
    schema = "column string, rule string, count bigint"
    if not checks:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[F.count_if(bad).alias(f"x{i}") for i, (_, _, bad) in enumerate(checks)])
    return wide.select(long_rows([
        F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"x{i}").alias("count"))
        for i, (c, rule, _) in enumerate(checks)
    ]).alias("s")).select("s.*").filter(F.col("count") > 0)


def flag_returns(df: DataFrame) -> DataFrame:
    """CL-14: negative quantities are counted and kept."""
    return domain_findings(df).filter("rule = 'returns'")


def null_negatives(df: DataFrame, substring: bool = False) -> DataFrame:
    """CL-15: negative money becomes NULL."""
    hit = [c for c in numeric_columns(df) if domain_rule(c, substring) == "non_negative_constraint"]
    return df.select([F.when(~(col(c) < 0), col(c)).alias(c) if c in hit else col(c) for c in df.columns])


def null_bad_ages(df: DataFrame) -> DataFrame:
    """CL-16: ages outside [0, 100] become NULL."""
    hit = [c for c in numeric_columns(df) if is_age(c)]
    return df.select([F.when(col(c).between(0, 100), col(c)).alias(c) if c in hit else col(c) for c in df.columns])


def doubles(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long table (column, value) of the numeric cells that hold a value."""
    cols = list(numeric_columns(df) if cols is None else cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value double")
    return df.select(long_rows([F.struct(F.lit(c).alias("column"), as_double(c).alias("value")) for c in cols]).alias("s")).select("s.*").filter("value is not null")


