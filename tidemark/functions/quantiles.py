"""Exact quantiles that never hold a group in one task.

``percentile`` keeps a map of all distinct values of a group in one aggregation
buffer. Here a mergeable sketch first brackets each wanted quantile, then one
columnar pass counts the rows below each bracket and one pass collects only the
values inside it (a few n/accuracy per quantile). Where those are still many, they get their
ranks in ranges of the order. The result is exact, with linear interpolation between
neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import as_double
from tidemark.functions.ranges import carry, join_keys, running_sum

BROADCAST_ROWS = 10_000
#: So many values of one quantile's bracket are summed up in one place, more in ranges.
CELL_VALUES = 50_000


def _number(x: float | None) -> str:
    """A double as SQL text, without loss."""
    return "CAST(NULL AS DOUBLE)" if x is None else f"double('{x!r}')"


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is proven to have at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows to the driver. A larger table
    comes back unhinted: the join then shuffles, with AQE splitting hot keys.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Long table (by..., column, p, n, value) of exact quantiles.

    ``by`` keys match null-safely. Columns without values give no row.
    """
    by = list(by)
    knames = [f"_k{i}" for i in range(len(by))]
    base = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(by, knames)], *[as_double(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    margin = 3.0 / accuracy
    points = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    plist = "array(" + ", ".join(_number(x) for x in points) + ")"
    sketch = (base.groupBy(*knames) if by else base).agg(*[
        F.expr(e) for i in range(len(columns))
        for e in (f"count(_v{i}) AS _n{i}", f"percentile_approx(_v{i}, {plist}, {accuracy}) AS _q{i}")
    ])

    def bound(i: int, j: int, low: bool) -> str:
        # Few values, or a quantile at the edge: the bracket stays open.
        p = probs[j]
        open_end = _number(float("-inf") if low else float("inf"))
        if p - margin <= 0 if low else p + margin >= 1:
            return open_end
        return f"CASE WHEN _n{i} <= {accuracy} THEN {open_end} ELSE _q{i}[{j if low else len(probs) + j}] END"

    cells = [(i, j) for i in range(len(columns)) for j in range(len(probs))]
    brackets = sketch.selectExpr(
        *knames, *[f"_n{i}" for i in range(len(columns))],
        *[f"{bound(i, j, True)} AS _lo{i}_{j}" for i, j in cells], *[f"{bound(i, j, False)} AS _hi{i}_{j}" for i, j in cells],
    )
    lo, hi, size = "_lo{}_{}".format, "_hi{}_{}".format, "_n{}".format
    if by:
        rows = brackets.limit(BROADCAST_ROWS + 1).collect()
        if len(rows) <= BROADCAST_ROWS:
            brackets = F.broadcast(df.sparkSession.createDataFrame(rows, brackets.schema))
        else:
            rows = brackets.agg(*[F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))]).collect()
        renamed = brackets.toDF(*[f"_b{c}" if c in knames else c for c in brackets.columns])
        joined = base.join(renamed, F.expr(" AND ".join(f"{k} <=> _b{k}" for k in knames))).drop(*[f"_b{k}" for k in knames])
    else:
        # One small row: as literals the limits need no join.
        row = brackets.first()
        rows, joined = [row], base
        lo, hi = (lambda i, j: _number(row[f"_lo{i}_{j}"])), (lambda i, j: _number(row[f"_hi{i}_{j}"]))
        size = lambda i: f"{row[f'_n{i}']}L"

    below = (joined.groupBy(*knames) if by else joined).agg(*[
        F.expr(f"named_struct('ci', {i}, 'pi', {j}, 'below', count_if(_v{i} < {lo(i, j)}), 'n', max({size(i)})) AS _c{i}_{j}") for i, j in cells
    ])
    below = below.selectExpr(*knames, "inline(array(" + ", ".join(f"_c{i}_{j}" for i, j in cells) + "))").filter("n > 0")
    inside = ", ".join(
        f"named_struct('ci', {i}, 'pi', {j}, 'v', CASE WHEN _v{i} BETWEEN {lo(i, j)} AND {hi(i, j)} THEN _v{i} END)" for i, j in cells
    )
    cell = [*knames, "ci", "pi"]
    hits = joined.selectExpr(*knames, f"inline(filter(array({inside}), s -> s.v IS NOT NULL))").groupBy(*cell, "v").agg(F.count("*").alias("cnt"))
    # a bracket is as wide as its margins and what the sketch may be off at both ends
    largest = max((r[f"_n{i}"] or 0 for r in rows for i in range(len(columns))), default=0)
    most = max(accuracy, (2 * margin + 2 / accuracy) * largest)
    pos = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("pi") + 1) * (F.col("n") - 1)
    below = below.withColumn("pos", pos)
    picked = _picked_here(hits, below, cell) if most <= CELL_VALUES else _picked_in_ranges(hits, below, cell)
    value = F.when(
        F.col("a").isNull() | F.col("z").isNull(),
        F.raise_error(F.lit("a quantile fell outside its bracket: raise `accuracy`")).cast("double"),
    ).otherwise(F.col("a") + (F.col("z") - F.col("a")) * (F.col("pos") - F.floor("pos")))
    names = F.array(*[F.lit(c) for c in columns])
    plist = F.array(*[F.lit(float(p)) for p in probs])
    return picked.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(by)],
        F.element_at(names, F.col("ci") + 1).alias("column"),
        F.element_at(plist, F.col("pi") + 1).alias("p"),
        "n",
        value.alias("value"),
    )


def _picked_here(hits: DataFrame, below: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``below`` with ``a`` and ``z``, the values around ``pos``: each cell's few values
    are sorted and counted off in one row."""
    values = hits.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("v", "cnt"))).alias("xs"))
    start = "named_struct('upto', below, 'a', CAST(NULL AS DOUBLE), 'z', CAST(NULL AS DOUBLE))"
    pick = "CASE WHEN s.upto <= {0}(pos) AND {0}(pos) < s.upto + x.cnt THEN x.v ELSE s.{1} END"
    step = f"named_struct('upto', s.upto + x.cnt, 'a', {pick.format('floor', 'a')}, 'z', {pick.format('ceil', 'z')})"
    out = join_keys(values, below, cell, "right").withColumn("_end", F.expr(f"aggregate(xs, {start}, (s, x) -> {step})"))
    return out.select(*cell, "n", "pos", "_end.a", "_end.z")


def _picked_in_ranges(hits: DataFrame, below: DataFrame, cell: Sequence[str]) -> DataFrame:
    """The same for cells of any size, ranked in ranges of their order."""
    ranked = join_keys(running_sum(hits, cell, ["v"], "cnt"), below, cell, "right").withColumn("upto", F.col("upto") + F.col("below"))
    holds = lambda r: r.between(F.col("upto") - F.col("cnt"), F.col("upto") - 1)
    return ranked.groupBy(*cell, "n", "pos").agg(F.max(F.when(holds(F.floor("pos")), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("pos")), F.col("v"))).alias("z"))


def quantile_columns(df: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Wide form of :func:`exact_quantiles`: one row per (by..., column)."""
    long = exact_quantiles(df, columns, list(probs.values()), by, accuracy)
    return long.groupBy(*by, "column").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()],
    )


def value_histogram(values: DataFrame) -> DataFrame:
    """(column, value, cnt) from a long table (column, value)."""
    return values.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("cnt"))


def cumulative_histogram(hist: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per ``column``: each distinct ``value`` with its count, the number of rows
    below it and the total, from a value histogram. The running sum goes over ranges of
    the values, of which there are the more the more values there are."""
    out = running_sum(hist.select("column", "value", "cnt"), ["column"], ["value"], "cnt", ranges)
    return out.select("column", "value", "cnt", (F.col("upto") - F.col("cnt")).alias("before"), F.col("total").alias("n"))


def values_at_ranks(hist: DataFrame, ranks: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds ``found``, the value at each zero-based ``rank`` of ``ranks`` (column, rank,
    n, ...), from a cumulative histogram: in the order of ranks the last value that
    begins at or before it. Ranks past the end find nothing."""
    extra = [c for c in ranks.columns if c not in ("column", "rank", "n")]
    starts = hist.select("column", F.col("before").alias("rank"), F.lit(0).alias("_side"), F.col("value").alias("_v"))
    asked = ranks.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast("double")})
    both = carry(starts.unionByName(asked, allowMissingColumns=True), ["column"], ["rank", "_side"], "_v", ranges)
    fits = (F.col("rank") >= 0) & (F.col("rank") < F.col("n"))
    return both.filter("_side = 1").select("column", "rank", "n", *extra, F.when(fits, F.col("below")).alias("found"))
