"""AN-08..14: compare a metric or a rate across the labels of a segment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset, as_double, is_numeric
from tidemark.functions.quantiles import quantile_columns
from tidemark.functions.tails import chi2_pvalue, f_pvalue
from tidemark.operators.cleaning import col
from tidemark.operators.common import NULL_TOKENS, ToolResult, currency_to_double
from tidemark.session import pin

# Labels taken as the positive class, in order of preference.
POSITIVE_LABELS = ("yes", "true", "1", "left", "churn")
# Name beginnings or ends that mark an identifier column.
ID_AFFIXES = ("_id", "id", "uuid", "guid", "key", "code", "hash", "num", "number")


def _label(name: str) -> Column:
    """A trimmed label; blank and null tokens count as missing."""
    c = F.trim(col(name).cast("string"))
    return F.when(~F.lower(c).isin(*NULL_TOKENS), c)


def metric_kinds(ds: Dataset, metrics: Sequence[str]) -> tuple[int, dict[str, tuple[str, Column]]]:
    """The rows of the table, and per metric column ``("numeric", value)`` or
    ``("rate", label)``, all from one aggregate: text is numeric when at least half of
    all rows parse; a 0/1 number is a rate."""
    ds = as_dataset(ds)
    numbers = [c for c in metrics if is_numeric(ds.df, c)]
    texts = [c for c in metrics if c not in numbers and ds.df.schema[c].dataType.simpleString() == "string"]
    row = ds.df.agg(
        F.count("*").alias("n"), *[F.count(currency_to_double(c)).alias(f"k{i}") for i, c in enumerate(texts)],
        *[x for i, c in enumerate(numbers) for x in (F.min(as_double(c)).alias(f"lo{i}"), F.count_if(~as_double(c).isin(0.0, 1.0)).alias(f"other{i}"))],
    ).first()
    out = {c: ("rate", _label(c)) for c in metrics}
    for i, c in enumerate(numbers):
        if row[f"lo{i}"] is None or row[f"other{i}"] != 0:
            out[c] = "numeric", as_double(c)
    for i, c in enumerate(texts):
        if row["n"] and row[f"k{i}"] / row["n"] >= 0.5:
            out[c] = "numeric", currency_to_double(c)
    return row["n"], out


@dataclass
class SegmentFacts:
    """What comparisons of several label and metric pairs need, each counted in one pass
    over the table for all of them: ``groups`` and ``medians`` per (segment_column,
    segment, metric_column), ``cells`` (segment_column, metric_column, segment, target, n)."""

    rows: int
    kinds: dict[str, tuple[str, Column]]
    groups: DataFrame | None
    medians: DataFrame | None
    cells: DataFrame | None

    def of(self, table: DataFrame, segment: str, metric: str) -> DataFrame:
        return table.filter((F.col("segment_column") == segment) & (F.col("metric_column") == metric)).drop("segment_column", "metric_column")


def segment_facts(ds: Dataset | DataFrame, pairs: Sequence[tuple[str, str]]) -> SegmentFacts:
    """One aggregate by GROUPING SETS for all numeric pairs, one call for their medians,
    and one more aggregate for all pairs that are rates."""
    ds = as_dataset(ds)
    rows, kinds = metric_kinds(ds, sorted({m for _, m in pairs}))
    seen = lambda c, v: F.when(~ds.mask(c), v)  # noqa: E731  imputed cells do not count
    groups = medians = cells = None
    numeric = [(s, m) for s, m in dict.fromkeys(pairs) if kinds[m][0] == "numeric"]
    wanted = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in numeric])
    if numeric:
        segs, mets = sorted({s for s, _ in numeric}), sorted({m for _, m in numeric})
        base = ds.df.select(*[seen(c, _label(c)).alias(f"s{i}") for i, c in enumerate(segs)], *[seen(c, kinds[c][1]).alias(f"v{j}") for j, c in enumerate(mets)])
        names = [f"s{i}" for i in range(len(segs))]
        wide = base.groupingSets([[F.col(n)] for n in names], *names).agg(F.grouping_id().alias("gid"), *[
            f(f"v{j}").alias(f"{x}_{j}") for j in range(len(mets))
            for x, f in (("n", F.count), ("s", F.sum), ("m", F.avg), ("v", F.var_samp), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))
        ])
        # all bits of the grouping id are set but the one of the label in turn
        own = lambda i: (1 << len(segs)) - 1 - (1 << (len(segs) - 1 - i))
        which = F.coalesce(*[F.when(F.col("gid") == own(i), F.lit(c)) for i, c in enumerate(segs)])
        cell = lambda j, c: F.struct(F.lit(c).alias("metric_column"), *[F.col(f"{x}_{j}").alias(x) for x in ("n", "s", "m", "v", "sd", "lo", "hi")])
        long = wide.select(which.alias("segment_column"), F.coalesce(*names).alias("segment"), F.explode(F.array(*[cell(j, c) for j, c in enumerate(mets)])).alias("g"))
        pair = F.struct(F.col("segment_column").alias("s"), F.col("metric_column").alias("m"))
        groups = pin(long.select("segment_column", "segment", "g.*").filter((F.col("n") > 0) & F.col("segment").isNotNull() & F.array_contains(wanted, pair)), "segment-groups")
        labelled = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("segment_column"), F.col(f"s{i}").alias("segment")) for i, c in enumerate(segs)])).alias("l"), *[F.col(f"v{j}").alias(c) for j, c in enumerate(mets)])
        labelled = labelled.filter("l.segment is not null").select(F.col("l.segment_column").alias("_column"), F.col("l.segment").alias("_segment"), *map(col, mets))
        found = quantile_columns(labelled, mets, {"median": 0.5}, by=["_column", "_segment"])
        medians = pin(found.select(F.col("_column").alias("segment_column"), F.col("_segment").alias("segment"), F.col("column").alias("metric_column"), "median"), "segment-medians")
    rates = [(s, m) for s, m in dict.fromkeys(pairs) if kinds[m][0] == "rate"]
    if rates:
        both = F.explode(F.array(*[
            F.struct(F.lit(s).alias("segment_column"), F.lit(m).alias("metric_column"), seen(s, _label(s)).alias("segment"), seen(m, kinds[m][1]).alias("target")) for s, m in rates
        ]))
        seen_cells = ds.df.select(both.alias("c")).select("c.*").filter("segment is not null and target is not null")
        cells = pin(seen_cells.groupBy("segment_column", "metric_column", "segment", "target").agg(F.count("*").alias("n")), "segment-cells")
    return SegmentFacts(rows, kinds, groups, medians, cells)


def _working(ds: Dataset, segment: str, metric: str, value: Column, name: str) -> DataFrame:
    """(segment, value) of rows in which both cells were observed."""
    return ds.df.filter(~ds.mask(segment) & ~ds.mask(metric)).select(
        _label(segment).alias("segment"), value.alias(name)
    ).filter(F.col("segment").isNotNull() & F.col(name).isNotNull())


def segment_groups(ds: Dataset | DataFrame, segment: str, metric: str) -> DataFrame:
    """Per segment the unrounded count, sum, mean, variance, minimum and maximum
    of the observed rows: one shuffle, from which AN-08..11 all follow."""
    ds = as_dataset(ds)
    return _segment_rows(ds, segment, metric).groupBy("segment").agg(
        F.count("metric").alias("n"), F.sum("metric").alias("s"), F.avg("metric").alias("m"), F.var_samp("metric").alias("v"),
        F.stddev_samp("metric").alias("sd"), F.min("metric").alias("lo"), F.max("metric").alias("hi"),
    )


def _segment_rows(ds: Dataset, segment: str, metric: str) -> DataFrame:
    value = as_double(metric) if is_numeric(ds.df, metric) else currency_to_double(metric)
    return _working(ds, segment, metric, value, "metric")


def segment_stats(ds: Dataset | DataFrame, segment: str, metric: str, groups: DataFrame | None = None, medians: DataFrame | None = None) -> DataFrame:
    """AN-08: per segment count, sum, mean, median, std, min, max, share of the
    total and ratio to the overall mean. Totals are a second, tiny aggregate
    over the per-segment rows (the shuffle is shared); medians are exact."""
    ds = as_dataset(ds)
    g = segment_groups(ds, segment, metric) if groups is None else groups
    total = g.agg(F.sum("s").alias("total")).scalar()
    overall = g.agg((F.sum("s") / F.sum("n")).alias("overall")).scalar()
    if medians is None:
        medians = quantile_columns(_segment_rows(ds, segment, metric), ["metric"], {"median": 0.5}, by=["segment"]).select("segment", "median")
    return g.join(medians, "segment").select(
        "segment", F.col("n").alias("count"), F.round("s", 2).alias("sum"), F.round("m", 2).alias("mean"),
        F.round("median", 2).alias("median"),
        F.when(F.col("n") > 1, F.round("sd", 2)).otherwise(F.lit(0.0)).alias("std"),
        F.round("lo", 2).alias("min"), F.round("hi", 2).alias("max"),
        F.when(total != 0, F.round(F.col("s") / total * 100, 2)).otherwise(F.lit(0.0)).alias("share_of_total_percent"),
        F.when(overall != 0, F.round(F.round("m", 2) / overall, 2)).otherwise(F.lit(1.0)).alias("relative_to_overall_mean"),
    )


def rank_segments(stats: DataFrame, by: str = "mean") -> DataFrame:
    """SO-01: segments by mean or rate, highest first, ties by name."""
    return stats.orderBy(F.desc(by), "segment")


def top_bottom(stats: DataFrame, by: str = "mean") -> DataFrame:
    """AN-09: highest and lowest segment, their difference and, when both means
    are positive, their ratio. Ties go to the first and last name."""
    key = F.struct((-F.col(by)).alias("neg"), F.col("segment"))
    t = stats.agg(F.min(key).alias("t"), F.max(key).alias("b"), F.count("*").alias("total_segments"))
    top, bottom = -F.col("t.neg"), -F.col("b.neg")
    return t.select(
        F.col("t.segment").alias("top_segment"), top.alias("top_value"),
        F.col("b.segment").alias("bottom_segment"), bottom.alias("bottom_value"),
        F.round(top - bottom, 2).alias("absolute_difference"),
        F.when(bottom > 0, F.round(top / bottom, 2)).alias("top_vs_bottom_ratio"),
        "total_segments",
    )


def anova(ds: Dataset | DataFrame, segment: str, metric: str, groups: DataFrame | None = None) -> DataFrame:
    """AN-10: one-way analysis of variance from per-group n, mean and variance.

    F is NULL with fewer than 2 groups or a group of one, and with no variance
    inside the groups."""
    g = segment_groups(ds, segment, metric) if groups is None else groups
    grand = g.agg((F.sum("s") / F.sum("n")).alias("grand")).scalar()
    t = g.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n_used"), F.min("n").alias("smallest"),
        F.sum(F.col("n") * F.pow(F.col("m") - grand, 2)).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ss_within"),
    )
    ok = (F.col("groups") >= 2) & (F.col("smallest") >= 2) & (F.col("ss_within") > 0)
    d1, d2 = F.col("groups") - 1, F.col("n_used") - F.col("groups")
    stat = F.when(ok, (F.col("ss_between") / d1) / (F.col("ss_within") / d2))
    return t.select(
        "groups", "n_used", d1.cast("double").alias("df_between"), d2.cast("double").alias("df_within"),
        "ss_between", "ss_within", stat.alias("f_statistic"),
    )


def with_anova_p(stats: DataFrame) -> DataFrame:
    """AN-10: add the p-value and whether it is below .05."""
    out = stats.withColumn("p_value", f_pvalue("f_statistic", "df_between", "df_within"))
    return out.withColumn("is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def cardinality_guard(ds: Dataset | DataFrame, segment: str, metric: str, groups: DataFrame | None = None) -> DataFrame:
    """AN-11: whether a segment column looks like a record identifier."""
    g = segment_groups(ds, segment, metric) if groups is None else groups
    t = g.agg(F.count("*").alias("distinct_segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_used"))
    name = segment.lower()
    id_name = any(name.endswith(a) or name.startswith(a) for a in ID_AFFIXES)
    ratio = F.coalesce(F.try_divide(F.col("distinct_segments"), F.col("n_used")), F.lit(0.0))
    unique = (ratio >= 0.70) & (F.col("distinct_segments") > 15)
    named = F.lit(id_name) & ((ratio >= 0.50) | (F.col("distinct_segments") > 30))
    return t.select(
        F.lit(segment).alias("segment_column"), "distinct_segments", "n_used", F.round(ratio, 4).alias("cardinality_ratio"),
        (unique | named).alias("rejected"),
        F.when(unique, "high cardinality").when(named, "identifier name").otherwise("ok").alias("reason"),
    )


def rate_rows(ds: Dataset | DataFrame, segment: str, target: str) -> DataFrame:
    ds = as_dataset(ds)
    return _working(ds, segment, target, _label(target), "target")


def positive_class(rows: DataFrame) -> DataFrame:
    """AN-12: the preferred positive label, else the smallest label."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in POSITIVE_LABELS]), F.lower("target")), F.lit(0)), F.lit(99))
    return rows.agg(F.min(F.struct(order.alias("o"), F.col("target"))).alias("b")).select(F.col("b.target").alias("target_class"))


def segment_rates(ds: Dataset | DataFrame, segment: str, target: str) -> DataFrame:
    """AN-12: per segment n, positives and rate; the overall rate is the row
    whose segment is NULL, from the same pass by GROUPING SETS."""
    return rates_of(crosstab(ds, segment, target))


def rates_of(counts: DataFrame) -> DataFrame:
    """AN-12 from the counts (segment, target, n)."""
    positive = F.lower(positive_class(counts).scalar())
    both = counts.groupingSets([["segment"], []], "segment").agg(
        F.sum("n").alias("n_used"), F.sum(F.when(F.lower("target") == positive, F.col("n")).otherwise(0)).alias("positive_count"),
    )
    rate = F.col("positive_count") / F.col("n_used")
    return both.select(
        "segment", "n_used", "positive_count", F.round(rate, 4).alias("rate"), F.round(rate * 100, 2).alias("rate_percent")
    )


def crosstab(ds: Dataset | DataFrame, segment: str, target: str) -> DataFrame:
    """AN-14: segment x target counts in long form (no zero cells)."""
    return rate_rows(ds, segment, target).groupBy("segment", "target").agg(F.count("*").alias("n"))


def crosstab_wide(ds: Dataset | DataFrame, segment: str, target: str, labels: list[str]) -> DataFrame:
    """AN-14: one column per target label."""
    return rate_rows(ds, segment, target).groupBy("segment").pivot("target", labels).count().na.fill(0, labels)


def chi_square(cells: DataFrame) -> DataFrame:
    """AN-13: test of independence from contingency cells (segment, target, n).

    Only cells that occur are needed: sum((O-E)^2/E) = N*(sum(O^2/(R*C)) - 1).
    A 2x2 table gets Yates' correction; there every cell has the same |O-E|."""
    r = cells.groupBy("segment").agg(F.sum("n").alias("row_n"))
    c = cells.groupBy("target").agg(F.sum("n").alias("col_n"))
    rs = r.agg(F.count("*").alias("rows"), F.sum("row_n").alias("total"), F.sum(1 / F.col("row_n")).alias("inv_rows"))
    cs = c.agg(F.count("*").alias("cols"), F.sum(1 / F.col("col_n")).alias("inv_cols"))
    rows, total, inv_rows = rs.select("rows").scalar(), rs.select("total").scalar(), rs.select("inv_rows").scalar()
    cols, inv_cols = cs.select("cols").scalar(), cs.select("inv_cols").scalar()
    o, e = F.col("n"), F.col("row_n") * F.col("col_n")
    t = cells.join(r, "segment").join(c, "target").agg(
        F.sum(o / e * o).alias("q"), F.max(F.abs(o - e / total)).alias("gap"), F.sum("n").alias("n_used"),
    )
    df = (rows - 1) * (cols - 1)
    plain = F.col("n_used") * (F.col("q") - 1)
    yates = F.pow(F.greatest(F.col("gap") - 0.5, F.lit(0.0)), 2) * F.col("n_used") * inv_rows * inv_cols
    return t.select(
        rows.alias("rows"), cols.alias("cols"), "n_used", df.cast("double").alias("df"),
        F.when(df == 1, yates).when(df > 1, plain).alias("chi2_statistic"),
    )


def with_chi2_p(stats: DataFrame) -> DataFrame:
    """AN-13: add the p-value and whether it is below .05."""
    out = stats.withColumn("p_value", chi2_pvalue("chi2_statistic", "df"))
    return out.withColumn("is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def segment_compare(ds: Dataset | DataFrame, segment: str, metric: str, allow_high_cardinality: bool = False, facts: SegmentFacts | None = None) -> ToolResult:
    """The segment tool: picks the mean or the rate path, guards against
    identifiers, and returns the segment table with a one-row summary. ``facts`` are
    those of several comparisons, counted together."""
    ds = as_dataset(ds)
    for c in (segment, metric):
        if c not in ds.columns:
            raise ValueError(f"Column '{c}' not found in dataset. Available: {ds.columns}")
    facts = facts or segment_facts(ds, [(segment, metric)])
    kind, total = facts.kinds[metric][0], F.lit(facts.rows)
    params = {"segment": segment, "metric": metric, "kind": kind}
    if kind == "numeric":
        groups = facts.of(facts.groups, segment, metric)
        guard = cardinality_guard(ds, segment, metric, groups).first()
        if guard["n_used"] == 0:
            return ToolResult("segment_compare", "error", "No valid non-null rows remaining after alignment.", params=params)
        if guard["rejected"] and not allow_high_cardinality:
            raise ValueError(
                f"Column '{segment}' looks like a record identifier ({guard['reason']}: "
                f"{guard['distinct_segments']} distinct values in {guard['n_used']} rows)."
            )
        stats = pin(segment_stats(ds, segment, metric, groups, facts.of(facts.medians, segment, metric)), "segments")
        ends, test = top_bottom(stats), with_anova_p(anova(ds, segment, metric, groups))
        tables = {"segments": rank_segments(stats), "test": test}
        stat_name = "f_statistic"
    else:
        cells = facts.of(facts.cells, segment, metric)
        rates = pin(rates_of(cells), "rates")
        stats = rates.filter("segment is not null").withColumn("count", F.col("n_used"))
        ends, test = top_bottom(stats, "rate_percent"), with_chi2_p(chi_square(cells))
        tables = {"segments": rank_segments(stats, "rate"), "overall": rates.filter("segment is null"), "test": test}
        stat_name = "chi2_statistic"
    t = test.first()  # one row
    used = F.lit(t["n_used"]).cast("long")
    summary = ends.select(
        F.lit(segment).alias("segment_column"), F.lit(metric).alias("metric_column"), F.lit(kind).alias("kind"), "*",
        used.alias("n_used"), F.lit(t[stat_name]).cast("double").alias("statistic"), F.lit(t["p_value"]).cast("double").alias("p_value"),
        F.lit(t["is_significant"]).alias("is_significant"), total.alias("total_records"), (total - used).alias("n_excluded"),
    )
    return ToolResult("segment_compare", "success", summary=summary, tables=tables, params=params)
