"""IN-12..15: the automatic analysis of one table as a batch job."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset, is_numeric
from tidemark.operators import insights as ins
from tidemark.operators.cleaning import col
from tidemark.operators.common import ToolResult
from tidemark.operators.imputation import is_id_name
from tidemark.operators.profiling import profile_columns
from tidemark.operators.segments import ID_AFFIXES, segment_facts
from tidemark.operators.verify import NarrativeCheck, check_narrative
from tidemark.plans.clean import CleaningOptions, clean
from tidemark.registry import run_tool
from tidemark.session import pin


@dataclass
class AnalysisOptions:
    """How far the automatic analysis goes; None is no limit. What a limit leaves
    out is listed in ``Analysis.left_out``."""

    correlated: int | None = None
    segment_labels: int | None = 2
    segment_measures: int | None = 2
    drilldowns: int | None = 3
    groups: int | None = 10
    findings: int = ins.TOP_TOTAL


AT_ONCE = 4
#: Strong pairs that one table of columns can have: 2^31 - 1 is no limit for Spark.
MAX_PAIRS = 2**31 - 1
ALPHA, OUTLIER_SHARE, STRONG_R = 0.05, 5.0, 0.5
# What the tools assume where a step says nothing, so that equal steps run once.
DEFAULTS = {"detect_outliers": {"method": "iqr", "threshold": 3.0}, "run_correlation": {"threshold": 0.4}}


@dataclass
class Step:
    tool: str
    args: dict[str, object]
    reason: str


def measures(profile: Sequence) -> list[str]:
    """Numeric columns that are not identifiers, which are no measures."""
    return [r["column"] for r in profile if r["inferred_type"] == "numeric" and not is_id_name(r["column"])]


def labels(profile: Sequence, low: int = 2, high: int = 20) -> list[str]:
    return [r["column"] for r in profile if r["inferred_type"] in ("categorical", "text") and low <= r["unique_count"] <= high]


def baseline_steps(profile: Sequence, options: AnalysisOptions | None = None) -> list[Step]:
    """IN-12: outliers and correlation of all measures, and labels times measures
    (two times two, unless the options say otherwise)."""
    o = options or AnalysisOptions()
    nums, cats = measures(profile), labels(profile)
    steps = []
    if nums:
        steps.append(Step("detect_outliers", {"method": "iqr", "columns": nums, "threshold": 3.0}, "baseline"))
    if len(nums) >= 2:
        steps.append(Step("run_correlation", {"columns": nums[:o.correlated]}, "baseline"))
    steps += [Step("segment_compare", {"segment": c, "metric": n}, "baseline") for c in cats[:o.segment_labels] for n in nums[:o.segment_measures]]
    return steps


def left_out(profile: Sequence, options: AnalysisOptions) -> list[str]:
    """The steps that the options' limits leave out of the baseline."""
    every = baseline_steps(profile, AnalysisOptions(None, None, None))
    done = baseline_steps(profile, options)
    return [f"{s.tool} {s.args}" for s in every if s.args not in [d.args for d in done]]


def plan(profile: Sequence) -> list[Step]:
    """IN-13: what to run, from profile rows alone: outliers, correlation at .3,
    the label whose number of values is nearest to five, the first date."""
    nums = measures(profile)
    cats = [r for r in profile if r["inferred_type"] in ("categorical", "text")]
    dates = [r["column"] for r in profile if r["inferred_type"] == "datetime"]
    steps = []
    if nums:
        steps.append(Step("detect_outliers", {"method": "iqr", "columns": nums}, "statistical anomalies"))
    if len(nums) >= 2:
        steps.append(Step("run_correlation", {"columns": nums, "threshold": 0.3}, "pairwise associations"))

    def fits(r, share: float, named: bool) -> bool:
        low = r["column"].lower()
        is_id = any(low.startswith(a) or low.endswith(a) for a in ID_AFFIXES)
        return not r["is_unique"] and r["unique_count"] >= 2 and r["unique_count"] / max(1, r["rows"]) < share and not (named and is_id)

    chosen = [r for r in cats if fits(r, 0.50, True)] or [r for r in cats if fits(r, 0.60, False)]
    if chosen and nums:
        best = min(chosen, key=lambda r: abs(r["unique_count"] - 5))
        steps.append(Step("segment_compare", {"segment": best["column"], "metric": nums[0]}, "difference across a key segment"))
    if dates and nums:
        steps.append(Step("trend_analysis", {"date": dates[0], "value": nums[0]}, "trajectory over time"))
    return steps


def run_steps(ds: Dataset, steps: Sequence[Step]) -> list[ToolResult]:
    """Run each distinct step once. All segment comparisons share their counts and
    medians. Steps do not depend on each other, so a few run at a time: their small jobs
    would otherwise leave most cores idle."""
    todo: dict[tuple, Step] = {}
    for s in steps:
        todo.setdefault((s.tool, tuple(sorted((k, str(v)) for k, v in {**DEFAULTS.get(s.tool, {}), **s.args}.items()))), s)

    pairs = [(str(s.args["segment"]), str(s.args["metric"])) for s in todo.values() if s.tool == "segment_compare" and {s.args["segment"], s.args["metric"]} <= set(ds.columns)]

    def one(s: Step) -> ToolResult:
        shared = {"facts": facts.result()} if s.tool == "segment_compare" and facts else None
        r = run_tool(s.tool, ds, shared=shared, **s.args)
        # Results are small and read several times from here on.
        r.tables = {k: t if k == "samples" else pin(t) for k, t in r.tables.items()}
        return r

    with ThreadPoolExecutor(AT_ONCE) as pool:
        # all comparisons count in the same passes over the table
        facts = pool.submit(segment_facts, ds, pairs) if pairs else None
        return list(pool.map(one, todo.values()))


def baseline_scan(ds: Dataset | DataFrame, profile: Sequence | None = None) -> list[ToolResult]:
    """IN-12."""
    ds = as_dataset(ds)
    rows = profile_columns(ds.clean()).collect() if profile is None else profile
    return run_steps(ds, baseline_steps(rows))


def segment_drilldown(ds: Dataset | DataFrame, segment: str, second: str, metric: str, k: int | None = 10) -> DataFrame:
    """IN-14: the ``k`` largest groups of two labels, with the mean of a metric."""
    g = as_dataset(ds).clean().groupBy(col(segment), col(second)).agg(F.count("*").alias("n"), F.round(F.avg(col(metric)), 2).alias(f"avg_{metric}"))
    return _largest(g, [segment, second], k)


def _largest(groups: DataFrame, names: Sequence[str], k: int | None) -> DataFrame:
    out = groups.orderBy(F.desc("n"), *map(col, names))
    return out if k is None else out.limit(k)


def value_frequencies(ds: Dataset | DataFrame, column: str, k: int | None = 10) -> DataFrame:
    """IN-14: the ``k`` most frequent values of a column."""
    return _largest(as_dataset(ds).clean().groupBy(col(column)).agg(F.count("*").alias("n")), [column], k).withColumnRenamed("n", "frequency")


def pair_means(ds: Dataset | DataFrame, segment: str, x: str, y: str, k: int | None = 10) -> DataFrame:
    """IN-14: the means of two measures in the ``k`` largest segments."""
    g = as_dataset(ds).clean().groupBy(col(segment)).agg(F.count("*").alias("n"), F.round(F.avg(col(x)), 2).alias(f"avg_{x}"), F.round(F.avg(col(y)), 2).alias(f"avg_{y}"))
    return _largest(g, [segment], k)


def drilldown_labels(profile: Sequence) -> list[str]:
    named = ("id", "code", "key", "number", "txn", "phone", "email")
    out = []
    for r in profile:
        low = r["column"].lower()
        is_id = any(low == p or low.endswith(f"_{p}") or low.startswith(f"{p}_") for p in named)
        kind, u = r["inferred_type"], r["unique_count"]
        if not is_id and (kind in ("categorical", "text", "boolean") and 2 <= u <= 50 or kind == "numeric" and 2 <= u <= 10):
            out.append(r["column"])
    return out


def drilldowns(ds: Dataset | DataFrame, results: Sequence[ToolResult], profile: Sequence, limit: int | None = 3, k: int | None = 10) -> list[tuple[str, DataFrame]]:
    """IN-14: a significant segment (p < .05) is split by a second label, a column
    with more than 5 % outliers is counted by value, and a pair with |r| > .5 is
    compared across a label. At most ``limit`` distinct follow-ups, each of
    the ``k`` largest groups."""
    ds = as_dataset(ds)
    cats = drilldown_labels(profile)
    out: dict[str, DataFrame] = {}
    for r in results:
        if r.status != "success" or (limit is not None and len(out) >= limit):
            continue
        if r.tool == "segment_compare":
            p = r.summary.select("p_value").first()["p_value"]
            second = next((c for c in cats if c != r.params["segment"]), None)
            if p is not None and p < ALPHA and second and is_numeric(ds.df, str(r.params["metric"])):
                seg, met = str(r.params["segment"]), str(r.params["metric"])
                out.setdefault(f"segment p={p:.4f} < 0.05 for '{met}' across '{seg}' -> drill down by '{second}'", segment_drilldown(ds, seg, second, met, k))
        elif r.tool == "detect_outliers" and "column_outliers" in r.tables:
            for c in r.tables["column_outliers"].filter(F.col("outlier_percentage") > OUTLIER_SHARE).select("column", "outlier_percentage").orderBy("column").collect():
                out.setdefault(f"outlier rate {c['outlier_percentage']:.1f}% > 5% in column '{c['column']}' -> inspect column", value_frequencies(ds, c["column"], k))
        elif r.tool == "run_correlation" and cats:
            for c in r.tables["pairs"].filter(F.col("abs_correlation") > STRONG_R).orderBy(F.desc("abs_correlation")).select("column_x", "column_y", "abs_correlation").limit(limit or MAX_PAIRS).collect():
                out.setdefault(f"|r|={c['abs_correlation']:.2f} > 0.5 between '{c['column_x']}' and '{c['column_y']}' -> check pair by segment '{cats[0]}'", pair_means(ds, cats[0], c["column_x"], c["column_y"], k))
    return list(out.items())[:limit]


def result_insights(ds: Dataset, results: Sequence[ToolResult], run_id: str = "run", disclosure: str | None = None) -> DataFrame:
    """All findings of a run, unranked."""
    run = F.lit(run_id).alias("run_id")
    total = F.lit(ds.df.count())
    parts: list[DataFrame] = []
    segs = [r for r in results if r.status == "success" and r.tool == "segment_compare"]
    if segs:
        tops, groups = [], []
        for i, r in enumerate(segs):
            rate = r.params["kind"] == "rate"
            overall = r.tables["overall"].select("rate_percent").scalar() if rate else F.lit(None).cast("double")
            tops.append(r.summary.select(F.lit(i).alias("run_id"), "segment_column", "metric_column", "kind", "top_segment", "bottom_segment", "absolute_difference",
                                         "top_vs_bottom_ratio", overall.alias("overall_rate_percent"), "p_value", "n_used", "total_records"))
            s = r.tables["segments"]
            groups.append(s.select(F.lit(i).alias("run_id"), "segment", F.col("count").alias("n"), F.col("rate_percent" if rate else "median").alias("shown")))
        union = lambda dfs: reduce(DataFrame.unionByName, dfs)
        parts.append(ins.segment_insights(union(tops), union(groups), disclosure).withColumn("run_id", F.lit(run_id)))
    for r in results:
        if r.status != "success":
            continue
        if r.tool == "run_correlation":
            parts.append(ins.correlation_insights(r.tables["pairs"].withColumn("run_id", F.lit(run_id)), disclosure=disclosure))
        elif r.tool == "trend_analysis":
            parts.append(ins.trend_insights(r.summary.select(run, "*"), disclosure))
        elif r.tool == "detect_outliers" and "column_outliers" in r.tables:
            top = r.tables["column_outliers"].filter("outlier_count > 0").agg(F.max_by("column", "outlier_count").alias("c")).scalar()
            parts.append(ins.outlier_insights(r.summary.select(run, top.alias("top_column"), "anomaly_count", "anomaly_rate_percent", "n_used", "total_records"), disclosure))
    if "findings" in ds.report:
        f = ds.report["findings"].select(run, "column", "kind", "rule", "value", "count", total.alias("total_records"))
        m = ds.report["imputation"].select(run, "column", "imputed_count", "imputation_rate", total.alias("total_records"))
        parts.append(ins.quality_insights(f, m, disclosure))
    return ins.union_insights(parts)


@dataclass
class Analysis:
    """The outcome of :func:`auto_analyze`. ``found`` has every finding, ``insights``
    the ranked ones, ``left_out`` the steps that limits kept from running."""

    dataset: Dataset
    profile: DataFrame
    results: list[ToolResult]
    follow_ups: list[tuple[str, DataFrame]]
    insights: DataFrame
    narrative: DataFrame
    found: DataFrame | None = None
    left_out: list[str] = field(default_factory=list)

    def check(self) -> NarrativeCheck:
        """TX-03..05 on this run: its claims, the rates before and after stripping, and
        the narrative without sentences that no finding bears out."""
        return check_narrative(self.insights, self.narrative)


def auto_analyze(df: DataFrame | Dataset, options: CleaningOptions | None = None, run_id: str = "run", analysis: AnalysisOptions | None = None) -> Analysis:
    """IN-15: clean, profile, baseline scan, plan, drill-downs, ranked findings
    and their narrative. Findings are checked for unfilled templates."""
    ds = df if isinstance(df, Dataset) else clean(df, options)
    disclosure = ds.report.get("sampling_disclosure")
    profile = profile_columns(ds.clean())
    rows = profile.collect()  # one row per column
    o = analysis or AnalysisOptions()
    results = run_steps(ds, baseline_steps(rows, o) + plan(rows))
    follow = drilldowns(ds, results, rows, None, o.groups)
    cut = [] if o.drilldowns is None else [f"follow-up: {reason}" for reason, _ in follow[o.drilldowns:]]
    follow = follow[:o.drilldowns]
    found = pin(result_insights(ds, results, run_id, disclosure), "found")
    ranked = ins.rank_insights(found, n_total=o.findings)
    ranked = ins.placeholder_flags(ranked, "summary").filter(~F.col("has_placeholder")).drop("has_placeholder")
    ranked = pin(ranked, "insights")
    spark = ds.df.sparkSession
    return Analysis(ds, spark.createDataFrame(rows, profile.schema), results, follow, ranked, ins.narrate(ranked, disclosure), found, left_out(rows, o) + cut)
