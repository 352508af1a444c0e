"""UF-01: the closed list of analysis tools, with uniform error results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.dataset import Dataset
from tidemark.operators.charts import chart_points
from tidemark.operators.common import ToolResult
from tidemark.operators.correlation import correlation, correlation_matrix
from tidemark.operators.outliers import outliers
from tidemark.operators.profiling import profile_columns
from tidemark.operators.segments import segment_compare
from tidemark.operators.sqlview import query_sql
from tidemark.operators.trend import trend
from tidemark.session import pin


@dataclass(frozen=True)
class Param:
    """What a parameter means, its type, and its values if there are only a few."""

    about: str
    kind: type
    allowed: tuple[str, ...] = ()

    def fault(self, name: str, value: object) -> str | None:
        many = self.kind is list
        fits = isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value) if many else _is(value, self.kind)
        if not fits:
            return f"{name} has to be {'a list of names' if many else self.kind.__name__}, not {type(value).__name__}"
        if self.allowed and str(value).lower() not in self.allowed:
            return f"{name} has to be one of {', '.join(self.allowed)}"
        return None


def _is(value: object, kind: type) -> bool:
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, kind) and not (kind is int and isinstance(value, bool))


@dataclass(frozen=True)
class OperatorSpec:
    """A named tool: its parameters and its function."""

    name: str
    params: dict[str, Param]
    call: Callable[..., object]
    required: tuple[str, ...] = ()


def _chart(ds: Dataset, kind: str, **args: object) -> DataFrame:
    """Chart points of the tool that belongs to the kind of chart."""
    tool, table = {"segment": ("segment_compare", "segments"), "correlation": ("run_correlation", "pairs"), "trend": ("trend_analysis", "timeline")}[kind]
    result = run_tool(tool, ds, **args)
    if result.status != "success":
        raise ValueError(result.message or f"{tool}: {result.status}")
    rows = result.tables[table]
    if kind == "segment" and "std" not in rows.columns:
        raise ValueError("a segment chart needs a numeric measure")
    return chart_points(kind, correlation_matrix(rows) if kind == "correlation" else rows)


def _summary(ds: Dataset) -> DataFrame:
    from tidemark.plans.analyze import auto_analyze  # that module runs tools from here

    return auto_analyze(ds).narrative


_COLUMNS, _THRESHOLD = Param("columns to use", list), "threshold"
_SEGMENT, _METRIC = Param("label column", str), Param("measure or target", str)
_DATE, _VALUE, _FREQ = Param("date column", str), Param("measure", str), Param("period of the series", str, ("auto", "m", "w", "d"))

OPERATORS: dict[str, OperatorSpec] = {
    s.name: s for s in (
        OperatorSpec("profile_dataset", {}, lambda ds: profile_columns(ds.clean())),
        OperatorSpec("run_correlation", {"columns": _COLUMNS, _THRESHOLD: Param("smallest strong |r|", float)}, correlation),
        OperatorSpec("detect_outliers", {
            "method": Param("how limits are found", str, ("iqr", "zscore", "z-score", "isolation_forest", "isolationforest")), "columns": _COLUMNS,
            _THRESHOLD: Param("fence width", float), "key": Param("what names a row in the forest's scores", list)}, outliers),
        OperatorSpec("segment_compare", {"segment": _SEGMENT, "metric": _METRIC, "allow_high_cardinality": Param("skip the identifier guard", bool)}, segment_compare, ("segment", "metric")),
        OperatorSpec("trend_analysis", {"date": _DATE, "value": _VALUE, "freq": _FREQ}, trend, ("date", "value")),
        OperatorSpec("query_sql", {"sql": Param("a read-only statement", str), "max_rows": Param("result limit", int)}, query_sql, ("sql",)),
        OperatorSpec("generate_chart", {
            "kind": Param("what to draw", str, ("segment", "correlation", "trend")), "segment": _SEGMENT, "metric": _METRIC, "columns": _COLUMNS,
            "date": _DATE, "value": _VALUE, "freq": _FREQ}, _chart, ("kind",)),
        OperatorSpec("write_summary", {}, _summary),
    )
}


def run_tool(name: str, ds: Dataset, /, *, shared: dict[str, object] | None = None, **args: object) -> ToolResult:
    """Run a listed tool. AN-20: what goes wrong comes back as a result with
    status ``error`` and a message, never as an exception. Results are computed
    before they are reported, so a fault in a lazy plan is reported too. ``shared``
    goes to the tool as it is: what a caller has worked out for several calls."""
    spec = OPERATORS.get(name)
    if spec is None:
        return ToolResult(name, "error", f"Unknown tool '{name}'. Available: {', '.join(OPERATORS)}")
    missing = [p for p in spec.required if p not in args]
    unknown = [a for a in args if a not in spec.params]
    if missing or unknown:
        return ToolResult(name, "error", f"missing: {missing}; unknown: {unknown}", params=dict(args))
    faults = [f for k, v in args.items() if v is not None and (f := spec.params[k].fault(k, v))]
    if faults:
        return ToolResult(name, "error", "; ".join(faults), params=dict(args))
    try:
        out = spec.call(ds, **args, **(shared or {}))
        out = out if isinstance(out, ToolResult) else ToolResult(name, "success", summary=out, params=dict(args))
        if out.summary is not None:
            out.summary = pin(out.summary, name)
    except Exception as e:  # noqa: BLE001  a tool's caller gets every fault as a result
        return ToolResult(name, "error", f"{type(e).__name__}: {e}" if not isinstance(e, ValueError) else str(e), params=dict(args))
    return out


def tool_statuses(results: list[ToolResult], df: DataFrame) -> DataFrame:
    """AN-20: tool, status and message of each result."""
    return df.sparkSession.createDataFrame([(i, r.tool, r.status, r.message) for i, r in enumerate(results)], "position int, tool string, status string, message string")
