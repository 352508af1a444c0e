"""IN-01, IN-02, IN-04, EV-03: confidence, impact, caveats, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.95996


def fmt(x: Column, places: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", x.cast("double")))


def signed(x: Column, places: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%+.{places}f", x.cast("double")))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def exclusion_rate(n_excluded: Column, total: Column) -> Column:
    return F.round(n_excluded / F.greatest(F.lit(1), total), 4)


def confidence(n_used: Column, rate: Column) -> Column:
    """IN-01: low above 40 % excluded or below 30 rows, medium above 20 % or
    below 60 rows, else high."""
    return F.when((rate > 0.4) | (n_used < 30), "low").when((rate > 0.2) | (n_used < 60), "medium").otherwise("high")


def impact_score(kind: Column, effect: Column, p: Column, n_used: Column, n_excluded: Column, conf: Column, anomalies: Column | None = None) -> Column:
    """IN-02: .45 effect + .35 significance + .20 coverage for analytical
    findings (x .55 when p > .05), .35 + .65 severity for data quality, at most
    .10 for an outlier finding without outliers; weighted by confidence."""
    total = n_used + n_excluded
    coverage = F.when(total > 0, n_used / total).otherwise(F.lit(1.0))
    severity = F.least(F.lit(1.0), n_excluded / F.greatest(F.lit(1), total) * 1.5)
    base = F.coalesce(F.least(F.lit(1.0), F.abs(effect)), F.lit(0.5))
    weak = F.coalesce(p > 0.05, F.lit(False))
    analytical = base * 0.45 + F.when(weak, F.lit(0.4)).otherwise(F.lit(1.0)) * 0.35 + coverage * 0.20
    raw = F.when(kind == "data_quality", 0.35 + 0.65 * severity).otherwise(F.when(weak, analytical * 0.55).otherwise(analytical))
    if anomalies is not None:
        raw = F.when((kind == "outlier") & (anomalies == 0), F.least(F.lit(0.10), raw)).otherwise(raw)
    weight = F.when(conf == "high", 1.0).when(conf == "medium", 0.75).when(conf == "low", 0.5).otherwise(0.75)
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw * weight)), 4)


def caveats(n_used: Column, rate: Column, p: Column, disclosure: str | None = None) -> Column:
    """IN-04: what limits a finding, as an array of sentences."""
    return F.array_compact(F.array(
        F.when(rate > 0.25, F.concat(F.lit("High exclusion/imputation rate ("), fmt(rate * 100, 1), F.lit("% rows affected)."))),
        F.when(n_used < 30, F.concat(F.lit("Small sample size (n="), n_used.cast("string"), F.lit("); interpret with caution."))),
        F.when(p > 0.05, F.concat(F.lit("Not statistically significant at alpha=0.05 (p="), fmt(p, 4), F.lit(")."))),
        F.lit(f"Derived from a {disclosure}" if disclosure else None).cast("string"),
    ))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """EV-03: Wilson 95 % interval of k out of n, in percent."""
    p = k / n
    denom = 1.0 + Z95 ** 2 / n
    centre = (p + Z95 ** 2 / (2.0 * n)) / denom
    margin = (Z95 / denom) * F.sqrt(p * (1.0 - p) / n + Z95 ** 2 / (4.0 * n * n))
    low = F.greatest(F.lit(0.0), F.round((centre - margin) * 100, 2))
    high = F.least(F.lit(100.0), F.round((centre + margin) * 100, 2))
    return F.when(n > 0, low).otherwise(F.lit(0.0)), F.when(n > 0, high).otherwise(F.lit(0.0))
