"""EV-*: metrics over tables of analysis runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import wilson
from tidemark.operators.windows import bh_adjust

TESTED = ("segment_difference", "correlation", "trend")


def normalized(*cols: str) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws(" ", *cols)), " ", "_")


def match_planted(planted: DataFrame, insights: DataFrame) -> DataFrame:
    """EV-01: planted findings with whether some insight of the run covers them.

    ``planted``: run_id, planted_id, kind (segment_difference, correlation,
    trend, outlier, sentinel, invalid_domain, missingness), name_1, name_2.
    ``insights``: run_id, insight_id, type, title, summary, effect_size,
    significance, direction. Insights are first reduced to the ones each rule can use."""
    body = normalized("title", "summary")
    quality = F.col("type") == "data_quality"
    usable = (
        F.when((F.col("type") == "segment_difference") & F.coalesce(F.col("significance") < 0.05, F.lit(True)), F.array(F.lit("segment_difference")))
        .when((F.col("type") == "correlation") & (F.abs("effect_size") >= 0.40), F.array(F.lit("correlation")))
        .when((F.col("type") == "trend") & F.coalesce(F.col("direction"), F.lit("upward")).isin("upward", "positive", "increasing"), F.array(F.lit("trend")))
        .when(F.col("type").isin("outlier", "outliers"), F.array(F.lit("outlier")))
        .when(quality, F.array_compact(F.array(
            F.when(body.contains("999") | body.contains("sentinel"), F.lit("sentinel")),
            F.when(body.contains("negative") | body.contains("invalid"), F.lit("invalid_domain")),
            F.when(body.contains("missing") | body.contains("imput"), F.lit("missingness")),
        )))
    )
    ready = insights.select("run_id", "insight_id", body.alias("body"), F.explode(usable).alias("kind"))
    low = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), " ", "_")
    # A run plants at most seven findings, so this join stays linear.
    hits = planted.join(ready, ["run_id", "kind"]).filter(F.col("body").contains(low("name_1")) & F.col("body").contains(low("name_2")))
    best = hits.groupBy("run_id", "planted_id").agg(F.min("insight_id").alias("matching_insight_id"))
    return planted.join(best, ["run_id", "planted_id"], "left").withColumn("found", F.col("matching_insight_id").isNotNull())


def recall(matches: DataFrame) -> DataFrame:
    """EV-02, EV-03: recall with its interval, per kind and overall (kind NULL)."""
    g = matches.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("total_planted"), F.count_if("found").alias("found"))
    lo, hi = wilson(F.col("found"), F.col("total_planted"))
    return g.select("kind", "total_planted", "found", F.round(F.col("found") / F.col("total_planted") * 100, 2).alias("recall_percent"), lo.alias("ci_low"), hi.alias("ci_high"))


def false_positives(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """EV-04: tests (run_id, type, p_value) with the adjusted p and whether they
    are false positives on null data: both below ``alpha``."""
    t = bh_adjust(tests.filter(F.col("type").isin(*TESTED)), "p_value", ["run_id"])
    hit = (F.col("p_value") < alpha) & (F.col("p_adj") < alpha)
    return t.withColumn("is_false_positive", F.coalesce(hit, F.lit(False)))


def null_false_positives(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """EV-04: false positives over all null runs, per run and per test."""
    g = false_positives(tests, alpha).groupBy("run_id").agg(F.count("*").alias("tests"), F.count_if("is_false_positive").alias("fp"))
    return g.agg(F.count("*").alias("null_runs"), F.sum("tests").alias("total_tests"), F.sum("fp").alias("false_positives")).select(
        "null_runs", "total_tests", "false_positives",
        F.round(F.col("false_positives") / F.col("null_runs"), 2).alias("fp_per_run"),
        F.round(F.col("false_positives") / F.col("total_tests") * 100, 2).alias("per_test_fp_rate"),
    )


def numeric_accuracy(audit: DataFrame) -> DataFrame:
    """EV-05: shares of audited numbers that check out and that cannot be checked."""
    t = audit.agg(
        F.count("*").alias("total_numbers"), F.count_if(F.col("result").isin("match", "rounding")).alias("verified"),
        F.count_if(F.col("result") == "unverifiable").alias("unverifiable"),
    )
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("total_numbers")) * 100, 2)
    return t.select("*", F.coalesce(share("verified"), F.lit(100.0)).alias("numeric_accuracy"), F.coalesce(share("unverifiable"), F.lit(0.0)).alias("unverifiable_rate"))


def run_efficiency(runs: DataFrame) -> DataFrame:
    """EV-06: means over runs; the follow-up share is over planted runs."""
    planted = ~F.col("is_null")
    return runs.agg(
        F.count("*").alias("runs"), F.round(F.avg(F.when(F.col("wall_time_seconds") > 0, F.col("wall_time_seconds"))), 2).alias("mean_wall_time"),
        F.round(F.avg("tokens"), 0).alias("mean_tokens"), F.round(F.avg("steps"), 2).alias("mean_steps"), F.round(F.avg("rounds"), 2).alias("mean_rounds"),
        F.round(F.avg("tool_calls"), 2).alias("mean_tool_calls"),
        F.round(F.coalesce(F.try_divide(F.count_if(planted & F.col("follow_up")), F.count_if(planted)), F.lit(0.0)) * 100, 2).alias("follow_up_percent"),
    )


def latency_totals(run_log: DataFrame) -> DataFrame:
    """EV-07: per run the time in tools, model and synthesis, and the rest."""
    part = lambda k: F.round(F.sum(F.when(F.col("phase") == k, F.col("seconds")).otherwise(0.0)), 3).alias(f"{k}_seconds")
    return run_log.groupBy("run_id").agg(F.count("*").alias("steps"), part("tool"), part("model"), part("synthesis"), F.round(F.sum("seconds"), 3).alias("total_seconds"))
