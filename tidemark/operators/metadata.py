"""MD-*: jobs, schedules and feedback as plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import any_of


def feedback_counts(fb: DataFrame) -> DataFrame:
    """MD-01: helpful, not relevant and all ratings per insight."""
    return fb.groupBy("job_id", "insight_id").agg(
        F.count("*").alias("total_feedbacks"), F.count_if(F.col("rating") == "helpful").alias("helpful_count"),
        F.count_if(F.col("rating") == "not_relevant").alias("not_relevant_count"),
    )


def due_schedules(schedules: DataFrame, as_of: str) -> DataFrame:
    """MD-02: active schedules whose next run is due at ``as_of`` or unset."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return schedules.filter(F.col("is_active") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))


def next_run(frequency: Column, base: Column) -> Column:
    """MD-03: one hour, seven days, or by default one day later."""
    f = F.lower(frequency)
    return F.when(f == "hourly", base + F.expr("INTERVAL 1 HOUR")).when(f == "weekly", base + F.expr("INTERVAL 7 DAY")).otherwise(base + F.expr("INTERVAL 1 DAY"))


def tenant_rows(df: DataFrame, user: object) -> DataFrame:
    """MD-04: rows of a user and rows nobody owns."""
    return df.filter((F.col("user_id") == F.lit(user)) | F.col("user_id").isNull())


def recency_buckets(jobs: DataFrame, as_of: str, k: int = 8) -> DataFrame:
    """MD-05: the ``k`` newest jobs of Today, Yesterday and Older. Each bucket is
    cut per task before the shuffle, however many jobs are Older."""
    day, today = F.to_date("created_at"), F.to_date(F.lit(as_of))
    bucket = F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").otherwise("Older")
    w = Window.partitionBy("time_group").orderBy(F.desc("created_at"), "job_id")
    return jobs.withColumn("time_group", bucket).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_rows(df: DataFrame, cols: Sequence[str], q: str) -> DataFrame:
    """MD-06: rows in which any field contains the text, ignoring case."""
    needle = q.strip().lower()
    if not needle:
        return df
    return df.filter(any_of([F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in cols]))
