"""Shares of the job total, findings over a threshold, and missing tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w
from stacktally.functions import columns as c
from stacktally.operators import lifecycle


def covered_stages(jobs: DataFrame, stages: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per stage and metric that the report of a finished job covers.

    Walks the job's own stage list, so a stage listed by two jobs appears under
    both; stages never submitted contribute nothing; a job whose total is unknown
    in a metric is left out in that metric. Everything that is known per job or
    stage is joined here, before any task: a large job's tasks never meet on one key.
    """
    finished = jobs.filter(F.col("end_ts").isNotNull())
    listed = lifecycle.job_stages(finished).join(totals, ["app_id", "job_id"])
    return listed.join(lifecycle.latest_attempt(stages), ["app_id", "stage_id"]).select(
        "app_id", "stage_id", "attempt", "job_id", "metric", "job_total"
    )


def expected_tasks(covered: w.Table, tasks: DataFrame) -> DataFrame:
    """One row per task and metric that the reports cover.

    Tasks of earlier attempts of a stage are dropped.
    """
    rows = tasks.select(
        "app_id", "stage_id", "attempt", "task_id", F.col("end_ts").isNotNull().alias("ended")
    )
    on = ["app_id", "stage_id", "attempt"]
    if covered.n_bytes > w.BROADCAST_LIMIT_BYTES:
        rows = w.publish(rows, "tasks")  # read twice: to count the tasks of a stage, and to join
    return w.join_lookup(rows, covered, on, spread_by=["task_id"]).drop("attempt")


def task_rows(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("unit") == m.TASK).select(
        "app_id", F.col("id").alias("task_id"), "metric", "udf", "is_total", "value"
    )


def usage_share(expected: DataFrame, usage: DataFrame) -> DataFrame:
    """Each task's usage as a percentage of its job's total. Only ended tasks have usage."""
    return (
        expected.filter("ended")
        .drop("ended")
        .join(task_rows(usage), ["app_id", "task_id", "metric"])
        .withColumn("pct", c.percent(F.col("value"), F.col("job_total")))
    )


def over_threshold(shares: DataFrame, cpu: float, mem: float) -> DataFrame:
    """Functions, not totals, at or over their metric's threshold."""
    limit = c.threshold_of(F.col("metric"), cpu, mem)
    return shares.filter(~F.col("is_total") & (F.col("pct") >= limit)).drop("is_total")


def with_impl(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    functions = w.measure(w.publish(resolved.select("app_id", "udf", "impl"), "functions"))
    return w.join_lookup(findings, functions, ["app_id", "udf"], spread_by=["task_id"], how="left")


def finding_rows(findings: DataFrame) -> DataFrame:
    return findings.withColumn("message", c.finding_message()).select(
        "app_id", "job_id", "stage_id", "task_id", "metric", "udf", "impl",
        "value", "job_total", "pct", "message",
    )


def missing_profiles(expected: DataFrame, usage: DataFrame) -> DataFrame:
    """Expected tasks without any usage row, not even a total, in the metric."""
    present = task_rows(usage).select(
        "app_id", "task_id", "metric", F.lit(True).alias("ended")
    )
    return (
        expected.join(present, ["app_id", "task_id", "metric", "ended"], "left_anti")
        .select("app_id", "job_id", "stage_id", "task_id", "metric")
        .withColumn("message", c.missing_message())
    )


def findings(
    expected: DataFrame, usage: DataFrame, resolved: DataFrame, cpu: float, mem: float
) -> DataFrame:
    shares = over_threshold(usage_share(expected, usage), cpu, mem)
    return finding_rows(with_impl(shares, resolved))


