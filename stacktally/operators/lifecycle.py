"""Jobs, stages and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w


def job_stages(jobs: DataFrame) -> DataFrame:
    """One row per job and listed stage, submitted or not."""
    return jobs.select(
        "app_id", "job_id", "start_ts", "end_ts",
        F.explode(F.array_distinct("stage_ids")).alias("stage_id"),
    )


def stages_of_job(jobs: DataFrame) -> DataFrame:
    """The sorted stage list of each job, within the row."""
    return jobs.select(
        "app_id", "job_id", F.array_sort(F.array_distinct("stage_ids")).alias("stage_ids")
    )


def stage_to_job(listed: DataFrame) -> DataFrame:
    """The job a stage belongs to: the last one started that lists it."""
    return listed.groupBy("app_id", "stage_id").agg(
        F.max_by("job_id", F.struct("start_ts", "job_id")).alias("job_id")
    )


def latest_attempt(stages: DataFrame) -> DataFrame:
    return stages.groupBy("app_id", "stage_id").agg(F.max("attempt").alias("attempt"))


def tasks_of_stage(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks of each submitted stage; a resubmission drops those of earlier attempts.

    One row per task, not a list per stage: a stage may hold most tasks there are.
    """
    latest = w.measure(w.publish(latest_attempt(stages), "attempts"))
    return w.join_lookup(tasks, latest, ["app_id", "stage_id", "attempt"], spread_by=["task_id"])


def task_to_job(tasks: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds ``job_id``, null when no job lists the task's stage."""
    stages = w.measure(w.publish(owners.select("app_id", "stage_id", "job_id"), "owners"))
    return w.join_lookup(tasks, stages, ["app_id", "stage_id"], spread_by=["task_id"], how="left")


def known_tasks(tasks_with_job: DataFrame) -> DataFrame:
    return tasks_with_job.filter(F.col("job_id").isNotNull())


def label_samples(samples: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds the label map of each sample; the job label is null when it is unknown."""
    return task_to_job(samples, owners).withColumn(
        "labels",
        F.create_map(
            *[
                part
                for name in ("job", "stage", "task")
                for part in (F.lit(name), F.col(f"{name}_id").cast("string"))
            ]
        ),
    )


def task_completeness(
    jobs: DataFrame, tasks: DataFrame, owners: DataFrame, usage: DataFrame
) -> DataFrame:
    """Per job, how many tasks ended and how many of them have usage in both metrics.

    Jobs without tasks are complete.
    """
    ended = known_tasks(task_to_job(tasks.filter(F.col("end_ts").isNotNull()), owners))
    seen = (
        usage.filter(F.col("unit") == m.TASK)
        .groupBy("app_id", F.col("id").alias("task_id"))
        .agg(
            F.max(F.col("metric") == m.CPU).alias("cpu"),
            F.max(F.col("metric") == m.MEM).alias("mem"),
        )
    )
    counted = (
        ended.join(seen, ["app_id", "task_id"], "left")
        .groupBy("app_id", "job_id")
        .agg(
            F.count("*").alias("expected"),
            F.count_if(F.coalesce(F.col("cpu") & F.col("mem"), F.lit(False))).alias("received"),
        )
    )
    expected, received = (F.coalesce(c, F.lit(0)) for c in ("expected", "received"))
    return (
        jobs.select("app_id", "job_id")
        .join(counted, ["app_id", "job_id"], "left")
        .select(
            "app_id", "job_id",
            expected.alias("expected"), received.alias("received"),
            (expected == received).alias("complete"),
        )
    )
