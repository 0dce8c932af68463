"""From attributed frames to the cost of each function in each task and job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally.functions import columns as c


def inclusive_max(attributed: DataFrame) -> DataFrame:
    """The largest inclusive value of each function within one profile snapshot.

    A maximum, not a sum: nested frames of a function are not counted twice,
    and separate stacks of one function are not added up. The total frame is the
    row without a function. Profiles of other types than CPU and memory are left out.
    """
    metric = c.metric_of(F.col("profile_type"))
    return (
        attributed.withColumn("metric", metric)
        .filter(F.col("metric").isNotNull())
        .groupBy("app_id", "metric", "unit", "id", "ts", "udf")
        .agg(F.max("total").alias("raw"))
        .withColumn("is_total", F.col("udf").isNull())
    )


def latest_usage(maxima: DataFrame) -> DataFrame:
    """The newest snapshot's value for each function; older deliveries are overwritten."""
    return (
        maxima.groupBy("app_id", "metric", "unit", "id", "udf")
        .agg(F.max_by("raw", "ts").alias("raw"), F.max("ts").alias("ts"))
        .withColumn("is_total", F.col("udf").isNull())
    )


def latest_inclusive(attributed: DataFrame) -> DataFrame:
    """``latest_usage`` of ``inclusive_max`` with one shuffle in place of two.

    The greatest (time, value) of a function is the largest value of its newest snapshot.
    """
    return (
        attributed.withColumn("metric", c.metric_of(F.col("profile_type")))
        .filter(F.col("metric").isNotNull())
        .groupBy("app_id", "metric", "unit", "id", "udf")
        .agg(F.max(F.struct("ts", "total")).alias("newest"))
        .select(
            "app_id", "metric", "unit", "id", "udf", F.col("newest.total").alias("raw"),
            F.col("newest.ts").alias("ts"), F.col("udf").isNull().alias("is_total"),
        )
    )


def in_display_units(latest: DataFrame) -> DataFrame:
    """The ``usage`` table: seconds for CPU, MiB for memory."""
    return latest.select(
        "app_id", "unit", "id", "metric", "udf", "is_total",
        c.in_units(F.col("metric"), F.col("raw")).alias("value"), "ts",
    )


def job_total(usage: DataFrame) -> DataFrame:
    """The total frame of each job profile."""
    return usage.filter((F.col("unit") == m.JOB) & F.col("is_total")).select(
        "app_id", F.col("id").alias("job_id"), "metric", F.col("value").alias("job_total")
    )


def jobs_without_total(valid: DataFrame, usage: DataFrame) -> DataFrame:
    """Valid job profiles in which no frame is the total: ``rejected`` rows."""
    jobs = valid.filter(F.col("unit") == m.JOB)
    total = usage.filter((F.col("unit") == m.JOB) & F.col("is_total")).select(
        "app_id", "id", "metric"
    )
    return (
        jobs.withColumn("metric", c.metric_of(F.col("profile_type")))
        .join(total, ["app_id", "id", "metric"], "left_anti")
        .select(*m.PROFILE_KEY, F.lit("no_total").alias("reason"))
    )


def usage_map(usage: DataFrame) -> DataFrame:
    """One row per profile and metric: a map from function to value, and the total.

    The map has one entry per function of the application seen in that profile.
    """
    entry = F.struct("udf", "value")
    return usage.groupBy("app_id", "unit", "id", "metric").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(~F.col("is_total"), entry)))
        ).alias("usage"),
        F.max(F.when(F.col("is_total"), F.col("value"))).alias("total"),
    )
