"""Profiles, registrations and reports as tables and streams of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w


def read_profiles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed profiles, partitioned by ``profile_type`` and ``unit``."""
    return spark.read.schema(m.PROFILE_RAW).format(fmt).load(path)


def stream_profiles(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(m.PROFILE_RAW).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_profiles(profiles: DataFrame, path: str, mode: str = "error") -> None:
    """Lands profiles so that type and unit prune files and ids prune row groups."""
    (
        profiles.sortWithinPartitions("profile_type", "unit", "app_id", "id")
        .write.mode(mode)
        .partitionBy("profile_type", "unit")
        .parquet(path)
    )


def write_sorted_profiles(profiles: DataFrame, path: str) -> None:
    """Adds profiles of one type and unit, both constants, whose rows already stand in the order of their ids."""
    writer = profiles.write.mode("append").option("compression", w.CODEC)
    writer.partitionBy("profile_type", "unit").parquet(path)


def read_registry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(m.REGISTRY).format(fmt).load(path)


def _write_run(rows: DataFrame, path: str, run: str) -> None:
    """Rows of one run, in a folder of their own, then the run's line of the manifest.

    A run that is repeated, whatever it had left behind, replaces its line and so its rows; readers
    see the rows of the last attempt that came to its end.
    """
    attempt = f"a{uuid.uuid4().hex}"  # a letter first, so that it is read back as text
    rows.write.partitionBy("metric").parquet(f"{path}/rows/run={run}/attempt={attempt}")
    line = rows.sparkSession.createDataFrame([(attempt,)], "attempt STRING").coalesce(1)
    line.write.mode("overwrite").parquet(f"{path}/manifest/run={run}")


def write_findings(findings: DataFrame, path: str, run: str) -> None:
    _write_run(findings, path, run)


def write_missing(missing: DataFrame, path: str, run: str) -> None:
    _write_run(missing, path, run)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs written to ``path`` by ``write_findings`` or ``write_missing``, and ``run``."""
    text = {c: F.col(c).cast("string") for c in ("run", "attempt")}
    manifest = spark.read.parquet(f"{path}/manifest").withColumns(text)
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumns(text)
    return rows.join(manifest, ["run", "attempt"]).drop("attempt")
