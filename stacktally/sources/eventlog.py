"""Lifecycle events from Spark event logs.

All readers work on lines ``app_id, value``. Lines of other events are dropped
by their text before any JSON is parsed. ``land_events`` parses a log once for
several readers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacktally import workspace as w

# Event names and fields as Spark writes them.
APP_START = "SparkListenerApplicationStart"
JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_SUBMITTED = "SparkListenerStageSubmitted"
TASK_START = "SparkListenerTaskStart"
TASK_END = "SparkListenerTaskEnd"

_TYPES = {
    "App Name": "STRING",
    "Timestamp": "BIGINT",
    "Job ID": "BIGINT",
    "Stage IDs": "ARRAY<BIGINT>",
    "Submission Time": "BIGINT",
    "Completion Time": "BIGINT",
    "Job Result": "STRUCT<Result: STRING>",
    "Stage Info": "STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, `Submission Time`: BIGINT>",
    "Stage ID": "BIGINT",
    "Stage Attempt ID": "BIGINT",
    "Task Info": "STRUCT<`Task ID`: BIGINT, `Launch Time`: BIGINT, `Finish Time`: BIGINT>",
    "Task End Reason": "STRUCT<Reason: STRING>",
}
_FIELDS = {
    APP_START: ("App Name", "Timestamp"),
    JOB_START: ("Job ID", "Stage IDs", "Submission Time"),
    JOB_END: ("Job ID", "Completion Time", "Job Result"),
    STAGE_SUBMITTED: ("Stage Info",),
    TASK_START: ("Stage ID", "Stage Attempt ID", "Task Info"),
    TASK_END: ("Stage ID", "Stage Attempt ID", "Task Info", "Task End Reason"),
}
EVENTS = tuple(_FIELDS)


def app_id_of(path: Column) -> Column:
    """The application id in the name of a log file."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, r"^events_\d+_", "")
    name = F.regexp_replace(name, r"\.(inprogress|compact|zstd|lz4|lzf|snappy)", "")
    # A cluster manager may append the number of the application attempt.
    return F.regexp_replace(name, r"^(application_\d+_\d+)_\d+$", "$1")


def _with_app_id(lines: DataFrame, *more: Column) -> DataFrame:
    return lines.select(app_id_of(F.col("_metadata.file_path")).alias("app_id"), "value", *more)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files or rolling log folders below ``path``; zstd files are read as they are."""
    return _with_app_id(spark.read.option("recursiveFileLookup", "true").text(path))


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Finished or rolled log files, each read once; ``arrived`` is when the file was written."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_app_id(reader.text(path), F.col("_metadata.file_modification_time").alias("arrived"))


MILLIS_RANGE = (-62_135_596_800_000, 253_402_300_799_999)


def parse_events(log: DataFrame, *events: str, whole: bool = False) -> DataFrame:
    """One typed row per line of the chosen events; only their fields are parsed.

    A table of such rows is only filtered, so all readers below accept either. Lines that say when
    they ``arrived`` keep that. ``whole`` leaves out lines that are no JSON to their end, of which
    the parser would give the fields so far.
    """
    if "value" not in log.columns:
        return log.filter(F.col("event").isin(*events))
    arrived = ["arrived"] if "arrived" in log.columns else []
    mentioned = reduce(Column.__or__, [F.contains("value", F.lit(e)) for e in events])
    if whole:
        mentioned &= F.get_json_object("value", "$").isNotNull()
    # A time beyond the years 1 to 9999 is no time; one bad number must not stop the run.
    millis = lambda field: F.when(
        F.col(field).between(*MILLIS_RANGE), F.timestamp_millis(F.col(field))
    )
    parsed = {field for event in events for field in _FIELDS[event]}
    schema = ", ".join(["Event STRING"] + [f"`{f}` {_TYPES[f]}" for f in _TYPES if f in parsed])
    absent = {f: F.lit(None).cast(kind) for f, kind in _TYPES.items() if f not in parsed}
    body = F.from_json("value", schema)
    if arrived:
        # On a stream all lines move the clock: a filter would be pushed below its watermark.
        body = F.when(mentioned, body)
    else:
        log = log.filter(mentioned)
    return (
        log.select("app_id", *arrived, F.inline(F.array(body)))
        .filter(F.col("Event").isin(*events))
        .withColumns(absent)
        .select(
            "app_id",
            F.col("Event").alias("event"),
            F.col("App Name").alias("app_name"),
            F.col("Job ID").alias("job_id"),
            F.col("Stage IDs").alias("stage_ids"),
            F.coalesce("Stage ID", "Stage Info.Stage ID").alias("stage_id"),
            F.coalesce("Stage Attempt ID", "Stage Info.Stage Attempt ID").alias("attempt"),
            F.col("Task Info.Task ID").alias("task_id"),
            F.coalesce(
                millis("Timestamp"), millis("Submission Time"),
                millis("Stage Info.Submission Time"), millis("Task Info.Launch Time"),
            ).alias("start_ts"),
            F.when(F.col("Event") == JOB_END, millis("Completion Time"))
            .when(F.col("Event") == TASK_END, millis("Task Info.Finish Time")).alias("end_ts"),
            F.coalesce("Job Result.Result", "Task End Reason.Reason").alias("outcome"),
            *arrived,
        )
    )


def land_events(log: DataFrame) -> DataFrame:
    """Parses a log once into a table partitioned by event, for several readers."""
    return w.publish(parse_events(log, *EVENTS), "events", partition_by=["event"])


def app_start(log: DataFrame) -> DataFrame:
    return (
        parse_events(log, APP_START)
        .groupBy("app_id")
        .agg(F.max("app_name").alias("app_name"), F.min("start_ts").alias("start_ts"))
        .withColumn("start_epoch", F.unix_seconds("start_ts"))
    )


def _kept(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(*columns, *(["arrived"] if "arrived" in rows.columns else []))


def job_ends(log: DataFrame) -> DataFrame:
    return _kept(parse_events(log, JOB_END), "app_id", "job_id", "end_ts", F.col("outcome").alias("result"))


def job_starts(log: DataFrame, block_bits: int | None = None) -> DataFrame:
    """One row per started job and stage that it lists.

    With ``block_bits`` one per job and ``block`` of that many (2 to the power of) neighbouring stages,
    with those of them that it lists as ``stage_ids``.
    """
    rows = parse_events(log, JOB_START)
    if block_bits is None:
        return _kept(rows, "app_id", "job_id", "start_ts", F.explode(F.array_distinct("stage_ids")).alias("stage_id"))
    block_of = lambda stage: F.shiftright(stage, block_bits)
    blocks = _kept(
        rows, "app_id", "job_id", "start_ts", "stage_ids",
        F.explode(F.array_distinct(F.transform("stage_ids", block_of))).alias("block"),
    )
    return blocks.withColumn("stage_ids", F.filter("stage_ids", lambda stage: block_of(stage) == F.col("block")))


def job_events(log: DataFrame) -> DataFrame:
    """Starts and ends of jobs, merged by one aggregation over one pass."""
    return (
        parse_events(log, JOB_START, JOB_END)
        .groupBy("app_id", "job_id")
        .agg(
            F.max_by("stage_ids", "start_ts").alias("stage_ids"),
            F.max("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
            F.max("outcome").alias("result"),
        )
    )


def stage_events(log: DataFrame) -> DataFrame:
    return (
        parse_events(log, STAGE_SUBMITTED)
        .groupBy("app_id", "stage_id", "attempt")
        .agg(F.max("start_ts").alias("submit_ts"))
    )


def task_ends(log: DataFrame) -> DataFrame:
    return _kept(
        parse_events(log, TASK_END), "app_id", "task_id", "stage_id", "attempt", "start_ts", "end_ts",
        F.col("outcome").alias("reason"),
    )


def task_events(log: DataFrame) -> DataFrame:
    """Starts and ends of tasks, merged by one aggregation over one pass."""
    return (
        parse_events(log, TASK_START, TASK_END)
        .groupBy("app_id", "task_id")
        .agg(
            *[F.max(c).alias(c) for c in ("stage_id", "attempt", "start_ts", "end_ts")],
            F.max("outcome").alias("reason"),
        )
    )
