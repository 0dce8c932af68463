"""Landed profiles, logs and registrations derived from an ``events`` table.

An application is a group of 50 users, a job a user, a stage a user's day, a task
a user's hour. Every event is one sample of a function named after its type; the
samples of one function within ten minutes are merged into one stack frame, so a
profile stays small however many events fall into it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w
from stacktally.sources import tables

# The columns below mean the same in Spark SQL and in DuckDB.
BASE_COLUMNS = [
    "event_id",
    "ts",
    "event_type",
    "concat('app-', CAST(CAST(floor(user_id / 50) AS BIGINT) AS STRING)) AS app_id",
    "user_id % 50 AS job_id",
    "user_id % 50 * 100 + day(ts) AS stage_id",
    "user_id % 50 * 10000 + day(ts) * 100 + hour(ts) AS task_id",
    "CAST(hour(ts) AS BIGINT) AS hour_of_day",
    "CAST(floor(minute(ts) / 10) AS BIGINT) AS slot",
    "concat(event_type, '_', CAST(user_id % 20 AS STRING)) AS udf",
    "concat('acme.udf.', event_type, '.F', CAST(user_id % 20 AS STRING)) AS impl",
    "CAST(round(value * 1000) AS BIGINT) * 1000000 AS cpu_ns",
    "CAST(round(value * 100) AS BIGINT) * 10007 AS mem_bytes",
]
NO_JOB_EVENT = "job_id % 10 = 9"  # the log never saw the job start
RUNNING_JOB = "job_id % 25 = 24"  # no end of the job either
SUBMITTED = "stage_id % 13 <> 0"
ATTEMPT = "CASE WHEN stage_id % 11 = 0 AND hour_of_day >= 12 THEN 1 ELSE 0 END"
RUNNING_TASK = "task_id % 23 = 0"
NO_TASK_PROFILE = "id % 17 = 0"
SMALLER_LATER = "id % 29 = 0"  # tasks with an early snapshot that is delivered again later
# How task profiles are spoilt, by task_id % 19.
BAD_JSON, EMPTY, RAGGED, WRONG_TYPE = 3, 5, 7, 9
ZERO_TOTAL_CPU = "job_id % 10 = 3"
NO_TOTAL_MEM = "job_id % 10 = 5"
NO_JOB_MEM = "job_id % 10 = 7"


@dataclass(frozen=True)
class Landing:
    """Tables as an operator of the library would find them."""

    profiles: DataFrame
    log: DataFrame
    registry: DataFrame


def base(events: DataFrame) -> DataFrame:
    return events.selectExpr(*BASE_COLUMNS)


def _body(frames: Column, spoilt: Column, total_name: Column) -> Column:
    """Profile JSON for the frames ``name, value`` of one snapshot, with their ``values`` and ``total``."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    values, total = F.col("values"), F.col("total")
    names = F.concat(
        F.array(total_name, F.lit("java/lang/Thread.run")),
        frames["name"],
    )
    leaves = F.flatten(
        F.transform(values, lambda v, i: F.array(zero, v, v, i.cast("bigint") + F.lit(2)))
    )
    levels = F.array(
        F.array(zero, F.when(spoilt == "zero_total", zero).otherwise(total), zero, zero),
        F.array(zero, total, zero, one),
        F.when(spoilt == "ragged", F.concat(leaves, F.array(zero))).otherwise(leaves),
    )
    text = F.to_json(
        F.struct(
            F.struct(
                F.when(spoilt == "empty", F.array().cast("array<string>"))
                .otherwise(names).alias("names"),
                levels.alias("levels"),
                total.alias("numTicks"),
                F.array_max(values).alias("maxSelf"),
            ).alias("flamebearer"),
            F.lit(1).alias("version"),
        )
    )
    return (
        F.when(spoilt == "bad_json", F.concat(F.lit("nope "), text))
        .when(spoilt == "wrong_type", F.regexp_replace(text, r'"names":\[[^\]]*\]', '"names":"x"'))
        .otherwise(text)
    )


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """A row per unit of ``keys`` with its frames, merged per function and slot before they are collected."""
    merged = rows.groupBy(*keys, "slot", "name").agg(
        F.sum("cpu").alias("cpu"), F.sum("mem").alias("mem"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
    return merged.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("name", "cpu", "mem", "slot"))).alias("frames"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


# A task belongs to one job, stage and hour, all of which are in its number.
TASK_KEY = ["app_id", "job_id", "stage_id", "task_id", "hour_of_day"]


def task_spans(rows: DataFrame) -> DataFrame:
    """A row per task: ``TASK_KEY``, its ``frames``, and the ``first_ts`` and ``last_ts`` of its samples.

    Samples are dealt by task once; neither merging nor collecting its frames moves them again.
    """
    name = F.concat(
        F.replace("impl", F.lit("."), F.lit("/")), F.lit("$"), F.col("slot").cast("string"),
        F.lit(".call"),
    )
    samples = rows.select(
        *TASK_KEY, "slot", name.alias("name"), F.col("cpu_ns").alias("cpu"), F.col("mem_bytes").alias("mem"),
        F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"),
    )
    return _merged(samples.repartition(*TASK_KEY), *TASK_KEY)


def _spans(rows: DataFrame) -> DataFrame:
    return rows if "frames" in rows.columns else task_spans(rows)


def job_spans(spans: DataFrame) -> DataFrame:
    """A row per job with the merged ``frames`` of its tasks, and the ``first_ts`` and ``last_ts`` of its samples."""
    samples = spans.select("app_id", "job_id", "first_ts", "last_ts", F.inline("frames"))
    return _merged(samples, "app_id", "job_id")


def profiles(rows: DataFrame) -> DataFrame:
    """Task and job profiles of both types; tasks may have an early or a later, smaller snapshot too.

    ``rows`` of this and the functions below are samples or their ``task_spans``.
    """
    spans = _spans(rows)
    return reduce(DataFrame.unionByName, profile_parts(spans, job_spans(spans)))


def profile_parts(tasks: DataFrame, jobs: DataFrame) -> list[DataFrame]:
    """``profiles`` of the spans of tasks and jobs, apart for each unit and type, in the order of the spans."""
    return [_profiles(rows, unit, metric) for unit, rows in ((m.TASK, tasks), (m.JOB, jobs)) for metric in (m.CPU, m.MEM)]


def _profiles(spans: DataFrame, unit: str, metric: str) -> DataFrame:
    """The profiles of one unit and type; both are constants, so that no rows are sorted to be written apart."""
    is_task, value = unit == m.TASK, "cpu" if metric == m.CPU else "mem"
    grouped = spans.select("app_id", F.col(f"{unit}_id").alias("id"), "job_id", "frames", "first_ts", "last_ts")
    minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
    landed = F.col("last_ts") + F.make_dt_interval(secs=F.lit(1 if is_task else 2))
    snapshots = [F.struct(landed.alias("ts"), F.col("frames").alias("frames"))]
    if is_task:
        grouped = grouped.filter(f"NOT ({NO_TASK_PROFILE})")
        hour = F.date_trunc("hour", "first_ts").cast("timestamp_ntz")
        early = F.filter("frames", lambda f: f["slot"] < 3)
        has_early = (F.size(early) > 0) & (F.size(early) < F.size("frames"))
        snapshots += [
            F.when(has_early, F.struct((hour + minutes(30)).alias("ts"), early.alias("frames"))),
            F.when(
                has_early & F.expr(SMALLER_LATER),
                F.struct((landed + minutes(70)).alias("ts"), early.alias("frames")),
            ),
        ]
    elif metric == m.MEM:
        grouped = grouped.filter(f"NOT ({NO_JOB_MEM})")
    landings = grouped.select("app_id", "id", "job_id", F.inline(F.array_compact(F.array(*snapshots))))
    # The values pass through generators, so that they are computed once and not for each reference.
    once = lambda df, **more: df.select(*df.columns, F.inline(F.array(F.struct(*[v.alias(n) for n, v in more.items()]))))
    rows = once(landings, values=F.col(f"frames.{value}"))
    rows = once(rows, total=F.aggregate("values", F.lit(0).cast("bigint"), lambda acc, v: acc + v))
    spoilt, root = F.lit("none"), F.lit(m.TOTAL_FRAME)
    if is_task:
        kinds = ((BAD_JSON, "bad_json"), (EMPTY, "empty"), (RAGGED, "ragged"), (WRONG_TYPE, "wrong_type"))
        for rest, kind in kinds:
            spoilt = F.when(F.col("id") % 19 == rest, kind).otherwise(spoilt)
    elif metric == m.CPU:
        spoilt = F.when(F.expr(ZERO_TOTAL_CPU), "zero_total").otherwise(spoilt)
    else:
        root = F.when(F.expr(NO_TOTAL_MEM), "root").otherwise(root)
    return rows.select(
        "app_id",
        F.when(F.substring("app_id", -1, 1).isin("0", "2", "4", "6", "8"), "spark-app")
        .otherwise("etl-app").alias("service_name"),
        "id", "job_id", F.col("ts").cast("timestamp").alias("ts"),
        _body(F.col("frames"), spoilt, root).alias("body"),
        F.lit(m.CPU_PROFILE if metric == m.CPU else m.MEM_PROFILE).alias("profile_type"),
        F.lit(unit).alias("unit"),
    )


def _line(rows: DataFrame, event: str, *fields: Column) -> DataFrame:
    return rows.select(
        "app_id", F.to_json(F.struct(F.lit(event).alias("Event"), *fields)).alias("value")
    )


def _ms(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def job_rows(rows: DataFrame) -> DataFrame:
    """``app_id, job_id, stage_ids, start_ts, end_ts``.

    A job also lists some stages of the job before it, and ends after all it lists.
    """
    own = _spans(rows).groupBy("app_id", "job_id", "stage_id").agg(
        F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts")
    )
    # A borrowed stage carries no start, so that only jobs with rows of their own remain.
    none = F.lit(None).cast("timestamp_ntz")
    listed = own.select(
        "app_id", "stage_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.struct("job_id", "start_ts", "end_ts"),
                    F.when(
                        F.col("stage_id") % 10 == 0,
                        F.struct(
                            (F.col("job_id") + 1).alias("job_id"), none.alias("start_ts"),
                            "end_ts",
                        ),
                    ),
                )
            )
        ),
    )
    return (
        listed.groupBy("app_id", "job_id")
        .agg(
            F.array_sort(F.collect_set("stage_id")).alias("stage_ids"),
            F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        )
        .filter(f"start_ts IS NOT NULL AND NOT ({NO_JOB_EVENT})")
    )


def log_lines(rows: DataFrame) -> DataFrame:
    """Event-log lines of all applications in the fields and units Spark writes."""
    spans = _spans(rows)
    apps = spans.groupBy("app_id").agg(F.min("first_ts").alias("ts"))
    jobs = job_rows(spans)
    attempted = spans.filter(SUBMITTED).withColumn("attempt", F.expr(ATTEMPT).cast("bigint"))
    stages = attempted.groupBy("app_id", "stage_id", "attempt").agg(F.min("first_ts").alias("ts"))
    tasks = attempted.withColumnsRenamed({"first_ts": "start_ts", "last_ts": "end_ts"})
    job_id, stage_id, attempt = (
        F.col("job_id").alias("Job ID"), F.col("stage_id").alias("Stage ID"),
        F.col("attempt").alias("Stage Attempt ID"),
    )
    result = F.when(F.col("job_id") % 4 == 0, "JobFailed").otherwise("JobSucceeded")
    info = lambda finish: F.struct(
        F.col("task_id").alias("Task ID"), _ms("start_ts").alias("Launch Time"),
        finish.cast("bigint").alias("Finish Time"),
    ).alias("Task Info")
    parts = [
        _line(
            apps, "SparkListenerApplicationStart",
            F.concat(F.lit("name of "), "app_id").alias("App Name"),
            F.col("app_id").alias("App ID"), _ms("ts").alias("Timestamp"),
        ),
        _line(
            jobs, "SparkListenerJobStart",
            job_id, _ms("start_ts").alias("Submission Time"), F.col("stage_ids").alias("Stage IDs"),
        ),
        _line(
            jobs.filter(f"NOT ({RUNNING_JOB})"), "SparkListenerJobEnd",
            job_id, _ms("end_ts").alias("Completion Time"),
            F.struct(result.alias("Result")).alias("Job Result"),
        ),
        _line(
            stages, "SparkListenerStageSubmitted",
            F.struct(stage_id, attempt, _ms("ts").alias("Submission Time")).alias("Stage Info"),
        ),
        _line(tasks, "SparkListenerTaskStart", stage_id, attempt, info(F.lit(0))),
        _line(
            tasks.filter(f"NOT ({RUNNING_TASK})"), "SparkListenerTaskEnd",
            stage_id, attempt,
            F.struct(F.lit("Success").alias("Reason")).alias("Task End Reason"),
            info(_ms("end_ts")),
        ),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def registry_rows(rows: DataFrame) -> DataFrame:
    """The functions of each application, registered when they were first used."""
    return rows.groupBy("app_id", "udf", "impl").agg(F.min("event_id").alias("seq")).select(
        "app_id", "seq", "udf", "impl", F.lit("udf").alias("origin")
    )


# Registrations in quantity: every event registers a function, most of them again.
REGISTRATION_COLUMNS = [
    "app_id",
    "event_id AS seq",
    "concat('f', CAST(job_id AS STRING), '_', CAST(slot AS STRING)) AS udf",
    "concat('acme.', event_type, '.V', CAST(event_id % 7 AS STRING)) AS impl",
    "CASE WHEN event_type = 'view' THEN 'udf' WHEN event_type = 'click' AND event_id % 2 = 0 "
    "THEN 'udaf' ELSE 'ddl' END AS origin",
]


def registrations(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(*REGISTRATION_COLUMNS)


def read_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark.read.parquet(f"{sf_dir}/events.parquet"))


# Streams get the data against the order of time, the later half first. A step that arrives far in
# the future ends all waiting.
STREAM_SPLIT = "2024-01-16 00:00:00"
ARRIVALS = ("2030-01-01 00:00:00", "2030-01-01 01:00:00", "2099-01-01 00:00:00")
END_APP = "~end"


def _end_step(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A profile, and a job with an ended task, of an application of their own."""
    one = spark.range(1).select(
        F.lit(END_APP).alias("app_id"), F.lit(0).cast("bigint").alias("id"),
        F.lit(ARRIVALS[-1]).cast("timestamp").alias("ts"),
    )
    profile = one.select(
        "app_id", F.lit("spark-app").alias("service_name"), "id", F.col("id").alias("job_id"), "ts",
        F.lit('{"flamebearer":{"names":["total"],"levels":[[0,1,0,0]]}}').alias("body"),
        F.lit(m.CPU_PROFILE).alias("profile_type"), F.lit(m.TASK).alias("unit"),
    )
    number, time = F.col("id"), _ms("ts")
    job = number.alias("Job ID")
    lines = [
        _line(one, "SparkListenerJobStart", job, time.alias("Submission Time"), F.array(number).alias("Stage IDs")),
        _line(
            one, "SparkListenerTaskEnd", number.alias("Stage ID"), number.alias("Stage Attempt ID"),
            F.struct(number.alias("Task ID"), time.alias("Launch Time"), time.alias("Finish Time")).alias("Task Info"),
        ),
        _line(one, "SparkListenerJobEnd", job, time.alias("Completion Time")),
    ]
    return profile, lines[0].unionByName(lines[1]).unionByName(lines[2])


_TIMES = (
    "`Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT>, `Completion Time` BIGINT, "
    "`Submission Time` BIGINT, `Stage Info` STRUCT<`Submission Time`: BIGINT>, `Timestamp` BIGINT"
)


def stream_steps(spark: SparkSession, landing: Landing) -> list[tuple[DataFrame, DataFrame, Column]]:
    """``(profiles, log lines, when they arrive)`` of each step."""
    fields = (
        "Task Info.Finish Time", "Completion Time", "Submission Time", "Stage Info.Submission Time", "Timestamp",
        "Task Info.Launch Time",
    )
    # The parse sits in a generator, so that it is done once for all fields.
    parsed = F.inline(F.array(F.from_json("value", _TIMES)))
    ms = F.coalesce(*[F.nullif(F.col(field), F.lit(0)) for field in fields])
    lines = landing.log.select(*landing.log.columns, parsed).select(*landing.log.columns, F.timestamp_millis(ms).alias("ts"))
    late = F.col("ts") >= F.lit(STREAM_SPLIT).cast("timestamp")
    steps = [(landing.profiles.filter(half), lines.filter(half).drop("ts")) for half in (late, ~late)]
    steps.append(_end_step(spark))
    return [(*step, F.lit(at).cast("timestamp")) for step, at in zip(steps, ARRIVALS)]


_landed: dict[tuple[str, str], str] = {}


def land(spark: SparkSession, sf_dir: str) -> Landing:
    """Writes the derived tables to the shared folder, once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        path = w.new_path(spark, "landing")
        rows = read_base(spark, sf_dir)
        # Narrow rows are sorted by task and job once, not the bodies derived from them.
        spans = w.publish(task_spans(rows).sortWithinPartitions("app_id", "task_id"), "spans")
        jobs = w.publish(job_spans(spans).sortWithinPartitions("app_id", "job_id"), "job_spans")
        for part in profile_parts(spans, jobs):
            tables.write_sorted_profiles(part, f"{path}/profiles")
        log_lines(spans).write.option("compression", w.CODEC).parquet(f"{path}/log")
        registry_rows(rows).write.parquet(f"{path}/registry")
        _landed[key] = path
    path = _landed[key]
    return Landing(
        profiles=tables.read_profiles(spark, f"{path}/profiles"),
        log=spark.read.schema(m.LOG_LINE).parquet(f"{path}/log"),
        registry=tables.read_registry(spark, f"{path}/registry"),
    )
