"""The report of a job on streams, whatever order logs and profiles arrive in.

Nothing here has a watermark, so nothing is dropped for being late. Log lines and usage are
landed as they arrive, each batch in a folder of its own that a repeated batch overwrites. A
report covers the ended jobs that are complete, or whose wait since the *arrival* of their end
is over. A job is reported again if anything of it arrived later; the newest report holds.

A step reads what landed since the last one and, of the applications that this touches or whose
wait is over, what is kept of them: their events and newest values, merged, in one of a fixed number
of folders that applications are dealt into. Folders without such an application are not read; rows
of others in the same folder are carried over as they are. Merging twice changes nothing, so a step that
failed half-way may run again. What is older than the retention is no longer kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stacktally import model as m
from stacktally import workspace as w
from stacktally.model import Settings
from stacktally.operators import registry as r, report, usage as u
from stacktally.plans import hotspots
from stacktally.sources import eventlog as e

EVENTS = (
    "app_id STRING, event STRING, app_name STRING, job_id BIGINT, stage_ids ARRAY<BIGINT>, "
    "stage_id BIGINT, attempt BIGINT, task_id BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP, "
    "outcome STRING, arrived TIMESTAMP"
)
FINDINGS = (
    "app_id STRING, job_id BIGINT, stage_id BIGINT, task_id BIGINT, metric STRING, udf STRING, "
    "impl STRING, value DOUBLE, job_total DOUBLE, pct DOUBLE, message STRING, step BIGINT"
)
MISSING = (
    "app_id STRING, job_id BIGINT, stage_id BIGINT, task_id BIGINT, metric STRING, "
    "message STRING, step BIGINT"
)
# What a job's report was made of; if this changes, the job is reported again.
BASIS = ["expected", "received", "totals", "digest"]
JOBS = (
    "app_id STRING, job_id BIGINT, expected BIGINT, received BIGINT, totals BIGINT, "
    "digest BIGINT, complete BOOLEAN, step BIGINT"
)
WAITING = "app_id STRING, app_key STRING, due TIMESTAMP, step BIGINT"
MERGED = "events BIGINT, usage BIGINT, step BIGINT"
LOG_FILES = "path STRING, n_bytes BIGINT, step BIGINT"
LANDED_USAGE = m.USAGE + ", arrived TIMESTAMP"
# Columns and the partitions below a table's folder.
_TABLES = {
    "events": (EVENTS, "batch BIGINT"), "usage": (LANDED_USAGE, "batch BIGINT"),
    "kept_events": (EVENTS, "app_key STRING"), "kept_usage": (LANDED_USAGE, "app_key STRING"),
    "findings": (FINDINGS, None), "missing": (MISSING, None), "jobs": (JOBS, "app_key STRING"),
    "waiting": (WAITING, None), "merged": (MERGED, None), "log_files": (LOG_FILES, None),
}
RETENTION = "INTERVAL 30 DAYS"


# A table kept by application has at most so many folders, however many applications there are.
APP_FOLDERS = 256


def app_key(app_id: Column) -> Column:
    """Names the folder of an application."""
    return F.lpad(F.hex(F.pmod(F.xxhash64(app_id), F.lit(APP_FOLDERS))), 2, "0")


class Store(NamedTuple):
    """Landed tables, what is kept of each application, and reports, below one shared folder."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> Store:
        """Empty tables, so that every table can be read from the start."""
        for table, (schema, parts) in _TABLES.items():
            fields = [f for f in schema.split(", ") if f != "step BIGINT"]
            folders = [f"{c}=-1" for c in (["step"] if len(fields) < len(schema.split(", ")) else [])]
            folders += [f"{parts.split()[0]}=-1"] if parts else []
            empty = self.spark.createDataFrame([], ", ".join(fields))
            empty.write.mode("overwrite").parquet("/".join([self.path(table), *folders]))
        return self

    def read(self, table: str) -> DataFrame:
        schema, parts = _TABLES[table]
        return self.spark.read.schema(f"{schema}, {parts}" if parts else schema).parquet(self.path(table))

    def write(self, rows: DataFrame, table: str, step: int) -> None:
        rows, parts = rows.drop("step"), _TABLES[table][1]
        if parts:
            rows = rows.hint("rebalance", parts.split()[0])
        writer = rows.write.mode("overwrite")
        if parts:
            writer = writer.partitionBy(parts.split()[0])
        writer.parquet(f"{self.path(table)}/step={step}")

    def keep(self, rows: DataFrame, table: str) -> None:
        """Replaces the folders of the applications in ``rows``; the others stay as they are.

        Each folder is written by few tasks, more only for what is too much for one.
        """
        writer = rows.hint("rebalance", "app_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("app_key").parquet(self.path(table))

    def of(self, table: str, keys: list[str]) -> DataFrame:
        """Rows of some applications; only their folders are read."""
        return self.read(table).filter(F.col("app_key").isin(keys))


def event_writer(lines: DataFrame, store: Store, arrived: Column | None = None) -> DataStreamWriter:
    """Parses each micro-batch of log lines once; all six kinds of events are kept.

    Events ``arrived`` when they are written, unless told otherwise.
    """
    arrived = F.current_timestamp() if arrived is None else arrived

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = e.parse_events(batch, *e.EVENTS).withColumn("arrived", arrived)
        rows.write.mode("overwrite").parquet(f"{store.path('events')}/batch={batch_id}")

    return lines.writeStream.foreachBatch(handle)


def land_log(store: Store, path: str, batch: int, app_id: Column | None = None, arrived: Column | None = None) -> int:
    """Lands the text logs below ``path`` that are new or have grown, as batch ``batch``; returns how many.

    A log may be written on, rolled into further files, or rewritten into a compacted one while this
    goes on. A file is read again whenever its size is another than at the batches before, which Spark
    bounds by rolling; lines that were landed before are merged by the reader (``merged_events``), as
    an application writes no line twice. A last line that is only half written is no JSON and is not
    landed; it will be when the file has grown. ``app_id`` is an expression on the file's path, by
    default that of Spark's names.
    """
    spark = store.spark
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("n_bytes")
    ).filter("n_bytes > 0")
    known = store.read("log_files").filter(F.col("step") < batch).select("path", "n_bytes")
    changed = w.publish(files.join(known, ["path", "n_bytes"], "left_anti"), "log_files")
    # Spark lists a folder's files on the driver, and these are some of them.
    paths = [row[0] for row in changed.select("path").collect()]
    if paths:
        lines = spark.read.text(paths)
        app_id = e.app_id_of(F.col("_metadata.file_path")) if app_id is None else app_id
        events = e.parse_events(lines.select(app_id.alias("app_id"), "value"), *e.EVENTS, whole=True)
        arrived = F.current_timestamp() if arrived is None else arrived
        events.withColumn("arrived", arrived).write.mode("overwrite").parquet(f"{store.path('events')}/batch={batch}")
    store.write(changed, "log_files", batch)
    return len(paths)


def last_delivery(usage: DataFrame) -> DataFrame:
    """The newest value of each function over all landed batches; of equal times the largest.

    One mergeable aggregation: a repeated delivery changes nothing, a smaller later one counts.
    """
    newest = F.max(F.struct("ts", "value")).alias("newest")
    more = [c for c in ("arrived", "touched") if c in usage.columns]
    merged = usage.groupBy("app_id", "unit", "id", "metric", "udf", "is_total").agg(
        newest, *[F.max(c).alias(c) for c in more]
    )
    return merged.select(
        "app_id", "unit", "id", "metric", "udf", "is_total", "newest.value", "newest.ts",
        *more,
    )


def merged_events(events: DataFrame) -> DataFrame:
    """Each line of a log once, with its last arrival."""
    same = [c for c in events.columns if c != "arrived"]
    return events.groupBy(*same).agg(F.max("arrived").alias("arrived"))


class Change(NamedTuple):
    """What a step has to look at: all that is kept of the applications concerned, with what is new.

    ``keys`` are their folders, ``kept_events`` and ``kept_usage`` what those hold from now on, which
    is more where an application that is not concerned shares the folder.
    """

    keys: list[str]
    events: DataFrame
    usage: DataFrame
    kept_events: DataFrame
    kept_usage: DataFrame
    waiting: DataFrame
    last: dict[str, int]


def change_of(store: Store, step: int, now: Column, retention: str = RETENTION) -> Change:
    """The applications touched since the steps before ``step``, or whose wait is over by ``now``.

    The keys of their folders go through the driver, ``APP_FOLDERS`` at most.
    """
    done_steps = store.read("merged").filter(F.col("step") < step)
    *before, last_step = done_steps.agg(F.max("events"), F.max("usage"), F.max("step")).first()
    new, last = {}, {}
    for table, done in zip(("events", "usage"), before):
        rows = store.read(table).filter(F.col("batch") > (-1 if done is None else done))
        rows = rows.withColumns({"app_key": app_key(F.col("app_id")), "arrived": F.coalesce("arrived", now)})
        new[table] = w.publish(rows, f"new_{table}")
        top = new[table].agg(F.max("batch")).first()[0]
        last[table] = top if top is not None else (-1 if done is None else done)
    waiting = store.read("waiting").filter(F.col("step") == F.lit(-1 if last_step is None else last_step))
    apps = waiting.filter(F.col("due") <= now).select("app_id").unionByName(new["events"].select("app_id")).unionByName(new["usage"].select("app_id"))
    apps = w.measure(w.publish(apps.distinct().withColumn("touched", F.lit(True)), "touched"))
    keys = [row[0] for row in apps.rows.select(app_key(F.col("app_id"))).distinct().collect()]
    held = F.col("arrived") >= now - F.expr(retention)

    def both(table: str, number: str) -> DataFrame:
        kept = w.join_lookup(store.of(f"kept_{table}", keys), apps, ["app_id"], spread_by=[number], how="left")
        # An application without a name meets no key.
        kept = kept.withColumn("touched", F.coalesce("touched", F.col("app_id").isNull()))
        fresh = new[table].drop("batch").withColumn("touched", F.lit(True))
        return kept.unionByName(fresh).filter(held | ~F.col("touched"))

    events = merged_events(both("events", "task_id"))
    usage = last_delivery(both("usage", "id")).withColumn("app_key", app_key(F.col("app_id")))
    kept = w.publish(events, "events", ["event"]), w.publish(usage, "last_usage", ["unit"])
    waits = waiting.join(apps.rows, ["app_id"], "left_anti").select("app_id", "app_key", "due")
    return Change(keys, *[rows.filter("touched").drop("touched") for rows in kept], *[rows.drop("touched") for rows in kept], waits, last)


def _progress(ended: DataFrame, expected: DataFrame, usage: DataFrame) -> DataFrame:
    """What each ended job waits for, and what of it is there: ``JOBS`` without ``step``.

    ``digest`` covers every covered task and every row of usage that holds for it or the job, so
    it changes with any of them, whatever their times. The rows are distinct: xor loses none.
    """
    job = ["app_id", "job_id"]
    row = F.bit_xor(F.xxhash64("metric", "is_total", "udf", "value", "ts"))
    seen = usage.filter(F.col("unit") == m.TASK).groupBy(
        "app_id", F.col("id").alias("task_id"), "metric"
    ).agg(F.count("*").alias("seen"), row.alias("seen_digest"))
    tasks = expected.join(seen, ["app_id", "task_id", "metric"], "left")
    tasks = tasks.groupBy(job).agg(
        F.count_if("ended").alias("expected"),
        F.count_if(F.col("ended") & F.col("seen").isNotNull()).alias("received"),
        F.bit_xor(F.xxhash64("stage_id", "task_id", "metric", "ended", "seen", "seen_digest")).alias("task_digest"),
    )
    totals = usage.filter((F.col("unit") == m.JOB) & F.col("is_total")).groupBy(
        "app_id", F.col("id").alias("job_id")
    ).agg(F.count("*").alias("totals"), row.alias("total_digest"))
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    counted = ended.join(tasks, job, "left").join(totals, job, "left").select(
        *job, "arrived", none("expected"), none("received"), none("totals"),
        F.xxhash64("task_digest", "total_digest").alias("digest"),
    )
    complete = (F.col("expected") == F.col("received")) & (F.col("totals") == 2)
    return counted.withColumn("complete", complete)


def _changed(state: DataFrame, reported: DataFrame) -> DataFrame:
    """The jobs that were not reported yet, or from something else than is there now."""
    basis = F.struct(*BASIS)
    last = reported.groupBy("app_id", "job_id").agg(F.max_by(basis, "step").alias("last"))
    both = state.join(last, ["app_id", "job_id"], "left")
    return both.filter(F.col("last").isNull() | ~F.col("last").eqNullSafe(basis)).drop("last")


def report_due(
    store: Store, registrations: DataFrame, step: int, settings: Settings = Settings(),
    now: Column | None = None, retention: str = RETENTION,
) -> None:
    """Reports the jobs that are due by ``now`` (default: the present), as step ``step``.

    Steps are numbered upwards by the caller, for example by the batch of the stream that the
    call follows. A step that is run again overwrites its own folders and finds the same news, as
    only steps before it count; only findings of jobs in the table of jobs count, which is written
    after them.
    """
    now = F.current_timestamp() if now is None else now
    change = change_of(store, step, now, retention)
    events, usage = change.events, change.usage
    reported = store.of("jobs", change.keys).filter(F.col("step") < step)
    jobs = e.job_events(events).filter(F.col("end_ts").isNotNull())
    tasks = e.task_events(events)
    expected = w.publish(
        hotspots.expected_of(jobs, e.stage_events(events), tasks, usage), "expected"
    )
    ended = e.parse_events(events, e.JOB_END).groupBy("app_id", "job_id").agg(
        F.max("arrived").alias("arrived")
    )
    wait = F.make_dt_interval(secs=F.lit(settings.give_up_ms / 1000))
    state = w.publish(_changed(_progress(ended, expected, usage), reported), "changed")
    is_due = F.col("complete") | (F.col("arrived") + wait <= now)
    due = w.publish(state.filter(is_due), "due")
    keys = w.measure(due.select("app_id", "job_id"))
    chosen = w.publish(
        w.join_lookup(expected, keys, ["app_id", "job_id"], spread_by=["task_id"]), "due_tasks"
    )
    found = report.findings(
        chosen, usage, r.resolve_registry(registrations),
        settings.cpu_threshold, settings.mem_threshold,
    )
    store.write(found, "findings", step)
    store.write(report.missing_profiles(chosen, usage), "missing", step)
    # Jobs that wait on: those seen now, and those of applications that were not looked at.
    waits = state.filter(~is_due).groupBy("app_id").agg(F.min(F.col("arrived") + wait).alias("due"))
    waits = waits.withColumn("app_key", app_key(F.col("app_id")))
    store.write(waits.unionByName(change.waiting), "waiting", step)
    store.write(due.drop("arrived").withColumn("app_key", app_key(F.col("app_id"))), "jobs", step)
    store.keep(change.kept_events, "kept_events")
    store.keep(change.kept_usage, "kept_usage")
    last = [(change.last["events"], change.last["usage"])]
    store.write(store.spark.createDataFrame(last, "events BIGINT, usage BIGINT"), "merged", step)


def newest(store: Store, table: str) -> DataFrame:
    """Rows of each job's newest report: ``table`` is findings, missing or jobs."""
    last = store.read("jobs").groupBy("app_id", "job_id").agg(F.max("step").alias("step"))
    return store.read(table).join(last, ["app_id", "job_id", "step"]).drop("step", "app_key")
