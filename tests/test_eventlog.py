"""Reading a log that Spark itself has written."""

import subprocess
import sys
import textwrap

import pytest

from stacktally.operators import lifecycle as lc
from stacktally.sources import eventlog as e

JOB = textwrap.dedent(
    """
    import sys
    from pyspark.sql import SparkSession
    spark = (
        SparkSession.builder.master("local[2]").appName("written log")
        .config("spark.ui.enabled", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", sys.argv[1])
        .config("spark.eventLog.rolling.enabled", sys.argv[2])
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.adaptive.enabled", "false")
        .getOrCreate()
    )
    spark.range(1000).repartition(4).groupBy((__import__("pyspark").sql.functions.col("id") % 7).alias("k")).count().collect()
    spark.range(10).count()
    print("APP", spark.sparkContext.applicationId)
    spark.stop()
    """
)


@pytest.fixture(scope="module", params=["true", "false"], ids=["rolling", "single"])
def written(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("eventlog")
    done = subprocess.run(
        [sys.executable, "-c", JOB, f"file://{folder}", request.param],
        capture_output=True, text=True, timeout=180, check=True,
    )
    app_id = next(line.split()[1] for line in done.stdout.splitlines() if line.startswith("APP"))
    return folder, app_id


def test_written_log(spark, written):
    folder, app_id = written
    log = e.read_event_log(spark, str(folder))
    start = e.app_start(log).collect()
    assert [(r.app_id, r.app_name) for r in start] == [(app_id, "written log")]
    assert start[0].start_epoch == int(start[0].start_ts.timestamp())
    jobs = e.job_events(log).collect()
    assert jobs and all(j.result == "JobSucceeded" and j.end_ts >= j.start_ts for j in jobs)
    stages, tasks = e.stage_events(log), e.task_events(log)
    task_rows = tasks.collect()
    assert all(t.reason == "Success" and t.end_ts is not None for t in task_rows)
    assert {t.app_id for t in task_rows} == {app_id}
    owners = lc.stage_to_job(lc.job_stages(e.job_events(log)))
    known = lc.known_tasks(lc.task_to_job(tasks, owners))
    assert known.count() == len(task_rows)
    assert lc.tasks_of_stage(stages, tasks).count() == len(task_rows)


def test_landed_events_give_the_same_tables(spark, written):
    log = e.read_event_log(spark, str(written[0]))
    landed = e.land_events(log)
    for reader in (e.app_start, e.job_events, e.stage_events, e.task_events, e.job_ends, e.task_ends):
        assert sorted(reader(log).collect(), key=repr) == sorted(reader(landed).collect(), key=repr)


def test_written_log_as_a_stream(spark, written, tmp_path):
    from stacktally.streaming import run

    folder, app_id = written
    rows = e.task_ends(e.stream_events(spark, str(folder)))
    run.drain(run.to_files(rows, str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = e.task_ends(e.read_event_log(spark, str(folder)))
    assert sorted(got.select(batch.columns).collect()) == sorted(batch.collect())


@pytest.mark.parametrize(
    "name, app_id",
    [
        ("events_1_local-1700000000000.zstd", "local-1700000000000"),
        ("events_12_app-20240101000000-0001", "app-20240101000000-0001"),
        ("application_1700000000000_0042_1.inprogress", "application_1700000000000_0042"),
        ("events_3_application_1700000000000_0042_2.zstd", "application_1700000000000_0042"),
        ("spark-0123456789abcdef.lz4", "spark-0123456789abcdef"),
    ],
)
def test_application_id_from_the_file_name(spark, tmp_path, name, app_id):
    from pyspark.sql import functions as F

    plain = tmp_path / name.replace(".zstd", "").replace(".lz4", "")
    plain.write_text('{"Event":"SparkListenerJobEnd","Job ID":1,"Completion Time":5}\n')
    assert [r.app_id for r in e.read_event_log(spark, str(tmp_path)).collect()] == [app_id]
    named = spark.range(1).select(e.app_id_of(F.lit(f"file:/x/{name}")).alias("app_id"))
    assert named.first().app_id == app_id


def test_an_absurd_time_is_no_time(spark):
    line = '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Stage Attempt ID":0,"Task End Reason":{"Reason":"Success"},"Task Info":{"Task ID":7,"Launch Time":%d,"Finish Time":9223372036854775807}}'
    log = spark.createDataFrame([("a", line % 1000)], "app_id string, value string")
    row, = e.parse_events(log, e.TASK_END).collect()
    assert row["task_id"] == 7 and row["end_ts"] is None and row["start_ts"] is not None


def test_logs_that_grow_are_landed_without_loss(spark, tmp_path):
    """A file that is written on, its last line half there, then rolled and compacted."""
    from stacktally.streaming import reports

    store = reports.Store(spark, str(tmp_path / "store")).create()
    folder = tmp_path / "log" / "eventlog_v2_app-1"
    folder.mkdir(parents=True)
    end = '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Stage Attempt ID":0,"Task Info":{"Task ID":%d,"Finish Time":%d}}\n'
    lines = [end % (t, 1000 + t) for t in range(6)]

    def land(batch, name, text):
        (folder / name).write_text(text)
        n = reports.land_log(store, str(tmp_path / "log"), batch)
        events = reports.merged_events(store.read("events").drop("batch"))
        return n, sorted((r.app_id, r.task_id) for r in e.task_ends(events).collect())

    tasks = lambda n: [("app-1", t) for t in range(n)]
    assert land(0, "events_1_app-1", lines[0] + lines[1][:40]) == (1, tasks(1))
    assert land(1, "appstatus_app-1.inprogress", "") == (0, tasks(1))
    assert land(2, "events_1_app-1", "".join(lines[:3])) == (1, tasks(3))
    assert land(3, "events_2_app-1", lines[3] + lines[4]) == (1, tasks(5))
    assert land(3, "events_2_app-1", lines[3] + lines[4]) == (1, tasks(5))  # the batch again
    assert land(4, "events_2_app-1.compact", "".join(lines[1:5])) == (1, tasks(5))
    assert land(5, "events_3_app-1", lines[5]) == (1, tasks(6))
    assert land(6, "events_3_app-1", lines[5]) == (0, tasks(6))
