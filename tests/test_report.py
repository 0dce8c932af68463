"""Shares, thresholds, missing tasks and the walk over a job's stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w
from stacktally.operators import lifecycle as lc, report, usage as u

T0 = dt.datetime(2024, 1, 1)
JOBS = "app_id STRING, job_id BIGINT, stage_ids ARRAY<BIGINT>, start_ts TIMESTAMP, end_ts TIMESTAMP, result STRING"
STAGES = "app_id STRING, stage_id BIGINT, attempt BIGINT, submit_ts TIMESTAMP"
TASKS = "app_id STRING, task_id BIGINT, stage_id BIGINT, attempt BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP, reason STRING"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def tables(spark):
    jobs = spark.createDataFrame(
        [
            ("a", 0, [1, 2, 3], at(0), at(9), "JobSucceeded"),
            ("a", 1, [2, 4], at(1), at(9), "JobFailed"),  # shares stage 2
            ("a", 2, [5], at(2), None, None),  # still running
            ("a", 3, [9], at(3), at(9), "JobSucceeded"),  # no tasks at all
            ("b", 0, [1], at(0), at(9), "JobSucceeded"),  # same ids, other application
        ],
        JOBS,
    )
    stages = spark.createDataFrame(
        [("a", 1, 0, at(0)), ("a", 2, 0, at(0)), ("a", 2, 1, at(4)), ("a", 4, 0, at(0)),
         ("a", 5, 0, at(0)), ("b", 1, 0, at(0))],  # stages 3 and 9 were skipped
        STAGES,
    )
    tasks = spark.createDataFrame(
        [
            ("a", 10, 1, 0, at(0), at(1), "Success"),
            ("a", 11, 1, 0, at(0), at(1), "Success"),
            ("a", 20, 2, 0, at(0), at(1), "Success"),  # dropped: stage was resubmitted
            ("a", 21, 2, 1, at(4), at(5), "Success"),
            ("a", 40, 4, 0, at(4), at(5), "ExceptionFailure"),
            ("a", 41, 4, 0, at(4), None, None),  # never ended
            ("a", 50, 5, 0, at(4), at(5), "Success"),
            ("a", 70, 7, 0, at(4), at(5), "Success"),  # stage of no job
            ("b", 10, 1, 0, at(0), at(1), "Success"),
        ],
        TASKS,
    )
    rows = []

    def add(app, unit, id_, cpu=None, mem=None, udf=None):
        for metric, value in ((m.CPU, cpu), (m.MEM, mem)):
            if value is not None:
                rows.append((app, unit, id_, metric, udf, udf is None, float(value), at(9)))

    add("a", "job", 0, 100, 200)
    add("a", "job", 1, 10)  # no memory total
    add("a", "job", 2, 10, 10)
    add("a", "job", 3, 10, 10)
    add("b", "job", 0, 50, 50)
    add("a", "task", 10, 60, 10)
    add("a", "task", 10, 25, 9, "f")
    add("a", "task", 11, 1)
    add("a", "task", 20, 99, 99, "f")
    add("a", "task", 21, 24, 50, "f")
    add("a", "task", 40, 2.5, None, "g")
    add("a", "task", 41, 10, 10, "g")
    add("a", "task", 50, 10, 10, "g")
    add("b", "task", 10, 50, 1, "f")
    usage = spark.createDataFrame(rows, m.USAGE)
    covered = w.measure(report.covered_stages(jobs, stages, u.job_total(usage)))
    expected = report.expected_tasks(covered, tasks)
    return jobs, stages, tasks, usage, expected


def test_expected_tasks(tables):
    got = {tuple(r) for r in tables[4].select("app_id", "job_id", "task_id", "metric").collect()}
    both = [("a", 0, 10), ("a", 0, 11), ("a", 0, 21), ("b", 0, 10)]
    want = {(*row, metric) for row in both for metric in (m.CPU, m.MEM)}
    want |= {("a", 1, task, m.CPU) for task in (21, 40, 41)}
    assert got == want


def test_large_lookups_are_salted(tables):
    jobs, stages, tasks, usage, expected = tables
    covered = w.measure(report.covered_stages(jobs, stages, u.job_total(usage)))
    salted = report.expected_tasks(covered._replace(n_bytes=w.BROADCAST_LIMIT_BYTES + 1), tasks)
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert sorted(salted.select(expected.columns).collect()) == sorted(expected.collect())


def test_threshold_is_inclusive_and_by_metric(tables):
    shares = report.usage_share(tables[4], tables[3])
    rows = report.over_threshold(shares, 25.0, 25.0).collect()
    got = {(r.app_id, r.job_id, r.task_id, r.metric, r.udf, r.pct) for r in rows}
    assert got == {
        ("a", 0, 10, m.CPU, "f", 25.0),
        ("a", 0, 21, m.MEM, "f", 25.0),
        ("a", 1, 21, m.CPU, "f", 240.0),
        ("a", 1, 40, m.CPU, "g", 25.0),
        ("b", 0, 10, m.CPU, "f", 100.0),
    }
    only_mem = report.over_threshold(shares, 1000.0, 4.5).collect()
    assert {(r.task_id, r.metric) for r in only_mem} == {(10, m.MEM), (21, m.MEM)}


def test_missing_counts_any_usage_row_as_present(tables):
    rows = report.missing_profiles(tables[4], tables[3]).collect()
    got = {(r.app_id, r.job_id, r.task_id, r.metric) for r in rows}
    # 11 has a CPU total only; 41 never ended, so its usage was never taken.
    assert got == {("a", 0, 11, m.MEM), ("a", 1, 41, m.CPU)}
    assert rows[0].message.startswith(f"[{rows[0].metric}] Task data is missing: job ")


def test_findings_shrink_as_the_threshold_grows(tables):
    shares = report.usage_share(tables[4], tables[3])
    previous = None
    for limit in (0.0, 5.0, 25.0, 30.0, 250.0):
        rows = {tuple(r) for r in report.over_threshold(shares, limit, limit).collect()}
        assert previous is None or rows <= previous
        previous = rows
    assert previous == set()


def test_message(spark, tables):
    resolved = spark.createDataFrame([("a", "f", "acme.F"), ("b", "f", "acme.F")], "app_id STRING, udf STRING, impl STRING")
    rows = report.findings(tables[4], tables[3], resolved, 25.0, 25.0).collect()
    by_key = {(r.app_id, r.job_id, r.task_id, r.metric): r for r in rows}
    assert by_key["a", 0, 10, "CPU"].message == (
        "[CPU] job 0 -> stage 1 -> task 10: f at acme.F: 25.00%, 25.00s/100.00s"
    )
    assert by_key["a", 0, 21, "MEM"].message.endswith("f at acme.F: 25.00%, 50.00MB/200.00MB")
    assert by_key["a", 1, 40, "CPU"].impl is None  # not registered: kept, class unknown


def test_zero_totals(spark):
    from stacktally.functions import columns as c

    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "v DOUBLE, t DOUBLE")
    got = [r[0] for r in rows.select(c.percent(F.col("v"), F.col("t"))).collect()]
    assert got == [float("inf"), None, 25.0]


def test_share_of_the_total_frame_is_100(landing):
    from stacktally.plans import hotspots

    usage = hotspots.task_usage(landing.profiles.filter("unit = 'job'"), landing.registry)
    totals = u.job_total(usage).withColumnRenamed("job_total", "t")
    own = usage.filter("is_total").select("app_id", F.col("id").alias("job_id"), "metric", "value")
    from stacktally.functions import columns as c

    shares = own.join(totals, ["app_id", "job_id", "metric"]).select(c.percent(F.col("value"), F.col("t")).alias("p"))
    assert {r.p for r in shares.collect()} == {100.0}


def test_stage_owner_and_labels(spark, tables):
    jobs, _, tasks, _, _ = tables
    owners = lc.stage_to_job(lc.job_stages(jobs))
    assert {(r.app_id, r.stage_id, r.job_id) for r in owners.collect()} == {
        ("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("a", 4, 1), ("a", 5, 2), ("a", 9, 3), ("b", 1, 0),
    }
    known = lc.known_tasks(lc.task_to_job(tasks, owners)).select("app_id", "task_id").collect()
    assert ("a", 70) not in {tuple(r) for r in known} and len(known) == 8
    labels = {(r.app_id, r.task_id): r.labels for r in lc.label_samples(tasks, owners).collect()}
    assert labels["a", 21] == {"job": "1", "stage": "2", "task": "21"}
    assert labels["a", 70]["job"] is None


def test_completeness(tables):
    jobs, _, tasks, usage, _ = tables
    owners = lc.stage_to_job(lc.job_stages(jobs))
    got = {
        (r.app_id, r.job_id): (r.expected, r.received, r.complete)
        for r in lc.task_completeness(jobs, tasks, owners, usage).collect()
    }
    assert got == {
        ("a", 0): (2, 1, False), ("a", 1): (3, 2, False), ("a", 2): (1, 1, True),
        ("a", 3): (0, 0, True), ("b", 0): (1, 1, True),
    }


def test_usage_map(tables):
    maps = {
        (r.app_id, r.unit, r.id, r.metric): (r.usage, r.total)
        for r in u.usage_map(tables[3]).collect()
    }
    assert maps["a", "task", 10, "CPU"] == ({"f": 25.0}, 60.0)
    assert maps["a", "task", 11, "CPU"] == ({}, 1.0)
    assert maps["a", "task", 40, "CPU"] == ({"g": 2.5}, None)


def test_sinks(spark, tables, tmp_path):
    from stacktally.sources import tables as t

    missing = report.missing_profiles(tables[4], tables[3])
    path = str(tmp_path / "missing")
    t.write_missing(missing, path, "monday")
    assert t.read_report(spark, path).count() == missing.count()
    # A run that dies after some of its files leaves rows that no manifest names; then it runs again.
    missing.limit(1).write.partitionBy("metric").parquet(f"{path}/rows/run=monday/attempt=dead")
    t.write_missing(missing, path, "monday")
    t.write_missing(missing, path, "tuesday")
    rows = t.read_report(spark, path)
    assert rows.count() == 2 * missing.count() and len(list((tmp_path / "missing/rows/run=monday").iterdir())) == 3
    assert sorted(rows.filter("run = 'monday'").drop("run").collect(), key=repr) == sorted(
        missing.select(rows.drop("run").columns).collect(), key=repr
    )
    resolved = spark.createDataFrame([("a", "f", "acme.F")], "app_id STRING, udf STRING, impl STRING")
    found = report.findings(tables[4], tables[3], resolved, 25.0, 25.0)
    t.write_findings(found, str(tmp_path / "findings"), "1")
    assert t.read_report(spark, str(tmp_path / "findings")).count() == 5
