"""Reports of jobs on streams: order of arrival, later deliveries, waits, repeated steps."""

import datetime as dt

from pyspark.sql import functions as F

from stacktally import model as m
from stacktally.model import Settings
from stacktally.streaming import reports

T0 = dt.datetime(2024, 1, 1, 10)
ARRIVED = dt.datetime(2024, 5, 1)
COLUMNS = [c.split()[0] for c in reports.EVENTS.split(", ")]


def event(app, kind, minute, **fields):
    time = T0 + dt.timedelta(minutes=minute)
    ends = kind.endswith("End")
    row = dict.fromkeys(COLUMNS) | fields
    row |= {"app_id": app, "event": kind, "end_ts" if ends else "start_ts": time, "arrived": ARRIVED}
    return tuple(row[c] for c in COLUMNS)


def log_of(app, minute, tasks):
    """One job 1 with stage 1."""
    stage = {"stage_id": 1, "attempt": 0}
    rows = [
        event(app, "SparkListenerJobStart", minute, job_id=1, stage_ids=[1]),
        event(app, "SparkListenerStageSubmitted", minute, **stage),
    ]
    rows += [event(app, "SparkListenerTaskEnd", minute + 1, task_id=t, **stage) for t in tasks]
    return [*rows, event(app, "SparkListenerJobEnd", minute + 2, job_id=1)]


def cost(app, unit, number, minute, value, udf=None, metrics=(m.CPU, m.MEM)):
    ts = T0 + dt.timedelta(minutes=minute)
    return [(app, unit, number, metric, udf, udf is None, value, ts) for metric in metrics]


class Run:
    def __init__(self, spark, folder):
        self.spark, self.n = spark, 0
        self.store = reports.Store(spark, str(folder)).create()
        self.registry = spark.createDataFrame(
            [("a", 1, "f", "x.F", "udf"), ("b", 1, "f", "x.F", "udf")], m.REGISTRY
        )

    def step(self, number, events=(), usage=(), waited=False):
        self.n += 1
        for table, rows in (("events", events), ("usage", usage)):
            schema = reports.EVENTS if table == "events" else m.USAGE
            self.spark.createDataFrame(list(rows), schema).write.parquet(
                f"{self.store.path(table)}/batch={self.n}"
            )
        now = ARRIVED + dt.timedelta(seconds=12 if waited else 1)
        reports.report_due(self.store, self.registry, number, Settings(), F.lit(now))
        found = reports.newest(self.store, "findings").filter("metric = 'CPU'").collect()
        missing = reports.newest(self.store, "missing").collect()
        jobs = reports.newest(self.store, "jobs").collect()
        return (
            {(r.app_id, r.task_id): r.value for r in found},
            {(r.app_id, r.task_id, r.metric) for r in missing},
            {r.app_id: r.complete for r in jobs},
        )


def test_reports_follow_arrival_not_event_time(spark, tmp_path):
    run = Run(spark, tmp_path / "store")
    assert run.step(0) == ({}, set(), {})
    # Application a is complete at once; b, a day older, comes after it and waits for task 2.
    usage = cost("a", m.JOB, 1, 2, 10.0) + cost("a", m.TASK, 1, 1, 8.0) + cost("a", m.TASK, 1, 1, 8.0, "f")
    got = run.step(1, log_of("a", 0, [1]), usage)
    assert got == ({("a", 1): 8.0}, set(), {"a": True})
    old = cost("b", m.JOB, 1, -1438, 10.0) + cost("b", m.TASK, 1, -1439, 9.0) + cost("b", m.TASK, 1, -1439, 9.0, "f")
    assert run.step(2, log_of("b", -1440, [1, 2]), old) == got
    # Its wait is over: reported with task 2 missing.
    lost = {("b", 2, m.CPU), ("b", 2, m.MEM)}
    both = {("a", 1): 8.0, ("b", 1): 9.0}
    assert run.step(3, waited=True) == (both, lost, {"a": True, "b": False})
    # A step that runs again changes nothing, nor does one without news.
    assert run.step(3, waited=True) == (both, lost, {"a": True, "b": False})
    assert run.step(4, waited=True) == (both, lost, {"a": True, "b": False})
    # What arrives after the report makes a new one.
    got = run.step(5, usage=cost("b", m.TASK, 2, -1439, 1.0))
    assert got == (both, set(), {"a": True, "b": True})
    # The last delivery holds, also if it is smaller or in another hour.
    smaller = cost("a", m.TASK, 1, 70, 5.0) + cost("a", m.TASK, 1, 70, 5.0, "f")
    assert run.step(6, usage=smaller)[0] == {("a", 1): 5.0, ("b", 1): 9.0}


def test_late_usage_older_than_the_job_total_makes_a_new_report(spark, tmp_path):
    run = Run(spark, tmp_path / "store")
    usage = cost("a", m.JOB, 1, 60, 10.0) + cost("a", m.TASK, 1, 1, 8.0) + cost("a", m.TASK, 1, 1, 8.0, "f")
    assert run.step(1, log_of("a", 0, [1]), usage)[0] == {("a", 1): 8.0}
    newer = cost("a", m.TASK, 1, 30, 6.0) + cost("a", m.TASK, 1, 30, 6.0, "f")
    assert run.step(2, usage=newer)[0] == {("a", 1): 6.0}
    # A further function of the same task and time, from a profile landed later.
    run.step(3, usage=cost("a", m.TASK, 1, 30, 5.0, "g"))
    found = reports.newest(run.store, "findings").filter("metric = 'CPU'").collect()
    assert {(r.udf, r.value) for r in found} == {("f", 6.0), ("g", 5.0)}


def test_repeated_deliveries_count_once(spark):
    rows = cost("a", m.TASK, 1, 1, 3.0) + cost("a", m.TASK, 1, 1, 3.0) + cost("a", m.TASK, 1, 0, 9.0)
    got = reports.last_delivery(spark.createDataFrame(rows, m.USAGE)).collect()
    assert sorted((r.metric, r.value) for r in got) == [(m.CPU, 3.0), (m.MEM, 3.0)]


def test_a_step_reads_only_what_is_new_and_touched(spark, tmp_path):
    run = Run(spark, tmp_path / "store")
    for n, app in enumerate("abcd"):
        usage = cost(app, m.JOB, 1, 2, 10.0) + cost(app, m.TASK, 1, 1, 8.0) + cost(app, m.TASK, 1, 1, 8.0, "f")
        run.step(n + 1, log_of(app, 0, [1, 2]), usage)
    key = {app: spark.range(1).select(reports.app_key(F.lit(app))).first()[0] for app in "abcd"}
    late = spark.createDataFrame(cost("b", m.TASK, 2, 1, 1.0), m.USAGE)
    late.write.parquet(f"{run.store.path('usage')}/batch=77")
    soon, over = (F.lit(ARRIVED + dt.timedelta(seconds=s)) for s in (1, 12))
    change = reports.change_of(run.store, 5, soon)
    assert change.keys == [key["b"]] and {r.app_id for r in change.usage.collect()} == {"b"}
    for table in ("kept_events", "kept_usage"):
        rows = run.store.of(table, change.keys)
        files = {r[0] for r in rows.select("_metadata.file_path").collect()}
        assert files and all(f"app_key={key['b']}" in f for f in files)
        assert "app_key" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    # All four wait for their second task; when their wait is over all are looked at, without any news.
    assert set(reports.change_of(run.store, 5, over).keys) == set(key.values())
    reports.report_due(run.store, run.registry, 5, Settings(), soon)
    assert {r.app_id for r in reports.newest(run.store, "jobs").collect()} == {"b"}
    reports.report_due(run.store, run.registry, 6, Settings(), over)
    assert {r.app_id: r.complete for r in reports.newest(run.store, "jobs").collect()} == {
        "a": False, "b": True, "c": False, "d": False
    }
    # Nothing waits and nothing is new: nothing is read. Old rows of a touched application go.
    assert reports.change_of(run.store, 7, over).keys == []
    cost_now = spark.createDataFrame(cost("b", m.TASK, 3, 1, 1.0), m.USAGE)
    cost_now.write.parquet(f"{run.store.path('usage')}/batch=78")
    month = F.lit(ARRIVED + dt.timedelta(days=31))
    reports.report_due(run.store, run.registry, 7, Settings(), month)
    assert {(r.app_id, r.id) for r in run.store.read("kept_usage").collect() if r.app_id == "b"} == {("b", 3)}
    assert run.store.of("kept_usage", [key["a"]]).count() > 0


def test_applications_share_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    keys = spark.range(5000).select(reports.app_key(F.concat(F.lit("app-"), F.col("id").cast("string")))).distinct()
    assert keys.count() <= reports.APP_FOLDERS
    # All in one folder: what happens to one application leaves the others as they are.
    monkeypatch.setattr(reports, "APP_FOLDERS", 1)
    run = Run(spark, tmp_path / "store")
    for n, app in enumerate("ab"):
        usage = cost(app, m.JOB, 1, 2, 10.0) + cost(app, m.TASK, 1, 1, 8.0) + cost(app, m.TASK, 1, 1, 8.0, "f")
        run.step(n + 1, log_of(app, 0, [1, 2]), usage)
    spark.createDataFrame(cost("b", m.TASK, 2, 1, 1.0), m.USAGE).write.parquet(f"{run.store.path('usage')}/batch=77")
    month = F.lit(ARRIVED + dt.timedelta(days=31))
    soon = F.lit(ARRIVED + dt.timedelta(seconds=1))
    reports.report_due(run.store, run.registry, 3, Settings(), soon)
    assert {r.app_id: r.complete for r in reports.newest(run.store, "jobs").collect()} == {"b": True}
    assert [r.app_id for r in run.store.read("waiting").filter("step = 3").collect()] == ["a"]
    before = run.store.read("kept_usage").filter("app_id = 'a'").count()
    assert before == 6
    # The other's wait is over much later; what is too old goes for the touched application alone.
    reports.report_due(run.store, run.registry, 4, Settings(), month)
    assert run.store.read("kept_usage").filter("app_id = 'a'").count() == 0
    assert run.store.read("kept_usage").filter("app_id = 'b'").count() > 0
