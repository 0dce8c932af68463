"""Order of arrival, late rows, repeated rows, timers and state on streams of files."""

import datetime as dt
import json

import pytest

from stacktally import fixtures as fx
from stacktally import model as m
from stacktally.model import Settings
from stacktally.plans import hotspots
from stacktally.sources import tables
from stacktally.streaming import jobs as sj, run, usage as su

T0 = dt.datetime(2024, 1, 1, 10)
SETTINGS = Settings()


def at(minutes=0.0):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Table:
    """A folder that grows by one file per step."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, *rows):
        df = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        df.write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def arrival(seconds):
    return dt.datetime(2024, 5, 1) + dt.timedelta(seconds=seconds)


DAY = 86_400
LINES = m.LOG_LINE + ", arrived TIMESTAMP"


def line(app, event, second, **fields):
    return (app, json.dumps({"Event": event} | fields), arrival(second))


def starts(job, stages, minute, second, app="a"):
    time = int(at(minute).timestamp() * 1000)
    return line(app, "SparkListenerJobStart", second, **{"Job ID": job, "Stage IDs": stages, "Submission Time": time})


def ends(task, stage, second, app="a"):
    return line(app, "SparkListenerTaskEnd", second, **{"Stage ID": stage, "Task Info": {"Task ID": task, "Finish Time": 1}})


def job_ends(job, second, app="a"):
    return line(app, "SparkListenerJobEnd", second, **{"Job ID": job, "Completion Time": 1})


def usage_row(task, minute, second, value=1.0, metrics=(m.CPU, m.MEM), udf=None, app="a"):
    return [(app, "task", task, x, udf, udf is None, value, at(minute), arrival(second)) for x in metrics]


class Streams:
    """The three streams over growing folders; ``step`` lands and drains, the last count of states is kept."""

    def __init__(self, spark, folder):
        self.spark, self.root = spark, str(folder)
        self.log = Table(spark, f"{folder}/log", LINES)
        self.usage = Table(spark, f"{folder}/usage", su.LANDED)
        self.states = {}

    def drain(self, rows, name, keyed=False):
        query = run.drain(run.to_files(rows, f"{self.root}/{name}"), f"{self.root}/ck-{name}", keyed)
        if query.lastProgress and keyed:
            self.states[name] = query.lastProgress["stateOperators"][0]["numRowsTotal"]

    def step(self, lines=(), usage=()):
        for table, rows in ((self.log, list(lines)), (self.usage, [r for rs in usage for r in rs])):
            if rows:
                table.add(*rows)
        self.drain(sj.owned_ends(self.log.stream()), "owned")
        owned = self.spark.readStream.schema(sj.OWNED).parquet(f"{self.root}/owned")
        self.drain(sj.track_tasks(owned, self.usage.stream(), SETTINGS, 7 * DAY * 1000), "tracked", True)
        tracked = sj.stream_tracked(self.spark, f"{self.root}/tracked")
        self.drain(sj.track_jobs(self.log.stream(), tracked, SETTINGS, 7 * DAY * 1000), "jobs", True)

    def tick(self, second):
        """Lets the clock go on by an application of its own."""
        self.step([starts(0, [0], 0, second, "~"), ends(second, 0, second, "~")], [usage_row(second, 0, second, app="~")])

    def tracked(self):
        return self.spark.read.schema(sj.TRACKED).parquet(f"{self.root}/tracked").filter("app_id <> '~'")

    def usage_now(self):
        return {(r.app_id, r.task_id, r.metric, r.udf): r.value for r in sj.newest_usage(self.tracked()).collect()}

    def outcomes(self):
        return {(r.app_id, r.job_id, r.task_id, r.metric): r.present for r in sj.outcomes(self.tracked()).collect()}

    def jobs(self):
        reports = self.spark.read.schema(sj.JOB_REPORT).parquet(f"{self.root}/jobs").filter("app_id <> '~'")
        return {
            (r.app_id, r.job_id): (r.tasks, r.outcomes, r.received, r.complete)
            for r in sj.newest_reports(reports).collect()
        }


def test_tasks_and_jobs_on_the_clock_of_arrival(spark, tmp_path):
    s = Streams(spark, tmp_path)
    # Application b ran years after a and lands before it; profiles come before, with and after ends.
    s.step(
        [starts(7, [1, 2], 10**6, 0, "b"), ends(1, 1, 0, "b"), ends(2, 1, 0, "b"), job_ends(7, 0, "b")],
        [usage_row(1, 10**6, 0, 3.0, udf="f", app="b"), usage_row(1, 10**6, 0, 3.0, udf="f", app="b")],
    )
    assert s.outcomes() == {} and s.jobs() == {}
    s.step(
        [starts(7, [1], 5, 60), ends(1, 1, 60), ends(3, 99, 60), job_ends(7, 60), job_ends(8, 60), starts(8, [], 5, 60)],
        [usage_row(1, 5, 60, 9.0), usage_row(1, 70, 60, 4.0), usage_row(2, 5, 60)],
    )
    of_b = {("b", 7, 1, m.CPU): True, ("b", 7, 1, m.MEM): True, ("b", 7, 2, m.CPU): False, ("b", 7, 2, m.MEM): False}
    assert s.outcomes() == of_b
    s.tick(300)
    # Task 3 of a has no job; task 2 has not ended; the newest value holds though it is smaller.
    assert s.outcomes() == {**of_b, ("a", 7, 1, m.CPU): True, ("a", 7, 1, m.MEM): True}
    assert s.usage_now() == {
        ("b", 1, m.CPU, "f"): 3.0, ("b", 1, m.MEM, "f"): 3.0, ("a", 1, m.CPU, None): 4.0, ("a", 1, m.MEM, None): 4.0
    }
    s.tick(600)
    assert s.jobs() == {("b", 7): (2, 4, 2, True), ("a", 7): (1, 2, 2, True), ("a", 8): (0, 0, 0, True)}
    # Late: usage given up on, a smaller newer value, an ended task, another owner.
    s.step(
        [ends(9, 2, 700, "b"), starts(8, [1], 10**6 + 1, 700, "b")],
        [usage_row(2, 10**6, 700, 2.0, metrics=(m.CPU,), app="b"), usage_row(1, 80, 700, 1.0)],
    )
    s.tick(1000)
    s.tick(1300)
    assert s.outcomes()["b", 8, 2, m.CPU] is True and s.outcomes()["b", 8, 2, m.MEM] is False
    assert ("b", 7, 2, m.CPU) not in s.outcomes() and s.outcomes()["b", 7, 9, m.CPU] is False
    assert s.usage_now()["a", 1, m.CPU, None] == 1.0 and s.usage_now()["b", 2, m.CPU, None] == 2.0
    assert s.tracked().filter("late AND kind = 'outcome'").count() > 0
    assert s.jobs() == {("b", 7): (1, 2, 0, True), ("a", 7): (1, 2, 2, True), ("a", 8): (0, 0, 0, True)}


def test_no_state_stays(spark, tmp_path):
    """Jobs and tasks that never end, and what comes after a report, leave no state."""
    s = Streams(spark, tmp_path)
    lines = [starts(j, [j], 0, 0) for j in range(5)] + [ends(100 * t, t % 5, 0) for t in range(20)]
    s.step([*lines, job_ends(1, 0)], [usage_row(100 * t, 1, 0) for t in range(30)])
    s.tick(600)
    s.tick(900)
    assert s.jobs() == {("a", 1): (4, 8, 8, True)} and s.states["tracked"] > 10 and s.states["jobs"] >= 5
    # After the report and a week: counts and usage of the reported job, a second end of it.
    s.step([ends(111_101, 1, 8 * DAY), job_ends(1, 8 * DAY)], [usage_row(500, 2, 8 * DAY, 7.0)])
    s.tick(16 * DAY)
    # Usage of tasks that never ended is given out as their state goes.
    assert len([k for k in s.usage_now() if k[1] >= 2000]) == 20
    s.tick(30 * DAY)
    # What is left is of the clock's own last rows.
    assert s.states["tracked"] <= 1 and s.states["jobs"] <= 1


def test_repeated_lines_and_restarts_change_nothing(spark, tmp_path):
    s = Streams(spark, tmp_path)
    lines = [starts(1, [1], 0, 0), ends(1, 1, 0), job_ends(1, 0)]
    s.step(lines * 3, [usage_row(1, 1, 0, 5.0)] * 3)
    s.tick(600)
    s.step([line("a", "SparkListenerTaskEnd", 650, **{"Stage ID": 1, "Task Info": {"Task ID": 1}})], [usage_row(1, 1, 650, 5.0)])
    s.tick(900)
    assert s.jobs() == {("a", 1): (1, 2, 2, True)} and s.usage_now() == {("a", 1, x, None): 5.0 for x in (m.CPU, m.MEM)}
    assert s.tracked().filter("kind = 'usage'").count() == 2


def test_usage_writer_equals_batch_and_is_repeatable(spark, landing, tmp_path):
    chosen = landing.profiles.filter("id % 7 < 3")
    path = str(tmp_path / "profiles")
    for part in ("id % 2 = 0", "id % 2 = 1"):
        tables.write_profiles(chosen.filter(part), path, mode="append")
    stream = tables.stream_profiles(spark, path)
    out, rejected = str(tmp_path / "usage"), str(tmp_path / "rejected")
    batch = hotspots.task_usage(chosen, landing.registry).select(
        "app_id", "unit", "id", "metric", "udf", "is_total", "value", "ts"
    )
    want = sorted(batch.collect(), key=repr)
    # The second run starts over with batch 0, as after a failure before its commit.
    for attempt in range(2):
        writer = su.usage_writer(stream, landing.registry, out, rejected)
        run.drain(writer, str(tmp_path / f"checkpoint-{attempt}"))
        got = spark.read.schema(m.USAGE).option("recursiveFileLookup", "true").parquet(out)
        assert sorted(got.collect(), key=repr) == want
    from stacktally.operators import profiles as p

    bad = spark.read.option("recursiveFileLookup", "true").parquet(rejected)
    assert bad.count() == p.rejected_profiles(chosen).count() > 0


def test_settings_bound_the_wait():
    assert Settings().give_up_ms == 11_000
    assert Settings(upload_interval_ms=500, poll_attempts=3).give_up_ms == 3_500


def test_fixture_steps_cover_all_rows(spark, landing):
    steps = fx.stream_steps(spark, landing)
    assert sum(profiles.count() for profiles, _, _ in steps) == landing.profiles.count() + 1
    assert sum(lines.count() for _, lines, _ in steps) == landing.log.count() + 3


def test_state_partitions_follow_the_cores(spark):
    before = spark.conf.get(run.PARTITIONS)
    spark.conf.set(run.PARTITIONS, "200")
    with run.state_partitions(spark):
        assert spark.conf.get(run.PARTITIONS) == str(2 * spark.sparkContext.defaultParallelism)
    assert spark.conf.get(run.PARTITIONS) == "200"
    spark.conf.set(run.PARTITIONS, before)


def test_tasks_of_a_job_share_few_states(spark, tmp_path):
    """Of two thousand neighbours, as many as asked for share a state."""
    owned, usage = (Table(spark, tmp_path / name, schema) for name, schema in (("owned", sj.OWNED), ("usage", su.LANDED)))
    usage.add(*[r for t in range(0, 2048, 64) for r in usage_row(t, 1, 0)])
    states = {}
    for bits in (8, 11):
        rows = sj.track_tasks(owned.stream(), usage.stream(), SETTINGS, block_bits=bits)
        query = run.drain(run.to_files(rows, f"{tmp_path}/out{bits}"), f"{tmp_path}/ck{bits}", True, True)
        states[bits] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert states[11] * 8 <= states[8]


def test_states_are_as_many_as_asked_for(spark, tmp_path):
    """Tasks, ends and jobs of many applications share three states, and nothing else changes."""
    log, usage = (Table(spark, tmp_path / name, schema) for name, schema in (("log", LINES), ("usage", su.LANDED)))
    apps = [f"app {i}" for i in range(6)]
    for a, app in enumerate(apps):
        tasks = [10_000 * j + t for j in range(2) for t in range(3)]
        log.add(*[starts(j, [100 * j, 7], a, 0, app) for j in range(2)], *[job_ends(j, 0, app) for j in range(2)],
                *[ends(t, t // 10_000 * 100, 0, app) for t in tasks])
        usage.add(*[r for t in tasks[a % 3:] for r in usage_row(t, 1, 0, 1.0 + a, udf='f "quoted"', app=app)])
    most = {}

    def drained(rows, root, of):
        query = run.drain(run.to_files(rows, f"{root}/{of}"), f"{root}/ck-{of}", True)
        n = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        most[root, of] = max(most.get((root, of), 0), n)

    variants = {f"{tmp_path}/apart": {}, f"{tmp_path}/together": {"states": 3}}
    for second in (600, 1200, 1800):
        for root, states in variants.items():
            drained(sj.owned_ends(log.stream(), **states), root, "owned")
            owned = spark.readStream.schema(sj.OWNED).parquet(f"{root}/owned")
            drained(sj.track_tasks(owned, usage.stream(), SETTINGS, **states), root, "tracked")
            tracked = sj.stream_tracked(spark, f"{root}/tracked")
            drained(sj.track_jobs(log.stream(), tracked, SETTINGS, **states), root, "jobs")
        log.add(starts(0, [0], 0, second, "~"), ends(second, 0, second, "~"))
        usage.add(*usage_row(second, 0, second, app="~"))

    def results(root):
        read = lambda schema, of: spark.read.schema(schema).parquet(f"{root}/{of}").filter("app_id <> '~'")
        tracked = read(sj.TRACKED, "tracked")
        frames = (read(sj.OWNED, "owned"), sj.outcomes(tracked), sj.newest_usage(tracked), sj.newest_reports(read(sj.JOB_REPORT, "jobs")))
        return [sorted(map(tuple, df.collect()), key=repr) for df in frames]

    apart, together = map(results, variants)
    assert [len(x) for x in apart] == [36, 72, 60, 12] and together == apart
    for of in ("owned", "tracked", "jobs"):
        own, shared = (most[root, of] for root in variants)
        assert shared <= 3 < own


def test_ends_wait_for_their_job_a_retention(spark, tmp_path):
    """Stages of several blocks, a job that comes within the retention and one that does not; then no state is left."""
    log = Table(spark, tmp_path / "log", LINES)

    def step(*lines):
        log.add(*lines)
        query = run.drain(run.to_files(sj.owned_ends(log.stream()), f"{tmp_path}/owned"), f"{tmp_path}/ck")
        rows = spark.read.schema(sj.OWNED).parquet(f"{tmp_path}/owned").collect()
        got = sorted((r.task_id, r.stage_id, r.job_id, (r.arrived - arrival(0)).total_seconds()) for r in rows)
        return got, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    no_stage = line("a", "SparkListenerTaskEnd", 0, **{"Task Info": {"Task ID": 9}})
    first = [(1, 3, 1, 0.0), (1, 3, 1, 0.0), (2, 40, 1, 0.0)]
    assert step(starts(1, [3, 40, 3], 0, 0), ends(1, 3, 0), ends(1, 3, 0), ends(2, 40, 0), ends(3, 41, 0), no_stage)[0] == first
    second = [*first, (3, 41, 2, 6.0 * DAY)]
    assert step(starts(2, [41], 0, 6 * DAY))[0] == second
    got, states = step(starts(3, [41, 3], 0, 8 * DAY), ends(4, 40, 8 * DAY))
    assert got == second and states > 0
    # Any line moves the clock.
    assert step(line("b", "SparkListenerLogStart", 20 * DAY))[0] == second
    assert step(line("b", "SparkListenerLogStart", 21 * DAY)) == (second, 0)
