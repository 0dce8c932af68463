"""Tasks and jobs on streams, on the clock of arrival.

No event time decides what is waited for: a task waits for its profile from the moment its end
*arrived*, as long as the settings say, and so does a job. Applications may therefore land in any
order, years apart; arrival is the one clock that runs alike for all of them, and the only column
with a watermark (its delay allows for clocks that differ between writers). The clock goes on with
every line and profile that arrives, of whatever application; where all feeds may fall silent, land
a line from time to time.

``owned_ends`` finds the job of each ended task, ``track_tasks`` keeps the state of tasks and gives
out a changelog, ``track_jobs`` keeps the state of jobs. Nothing is dropped for being late: what
arrives after an outcome was given out takes that outcome back (``n`` is -1) and gives out another,
marked ``late``. Every state is forgotten a ``retention`` after its last news, also that of tasks
and jobs that never end.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stacktally import model as m
from stacktally.model import Settings
from stacktally.sources import eventlog as e

RETENTION = "7 days"
# How far apart the clocks of two writers may be. What a task's state gives out carries the time of
# its watermark, so the stream of jobs, which reads that next to log lines, allows for more.
SKEW, JOB_SKEW = "10 seconds", "30 seconds"
# Pieces that the tasks of one stage are dealt into when they meet the job that lists it.
STAGE_PIECES = 8
# Stages are numbered on as jobs start; a job is kept once for so many neighbours (2 to the power of).
STAGE_BITS = 4
# Tasks are numbered on as an application runs; so many neighbours (2 to the power of) share a state.
BLOCK_BITS = 8
# Where the number of states is chosen, log lines that one of them should get, and rows that are
# collected in a worker before they are packed by state.
STATE_LINES, PACK_ROWS = 16_384, 200_000

OWNED = (
    "app_id STRING, stage_id BIGINT, task_id BIGINT, job_id BIGINT, job_start TIMESTAMP, arrived TIMESTAMP"
)
TRACKED = (
    "app_id STRING, job_id BIGINT, stage_id BIGINT, task_id BIGINT, kind STRING, metric STRING, udf STRING, "
    "is_total BOOLEAN, value DOUBLE, ts TIMESTAMP, present BOOLEAN, n INT, late BOOLEAN, arrived TIMESTAMP"
)
# Kinds of tracked rows.
ENDED, USAGE, OUTCOME = "ended", "usage", "outcome"
JOB_REPORT = (
    "app_id STRING, job_id BIGINT, tasks BIGINT, outcomes BIGINT, received BIGINT, complete BOOLEAN, revision INT"
)


def states_for(lines: int) -> int:
    """How many states to deal the tasks and jobs of so many log lines into."""
    return max(1, -(-lines // STATE_LINES))


def _join_ends():
    def number(text):
        return None if text is None else int(text)

    def joined(key, batches, state):
        """Ends and starts of a state by application, piece and stage, each new one with all of the other kind."""
        held, now, out = pickle.loads(state.get[0]) if state.exists else {}, state.getCurrentWatermarkMs() * 1000, []
        held = {
            k: kept for k, kinds in held.items()
            if any(kept := [[x for x in kind if x[-1][1] >= now] for kind in kinds])
        }
        whens = {x[-1]: x[-1] for kinds in held.values() for kind in kinds for x in kind}

        def meet(at, end, start):
            if start[-1][0] <= end[-1][1] and end[-1][0] <= start[-1][1]:
                out.append((at[0], at[2], end[0], *start[:2], max(start[-1][0], end[-1][0])))

        for batch in batches:
            for rows in batch["rows"]:
                for app_id, piece, *row, arrived, until in json.loads(rows):
                    when = int(arrived), int(until)
                    when = whens.setdefault(when, when)  # one object, so that it is kept once a state
                    if len(row) == 2:
                        at = app_id, piece, int(row[0])
                        new = number(row[1]), when
                        ends, starts = held.setdefault(at, [[], []])
                        ends.append(new)
                        for start in starts:
                            meet(at, new, start)
                    else:
                        new = number(row[1]), number(row[2]), when
                        for stage in row[0].split(","):
                            at = app_id, piece, int(stage)
                            ends, starts = held.setdefault(at, [[], []])
                            starts.append(new)
                            for end in ends:
                                meet(at, end, new)
        if held:
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(min(until for _, until in whens), now) // 1000 + 1)
        elif state.exists:
            state.remove()
        columns = ["app_id", "stage_id", "task_id", "job_id", "job_start", "arrived"]
        for i in range(0, len(out), 10_000):
            yield pd.DataFrame(dict(zip(columns, map(list, zip(*out[i:i + 10_000])))), dtype=object)

    return joined


def _newest_arrival():
    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = [batch["arrived_ms"].max() for batch in batches if len(batch)]
        if times:
            yield pd.DataFrame({"part": [0], "arrived_ms": [max(times)], "rows": ["[]"]})

    return newest


def owned_ends(
    log: DataFrame, retention: str = RETENTION, pieces: int = STAGE_PIECES, states: int | None = None
) -> DataFrame:
    """``OWNED``: a row per ended task and job that lists its stage, as soon as both have arrived.

    ``log`` are streamed lines with ``arrived``. Which of several jobs owns the task is left to its
    state. A stage may hold most tasks: its tasks are dealt into ``pieces`` and the few rows of jobs
    are repeated for each. Neighbouring stages (``STAGE_BITS``) share a state for each piece, or these
    are dealt into a number of ``states``, as tasks are (``track_tasks``).
    """
    span = F.expr(f"INTERVAL {retention}")
    when = (F.unix_micros("arrived"), F.unix_micros(F.col("arrived") + span))
    part = _part(states, F.col("app_id"), F.col("block"), F.col("piece"))
    ends = e.task_ends(log).filter("app_id IS NOT NULL AND stage_id IS NOT NULL").withColumns({
        "block": F.shiftright("stage_id", STAGE_BITS),
        "piece": F.pmod(F.xxhash64("task_id"), F.lit(pieces)).cast("int"),
    })
    starts = e.job_starts(log, STAGE_BITS).filter("app_id IS NOT NULL AND block IS NOT NULL").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    )
    listed = F.array_join(F.array_distinct("stage_ids").cast("array<string>"), ",")
    # All lines move the clock, not only those that are joined.
    clock = log.select(F.unix_millis("arrived").alias("arrived_ms")).mapInPandas(_newest_arrival(), PACKED)
    rows = _packed(ends, part, "piece", "stage_id", "task_id", *when).unionByName(
        _packed(starts, part, "piece", listed, "job_id", F.unix_micros("start_ts"), *when)
    ).unionByName(_arrived(clock)).withWatermark("arrived", SKEW)
    owned = rows.groupBy("part").applyInPandasWithState(
        _join_ends(), OWNED.replace("TIMESTAMP", "BIGINT"), "ends BINARY", "append", "EventTimeTimeout"
    )
    return owned.withColumns({c: F.timestamp_micros(c) for c in ("job_start", "arrived")})


# A tracked row as a task's state gives it out: times are numbers.
_GIVEN_OUT = TRACKED.replace("ts TIMESTAMP", "ts BIGINT").replace("arrived TIMESTAMP", "arrived BIGINT")
_ARROW = {"STRING": "string", "BIGINT": "int64", "INT": "int32", "DOUBLE": "float64", "BOOLEAN": "bool"}


def _task_state(upload_ms: int, give_up_ms: int, retention_ms: int) -> StatefulProcessor:
    # The class is local, so it travels to the workers by value; they need no copy of this package.
    given_out = Row("rows")
    fields = [(name, _ARROW[kind]) for name, kind in (f.split() for f in _GIVEN_OUT.split(", "))]
    # Places in a task's state.
    stage, job, job_start, ended, given, cpu, mem, expires, usage = range(9)
    flags, earliest = {"true": True, "false": False}, -(2**63)

    def number(text):
        return None if text is None else int(text)

    def rank(start, of_job):
        return start, -1 if of_job is None else of_job

    def newness(v):
        return earliest if v[0] is None else v[0], v[1]

    def table(rows):
        import pyarrow as pa

        schema = pa.schema([(name, pa.type_for_alias(kind)) for name, kind in fields])
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
        return sink.getvalue().to_pybytes()

    class TaskState(StatefulProcessor):
        """The tasks of one state: owner, end, newest value per metric and function, what was given out.

        They are kept as one value with the time of the next timer, so a batch costs one read and one
        write for all tasks of the state.
        """

        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("tasks", "tasks BINARY, timer BIGINT")

        def _save(self, tasks, timer):
            if not tasks:
                self.state.clear()
                return
            due = min(map(self._due, tasks.values()))
            if timer is None or due < timer:
                timer = due
                self.handle.registerTimer(timer)
            self.state.update((pickle.dumps(tasks, pickle.HIGHEST_PROTOCOL), timer))

        def _due(self, s):
            if s[ended] is None or s[given]:
                return s[expires]
            return min(s[expires], s[ended] + (upload_ms if all(self._seen(s)) else give_up_ms))

        def _usage(self, key, s, at, changed, late):
            for k in changed:
                ts, value = s[usage][k]
                yield key[0], s[job], s[stage], key[1], "usage", *k, value, ts, None, 1, late, at

        def _outcomes(self, key, s, at, n, late):
            for metric, present in (("CPU", s[cpu]), ("MEM", s[mem])):
                yield key[0], s[job], s[stage], key[1], "outcome", metric, None, None, None, None, present, n, late, at

        def _ended(self, key, s, at, n):
            yield key[0], s[job], s[stage], key[1], "ended", None, None, None, None, None, None, n, s[given], at

        def _seen(self, s):
            seen = {k[0] for k in s[usage]}
            return ["CPU" in seen, "MEM" in seen]

        def _apply(self, key, s, rows, known):
            at, changed, owner, held = 0, set(), None, s[usage]
            for row in rows:
                at = max(at, int(row[2]))
                if len(row) == 6:  # stage, start and number of the job
                    start, of_job = int(row[4]), number(row[5])
                    if owner is None or rank(start, of_job) > rank(*owner[:2]):
                        owner = start, of_job, number(row[3])
                else:  # metric, function, whether it is the total, time, value
                    k, v = (row[3], row[4], flags.get(row[5])), (number(row[6]), float(row[7] or "nan"))
                    k = known.setdefault(k, k)  # one object, so that it is kept once a state
                    if k not in held or newness(v) > newness(held[k]):
                        held[k] = v
                        changed.add(k)
            s[expires] = max(s[expires], at + retention_ms)
            if owner and (s[ended] is None or rank(*owner[:2]) > rank(s[job_start], s[job])):
                if s[ended] is None:
                    s[ended] = at
                else:  # another job that lists the stage started later
                    yield from self._ended(key, s, at, -1)
                    if s[given]:
                        yield from self._outcomes(key, s, at, -1, True)
                s[job_start], s[job], s[stage] = owner
                yield from self._ended(key, s, at, 1)
                if s[given]:
                    yield from self._outcomes(key, s, at, 1, True)
            if s[given] and changed:
                if self._seen(s) != s[cpu:expires]:
                    yield from self._outcomes(key, s, at, -1, True)
                    s[cpu:expires] = self._seen(s)
                    yield from self._outcomes(key, s, at, 1, True)
                yield from self._usage(key, s, at, sorted(changed, key=repr), True)

        def handleInputRows(self, key, rows, timerValues):
            held = self.state.get()
            tasks, timer = (pickle.loads(held[0]), held[1]) if held else ({}, None)
            news, out = {}, []
            for packed in rows:
                for row in json.loads(packed.rows):
                    news.setdefault((row[0], number(row[1])), []).append(row)
            known = {k: k for s in tasks.values() for k in s[usage]}
            for task, of_task in news.items():
                s = tasks.setdefault(task, [None, None, None, None, False, False, False, 0, {}])
                out += self._apply(task, s, of_task, known)
            self._save(tasks, timer)
            if out:
                yield given_out(table(out))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.state.get()
            if not held or expiredTimerInfo.getExpiryTimeInMs() < held[1]:
                return  # an earlier timer has done its work
            tasks, now, out = pickle.loads(held[0]), timerValues.getCurrentWatermarkInMs(), []
            for task, s in list(tasks.items()):
                if now < self._due(s):
                    continue
                if s[ended] is not None and not s[given]:
                    s[given], s[cpu:expires] = True, self._seen(s)
                    out += self._usage(task, s, now, s[usage], False)
                    out += self._outcomes(task, s, now, 1, False)
                if now >= s[expires]:
                    if not s[given]:  # it never ended: nothing is missing, its usage is what there is
                        out += self._usage(task, s, now, s[usage], False)
                    del tasks[task]
            self._save(tasks, None)
            if out:
                yield given_out(table(out))

        def close(self):
            pass

    return TaskState()


def _pack_rows(most: int):
    def texts(groups):
        return pd.DataFrame(
            [(part, arrived, f"[{','.join(rows)}]") for part, (arrived, rows) in groups.items()],
            columns=["part", "arrived_ms", "rows"],
        )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, n = {}, 0
        for batch in batches:
            for part, arrived, row in zip(*(batch[c].tolist() for c in ("part", "arrived_ms", "row"))):
                group = groups.setdefault(part, [arrived, []])
                if arrived > group[0]:
                    group[0] = arrived
                group[1].append(row)
            n += len(batch)
            if n >= most:
                yield texts(groups)
                groups, n = {}, 0
        if groups:
            yield texts(groups)

    return packed


PACKED = "part BIGINT, arrived_ms BIGINT, rows STRING"


def _part(states: int | None, *key: Column) -> Column:
    """The number of the state that holds a key; one of ``states`` if that is given."""
    part = F.xxhash64(*key)
    return part if states is None else F.pmod(part, F.lit(states).cast("bigint"))


def _arrived(packed: DataFrame) -> DataFrame:
    return packed.withColumn("arrived", F.timestamp_millis("arrived_ms"))


def _packed(rows: DataFrame, part: Column, *fields: str | Column) -> DataFrame:
    """Rows of one state as one text of lists per ``PACK_ROWS`` rows: a state costs as much for one row as for many.

    A list has the application and ``fields`` as texts.
    """
    listed = [F.col(f) if isinstance(f, str) else f for f in ("app_id", *fields)]
    packed = rows.select(
        part.alias("part"), F.coalesce(F.unix_millis("arrived"), F.lit(0).cast("bigint")).alias("arrived_ms"),
        F.to_json(F.array(*[f.cast("string") for f in listed])).alias("row"),
    ).mapInPandas(_pack_rows(PACK_ROWS), PACKED)
    return _arrived(packed)


def track_tasks(
    owned: DataFrame, usage: DataFrame, settings: Settings = Settings(), retention_ms: int = 7 * 86_400_000,
    block_bits: int = BLOCK_BITS, states: int | None = None,
) -> DataFrame:
    """``TRACKED``: what becomes of each task, as a changelog.

    ``owned`` are streamed rows of ``owned_ends``, ``usage`` streamed usage with ``arrived``. A task
    whose end is known gives out an ``ended`` row at once; when both metrics have come, an upload
    interval after its end, else when its wait is over, its newest values (``usage``, by time, then
    value) and an ``outcome`` per metric. Usage of a task that never ends is given out when its state
    is forgotten.

    ``block_bits`` tells how many neighbouring tasks share a state (2 to the power of). A state costs
    about 2 ms a batch besides its rows, so where many tasks land in few batches, blocks are dealt into
    a number of ``states`` that makes them large enough (``states_for``); a stream keeps the numbers
    that it began with.
    """
    state = _task_state(settings.upload_interval_ms, settings.give_up_ms, retention_ms)
    part = _part(states, F.col("app_id"), F.shiftright("task_id", block_bits))
    arrived = F.coalesce(F.unix_millis("arrived"), F.lit(0).cast("bigint"))
    job_start = F.coalesce(F.unix_millis("job_start"), F.lit(-1).cast("bigint"))
    ends = _packed(owned, part, "task_id", arrived, "stage_id", job_start, "job_id")
    landed = usage.filter(F.col("unit") == m.TASK).withColumnRenamed("id", "task_id")
    values = _packed(landed, part, "task_id", arrived, "metric", "udf", "is_total", F.unix_micros("ts"), "value")
    rows = ends.withWatermark("arrived", SKEW).unionByName(values.withWatermark("arrived", SKEW))
    tracked = rows.groupBy("part").transformWithState(state, "rows BINARY", "append", "eventTime")
    return tracked.mapInArrow(_unpack_rows(), _GIVEN_OUT).withColumns(
        {"ts": F.timestamp_micros("ts"), "arrived": F.timestamp_millis("arrived")}
    )


def _unpack_rows():
    def unpacked(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in batch.column(0):
                yield from pa.ipc.open_stream(rows.as_buffer())

    return unpacked


def stream_tracked(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRACKED).parquet(path)


def outcomes(tracked: DataFrame) -> DataFrame:
    """The outcomes that hold: ``app_id, job_id, stage_id, task_id, metric, present``."""
    key = ["app_id", "job_id", "stage_id", "task_id", "metric", "present"]
    return tracked.filter(F.col("kind") == OUTCOME).groupBy(*key).agg(F.sum("n").alias("n")).filter("n > 0").drop("n")


def missing_tasks(tracked: DataFrame) -> DataFrame:
    return outcomes(tracked).filter(~F.col("present")).drop("present")


def newest_usage(tracked: DataFrame) -> DataFrame:
    """The newest value of each task's functions; of equal times the largest."""
    rows = tracked.filter(F.col("kind") == USAGE)
    newest = F.max(F.struct("ts", "value")).alias("newest")
    return rows.groupBy("app_id", "task_id", "metric", "udf", "is_total").agg(newest).select(
        "app_id", "task_id", "metric", "udf", "is_total", "newest.value", "newest.ts"
    )


COUNTS = (
    "app_id STRING, job_id BIGINT, ended_ms BIGINT, tasks BIGINT, outcomes BIGINT, received BIGINT, arrived TIMESTAMP"
)


def _merge_rows():
    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.groupby(["app_id", "job_id"], as_index=False, dropna=False).agg(
                    {"ended_ms": "max", "tasks": "sum", "outcomes": "sum", "received": "sum", "arrived": "max"}
                )

    return merged


def _job_state(upload_ms: int, over_ms: int, retention_ms: int) -> StatefulProcessor:
    report_row = Row(*(field.split()[0] for field in JOB_REPORT.split(", ")))
    # Places in a job's state.
    tasks, outcomes, received, ended, looked, revision, expires, said = range(8)

    class JobState(StatefulProcessor):
        """The jobs of one state: counts, the arrival of the job's end, and the counts of its last report."""

        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("jobs", "jobs BINARY, timer BIGINT")

        def _save(self, jobs, timer):
            if not jobs:
                self.state.clear()
                return
            due = min(map(self._due, jobs.values()))
            if timer is None or due < timer:
                timer = due
                self.handle.registerTimer(timer)
            self.state.update((pickle.dumps(jobs, pickle.HIGHEST_PROTOCOL), timer))

        def _due(self, s):
            if s[ended] is None or s[revision]:
                return s[expires]
            return min(s[expires], s[ended] + (over_ms if s[looked] else upload_ms))

        def _report(self, key, s):
            if s[revision] and s[said] == s[:ended]:
                return
            s[revision] += 1
            s[said] = s[:ended]
            yield report_row(*key, *s[:ended], s[outcomes] >= 2 * s[tasks], s[revision])

        def handleInputRows(self, key, rows, timerValues):
            held = self.state.get()
            jobs, timer = (pickle.loads(held[0]), held[1]) if held else ({}, None)
            news = {}
            for r in rows:
                s = jobs.setdefault((r.app_id, r.job_id), [0, 0, 0, None, False, 0, 0, []])
                s[tasks], s[outcomes], s[received] = s[tasks] + r.tasks, s[outcomes] + r.outcomes, s[received] + r.received
                s[expires] = max(s[expires], r.arrived_ms + retention_ms)
                if r.ended_ms is not None and r.ended_ms >= 0 and s[ended] is None:
                    s[ended] = int(r.ended_ms)
                news[r.app_id, r.job_id] = s
            for job, s in news.items():
                if s[revision]:  # it was reported before
                    yield from self._report(job, s)
            self._save(jobs, timer)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.state.get()
            if not held or expiredTimerInfo.getExpiryTimeInMs() < held[1]:
                return  # an earlier timer has done its work
            jobs, now = pickle.loads(held[0]), timerValues.getCurrentWatermarkInMs()
            for job, s in list(jobs.items()):
                if now < self._due(s):
                    continue
                if s[ended] is not None and not s[revision]:
                    s[looked] = True
                    if now >= s[ended] + over_ms or (now >= s[ended] + upload_ms and s[outcomes] >= 2 * s[tasks]):
                        yield from self._report(job, s)
                if now >= s[expires]:
                    del jobs[job]
            self._save(jobs, None)

        def close(self):
            pass

    return JobState()


def track_jobs(
    log: DataFrame, tracked: DataFrame, settings: Settings = Settings(), retention_ms: int = 7 * 86_400_000,
    states: int | None = None,
) -> DataFrame:
    """``JOB_REPORT``: each ended job, when all its ended tasks have an outcome or its wait is over.

    ``log`` are streamed lines with ``arrived``, ``tracked`` the streamed changelog of tasks, merged
    per job before the shuffle. A job waits an upload interval from the arrival of its end, so that
    counts of its tasks that land with it are in. Counts that change after a report make another
    ``revision``. Jobs that never end and counts that come long after are forgotten. A job has a state
    of its own, or jobs are dealt into a number of ``states``, as tasks are (``track_tasks``).
    """
    zero = F.lit(0).cast("bigint")
    ends = e.job_ends(log.withWatermark("arrived", JOB_SKEW)).select(
        "app_id", "job_id", F.unix_millis("arrived").alias("ended_ms"), zero.alias("tasks"), zero.alias("outcomes"),
        zero.alias("received"), "arrived",
    )
    n = F.col("n").cast("bigint")
    count = lambda test, name: F.when(test, n).otherwise(zero).alias(name)
    counts = tracked.filter(F.col("kind") != USAGE).filter(F.col("job_id").isNotNull()).select(
        "app_id", "job_id", F.lit(-1).cast("bigint").alias("ended_ms"), count(F.col("kind") == ENDED, "tasks"),
        count(F.col("kind") == OUTCOME, "outcomes"),
        count((F.col("kind") == OUTCOME) & F.col("present"), "received"), "arrived",
    ).mapInPandas(_merge_rows(), COUNTS).withWatermark("arrived", JOB_SKEW)
    rows = ends.unionByName(counts).withColumn("arrived_ms", F.unix_millis("arrived"))
    rows = rows.withColumn("part", _part(states, F.col("app_id"), F.col("job_id")))
    over = settings.give_up_ms + 2 * settings.upload_interval_ms + 60_000
    return rows.groupBy("part").transformWithState(
        _job_state(settings.upload_interval_ms, over, retention_ms), JOB_REPORT, "append", "eventTime"
    )


def newest_reports(reports: DataFrame) -> DataFrame:
    fields = F.struct("tasks", "outcomes", "received", "complete")
    last = reports.groupBy("app_id", "job_id").agg(F.max_by(fields, "revision").alias("last"))
    return last.select("app_id", "job_id", "last.*")
