"""

The Spark queries go the whole way: they land JSON profiles, event-log lines and
registrations derived from ``events``, then parse, decode, match and report. The
SQL computes the same results from ``events`` directly and never sees any JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacktally import fixtures as fx
from stacktally import model as m
from stacktally import workspace as w
from stacktally.functions import columns as c
from stacktally.model import Settings
from stacktally.operators import lifecycle as lc
from stacktally.operators import matching, profiles as p, registry as r, report, usage as u
from stacktally.plans import hotspots
from stacktally.sources import eventlog as e
from stacktally.sources import tables
from stacktally.streaming import jobs as sj
from stacktally.streaming import reports, run
from stacktally.streaming import usage as su

try:
    import corpus_pipeline
    from stacktally.llm import queries as llm
except ModuleNotFoundError:  # the operators of a training-data pipeline are an optional part
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
# Low enough for results neither empty nor everything; different per metric.
THRESHOLDS = Settings(cpu_threshold=5.0, mem_threshold=4.0)
RANGE = ("2024-01-10 00:00:00", "2024-01-19 12:00:00")
SERVICE = "spark-app"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = f"WITH {_CTES}\n{sql.strip()}"
        return fn

    return register


def entry(spark: SparkSession) -> DataFrame:
    """The report of all functions over their threshold."""
    return findings_all(spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    more = {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}
    return {**_QUERIES, **more}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **(llm.oracle_sql() if llm else {})}


# --- the expected tables, from the base table --------------------------------

_CTES = f"""
base AS (SELECT {', '.join(fx.BASE_COLUMNS)} FROM events),
registration AS (SELECT {', '.join(fx.REGISTRATION_COLUMNS)} FROM base),
job_start AS (
  SELECT app_id, job_id, epoch_us(min(ts)) // 1000 AS start_ms
  FROM base WHERE NOT ({fx.NO_JOB_EVENT}) GROUP BY app_id, job_id),
job_stage AS (
  SELECT DISTINCT app_id, job_id, stage_id FROM base WHERE NOT ({fx.NO_JOB_EVENT})
  UNION
  SELECT DISTINCT b.app_id, j.job_id, b.stage_id
  FROM base b JOIN job_start j ON j.app_id = b.app_id AND j.job_id = b.job_id + 1
  WHERE b.stage_id % 10 = 0),
job AS (
  SELECT app_id, job_id, start_ms, max(stage_end_ms) AS end_ms, NOT ({fx.RUNNING_JOB}) AS finished
  FROM job_start JOIN job_stage USING (app_id, job_id)
  JOIN (SELECT app_id, stage_id, epoch_us(max(ts)) // 1000 AS stage_end_ms
        FROM base GROUP BY app_id, stage_id) USING (app_id, stage_id)
  GROUP BY app_id, job_id, start_ms),
stage_owner AS (
  SELECT app_id, stage_id, arg_max(job_id, start_ms * 1000 + job_id) AS job_id
  FROM job_stage JOIN job USING (app_id, job_id) GROUP BY app_id, stage_id),
attempted AS (SELECT *, CAST({fx.ATTEMPT} AS BIGINT) AS attempt FROM base WHERE {fx.SUBMITTED}),
stage AS (
  SELECT app_id, stage_id, attempt, epoch_us(min(ts)) // 1000 AS submit_ms
  FROM attempted GROUP BY app_id, stage_id, attempt),
task AS (
  SELECT app_id, stage_id, attempt, task_id, epoch_us(min(ts)) // 1000 AS start_ms,
         epoch_us(max(ts)) // 1000 AS end_ms, NOT ({fx.RUNNING_TASK}) AS ended
  FROM attempted GROUP BY app_id, stage_id, attempt, task_id),
current_task AS (
  SELECT task.* FROM task
  JOIN (SELECT app_id, stage_id, max(attempt) AS attempt FROM stage GROUP BY app_id, stage_id) latest
  USING (app_id, stage_id, attempt)),
slot_cost AS (
  SELECT app_id, job_id, task_id, udf, impl, slot, CAST(sum(cpu_ns) AS BIGINT) AS cpu_ns,
         CAST(sum(mem_bytes) AS BIGINT) AS mem_bytes
  FROM base GROUP BY app_id, job_id, task_id, udf, impl, slot),
slot_metric AS (
  SELECT *, 'CPU' AS metric, '{m.CPU_PROFILE}' AS profile_type, cpu_ns AS raw FROM slot_cost
  UNION ALL
  SELECT *, 'MEM' AS metric, '{m.MEM_PROFILE}' AS profile_type, mem_bytes AS raw FROM slot_cost),
task_span AS (
  SELECT app_id, job_id, task_id, date_trunc('hour', min(ts)) AS h, max(ts) AS last_ts,
         min(slot) < 3 AND max(slot) >= 3 AS has_early
  FROM base WHERE task_id % 17 <> 0 GROUP BY app_id, job_id, task_id),
snapshot AS (
  SELECT app_id, 'task' AS unit, task_id AS id, job_id, 9 AS last_slot, last_ts + INTERVAL 1 SECOND AS ts
  FROM task_span
  UNION ALL
  SELECT app_id, 'task', task_id, job_id, 2, h + INTERVAL 30 MINUTE FROM task_span WHERE has_early
  UNION ALL
  SELECT app_id, 'task', id, job_id, 2, last_ts + INTERVAL 1 SECOND + INTERVAL 70 MINUTE
  FROM (SELECT *, task_id AS id FROM task_span) WHERE has_early AND {fx.SMALLER_LATER}
  UNION ALL
  SELECT app_id, 'job', job_id, job_id, 9, max(ts) + INTERVAL 2 SECOND
  FROM base GROUP BY app_id, job_id),
profile AS (
  SELECT s.*, epoch_us(s.ts) // 1000 AS ts_ms, t.metric, t.profile_type,
         CASE WHEN CAST(substr(app_id, -1) AS INT) % 2 = 0 THEN 'spark-app' ELSE 'etl-app' END
           AS service_name,
         CASE WHEN unit = 'task' AND id % 19 = {fx.BAD_JSON} THEN 'bad_json'
              WHEN unit = 'task' AND id % 19 = {fx.EMPTY} THEN 'empty'
              WHEN unit = 'task' AND id % 19 = {fx.RAGGED} THEN 'ragged_level'
              WHEN unit = 'task' AND id % 19 = {fx.WRONG_TYPE} THEN 'wrong_type'
              WHEN unit = 'job' AND metric = 'CPU' AND {fx.ZERO_TOTAL_CPU} THEN 'zero_total'
         END AS reason,
         CASE WHEN unit = 'job' AND metric = 'MEM' AND {fx.NO_TOTAL_MEM} THEN 'root'
              ELSE 'total' END AS root
  FROM snapshot s
  CROSS JOIN (VALUES ('CPU', '{m.CPU_PROFILE}'), ('MEM', '{m.MEM_PROFILE}')) t(metric, profile_type)
  WHERE NOT (unit = 'job' AND metric = 'MEM' AND {fx.NO_JOB_MEM})),
unit_slot AS (
  SELECT app_id, 'task' AS unit, task_id AS id, metric, udf, impl, slot, raw FROM slot_metric
  UNION ALL
  SELECT app_id, 'job', job_id, metric, udf, impl, slot, CAST(sum(raw) AS BIGINT)
  FROM slot_metric GROUP BY app_id, job_id, metric, udf, impl, slot),
leaf AS (
  SELECT p.app_id, p.profile_type, p.metric, p.unit, p.id, p.ts_ms, p.root, s.udf, s.impl, s.slot, s.raw
  FROM profile p JOIN unit_slot s
    ON s.app_id = p.app_id AND s.unit = p.unit AND s.id = p.id AND s.metric = p.metric
       AND s.slot <= p.last_slot
  WHERE p.reason IS NULL),
maxima AS (
  SELECT app_id, profile_type, metric, unit, id, ts_ms, udf, FALSE AS is_total, max(raw) AS raw
  FROM leaf GROUP BY app_id, profile_type, metric, unit, id, ts_ms, udf
  UNION ALL
  SELECT app_id, profile_type, metric, unit, id, ts_ms, NULL, TRUE, CAST(sum(raw) AS BIGINT)
  FROM leaf WHERE root = 'total' GROUP BY app_id, profile_type, metric, unit, id, ts_ms),
latest AS (
  SELECT app_id, profile_type, metric, unit, id, udf, is_total, arg_max(raw, ts_ms) AS raw,
         max(ts_ms) AS ts_ms
  FROM maxima GROUP BY app_id, profile_type, metric, unit, id, udf, is_total),
usage AS (
  SELECT *, CAST(raw AS DOUBLE) / CASE metric WHEN 'CPU' THEN CAST(1000000000 AS DOUBLE)
                                  ELSE CAST(1048576 AS DOUBLE) END AS value FROM latest),
total AS (
  SELECT app_id, id AS job_id, metric, value AS job_total FROM usage WHERE unit = 'job' AND is_total),
expected AS (
  SELECT app_id, job_id, stage_id, t.task_id, t.ended, metric, job_total
  FROM job_stage JOIN (SELECT app_id, job_id FROM job WHERE finished) USING (app_id, job_id)
  JOIN total USING (app_id, job_id)
  JOIN current_task t USING (app_id, stage_id)),
task_usage AS (
  SELECT app_id, id AS task_id, metric, udf, is_total, value FROM usage WHERE unit = 'task'),
share AS (
  SELECT e.app_id, e.job_id, e.stage_id, e.task_id, e.metric, u.udf, u.is_total, u.value,
         e.job_total, u.value / e.job_total * 100 AS pct
  FROM expected e JOIN task_usage u
    ON u.app_id = e.app_id AND u.task_id = e.task_id AND u.metric = e.metric
  WHERE e.ended),
finding AS (
  SELECT share.* EXCLUDE (is_total), impl,
         printf('[%s] job %d -> stage %d -> task %d: %s at %s: %.2f%%, %.2f%s/%.2f%s',
                metric, job_id, stage_id, task_id, udf, impl, round(pct, 2),
                round(value, 2), CASE metric WHEN 'CPU' THEN 's' ELSE 'MB' END,
                round(job_total, 2), CASE metric WHEN 'CPU' THEN 's' ELSE 'MB' END) AS message
  FROM share JOIN (SELECT DISTINCT app_id, udf, impl FROM base) USING (app_id, udf)
  WHERE NOT is_total
    AND pct >= CASE metric WHEN 'CPU' THEN {THRESHOLDS.cpu_threshold} ELSE {THRESHOLDS.mem_threshold} END),
missing AS (
  SELECT app_id, job_id, stage_id, task_id, metric,
         printf('[%s] Task data is missing: job %d, stage %d, task %d',
                metric, job_id, stage_id, task_id) AS message
  FROM expected e
  WHERE NOT ended OR NOT EXISTS (
    SELECT 1 FROM task_usage u
    WHERE u.app_id = e.app_id AND u.task_id = e.task_id AND u.metric = e.metric)),
resolved AS (
  SELECT app_id, udf, seq, impl, origin FROM (
    SELECT *, row_number() OVER (
      PARTITION BY app_id, udf
      ORDER BY origin = 'ddl', CASE WHEN origin = 'ddl' THEN seq ELSE -seq END) AS rn
    FROM registration) WHERE rn = 1)
"""


def _ms(column: str):
    return F.unix_millis(column)


def _usage(land: fx.Landing, **only: str) -> DataFrame:
    """Usage of the chosen unit or profile type; both prune the scan."""
    profiles = land.profiles
    for column, value in only.items():
        profiles = profiles.filter(F.col(column) == value)
    return hotspots.task_usage(profiles, land.registry)


def _report(spark: SparkSession, sf_dir: str) -> hotspots.Report:
    land = fx.land(spark, sf_dir)
    log = e.land_events(land.log)
    return hotspots.find_hotspots(
        land.profiles, e.job_events(log), e.stage_events(log), e.task_events(log),
        land.registry, THRESHOLDS,
    )


def _owners(log: DataFrame) -> DataFrame:
    return lc.stage_to_job(lc.job_stages(e.job_events(log)))


def _shares(spark: SparkSession, sf_dir: str, metric_type: str | None = None) -> DataFrame:
    land = fx.land(spark, sf_dir)
    only = {"profile_type": metric_type} if metric_type else {}
    usage = w.publish(_usage(land, **only), "usage", partition_by=["unit"])
    log = e.land_events(land.log)
    expected = hotspots.expected_of(
        e.job_events(log), e.stage_events(log), e.task_events(log), usage
    )
    return report.usage_share(expected, usage)


# --- sources ------------------------------------------------------------------

@query("SELECT app_id, service_name, profile_type, unit, id, job_id, ts_ms FROM profile")
def profiles_scan(spark, sf_dir):
    return fx.land(spark, sf_dir).profiles.select(
        "app_id", "service_name", "profile_type", "unit", "id", "job_id", _ms("ts").alias("ts_ms")
    )


@query("""
SELECT app_id, job_id, start_ms, CASE WHEN finished THEN end_ms END AS end_ms,
       CASE WHEN finished THEN CASE WHEN job_id % 4 = 0 THEN 'JobFailed' ELSE 'JobSucceeded' END
       END AS result,
       (SELECT count(*) FROM job_stage s WHERE s.app_id = job.app_id AND s.job_id = job.job_id)
         AS n_stages
FROM job
""")
def job_events(spark, sf_dir):
    return e.job_events(fx.land(spark, sf_dir).log).select(
        "app_id", "job_id", _ms("start_ts").alias("start_ms"), _ms("end_ts").alias("end_ms"),
        "result", F.size("stage_ids").cast("bigint").alias("n_stages"),
    )


@query("SELECT app_id, stage_id, attempt, submit_ms FROM stage")
def stage_events(spark, sf_dir):
    return e.stage_events(fx.land(spark, sf_dir).log).select(
        "app_id", "stage_id", "attempt", _ms("submit_ts").alias("submit_ms")
    )


@query("""
SELECT app_id, stage_id, attempt, task_id, start_ms, CASE WHEN ended THEN end_ms END AS end_ms,
       CASE WHEN ended THEN 'Success' END AS reason
FROM task
""")
def task_events(spark, sf_dir):
    return e.task_events(fx.land(spark, sf_dir).log).select(
        "app_id", "stage_id", "attempt", "task_id", _ms("start_ts").alias("start_ms"),
        _ms("end_ts").alias("end_ms"), "reason",
    )


@query("""
SELECT app_id, concat('name of ', app_id) AS app_name, epoch_us(min(ts)) // 1000 AS start_ms,
       epoch_us(min(ts)) // 1000000 AS start_epoch
FROM base GROUP BY app_id
""")
def app_start(spark, sf_dir):
    return e.app_start(fx.land(spark, sf_dir).log).select(
        "app_id", "app_name", _ms("start_ts").alias("start_ms"), "start_epoch"
    )


@query("""
SELECT app_id, udf, impl, 'udf' AS origin, min(event_id) AS seq FROM base
GROUP BY app_id, udf, impl
""")
def registry_scan(spark, sf_dir):
    return fx.land(spark, sf_dir).registry


# --- projections and filters ----------------------------------------------------

@query(f"""
SELECT app_id, id, ts_ms FROM profile
WHERE metric = 'CPU' AND service_name = '{SERVICE}' AND unit = 'task'
""")
def label_select(spark, sf_dir):
    profiles = fx.land(spark, sf_dir).profiles
    return p.select_profiles(profiles, m.CPU_PROFILE, SERVICE, m.TASK).select(
        "app_id", "id", _ms("ts").alias("ts_ms")
    )


@query(f"""
SELECT app_id, profile_type, unit, id, ts_ms FROM profile
WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts <= TIMESTAMP '{RANGE[1]}'
""")
def time_range(spark, sf_dir):
    return p.in_range(fx.land(spark, sf_dir).profiles, *RANGE).select(
        "app_id", "profile_type", "unit", "id", _ms("ts").alias("ts_ms")
    )


@query(f"""
SELECT app_id, profile_type, unit, id, ts_ms FROM profile
JOIN (SELECT app_id, min(ts) AS start_ts FROM base GROUP BY app_id) USING (app_id)
WHERE ts >= start_ts AND ts <= TIMESTAMP '{RANGE[1]}'
""")
def time_range_from_start(spark, sf_dir):
    land = fx.land(spark, sf_dir)
    return p.since_app_start(land.profiles, e.app_start(land.log), RANGE[1]).select(
        "app_id", "profile_type", "unit", "id", _ms("ts").alias("ts_ms")
    )


@query("""
SELECT app_id, profile_type, unit, id, ts_ms,
       (SELECT 2 + count(*) FROM unit_slot s
        WHERE s.app_id = p.app_id AND s.unit = p.unit AND s.id = p.id AND s.metric = p.metric
          AND s.slot <= p.last_slot) AS n_names
FROM profile p WHERE reason IS NULL
""")
def valid_profiles(spark, sf_dir):
    return p.valid_profiles(fx.land(spark, sf_dir).profiles).select(
        "app_id", "profile_type", "unit", "id", _ms("ts").alias("ts_ms"),
        F.size("names").cast("bigint").alias("n_names"),
    )


@query("""
SELECT app_id, profile_type, unit, id, ts_ms,
       CASE WHEN reason IS NULL THEN 'no_total' ELSE reason END AS reason
FROM profile WHERE reason IS NOT NULL OR root = 'root'
""")
def rejected_profiles(spark, sf_dir):
    return _report(spark, sf_dir).rejected.select(
        "app_id", "profile_type", "unit", "id", _ms("ts").alias("ts_ms"), "reason"
    )


def _over(spark, sf_dir, profile_type):
    shares = _shares(spark, sf_dir, profile_type)
    return report.over_threshold(
        shares, THRESHOLDS.cpu_threshold, THRESHOLDS.mem_threshold
    ).select("app_id", "job_id", "stage_id", "task_id", "udf", "value", "job_total", "pct")


@query("""
SELECT app_id, job_id, stage_id, task_id, udf, value, job_total, pct FROM finding
WHERE metric = 'CPU'
""")
def threshold_cpu(spark, sf_dir):
    return _over(spark, sf_dir, m.CPU_PROFILE)


@query("""
SELECT app_id, job_id, stage_id, task_id, udf, value, job_total, pct FROM finding
WHERE metric = 'MEM'
""")
def threshold_mem(spark, sf_dir):
    return _over(spark, sf_dir, m.MEM_PROFILE)


# --- decoding and matching --------------------------------------------------------

@query("""
SELECT app_id, profile_type, unit, id, ts_ms, CAST(2 AS INTEGER) AS depth,
       raw AS total, raw AS self, replace(impl, '.', '/') || '$' || slot || '.call' AS frame
FROM leaf
UNION ALL
SELECT app_id, profile_type, unit, id, ts_ms, depth, CAST(sum(raw) AS BIGINT), 0,
       CASE depth WHEN 0 THEN root ELSE 'java/lang/Thread.run' END
FROM leaf CROSS JOIN (VALUES (0), (1)) d(depth)
GROUP BY app_id, profile_type, unit, id, ts_ms, root, depth
""")
def decode_frames(spark, sf_dir):
    return p.decode_frames(p.valid_profiles(fx.land(spark, sf_dir).profiles)).select(
        "app_id", "profile_type", "unit", "id", _ms("ts").alias("ts_ms"), "depth", "total",
        "self", "frame",
    )


@query("""
SELECT DISTINCT app_id, replace(impl, '.', '/') || '$' || slot || '.call' AS frame, udf, impl
FROM base
""")
def frame_match(spark, sf_dir):
    land = fx.land(spark, sf_dir)
    classes = hotspots.measured_classes(r.resolve_registry(land.registry))
    return matching.match_frames(p.frame_names(land.profiles), classes)


@query("""
SELECT app_id, metric, unit, id, ts_ms, udf, is_total, raw FROM maxima
""")
def inclusive_max(spark, sf_dir):
    land = fx.land(spark, sf_dir)
    frames = hotspots.attributed_frames(p.parse_once(land.profiles), r.resolve_registry(land.registry))
    return u.inclusive_max(frames).select(
        "app_id", "metric", "unit", "id", _ms("ts").alias("ts_ms"), "udf", "is_total", "raw"
    )


@query("SELECT app_id, metric, unit, id, udf, is_total, raw, ts_ms FROM latest")
def latest_usage(spark, sf_dir):
    land = fx.land(spark, sf_dir)
    frames = hotspots.attributed_frames(p.parse_once(land.profiles), r.resolve_registry(land.registry))
    return u.latest_usage(u.inclusive_max(frames)).select(
        "app_id", "metric", "unit", "id", "udf", "is_total", "raw", _ms("ts").alias("ts_ms")
    )


@query("SELECT app_id, job_id, metric, job_total FROM total")
def job_total(spark, sf_dir):
    return u.job_total(_usage(fx.land(spark, sf_dir), unit=m.JOB))


def _task_usage(spark, sf_dir, profile_type):
    usage = _usage(fx.land(spark, sf_dir), unit=m.TASK, profile_type=profile_type)
    return report.task_rows(usage).select("app_id", "task_id", "udf", "is_total", "value")


@query("SELECT app_id, task_id, udf, is_total, value FROM task_usage WHERE metric = 'CPU'")
def task_usage_cpu(spark, sf_dir):
    return _task_usage(spark, sf_dir, m.CPU_PROFILE)


@query("SELECT app_id, task_id, udf, is_total, value FROM task_usage WHERE metric = 'MEM'")
def task_usage_mem(spark, sf_dir):
    return _task_usage(spark, sf_dir, m.MEM_PROFILE)


@query("""
SELECT app_id, unit, id, metric, count(udf) AS n_functions,
       string_agg(udf, ',' ORDER BY udf) AS functions,
       max(CASE WHEN udf LIKE 'click%' THEN value END) AS click_value,
       max(CASE WHEN is_total THEN value END) AS total
FROM usage GROUP BY app_id, unit, id, metric
""")
def usage_map(spark, sf_dir):
    keys = F.map_keys("usage")
    return u.usage_map(_usage(fx.land(spark, sf_dir))).select(
        "app_id", "unit", "id", "metric", F.size("usage").cast("bigint").alias("n_functions"),
        F.when(F.size("usage") > 0, F.array_join(keys, ",")).alias("functions"),
        F.get(
            F.map_values(F.map_filter("usage", lambda k, v: k.startswith("click"))), F.lit(0)
        ).alias("click_value"),
        "total",
    )


# --- lifecycle --------------------------------------------------------------------

@query("SELECT app_id, job_id, stage_id FROM job_stage")
def job_stages(spark, sf_dir):
    jobs = e.job_events(fx.land(spark, sf_dir).log)
    return lc.job_stages(jobs).select("app_id", "job_id", "stage_id")


@query("SELECT app_id, stage_id, job_id FROM stage_owner")
def stage_to_job(spark, sf_dir):
    return _owners(fx.land(spark, sf_dir).log)


@query("""
SELECT app_id, job_id, string_agg(CAST(stage_id AS VARCHAR), ',' ORDER BY stage_id) AS stage_ids
FROM job_stage GROUP BY app_id, job_id
""")
def stages_of_job(spark, sf_dir):
    jobs = e.job_events(fx.land(spark, sf_dir).log)
    return lc.stages_of_job(jobs).withColumn("stage_ids", F.array_join("stage_ids", ","))


@query("SELECT app_id, stage_id, attempt, task_id FROM current_task")
def tasks_of_stage(spark, sf_dir):
    log = fx.land(spark, sf_dir).log
    return lc.tasks_of_stage(e.stage_events(log), e.task_events(log)).select(
        "app_id", "stage_id", "attempt", "task_id"
    )


@query("""
SELECT task.app_id, task.stage_id, task.task_id, stage_owner.job_id
FROM task JOIN stage_owner USING (app_id, stage_id)
""")
def task_to_job(spark, sf_dir):
    log = fx.land(spark, sf_dir).log
    return lc.known_tasks(lc.task_to_job(e.task_events(log), _owners(log))).select(
        "app_id", "stage_id", "task_id", "job_id"
    )


@query("""
SELECT b.event_id, b.app_id, CAST(o.job_id AS VARCHAR) AS job, CAST(b.stage_id AS VARCHAR) AS stage,
       CAST(b.task_id AS VARCHAR) AS task
FROM base b LEFT JOIN stage_owner o ON o.app_id = b.app_id AND o.stage_id = b.stage_id
""")
def label_samples(spark, sf_dir):
    samples = fx.read_base(spark, sf_dir).select("event_id", "app_id", "stage_id", "task_id")
    labelled = lc.label_samples(samples, _owners(fx.land(spark, sf_dir).log))
    return labelled.select(
        "event_id", "app_id", *[F.col("labels")[k].alias(k) for k in ("job", "stage", "task")]
    )


@query("""
SELECT job.app_id, job.job_id, count(t.task_id) AS expected, count(seen.task_id) AS received,
       count(t.task_id) = count(seen.task_id) AS complete
FROM job LEFT JOIN stage_owner o ON o.app_id = job.app_id AND o.job_id = job.job_id
LEFT JOIN task t ON t.app_id = o.app_id AND t.stage_id = o.stage_id AND t.ended
LEFT JOIN (SELECT app_id, task_id FROM task_usage GROUP BY app_id, task_id
           HAVING count(DISTINCT metric) = 2) seen
  ON seen.app_id = t.app_id AND seen.task_id = t.task_id
GROUP BY job.app_id, job.job_id
""")
def task_completeness(spark, sf_dir):
    land = fx.land(spark, sf_dir)
    return lc.task_completeness(
        e.job_events(land.log), e.task_events(land.log), _owners(land.log),
        _usage(land, unit=m.TASK),
    )


# --- registry ---------------------------------------------------------------------

@query("SELECT app_id, seq, udf, impl, origin FROM registration")
def registry_union(spark, sf_dir):
    rows = fx.registrations(fx.read_base(spark, sf_dir))
    api, aggregators, ddl = (
        rows.filter(F.col("origin") == o).drop("origin") for o in ("udf", "udaf", "ddl")
    )
    return r.union_origins(api, aggregators, ddl)


@query("SELECT app_id, udf, seq, impl, origin FROM resolved")
def registry_resolve(spark, sf_dir):
    return r.resolve_registry(fx.registrations(fx.read_base(spark, sf_dir)))


@query("SELECT app_id, impl, arg_max(udf, seq) AS udf FROM resolved GROUP BY app_id, impl")
def impl_to_udf(spark, sf_dir):
    return r.impl_to_udf(r.resolve_registry(fx.registrations(fx.read_base(spark, sf_dir))))


@query("""
SELECT app_id, seq, udf, impl, origin, replace(impl, '.', '/') AS impl_path FROM registration
""")
def impl_path(spark, sf_dir):
    return r.with_impl_path(fx.registrations(fx.read_base(spark, sf_dir)))


# --- scalar functions over whole tables ----------------------------------------------

@query("SELECT event_id, CAST(cpu_ns AS DOUBLE) / CAST(1000000000 AS DOUBLE) AS seconds FROM base")
def cpu_seconds(spark, sf_dir):
    rows = fx.read_base(spark, sf_dir)
    return rows.select("event_id", c.cpu_seconds(F.col("cpu_ns")).alias("seconds"))


@query("SELECT event_id, CAST(mem_bytes AS DOUBLE) / CAST(1048576 AS DOUBLE) AS mib FROM base")
def mem_mib(spark, sf_dir):
    rows = fx.read_base(spark, sf_dir)
    return rows.select("event_id", c.mem_mib(F.col("mem_bytes")).alias("mib"))


@query("""
SELECT app_id, profile_type, unit, id, ts_ms,
       profile_type || '{service_name="' || service_name || '",' || unit || '="' || id || '"}'
         AS selector
FROM profile
""")
def selector_text(spark, sf_dir):
    selector = c.selector_text(*map(F.col, ("profile_type", "service_name", "unit", "id")))
    return fx.land(spark, sf_dir).profiles.select(
        "app_id", "profile_type", "unit", "id", _ms("ts").alias("ts_ms"), selector.alias("selector")
    )


# --- streams ----------------------------------------------------------------------

class _Feed:
    """Folders that the steps of a stream are landed in, and the streams that every step drains."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root = spark, w.new_path(spark, "stream")
        self.landing = fx.land(spark, sf_dir)
        self.profiles, self.lines = f"{self.root}/profiles", f"{self.root}/lines"
        self.usage, self.tracked_path = f"{self.root}/usage", f"{self.root}/tracked"
        self.states = sj.states_for(self.landing.log.count())

    def steps(self):
        for profiles, lines, arrived in fx.stream_steps(self.spark, self.landing):
            tables.write_profiles(profiles, self.profiles, mode="append")
            lines.withColumn("arrived", arrived).write.mode("append").parquet(self.lines)
            stream = tables.stream_profiles(self.spark, self.profiles)
            self.drain(su.usage_writer(stream, self.landing.registry, self.usage, arrived=arrived), "land")
            owned = self.drain_to_files(sj.owned_ends(self.log(), states=self.states), "owned", keyed=True)
            self.drain_to_files(
                sj.track_tasks(
                    self.spark.readStream.schema(sj.OWNED).parquet(owned), su.stream_usage(self.spark, self.usage),
                    block_bits=11, states=self.states,  # a step lands half of all tasks at once
                ),
                "tracked", keyed=True,
            )
            yield

    def drain(self, writer, name: str, keyed: bool = False, stateful: bool = False) -> None:
        run.drain(writer, f"{self.root}/checkpoint/{name}", keyed, stateful)

    def drain_to_files(self, rows: DataFrame, name: str, keyed: bool = False) -> str:
        path = f"{self.root}/{name}"
        self.drain(run.to_files(rows, path), name, keyed, stateful=True)
        return path

    def log(self) -> DataFrame:
        return self.spark.readStream.schema(m.LOG_LINE + ", arrived TIMESTAMP").parquet(self.lines)

    def tracked(self) -> DataFrame:
        rows = self.spark.read.schema(sj.TRACKED).parquet(self.tracked_path)
        return rows.filter(F.col("app_id") != fx.END_APP)


@query("SELECT app_id, task_id, metric, udf, is_total, value FROM task_usage")
def stream_task_usage(spark, sf_dir):
    feed = _Feed(spark, sf_dir)
    for _ in feed.steps():
        pass
    return sj.newest_usage(feed.tracked()).drop("ts")


@query("""
SELECT t.app_id, o.job_id, t.stage_id, t.task_id, metric
FROM task t JOIN stage_owner o USING (app_id, stage_id)
CROSS JOIN (VALUES ('CPU'), ('MEM')) v(metric)
WHERE t.ended AND NOT EXISTS (
  SELECT 1 FROM task_usage u
  WHERE u.app_id = t.app_id AND u.task_id = t.task_id AND u.metric = v.metric)
""")
def stream_missing(spark, sf_dir):
    feed = _Feed(spark, sf_dir)
    for _ in feed.steps():
        pass
    return sj.missing_tasks(feed.tracked())


@query("""
SELECT job.app_id, job.job_id, count(t.task_id) AS tasks, 2 * count(t.task_id) AS outcomes,
       CAST(coalesce(sum(seen.n), 0) AS BIGINT) AS received, TRUE AS complete
FROM job LEFT JOIN stage_owner o ON o.app_id = job.app_id AND o.job_id = job.job_id
LEFT JOIN task t ON t.app_id = o.app_id AND t.stage_id = o.stage_id AND t.ended
LEFT JOIN (SELECT app_id, task_id, count(DISTINCT metric) AS n FROM task_usage
           GROUP BY app_id, task_id) seen
  ON seen.app_id = t.app_id AND seen.task_id = t.task_id
WHERE job.finished GROUP BY job.app_id, job.job_id
""")
def stream_job_report(spark, sf_dir):
    feed = _Feed(spark, sf_dir)
    for _ in feed.steps():
        tracked = sj.stream_tracked(spark, feed.tracked_path)
        rows = sj.track_jobs(feed.log(), tracked, states=feed.states)
        path = feed.drain_to_files(rows, "reports", keyed=True)
    reported = spark.read.schema(sj.JOB_REPORT).parquet(path).filter(F.col("app_id") != fx.END_APP)
    return sj.newest_reports(reported)


def _streamed_reports(spark: SparkSession, sf_dir: str) -> reports.Store:
    """Applications land in two halves that mix all times; the first half with only some of its
    profiles, the rest of those comes with the other half. All six kinds of events come from the
    stream. Both steps report every job that has ended so far, so some jobs twice."""
    landing = fx.land(spark, sf_dir)
    root = w.new_path(spark, "reports")
    store = reports.Store(spark, root).create()
    profiles, lines = f"{root}/in/profiles", f"{root}/in/lines"
    first = F.pmod(F.xxhash64("app_id"), F.lit(2)) == 0
    early = first & (F.pmod("id", F.lit(2)) == 0)
    for step, (of_lines, of_profiles) in enumerate([(first, early), (~first, ~early)]):
        tables.write_profiles(landing.profiles.filter(of_profiles), profiles, mode="append")
        landing.log.filter(of_lines).write.mode("append").parquet(lines)
        stream = tables.stream_profiles(spark, profiles)
        arrived, hour = F.lit(fx.ARRIVALS[step]).cast("timestamp"), F.make_dt_interval(hours=F.lit(1))
        writer = su.usage_writer(stream, landing.registry, store.path("usage"), arrived=arrived)
        run.drain(writer, f"{root}/ck/usage")
        stream = spark.readStream.schema(m.LOG_LINE).parquet(lines)
        run.drain(reports.event_writer(stream, store, arrived), f"{root}/ck/events")
        reports.report_due(store, landing.registry, step, THRESHOLDS, arrived + hour)
    return store


@query("""
SELECT app_id, job_id, stage_id, task_id, metric, udf, impl, value, job_total, pct, message
FROM finding
""")
def stream_findings(spark, sf_dir):
    return reports.newest(_streamed_reports(spark, sf_dir), "findings")


@query("SELECT app_id, job_id, stage_id, task_id, metric, message FROM missing")
def stream_missing_report(spark, sf_dir):
    return reports.newest(_streamed_reports(spark, sf_dir), "missing")


@query("""
SELECT app_id, stage_id, attempt, task_id, start_ms, CASE WHEN ended THEN end_ms END AS end_ms,
       CASE WHEN ended THEN 'Success' END AS reason
FROM task
""")
def stream_log_lines(spark, sf_dir):
    """Text logs that grow: a first file whose last lines are half written, a rolled second one, and
    one application's compacted file that repeats both."""
    lines = fx.land(spark, sf_dir).log.withColumn("app", F.col("app_id"))
    root = w.new_path(spark, "logs")
    store = reports.Store(spark, f"{root}/store").create()
    key = F.pmod(F.xxhash64("app_id", "value"), F.lit(100))
    half = F.when(key == 0, F.substring("value", F.lit(1), (F.length("value") / 2).cast("int"))).otherwise(F.col("value"))
    some_app = F.pmod(F.xxhash64("app_id"), F.lit(3)) == 0
    written = [
        lines.filter(key < 60).withColumn("value", half),
        lines.filter((key >= 50) | (key == 0)),
        lines.filter(some_app),
    ]
    path = F.col("_metadata.file_path")
    for batch, part in enumerate(written):
        # A log is a few files, not one for each task that derives its lines.
        part.select("app", "value").hint("rebalance", "app").write.mode("append").partitionBy("app").text(f"{root}/in")
        reports.land_log(store, f"{root}/in", batch, F.regexp_extract(path, "/app=([^/]+)/", 1))
    return e.task_events(reports.merged_events(store.read("events").drop("batch"))).select(
        "app_id", "stage_id", "attempt", "task_id", _ms("start_ts").alias("start_ms"),
        _ms("end_ts").alias("end_ms"), "reason",
    )


# --- reports ----------------------------------------------------------------------

@query("SELECT app_id, job_id, stage_id, task_id, metric, udf, is_total, value, job_total, pct FROM share")
def usage_share(spark, sf_dir):
    return _shares(spark, sf_dir)


@query("""
SELECT app_id, job_id, stage_id, task_id, metric, udf, impl, value, job_total, pct, message
FROM finding
""")
def findings_all(spark, sf_dir):
    return _report(spark, sf_dir).findings


@query("SELECT app_id, job_id, stage_id, task_id, metric, udf, impl FROM finding")
def finding_impl(spark, sf_dir):
    land = fx.land(spark, sf_dir)
    found = report.over_threshold(
        _shares(spark, sf_dir), THRESHOLDS.cpu_threshold, THRESHOLDS.mem_threshold
    )
    return report.with_impl(found, r.resolve_registry(land.registry)).select(
        "app_id", "job_id", "stage_id", "task_id", "metric", "udf", "impl"
    )


@query("SELECT app_id, task_id, job_id, metric, message FROM finding")
def finding_message(spark, sf_dir):
    path = w.new_path(spark, "findings")
    found = findings_all(spark, sf_dir)
    for _ in range(2):  # a run that is repeated leaves each row once
        tables.write_findings(found, path, "nightly")
    return tables.read_report(spark, path).select("app_id", "task_id", "job_id", "metric", "message")


@query("SELECT app_id, job_id, stage_id, task_id, metric, message FROM missing")
def missing_profiles(spark, sf_dir):
    path = w.new_path(spark, "missing")
    tables.write_missing(_report(spark, sf_dir).missing, path, "nightly")
    return tables.read_report(spark, path).drop("run")
