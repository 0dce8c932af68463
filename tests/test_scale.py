"""Results under skew and partitioning, and the shape of the plans."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stacktally import fixtures as fx
from stacktally import model as m
from stacktally import workspace as w
from stacktally.model import Settings
from stacktally.operators import matching, profiles as p, registry as r, usage as u
from stacktally.plans import hotspots
from stacktally.sources import eventlog as e

LOW = Settings(cpu_threshold=2.0, mem_threshold=2.0)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def report_of(profiles, log, registry):
    return hotspots.find_hotspots(
        profiles, e.job_events(log), e.stage_events(log), e.task_events(log), registry, LOW
    )


def test_row_order_and_partitions_do_not_matter(landing):
    log = e.land_events(landing.log)
    plain = report_of(landing.profiles, log, landing.registry)
    mixed = report_of(
        landing.profiles.repartition(13, F.rand(1)), log.repartition(3, F.rand(2)),
        landing.registry.orderBy(F.rand(3)),
    )
    for a, b in ((plain.findings, mixed.findings), (plain.missing, mixed.missing)):
        assert sorted(a.collect()) == sorted(b.collect())


def test_one_job_and_stage_with_most_rows(spark, sf_dir):
    """A third of all events moved to one user's hour: the same answer by brute force."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hot = F.col("event_id") % 3 == 0
    skewed = events.withColumn("user_id", F.when(hot, 8).otherwise(F.col("user_id"))).withColumn(
        "ts", F.when(hot, F.expr("TIMESTAMP_NTZ '2024-01-05 07:10:00'")).otherwise(F.col("ts"))
    )
    rows = fx.base(skewed).drop("hour").cache()
    usage = hotspots.task_usage(fx.profiles(rows), fx.registry_rows(rows))
    got = {
        (r_.id, r_.metric, r_.udf): r_.value
        for r_ in usage.filter("unit = 'job' AND NOT is_total").collect()
    }
    slots = {}
    for row in rows.collect():
        for metric, raw in (("CPU", row.cpu_ns), ("MEM", row.mem_bytes)):
            if metric == "CPU" and row.job_id % 10 == 3 or metric == "MEM" and row.job_id % 10 == 7:
                continue
            key = (row.job_id, metric, row.udf, row.slot)
            slots[key] = slots.get(key, 0) + raw
    want = {}
    for (job, metric, udf, _), raw in slots.items():
        value = raw / (1e9 if metric == "CPU" else 1048576.0)
        want[job, metric, udf] = max(value, want.get((job, metric, udf), value))
    assert got == want
    rows.unpersist()


def test_salted_and_broadcast_attribution_agree(landing):
    classes = w.measure(r.impl_to_udf(r.resolve_registry(landing.registry)), matching.shortest_path())
    dictionary = w.measure(matching.match_frames(p.frame_names(landing.profiles), classes))
    frames = p.decode_frames(p.valid_profiles(landing.profiles))
    small = matching.attribute(frames, dictionary)
    large = matching.attribute(frames, dictionary, limit=0)
    assert "_salt" in plan_of(large) and "_salt" not in plan_of(small)
    assert sorted(u.inclusive_max(small).collect(), key=repr) == sorted(
        u.inclusive_max(large).collect(), key=repr
    )


def test_selector_prunes_partitions_and_columns(landing):
    df = p.select_profiles(landing.profiles, m.CPU_PROFILE, "spark-app", m.TASK).select("app_id", "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(profile_type" in plan and "unit" in plan
    assert "EqualTo(service_name,spark-app)" in plan
    assert "body" not in plan.split("ReadSchema")[1]


def test_job_totals_read_job_profiles_only(landing):
    usage = hotspots.task_usage(landing.profiles, landing.registry)
    plan = u.job_total(usage)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "levels" in line)
    assert "unit" in scan.split("PartitionFilters")[1].split("]")[0]


def test_maxima_are_merged_before_the_shuffle(landing):
    usage = hotspots.task_usage(landing.profiles, landing.registry)
    plan = usage._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(struct(ts" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def scans_of(df):
    return [line for line in plan_of(df).splitlines() if "FileScan parquet" in line]


def test_bodies_are_read_and_parsed_once(landing, monkeypatch):
    """One table is written from the bodies, by one parse; nothing after it reads a body."""
    written, publish = {}, w.publish

    def record(df, name, *args, **kwargs):
        written[name] = plan_of(df).split("== Physical Plan ==")[1]
        return publish(df, name, *args, **kwargs)

    monkeypatch.setattr(w, "publish", record)
    report = report_of(landing.profiles, e.land_events(landing.log), landing.registry)
    assert {name: plan.count("from_json") for name, plan in written.items() if "from_json" in plan and name != "events"} == {"parsed": 1}
    for df in (report.findings, report.missing, report.rejected):
        assert "from_json" not in plan_of(df)
        assert not any("body" in scan or "levels" in scan for scan in scans_of(df))
    assert sum(report.parsed.rejects.values()) == report.parsed.rejected.count() > 0


def test_frames_are_reduced_inside_the_row(landing):
    """The rows that a profile is spread into are its names in use, not its frames."""
    valid = p.parse_once(landing.profiles).valid
    frames = p.decode_frames(valid).filter("frame IS NOT NULL").groupBy(*m.PROFILE_KEY, "frame")
    slow = frames.agg(F.max("total").alias("total"))
    fast = p.largest_frames(valid)
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
    thrice = valid.withColumn("levels", F.concat("levels", "levels", "levels"))
    assert p.largest_frames(thrice).count() == fast.count() < p.decode_frames(thrice).count()
    generate = next(line for line in plan_of(fast).split("== Physical Plan ==")[1].splitlines() if "Generate inline" in line)
    assert "names#" not in generate.split("], ")[-2] + generate.split("], ")[-1]


def test_no_nested_loop_in_the_report(landing):
    report = report_of(landing.profiles, e.land_events(landing.log), landing.registry)
    for df in (report.findings, report.missing, report.rejected):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_shared_folder_follows_the_session():
    session = lambda master, **conf: SimpleNamespace(
        conf=conf, sparkContext=SimpleNamespace(master=master)
    )
    assert w.shared_folder(session("spark://a:7077", **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        w.shared_folder(session("spark://a:7077"))


def test_hot_keys_are_split_by_their_rows(spark):
    facts = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id")
    split = w.split_keys(w.count_keys(facts, ["k"]), ["k"]).collect()
    assert [(row.k, row["_pieces"]) for row in split] == [(-1, 10_000 // w.LEAST_SPLIT_ROWS)]
    lookup = spark.createDataFrame([(-1, "hot"), (1, "one"), (7, "seven")], "k LONG, name STRING")
    for how in ("inner", "left", "left_anti"):
        got = w.join_split(facts, lookup, ["k"], ["id"], how)
        plain = facts.join(lookup, "k", how).select(got.columns)
        assert sorted(got.collect(), key=repr) == sorted(plain.collect(), key=repr)
    nothing = w.join_split(facts.limit(0), lookup, ["k"], ["id"])
    assert nothing.count() == 0


def test_large_dictionary_meets_one_row_per_name_of_a_profile(landing):
    classes = w.measure(r.impl_to_udf(r.resolve_registry(landing.registry)), matching.shortest_path())
    dictionary = w.measure(w.publish(matching.match_frames(p.frame_names(landing.profiles), classes), "test"))
    plan = plan_of(matching.attribute(p.decode_frames(p.valid_profiles(landing.profiles)), dictionary, limit=0))
    assert "from_json" not in plan


def test_only_measurable_columns_are_measured(spark):
    assert w.measure(spark.sql("SELECT X'0102' AS a, 1 AS b")).n_bytes == 2 + w.ROW_OVERHEAD_BYTES
    with pytest.raises(ValueError):
        w.measure(spark.sql("SELECT array('long') AS a"))


def test_measured_size_is_exact(spark):
    rows = spark.createDataFrame([("ab", None, 1), ("ü", "xyz", 2)], "a STRING, b STRING, n INT")
    expected = 2 + 0 + 2 + 3 + 2 * w.ROW_OVERHEAD_BYTES
    assert w.measure(rows).n_bytes == expected
    published = w.measure(w.publish(rows, "test"))
    assert published.n_bytes == expected
    assert sorted(published.rows.collect(), key=repr) == sorted(rows.collect(), key=repr)


def test_large_dictionary_moves_no_frame_that_is_no_functions(spark, monkeypatch):
    """Before the shuffle, names of no dictionary are dropped; the reserved frame may be a function's."""
    rows = [
        ("a", "T", "task", 1, 1, "lib/Thread.run", 9), ("a", "T", "task", 1, 1, "total", 9), ("a", "T", "task", 1, 1, "f/A.call", 4),
        ("b", "T", "task", 1, 1, "f/A.call", 5), ("b", "T", "task", 1, 1, "total", 5), ("c", "T", "task", 1, 1, "total", 6),
        (None, "T", "task", 1, 1, "total", 3),
    ]
    frames = spark.createDataFrame(rows, "app_id STRING, profile_type STRING, unit STRING, id LONG, ts LONG, frame STRING, total LONG")
    known = spark.createDataFrame(
        [("a", "f/A.call", "fa", 1), ("b", "total", "word", 1)], "app_id STRING, frame STRING, udf STRING, n LONG"
    )
    written, publish = {}, w.publish

    def record(df, name, *args, **kwargs):
        written[name] = publish(df, name, *args, **kwargs)
        return written[name]

    monkeypatch.setattr(w, "publish", record)
    limit = 2 * w.ROW_OVERHEAD_BYTES + len("f/A.call") + len("total")
    large = matching.attribute(frames, w.measure(known), limit=limit)
    assert "_salt" in plan_of(large) and "key_counts" not in written
    assert {row.frame for row in written["known_frames"].collect()} == {"f/A.call", "total"}
    small = matching.attribute(frames, w.measure(known))
    assert sorted(large.collect(), key=repr) == sorted(small.collect(), key=repr)
    assert {(row.app_id, row.udf) for row in small.collect()} == {("a", "fa"), ("a", None), ("b", "word"), ("c", None), (None, None)}


def test_names_are_counted_with_the_dictionary(landing):
    valid = p.parse_once(landing.profiles).valid
    counted = hotspots.dictionary_of(valid, r.resolve_registry(landing.registry)).rows
    names = valid.select("app_id", F.explode("names").alias("frame")).groupBy("app_id", "frame").count()
    assert counted.join(names, ["app_id", "frame"]).filter("n <> count").count() == 0 < counted.count()


def test_bodies_are_not_sorted_to_be_landed(spark, sf_dir, tmp_path):
    spans = fx.task_spans(fx.read_base(spark, sf_dir))
    parts = fx.profile_parts(spans, fx.job_spans(spans))
    assert len(parts) == 4
    for part in parts:
        kinds = part.select("profile_type", "unit").distinct().collect()
        assert len(kinds) == 1
        executed = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in executed
