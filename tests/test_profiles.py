"""Validity, reasons for rejection and decoding of single documents."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w
from stacktally.operators import matching, profiles as p, registry as r, usage as u

TS = dt.datetime(2024, 1, 1)

# unit, id, body, reason
EDGE = [
    ("job", -1, '{"flamebearer":{"names":["total"],"levels":[[0,0,0,0]]}}', "zero_total"),
    ("job", -2, '{"flamebearer":{"names":[],"levels":[]}}', "empty"),
    ("job", -3, "nope", "bad_json"),
    ("job", -4, '{"flamebearer":{"names":"x","levels":[[0,1,0,0]]}}', "wrong_type"),
    ("task", -5, '{"flamebearer":{"names":["total"],"levels":[[],[0,7,0,0]]}}', None),
    ("job", -6, '{"flamebearer":{"names":["total"],"levels":[[]]}}', "no_first_total"),
    ("task", -7, '{"flamebearer":{"names":["total"],"levels":[[0,7,0]]}}', "ragged_level"),
    ("task", -8, '{"flamebearer":{"names":["total"],"levels":[[0,7,0,9]]}}', None),
    ("task", -9, '{"flamebearer":{"names":["total"],"levels":[[0,0,0,0]]}}', None),
    ("job", -10, '{"flamebearer":{"names":["x"],"levels":[[0,5,0,0]]}}', None),
    ("task", -11, '{"flamebearer":{"names":["total"],"levels":[[0,1.5,0,0]]}}', "bad_json"),
    ("task", -12, None, "bad_json"),
    ("task", -13, '{"other":1}', "no_flamebearer"),
    ("task", -14, '{"flamebearer":{"levels":[[0,1,0,0]]}}', "no_names"),
    ("task", -15, '{"flamebearer":{"names":["total"]}}', "no_levels"),
    ("task", -16, '{"flamebearer":{"names":["total"],"levels":{"a":1}}}', "wrong_type"),
    ("task", -17, '{"flamebearer":{"names":["total"],"levels":[[0,7,0,0', "bad_json"),
    ("task", -18, '{"flamebearer":{"names":["total"],"levels":[null,[0,7,null,null]]}}', None),
    ("task", -19, '{"flamebearer":{"names":["total"],"levels":[[0,7,0,-1]]}}', None),
    ("job", -20, '{"flamebearer":{"names":["total"],"levels":[[0,null,0,0]]}}', "zero_total"),
    ("task", -21, '{"flamebearer":{"names":["total"],"levels":[[0,7,0,0],[0,1,0,0,0]]}}', "ragged_level"),
    ("task", -22, "", "bad_json"),
    ("task", -23, "[1]", "no_flamebearer"),
]


def profile_rows(spark, rows, profile_type=m.CPU_PROFILE):
    """rows: unit, id, body, ts or nothing."""
    full = [
        ("a", "svc", row[1], None, row[3] if len(row) > 3 else TS, row[2], profile_type, row[0])
        for row in rows
    ]
    return spark.createDataFrame(full, m.PROFILE_RAW)


def registry_rows(spark, *pairs, app="a"):
    rows = [(app, i, udf, impl, "udf") for i, (udf, impl) in enumerate(pairs)]
    return spark.createDataFrame(rows, m.REGISTRY)


def latest_of(spark, profiles, registry):
    classes = w.measure(r.impl_to_udf(r.resolve_registry(registry)), matching.shortest_path())
    dictionary = w.measure(matching.match_frames(p.frame_names(profiles), classes))
    frames = matching.attribute(p.decode_frames(p.valid_profiles(profiles)), dictionary)
    rows = u.latest_usage(u.inclusive_max(frames)).collect()
    return {(row.id, row.udf, row.is_total): row.raw for row in rows}


@pytest.fixture(scope="module")
def edge(spark):
    return profile_rows(spark, [row[:3] for row in EDGE])


def test_reasons(edge):
    got = {row.id: row.reason for row in p.rejected_profiles(edge).collect()}
    assert got == {id_: reason for _, id_, _, reason in EDGE if reason}


def test_valid_is_the_complement_of_rejected(edge):
    valid, rejected = p.validate_profiles(edge)
    assert {row.id for row in valid.collect()} == {row[1] for row in EDGE if row[3] is None}
    assert valid.count() + rejected.count() == len(EDGE)


def test_parsed_once_keeps_every_profile(spark, edge):
    parsed = p.parse_once(edge)
    reasons = [row[3] for row in EDGE if row[3]]
    assert parsed.rejects == {reason: reasons.count(reason) for reason in reasons}
    assert {row.id: row.reason for row in parsed.rejected.collect()} == {row[1]: row[3] for row in EDGE if row[3]}
    assert {row.id for row in parsed.valid.collect()} == {row[1] for row in EDGE if row[3] is None}
    nothing = p.parse_once(edge.limit(0))
    assert nothing.rejects == {} and nothing.rows.count() == 0


def test_largest_frames_of_edges(spark, edge):
    """Null levels and numbers, indices outside the dictionary, null and repeated names, negative values."""
    rows = p.largest_frames(p.valid_profiles(edge)).collect()
    assert {row.id: (row.frame, row.total) for row in rows} == {
        -5: ("total", 7), -9: ("total", 0), -10: ("x", 5), -18: ("total", 7),
    }
    text = body(["total", None, "a", "a"], [0, 9, 0, 0], [0, -4, 1, 2, 0, 8, 1, 1, 0, 3, 1, 3, 0, 2, 1, 3, 0, -5, 0, 2, 0, 6, 0, 3000000000])
    found = p.largest_frames(p.valid_profiles(profile_rows(spark, [("task", 1, text)]))).collect()
    assert sorted((row.frame, row.total) for row in found) == [("a", -4), ("a", 3), ("total", 9)]


def test_decoded_edges(edge):
    rows = p.decode_frames(p.valid_profiles(edge)).collect()
    got = {row.id: (row.depth, row.total, row.self, row.frame) for row in rows}
    assert got == {
        -5: (1, 7, 0, "total"),
        -8: (0, 7, 0, None),
        -9: (0, 0, 0, "total"),
        -10: (0, 5, 0, "x"),
        -18: (1, 7, 0, "total"),
        -19: (0, 7, 0, None),
    }


def test_nothing_attributed_means_no_usage_row(spark, edge):
    got = latest_of(spark, edge, registry_rows(spark, ("f", "acme.F")))
    assert got == {(-5, None, True): 7, (-9, None, True): 0, (-18, None, True): 7}


def test_job_without_total_is_rejected_later(spark, edge):
    valid = p.valid_profiles(edge)
    usage = u.in_display_units(
        u.latest_usage(
            u.inclusive_max(
                matching.attribute(
                    p.decode_frames(valid),
                    w.measure(spark.createDataFrame([], "app_id STRING, frame STRING, udf STRING")),
                )
            )
        )
    )
    rows = u.jobs_without_total(valid, usage).collect()
    assert [(row.id, row.reason) for row in rows] == [(-10, "no_total")]


def body(names, *levels):
    return json.dumps({"flamebearer": {"names": names, "levels": levels}})


def test_largest_not_summed_over_depths_and_stacks(spark):
    names = ["total", "acme/F.call", "acme/F$1.inner", "other"]
    text = body(names, [0, 100, 0, 0], [0, 30, 0, 1, 0, 40, 5, 1], [0, 29, 29, 2, 0, 35, 1, 3])
    got = latest_of(spark, profile_rows(spark, [("task", 1, text)]), registry_rows(spark, ("f", "acme.F")))
    assert got == {(1, None, True): 100, (1, "f", False): 40}


def test_function_beats_the_reserved_name_on_its_own_frame(spark):
    text = body(["total", "x"], [0, 9, 0, 0], [0, 5, 5, 1])
    profiles = profile_rows(spark, [("job", 1, text)])
    assert latest_of(spark, profiles, registry_rows(spark, ("f", "tot"))) == {(1, "f", False): 9}
    # A function merely named like the reserved frame is kept apart from it.
    got = latest_of(spark, profiles, registry_rows(spark, ("total", "x")))
    assert got == {(1, None, True): 9, (1, "total", False): 5}


def test_newest_snapshot_overwrites_and_keeps_other_functions(spark):
    registry = registry_rows(spark, ("f", "acme.F"), ("g", "acme.G"))
    later = TS + dt.timedelta(minutes=5)
    profiles = profile_rows(
        spark,
        [
            ("task", 1, body(["total", "acme/F.a", "acme/G.a"], [0, 9, 0, 0], [0, 4, 4, 1, 0, 5, 5, 2]), TS),
            ("task", 1, body(["total", "acme/F.a"], [0, 20, 0, 0], [0, 3, 3, 1]), later),
            ("task", 1, "broken", later + dt.timedelta(minutes=5)),
        ],
    )
    got = latest_of(spark, profiles, registry)
    assert got == {(1, None, True): 20, (1, "f", False): 3, (1, "g", False): 5}


def test_an_unrelated_frame_changes_nothing(spark):
    registry = registry_rows(spark, ("f", "acme.F"))
    plain = body(["total", "acme/F.a"], [0, 9, 0, 0], [0, 4, 4, 1])
    more = body(["total", "acme/F.a", "zzz"], [0, 9, 0, 0], [0, 4, 4, 1, 0, 5, 5, 2])
    results = [
        latest_of(spark, profile_rows(spark, [("task", 1, text)]), registry) for text in (plain, more)
    ]
    assert results[0] == results[1]


def test_select_by_labels_and_ids(landing):
    profiles = landing.profiles
    chosen = p.select_profiles(profiles, m.CPU_PROFILE, "spark-app", m.JOB, ids=[1, 2])
    assert {row.id for row in chosen.collect()} == {1, 2}
    ids = profiles.select("app_id", "id").where("unit = 'job' AND id < 3").distinct()
    by_table = p.select_profiles(profiles, m.CPU_PROFILE, "spark-app", m.JOB, ids=ids)
    assert {row.id for row in by_table.collect()} == {0, 1, 2}


def test_range_is_inclusive_at_both_ends(spark):
    profiles = profile_rows(spark, [("task", 1, "x")])
    assert p.in_range(profiles, TS, TS).count() == 1
    assert p.in_range(profiles, TS + dt.timedelta(microseconds=1), TS + dt.timedelta(1)).count() == 0


def test_text_is_parsed_once(landing):
    plan = p.decode_frames(p.valid_profiles(landing.profiles))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_one_bad_index_stops_nothing(spark):
    body = '{"flamebearer":{"names":["total"],"levels":[[0,7,0,3000000000,0,5,0,-1,0,3,0,0]]}}'
    row = [("a", "s", m.CPU_PROFILE, m.TASK, 1, 1, body)]
    profiles = spark.createDataFrame(
        row, "app_id string, service_name string, profile_type string, unit string, id bigint, job_id bigint, body string"
    ).withColumn("ts", F.timestamp_millis(F.lit(1000)))
    frames = p.decode_frames(p.valid_profiles(profiles)).orderBy("total").collect()
    assert [(r["total"], r["frame"]) for r in frames] == [(3, "total"), (5, None), (7, None)]


def test_newest_maximum_needs_one_shuffle(spark):
    rows = [("a", m.CPU_PROFILE, "task", 1, ts, udf, total)
            for ts, udf, total in ((1, "f", 9), (2, "f", 3), (2, "f", 5), (2, None, 8), (1, None, 99))]
    frames = spark.createDataFrame(
        rows, "app_id string, profile_type string, unit string, id bigint, ts bigint, udf string, total bigint"
    )
    slow = u.latest_usage(u.inclusive_max(frames)).select("udf", "raw", "ts", "is_total")
    fast = u.latest_inclusive(frames)
    assert sorted(fast.select("udf", "raw", "ts", "is_total").collect(), key=repr) == sorted(slow.collect(), key=repr)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
