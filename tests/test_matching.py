"""Containment of class paths in frames against brute force."""

import random

import pytest

from stacktally import workspace as w
from stacktally.operators import matching

NAMES = "app_id STRING, frame STRING"
CLASSES = "app_id STRING, impl STRING, udf STRING"


def brute_force(names, classes):
    found = set()
    for app, frame in names:
        hits = [
            (-len(impl), impl, udf)
            for class_app, impl, udf in classes
            if class_app == app and impl.replace(".", "/") in frame
        ]
        if hits:
            _, impl, udf = min(hits)
            found.add((app, frame, udf, impl))
    return found


def run(spark, names, classes, limit=w.BROADCAST_LIMIT_BYTES):
    names_df = spark.createDataFrame(sorted(set(names)), NAMES)
    table = w.measure(spark.createDataFrame(classes, CLASSES), matching.shortest_path())
    rows = matching.match_frames(names_df, table, limit).collect()
    assert len(rows) == len(set(rows))
    return {tuple(row) for row in rows}


CLASSES_SMALL = [
    ("a", "acme.udf.click", "click"),
    ("a", "acme.udf.click$1", "long"),
    ("a", "acme.udf.view", "view"),
    ("a", "Foo", "short"),
    ("a", "Q", "one"),
    ("a", "org.x.Medium", "medium"),
    ("b", "acme.udf.click", "other_app"),
]
NAMES_SMALL = [
    ("a", "acme/udf/click$1.call"), ("a", "acme/udf/click.call"), ("a", "zzacme/udf/clickX"),
    ("a", "acme/udf/clic"), ("a", "ACME/UDF/CLICK"), ("a", "lib/Foo.run"), ("a", "Fo"),
    ("a", "xQx"), ("a", "Q"), ("a", "acme/udf/view acme/udf/click"), ("a", ""),
    ("a", "org/x/Medium"), ("a", "total"), ("b", "acme/udf/click$1.call"), ("b", "lib/Foo.run"),
    ("a", "acme/udf/view" * 30), ("a", "ünïcode/acme/udf/view→Q"),
]


@pytest.mark.parametrize("limit", [w.BROADCAST_LIMIT_BYTES, 0])
def test_small_table(spark, limit):
    assert run(spark, NAMES_SMALL, CLASSES_SMALL, limit) == brute_force(NAMES_SMALL, CLASSES_SMALL)


@pytest.mark.parametrize("seed", range(3))
def test_random_strings(spark, seed):
    rng = random.Random(seed)

    def word(low, high):
        return "".join(rng.choice("ab./$1") for _ in range(rng.randint(low, high)))

    classes = {(rng.choice("xy"), word(1, 20)) for _ in range(120)}
    classes = [(app, impl, f"udf{i}") for i, (app, impl) in enumerate(sorted(classes))]
    names = [(rng.choice("xy"), word(0, 40).replace(".", "/")) for _ in range(300)]
    # Make sure of long matches too.
    names += [
        (app, word(0, 5) + impl.replace(".", "/") + word(0, 5)) for app, impl, _ in classes[::2]
    ]
    assert run(spark, names, classes) == brute_force(names, classes)


def test_classes_that_differ_in_a_few_letters(spark):
    classes = [("a", f"com.acme.jobs.Job{i % 7}$$anonfun${i}", f"u{i}") for i in range(300)]
    names = [("a", f"com/acme/jobs/Job{i % 7}$$anonfun${i}.apply") for i in range(0, 400, 3)]
    assert run(spark, names, classes) == brute_force(names, classes)


def test_anchor_is_the_rarest_substring(spark):
    classes = [("a", f"com.acme.jobs.{c}.Transform", c) for c in ("left", "right", "middle")]
    rows = matching.anchors(spark.createDataFrame(classes, CLASSES)).collect()
    assert len(rows) == len({row.gram for row in rows}) == 3


def test_long_paths_keep_a_fraction_of_their_pieces(spark):
    names = [("a", f"com/acme/jobs/Transform{i}$$anonfun.apply/{i * 7919}") for i in range(200)]
    df = spark.createDataFrame(names, NAMES)
    rows = matching._hash_rows(df, "frame", [matching.LONG]).count()
    assert 0 < rows < 0.5 * sum(len(frame) for _, frame in names)


def test_no_cross_join(spark):
    names = spark.createDataFrame(NAMES_SMALL, NAMES)
    for limit in (0, w.BROADCAST_LIMIT_BYTES):
        table = w.measure(spark.createDataFrame(CLASSES_SMALL, CLASSES), matching.shortest_path())
        plan = matching.match_frames(names, table, limit)._jdf.queryExecution().toString()
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("limit", [w.BROADCAST_LIMIT_BYTES, 0])
def test_lookup_join_with_a_hot_key(spark, limit):
    facts = spark.range(3000).selectExpr(
        "'a' AS app_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('f', id % 50) END AS frame", "id"
    )
    lookup = spark.range(40).selectExpr("'a' AS app_id", "concat('f', id) AS frame", "id AS n").unionByName(
        spark.sql("SELECT 'a' AS app_id, 'hot' AS frame, -1L AS n")
    )
    inner = w.join_lookup(facts, w.measure(lookup), ["app_id", "frame"], ["id"], limit=limit)
    left = w.join_lookup(facts, w.measure(lookup), ["app_id", "frame"], ["id"], "left", limit)
    plain = facts.join(lookup, ["app_id", "frame"])
    assert sorted(inner.collect()) == sorted(plain.select(inner.columns).collect())
    assert left.count() == 3000 and left.filter("n = -1").count() == 1000
