"""Registrations replayed one by one against the resolved table."""

import random

import pytest
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally.operators import registry as r

# seq, udf, impl, origin
ROWS = [
    (1, "click", "acme.udf.click", "udf"),
    (2, "view", "acme.udf.view", "udf"),
    (6, "view", "acme.udf.other", "ddl"),
    (7, "ddl_only", "acme.ddl.A", "ddl"),
    (8, "ddl_only", "acme.ddl.B", "ddl"),
    (9, "late_api", "acme.api.Old", "ddl"),
    (10, "late_api", "acme.api.New", "udf"),
    (11, "agg", "acme.agg.Sum", "udaf"),
    (12, "alias", "acme.agg.Sum", "udaf"),
    (13, "late_api", "acme.api.Ignored", "ddl"),
    (14, "click", "acme.udf.click2", "udaf"),
]


def frame(spark, rows, app="a"):
    return spark.createDataFrame([(app, *row) for row in rows], m.REGISTRY)


def replay(rows):
    current = {}
    for seq, udf, impl, origin in sorted(rows):
        if origin != "ddl" or udf not in current:
            current[udf] = (seq, impl, origin)
    return current


def resolved(df):
    return {row.udf: (row.seq, row.impl, row.origin) for row in r.resolve_registry(df).collect()}


def test_rules(spark):
    assert resolved(frame(spark, ROWS)) == replay(ROWS)


@pytest.mark.parametrize("seed", range(2))
def test_random_sequences(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, f"f{rng.randint(0, 30)}", f"c{rng.randint(0, 9)}", rng.choice(["udf", "udaf", "ddl", "ddl"]))
        for i in range(400)
    ]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert resolved(frame(spark, shuffled).repartition(5)) == replay(rows)


def test_last_registered_name_stands_for_a_class(spark):
    got = {row.impl: row.udf for row in r.impl_to_udf(r.resolve_registry(frame(spark, ROWS))).collect()}
    assert got["acme.agg.Sum"] == "alias"
    assert got["acme.api.New"] == "late_api" and "acme.api.Old" not in got


def test_applications_do_not_mix(spark):
    both = frame(spark, [(1, "f", "x", "udf")], "a").unionByName(frame(spark, [(2, "f", "y", "udf")], "b"))
    rows = r.resolve_registry(both).collect()
    assert sorted((row.app_id, row.impl) for row in rows) == [("a", "x"), ("b", "y")]


def test_union_tags_the_origin(spark):
    df = frame(spark, ROWS)
    parts = [df.filter(F.col("origin") == o).drop("origin") for o in ("udf", "udaf", "ddl")]
    assert sorted(r.union_origins(*parts).collect()) == sorted(df.collect())
