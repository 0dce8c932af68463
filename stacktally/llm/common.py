"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacktally import workspace as w


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that hold whole texts go to Python in batches of ``rows``, not of ten thousand, which
    bounds the memory of a worker. A setting of the session, so queries and stages make it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole(text: Column) -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: equal texts have equal keys."""
    return F.unhex(F.md5(whole(text)))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))
    ).first()
    return tuple(row)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (u, v): one row (node, comp) per node with an edge.

    ``comp`` is the smallest node. Alternates large-star and small-star steps: every step is
    one mergeable minimum and one join per node, so a hub is neither collected nor expanded, and
    the join splits the links of a hub.
    Each round is a written table, compared with the last one by count and hashes.
    """
    current = w.publish(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v").distinct(), name,
    )
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = w.publish(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        split = w.split_keys(low.select("u", "n"), ["u"])
        low = low.select("u", F.least("u", "m").alias("m"))
        large = w.join_split(both, low, ["u"], ["v"], split=split).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = w.publish(large.distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = low.select("u", F.col("m").alias("v"))
        current = w.publish(small.filter("u <> v").unionByName(star).distinct(), name)
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    members = current.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return members.unionByName(roots)
