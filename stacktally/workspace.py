"""The shared folder for intermediate tables, and joins that check a size first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only if it was measured to be no larger than this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Tables written to the shared folder hold the same few texts over and over.
CODEC = "zstd"
# Fixed per-row cost added to the measured text when sizes are checked.
ROW_OVERHEAD_BYTES = 64
# A key is split if it holds more than one in so many rows, which bounds the number of such keys.
MOST_SPLIT_KEYS = 4000
# A key with fewer rows than this is never split.
LEAST_SPLIT_ROWS = 250

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local-mode session without the setting gets a temporary folder; on a
    cluster a folder of one machine would be lost with that machine.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="stacktally-")
    return _local_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stacktally/{name}-{uuid.uuid4().hex}"


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's texts plus a fixed cost, as an upper bound for small lookups."""
    kinds = dict(df.dtypes)
    if nested := [c for c, kind in kinds.items() if kind.startswith(("array", "map", "struct", "variant"))]:
        raise ValueError(f"the size of {', '.join(nested)} cannot be measured")
    text = [
        F.coalesce(F.octet_length(F.col(c)), F.lit(0))
        for c, kind in kinds.items() if kind.startswith(("string", "varchar", "char", "binary"))
    ]
    return reduce(Column.__add__, text, F.lit(ROW_OVERHEAD_BYTES))


def _total_bytes(df: DataFrame) -> Column:
    return F.coalesce(F.sum(_row_bytes(df).cast("bigint")), F.lit(0)).alias("n_bytes")


class Table(NamedTuple):
    """A table with its measured size and whatever else was measured along with it."""

    rows: DataFrame
    n_bytes: int
    measured: dict[str, int | None]


def publish(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins the true
    size of the table in place of an estimate.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measure(df: DataFrame, *measures: Column) -> Table:
    """Size and other named aggregates of a published table, by one pass over it."""
    row = df.agg(_total_bytes(df), *measures).first().asDict()
    return Table(df, row["n_bytes"], row)


def split_keys(counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Into how many pieces (``_pieces``) to split each key of ``counts`` (``on`` and ``n``).

    Only keys with more than one in ``MOST_SPLIT_KEYS`` of all rows are returned, so there are
    fewer than that many, and a piece holds no more rows than such a key would.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(LEAST_SPLIT_ROWS, -(-total // MOST_SPLIT_KEYS))
    hot = counts.filter(F.col("n") > most)
    return publish(hot.select(*on, F.ceil(F.col("n") / most).cast("int").alias("_pieces")), "split_keys")


def count_keys(facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """``on`` and ``n``: the rows of each key, merged before the shuffle."""
    return publish(facts.groupBy(*on).agg(F.count("*").alias("n")), "key_counts")


def join_split(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    split: DataFrame | None = None,
) -> DataFrame:
    """Inner, left or anti join of two large tables in which a key may hold most of ``facts``.

    The keys that hold a large share of ``facts`` (``split``, else counted here, which reads
    ``facts`` once more) are cut into pieces by ``spread_by``; ``lookup`` is repeated once per
    piece for those keys alone.
    """
    if split is None:
        split = split_keys(count_keys(facts, on), on)
    # Fewer than MOST_SPLIT_KEYS rows.
    split = F.broadcast(split)
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = facts.join(split, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), pieces).cast("int"))
    repeated = lookup.join(split, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_salt"], how).drop("_salt")


def join_lookup(
    facts: DataFrame,
    lookup: Table,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Inner, left or anti join of a large table with a lookup of few rows per key.

    A lookup measured to be small is broadcast, so the large side stays where it
    is. Beyond the limit both sides are shuffled, and hot keys are split (``join_split``).
    """
    if lookup.n_bytes <= limit:
        return facts.join(F.broadcast(lookup.rows), on, how)
    return join_split(facts, lookup.rows, on, spread_by, how)
