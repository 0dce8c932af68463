"""The registered functions of each application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally.functions import columns as c


def union_origins(api: DataFrame, aggregators: DataFrame, ddl: DataFrame) -> DataFrame:
    """One registry from the three kinds of registration, with their origin as a column."""
    tagged = [
        df.withColumn("origin", F.lit(origin))
        for df, origin in ((api, "udf"), (aggregators, "udaf"), (ddl, m.DDL_ORIGIN))
    ]
    return reduce(DataFrame.unionByName, tagged).select(
        "app_id", "seq", "udf", "impl", "origin"
    )


def resolve_registry(registrations: DataFrame) -> DataFrame:
    """The registration in force for each name.

    The latest API registration wins. A DDL registration only fills a free name,
    so among DDL rows the earliest one stays. One aggregation, merged before
    the shuffle, so a name registered over and over does no harm.
    """
    is_api = F.col("origin").isin(*m.API_ORIGINS)
    rank = F.struct(
        is_api.alias("api"),
        F.when(is_api, F.col("seq")).otherwise(-F.col("seq")).alias("order"),
    )
    winner = F.max_by(F.struct("seq", "impl", "origin"), rank).alias("w")
    return (
        registrations.groupBy("app_id", "udf")
        .agg(winner)
        .select("app_id", "udf", "w.seq", "w.impl", "w.origin")
    )


def impl_to_udf(resolved: DataFrame) -> DataFrame:
    """One name per implementation class: the one registered last."""
    return resolved.groupBy("app_id", "impl").agg(
        F.max_by("udf", F.struct("seq", "udf")).alias("udf")
    )


def with_impl_path(registry: DataFrame) -> DataFrame:
    return registry.withColumn("impl_path", c.impl_path(F.col("impl")))
