"""Selecting, checking and decoding landed profiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w
from stacktally.functions import columns as c


def select_profiles(
    profiles: DataFrame,
    profile_type: str,
    service: str,
    unit: str,
    ids: DataFrame | list[int] | None = None,
) -> DataFrame:
    """Label selector. Type and unit prune partitions, the rest reaches the parquet scan."""
    chosen = profiles.filter(
        (F.col("profile_type") == profile_type)
        & (F.col("service_name") == service)
        & (F.col("unit") == unit)
    )
    if ids is None:
        return chosen
    if isinstance(ids, DataFrame):
        return chosen.join(ids, [col for col in ("app_id", "id") if col in ids.columns], "left_semi")
    return chosen.filter(F.col("id").isin(ids))


def in_range(profiles: DataFrame, start, until) -> DataFrame:
    """Profiles landed between ``start`` and ``until``, both inclusive."""
    first, last = (F.lit(t).cast("timestamp") for t in (start, until))
    return profiles.filter((F.col("ts") >= first) & (F.col("ts") <= last))


def since_app_start(profiles: DataFrame, starts: DataFrame, until) -> DataFrame:
    """Profiles landed between the start of their own application and ``until``."""
    bounds = w.measure(w.publish(starts.select("app_id", "start_ts"), "starts"))
    return (
        w.join_lookup(
            profiles.filter(F.col("ts") <= F.lit(until).cast("timestamp")), bounds, ["app_id"],
            spread_by=["profile_type", "unit", "id"],
        )
        .filter(F.col("ts") >= F.col("start_ts"))
        .drop("start_ts")
    )


def parse(profiles: DataFrame, schema: str = m.BODY) -> DataFrame:
    """Adds ``names`` and, with the full schema, ``levels``.

    The parse sits in a generator on purpose: filters on its result cannot be
    pushed below it, which would repeat the parse for every reference.
    """
    keep = profiles.columns
    fields = ["names", "levels"] if schema == m.BODY else ["names"]
    return profiles.select(
        *keep, F.inline(F.array(F.from_json("body", schema)))
    ).select(*keep, *[F.col(f"flamebearer.{f}").alias(f) for f in fields])


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """Parsed profiles that can be decoded, without their text."""
    parsed = parse(profiles).drop("body")
    return parsed.filter(c.is_usable(F.col("unit"), F.col("names"), F.col("levels")))


def _with_reason(profiles: DataFrame) -> DataFrame:
    return parse(profiles).withColumn(
        "reason", c.reject_reason(F.col("body"), F.col("unit"), F.col("names"), F.col("levels"))
    )


def rejected_profiles(profiles: DataFrame) -> DataFrame:
    return (
        _with_reason(profiles)
        .filter(F.col("reason").isNotNull())
        .select(*m.PROFILE_KEY, "reason")
    )


def validate_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    return valid_profiles(profiles), rejected_profiles(profiles)


class Parsed(NamedTuple):
    """Profiles parsed once: a written table, and how many were rejected for each reason.

    ``rows`` has the profile key, ``reason`` (null for a usable profile), ``names`` and
    ``levels``; it is partitioned by ``unit``.
    """

    rows: DataFrame
    rejects: dict[str, int]

    @property
    def valid(self) -> DataFrame:
        return self.rows.filter(F.col("reason").isNull()).drop("reason")

    @property
    def rejected(self) -> DataFrame:
        return self.rows.filter(F.col("reason").isNotNull()).select(*m.PROFILE_KEY, "reason")


def parse_once(profiles: DataFrame) -> Parsed:
    """Reads and parses every body in one pass; all later steps read columns of the result.

    The rejects are counted while the table is written.
    """
    rows = _with_reason(profiles).select(*m.PROFILE_KEY, "reason", "names", "levels")
    seen = Observation()
    counts = [F.count_if(F.col("reason") == reason).alias(reason) for reason in m.REJECT_REASONS]
    written = w.publish(rows.observe(seen, *counts), "parsed", partition_by=["unit"])
    return Parsed(written, {reason: n for reason, n in seen.get.items() if n})


def decode_frames(valid: DataFrame) -> DataFrame:
    """One row per 4-tuple of the level matrix, with the name looked up.

    Numbers that are JSON null count as zero. An index outside the dictionary
    gives a null frame.
    """
    at = lambda i: F.coalesce(F.get("level", F.col("p") + F.lit(i)), F.lit(0))
    key = m.PROFILE_KEY
    return (
        valid.select(*key, "names", F.posexplode("levels").alias("depth", "level"))
        .filter(F.size("level") >= m.FRAME_STRIDE)
        .select(
            *key, "names", "depth", "level",
            F.explode(
                F.sequence(F.lit(0), F.size("level") - m.FRAME_STRIDE, F.lit(m.FRAME_STRIDE))
            ).alias("p"),
        )
        .select(
            *key,
            "depth",
            at(0).alias("off"),
            at(1).alias("total"),
            at(2).alias("self"),
            F.get(
                "names", F.when(at(3).between(F.lit(0), F.size("names") - 1), at(3)).cast("int")
            ).alias("frame"),
        )
    )


def largest_frames(valid: DataFrame) -> DataFrame:
    """The profile key, ``frame, total``: the largest inclusive value of each name in a profile.

    What ``decode_frames`` and a maximum per name give, but reduced inside the row: a profile is
    spread into as many rows as its dictionary has names in use, not frames, and the dictionary is
    not repeated for each of them. A name that the dictionary holds twice may come twice.
    Frames whose index lies outside the dictionary are left out.
    """
    key = m.PROFILE_KEY
    # An array without its null levels, as one of those would make the whole of it null.
    flat = valid.select(*key, "names", F.flatten(F.filter("levels", lambda lv: lv.isNotNull())).alias("flat"))
    at = lambda i, field: F.coalesce(F.get("flat", i * m.FRAME_STRIDE + field), F.lit(0))
    n_frames = F.floor(F.size("flat") / m.FRAME_STRIDE).cast("int")
    frames = F.transform(
        F.when(n_frames > 0, F.sequence(F.lit(0), n_frames - 1)),
        lambda i: F.struct(at(i, 3).alias("name"), at(i, 1).alias("total")),
    )
    known = F.filter(frames, lambda f: f["name"].between(F.lit(0), F.size("names") - 1))
    ordered = flat.select(*key, "names", F.sort_array(known).alias("ordered"))
    largest = F.filter("ordered", lambda f, i: ~F.get("ordered", i + 1)["name"].eqNullSafe(f["name"]))
    named = F.transform(
        largest, lambda f: F.struct(F.get("names", f["name"].cast("int")).alias("frame"), f["total"].alias("total"))
    )
    return ordered.select(*key, F.inline(named)).filter(F.col("frame").isNotNull())


def _names(parsed: DataFrame) -> DataFrame:
    return parsed.select("app_id", F.explode("names").alias("frame")).filter(F.col("frame").isNotNull())


def names_of(parsed: DataFrame) -> DataFrame:
    """The distinct names of each application's dictionaries, merged before the shuffle."""
    return _names(parsed).distinct()


def counted_names(parsed: DataFrame) -> DataFrame:
    """``names_of`` with ``n``, how many entries of the dictionaries a name is."""
    return _names(parsed).groupBy("app_id", "frame").agg(F.count("*").alias("n"))


def frame_names(profiles: DataFrame) -> DataFrame:
    """``names_of`` landed profiles: parses the dictionaries only, not the levels."""
    return names_of(parse(profiles, m.BODY_NAMES))
