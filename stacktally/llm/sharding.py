"""Shards of documents by balanced label propagation.

Documents with equal texts are linked. Every linked document starts in a shard of its own;
round by round, documents move to the shard where most of their neighbours are, as far as the
quota of that shard allows. What is over a quota at the end, and all unlinked documents, fill
the room that is left, so the shards' row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stacktally import workspace as w
from stacktally.llm.common import text_key, whole

SHARDS = 40
ROUNDS = 5
LAW = "rows"


def _start(shards: int) -> Column:
    return F.pmod(F.xxhash64("key", "doc_id"), F.lit(shards)).cast("int")


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Linked rows in each shard: as many numbers as there are shards."""
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _array(numbers: list) -> Column:
    return F.array(*[F.lit(n) for n in numbers])


def propagate(rows: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Shards of the linked rows: one row (key, part, start, shard, n).

    A group of copies larger than a shard is treated as several, ``part`` telling which, as no
    shard could hold it. The state has a row per group and shard it started in, not per
    document. A shard with less room than is asked of it admits groups by chance, at the rate
    that fills it.
    """
    shards = len(quotas)
    groups = rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    groups = groups.select(
        "key", F.ceil(F.col("copies") / F.lit(max(1, min(quotas)))).cast("int").alias("parts")
    )
    groups = w.publish(groups, "shard_groups")
    state = rows.join(groups, "key").groupBy(
        "key", _part().alias("part"), _start(shards).alias("start"), "parts"
    ).agg(F.count("*").alias("n")).withColumn("shard", F.col("start"))
    state = w.publish(state, "shard_state")
    for turn in range(rounds):
        # The group's largest share says where to; ties go by a hash, so that no shard is favoured.
        votes = state.groupBy("key", "part", "shard").agg(F.sum("n").alias("n"))
        most = F.max(F.struct("n", F.xxhash64("key", "part", "shard").alias("tie"), "shard")).alias("most")
        target = votes.groupBy("key", "part").agg(most).select(
            "key", "part", F.col("most.shard").alias("target")
        )
        moves = w.publish(state.join(target, ["key", "part"]), "shard_moves")
        asked = {
            r["target"]: r["n"] for r in
            moves.filter("shard <> target").groupBy("target").agg(F.sum("n").alias("n")).collect()
        }
        if not asked:
            break
        loads = _loads(state, shards)
        rates = [
            max(0.0, min(1.0, (quotas[s] - loads[s]) / asked[s])) if s in asked else 0.0
            for s in range(shards)
        ]
        chance = F.pmod(F.xxhash64("key", "part", F.lit(turn)), F.lit(1_000_000)) / F.lit(1e6)
        goes = chance < F.element_at(_array(rates), F.col("target") + 1)
        state = w.publish(
            moves.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target"),
            "shard_state",
        )
    return state


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 16, ``slot`` counts gapless within the shard,
    ``law`` is ``rows``: shard s gets n div shards rows, one more if s < n mod shards. A null
    text counts as empty, a null doc_id is a value like others, repeated rows are placed each.
    An empty table gives no rows; with fewer rows than shards, the last shards stay empty.
    """
    text = F.col("text")
    rows = w.publish(docs.select(
        "doc_id", (F.octet_length(whole(text)) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(whole(text)).alias("text_crc32"), text_key(text).alias("key"),
    ), "shard_rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    state = propagate(rows, quotas, rounds)
    parts = state.groupBy("key").agg(F.first("parts").alias("parts"))
    linked = rows.join(w.publish(parts, "shard_parts"), "key", "left")
    place = state.select("key", "part", "start", "shard")
    placed = linked.withColumns({"part": _part(), "start": _start(shards)}).join(
        place, ["key", "part", "start"], "left"
    )
    # Sorted by shard, so a row's number within its run gives its rank in the shard.
    placed = placed.select("doc_id", "size", "text_crc32", "key", "part", "shard")
    placed = placed.orderBy("shard", "key", "part", "doc_id", "size")
    placed = w.publish(placed.withColumn("row", F.monotonically_increasing_id()), "shard_placed")
    return _fill(placed, quotas).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _fill(placed: DataFrame, quotas: list[int]) -> DataFrame:
    """Final shard and slot of rows numbered in the order of their shard.

    All that is needed to know is how many rows of which shard each partition has: a table of
    partitions plus shards at most, small enough for one window and a broadcast.
    """
    placed = placed.withColumns({
        "run": F.shiftright("row", 33), "wish": F.coalesce("shard", F.lit(-1)),
    })
    runs = placed.groupBy("run", "wish").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("wish").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = F.when(F.col("wish") < 0, F.lit(0)).otherwise(
        F.element_at(_array(quotas), F.greatest("wish", F.lit(0)) + 1)
    ).cast("bigint")
    over = F.greatest(F.lit(0), F.col("before") + F.col("n") - F.greatest(quota, "before"))
    runs = runs.withColumns({"quota": quota, "over": over})
    order = Window.orderBy("wish", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = w.publish(
        runs.withColumn("over_before", F.coalesce(F.sum("over").over(order), F.lit(0))), "shard_runs"
    )
    stay = {
        r["wish"]: min(r["n"], r["quota"]) for r in
        runs.groupBy("wish", "quota").agg(F.sum("n").alias("n")).collect() if r["wish"] >= 0
    }
    room, ends, kept = 0, [], [stay.get(s, 0) for s in range(len(quotas))]
    for s, quota_of in enumerate(quotas):
        room += quota_of - kept[s]
        ends.append(room)
    rank = F.col("row") - F.col("first") + F.col("before")
    number = F.col("over_before") + F.col("rank") - F.greatest("quota", "before")
    found = placed.join(F.broadcast(runs), ["run", "wish"]).withColumn("rank", rank)
    found = found.withColumns({"stays": F.col("rank") < F.col("quota"), "number": number})
    free = F.size(F.filter(_array(ends), lambda end: end <= F.col("number")))
    found = found.withColumn("final", F.when(F.col("stays"), F.col("wish")).otherwise(free).cast("int"))
    at = F.col("final") + 1
    starts = [0, *ends[:-1]]
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(
        F.element_at(_array(kept), at) + F.col("number") - F.element_at(_array(starts), at)
    )
    return found.withColumn("slot", slot.cast("bigint")).drop("shard").withColumnRenamed("final", "shard")
