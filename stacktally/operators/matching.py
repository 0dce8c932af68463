"""Which registered function a stack frame belongs to.

A frame belongs to a function if it contains the function's class path anywhere.
Comparing every frame with every class would be a cross join, so both sides are
described by hashes of short substrings, and only pairs that share one are
compared in full.

Of a text, the substrings of eight characters with the smallest hash among five
neighbours are kept (minimizers, as in winnowing for document fingerprints). All
neighbours inside a class path are neighbours in every frame that contains the
path, so what is kept of the path is kept of the frame: a join on one of the
path's hashes finds every frame. Joined on is the hash shared by the fewest
classes of the application, which keeps classes with a common package or a common
ending apart. Paths too short for that use all their substrings of four or of one
characters, and frames are cut that finely only if such a class exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacktally import model as m
from stacktally import workspace as w
from stacktally.functions import columns as c

GRAM, NEIGHBOURS = 8, 5
# The shortest path each way of cutting serves, and the size of its pieces.
LONG, MEDIUM, SHORT = GRAM + NEIGHBOURS - 1, 4, 1
PIECE = {LONG: GRAM, MEDIUM: MEDIUM, SHORT: SHORT}
_ATTRIBUTED = [*m.PROFILE_KEY, "frame", "total", "udf", "is_total"]


def _cut_of(path: Column) -> Column:
    n = F.length(path)
    return F.when(n >= LONG, LONG).when(n >= MEDIUM, MEDIUM).otherwise(SHORT)


def _pieces(text: Column, size: int) -> Column:
    """Hashes of all substrings of one size, in order."""
    last = F.length(text) - size + 1
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(text, i, F.lit(size)))),
    )


def _minimizers(hashes: Column) -> Column:
    last = F.size(hashes) - NEIGHBOURS + 1
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: F.least(*[F.get(hashes, i + F.lit(d)) for d in range(NEIGHBOURS)]),
        ),
    )


def _hash_rows(texts: DataFrame, text: str, cuts: Column | list[int]) -> DataFrame:
    """One row per distinct hash of ``text``; ``cuts`` is a list, or a column with one cut.

    The pieces pass through a generator of one row, so that they are computed
    once and not again for every neighbour.
    """
    column = F.col(text)
    offered = list(PIECE) if isinstance(cuts, Column) else cuts
    wanted = lambda cut, value: F.when(cuts == cut, value) if isinstance(cuts, Column) else value
    pieces = F.struct(*[wanted(cut, _pieces(column, PIECE[cut])).alias(f"cut{cut}") for cut in offered])
    cut_texts = texts.select(*texts.columns, F.explode(F.array(pieces)).alias("pieces"))
    kept = [
        F.coalesce(
            _minimizers(F.col(f"pieces.cut{cut}")) if cut == LONG else F.col(f"pieces.cut{cut}"),
            F.array().cast("array<bigint>"),
        )
        for cut in offered
    ]
    return cut_texts.select(
        *texts.columns, F.explode(F.array_distinct(F.concat(*kept))).alias("gram")
    )


def anchors(registry: DataFrame) -> DataFrame:
    """``app_id, impl, udf, path, gram``: one row per class with its rarest hash."""
    classes = registry.select(
        "app_id", "impl", "udf", c.impl_path(F.col("impl")).alias("path")
    ).filter(F.length("path") > 0)
    grams = _hash_rows(classes, "path", _cut_of(F.col("path")))
    shared_by = grams.groupBy("app_id", "gram").agg(F.count("*").alias("n"))
    return (
        grams.join(shared_by, ["app_id", "gram"])
        .groupBy("app_id", "impl", "udf", "path")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    )


def shortest_path() -> Column:
    """To be measured with a table of classes; decides how finely frames are cut."""
    return F.min(F.nullif(F.length("impl"), F.lit(0))).alias("shortest")


def match_frames(
    names: DataFrame, registry: w.Table, limit: int = w.BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """``app_id, frame, udf, impl`` for each distinct frame name that is a function's.

    Among several classes in one frame the longest wins, then the smallest name.
    ``registry`` is measured with ``shortest_path()``. Further columns of ``names`` are kept.
    """
    name = ["app_id", "frame", *[col for col in names.columns if col not in ("app_id", "frame")]]
    found = anchors(registry.rows)
    # An anchor row is its registry row, the class path once more and one hash.
    if registry.n_bytes <= limit // 3:
        found = F.broadcast(found)
    shortest = registry.measured["shortest"] or LONG
    cuts = [LONG]
    if shortest < LONG:
        cuts.append(MEDIUM)
    if shortest < MEDIUM:
        cuts.append(SHORT)
    grams = _hash_rows(names.select(*name), "frame", cuts)
    return (
        grams.join(found, ["app_id", "gram"])
        .filter(F.contains("frame", F.col("path")))
        .groupBy(*name)
        .agg(F.min(F.struct((-F.length("path")).alias("rank"), "impl", "udf")).alias("best"))
        .select("app_id", "frame", "best.udf", "best.impl", *name[2:])
    )


def attribute(
    frames: DataFrame, dictionary: w.Table, limit: int = w.BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """The profile key, ``frame, total, udf, is_total`` of the frames that count.

    A frame counts if its name is in ``dictionary`` (the result of
    ``match_frames``) or is the reserved total frame. A function whose class path
    occurs in the reserved word itself takes that frame over.

    Frames stay where they are if the dictionary can be broadcast. Beyond ``limit`` they are written
    once, without the names that are in no application's dictionary, as far as the distinct names
    can be broadcast; then functions meet the dictionary, and totals the few entries for the reserved
    word. A dictionary that says how often each name occurs (``n``) spares counting them.
    """
    frames = frames.select(*m.PROFILE_KEY, "frame", "total").filter(F.col("frame").isNotNull())
    known = dictionary.rows.select("app_id", "frame", "udf")
    total = F.col("frame") == m.TOTAL_FRAME
    if dictionary.n_bytes <= limit:
        looked_up = frames.join(F.broadcast(known), ["app_id", "frame"], "left")
        found = F.col("udf").isNotNull()
        return looked_up.filter(found | total).withColumn("is_total", ~found).select(*_ATTRIBUTED)
    names = w.measure(w.publish(known.select("frame").distinct(), "known_names"))
    if names.n_bytes <= limit:
        listed = F.broadcast(names.rows.withColumn("listed", F.lit(True)))
        frames = frames.join(listed, "frame", "left").filter(F.col("listed") | total).drop("listed")
    written = w.publish(frames, "known_frames")
    taken = w.measure(known.filter(total).select("app_id"))
    on, spread_by = ["app_id", "frame"], ["profile_type", "unit", "id"]
    split = w.split_keys(dictionary.rows.select(*on, "n"), on) if "n" in dictionary.rows.columns else None
    # Totals that are no function's would be sorted and moved only to be dropped.
    asked = written if taken.n_bytes else written.filter(~total)
    functions = w.join_split(asked, known, on, spread_by, split=split)
    totals = w.join_lookup(written.filter(total), taken, ["app_id"], spread_by, "left_anti", limit)
    return functions.withColumn("is_total", F.lit(False)).select(*_ATTRIBUTED).unionByName(
        totals.withColumn("udf", F.lit(None).cast("string")).withColumn("is_total", F.lit(True)).select(*_ATTRIBUTED)
    )
