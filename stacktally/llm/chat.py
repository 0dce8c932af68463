"""Preference formatting of conversations.

The turns that a chosen and a rejected conversation begin with alike are rendered once, as the
prompt; what follows is rendered per side, with the character ranges a trainer should learn
from. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stacktally.llm.common import whole

TRAINED_ROLE = "assistant"


def render_turn(role: Column, text: Column) -> Column:
    """One turn with its marks; a null role reads ``unknown``."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Sides by the convention of the table: conversations 2k and 2k + 1 answer the same
    request, the even one is chosen. Rows without conv_id belong to no conversation."""
    return conversations.filter("conv_id IS NOT NULL").select(
        F.floor(F.col("conv_id") / F.lit(2)).cast("bigint").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )


def format_pairs(sides: DataFrame) -> DataFrame:
    """One row per pair: pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``sides`` has pair_id, side (``chosen`` or ``rejected``), turn, role and text. Turns are
    ordered by number; of equal numbers by role, then text. Null roles read ``unknown``, null
    texts are empty; turns without number come first. ``n_prefix`` is the longest common prefix
    of (role, text); the rest is the completion, empty if nothing follows. A pair with one side
    missing has an empty completion there and, as nothing is in common, no prompt.

    A mask is an array of (start, end) in code points of the completion: the text and the end
    mark of each assistant turn. One shuffle by pair; a conversation is one row of the result,
    so only its own turns are gathered.
    """
    turns = sides.select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
        whole(F.col("text")).alias("text"),
    ).withColumn("rendered", render_turn(F.col("role"), F.col("text")))
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.repartition("pair_id").withColumns({
        "n": F.row_number().over(order),
        "end": F.sum(F.length("rendered")).over(running).cast("bigint"),
    })
    turn = F.struct("n", "role", "text", "rendered", "end")

    def side(name: str) -> Column:
        gathered = F.collect_list(F.when(F.col("side") == name, turn))
        return F.sort_array(gathered).alias(f"{name}_turns")

    pairs = turns.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    alike = F.zip_with(
        "chosen_turns", "rejected_turns",
        lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)),
    )
    first_other = F.array_position(alike, False)
    pairs = pairs.withColumn(
        "n_prefix", F.when(first_other == 0, F.size("chosen_turns")).otherwise(first_other - 1).cast("int")
    )

    def texts(turns_of: Column) -> Column:
        return F.array_join(F.transform(turns_of, lambda t: t["rendered"]), "")

    def rest(name: str) -> Column:
        return F.filter(f"{name}_turns", lambda t: t["n"] > F.col("n_prefix"))

    prompt_end = F.coalesce(
        F.get(F.transform("chosen_turns", lambda t: t["end"]), F.col("n_prefix") - 1), F.lit(0)
    )

    def mask(name: str) -> Column:
        learnt = F.filter(rest(name), lambda t: t["role"] == TRAINED_ROLE)
        mark = len("<|end|>")
        return F.transform(learnt, lambda t: F.struct(
            (t["end"] - 1 - mark - F.length(t["text"]) - prompt_end).alias("start"),
            (t["end"] - 1 - prompt_end).alias("end"),
        ))

    return pairs.select(
        "pair_id", "n_prefix",
        texts(F.filter("chosen_turns", lambda t: t["n"] <= F.col("n_prefix"))).alias("prompt"),
        texts(rest("chosen")).alias("chosen"), texts(rest("rejected")).alias("rejected"),
        mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"),
    )


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
