"""Quality rules as a ledger: measure once, keep failure bits, decide by versioned policies.

Every rule is evaluated once per document and leaves one bit and its measurement. A policy
is a version of a bit mask, so changing the verdict, or asking what one rule costs, never
reads a text again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacktally.llm.common import free_name, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words",
]


class Rule(NamedTuple):
    name: str
    fails: str


# The position of a rule is its bit; new rules are added at the end only.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 60 * n_words"),
    Rule("shouting", "100 * n_upper_words > 60 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
)


class Policy(NamedTuple):
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bit = {rule.name: 1 << i for i, rule in enumerate(RULES)}
        return sum(bit[name] for name in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_words"))
# Repeated lines are measured only: short clean documents have them too.
CURRENT = Policy("2", ("too_few_words", "repeated_words", "symbols", "shouting", "long_words"))
STRICT = Policy("3-strict", tuple(rule.name for rule in RULES))
POLICIES = (BASE, CURRENT, STRICT)


def measure_text(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        until = 0  # words before this position are counted
        for i, window in enumerate(windows):
            if found[window] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)),
        repeated, len(lines), sum(map(str.isupper, words)),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure_text(t) for t in batch], columns=MEASURES)


def ledger(
    docs: DataFrame, text: str = "text", measured: str = "measured", fail_bits: str = "fail_bits"
) -> DataFrame:
    """``docs`` with struct ``measured`` and bit mask ``fail_bits``, one bit per rule.

    One narrow pass: no shuffle, and nothing is gathered but one batch of rows. A null text
    counts as empty and fails ``too_few_words``. Repeated rows are each measured; columns of
    ``docs`` are kept, except that ``measured`` and ``fail_bits`` are replaced.
    """
    found = docs.withColumn(measured, _measure(whole(F.col(text))))
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES):
        expression = re.sub(r"\b(n_\w+|word_chars)\b", rf"`{measured}`.\1", rule.fails)
        bits = bits + F.when(F.expr(expression), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return found.withColumn(fail_bits, bits)


def passes(policy: Policy, fail_bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes ``policy``."""
    return F.col(fail_bits).bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def keep(docs: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with the columns of ``docs``."""
    measured, bits = free_name(docs, "measured"), free_name(docs, "fail_bits")
    return ledger(docs, text, measured, bits).filter(passes(policy, bits)).drop(measured, bits)


def ablations(kept: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule of it: how many documents the rule rejects, alone and at all.

    Works on the counts of the distinct bit masks, at most ``2 ** len(RULES)`` rows. An empty
    ledger gives zero counts.
    """
    masks = kept.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spark = kept.sparkSession
    choices = spark.createDataFrame(
        [(p.version, name, p.mask, 1 << i) for p in policies
         for i, (name, _) in enumerate(RULES) if name in p.rules],
        "policy string, rule string, mask bigint, bit bigint",
    )
    counts = masks.agg(F.collect_list(F.struct("fail_bits", "n")).alias("masks"))

    def total(test: str) -> Column:
        return F.expr(
            f"aggregate(filter(masks, m -> {test}), 0L, (a, m) -> a + m.n)"
        ).cast("bigint")

    return choices.join(F.broadcast(counts)).select(
        "policy", "rule",
        total("m.fail_bits & mask <> 0").alias("rejected"),
        total("m.fail_bits & bit <> 0").alias("failed_rule"),
        total("m.fail_bits & mask = bit").alias("rejected_only_by_rule"),
    )
