"""How five document filters act on each other, whatever order they are applied in.

Each document is reduced to the set of filters it fails (five bits). Per part of the corpus the
number of documents that each of the 32 coalitions of filters removes is tabulated; everything
else follows from that table. A step removes the difference of two coalitions. Shapley values are
the weighted least-squares fit of additive filter worths to the table, under the constraint that
the worths add up to what all filters remove; its normal equations are solved in rationals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacktally import workspace as w
from stacktally.llm.common import whole

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
DUPLICATE = 1 << FILTERS.index("E")


def shapley_weights(n: int) -> list[list[Fraction]]:
    """Row i: the weight of each coalition's worth in the Shapley value of player i of ``n``.

    Minimises the sum over coalitions S (neither empty nor full) of k(S) * (worth(S) - the sum
    of the values in S) squared with the kernel k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), subject
    to the values adding up to the worth of the full coalition. The matrix of the normal equations
    with the multiplier of the constraint is the same for all parts, so it is solved once, exactly,
    with one right-hand side per coalition.
    """
    full = (1 << n) - 1
    inside = lambda i, s: s >> i & 1
    kernel = {
        s: Fraction(n - 1, comb(n, size) * size * (n - size))
        for s in range(1, full) for size in [s.bit_count()]
    }
    rows = []
    for i in range(n):
        normal = [sum(k for s, k in kernel.items() if inside(i, s) and inside(j, s)) for j in range(n)]
        rows.append([*map(Fraction, normal), Fraction(1)]
                    + [kernel.get(s, Fraction(0)) * inside(i, s) for s in range(full + 1)])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(s == full) for s in range(full + 1)])
    for at in range(n + 1):
        pivot = next(r for r in range(at, n + 1) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(n + 1):
            if r != at and rows[r][at]:
                rows[r] = [x - rows[r][at] * y for x, y in zip(rows[r], rows[at])]
    return [row[n + 1 :] for row in rows[:n]]


def _bits(n_words: Column, n_distinct: Column, text: Column) -> Column:
    """Failures of A to D as bits; ``E`` needs the other documents."""
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        n_words < 200,
        100 * n_distinct < 50 * n_words,
        100 * upper > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, part, bits, key, n``: equal rows of documents are merged into one with a count."""
    text = whole(F.col("text"))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    rows = rows.select(
        "doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")
    )
    return rows.groupBy(
        "doc_id", "part", _bits(F.col("n_words"), F.col("n_distinct"), F.col("text")).alias("bits"),
        F.unhex(F.sha2("text", 256)).alias("key"),
    ).agg(F.count("*").alias("n"))


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the exact set of filters that they fail.

    The joins are by document, never by text: of each text only the smallest ``doc_id`` is kept
    and met again by (doc_id, text), so a text that a third of all rows share is one row.
    """
    rows = w.publish(measured(documents), "filter_bits")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = rows.filter("doc_id IS NOT NULL").join(first, ["doc_id", "key"], "left").join(marks, "doc_id", "left")
    # A row without id comes after no other and has no label; such rows meet nothing.
    unknown = rows.filter("doc_id IS NULL").withColumns(
        {"first": F.lit(True), "good": F.lit(False), "toxic": F.lit(False)}
    )
    copy = F.when(F.col("first").isNull(), DUPLICATE).otherwise(0)
    return known.unionByName(unknown).groupBy("part", (F.col("bits") + copy).alias("mask")).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")],
    )


def coalitions(counts: DataFrame) -> DataFrame:
    """``part, coalition, n, removed, good, toxic``: what each of the 32 sets of filters removes."""
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)))
    removed = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    return counts.withColumn("coalition", every).groupBy("part", "coalition").agg(
        F.sum("n").alias("n"), removed("n").alias("removed"),
        removed("good").alias("good"), removed("toxic").alias("toxic"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the columns below.

    ``documents`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns
    do not matter. A null text is empty, a null lang is the part ''. Every row counts as a document;
    a row without doc_id is no copy of another and has no label. Of several labels of a document
    any that says good or toxic counts. Rows with equal ids and texts are not copies of each other:
    ``E`` asks for a smaller id. Empty texts have no words: they fail A, never B or C. An empty
    table has no parts and gives no rows. Texts are compared by SHA-256.

    kept: after this step; removed: by it; redundant: fail its filter but were removed before;
    unique_fails: fail its filter alone; good_lost, toxic_lost: of the removed; shapley: what its
    filter removes, summed over all orders, which is the Shapley value times 120.
    """
    n = len(FILTERS)
    full = (1 << n) - 1
    orders = factorial(n)
    # Times the number of orders all weights are whole numbers.
    weights = [[int(x * orders) for x in row] for row in shapley_weights(n)]
    assert all(Fraction(a, orders) == b for x, y in zip(weights, shapley_weights(n)) for a, b in zip(x, y))
    table = coalitions(mask_counts(documents, labels))
    worth = [
        F.sum(F.get(F.lit(row), F.col("coalition")).cast("bigint") * F.col("removed")) for row in weights
    ]
    parts = table.groupBy("part").agg(
        F.max("n").alias("n"),
        # 32 entries per part
        F.map_from_entries(F.collect_list(F.struct("coalition", F.struct("removed", "good", "toxic")))).alias("of"),
        F.array(*worth).alias("worth"),
    )
    order, step = F.col("filter_order"), F.col("step")
    power = lambda n: F.call_function("shiftleft", F.lit(1), n)
    bit = lambda k: power(F.ascii(F.substring(order, k, 1)) - ord(FILTERS[0]))
    letter = F.ascii(F.substring(order, step, F.lit(1))) - ord(FILTERS[0])
    steps = (
        parts.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("filter", letter)
        .withColumn("before", sum((F.when(step > k, bit(k)).otherwise(0) for k in range(1, n)), F.lit(0)))
        .withColumn("own", power(F.col("filter")))
    )
    of = lambda coalition, what: F.element_at("of", coalition)[what]
    before, own = F.col("before"), F.col("own")
    lost = lambda what: of(before + own, what) - of(before, what)
    long = lambda value, name: F.coalesce(value, F.lit(0)).cast("bigint").alias(name)
    return steps.select(
        "part", "filter_order", "step",
        long(F.col("n") - of(before + own, "removed"), "kept"),
        long(lost("removed"), "removed"),
        long(of(own, "removed") - lost("removed"), "redundant"),
        long(of(F.lit(full), "removed") - of(full - own, "removed"), "unique_fails"),
        long(lost("good"), "good_lost"), long(lost("toxic"), "toxic_lost"),
        long(F.get("worth", F.col("filter")), "shapley"),
    )
