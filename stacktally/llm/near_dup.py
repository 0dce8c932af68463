"""Near duplicates by order min-hash and banded alignment.

A sketch keeps the few smallest of a text's word k-mers, each labelled with its occurrence
number, in the order in which they stand in the text. Two texts meet if one of their sketches
is equal, which becomes likely with *edit* similarity: moving blocks around changes it, unlike
plain min-hash. Every meeting is then checked by aligning the words in a band as wide as the
similarity allows.

Texts that meet are not paired with each other but with the first of them (its hub). Only
where that leaves several classes under one sketch are the texts of the smaller classes
paired with the rest, so no link is lost and a group of copies costs one pair per copy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from stacktally import workspace as w
from stacktally.llm.common import components, free_name, text_key, whole

# Chosen for what scattered edits leave of the k-mers at SIMILARITY, see ``classes``.
SHINGLE_WORDS = 3
KEPT_IN_ORDER = 3
SKETCHES = 64
SIMILARITY = 0.8
# Numbers of 64 bits that hold the parities of a text's words. With few cells, texts of a common
# passage and different ends seem closer than they are, and more of them are aligned.
PARITIES = 64
# So many numbers are left of them, folded, for the first look at a pair.
FOLDED = 16
# k-mers hashed at once, times sketches.
_CELLS = 100_000
# Cells aligned at once: pairs times the widest band.
_BAND_CELLS = 60_000

_SIGNATURE = T.StructType([
    T.StructField("n_words", T.IntegerType()),
    T.StructField("sketches", T.ArrayType(T.LongType())),
    T.StructField("parities", T.ArrayType(T.LongType())),
])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; wraps around."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash per k-mer and occurrence of it, in text order; one for a text below k words."""
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if not first.all():
        at = np.arange(n)
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        h = h + occurrence * np.uint64(0xA24BAED4963EE407)
    return _mix(h)


def sketch(words: np.ndarray, k: int, kept: int, sketches: int) -> np.ndarray:
    """One number per sketch; texts without words share one constant."""
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64))
    if not len(words):
        return seeds[:1].astype(np.int64)
    kmers = labelled_kmers(words, k)
    kept = min(kept, len(kmers))
    out = np.empty(sketches, dtype=np.uint64)
    at_once = max(1, _CELLS // len(kmers))
    for start in range(0, sketches, at_once):
        seed = seeds[start : start + at_once, None]
        values = (kmers[None, :] ^ seed) * (seed | np.uint64(1))
        values ^= values >> np.uint64(29)
        rows = np.arange(len(values))
        smallest = np.empty((len(values), kept), dtype=np.int64)
        for i in range(kept):
            smallest[:, i] = values.argmin(axis=1)
            values[rows, smallest[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        smallest.sort(axis=1)
        h = seed[:, 0].copy()
        for i in range(kept):
            h = _mix(h) + kmers[smallest[:, i]]
        out[start : start + at_once] = _mix(h)
    return out.view(np.int64)


def parities(words: np.ndarray) -> np.ndarray:
    """For each of 64 x PARITIES cells, whether an odd number of words falls into it.

    A word's later occurrences fall into other cells. Cells that differ between two texts are
    at most as many as the words that only one of them has, so they bound the edits from below.
    """
    bits = np.zeros(64 * PARITIES, dtype=np.uint8)
    if len(words):
        cells = labelled_kmers(words, 1) % np.uint64(len(bits))
        bits = (np.bincount(cells.astype(np.int64), minlength=len(bits)) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _signature(k: int, kept: int, sketches: int):
    @F.pandas_udf(_SIGNATURE)
    def signature(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sizes, found, odd = [], [], []
            for text in batch:
                words = words_of(text)
                hashes = np.fromiter(
                    (xxh3_64_intdigest(x) for x in words), dtype=np.uint64, count=len(words)
                )
                sizes.append(len(words))
                found.append(sketch(hashes, k, kept, sketches))
                odd.append(parities(hashes))
            yield pd.DataFrame({"n_words": sizes, "sketches": found, "parities": odd})

    return signature


# --- alignment ------------------------------------------------------------------


def _most_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def _reach(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs at once, -1 where one is above ``most`` of its pair.

    The band holds, for every diagonal (place in b minus place in a), the furthest word of a that
    is reached with e edits; with each further edit it grows by a diagonal at either side, as far
    as the edits left still lead back to the end. So a pair costs about the square of its
    distance and the words that are equal along the way, not its length times the band.
    """
    n_a = np.array([len(x) for x in a])
    n_b = np.array([len(x) for x in b])
    # The words of all pairs end to end, each text with an end mark that equals nothing.
    flat_a = np.concatenate([part for x in a for part in (x, [-1])])
    flat_b = np.concatenate([part for x in b for part in (x, [-2])])
    from_a = np.cumsum(np.r_[0, n_a[:-1] + 1])
    from_b = np.cumsum(np.r_[0, n_b[:-1] + 1])
    target = n_b - n_a
    nowhere = -(1 << 40)
    out = np.full(len(a), -1, dtype=np.int64)
    live = np.flatnonzero(np.abs(target) <= most)
    reached = np.zeros((len(live), 1), dtype=np.int64)
    e = 0
    while len(live):
        slope = np.arange(-e, e + 1)
        if e:
            wide = np.full((len(live), 2 * e + 3), nowhere, dtype=np.int64)
            wide[:, 2:-2] = reached
            # a word of b alone, a word of each, a word of a alone
            reached = np.maximum(wide[:, :-2], np.maximum(wide[:, 1:-1], wide[:, 2:]) + 1)
            reached = np.minimum(reached, np.minimum(n_a[live, None], n_b[live, None] - slope))
        fits = np.abs(target[live, None] - slope) <= (most[live] - e)[:, None]
        fits &= (reached >= 0) & (reached + slope >= 0)
        reached[~fits] = nowhere
        pair, column = np.nonzero(fits)
        at_a = from_a[live][pair] + reached[pair, column]
        at_b = from_b[live][pair] + reached[pair, column] + slope[column]
        running = np.arange(len(pair))
        steps = np.zeros(len(pair), dtype=np.int64)
        while len(running):
            same = flat_a[at_a] == flat_b[at_b]
            running, at_a, at_b = running[same], at_a[same] + 1, at_b[same] + 1
            steps[running] += 1
        reached[pair, column] += steps
        end = np.clip(target[live] + e, 0, 2 * e)
        done = (np.abs(target[live]) <= e) & (reached[np.arange(len(live)), end] >= n_a[live])
        out[live[done]] = e
        stay = ~done & (most[live] > e)
        live, reached = live[stay], reached[stay]
        e += 1
    return out


def edit_distances(
    pairs: list[tuple[list[str], list[str]]], similarity: float = SIMILARITY
) -> list[int]:
    """Word edit distance of each pair, or -1 where it is below ``similarity``.

    Common ends are cut off, words that one side has more often bound the distance from below,
    and the rest is aligned in a band that grows by one diagonal with each edit. A pair costs at
    most the square of the edits allowed, or its equal words times these edits where almost all
    words are the same; texts of any length are aligned whole.
    """
    out = [-1] * len(pairs)
    waiting = []
    for i, (a, b) in enumerate(pairs):
        most = _most_edits(max(len(a), len(b)), similarity)
        if abs(len(a) - len(b)) > most:
            continue
        start = 0
        while start < min(len(a), len(b)) and a[start] == b[start]:
            start += 1
        end = 0
        while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
            end += 1
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        only_a, only_b = Counter(a), Counter(b)
        only_a.subtract(only_b)
        more = sum(n for n in only_a.values() if n > 0)
        less = -sum(n for n in only_a.values() if n < 0)
        if max(more, less) > most:
            continue
        if not a or not b:
            out[i] = max(len(a), len(b))
            continue
        number: dict[str, int] = {}
        ids = [np.array([number.setdefault(x, len(number)) for x in side], dtype=np.int32) for side in (a, b)]
        waiting.append((i, ids[0], ids[1], most))
    waiting.sort(key=lambda x: x[3])
    start = 0
    while start < len(waiting):
        end = start + 1
        while end < len(waiting) and (end + 1 - start) * (2 * waiting[end][3] + 1) <= _BAND_CELLS:
            end += 1
        chunk = waiting[start:end]
        found = _reach([x[1] for x in chunk], [x[2] for x in chunk], np.array([x[3] for x in chunk]))
        for item, d in zip(chunk, found.tolist()):
            out[item[0]] = d
        start = end
    return out


def _verify(similarity: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                pairs = [(words_of(a), words_of(b)) for a, b in zip(part["text_u"], part["text_v"])]
                kept = [d >= 0 for d in edit_distances(pairs, similarity)]
                yield part.loc[kept, ["u", "v"]]

    return verify


# --- candidates and classes -----------------------------------------------------


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts align; a hub's rows are split over tasks by their number."""
    a = texts.select(F.col("key").alias("u"), F.col("text").alias("text_u"))
    b = texts.select(F.col("key").alias("v"), F.col("text").alias("text_v"))
    hubs = w.split_keys(w.count_keys(pairs, ["u"]), ["u"])
    met = w.join_split(w.join_split(pairs, b, ["v"], ["u"]), a, ["u"], ["v"], split=hubs)
    return met.select("u", "v", "text_u", "text_v").mapInPandas(
        _verify(similarity), "u binary, v binary"
    )


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One text for each key; copies are merged before the shuffle."""
    wanted = w.measure(w.publish(keys, "near_keys"))
    rows = docs.select(text_key(F.col("text")).alias("key"), whole(F.col("text")).alias("text"))
    side = F.broadcast(wanted.rows) if wanted.n_bytes <= w.BROADCAST_LIMIT_BYTES else wanted.rows
    found = rows.join(side, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return w.publish(found, "near_texts")


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()


def _near_sizes(similarity: float) -> str:
    return f"least(n_u, n_v) >= {similarity} * greatest(n_u, n_v) - 1e-9"


def _folded() -> str:
    """``parities`` of fewer cells: those that fall together are added up."""
    parts = " ^ ".join(f"parities[i + {at}]" for at in range(0, PARITIES, FOLDED))
    return f"transform(sequence(0, {FOLDED - 1}), i -> {parts})"


def _near_words(similarity: float) -> str:
    """False only for pairs whose different words alone are too many edits.

    Most pairs fall at the folded parities already.
    """
    most = f"2 * (1 - {similarity}) * greatest(n_u, n_v) + 1e-6 - abs(n_u - n_v)"
    first = " + ".join(f"bit_count(few_u[{i}] ^ few_v[{i}])" for i in range(FOLDED))
    full = "aggregate(zip_with(odd_u, odd_v, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    return f"{first} <= {most} AND {full} <= {most}"


def _hub_pairs(met: DataFrame, split: DataFrame, similarity: float) -> DataFrame:
    """Every text under a sketch with the first text of that sketch."""
    hubs = w.publish(
        met.groupBy("bucket").agg(F.min(F.struct("key", "n_words")).alias("hub"))
        .select("bucket", F.col("hub.key").alias("u"), F.col("hub.n_words").alias("n_u")), "near_hubs",
    )
    pairs = met.select("bucket", F.col("key").alias("v"), F.col("n_words").alias("n_v"))
    pairs = w.join_split(pairs, hubs, ["bucket"], ["v"], split=split)
    return pairs.filter("u <> v").filter(_near_sizes(similarity)).select("u", "v").distinct()


def _other_pairs(
    met: DataFrame, split: DataFrame, nodes: DataFrame, comps: DataFrame, similarity: float
) -> DataFrame:
    """Pairs of different classes under a sketch, but for those within its largest class.

    Pairs are dropped inside the join where their sizes or words differ too much, and under all
    but the first of the sketches that both texts share. Crowded sketches are split in every
    join, by the texts outside the largest class in the last.
    """
    placed = met.join(comps.select(F.col("node").alias("key"), "comp"), "key", "left").select(
        "bucket", "key", "n_words", F.coalesce("comp", "key").alias("comp")
    )
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = mixed.filter("low <> high").select("bucket")
    open_ = w.publish(w.join_split(placed, mixed, ["bucket"], ["key"], split=split), "near_open")
    sizes = open_.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m"))
    main = main.select("bucket", F.col("m.comp").alias("main"))
    open_ = w.join_split(open_, main, ["bucket"], ["key"], split=split)
    open_ = w.publish(open_.join(nodes.select("key", "sketches", "parities"), "key"), "near_open")
    u = open_.filter("comp <> main").select(
        "bucket", F.col("key").alias("u"), F.col("n_words").alias("n_u"), F.col("comp").alias("comp_u"),
        F.col("parities").alias("odd_u"), F.expr(_folded()).alias("few_u"),
        F.col("sketches").alias("sketches_u"),
    )
    v = open_.select(
        "bucket", F.col("key").alias("v"), F.col("n_words").alias("n_v"), F.col("comp").alias("comp_v"), "main",
        F.col("parities").alias("odd_v"), F.expr(_folded()).alias("few_v"),
        F.col("sketches").alias("sketches_v"),
    )
    pairs = w.join_split(u, v, ["bucket"], ["u"], split=split)
    pairs = pairs.filter("comp_u <> comp_v AND (comp_v = main OR u < v)")
    first = "bucket = element_at(array_intersect(sketches_u, sketches_v), 1)"
    return pairs.filter(f"{_near_sizes(similarity)} AND {_near_words(similarity)} AND {first}").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).distinct()


def _merged(nodes: DataFrame, comps: DataFrame, more: DataFrame) -> DataFrame:
    """(key, comp) of all nodes after further links, which are followed between classes only."""
    placed = w.publish(
        nodes.select("key").join(comps.select(F.col("node").alias("key"), "comp"), "key", "left")
        .select("key", F.coalesce("comp", "key").alias("comp")), "near_placed",
    )
    for side, other in (("u", "v"), ("v", "u")):
        of = placed.select(F.col("key").alias(side), F.col("comp").alias(f"comp_{side}"))
        more = w.join_split(more, of, [side], [other])
    top = components(more.select(F.col("comp_u").alias("u"), F.col("comp_v").alias("v")), "near_classes")
    top = top.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return w.join_split(placed, top, ["comp"], ["key"], how="left").select(
        "key", F.coalesce("top", "comp").alias("comp")
    )


def classes(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    kept: int = KEPT_IN_ORDER,
    sketches: int = SKETCHES,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row (key, n_copies, comp) per different text, ``key`` as by ``text_key``.

    Texts of one ``comp`` are linked by pairs whose word edit similarity, 1 - edits / words of
    the longer text, is at least ``similarity``. Words are lower case between white space.
    Two texts are compared if any of ``sketches`` order min-hashes of ``kept`` k-mers is equal.
    Where every edit changes another word, far from the next, a share of s ** 3 / (2 - s ** 3)
    of the k-mers is left at similarity s: a pair is missed with probability below 1e-5 at 0.9,
    0.003 at 0.85 and 0.07 at 0.8 (independent draws); less often if edits stand together. Every
    occurrence of a repeated phrase counts. Null and empty texts, and texts of white space only, are one class. An empty table gives no rows.
    """
    signature = _signature(shingle_words, kept, sketches)
    signed = docs.select(
        text_key(F.col("text")).alias("key"), signature(whole(F.col("text"))).alias("s")
    ).select("key", "s.n_words", "s.sketches", "s.parities")
    nodes = w.publish(
        signed.groupBy("key").agg(
            F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"),
            F.first("sketches").alias("sketches"), F.first("parities").alias("parities"),
        ), "near_nodes",
    )
    # Most sketches stand under one text only: they are dropped before anything is joined.
    met = nodes.select("key", "n_words", F.explode("sketches").alias("bucket"))
    shared = w.publish(met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "near_shared")
    split = w.split_keys(shared, ["bucket"])
    met = w.publish(w.join_split(met, shared.select("bucket"), ["bucket"], ["key"], split=split), "near_met")

    pairs = w.publish(_hub_pairs(met, split, similarity), "near_pairs")
    links = w.publish(_similar(pairs, _texts_of(docs, _keys(pairs)), similarity), "near_links")
    comps = components(links, "near_classes")

    others = w.publish(_other_pairs(met, split, nodes, comps, similarity), "near_pairs")
    more = w.publish(_similar(others, _texts_of(docs, _keys(others)), similarity), "near_links")
    return nodes.select("key", "n_copies").join(_merged(nodes, comps, more), "key")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, is_kept.

    ``class_id`` is the smallest doc_id of the class (null only if all are null), ``class_size``
    its number of rows, ``is_kept`` true for rows with that doc_id. Repeated rows each get a
    row. Other columns are ignored. Null texts count as empty.
    """
    named = w.publish(classes(docs, **options), "near_named")
    rows = w.publish(docs.select("doc_id", text_key(F.col("text")).alias("key")), "near_rows")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    found = w.publish(named.join(firsts, "key"), "near_firsts")
    ids = found.groupBy("comp").agg(
        F.min("first_id").alias("class_id"), F.sum("n_copies").alias("class_size")
    )
    lookup = w.join_split(found.select("key", "comp"), ids, ["comp"], ["key"]).drop("comp")
    return w.join_split(rows, lookup, ["key"], ["doc_id"]).select(
        "doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id, nulls last, one of equal rows.

    Columns and values of the kept rows are those of ``docs``.
    """
    row = free_name(docs, "row")
    numbered = w.publish(docs.withColumn(row, F.monotonically_increasing_id()), "near_rows")
    named = classes(numbered, **options)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row"))
    firsts = numbered.select(text_key(F.col("text")).alias("key"), rank.alias("rank"))
    firsts = firsts.groupBy("key").agg(F.min("rank").alias("first"))
    kept = named.join(firsts, "key").groupBy("comp").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
