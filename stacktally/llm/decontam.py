"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared token seeds. For each meeting, the longest matches
are marked again and again, without overlap, by running Karp-Rabin; the share of the item that
the tiles cover decides. Tiles may lie in any order, so reordered passages are caught.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from stacktally import workspace as w
from stacktally.llm.common import free_name, text_key, whole

SEED_TOKENS = 5
COVERAGE = 0.6
# First length searched for; halved down to the seed length.
FIRST_LENGTH = 20

TOKEN = re.compile(r"\w+")

FOUND = "key binary, item_id bigint, coverage double, n_tiles int, longest_tile int"


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def seeds_of(tokens: list[str], n: int = SEED_TOKENS) -> np.ndarray:
    """The different hashes of runs of ``n`` tokens; none for a shorter text."""
    size = len(tokens) - n + 1
    if size < 1:
        return np.empty(0, dtype=np.int64)
    words = np.fromiter((xxh3_64_intdigest(t) for t in tokens), dtype=np.uint64, count=len(tokens))
    h = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : i + size]
    return np.unique(h).view(np.int64)


def _seeds(n: int):
    @F.pandas_udf("array<bigint>")
    def seeds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([seeds_of(tokens_of(t), n) for t in batch], dtype=object)

    return seeds


def tile(item: list[str], text: list[str], least: int = SEED_TOKENS) -> list[int]:
    """Lengths of the tiles of ``item`` in ``text``, none shorter than ``least``.

    The longest match of unmarked tokens on both sides is marked first; of equally long ones,
    the first in the item, then in the text.
    """
    free_item, free_text = [True] * len(item), [True] * len(text)
    tiles: list[int] = []
    length = max(least, min(FIRST_LENGTH, len(item)))

    def run(i: int, j: int) -> int:
        n = 0
        while (
            i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n]
            and item[i + n] == text[j + n]
        ):
            n += 1
        return n

    def starts(tokens: list[str], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
        """Start and running hash of every stretch of ``n`` unmarked tokens."""
        base, modulus = 1_000_003, (1 << 61) - 1
        top = pow(base, n - 1, modulus)
        h = size = 0
        for at, token in enumerate(tokens):
            if not free[at]:
                h = size = 0
                continue
            if size == n:
                h = (h - hash(tokens[at - n]) * top) % modulus
            else:
                size += 1
            h = (h * base + hash(token)) % modulus
            if size == n:
                yield at - n + 1, h

    while length >= least:
        wanted = {h for _, h in starts(item, free_item, length)}
        where: dict[int, list[int]] = {}
        for j, h in starts(text, free_text, length):
            if h in wanted:
                where.setdefault(h, []).append(j)
        matches = []
        for i, h in starts(item, free_item, length):
            best = max(((run(i, j), -j) for j in where.get(h, ())), default=(0, 0))
            if best[0] >= length:
                matches.append((-best[0], i, -best[1]))
        if matches and -min(matches)[0] >= 2 * length:
            length = -min(matches)[0]  # look for the very long ones first
            continue
        marked = False
        for n, i, j in sorted(matches):
            if run(i, j) >= -n:
                free_item[i : i - n] = [False] * -n
                free_text[j : j - n] = [False] * -n
                tiles.append(-n)
                marked = True
        if marked and matches:
            continue  # matches cut by a new tile may leave others of this length
        length = least if least < length < 2 * least else (length // 2 if length > least else 0)
    return tiles


def _tile_batches(least: int, coverage: float):
    def tile_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, item_id, item, text in zip(batch["key"], batch["item_id"], batch["item"], batch["text"]):
                item_tokens = tokens_of(item)
                tiles = tile(item_tokens, tokens_of(text), least)
                share = sum(tiles) / len(item_tokens)
                if share >= coverage:
                    out.append((key, item_id, share, len(tiles), max(tiles)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return tile_batches


def _lookup(df: DataFrame, name: str) -> DataFrame:
    """A written table; marked for broadcast only if it was measured to be small."""
    table = w.measure(w.publish(df, name))
    return F.broadcast(table.rows) if table.n_bytes <= w.BROADCAST_LIMIT_BYTES else table.rows


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, seed_tokens: int = SEED_TOKENS, coverage: float = COVERAGE
) -> DataFrame:
    """One row (key, item_id, coverage, n_tiles, longest_tile) per text and item over ``coverage``."""
    items = w.publish(
        benchmark.filter("text IS NOT NULL").select("item_id", F.col("text").alias("item")).distinct(),
        "items",
    )
    seeds = _seeds(seed_tokens)
    item_seeds = items.select("item_id", "item", F.explode(seeds("item")).alias("seed"))
    per_item = _lookup(item_seeds, "item_seeds")
    rows = docs.select(text_key(F.col("text")).alias("key"), whole(F.col("text")).alias("text"))
    met = rows.select("key", F.explode(seeds("text")).alias("seed")).join(per_item, "seed")
    met = w.publish(met.select("key", "item_id", "item").distinct(), "candidates")
    keys = _lookup(met.select("key").distinct(), "candidate_keys")
    texts = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return met.join(texts, "key").select("key", "item_id", "item", "text").mapInPandas(
        _tile_batches(seed_tokens, coverage), FOUND
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and test item whose tokens its tiles cover to ``coverage`` or more.

    Columns: doc_id, item_id, coverage, n_tiles, longest_tile. Tokens are runs of word
    characters in lower case. Texts are compared whole; equal texts are compared once. Null and
    empty texts match nothing, nor do items of fewer tokens than a seed. Repeated rows of
    documents are repeated in the result; equal rows of the benchmark count once. Either table
    may be empty.
    """
    found = w.publish(contaminated_texts(docs, benchmark, **options), "contaminated")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(found, "key").drop("key")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; columns as they were."""
    found = contaminated_texts(docs, benchmark, **options).select("key").distinct()
    key = free_name(docs, "key")
    bad = _lookup(found.select(F.col("key").alias(key)), "contaminated_keys")
    return docs.withColumn(key, text_key(F.col("text"))).join(bad, key, "left_anti").drop(key)
