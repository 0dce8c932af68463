"""The trie of the common beginnings of rebuilt conversations, without building any of them.

A rebuilt conversation is the head of a base conversation followed by the rest of its own turns.
Turns are elements of a monoid: of a sequence x1..xn its element is (n, x1*B + ... + xn*B^n) modulo
three primes, and (m, s) (n, t) = (m + n, s + B^m t). Running sums over the stored turns give the
element of every stored prefix; the element of a rebuilt prefix is the product of the base's head
and of what remains of the own prefix when its own head is divided off. So only numbers and
references to stored turns are combined, and equal elements of equal length make a node.

That equal elements mean equal turns is verified for every node: all members must have the same
parent element and the same digest in the stored turn they refer to. Should two prefixes ever
collide, all is computed again with another base.

Running sums are taken over pieces of a range partitioning by (conversation, position) and
composed over the few conversations that span pieces, so no conversation has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stacktally import workspace as w
from stacktally.llm.common import whole

STRIDE, MOST_SHARED = 5, 9
# The three largest primes below 2^31: sums of terms stay in 64 bits for 2^32 turns.
PRIMES = (2147483647, 2147483629, 2147483587)
# Ids of conversations that end at a node are joined in blocks of so many numbers.
BLOCK_BITS = 12
SUMS, TERMS = ["s0", "s1", "s2"], ["t0", "t1", "t2"]


class Rebuild(NamedTuple):
    """Which conversation's head each one takes, and of how many turns."""

    base: Column
    head: Column


def by_checksum(conv_id: Column) -> Rebuild:
    """The base is the next lower multiple of five, the head crc32(id) modulo nine."""
    return Rebuild(
        conv_id - conv_id % STRIDE,
        (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int"),
    )


# --- the monoid -------------------------------------------------------------------

def _bases(seed: int) -> list[int]:
    digest = hashlib.sha256(f"base {seed}".encode()).digest()
    return [int.from_bytes(digest[8 * i : 8 * i + 8], "big") % (p - 3) + 2 for i, p in enumerate(PRIMES)]


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent modulo prime for exponents below 2^32: one table per hexadecimal digit."""
    factors = []
    for digit in range(8):
        table = F.lit([pow(base, k << 4 * digit, prime) for k in range(16)])
        at = F.shiftright(exponent, 4 * digit).bitwiseAND(F.lit(15)).cast("int")
        factors.append(F.get(table, at).cast("bigint"))
    return reduce(lambda a, b: a * b % prime, factors)


def _terms(key: Column, position: Column, seed: int) -> list[Column]:
    """x * B^position for the turn with digest ``key``, one per prime."""
    return [
        F.pmod(F.xxhash64(key, F.lit(i), F.lit(seed)), F.lit(p)) * _power(b, p, position) % p
        for i, (p, b) in enumerate(zip(PRIMES, _bases(seed)))
    ]


def _rebased(head: list[Column], own_head: list[Column], own: list[Column], shift: Column, seed: int) -> list[Column]:
    """Sums of: the base's head, then the own prefix after its own head, moved by ``shift`` turns.

    ``shift`` (base head less own head, -8 to 0) is a power of the inverse base.
    """
    out = []
    for i, (p, b) in enumerate(zip(PRIMES, _bases(seed))):
        powers = F.lit([pow(b, -k, p) for k in range(MOST_SHARED)])
        back = F.get(powers, (-shift).cast("int")).cast("bigint")
        out.append((head[i] + F.pmod(own[i] - own_head[i], F.lit(p)) * back) % p)
    return out


# --- running sums -----------------------------------------------------------------

def _deal(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Rows in range-partitioned, written ``_piece``s by key and order; a key of any size is spread."""
    dealt = rows.repartitionByRange(key, *order)
    return w.publish(dealt.withColumn("_piece", F.spark_partition_id()), name)


def _spanning(total: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of ``total`` (one per key and piece) of keys in several pieces.

    Between two neighbouring pieces at most one key goes on, so there are no more than twice as many
    rows as pieces, whatever the input.
    """
    keys = total.groupBy(key).agg(F.count("*").alias("_pieces")).filter("_pieces > 1").select(key)
    return total.join(F.broadcast(w.publish(keys, name)), key)


def _earlier(key: str):
    return Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds running sums within ``key`` in a total ``order``; ``sums`` maps new columns to summed ones."""
    dealt = _deal(rows, key, order, name)
    local = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = w.publish(dealt.groupBy(key, "_piece").agg(*[F.sum(old).alias(new) for new, old in sums.items()]), name)
    offsets = _spanning(total, key, name).select(
        key, "_piece", *[F.coalesce(F.sum(new).over(_earlier(key)), F.lit(0)).alias(f"_{new}") for new in sums]
    )
    offsets = F.broadcast(w.publish(offsets, name))
    placed = dealt.withColumns({new: F.sum(old).over(local) for new, old in sums.items()})
    return placed.join(offsets, [key, "_piece"], "left").select(
        *rows.columns, *[(F.col(new) + F.coalesce(f"_{new}", F.lit(0))).alias(new) for new in sums]
    )


def placed_turns(turns: DataFrame, seed: int) -> DataFrame:
    """``conv_id, pos`` (from 1)``, key, n_bytes``, the turn's terms t0..t2 and running sums s0..s2.

    Each piece has the element of its own turns; where a conversation goes on from an earlier piece,
    the product of what stands before is put in front.
    """
    name = "trie_turns"
    order = [F.col("turn"), F.col("key"), F.col("rank")]  # the rank parts turns that are alike
    dealt = _deal(turns.withColumn("rank", F.monotonically_increasing_id()), "conv_id", order, name)
    local = Window.partitionBy("conv_id", "_piece").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("pos", F.row_number().over(local).cast("bigint"))
    dealt = dealt.withColumns(dict(zip(TERMS, _terms(F.col("key"), F.col("pos"), seed))))
    dealt = dealt.withColumns({s: F.sum(t).over(upto) % p for s, t, p in zip(SUMS, TERMS, PRIMES)})
    dealt = w.publish(dealt.drop("turn", "rank"), name)
    total = w.publish(
        dealt.groupBy("conv_id", "_piece").agg(F.max("pos").alias("n"), F.max_by(F.struct(*SUMS), "pos").alias("s")), name
    )
    zero = F.lit(0).cast("bigint")
    spanning = _spanning(total, "conv_id", name).withColumn("_n", F.coalesce(F.sum("n").over(_earlier("conv_id")), zero))
    lifted = [F.col(f"s.{s}") * _power(b, p, F.col("_n")) % p for s, p, b in zip(SUMS, PRIMES, _bases(seed))]
    offsets = spanning.select(
        "conv_id", "_piece", "_n",
        *[F.coalesce(F.sum(x).over(_earlier("conv_id")) % p, zero).alias(f"_{s}") for s, x, p in zip(SUMS, lifted, PRIMES)],
    )
    offsets = F.broadcast(w.publish(offsets, name))
    joined = dealt.join(offsets, ["conv_id", "_piece"], "left").fillna(0, ["_n", *[f"_{s}" for s in SUMS]])
    moved = lambda c, p, b: F.col(c) * _power(b, p, F.col("_n")) % p
    each = list(zip(SUMS, TERMS, PRIMES, _bases(seed)))
    return joined.select(
        "conv_id", (F.col("pos") + F.col("_n")).alias("pos"), "key", "n_bytes",
        *[moved(t, p, b).alias(t) for _, t, p, b in each],
        *[((F.col(f"_{s}") + moved(s, p, b)) % p).alias(s) for s, _, p, b in each],
    )


# --- the trie ----------------------------------------------------------------------

def stored_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, key, n_bytes``: digest and text size of each turn; null texts are empty."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )


def _prefixes(placed: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, and the lengths of these.

    Prefixes: conv_id, depth, f0..f2 (its element), p0..p2 (its parent's), key and n_bytes of the
    last turn, and where that is stored: at_conv, at_pos.
    """
    plan = by_checksum(F.col("conv_id"))
    placed = placed.withColumn("head", plan.head)
    own = placed.groupBy("conv_id").agg(
        F.max("pos").alias("own_len"), F.max("head").alias("head"),
        *[F.coalesce(F.max(F.when(F.col("pos") == F.col("head"), F.col(s))), F.lit(0)).alias(f"own_{s}") for s in SUMS],
    ).withColumn("base", by_checksum(F.col("conv_id")).base)
    own = w.publish(own, "trie_conversations")
    # A conversation shorter than its own head has no turns left; its own sums are not used then.
    most = F.lit(MOST_SHARED)
    stored_heads = placed.filter(F.col("pos") < most).select(
        F.col("conv_id").alias("base"), "pos", "key", "n_bytes", *SUMS, *TERMS
    )
    # At most five conversations have a base and at most eight turns of it are met.
    heads = own.select("conv_id", "base", "head").join(stored_heads, "base").filter("pos <= head")
    heads = w.publish(heads, "trie_heads")
    head_end = heads.groupBy("conv_id").agg(
        F.max("pos").alias("head_len"),
        F.max_by(F.struct(*SUMS), "pos").alias("h"),
    )
    zero = F.lit(0).cast("bigint")
    whole_convs = own.join(head_end, "conv_id", "left").select(
        "conv_id", "own_len", "head", F.coalesce("head_len", zero).alias("head_len"),
        *[f"own_{s}" for s in SUMS], *[F.coalesce(f"h.{s}", zero).alias(f"head_{s}") for s in SUMS],
    )
    whole_convs = w.publish(
        whole_convs.withColumn("length", F.col("head_len") + F.greatest(zero, F.col("own_len") - F.col("head"))),
        "trie_lengths",
    )
    lengths = whole_convs.select("conv_id", "length")
    tails = placed.filter(F.col("pos") > F.col("head")).drop("head")
    tails = w.join_lookup(tails, w.measure(whole_convs), ["conv_id"], spread_by=["pos"])
    sums = lambda prefix, names=SUMS: [F.col(f"{prefix}{s}") for s in names]
    shift = F.col("head_len") - F.col("head")
    now = _rebased(sums("head_"), sums("own_"), sums(""), shift, seed)
    before = [F.col(s) - F.col(f"t{i}") for i, s in enumerate(SUMS)]
    before = _rebased(sums("head_"), sums("own_"), before, shift, seed)
    tails = tails.select(
        "conv_id", (F.col("pos") + shift).alias("depth"), *[c.alias(f"f{i}") for i, c in enumerate(now)],
        *[c.alias(f"p{i}") for i, c in enumerate(before)], "key", "n_bytes",
        F.col("conv_id").alias("at_conv"), F.col("pos").alias("at_pos"),
    )
    mod = lambda c, i: F.pmod(c, F.lit(PRIMES[i]))
    heads = heads.select(
        "conv_id", F.col("pos").alias("depth"), *[mod(F.col(s), i).alias(f"f{i}") for i, s in enumerate(SUMS)],
        *[mod(F.col(s) - F.col(f"t{i}"), i).alias(f"p{i}") for i, s in enumerate(SUMS)], "key", "n_bytes",
        F.col("base").alias("at_conv"), F.col("pos").alias("at_pos"),
    )
    none = F.lit(None).cast("bigint")
    roots = lengths.select(
        "conv_id", zero.alias("depth"), *[zero.alias(f"f{i}") for i in range(3)], *[none.alias(f"p{i}") for i in range(3)],
        F.lit(None).cast("binary").alias("key"), zero.alias("n_bytes"), none.alias("at_conv"), none.alias("at_pos"),
    )
    return heads.unionByName(tails).unionByName(roots), lengths


NODE = ["depth", "f0", "f1", "f2"]


def _nodes(prefixes: DataFrame) -> DataFrame:
    """One row per element and length, merged before the shuffle; ``mixed`` if its members differ."""
    alike = [F.min(c).eqNullSafe(F.max(c)) for c in ("key", "p0", "p1", "p2")]
    return prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in range(3)], F.min(F.struct("at_conv", "at_pos")).alias("at"),
        (~reduce(Column.__and__, alike)).alias("mixed"),
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's blocks, joined by commas in order; holds one state, no list."""
    node, state = None, None
    columns = [*NODE, "ends_sha256"]
    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            here = (row.depth, row.f0, row.f1, row.f2)
            if here != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = here, hashlib.sha256(row.ids.encode())
            else:
                state.update(b"," + row.ids.encode())
        if done:
            yield pd.DataFrame(done, columns=columns)
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=columns)


def _ends(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per node in which conversations end the digest of their ids.

    A node may be the end of most conversations there are: ids are joined in blocks of 4,096
    numbers, in parallel, and only the blocks of a node that has several meet in one stream, which
    SHA-256 needs, as it reads its bytes in order.
    """
    at_end = prefixes.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"])
    block = F.shiftright("conv_id", BLOCK_BITS)
    blocks = at_end.groupBy(*NODE, block.alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    blocks = w.publish(blocks, "trie_ends")
    several = blocks.groupBy(*NODE).agg(F.count("*").alias("n_blocks"), F.max("ids").alias("ids"))
    single = several.filter("n_blocks = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many = w.publish(several.filter("n_blocks > 1").select(*NODE), "trie_long_ends")
    streamed = blocks.join(many, NODE).select(*NODE, "block", "ids").repartition(*NODE)
    schema = "depth BIGINT, f0 BIGINT, f1 BIGINT, f2 BIGINT, ends_sha256 STRING"
    return single.unionByName(streamed.sortWithinPartitions(*NODE, "block").mapInPandas(_digests, schema))


def trie(conversations: DataFrame, seeds: range = range(8)) -> DataFrame:
    """One row per distinct beginning of a rebuilt conversation, the empty one included.

    ``conversations`` has conv_id, turn, role and text; other columns do not matter. Turns are
    ordered by number, null first; of equal numbers by a digest of role and text, and turns that are
    alike count as often as they occur. A null role or text is empty. Rows without conv_id belong to
    no conversation. An empty table has no nodes.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 as the contract of the query states; at_conv, at_pos: a stored turn that is the last
    of the beginning (null: root), positions from 1.
    """
    turns = stored_turns(conversations)
    for seed in seeds:
        prefixes, lengths = _prefixes(w.publish(placed_turns(turns, seed), "trie_placed"), seed)
        prefixes = w.publish(prefixes, "trie_prefixes")
        nodes = w.publish(_nodes(prefixes), "trie_nodes")
        if not nodes.agg(F.count_if("mixed")).first()[0]:
            break
    else:
        raise RuntimeError("all bases collide")

    # Children, by the parent's element.
    up = {"depth": F.col("depth") - 1} | {f"f{i}": F.col(f"p{i}") for i in range(3)}
    children = nodes.filter("depth > 0").select("conv_id", *[c.alias(n) for n, c in up.items()])
    counts = w.count_keys(children, NODE)
    nodes = nodes.drop("mixed").join(counts.withColumnRenamed("n", "n_children"), NODE, "left").fillna(0, ["n_children"])
    nodes = w.publish(nodes, "trie_counted")

    # Each node is summed up along the path of its smallest member; all it adds to are prefixes of that.
    lead = nodes.select(
        *NODE, "conv_id", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"),
    )
    paths = prefixes.select(*NODE, "conv_id").join(lead, [*NODE, "conv_id"], "left").fillna(0, ["saved", "leaf"])
    below = running(
        paths, "conv_id", [F.col("depth").desc()], {"saved_below": "saved", "leaves_below": "leaf"}, "trie_paths"
    )
    sums = below.groupBy(*NODE).agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves"))

    # A node may have most nodes as children, so the parent's row is repeated for split keys.
    child = nodes.select(
        *[F.col(c).alias(f"c_{c}") for c in NODE], *[F.coalesce(c, F.lit(-1)).alias(n) for n, c in up.items()]
    )
    above = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    parents = w.join_split(child, above, NODE, ["c_f0"], split=w.split_keys(counts, NODE))
    parents = parents.select(*[F.col(f"c_{c}").alias(c) for c in NODE], "parent_conv_id")

    ends = _ends(prefixes, lengths)
    return (
        nodes.join(sums, NODE).join(parents, NODE, "left").join(ends, NODE, "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            F.col("at.at_conv").alias("at_conv"), F.col("at.at_pos").alias("at_pos"),
        )
    )
