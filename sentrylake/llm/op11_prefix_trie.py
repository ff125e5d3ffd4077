"""Prefix trie of conversations by collapsing whole sequences.

Identical conversations are grouped first: a sequence is kept once, with its weight (how many
conversations), its smallest conversation and the list of conversations that end there. Sequences
that are a proper prefix of another one are taken off by an anti-join, the rest are the leaves of
the trie. Then the prefixes of the sequences, weighted, are added up into the nodes.

A prefix is known by the exclusive or of one 128-bit hash per turn, which mixes the place of the
turn with the SHA-256 of its role and text. The exclusive or is taken in blocks of places that are
joined by their totals, and the place of a turn by ranges of the sorted table, so that neither a
very long conversation nor a very common one meets in one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stage

# Places in a block, and ids in a piece of an end list.
BLOCK = 1024
PIECE_IDS = 512
# Rebuilt conversations borrow up to this many turns less one from the first of their hundred.
HEADS, GROUP = 6, 100
_NODE = ["p1", "p2", "depth"]


def _ranged(rows: DataFrame, label: str, *order: Column) -> DataFrame:
    """rows written out, sorted into ranges of `order`, with the number of the range as part."""
    ranged = rows.repartitionByRange(*order)
    return stage(ranged.withColumn("part", F.spark_partition_id()), label)


def ranked_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d from 1, c1, c2, n_chars, part) and conversations (conv_id, n_own)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        content.alias("content"),
        F.length(text).cast("bigint").alias("n_chars"),
        # tells equal rows apart, so that they can be in different ranges
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "content", "row"]
    ranged = _ranged(turns, "turns", *[F.col(c) for c in order])
    pieces = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = pieces.withColumn(
        "offset", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    ).drop("n")
    local = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    placed = (
        ranged.withColumn("rank", F.row_number().over(local))
        .join(offsets, ["conv_id", "part"])
        .select(
            "conv_id", "part", (F.col("offset") + F.col("rank")).alias("d"),
            F.xxhash64(F.lit(1), "content").alias("c1"),
            F.xxhash64(F.lit(2), "content").alias("c2"), "n_chars",
        )
    )
    owners = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    return placed, owners


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h turns of conversation c - c % 100, h being the crc32 of
    its id modulo 6, and then its own turns behind its first h. Gives the turns (conv_id, place,
    n_chars, q1, q2: hash of place and content) and all conversations (conv_id)."""
    placed, owners = ranked_turns(conversations)
    placed = stage(placed, "placed")
    heads = (
        placed.filter(f"conv_id % {GROUP} = 0 and d < {HEADS}")
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("d", "c1", "c2", "n_chars"))).alias("head"))
    )
    # At most 199 conversations share a base, which has at most five turns in its head.
    borrowed = stage(
        owners.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS)
        .withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
        .join(heads, "base", "left")
        .withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h as int))"))
        .select("conv_id", "h", "head", F.size("head").alias("used")),
        "borrowed",
    )
    own = placed.join(borrowed.drop("head"), "conv_id").filter("d > h").select(
        "conv_id", (F.col("used") + F.col("d") - F.col("h")).alias("place"), "c1", "c2", "n_chars"
    )
    first = borrowed.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.d").alias("place"), "t.c1", "t.c2", "t.n_chars"
    )
    turns = own.unionByName(first).select(
        "conv_id", "place", "n_chars",
        F.xxhash64("place", "c1", "c2").alias("q1"),
        F.xxhash64("c2", "place", "c1").alias("q2"),
    )
    return stage(turns, "rebuilt"), borrowed.select("conv_id")


def _end_lists(whole: DataFrame) -> DataFrame:
    """whole (p1, p2, depth, conv_id) -> p1, p2, depth, ends_sha256. Ids become pieces of a
    comma-separated list within ranges of (sequence, id); SHA-256 reads a list from front to back,
    so one task takes the pieces of a sequence, one after the other and never all at once."""
    ranged = _ranged(whole, "ends", *[F.col(c) for c in [*_NODE, "conv_id"]])
    local = Window.partitionBy(*_NODE, "part").orderBy("conv_id")
    pieces = (
        ranged.withColumn("nth", F.row_number().over(local) - 1)
        .groupBy(*_NODE, "part", F.expr(f"nth div {PIECE_IDS}").alias("piece"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
             .alias("ids"))
    )

    def digest(batches):
        key, seen = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"]),
                                  strict=True):
                if node != key:
                    if key:
                        done.append([*key, seen.hexdigest()])
                    key, seen = node, hashlib.sha256()
                else:
                    seen.update(b",")
                seen.update(ids.encode())
            yield _digests(done)
        if key:
            yield _digests([[*key, seen.hexdigest()]])

    return (
        pieces.repartition(*_NODE)
        .sortWithinPartitions(*_NODE, "part", "piece")
        .select(*_NODE, "ids")
        .mapInArrow(digest, "p1 bigint, p2 bigint, depth bigint, ends_sha256 string")
    )


def _digests(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_NODE, "ends_sha256"]
    )


def _running(rows: DataFrame, key: str, place: str, adds: list[tuple[str, str, str]],
             descending: bool = False) -> DataFrame:
    """rows (places unique within a key) with running aggregates (name, aggregate over a column,
    how to put two together with {0} and {1}) along place, taken in blocks of places."""
    order = F.desc if descending else F.asc
    blocked = rows.withColumn("__block", F.expr(f"{place} div {BLOCK}"))
    totals = blocked.groupBy(key, "__block").agg(*[F.expr(a).alias(f"__{n}") for n, a, _ in adds])
    behind = Window.partitionBy(key).orderBy(order("__block")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select(
        key, "__block",
        *[F.coalesce(F.expr(re.sub(r"\(.*\)", f"(__{n})", a)).over(behind), F.lit(0))
          .alias(f"__{n}") for n, a, _ in adds],
    )
    inside = Window.partitionBy(key, "__block").orderBy(order(place)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = blocked
    for name, aggregate, _ in adds:
        local = local.withColumn(name, F.expr(aggregate).over(inside))
    joined = local.join(carried, [key, "__block"])
    for name, _, both in adds:
        joined = joined.withColumn(name, F.expr(both.format(name, f"__{name}")))
    return joined.drop("__block", *[f"__{n}" for n, _, _ in adds])


def sequences_of(turns: DataFrame, everyone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole conversations (p1, p2, depth, conv_id) and, of identical ones, one sequence (p1, p2,
    depth, weight, conv_id: the smallest). A conversation without a turn has depth 0."""
    ends = turns.groupBy("conv_id").agg(
        F.bit_xor("q1").alias("p1"), F.bit_xor("q2").alias("p2"),
        F.count(F.lit(1)).alias("depth"),
    )
    none = F.lit(0).cast("bigint")
    whole = stage(
        everyone.join(ends, "conv_id", "left").select(
            *[F.coalesce(c, none).alias(c) for c in _NODE], "conv_id"
        ),
        "whole",
    )
    grouped = whole.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")
    )
    return whole, stage(grouped, "sequences")


def prefixes_of(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """conv_id, weight, length of each sequence with each of its prefixes: p1, p2, depth, parent
    (b1, b2) and n_chars of its last turn. The empty prefix has depth 0."""
    kept = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    xor = [(f"p{i}", f"bit_xor(q{i})", "{0} ^ {1}") for i in (1, 2)]
    along = _running(turns.join(kept, "conv_id"), "conv_id", "place", xor).select(
        "conv_id", "weight", "length", "p1", "p2", F.col("place").alias("depth"),
        F.expr("p1 ^ q1").alias("b1"), F.expr("p2 ^ q2").alias("b2"), "n_chars",
    )
    none = F.lit(0).cast("bigint")
    root = kept.select(
        "conv_id", "weight", "length", none.alias("p1"), none.alias("p2"), none.alias("depth"),
        none.alias("b1"), none.alias("b2"), none.alias("n_chars"),
    )
    return stage(along.unionByName(root), "prefixes")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per different sequence of the first d rebuilt turns (see `rebuilt`): conv_id (the
    smallest conversation that begins with it), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    conversations: conv_id, turn, role, text. Turns go by turn, null first; equal ones by role,
    then by a hash of the text, and repeated rows are turns of their own. Null roles and texts
    count as empty. Rows without a conv_id belong to no conversation and are left out. Other
    columns are not read. An empty table gives an empty result, without a root.
    """
    turns, everyone = rebuilt(conversations)
    whole, sequences = sequences_of(turns, everyone)
    prefixes = prefixes_of(turns, sequences)

    inner = prefixes.filter("depth < length").select(*_NODE).distinct()
    leaves = sequences.join(inner, _NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    nodes = stage(
        prefixes.groupBy(*_NODE).agg(
            F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.max("n_chars").alias("n_chars"), F.max("b1").alias("b1"), F.max("b2").alias("b2"),
        ).withColumn("saves", F.expr("(n_convs - 1) * n_chars")),
        "nodes",
    )
    # A node belongs to its smallest conversation, so a sequence owns its nodes from some depth on.
    # What lies below a node: the rest of its own sequence, and of every other sequence that goes
    # through it all that this one owns.
    owned = _running(nodes.select("conv_id", "depth", "saves"), "conv_id", "depth",
                     [("below", "sum(saves)", "{0} + {1}")], descending=True)
    shares = nodes.groupBy("conv_id").agg(F.sum("saves").alias("share"))
    through = (
        sequences.select("conv_id")
        .join(leaves, "conv_id", "left")
        .join(shares, "conv_id", "left")
        .na.fill(0, ["leaf", "share"])
    )
    sums = prefixes.select("conv_id", *_NODE).join(through, "conv_id").groupBy(*_NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum("share").alias("shares")
    )
    up = [F.col("b1").alias("p1"), F.col("b2").alias("p2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.filter("depth > 0").select(*up).groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    parents = nodes.select(
        F.col("p1").alias("b1"), F.col("p2").alias("b2"), (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    of_owner = owned.select("conv_id", "depth", "below").join(shares, "conv_id")
    return (
        nodes.join(sums, _NODE)
        .join(children, _NODE, "left")
        .join(_end_lists(whole), _NODE, "left")
        .join(of_owner, ["conv_id", "depth"])
        .join(parents, ["b1", "b2", "depth"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            F.col("n_leaves").cast("bigint").alias("n_leaves"),
            (F.col("shares") - F.col("share") + F.col("below")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
