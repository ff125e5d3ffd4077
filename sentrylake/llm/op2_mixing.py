"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots of one block of rows. A source of weight w (all weights add up to one) releases
its k-th block (from 0) at floor(k / w) and has it due at ceil((k + 1) / w): one block in each such
window keeps it less than one block away from its target. In a slot the released block with the
earliest deadline runs.

Time is cut into spans of SPAN slots that are scheduled independently of each other, so that the
mix of a corpus of any length runs in many tasks. Which blocks fall into a span follows from a tree
over the sources, ordered by weight: each inner node deals its slots to its two sides in the same
way, the k-th block of a side of share p taking the slot nearest the middle (k + 1/2) / p of its
window. That has a closed form, so a block finds its slot by walking up the tree, in whole numbers.
At the borders of the spans a source is off its target by half a block for its own node plus half of
its part of each node above. Within a span the earliest deadline decides, and a second pass over
spans that are shifted by half mends the borders.

Slots of a source that has run out stay empty, which gives its time to the others in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from ..operators.staging import stage

BLOCK_ROWS = 16
SPAN = 256
# Weights become whole numbers of about this sum, at least 1.
SCALE = 1 << 30
# Without given weights a source weighs its number of rows to this power.
TEMPER = 0.7
# The mix ends where the sources still running hold less than this share of the weight.
LEAST_RUNNING = 0.25
_BUCKET_ROWS = 100_000
_SOURCES = 100_000
_PIECE = 4096
_DEPTH = 40
_ADDED = ("share", "block", "release", "deadline", "slot", "place", "in_mix")
_BIG = "cast({} as decimal(38, 0))".format


def shares(sizes: DataFrame, weights: DataFrame | dict[str, float] | None = None) -> DataFrame:
    """sizes (source, n) -> source, n, share, total: whole numbers in proportion to the weights and
    their sum. weights: source -> weight, or a table (source, weight); sources without a weight
    above 0 are left out. None: the number of rows to the power TEMPER."""
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("n", F.lit(TEMPER)))
    else:
        if isinstance(weights, dict):
            weights = sizes.sparkSession.createDataFrame(
                [(s, float(w)) for s, w in weights.items()], "source string, weight double"
            )
        given = weights.groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        weighed = sizes.join(given, "source").filter("weight > 0")
    # each sum is one row
    summed = weighed.agg(F.sum("weight").alias("all_weights"))
    whole = weighed.join(F.broadcast(summed)).selectExpr(
        "source", "n",
        f"cast(greatest(round(weight / all_weights * {SCALE}), 1) as bigint) as share",
    )
    return whole.join(F.broadcast(whole.agg(F.sum("share").alias("total"))))


def _midpoints(shared: DataFrame) -> DataFrame:
    """shared plus code: the first _DEPTH binary digits of the middle of the source's stretch when
    all stretches lie side by side, heavy ones first (to an eighth of a power of two; sources of
    one such class by a hash, in buckets that bound what one task puts in order)."""
    buckets = max(math.ceil(shared.count() / _SOURCES), 1)
    classed = shared.withColumn("__class", F.expr("-cast(floor(8 * log2(share)) as int)")).withColumn(
        "__bucket", F.expr(f"pmod(xxhash64(source), {buckets}L)")
    )
    # at most 8 * 31 classes times the buckets
    sums = classed.groupBy("__class", "__bucket").agg(F.sum("share").alias("__sum"))
    before = Window.orderBy("__class", "__bucket")
    starts = sums.select(
        "__class", "__bucket", (F.sum("__sum").over(before) - F.col("__sum")).alias("__before")
    )
    inside = Window.partitionBy("__class", "__bucket").orderBy("source")
    return (
        classed.withColumn("__upto", F.sum("share").over(inside))
        .join(starts, ["__class", "__bucket"])
        .withColumn("code", F.expr(
            f"cast({_BIG('2 * (__before + __upto) - share')} * {1 << (_DEPTH - 1)} "
            f"div total as bigint)"))
        .drop("__class", "__bucket", "__upto", "__before")
    )


def with_path(shared: DataFrame) -> DataFrame:
    """shared (source, n, share, total) plus path: the way from the source up the tree as an array
    of (first: is it the first side, part: weight of the side, whole: weight of the node)."""
    coded = stage(_midpoints(shared), "mix-codes")
    # A stretch of a total / 2**d or more is alone below its first d + 1 digits.
    steps = coded.select(
        "source", "share", "code",
        F.expr(f"explode(sequence(0, least({_DEPTH}, "
               "2 + cast(ceil(log2(total / share)) as int)))) as d"),
    ).withColumn("prefix", F.expr(f"shiftright(code, {_DEPTH} - d)"))
    nodes = steps.groupBy("d", "prefix").agg(F.sum("share").alias("weight"))
    ways = (
        steps.join(nodes, ["d", "prefix"])
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("d", "prefix", "weight"))).alias("way"))
    )
    path = """filter(transform(sequence(size(way) - 1, 1), i -> struct(
        way[i].prefix % 2 = 0 as first, way[i].weight as part, way[i - 1].weight as whole)),
        e -> e.part < e.whole)"""
    return coded.drop("code").join(ways, "source").withColumn("path", F.expr(path)).drop("way")


def block_slots(pathed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pathed (source, n, share, total, path) -> source, share, block, release, deadline, near: the
    slot of each block by the tree."""
    last = f"cast(ceil(n / {block_rows}) as bigint) - 1"
    middle = f"{_BIG('2 * s + 1')} * e.whole"
    return (
        pathed.withColumn("__piece", F.expr(f"explode(sequence(0L, ({last}) div {_PIECE}))"))
        # a large source is many pieces, made in different tasks
        .repartition("source", "__piece")
        .withColumn("block", F.expr(
            f"explode(sequence(__piece * {_PIECE}, least((__piece + 1) * {_PIECE} - 1, {last})))"))
        .selectExpr(
            "source", "share", "block",
            f"cast({_BIG('block')} * total div share as bigint) as release",
            f"cast(({_BIG('block + 1')} * total + share - 1) div share as bigint) as deadline",
            f"""aggregate(path, block, (s, e) -> cast(if(e.first, ({middle} - 1) div (2 * e.part),
                {middle} div (2 * e.part)) as bigint)) as near""",
        )
    )


def earliest_deadline_first(near: DataFrame, span: int = SPAN, offset: int = 0) -> DataFrame:
    """near (source, share, block, release, deadline, near) -> the same with slot in place of near:
    within each span of slots the released block with the earliest deadline runs first; if none
    is released, the one that is released next. A span holds `span` blocks at most; the first
    begins `offset` slots before slot 0."""
    spans = near.groupBy(F.expr(f"(near + {offset}) div {span}").alias("__span")).agg(
        F.array_sort(F.collect_list(F.struct(
            "deadline", "release", "source", "block", "share", "near"))).alias("jobs")
    )
    run = """aggregate(array_sort(transform(jobs, j -> j.near)),
      struct(sequence(0, size(jobs) - 1) as waiting, cast(array() as array<int>) as ran),
      (s, t) -> transform(array(coalesce(
          get(filter(s.waiting, i -> jobs[i].release <= t), 0),
          array_min(transform(s.waiting, i -> struct(jobs[i].release as r, i as i))).i)),
        next -> struct(filter(s.waiting, i -> i != next) as waiting,
                       concat(s.ran, array(next)) as ran))[0],
      s -> s.ran)"""
    return (
        spans.withColumn("slots", F.expr("array_sort(transform(jobs, j -> j.near))"))
        .withColumn("ran", F.expr(run))
        .select("jobs", "slots", F.posexplode("ran").alias("at", "i"))
        .selectExpr("jobs[i] as j", "slots[at] as slot")
        .select("j.source", "j.share", "j.block", "j.release", "j.deadline", "slot")
    )


def schedule(sizes: DataFrame, weights: DataFrame | dict[str, float] | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """sizes (source, n) -> source, share, block, release, deadline, slot of every block."""
    near = block_slots(with_path(shares(sizes, weights)), block_rows)
    first = earliest_deadline_first(near).withColumnRenamed("slot", "near")
    # Spans that begin half a span earlier mend what went wrong at the borders.
    return earliest_deadline_first(first, offset=SPAN // 2)


def _end_of_mix(blocks: DataFrame, least_running: float) -> DataFrame:
    """One row: the last slot at which the sources still running hold least_running of the
    weight."""
    ends = blocks.groupBy("source").agg(
        F.max("slot").cast("double").alias("ends"), F.max("share").alias("share")
    )
    at = stage(ends.groupBy("ends").agg(F.sum("share").alias("share")), "mix-ends")
    total = at.agg(F.sum("share").alias("__total"))
    later = running_totals(at, "ends", ["share"], descending=True)
    return (
        later.join(F.broadcast(total))
        .filter(F.expr(f"run_share - share < {least_running} * __total"))
        .agg(F.min("ends").cast("bigint").alias("__last"))
    )


def mix(docs: DataFrame, weights: DataFrame | dict[str, float] | None = None,
        source_col: str = "source", key: tuple[str, ...] = ("doc_id",),
        block_rows: int = BLOCK_ROWS, least_running: float = LEAST_RUNNING,
        seed: int = 2) -> DataFrame:
    """All rows and columns of docs plus share (of the weight, as a whole number), block (from 0 in
    its source), release, deadline, slot, place (row in the block) and in_mix.

    Rows of a source come in the order of a hash of `key`. slot and place order the whole mix.
    in_mix is false behind the slot at which so many sources have run out that the rest holds less
    than least_running of the weight: what comes there is surplus of over-supplied sources. Any
    number of sources is mixed. A null source counts as the source ''. Rows of a source without a
    weight keep null slots and are not in the mix. Rows with equal keys take neighbouring places.
    An empty table gives an empty result. Columns of docs named share, block, release, deadline,
    slot, place or in_mix, or beginning with two underscores, are replaced or dropped.
    """
    own = [c for c in docs.columns if c not in _ADDED and not c.startswith("__")]
    n = docs.count()
    bits = max(6, math.ceil(math.log2(max(n / _BUCKET_ROWS, 1))))
    rows = (
        docs.select(*own)
        .withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
        .withColumn("__k", F.xxhash64(F.lit(seed), *key))
        .withColumn("__bucket", F.expr(f"cast(shiftrightunsigned(__k, {64 - bits}) as int)"))
    )
    # A source is ordered in buckets of the hash, so that a large one is many pieces.
    counts = stage(
        rows.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n")), "mix-counts"
    )
    before = Window.partitionBy("__source").orderBy("__bucket")
    starts = counts.select(
        "__source", "__bucket",
        (F.sum("__n").over(before) - F.col("__n")).alias("__start"),
    )
    sizes = counts.groupBy(F.col("__source").alias("source")).agg(F.sum("__n").alias("n"))
    blocks = stage(schedule(sizes, weights, block_rows), "mix-blocks")

    local = Window.partitionBy("__source", "__bucket").orderBy("__k")
    placed = (
        rows.withColumn("__row", F.row_number().over(local))
        .join(starts, ["__source", "__bucket"])
        .withColumn("__row", F.col("__start") + F.col("__row") - 1)
        .withColumn("block", F.expr(f"__row div {block_rows}"))
        .withColumn("place", F.expr(f"cast(__row % {block_rows} as int)"))
        .join(blocks.withColumnRenamed("source", "__source"), ["__source", "block"], "left")
        .join(F.broadcast(_end_of_mix(blocks, least_running)))
    )
    return placed.select(
        *own, "share", "block", "release", "deadline", "slot", "place",
        F.expr("coalesce(slot <= __last, false)").alias("in_mix"),
    )


def in_mix_order(docs: DataFrame, surplus: bool = False, **options) -> DataFrame:
    """The rows of docs that are in the mix, with the columns of docs only, sorted by slot and
    place over all partitions. With surplus all rows: what comes behind the mix's end follows it,
    and rows of sources without a weight come last. Columns of docs that have the names of the
    mix's own are kept."""
    source = options.pop("source_col", "source")
    key = options.pop("key", ("doc_id",))
    packed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(source).alias("source"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)],
    )
    mixed = mix(packed, key=tuple(f"k{i}" for i in range(len(key))), **options)
    kept = mixed if surplus else mixed.filter("in_mix")
    return kept.sort(F.asc_nulls_last("slot"), "place").select("row.*")
