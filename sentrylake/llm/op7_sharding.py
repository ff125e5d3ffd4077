"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in buckets by a hash. How many rows of bucket p go to shard k is drawn first: the counts
of a uniform shuffle are multivariate hypergeometric, and they are drawn down a binary tree over
the buckets (each inner node splits its shard sizes between its halves), so no chain runs over all
buckets. Then each bucket puts its rows in random order and deals them out by its row of the
matrix (first permutation), rows meet in their shards (exchange) and are put in random order there
(second permutation). Shard sizes are exact because the matrix adds up to them; only counts, never
rows, are seen as a whole. All randomness is a hash of seed and position, so a task that runs
again after a lost executor makes the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stage

# A bucket holds about this many rows; there are 64 at least.
BUCKET_ROWS = 100_000
# Tree levels made in one task before the nodes are spread.
_LEVELS_IN_ONE_TASK = 6


def _draw(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL text of a hypergeometric draw: how many of `marked` among `total` are in a sample of
    `drawn`. Weights relative to the mode follow by their ratios to both sides; a first walk adds
    them up, a second stops where they pass the uniform share. Ten standard deviations hold all
    mass that a 53-bit uniform can tell apart."""
    walk = f"""
      transform(array(struct(
        cast({total} as double) as t, cast({marked} as double) as m, cast({drawn} as double) as n,
        floor((cast({drawn} as double) + 1) * (cast({marked} as double) + 1)
              / (cast({total} as double) + 2)) as mode)), q -> struct(
        q.t as t, q.m as m, q.n as n, q.mode as mode,
        sequence(1, cast(40 + ceil(10 * sqrt(
          q.n * (q.m / q.t) * (1 - q.m / q.t) * ((q.t - q.n) / greatest(q.t - 1, 1.0)))) as int))
          as steps))[0]"""
    up = "s.up * ((q.m - s.b) * (q.n - s.b)) / ((s.b + 1) * (q.t - q.m - q.n + s.b + 1))"
    down = "s.down * (s.a * (q.t - q.m - q.n + s.a)) / ((q.m - s.a + 1) * (q.n - s.a + 1))"
    start = "cast(q.mode as double) as a, cast(q.mode as double) as b, 1.0D as up, 1.0D as down"
    weigh = f"""aggregate(q.steps, struct({start}, 1.0D as w),
      (s, i) -> struct(s.a - 1 as a, s.b + 1 as b, {up} as up, {down} as down,
                       s.w + {up} + {down} as w), s -> s.w)"""
    # left: what is still to pass; the value is taken at the first weight that uses it up.
    find = f"""aggregate(q.steps,
      struct({start}, {uniform} * {weigh} - 1.0D as left, cast(q.mode as double) as x),
      (s, i) -> if(s.left < 0, s, struct(
        s.a - 1 as a, s.b + 1 as b, {up} as up, {down} as down,
        s.left - {up} - {down} as left,
        if(s.left - {up} < 0, s.b + 1, s.a - 1) as x)),
      s -> cast(greatest(least(s.x, q.m, q.n), q.n - q.t + q.m, 0.0D) as bigint))"""
    return f"""(case when {drawn} = 0 or {marked} = 0 then 0L when {drawn} = {total} then {marked}
      when {marked} = {total} then {drawn}
      else transform(array({walk}), q -> {find})[0] end)"""


def _uniform(seed: int, *parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64({', '.join([f'{seed}L', *parts])}), 11) / {2.0**53!r}D)"


def communication_matrix(counts: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """counts (bucket, n) -> bucket, to_shard: array with the rows of the bucket for each shard.
    Buckets are numbered 0 to 2**levels - 1; missing ones are empty."""
    total = "aggregate(counts, 0L, (a, c) -> a + c)"
    every = f"sequence(0, {2**levels - 1})"
    nodes = counts.groupBy().agg(
        F.expr("map_from_entries(collect_list(struct(bucket, n)))").alias("by_bucket")
    ).selectExpr(
        "0 as node",
        f"transform({every}, b -> coalesce(by_bucket[b], 0L)) as counts",
    ).selectExpr(
        "node", "counts",
        f"transform(sequence(0, {shards - 1}), k -> {total} div {shards} "
        f"+ if(k < {total} % {shards}, 1L, 0L)) as sizes",
    )
    for level in range(levels):
        half = 2 ** (levels - level - 1)
        draw = _draw("s.rest", "s.size", "s.need",
                     _uniform(seed, f"{level}", "node", "s.k"))
        # (k, rest of all shards from k on, still needed by the left half, drawn so far)
        split = f"""aggregate(sequence(0, {shards - 1}),
          struct({total} as rest, aggregate(slice(counts, 1, {half}), 0L, (a, c) -> a + c) as need,
                 cast(array() as array<bigint>) as got),
          (z, k) -> transform(array(struct(z.rest as rest, z.need as need, sizes[k] as size,
                                           k as k)),
            s -> transform(array({draw}), x -> struct(
              s.rest - s.size as rest, s.need - x as need,
              concat(z.got, array(x)) as got))[0])[0],
          z -> z.got)"""
        nodes = nodes.selectExpr("node", "counts", "sizes", f"{split} as got").selectExpr(
            f"""inline(array(
              struct(2 * node as node, slice(counts, 1, {half}) as counts, got as sizes),
              struct(2 * node + 1 as node, slice(counts, {half + 1}, {half}) as counts,
                     zip_with(sizes, got, (a, b) -> a - b) as sizes)))"""
        )
        if level + 1 == _LEVELS_IN_ONE_TASK and levels > level + 1:
            nodes = nodes.repartition(F.col("node"))
    return nodes.selectExpr("node as bucket", "sizes as to_shard")


def _with_bucket(docs: DataFrame, key: list[str], levels: int, seed: int) -> DataFrame:
    return docs.withColumn("__k1", F.xxhash64(F.lit(seed), *key)).withColumn(
        "__bucket", F.expr(f"cast(shiftrightunsigned(__k1, {64 - levels}) as int)")
    )


def _dealt(rows: DataFrame, matrix: DataFrame, sub_bits: int, seed: int) -> DataFrame:
    """Adds shard, __k2 and __sub: the first permutation and the dealing out."""
    local = Window.partitionBy("__bucket").orderBy("__k1")
    upto = "transform(sequence(1, size(to_shard)), k -> aggregate(slice(to_shard, 1, k), 0L, " \
           "(a, c) -> a + c))"  # fmt: skip
    return (
        rows.withColumn("__place", F.row_number().over(local))
        .join(
            matrix.selectExpr("bucket as __bucket", f"{upto} as __upto"),
            "__bucket",
        )
        .withColumn("shard", F.expr("size(filter(__upto, c -> c < __place))"))
        .withColumn("__k2", F.xxhash64(F.lit(seed + 1), "__k1"))
        .withColumn("__sub", F.expr(f"cast(shiftrightunsigned(__k2, {64 - sub_bits}) as int)"))
        .drop("__upto", "__place", "__bucket", "__k1")
    )


def _sized(n: int, shards: int, bucket_rows: int) -> tuple[int, int]:
    """Bits of the hash that number a row's bucket, and its part of a shard."""
    levels = max(6, math.ceil(math.log2(max(n / bucket_rows, 1))))
    return levels, max(2, levels - int(math.log2(max(shards, 1))))


def _matrix(rows: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """The communication matrix, drawn once and written out: a row for each bucket."""
    counts = rows.groupBy(F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return stage(communication_matrix(counts, levels, shards, seed), "matrix")


def shuffle_into_shards(docs: DataFrame, key: list[str], shards: int = 16, seed: int = 7,
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of docs plus shard (0 to shards - 1, sizes at most one row apart) and
    slot (gapless from 0 in each shard).

    key: the columns whose hash stands for a row. Nulls in them are values like any other. Rows
    with equal keys are in the same bucket, keep one of their places each and differ in slot. An
    empty table gives an empty result. Columns of docs named shard, slot or beginning with two
    underscores are replaced.
    """
    levels, sub_bits = _sized(docs.count(), shards, bucket_rows)
    rows = _with_bucket(docs.drop("shard", "slot"), key, levels, seed)
    matrix = _matrix(rows, levels, shards, seed)

    # Where each part of a shard begins: a second, narrow pass over keys only.
    narrow = _dealt(rows.select("__k1", "__bucket"), matrix, sub_bits, seed)
    parts = narrow.groupBy("shard", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )

    second = Window.partitionBy("shard", "__sub").orderBy("__k2")
    return (
        _dealt(rows, matrix, sub_bits, seed)
        .withColumn("__place", F.row_number().over(second))
        .join(starts, ["shard", "__sub"])
        .withColumn("slot", F.col("__start") + F.col("__place") - 1)
        .select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def deal_into_shards(docs: DataFrame, key: list[str], shards: int = 16, seed: int = 7,
                     bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs plus shard, as shuffle_into_shards has it, for rows that are put in an order of their
    own in each shard (order_in_shards); the same holds for odd rows."""
    levels, sub_bits = _sized(docs.count(), shards, bucket_rows)
    rows = _with_bucket(docs.drop("shard"), key, levels, seed)
    dealt = _dealt(rows, _matrix(rows, levels, shards, seed), sub_bits, seed)
    return dealt.select(*[c for c in docs.columns if c != "shard"], "shard")


def order_in_shards(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """rows (with a column shard) plus slot, gapless from 0 in each shard in the order of `order`.

    part: SQL of a value that grows with the order and of which each value holds few rows in a
    shard. Rows whose part or order is null come first and keep a slot like any other; equal ones
    take neighbouring slots in no given order. An empty table gives an empty result. Columns named
    slot or beginning with two underscores are replaced.
    """
    parted = rows.drop("slot").withColumn("__part", F.struct(F.expr(part).alias("part")))
    counts = parted.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part")
    starts = counts.select(
        "shard", "__part", (F.sum("__n").over(before) - F.col("__n")).alias("__start")
    )
    local = Window.partitionBy("shard", "__part").orderBy(*order)
    return (
        parted.withColumn("__place", F.row_number().over(local))
        .join(starts, ["shard", "__part"])
        .withColumn("slot", F.col("__start") + F.col("__place") - 1)
        .select(*[c for c in rows.columns if c != "slot"], "slot")
    )


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes of the text, null: none, plus 1) and text_crc32 (null as empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
