"""Isolation forest (Liu, Ting, Zhou 2008), grown level by level from aggregates.

Every choice (which rows a tree sees, the feature and the place of a cut) is a number read from an
MD5, so that any engine grows the same trees from the same windows. A level of all trees is one
aggregate: the number of rows and the least and greatest value of each feature per (tree, node).
The rows of all samples are trees * sample at most, whatever the table holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefn import to_instant
from ..schema import FEATURES
from .staging import stage

# Size of the forest and seed.
TREES, SAMPLE, SEED = 300, 256, 7
_BITS = 52


def number(*parts: Column | str | int) -> Column:
    """A whole number of 52 bits: the first 13 digits of the MD5 of the parts, put together with
    '|' (null as empty)."""
    texts = [F.lit(str(p)) if isinstance(p, int) else F.coalesce(
        (F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 13), 16, 10).cast("bigint")


def unit(*parts: Column | str | int) -> Column:
    """Such a number as a share in [0, 1)."""
    return number(*parts) / F.lit(float(1 << _BITS))


def window_key() -> Column:
    """Text that stands for a window: user, address and start in microseconds."""
    return F.concat_ws(
        "|", F.coalesce("user_name", F.lit("")), F.coalesce("ip", F.lit("")),
        F.unix_micros(to_instant(F.col("start_ts"))).cast("string"),
    )


def tree_samples(
    windows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """At most `sample` rows per tree, chosen by hash: tree_id and the features.

    Each row draws about 1.5 * trees * sample / n trees, so the number of drawn rows stays the
    same whatever n is; a table smaller than a sample goes to every tree."""
    n = windows.agg(F.count(F.lit(1)).alias("n"))  # one row
    rate = F.lit(1.5 * trees * sample) / F.col("n")
    draws = F.floor(rate) + F.when(unit("key", seed) < rate - F.floor(rate), 1).otherwise(0)
    everywhere = F.sequence(F.lit(0), F.lit(trees - 1))
    slots = F.transform(
        F.sequence(F.lit(1), draws.cast("int")),
        lambda j: (number("key", j, seed + 1) % trees).cast("int"),
    )
    chosen = (
        F.when(rate >= trees, everywhere)
        .when(draws >= 1, F.array_distinct(slots))
        .otherwise(F.array().cast("array<int>"))
    )
    drawn = (
        windows.select(window_key().alias("key"), *[F.col(f).cast("double") for f in FEATURES])
        .crossJoin(F.broadcast(n))
        .select(F.explode(chosen).alias("tree_id"), "key", *FEATURES)
    )
    rank = F.row_number().over(
        Window.partitionBy("tree_id").orderBy(number("key", "tree_id", seed + 2), "key")
    )
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= sample).select(
        "tree_id", *FEATURES
    )


def _average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _average_path_of(n: Column) -> Column:
    return (
        F.when(n <= 1, 0.0)
        .when(n == 2, 1.0)
        .otherwise(2.0 * (F.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n)
    )


def train_forest(
    windows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """The node table: tree_id, node (the children of node i are 2 i + 1 and 2 i + 2), feature (by
    number, -1 for a leaf), threshold, path (of a leaf) and sample_size.

    A node is cut if it holds two rows or more, lies above the level log2 of its tree's rows, and
    some feature differs in it: a random one of these, at a random place between its least and
    greatest value. Rows up to the threshold go to the first child."""
    rows = stage(tree_samples(windows, trees, sample, seed).withColumn("node", F.lit(0)), "sample")
    sizes = rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("sample_size"))
    grown = None
    for depth in range(math.ceil(math.log2(max(sample, 2))) + 1):
        lows, highs = ([F.expr(f"{f}({x})") for x in FEATURES] for f in ("min", "max"))
        level = (
            rows.groupBy("tree_id", "node")
            .agg(F.count(F.lit(1)).alias("n"), F.array(*lows).alias("low"),
                 F.array(*highs).alias("high"))
            .join(sizes, "tree_id")
            .withColumn("open", F.expr(
                f"filter(sequence(0, {len(FEATURES) - 1}), f -> high[f] > low[f])"))
            .withColumn("cut", F.expr("n > 1 and size(open) > 0") & (
                F.lit(depth) < F.ceil(F.log2(F.greatest("sample_size", F.lit(2))))))
            .withColumn("feature", F.when(F.col("cut"), F.get(
                "open", (number("tree_id", "node", seed + 3) % F.size("open")).cast("int"))
            ).otherwise(-1))
            .withColumn("threshold", F.when(F.col("cut"), F.expr("low[feature]") + (
                F.expr("high[feature]") - F.expr("low[feature]"))
                * unit("tree_id", "node", seed + 4)).otherwise(0.0))
            .withColumn("path", F.when(~F.col("cut"), depth + _average_path_of(F.col("n"))))
            .select("tree_id", "node", "feature", "threshold", "path", "sample_size")
        )
        level = stage(level, f"level-{depth}")
        grown = level if grown is None else grown.unionByName(level)
        value = F.get(F.array(*FEATURES), F.col("feature"))
        # a row for each node of a level: `trees` times `sample` at most
        cuts = level.filter("feature >= 0").select("tree_id", "node", "feature", "threshold")
        rows = stage(
            rows.join(F.broadcast(cuts), ["tree_id", "node"])
            .withColumn("node", F.expr("2 * node + 1") + F.when(value <= F.col("threshold"), 0)
                        .otherwise(1))
            .select("tree_id", "node", *FEATURES),
            f"rows-{depth}",
        )
    return grown


def forest_scores(windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add forest_raw = 2^(-mean path / expected path).

    The node table is bounded by trees * (2 * sample - 1) rows and goes to the executors as
    one broadcast variable."""
    table = nodes.orderBy("tree_id", "node").toPandas()
    place = table["tree_id"].to_numpy(np.int64) << 32 | table["node"].to_numpy(np.int64)
    leaf = table["feature"].to_numpy() < 0
    own = np.arange(len(table))

    def child(which: int) -> np.ndarray:
        """Positions of the children; a leaf points at itself, so that every walk can take the
        same number of steps."""
        at = place - table["node"].to_numpy(np.int64) + 2 * table["node"].to_numpy(np.int64) + which
        return np.where(leaf, own, np.searchsorted(place, at)).astype(np.int32)

    largest = int(table["sample_size"].max()) if len(table) else 1
    model = {
        "roots": np.flatnonzero(table["node"].to_numpy() == 0).astype(np.int32),
        "feature": np.where(leaf, 0, table["feature"]).astype(np.int32),
        "cut": table["threshold"].to_numpy(),
        "left": child(1),
        "right": child(2),
        "path": table["path"].fillna(0.0).to_numpy(),
        "steps": math.ceil(math.log2(max(largest, 2))),
        "expected": _average_path(largest) if len(table) else 1.0,
    }
    shared = windows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = shared.value
        for rows in batches:
            x = rows.to_numpy(dtype=float)
            out = np.empty(len(x))
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                at = np.broadcast_to(m["roots"], (len(part), len(m["roots"])))
                for _ in range(m["steps"]):
                    value = np.take_along_axis(part, m["feature"][at], axis=1)
                    at = np.where(value <= m["cut"][at], m["left"][at], m["right"][at])
                mean_path = m["path"][at].mean(axis=1)
                out[i : i + 4096] = 2.0 ** (-mean_path / max(m["expected"], 1e-9))
            yield pd.Series(out)

    row = F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES])
    return windows.withColumn("forest_raw", walk(row))
