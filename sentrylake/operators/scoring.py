"""Feature statistics, batch scaling, the baseline score and feature attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import percentile_band, quantile_scaled
from ..schema import FEATURES
from .quantiles import exact_quantiles

STAT_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
STAT_NAMES = ("mean", "std", "p5", "p25", "p50", "p75", "p95", "p99")


def feature_stats(windows: DataFrame, stored: bool = False) -> DataFrame:
    """13 rows: feature, n, mean, population std (+1e-6) and six quantiles. stored: windows are a
    stored table, which is read as it is."""
    stats = exact_quantiles(
        windows,
        FEATURES,
        STAT_QUANTILES,
        extra=("avg(x) as mean", "stddev_pop(x) + 1e-6D as std"),
        stored=stored,
    )
    return stats.withColumnRenamed("name", "feature").select("feature", "n", *STAT_NAMES)


def stats_row(stats: DataFrame) -> DataFrame:
    """The 13 statistics rows as one row with a struct column s_<feature> each."""
    packed = f"struct({', '.join(STAT_NAMES)})"
    return stats.agg(
        *[F.expr(f"first(case when feature = '{f}' then {packed} end, true) as s_{f}")
          for f in FEATURES]
    )


def with_stats(windows: DataFrame, stats: DataFrame) -> DataFrame:
    # One row of 13 structs: the broadcast does not grow with the data.
    return windows.crossJoin(F.broadcast(stats_row(stats)))


def _z(feature: str) -> str:
    s = f"s_{feature}"
    return (
        f"case when {s}.std > 0 then abs((cast({feature} as double) - {s}.mean) / {s}.std) "
        "else 0D end"
    )


def _drop_stats(df: DataFrame) -> DataFrame:
    return df.drop(*[f"s_{f}" for f in FEATURES])


def scale_by_batch(
    df: DataFrame, column: str, out: str, frozen: DataFrame | None = None, stored: bool = False
) -> DataFrame:
    """(x - q10) / (q90 - q10) clipped to [0, 1], with the quantiles of this batch or, for
    streams, frozen ones (a one-row DataFrame with p10 and p90). stored: df is a stored table."""
    q = exact_quantiles(df, [column], (0.1, 0.9), stored=stored) if frozen is None else frozen
    q = q.select(F.col("p10").alias("_q10"), F.col("p90").alias("_q90"))
    return (
        df.crossJoin(F.broadcast(q))
        .withColumn(out, quantile_scaled(F.col(column), F.col("_q10"), F.col("_q90")))
        .drop("_q10", "_q90")
    )


def baseline_scores(windows: DataFrame, stats: DataFrame) -> DataFrame:
    """Largest z over the features per window: raw_score."""
    largest = f"greatest({', '.join(_z(f) for f in FEATURES)})"
    return _drop_stats(with_stats(windows, stats).withColumn("raw_score", F.expr(largest)))


def _entry(z: str, pos: int, feature: str, percentile: str) -> str:
    return (
        f"struct(-({z}) as order_z, {pos} as pos, '{feature}' as feature, "
        f"cast({feature} as double) as value, {percentile} as percentile)"
    )


def with_top_features(windows: DataFrame, stats: DataFrame | None, k: int) -> DataFrame:
    """Add `top`, by z against the statistics or, without any, inside each row's own vector."""
    if stats is not None:
        # Sorted inside the row, so nothing is shuffled.
        items = ", ".join(
            _entry(_z(f), i, f, percentile_band(f"cast({f} as double)", f"s_{f}"))
            for i, f in enumerate(FEATURES)
        )
        return _drop_stats(
            with_stats(windows, stats).withColumn(
                "top", F.expr(f"slice(sort_array(array({items})), 1, {k})")
            )
        )
    xs = F.array(*[F.col(f).cast("double") for f in FEATURES])
    names = F.array(*[F.lit(f) for f in FEATURES])
    n = F.lit(float(len(FEATURES)))
    # Lambda variables over one-element arrays bind mean and deviation once per row.
    means = F.array(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n)
    spreads = F.transform(
        means,
        lambda m: F.struct(
            m.alias("mean"),
            (
                F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)
                + F.lit(1e-6)
            ).alias("std"),
        ),
    )
    ranked = F.transform(
        spreads,
        lambda s: F.sort_array(
            F.transform(
                xs,
                lambda x, i: F.struct(
                    (-F.abs((x - s["mean"]) / s["std"])).alias("order_z"),
                    i.alias("pos"),
                    F.get(names, i).alias("feature"),
                    x.alias("value"),
                    F.lit(50.0).alias("percentile"),
                ),
            )
        ),
    )
    return windows.withColumn("top", F.slice(F.get(ranked, F.lit(0)), 1, k))


def explain_features(windows: DataFrame, stats: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One row per window and contributing feature, rank 1..k."""
    listed = with_top_features(windows, stats, k)
    return listed.select(
        "user_name", "ip", "start_ts", F.posexplode("top").alias("i", "t")
    ).select(
        "user_name",
        "ip",
        "start_ts",
        (F.col("i") + 1).alias("rank"),
        "t.feature",
        "t.value",
        F.round(-F.col("t.order_z"), 2).alias("z_score"),
        "t.percentile",
        F.round(-F.col("t.order_z"), 2).alias("attribution"),
    )
