"""Training: events -> model tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import scoring as sc
from ..operators import sequences as sq
from ..operators.iforest import SAMPLE, SEED, TREES, forest_scores, train_forest
from ..operators.quantiles import exact_quantiles
from ..operators.reconstruction import COMPONENTS, fit_reconstruction, reconstruction_errors
from ..operators.staging import stage
from ..options import DEFAULTS, Options
from .detect import Models

TABLES = {
    "feature_stats": "stats",
    "vocab": "vocab",
    "transitions": "transitions",
    "model_trees": "trees",
    "reconstruction": "reconstruction",
    "score_quantiles": "quantiles",
}


def fit(
    events: DataFrame,
    path: str,
    opts: Options = DEFAULTS,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
    components: int = COMPONENTS,
) -> Models:
    """Fit every model on the events, write the tables under path and read them back."""
    spark = events.sparkSession
    windows = stage(ft.window_features(events, opts), "train-windows")

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    save(sc.feature_stats(windows, stored=True), "feature_stats")
    forest = save(train_forest(windows, trees, sample, seed), "model_trees")
    linear = save(fit_reconstruction(windows, components), "reconstruction")

    vocab = save(sq.token_vocab(events, opts), "vocab")
    pairs = stage(sq.session_transitions(sq.session_tail(events, vocab, opts)), "train-pairs")
    table = save(sq.fit_transitions(pairs), "transitions")

    raw = stage(reconstruction_errors(forest_scores(windows, forest), linear), "train-scores")
    q = exact_quantiles(
        raw, ["forest_raw", "reconstruction_raw"], (0.1, 0.9), stored=True
    )
    surprise = sq.surprisal(pairs, table, vocab).select(F.col("raw_score").alias("sequence_raw"))
    save(q.unionByName(exact_quantiles(surprise, ["sequence_raw"], (0.1, 0.9))), "score_quantiles")
    return load_models(spark, path)


def load_models(spark: SparkSession, path: str, frozen_quantiles: bool = False) -> Models:
    """The model tables. frozen_quantiles scales scores with the training quantiles instead of
    those of each batch, which keeps scores of small stream batches comparable."""
    found = {field: spark.read.parquet(f"{path}/{name}") for name, field in TABLES.items()}
    if not frozen_quantiles:
        found.pop("quantiles")
    return Models(**found)
