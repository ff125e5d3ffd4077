"""Reconstruction error under a linear autoencoder: principal components of the features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES

COMPONENTS = 4


def fit_reconstruction(windows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """13 rows: feature, mean, std, weights (array of k).

    One pass: means and the 91 covariances, which Spark merges task by task. Only the matrix of
    13 x 13 correlations is solved on the driver. A feature without spread, or of fewer than two
    rows, has std 1 and no part in the components."""
    d = len(FEATURES)
    numbers = windows.select(*[F.col(f).cast("double") for f in FEATURES])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = numbers.agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_samp(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    covariance = np.zeros((d, d))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"] or 0.0
    spread = np.sqrt(np.diag(covariance))
    spread[spread == 0] = 1.0
    # ascending eigenvalues
    _, vectors = np.linalg.eigh(covariance / np.outer(spread, spread))
    weights = vectors[:, ::-1][:, :k]
    rows = [
        (f, float(row[f"m{i}"] or 0.0), float(spread[i]), [float(w) for w in weights[i]])
        for i, f in enumerate(FEATURES)
    ]
    return windows.sparkSession.createDataFrame(
        rows, "feature string, mean double, std double, weights array<double>"
    )


def reconstruction_errors(windows: DataFrame, model: DataFrame) -> DataFrame:
    """Add reconstruction_raw: mean squared error of the standardised features.

    The components are orthonormal, so the error is what the squared projections leave of the
    squared length: plain column arithmetic with 13 * k constants."""
    rows = {r["feature"]: r for r in model.collect()}  # 13 rows
    z = {
        f: f"((cast({f} as double) - {rows[f]['mean']!r}D) / {rows[f]['std']!r}D)" for f in FEATURES
    }
    standard = windows.select(
        "*", *[F.expr(text).alias(f"_z_{f}") for f, text in z.items()]
    )
    length = " + ".join(f"_z_{f} * _z_{f}" for f in FEATURES)
    k = len(rows[FEATURES[0]]["weights"])
    projections = [
        " + ".join(f"{rows[f]['weights'][j]!r}D * _z_{f}" for f in FEATURES) for j in range(k)
    ]
    projected = standard.select(
        "*",
        F.expr(length).alias("_length"),
        *[F.expr(p).alias(f"_p{j}") for j, p in enumerate(projections)],
    )
    explained = " + ".join(f"_p{j} * _p{j}" for j in range(k))
    return projected.withColumn(
        "reconstruction_raw", F.expr(f"greatest(0D, (_length - ({explained})) / {len(FEATURES)}D)")
    ).drop("_length", *[f"_p{j}" for j in range(k)], *[f"_z_{f}" for f in FEATURES])
