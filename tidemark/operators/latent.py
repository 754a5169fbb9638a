"""Latent features of activations: what they fire on, what they carry, how they align with labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, vec: str, label: str) -> DataFrame:
    """(feature, z, y)."""
    return rows.select(F.posexplode(vec).alias("feature", "z"), F.col(label).cast("double").alias("y")).withColumn("z", F.col("z").cast("double"))


def feature_report(rows: DataFrame, vec: str, label: str) -> DataFrame:
    """(feature, mean_activation, label_corr): 0 where a side is constant."""
    c = F.when((F.stddev_pop("z") < 1e-12) | (F.stddev_pop("y") < 1e-12), 0.0).otherwise(F.corr("z", "y"))
    return exploded(rows, vec, label).groupBy("feature").agg(F.avg("z").alias("mean_activation"), F.coalesce(c, F.lit(0.0)).alias("label_corr"))


def top_features(report: DataFrame, by: str, n: int) -> DataFrame:
    """The n features with the greatest size of ``by`` (ties: the smaller number)."""
    return report.orderBy(F.desc(F.abs(by)), "feature").limit(n)


def reconstruct(rows: DataFrame, vec: str, encoder: tuple[np.ndarray, np.ndarray], decoder: tuple[np.ndarray, np.ndarray], removed: list[int] = (), into: str = "decoded") -> DataFrame:
    """Adds relu(x W + b) V + c by Arrow batches, the listed latents set to 0 before decoding. Null vectors stay null."""
    (w, b), (v, c) = encoder, decoder
    gone = [int(r) for r in removed]

    @F.pandas_udf("array<double>")
    def both(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        there = np.flatnonzero(x.notna().to_numpy())
        if len(there):
            z = np.maximum(np.stack(x.to_numpy()[there]).astype(float) @ w + b, 0.0)
            z[:, gone] = 0.0
            for i, y in zip(there, z @ v + c):
                out.iat[i] = y
        return out

    return rows.withColumn(into, both(F.col(vec)))


def reconstruction_error(rows: DataFrame, vec: str, decoded: str):
    """The squared error summed over a row's components, as an expression; null for null vectors."""
    return F.aggregate(F.zip_with(decoded, vec, lambda a, b: (a - b.cast("double")) * (a - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)


def ablation(rows: DataFrame, vec: str, encoder: tuple[np.ndarray, np.ndarray], decoder: tuple[np.ndarray, np.ndarray], removed: list[int]) -> DataFrame:
    """(mse_base, mse_ablated, delta): the autoencoder's mean squared reconstruction error, and with the listed latents at 0."""
    r = reconstruct(reconstruct(rows, vec, encoder, decoder, into="__all"), vec, encoder, decoder, removed, "__less")
    n = F.sum(F.size(vec))
    one = r.where(F.col(vec).isNotNull()).agg((F.sum(reconstruction_error(r, vec, "__all")) / n).alias("mse_base"), (F.sum(reconstruction_error(r, vec, "__less")) / n).alias("mse_ablated"))
    return one.withColumn("delta", F.col("mse_ablated") - F.col("mse_base"))


def label_alignment(rows: DataFrame, vec: str, label: str, n: int = 20) -> DataFrame:
    """(label_alignment_corr): mean activation of the n features most correlated with the label, against the label. At most n numbers reach the driver."""
    top = [r["feature"] for r in top_features(feature_report(rows, vec, label), "label_corr", n).collect()]
    strength = sum((F.get(F.col(vec), i).cast("double") for i in top[1:]), F.get(F.col(vec), top[0]).cast("double")) / len(top) if top else F.lit(0.0)
    s = rows.select(strength.alias("s"), F.col(label).cast("double").alias("y"))
    return s.agg(F.when((F.stddev_pop("s") < 1e-12) | (F.stddev_pop("y") < 1e-12), 0.0).otherwise(F.corr("s", "y")).alias("label_alignment_corr"))


def encode(rows: DataFrame, vec: str, weights: np.ndarray, bias: np.ndarray, into: str = "latent") -> DataFrame:
    """Adds relu(x W + b), by Arrow batches; the weights have the model's fixed size."""

    @F.pandas_udf("array<double>")
    def forward(x: pd.Series) -> pd.Series:
        z = np.maximum(np.stack(x.to_numpy()).astype(float) @ weights + bias, 0.0)
        return pd.Series(list(z))

    return rows.withColumn(into, forward(F.col(vec)))


def score_batches(rows: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """The slot for models: ``fn`` maps a pandas frame of ``columns`` to one of ``schema``, batch by batch."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return rows.select(*columns).mapInPandas(run, schema)
