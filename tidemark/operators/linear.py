"""Closed-form linear models: sufficient statistics by one aggregate, solved on the driver at the size of the features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHAS = tuple(10 ** (-3 + i / 2) for i in range(13))


def available(train: DataFrame, features: list[str]) -> list[str]:
    """Features that have a value in the training rows; none of none."""
    if not features:
        return []
    n = train.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in features]).first()
    return [c for c in features if n[c]]


class Ridge:
    """Median imputation, standardisation by population spread, ridge with the penalty of least exact leave-one-out error."""

    def __init__(self, features: list[str], alphas: tuple[float, ...] = ALPHAS) -> None:
        self.features, self.alphas = list(features), alphas

    def _x(self) -> list[Column]:
        out = []
        for c, md, mu, sd in zip(self.features, self.median, self.mean, self.std):
            v = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(md)))
            out.append((v - float(mu)) / float(sd))
        return out

    def fit(self, train: DataFrame, target: str) -> "Ridge":
        num = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        t = train.where(F.col(target).isNotNull())
        k = len(self.features)
        md = t.agg(*[F.percentile(num(c), 0.5) for c in self.features]).first()
        self.median = [m if m is not None else 0.0 for m in md]
        filled = [F.coalesce(num(c), F.lit(float(m))) for c, m in zip(self.features, self.median)]
        st = t.agg(*[f(v) for v in filled for f in (F.avg, F.stddev_pop)]).first()
        self.mean = [st[2 * i] or 0.0 for i in range(k)]
        self.std = [st[2 * i + 1] if (st[2 * i + 1] or 0) > 1e-12 else 1.0 for i in range(k)]
        x, y = self._x(), F.col(target).cast("double")
        g = t.agg(F.count("*"), F.avg(y), *[F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)], *[F.sum(x[i] * y) for i in range(k)]).first()
        n, ybar, rest = g[0], g[1], list(g[2:])
        gram = np.zeros((k, k))
        at = 0
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = rest[at]
                at += 1
        b = np.array(rest[at:], float)
        coef = {a: np.linalg.solve(gram + a * np.eye(k), b) for a in self.alphas}
        inv = {a: np.linalg.inv(gram + a * np.eye(k)) for a in self.alphas}
        alphas = self.alphas

        def errors(batches):
            total = np.zeros(len(alphas))
            for r in batches:
                m = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in r.columns])
                xs, ys = m[:, :-1], m[:, -1]
                for j, al in enumerate(alphas):
                    lever = 1.0 / n + ((xs @ inv[al]) * xs).sum(axis=1)
                    total[j] += float((((ys - ybar - xs @ coef[al]) / (1.0 - lever)) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(alphas))), pa.array(total)], ["j", "e"])

        rows = t.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y")).mapInArrow(errors, "j bigint, e double")
        loo = {r["j"]: r["e"] / n for r in rows.groupBy("j").agg(F.sum("e").alias("e")).collect()}
        self.loo = {al: loo.get(j, float("inf")) for j, al in enumerate(alphas)}
        self.alpha = min(self.alphas, key=lambda a: self.loo[a])
        self.coef, self.intercept = coef[self.alpha], float(ybar)
        return self

    def predict(self) -> Column:
        """The prediction as an expression."""
        return sum((x * float(c) for x, c in zip(self._x(), self.coef)), F.lit(self.intercept))


def residual_targets(train: DataFrame, frames: DataFrame, features: list[str], target: str) -> tuple[DataFrame, Ridge]:
    """``frames`` with baseline_pred and residual_target of a ridge fitted on ``train`` alone; absent features count as 0."""
    for c in features:
        if c not in frames.columns:
            train, frames = train.withColumn(c, F.lit(0.0)), frames.withColumn(c, F.lit(0.0))
    m = Ridge(available(train, features) or features).fit(train, target)
    return frames.withColumn("baseline_pred", m.predict()).withColumn("residual_target", F.col(target) - F.col("baseline_pred")), m


def final_prediction(calls: DataFrame, residual: str = "mean_pair_residual") -> DataFrame:
    """Adds final_pred: the baseline plus the pooled residual, 0 where there is none."""
    return calls.withColumn("final_pred", F.col("baseline_pred") + F.coalesce(residual, F.lit(0.0)))


class Calibrator:
    """Logistic regression of a label on one score (penalty as C = 1), by Newton steps over aggregates; constant if a class is missing."""

    def fit(self, train: DataFrame, score: str, label: str, steps: int = 25) -> "Calibrator":
        t = train.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
        n, mean = t.agg(F.count("*"), F.avg("y")).first()
        self.score, self.w, self.b, self.rate = score, 0.0, 0.0, mean if n else 0.5
        self.constant = not n or mean in (0.0, 1.0)
        for _ in range(0 if self.constant else steps):
            p = 1 / (1 + F.exp(-(F.col("s") * self.w + self.b)))
            v = p * (1 - p)
            g = t.agg(F.sum((p - F.col("y")) * F.col("s")), F.sum(p - F.col("y")), F.sum(v * F.col("s") * F.col("s")), F.sum(v * F.col("s")), F.sum(v)).first()
            h = np.array([[g[2] + 1.0, g[3]], [g[3], g[4] + 1e-12]])
            d = np.linalg.solve(h, np.array([g[0] + self.w, g[1]]))
            self.w, self.b = self.w - float(d[0]), self.b - float(d[1])
            if np.abs(d).max() < 1e-9:
                break
        return self

    def predict(self) -> Column:
        return F.lit(float(self.rate)) if self.constant else 1 / (1 + F.exp(-(F.col(self.score) * self.w + self.b)))


def boosted(train: DataFrame, features: list[str], label: str, weight: str | None = None, iterations: int = 250):
    """A gradient boosted classifier of Spark ML over imputed features; similar to, not equal to, histogram boosting."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    out = [f"{c}__i" for c in features]
    stages = [Imputer(inputCols=features, outputCols=out, strategy="median"), VectorAssembler(inputCols=out, outputCol="__features"), GBTClassifier(featuresCol="__features", labelCol=label, maxIter=iterations, maxDepth=3, stepSize=0.05, minInstancesPerNode=10, seed=42, **({"weightCol": weight} if weight else {}))]
    return Pipeline(stages=stages).fit(train)
