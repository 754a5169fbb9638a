"""Ranking, calibration and error metrics of predictions, by group on demand.

Ranks and curves come from distinct scores with their class counts, so the sorted
part of the work is as large as the number of distinct scores, not of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.universe import average_rank, prefix_sums, quantiles


def _by_score(p: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    return p.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))


def roc_pr(p: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., rows, positives, auroc, auprc): rank-sum area and average precision; null where a class is missing.

    Without groups distinct scores are cumulated over ranges, so no task sees all of them.
    """
    by = by or []
    c = _by_score(p, by, y, score)
    if by:
        up = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
        c = c.withColumns({"tp": F.sum("pos").over(up), "seen": F.sum("n").over(up)})
    else:
        c = prefix_sums(c, "s", {"tp": "pos", "seen": "n"}, descending=True).withColumns({"tp": F.col("tp") + F.col("pos"), "seen": F.col("seen") + F.col("n")})
    neg = F.col("n") - F.col("pos")
    above_neg = F.col("seen") - F.col("tp")  # negatives at or above the score
    P, N = F.sum("pos"), F.sum("n") - F.sum("pos")
    wins = F.sum(F.col("pos") * (0 - above_neg + neg / 2))  # plus P * N
    return c.groupBy(*by).agg(
        F.sum("n").alias("rows"), P.alias("positives"), F.when((P > 0) & (N > 0), (P * N + wins) / (P * N)).alias("auroc"),
        F.when((P > 0) & (N > 0), F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / P).alias("auprc"),
    )


def confusion(p: DataFrame, y: str, prob: str, threshold=0.5, by: list[str] | None = None) -> DataFrame:
    """(by..., tn, fp, fn, tp, accuracy); ``threshold`` is a number or a column."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    hit, pos = F.col(prob) >= t, F.col(y) == 1
    return p.where(F.col(y).isNotNull() & F.col(prob).isNotNull()).groupBy(*(by or [])).agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"), F.avg((hit == pos).cast("int")).alias("accuracy"))


def errors(p: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by..., rmse, mae, mse)."""
    d = F.col(truth) - F.col(predicted)
    return p.groupBy(*(by or [])).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def correlations(p: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman): null when a side is constant."""
    q = p.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    r = average_rank(average_rank(q, "x", "rx"), "y", "ry")
    ok = lambda a, b: (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return r.agg(F.when(ok("x", "y"), F.corr("x", "y")).alias("pearson"), F.when(ok("x", "y"), F.corr("rx", "ry")).alias("spearman"))


def calibration_error(p: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """(ece, brier): equal bins, the last closed; edges are multiples of the bin's width in floating point."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    b = sum([(F.col(prob) >= e).cast("int") for e in edges[1:]], (F.col(prob) >= edges[0]).cast("int"))
    by = p.where(F.col(y).isNotNull() & F.col(prob).between(0, 1)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(prob).alias("conf"), F.sum(F.pow(F.col(y) - F.col(prob), 2)).alias("se"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), (F.sum("se") / F.sum("n")).alias("brier"))


def calibration_curve(p: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """(bin, rows, mean_predicted, fraction_positive) between quantile edges."""
    edges = quantiles(p, prob, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "e")
    b = F.size(F.filter("e", lambda x: x <= F.col(prob)))
    return p.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.avg(prob).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"))


def select_threshold(p: DataFrame, y: str, prob: str, objective: str = "accuracy") -> DataFrame:
    """(threshold, score): the best of a grid, all probabilities and the quartiles; ties go to the one nearest 0.5, then the lower.

    Candidates are scored from cumulated class counts, not by crossing them with the rows.
    """
    c = _by_score(p, [], y, prob)
    grid = [round(0.05 * i, 2) for i in range(1, 20)] + [0.25, 0.5, 0.75]
    extra = p.sparkSession.createDataFrame([(float(g),) for g in sorted(set(grid))], "s double").select("s", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"))
    c = c.select(F.least(F.greatest(F.col("s").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("s"), "pos", "n").unionByName(extra).groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    tot = c.agg(F.sum("pos").alias("P"), F.sum("n").alias("T"))
    c = prefix_sums(c, "s", {"tp": "pos", "hit": "n"}, descending=True).withColumns({"tp": F.col("tp") + F.col("pos"), "hit": F.col("hit") + F.col("n")}).crossJoin(F.broadcast(tot))
    N, fp = F.col("T") - F.col("P"), F.col("hit") - F.col("tp")
    tn, fn = N - fp, F.col("P") - F.col("tp")
    score = {
        "accuracy": (F.col("tp") + tn) / F.col("T"),
        "balanced_accuracy": (F.try_divide(F.col("tp"), F.col("P")) + F.try_divide(tn, N)) / 2,
        "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + fp + fn), F.lit(0.0)),
    }[objective]
    best = F.min(F.struct((-F.round(score, 12)).alias("a"), F.round(F.abs(F.col("s") - 0.5), 12).alias("b"), F.col("s").alias("t")))
    return c.agg(best.alias("x")).select(F.col("x.t").alias("threshold"), (-F.col("x.a")).alias("score"))


#: Resamples' weights: Poisson(1) up to where the rest is below the resolution of the draw (2 ** -40).
_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(16)])
_ROWS = 4096


def poisson_weights(keys: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """(rows, n_boot) Poisson(1) weights, drawn from each row's own 64-bit key so that re-runs agree."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
        for shift, prime in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(prime)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(24)).astype(float) / (1 << 40), side="right").astype(float)


def bootstrap(p: DataFrame, key: str, sums: dict, metrics: dict, n_boot: int = 400, seed: int = 42) -> DataFrame:
    """(metric, lower, upper): 95% intervals over Poisson resamples.

    Each row enters resample b with a Poisson(1) weight drawn from its own key. ``sums``
    maps names to columns whose weighted sums are taken, ``metrics`` names to functions of
    these sums (a dict of columns; ``n`` is the sum of weights). Within a batch the sums of
    all resamples are one matrix product; a task gives n_boot rows, whatever its input.
    A null counts as 0.
    """
    names = list(sums)
    rows = p.select(F.xxhash64(key).alias("k"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(sums.values())])

    def run(batches):
        total = np.zeros((n_boot, len(names) + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(b.column(i + 1).to_numpy() for i in range(len(names)))])
            k = b.column(0).to_numpy()
            for at in range(0, len(k), _ROWS):
                total += poisson_weights(k[at : at + _ROWS], n_boot, seed).T @ x[at : at + _ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *(pa.array(total[:, i]) for i in range(len(names) + 1))], ["b", "n", *(f"s{i}" for i in range(len(names)))])

    parts = rows.mapInArrow(run, ", ".join(["b bigint", "n double", *(f"s{i} double" for i in range(len(names)))]))
    one = parts.groupBy("b").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))]).where("n > 0")
    got = {"n": F.col("n")} | {c: F.col(f"s{i}") for i, c in enumerate(names)}
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(f(got).cast("double"), F.lit(None).cast("double")).alias("v")) for m, f in metrics.items()]))
    return one.select(values.alias("x")).groupBy("x.metric").agg(F.percentile("x.v", 0.025).alias("lower"), F.percentile("x.v", 0.975).alias("upper"))


def leaderboard(rows: DataFrame, name: str, spearman: str, auroc: str, listed: tuple[str, ...] = ()) -> DataFrame:
    """The best row by validation Spearman, then AUROC; missing ones lose, ties go to the first listed name, else the smaller one."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, listed)), F.col(name)), F.lit(0)) if listed else F.lit(0)
    low = lambda c: -F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(float("-inf")))
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct(low(spearman).alias("a"), low(auroc).alias("b"), place.alias("p"), F.col(name).alias("c"))).alias("x")).select("x.*")
