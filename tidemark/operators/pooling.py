"""Ordered pooling of scores by call, and statistics that transforms are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.universe import quantiles


def _ranked(scores: DataFrame, by: list[str], order: str, score: str) -> DataFrame:
    return scores.where(F.col(score).isNotNull()).withColumns({"__i": F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def pool(scores: DataFrame, by: list[str], order: str = "pair_index", score: str = "score") -> DataFrame:
    """Per group every pooling: mean, max, median, min, first, last, top3_mean, bottom3_mean, recency_weighted_mean (weights 1 to 2). Null scores do not count."""
    r = _ranked(scores, by, order, score)
    w = F.when(F.col("__n") > 1, 1 + F.col("__i") / (F.col("__n") - 1)).otherwise(1.0)
    a = F.array_sort(F.collect_list(F.col(score).cast("double")))
    return r.groupBy(*by).agg(
        F.count("*").alias("num_pairs"), F.avg(score).alias("mean"), F.max(score).alias("max"), F.median(score).alias("median"), F.min(score).alias("min"), F.min_by(score, "__i").alias("first"), F.max_by(score, "__i").alias("last"),
        _mean(F.slice(a, F.greatest(F.size(a) - 2, F.lit(1)), F.lit(3))).alias("top3_mean"), _mean(F.slice(a, 1, 3)).alias("bottom3_mean"), (F.sum(F.col(score) * w) / F.sum(w)).alias("recency_weighted_mean"),
    )


def rich_features(scores: DataFrame, by: list[str], order: str = "pair_index", score: str = "score") -> DataFrame:
    """``pool`` and spread, range, quantiles, recent3_mean, last_minus_first, trend slope (0 under two scores or when flat)."""
    r = _ranked(scores, by, order, score)
    flat = F.max(score) - F.min(score) <= 1e-8 + 1e-5 * F.abs(F.min_by(score, "__i"))
    more = r.groupBy(*by).agg(
        F.stddev_pop(score).alias("std"), (F.max(score) - F.min(score)).alias("range"), *[F.percentile(score, q).alias(n) for q, n in ((0.25, "q25"), (0.75, "q75"), (0.9, "q90"))],
        F.avg(F.when(F.col("__i") >= F.col("__n") - 3, F.col(score))).alias("recent3_mean"), (F.max_by(score, "__i") - F.min_by(score, "__i")).alias("last_minus_first"),
        F.when((F.count("*") < 2) | flat, 0.0).otherwise(F.regr_slope(F.col(score), F.col("__i").cast("double"))).alias("trend_slope"),
    )
    return pool(scores, by, order, score).join(more, by)


def residual_pool(predictions: DataFrame, by: list[str], score: str = "pair_residual_pred", k: int = 3) -> DataFrame:
    """Per call mean, max, population spread and mean of the k greatest pair residuals."""
    a = F.array_sort(F.collect_list(F.col(score).cast("double")))
    return predictions.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("pair_count"), F.avg(score).alias("mean_pair_residual"), F.max(score).alias("max_pair_residual"), F.stddev_pop(score).alias("std_pair_residual"),
        _mean(F.slice(a, F.greatest(F.size(a) - (max(k, 1) - 1), F.lit(1)), F.lit(max(k, 1)))).alias("topk_mean_pair_residual"),
    )


def attach(calls: DataFrame, pooled: DataFrame, columns: list[str], key: str = "call_id") -> DataFrame:
    """``calls`` with the pooled columns, 0 where a call has none."""
    return calls.join(pooled.select(key, *columns), key, "left").fillna(0, columns)


def positions_in_call(pairs: DataFrame) -> DataFrame:
    """Adds pair_position_frac (index over the last index) and pair_position_from_end."""
    n = F.max("pair_index").over(Window.partitionBy("call_id")) + 1
    return pairs.withColumns({"pair_position_frac": F.col("pair_index") / F.greatest(n - 1, F.lit(1)), "pair_position_from_end": n - 1 - F.col("pair_index")})


def scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median, mean, std) of the finite values; a spread under 1e-8 counts as 1."""
    fin = {c: F.when(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) < float("inf"), F.col(c).cast("double")) for c in columns}
    one = train.agg(*[f(v).alias(f"{c}__{k}") for c, v in fin.items() for k, f in (("md", lambda x: F.percentile(x, 0.5)), ("mn", F.avg), ("sd", F.stddev_pop))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__md").alias("median"), F.col(f"{c}__mn").alias("mean"), F.when(F.col(f"{c}__sd") >= 1e-8, F.col(f"{c}__sd")).otherwise(1.0).alias("std")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def winsorise(train: DataFrame, everything: DataFrame, target: str, q: float = 0.05) -> DataFrame:
    """``everything`` with transformed: the target clipped to the train quantiles q and 1-q, centred and scaled by the clipped train values; and restored, the inverse (the clipped target)."""
    cut = quantiles(train, target, [q, 1 - q]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    clip = lambda: F.least(F.greatest(F.col(target), F.col("lo")), F.col("hi"))
    fit = train.crossJoin(F.broadcast(cut)).withColumn("__c", clip()).agg(F.avg("__c").alias("mu"), F.stddev_pop("__c").alias("sd"))
    sd = F.when(F.col("sd") >= 1e-8, F.col("sd")).otherwise(1.0)
    return everything.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(fit)).withColumn("transformed", (clip() - F.col("mu")) / sd).withColumn("restored", F.col("transformed") * sd + F.col("mu")).drop("lo", "hi", "mu", "sd")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = total / (2 * rows of the label); 1 for all if a class is missing."""
    n = rows.agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__q"))
    t = F.col("__p") + F.col("__q")
    w = F.when((F.col("__p") == 0) | (F.col("__q") == 0), 1.0).when(F.col(label) == 1, t / (2 * F.col("__p"))).otherwise(t / (2 * F.col("__q")))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", w).drop("__p", "__q")


def token_audit(rows: DataFrame, text: str) -> DataFrame:
    """Token counts of a text column (white space): mean, median, p90, p95, max and shares over 256, 512 and 1024."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))
    return rows.select(n.alias("n")).agg(
        F.count("*").alias("texts"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.9).alias("p90"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("max"),
        *[F.avg((F.col("n") > k).cast("int")).alias(f"share_over_{k}") for k in (256, 512, 1024)],
    )
