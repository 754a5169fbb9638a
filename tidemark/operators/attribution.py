"""Rationales and their faithfulness, with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>")

#: A scorer gives a score from the tokens and the mask (1 kept, 0 removed) of a row.
Scorer = Callable[[Column, Column], Column]


class Additive:
    """A scorer whose tokens add up: the weight of the kept tokens over all. Its curves need one pass over the tokens, not one per masking."""

    def __init__(self, weight: Callable[[Column], Column]) -> None:
        self.weight = weight

    def weights(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: self.weight(t).cast("double"))

    def __call__(self, tokens: Column, mask: Column) -> Column:
        n = self.weights(tokens)
        kept = F.aggregate(F.zip_with(n, mask, lambda a, m: a * m), F.lit(0.0), lambda a, x: a + x)
        return kept / F.aggregate(n, F.lit(0.0), lambda a, x: a + x)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def minmax(scores: Column) -> Column:
    """Scores moved to 0..1; all 0 where they hardly differ."""
    lo, hi = F.array_min(scores), F.array_max(scores)
    return F.transform(scores, lambda x: F.when(hi - lo <= 1e-12, 0.0).otherwise((x - lo) / (hi - lo)))


def ranked_positions(tokens: Column, scores: Column, skip_special: bool = True) -> Column:
    """Positions from the highest score to the lowest (ties: the later first), special tokens left out on demand."""
    rows = F.zip_with(F.zip_with(scores, F.sequence(F.lit(0), F.greatest(F.size(scores) - 1, F.lit(0))), lambda s, i: F.struct((-s).alias("s"), (-i).alias("i"))), tokens, lambda x, t: F.struct(x["s"].alias("s"), x["i"].alias("i"), t.alias("t")))
    if skip_special:
        rows = F.filter(rows, lambda r: ~r["t"].isin(*SPECIAL_TOKENS))
    return F.transform(F.array_sort(rows), lambda r: -r["i"])


def topk(tokens: Column, scores: Column, k: int, skip_special: bool = True) -> Column:
    """The positions of the k highest scores (at least one), in the order of the text."""
    return F.array_sort(F.slice(ranked_positions(tokens, scores, skip_special), 1, max(k, 1)))


def mask_without(tokens: Column, removed: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.when(F.array_contains(removed, i), 0.0).otherwise(1.0))


def mask_only(tokens: Column, kept: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.when(F.array_contains(kept, i), 1.0).otherwise(0.0))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, however often f reads it; inside a lambda it would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def faithfulness(rows: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """Adds rationale, comprehensiveness f(x) - f(x without it) and sufficiency f(x) - f(it alone). Empty rows have none."""
    r = rows.where(F.size("tokens") > 0).withColumn("rationale", topk(F.col("tokens"), F.col("scores"), k))
    t = F.col("tokens")
    full = scorer(t, F.transform(t, lambda _: F.lit(1.0)))
    without = bound(F.col("rationale"), lambda x: scorer(t, mask_without(t, x)))
    only = bound(F.col("rationale"), lambda x: scorer(t, mask_only(t, x)))
    return r.withColumns({"comprehensiveness": full - without, "sufficiency": full - only})


def deletion_curve(rows: DataFrame, key: str, scorer: Scorer, steps: int = 10) -> DataFrame:
    """(key, fraction_removed, score): the highest scored tokens are removed first, round(fraction * n) of them (half to even)."""
    order = F.transform(ranked_positions(F.col("tokens"), F.col("scores"), False), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    r = rows.where(F.size("tokens") > 0).withColumn("__r", F.transform(F.array_sort(order), lambda x: x["i"]))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("__i")).withColumn("fraction_removed", F.col("__i") / steps)
    gone = F.bround(F.col("fraction_removed") * F.size("tokens"), 0).cast("int")
    mask = bound(gone, lambda g: F.transform("__r", lambda x: F.when(x < g, 0.0).otherwise(1.0)))
    return r.select(key, "fraction_removed", scorer(F.col("tokens"), mask).alias("score"))


def curve_area(curve: DataFrame, key: str) -> DataFrame:
    """(key, auc): trapezoids under a deletion curve."""
    w = Window.partitionBy(key).orderBy("fraction_removed")
    part = (F.col("fraction_removed") - F.lag("fraction_removed").over(w)) * (F.col("score") + F.lag("score").over(w)) / 2
    return curve.withColumn("__p", part).groupBy(key).agg(F.sum("__p").alias("auc"))


def random_baseline(rows: DataFrame, key: str, scorer: Scorer, k: int, trials: int = 25, seed: int = 42) -> DataFrame:
    """(key, random_mean, random_std, random_n): comprehensiveness of random rationales, drawn by hash so that re-runs agree."""
    r = rows.where(F.size("tokens") > 0)
    if isinstance(scorer, Additive):
        r = r.select(key, scorer.weights(F.col("tokens")).alias("__w"))
        r = r.select(key, "__w", _sum(F.col("__w")).alias("__s"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("__t"))
        draw = F.transform("__w", lambda x, i: F.struct(F.xxhash64(F.col(key), F.col("__t"), i, F.lit(seed)).alias("h"), i.alias("i"), x.alias("w")))
        v = F.aggregate(F.slice(F.array_sort(draw), 1, max(k, 1)), F.lit(0.0), lambda a, x: a + x["w"]) / F.col("__s")
        return r.withColumn("__v", v).groupBy(key).agg(F.avg("__v").alias("random_mean"), F.stddev_pop("__v").alias("random_std"), F.count("*").alias("random_n"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("__t"))
    draw = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.struct(F.xxhash64(F.col(key), F.col("__t"), i, F.lit(seed)).alias("h"), i.alias("i")))
    drawn = F.transform(F.slice(F.array_sort(draw), 1, max(k, 1)), lambda s: s["i"])
    t = F.col("tokens")
    v = scorer(t, F.transform(t, lambda _: F.lit(1.0))) - bound(drawn, lambda x: scorer(t, mask_without(t, x)))
    return r.withColumn("__v", v).groupBy(key).agg(F.avg("__v").alias("random_mean"), F.stddev_pop("__v").alias("random_std"), F.count("*").alias("random_n"))


def perturbation(rows: DataFrame, key: str, scorer: Scorer) -> DataFrame:
    """(key, position, importance): how far the score falls without each token, never below 0; special tokens left out."""
    t = F.col("tokens")
    if isinstance(scorer, Additive):
        r = rows.where(F.size("tokens") > 0).withColumn("__w", scorer.weights(t)).withColumn("__s", _sum(F.col("__w")))
        r = r.select(key, "__s", F.posexplode(F.arrays_zip(F.col("tokens").alias("t"), F.col("__w").alias("w"))).alias("position", "__x"))
        return r.where(~F.col("__x.t").isin(*SPECIAL_TOKENS)).select(key, "position", F.greatest(F.col("__x.w") / F.col("__s"), F.lit(0.0)).alias("importance"))
    r = rows.withColumn("__f", scorer(t, F.transform(t, lambda _: F.lit(1.0))))
    r = r.select("*", F.posexplode("tokens").alias("position", "__w")).where(~F.col("__w").isin(*SPECIAL_TOKENS))
    drop = F.col("__f") - scorer(t, F.transform(t, lambda _, i: F.when(i == F.col("position"), 0.0).otherwise(1.0)))
    return r.select(key, "position", F.greatest(drop, F.lit(0.0)).alias("importance"))


def head_tail(tokens: Column, limit: int) -> Column:
    """The first half and the last half of a sequence longer than the limit; the first half is the smaller one."""
    h = limit // 2
    return F.when(F.size(tokens) <= limit, tokens).otherwise(F.concat(F.slice(tokens, 1, h), F.slice(tokens, -(limit - h), limit - h)))


def overlap(a: Column, b: Column) -> Column:
    """The share of the distinct values of a that b has; 0 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has as good as no length, null where the lengths differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(n <= 1e-12, 0.0).otherwise(dot(a, b) / n)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
