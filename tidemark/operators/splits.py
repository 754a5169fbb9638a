"""Splits in time and what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What training data must have.
MIN_COVERAGE = {"SUE_EPS": 0.65, "SUE_REV": 0.85, "pre_event_return": 0.90, "volatility": 0.90, "market_cap": 0.99, "qa_count": 0.99}
MIN_CALLS, MIN_PAIRS, MIN_TRAIN_PAIRS, MIN_EVAL_PAIRS, MIN_FOLDS = 500, 1000, 200, 50, 1


def position(calls: DataFrame, at: str = "event_date", key: str = "call_id") -> DataFrame:
    """Distinct (key, at) with pos from 0 in order of (at, key), nulls first.

    Days are counted first and each gets its offset from the days before it; rows are
    numbered within their day. A corpus has few days, so only those pass one task.
    """
    one = calls.select(key, at).distinct()
    days = one.groupBy(at).agg(F.count("*").alias("__n"))
    w = Window.orderBy(F.asc_nulls_first(at)).rowsBetween(Window.unboundedPreceding, -1)
    off = days.select(F.col(at).alias("__d"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__o"))
    inside = one.withColumn("__i", F.row_number().over(Window.partitionBy(at).orderBy(key)) - 1)
    return inside.join(F.broadcast(off), F.col(at).eqNullSafe(F.col("__d"))).select(key, at, (F.col("__o") + F.col("__i")).alias("pos"))


def time_split(calls: DataFrame, train: float = 0.7, val: float = 0.15, at: str = "event_date", key: str = "call_id") -> DataFrame:
    """(key, at, split): the first int(n * train) in time are train, up to int(n * (train + val)) val, the rest test."""
    p = position(calls, at, key)
    n = p.count()
    a, b = int(n * train), int(n * (train + val))
    return p.select(key, at, F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test").alias("split"))


def rolling_splits(calls: DataFrame, min_train: int, val: int, test: int, step: int, at: str = "event_date", key: str = "call_id", max_folds: int | None = None) -> DataFrame:
    """(fold, split, key): expanding train windows, each followed by val and test rows; folds that would run past the end are left out.

    A row enters the folds its position belongs to by arithmetic; nothing is collected but the number of rows.
    """
    if min(min_train, val, test, step) < 1:
        raise ValueError("sizes must be positive")
    p = position(calls, at, key)
    n = p.count()
    folds = max(0, (n - min_train - val - test) // step + 1)
    folds = min(folds, max_folds) if max_folds is not None else folds
    if not folds:
        return p.select(F.lit(0).alias("fold"), F.lit("").alias("split"), key).limit(0)
    rows = p.select(key, "pos", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    end = F.lit(min_train) + F.col("fold") * step
    split = F.when(F.col("pos") < end, "train").when(F.col("pos") < end + val, "val").when(F.col("pos") < end + val + test, "test")
    return rows.select("fold", split.alias("split"), key).where("split is not null")


def fold_summary(folds: DataFrame, calls: DataFrame, pairs: DataFrame, at: str = "event_date") -> DataFrame:
    """(fold, split, calls, pairs, first_date, last_date)."""
    per = pairs.groupBy("call_id").agg(F.count("*").alias("__p"))
    c = calls.groupBy("call_id").agg(F.min(at).alias(at)).join(per, "call_id", "left")
    return folds.join(c, "call_id").groupBy("fold", "split").agg(F.count("*").alias("calls"), F.coalesce(F.sum("__p"), F.lit(0)).alias("pairs"), F.min(at).alias("first_date"), F.max(at).alias("last_date"))


def validate(calls: DataFrame, pairs: DataFrame, folds: DataFrame, coverage: dict[str, float] | None = None, at: str = "event_date", least: dict[str, int] | None = None) -> DataFrame:
    """(level, code, fold, value, required): one row per broken rule; none if the data may be trained on."""
    coverage = MIN_COVERAGE if coverage is None else coverage
    need = {"calls": MIN_CALLS, "pairs": MIN_PAIRS, "train_pairs": MIN_TRAIN_PAIRS, "eval_pairs": MIN_EVAL_PAIRS, "folds": MIN_FOLDS} | (least or {})
    there = [c for c in coverage if c in calls.columns]
    cov = lambda df, by: df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).isNotNull().cast("int")).alias(c) for c in there])
    rule = lambda level, code, value, least_: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), value.cast("double").alias("value"), F.lit(float(least_)).alias("required"))
    total = cov(calls, []).withColumn("fold", F.lit(None).cast("int"))
    rules = [rule("error", "min_calls", F.col("n"), need["calls"])] + [rule("error", f"coverage_{c}", F.coalesce(F.col(c), F.lit(0.0)) if c in there else F.lit(0.0), v) for c, v in coverage.items()]
    out = [total.select("fold", F.explode(F.array(*rules)).alias("r"))]
    out.append(pairs.agg(F.count("*").alias("n")).select(F.lit(None).cast("int").alias("fold"), rule("error", "min_pairs", F.col("n"), need["pairs"]).alias("r")))
    out.append(folds.agg(F.count_distinct("fold").alias("n")).select(F.lit(None).cast("int").alias("fold"), rule("error", "min_folds", F.col("n"), need["folds"]).alias("r")))
    twice = pairs.groupBy("pair_id").count().where("count > 1").agg(F.count("*").alias("n"))
    orphan = pairs.join(calls, "call_id", "left_anti").agg(F.count("*").alias("n"))
    for code, d in (("pair_id_repeated", twice), ("orphan_pairs", orphan)):
        out.append(d.select(F.lit(None).cast("int").alias("fold"), rule("error", code, -F.col("n"), 0).alias("r")))
    s = fold_summary(folds, calls, pairs, at)
    out.append(s.select("fold", F.when(F.col("split") == "train", rule("error", "train_pairs", F.col("pairs"), need["train_pairs"])).otherwise(rule("error", "eval_pairs", F.col("pairs"), need["eval_pairs"])).alias("r")))
    overlap = folds.groupBy("fold", "call_id").agg(F.count_distinct("split").alias("k")).where("k > 1").groupBy("fold").agg(F.count("*").alias("n"))
    out.append(overlap.select("fold", rule("error", "overlap", -F.col("n"), 0).alias("r")))
    if there:
        t = cov(folds.where("split = 'train'").join(calls, "call_id"), ["fold"])
        out.append(t.select("fold", F.explode(F.array(*[rule("warning", f"train_coverage_{c}", F.coalesce(F.col(c), F.lit(0.0)), coverage[c]) for c in there])).alias("r")))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both.where("r.value < r.required").select("r.level", "r.code", "fold", "r.value", "r.required")
