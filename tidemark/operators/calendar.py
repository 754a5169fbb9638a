"""Event studies on a trading grid: windows once per (ticker, day), looked up by events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof


def returns_from_closes(closes: DataFrame, key: str = "ticker", at: str = "trade_date", close: str = "close_price", tie: str = "loaded_at") -> DataFrame:
    """(key, at, return): change against the key's previous day; of a day's rows the latest counts, days without a close are no days."""
    one = closes.where(F.col(close).isNotNull() & F.col(key).isNotNull()).groupBy(key, at).agg(F.max(F.struct(tie, close))[close].alias(close))
    prev = F.lag(close).over(Window.partitionBy(key).orderBy(at))
    return one.select(key, at, F.try_divide(F.col(close), prev).alias("__r")).select(key, at, (F.col("__r") - 1).alias("return")).where("return is not null")


def trading_grid(stock: DataFrame, market: DataFrame, key: str = "ticker", at: str = "trade_date") -> DataFrame:
    """(key, at, r, m): a stock's days that are market days, one row each, NaN as null."""
    nn = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    s = stock.where(F.col(key).isNotNull()).groupBy(key, at).agg(F.max(nn("r")).alias("r"))
    m = market.groupBy(at).agg(F.max(nn("m")).alias("m"))
    return s.join(m, at)


def _sum(c, w):
    return F.when(F.count("*").over(w) > 0, F.coalesce(F.sum(c).over(w), F.lit(0.0)))


def event_windows(grid: DataFrame, key: str = "ticker", at: str = "trade_date", horizon: int = 20) -> DataFrame:
    """The grid with every window an event on that day (as i0) needs.

    car: abnormal returns of the rows i0..i0+horizon-1, truncated at the end; series: the same as text;
    momentum_n, volatility_n, beta_60: rows ending at i0-1 (nansum, population deviation, covariance over
    variance from five pairs on); pre_5: compound of the five rows ending at i0-2; post_3: of i0..i0+2.
    """
    o = Window.partitionBy(key).orderBy(at)
    ahead, back = o.rowsBetween(0, horizon - 1), lambda n: o.rowsBetween(-n, -1)
    ab = F.col("r") - F.col("m")
    g = grid.withColumn("__pair", F.col("r").isNotNull() & F.col("m").isNotNull())
    r2, m2 = F.when(F.col("__pair"), F.col("r")), F.when(F.col("__pair"), F.col("m"))
    out = {
        "car": _sum(ab, ahead),
        "series": F.array_join(F.transform(F.collect_list(F.coalesce(ab, F.lit(float("nan")))).over(ahead), lambda x: F.format_string("%.6f", x)), " "),
        "window_rows": F.count("*").over(ahead),
        "pre_5": F.product(1 + F.coalesce("r", F.lit(0.0))).over(o.rowsBetween(-6, -2)) - 1,
        "post_3": F.product(1 + F.coalesce("r", F.lit(0.0))).over(o.rowsBetween(0, 2)) - 1,
    }
    for n in (5, 20, 60):
        out[f"momentum_{n}"] = _sum(F.col("r"), back(n))
        out[f"market_momentum_{n}"] = _sum(F.col("m"), back(n))
    for n in (20, 60):
        out[f"volatility_{n}"] = F.stddev_pop("r").over(back(n))
    out["market_volatility_20"] = F.stddev_pop("m").over(back(20))
    var = F.var_pop(m2).over(back(60))
    out["beta_60"] = F.when((F.count(r2).over(back(60)) >= 5) & (var > 1e-18), F.covar_pop(r2, m2).over(back(60)) / var)
    return g.withColumns(out).drop("__pair")


def event_study(events: DataFrame, grid: DataFrame, *, key: str = "ticker", event_at: str = "event_date", at: str = "trade_date", lag_days: int = 1, horizon: int = 20, threshold: float = 0.0) -> DataFrame:
    """Events with i0 (the first trading day from event_at + lag_days on) and its windows.

    Without a later trading day the sum is 0, the label 0 and has_window false; windows are null.
    """
    w = event_windows(grid, key, at, horizon)
    names = [c for c in w.columns if c not in (key, at, "r", "m")]
    shifted = events.withColumn("__at", F.date_add(event_at, lag_days))
    out = asof(shifted, w, key=key, event_at="__at", row_at=at, payload=names, into="__w", direction="forward")
    car = F.coalesce(F.col("__w.car"), F.lit(0.0))
    return out.select(
        *events.columns, F.col(f"__w.{at}").alias("i0"), car.alias("car_horizon"), (car > threshold).cast("int").alias("label"), F.col("__w").isNotNull().alias("has_window"),
        F.coalesce("__w.series", F.lit("")).alias("abnormal_return_series"), *[F.col(f"__w.{c}").alias(c) for c in names if c not in ("car", "series")],
        (F.col("__w.momentum_20") - F.col("__w.market_momentum_20")).alias("relative_momentum_20"),
    )


def call_frequency(calls: DataFrame) -> DataFrame:
    """Per call of a ticker, by (event_date, call_id): earlier calls, days since the last one, earlier calls within
    365 days (same-day earlier rows count), mean gap of the earlier calls (from two on). Prior only.

    Windows run over a ticker's days, of which there are few, and within a day; a
    ticker with a third of all calls is spread over its days.
    """
    c = calls.where("ticker is not null and event_date is not null").select("call_id", "ticker", "event_date")
    days = c.groupBy("ticker", "event_date").agg(F.count("*").alias("__n"))
    o = Window.partitionBy("ticker").orderBy("event_date")
    before = F.coalesce(F.sum("__n").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    year = F.sum("__n").over(Window.partitionBy("ticker").orderBy(F.unix_date("event_date")).rangeBetween(-365, 0))
    days = days.withColumns({"__b": before, "__y": year, "__p": F.lag("event_date").over(o), "__f": F.first("event_date").over(o.rowsBetween(Window.unboundedPreceding, 0))})
    k = F.row_number().over(Window.partitionBy("ticker", "event_date").orderBy("call_id")) - 1
    c = c.withColumn("__k", k).join(days, ["ticker", "event_date"])
    n, prev = F.col("__b") + F.col("__k"), F.when(F.col("__k") > 0, F.col("event_date")).otherwise(F.col("__p"))
    return c.select(
        "call_id", "ticker", "event_date", n.alias("prior_call_count"), F.datediff("event_date", prev).alias("days_since_prev_call"), (F.col("__y") - F.col("__n") + F.col("__k")).alias("prior_call_count_365d"),
        F.when(n >= 2, F.datediff(prev, "__f") / (n - 1)).alias("mean_prior_call_gap_days"),
    )
