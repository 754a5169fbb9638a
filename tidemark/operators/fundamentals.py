"""Facts and estimates by event: quarters out of cumulative amounts, as-of facts, surprises, proxies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import prior_version

# Fixed values.
MAX_QUARTER_DAYS = 140
SHARES_RANGE = (1e6, 1e11)
MAX_LAG_DAYS, MAX_STALENESS_DAYS = 120, 730
ALIASES = {
    "reported_eps": ("reported_eps", "eps_actual", "actual_eps", "epsActual"),
    "estimated_eps": ("estimated_eps", "eps_estimate", "consensus_eps", "epsEstimated"),
    "reported_revenue": ("reported_revenue", "revenue_actual", "actual_revenue", "revenueActual"),
    "estimated_revenue": ("estimated_revenue", "revenue_estimate", "consensus_revenue", "revenueEstimated"),
}


def quarterly(facts: DataFrame, abs_value: bool = False) -> DataFrame:
    """Facts of one quarter: direct ones (up to 140 days, or instants) and differences of neighbouring cumulative ones."""
    days = F.datediff("period_end", "period_start")
    f = facts.where("fact_value is not null and period_end is not null").withColumn("period_days", days)
    direct = f.where((F.col("period_days").between(1, MAX_QUARTER_DAYS)) | F.col("period_start").isNull()).withColumn("derived", F.lit(0))
    cumulative = f.where((F.col("period_days") > MAX_QUARTER_DAYS) & F.col("period_start").isNotNull())
    p = prior_version(cumulative, ["ticker", "concept", "unit", "period_start"], "period_end", ["fact_value"], "__prev")
    gap = F.datediff("period_end", "__prev.period_end")
    derived = p.where(gap.between(1, MAX_QUARTER_DAYS)).withColumns({"fact_value": F.col("fact_value") - F.col("__prev.fact_value"), "period_start": F.date_add("__prev.period_end", 1), "period_days": gap, "derived": F.lit(1)}).drop("__prev")
    out = direct.unionByName(derived)
    return out.withColumn("fact_value", F.abs("fact_value")) if abs_value else out


def statement_asof(events: DataFrame, facts: DataFrame, max_lag_days: int = MAX_LAG_DAYS, strict_pit: bool = False) -> DataFrame:
    """Each event's fact: nearest period end within the lag, direct before derived, then least filing lag, latest filing.

    A filing may lie behind the event unless ``strict_pit``. The candidates of an event
    are those of one ticker within the lag: the join is on (ticker, block of the lag's
    length), so it neither crosses a ticker's whole history nor ranges over tickers.
    """
    block = lambda c: F.floor(F.unix_date(c) / (max_lag_days + 1))
    e = events.withColumn("__b", block("event_date"))
    f = facts.select("ticker", F.col("fact_value"), "period_end", "filed_date", "derived", F.explode(F.array(block("period_end"), block("period_end") + 1)).alias("__b"))
    lag = F.datediff("event_date", "period_end")
    j = e.join(f, ["ticker", "__b"]).where(lag.between(0, max_lag_days))
    if strict_pit:
        j = j.where("filed_date <= event_date")
    filed = F.datediff("event_date", "filed_date")
    last = F.lit(2147483647)
    best = F.min(F.struct(lag.alias("lag"), "derived", F.coalesce(filed, last).alias("filed_lag"), F.coalesce(-F.unix_date("filed_date"), last).alias("filed"), "fact_value", "period_end", "filed_date"))
    got = j.groupBy("call_id").agg(best.alias("x"))
    return events.join(got, "call_id", "left").select(*events.columns, F.col("x.fact_value").alias("fact_value"), F.col("x.period_end").alias("period_end"), F.col("x.lag").alias("period_end_lag_days"), F.col("x.filed_lag").alias("filed_lag_days"), F.col("x.derived").alias("derived"))


def shares_asof(events: DataFrame, facts: DataFrame, max_staleness_days: int = MAX_STALENESS_DAYS) -> DataFrame:
    """Each event's share count: latest period end, then latest filing, both on or before it, of a plausible size and not too stale."""
    block = lambda c: F.floor(F.unix_date(c) / (max_staleness_days + 1))
    one = facts.where(F.col("fact_value").between(*SHARES_RANGE)).groupBy("ticker", "period_end", "filed_date").agg(F.max("fact_value").alias("shares"))
    f = one.where("period_end is not null and filed_date is not null").select("*", F.explode(F.array(block("period_end"), block("period_end") + 1)).alias("__b"))
    stale = F.datediff("event_date", "period_end")
    j = events.withColumn("__b", block("event_date")).join(f, ["ticker", "__b"]).where(stale.between(0, max_staleness_days) & (F.col("filed_date") <= F.col("event_date")))
    got = j.groupBy("call_id").agg(F.max(F.struct("period_end", "filed_date", "shares")).alias("x"))
    return events.join(got, "call_id", "left").select(*events.columns, F.col("x.shares").alias("shares"), F.datediff("event_date", "x.period_end").alias("shares_staleness_days"))


def safe_ratio(x: Column, y: Column) -> Column:
    """x over the size of y; null where y is null or as good as zero."""
    return F.when(F.abs(y) > 1e-12, x / F.abs(y))


def first_present(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """The first non-null number among the alias columns there are; null without any."""
    there = [F.expr(f"try_cast(`{c}` as double)") for c in aliases if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def standardise_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the standard columns out of any alias; of repeated keys the greatest row counts."""
    std = df.select(*keys, *[first_present(df, a).alias(c) for c, a in ALIASES.items()])
    return std.groupBy(*keys).agg(F.max(F.struct(*ALIASES)).alias("x")).select(*keys, "x.*")


def merge_events(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of event tables; the earlier table's value stands where it is known."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        rest = [c for c in a.columns if c not in keys]
        right = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
        return a.join(right, keys, "full").select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in rest])

    return reduce(two, frames)


def surprise(df: DataFrame) -> DataFrame:
    """Adds eps_surprise, its share of the estimate, 0/1 flags and the label (null without a surprise) for EPS and revenue."""
    out = df
    for c in ("eps", "revenue"):
        s = F.col(f"reported_{c}") - F.col(f"estimated_{c}")
        out = out.withColumns({
            f"{c}_surprise": s, f"{c}_surprise_pct": safe_ratio(s, F.col(f"estimated_{c}")),
            f"{c}_beat": F.coalesce((s > 0).cast("int"), F.lit(0)), f"{c}_miss": F.coalesce((s < 0).cast("int"), F.lit(0)), f"{c}_meet": F.coalesce((s == 0).cast("int"), F.lit(0)),
            f"{c}_label": F.when(s > 0, "beat").when(s < 0, "miss").when(s == 0, "meet"),
        })
    return out


def capex_proxy(df: DataFrame, window: int = 4) -> DataFrame:
    """Adds prior_ratio, the median capex-to-revenue ratio of the ``window`` earlier events, and estimated_capex from it."""
    ratio = F.try_divide(F.col("reported_capex"), F.abs("reported_revenue"))
    w = Window.partitionBy("ticker").orderBy("event_date", "call_id").rowsBetween(-window, -1)
    t = df.withColumn("__r", F.when(ratio > 0, ratio))
    t = t.withColumn("prior_ratio", F.percentile("__r", 0.5).over(w))
    proxy = F.col("estimated_revenue") * F.col("prior_ratio")
    return t.withColumns({"estimated_capex": proxy, "estimated_capex_is_proxy": proxy.isNotNull().cast("int")}).drop("__r")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, coverage, mean, median): one pass over all columns."""
    one = df.agg(F.count("*").alias("__n"), *[f(c).alias(f"{c}__{k}") for c in columns for k, f in (("c", F.count), ("m", F.avg), ("d", F.median))])
    rows = [F.struct(F.lit(c).alias("column"), F.try_divide(F.col(f"{c}__c"), F.col("__n")).alias("coverage"), F.col(f"{c}__m").cast("double").alias("mean"), F.col(f"{c}__d").cast("double").alias("median")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def match_coverage(matched: DataFrame) -> DataFrame:
    """(ticker, events, matched_share) of a nearest match."""
    return matched.groupBy("ticker").agg(F.count("*").alias("events"), F.avg((F.col("match_status") == "matched").cast("int")).alias("matched_share"))
