"""Universe screens and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MIN_MARKET_CAP, SECTOR = 1e10, "Information Technology"


def average_rank(df: DataFrame, value: str, into: str, by: list[str] | None = None, share: bool = False) -> DataFrame:
    """Adds the average rank of ``value`` (as a share of the non-null rows on demand); nulls have none.

    Ranks come from the distinct values with their counts, each placed by its bucket's
    rows before it: values are ranged over buckets, so no task sorts all of them.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    total = counts.groupBy(*by).agg(F.sum("__c").alias("__n")) if by else counts.agg(F.sum("__c").alias("__n"))
    if by:
        w = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("__below", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    else:
        ranked = prefix_sums(counts, "__v", {"__below": "__c"})
    mid = F.col("__below") + (F.col("__c") + 1) / 2
    if by:
        joined = df.join(ranked.select(*by, F.col("__v").alias(value), mid.alias(into)), [*by, value], "left")
    else:
        joined = _with_ranks(df, ranked.select("__v", "__c", mid.alias("__r")), value, into)
    if share:
        joined = (joined.join(F.broadcast(total), by) if by else joined.crossJoin(F.broadcast(total))).withColumn(into, F.col(into) / F.col("__n")).drop("__n")
    return joined.select(*df.columns, into)


def _with_ranks(df: DataFrame, ranked: DataFrame, value: str, into: str, share: int = 256) -> DataFrame:
    """Joins (__v, __c, __r) back on the value. Values that hold more than 1 / share of the rows, at most ``share`` of
    them, are broadcast, and their rows take no part in the exchange by value but are spread, so that none is a hot key."""
    total = ranked.agg(F.sum("__c").alias("__all"))
    hot = ranked.crossJoin(F.broadcast(total)).where(F.col("__c") * share > F.col("__all")).select(F.col("__v").alias("__h"), F.col("__r").alias("__hr"))
    marked = df.join(F.broadcast(hot), F.col(value) == F.col("__h"), "left")
    spread = F.when(F.col("__h").isNotNull() | F.col(value).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(share)).cast("int") + 1).otherwise(0)
    cold = ranked.select(F.col("__v"), F.lit(0).alias("__s"), "__r")
    joined = marked.withColumn("__t", spread).join(cold, (F.col(value) == F.col("__v")) & (F.col("__t") == F.col("__s")), "left")
    return joined.withColumn(into, F.coalesce("__hr", "__r"))


def quantiles(df: DataFrame, value: str, probs: list[float]) -> DataFrame:
    """One row (q): the exact interpolated quantiles of the non-null values, null without any.

    Positions are looked up in the distinct values' cumulated counts (``prefix_sums``), so no task holds them all.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__all"))
    at = [F.lit(float(p)) * (F.col("__all") - 1) for p in probs]
    ranked = prefix_sums(counts, "__v", {"__below": "__c"}).crossJoin(F.broadcast(total))
    holds = lambda k: F.max(F.when((F.col("__below") <= k) & (k < F.col("__below") + F.col("__c")), F.col("__v")))
    ends = ranked.agg(F.max("__all").alias("__n"), *[holds(F.floor(k)).alias(f"__l{i}") for i, k in enumerate(at)], *[holds(F.ceil(k)).alias(f"__u{i}") for i, k in enumerate(at)])
    part = [F.lit(float(p)) * (F.col("__n") - 1) - F.floor(F.lit(float(p)) * (F.col("__n") - 1)) for p in probs]
    return ends.select(F.array(*[F.when(x == 0, F.col(f"__l{i}")).otherwise(F.col(f"__l{i}") * (1 - x) + F.col(f"__u{i}") * x) for i, x in enumerate(part)]).alias("q"))


def prefix_sums(values: DataFrame, value: str, sums: dict[str, str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """Adds, for each new name, the sum of its column over the rows with smaller (descending: greater) values.

    ``values`` has one row per value. They are ranged into buckets by approximate
    quantiles; each bucket is summed in order by itself on top of the bounded list of
    the buckets' totals, so no task sorts all values.
    """
    cuts = values.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 10000).alias("__cuts"))
    placed = values.crossJoin(F.broadcast(cuts)).withColumn("__b", F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda x: x < F.col(value)))).drop("__cuts")
    order = F.desc if descending else F.asc
    totals = placed.groupBy("__b").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    up = Window.orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("__b", *[F.coalesce(F.sum(f"__s_{n}").over(up), F.lit(0)).alias(f"__o_{n}") for n in sums])
    w = Window.partitionBy("__b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offset), "__b")
    return out.select(*values.columns, *[(F.col(f"__o_{n}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(n) for n, c in sums.items()])


def corpus_stats(calls: DataFrame) -> DataFrame:
    """(ticker, calls, first_event_date, last_event_date)."""
    return calls.where("ticker is not null").groupBy("ticker").agg(F.count("*").alias("calls"), F.min("event_date").alias("first_event_date"), F.max("event_date").alias("last_event_date"))


def screen(universe: DataFrame, calls: DataFrame, min_cap: float = MIN_MARKET_CAP, sector: str = SECTOR, forced: tuple[str, ...] = ()) -> DataFrame:
    """Listings in the corpus that are large enough and of the sector or forced in, with why, rank and corpus statistics.

    Of a listing's repeated rows the greatest counts; null sectors match none.
    """
    u = universe.where("ticker is not null").groupBy("ticker").agg(F.max(F.struct(F.col("market_cap_usd").cast("double").alias("market_cap_usd"), F.trim(F.coalesce("sector", F.lit(""))).alias("sector"))).alias("x")).select("ticker", "x.*")
    hit, force = F.lower("sector") == sector.lower(), F.col("ticker").isin(list(forced))
    chosen = u.join(corpus_stats(calls), "ticker").where((F.col("market_cap_usd") >= min_cap) & (hit | force))
    why = F.when(force & hit, "sector_filter+forced_include").when(force, "forced_include").otherwise("sector_filter")
    return average_rank(chosen.withColumns({"included_by": why, "log_market_cap": F.ln("market_cap_usd")}), "market_cap_usd", "market_cap_percentile", share=True)


def override(base: DataFrame, better: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the columns of ``better`` where it has them; of a key's several rows the greatest counts, whole."""
    b = better.groupBy(key).agg(F.max(F.struct(*columns)).alias("__x")).select(key, *[F.col(f"__x.{c}").alias(f"__{c}") for c in columns])
    return base.join(b, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
