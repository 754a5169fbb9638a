"""Entity attributes as they were known at the time of an event.

A change log holds, per entity, versions of an attribute with the day each
became known. The operator materialises periodic snapshots (one state per
entity and month: the best version known before the month) together with the
month's own change log, and gives every event its preceding snapshot, on which
only the changes between snapshot and event are replayed.

Snapshots and logs are stored by year (``ChangeStore``); a later run opens the store,
adds the changes known since, and rewrites only years from the first changed one on.

Each (entity, month) is one row whose log has at most one entry per day, so the
join from events is row to row: an entity that holds a third of all events or
of all changes is spread over its months, and no (event, change) pairs are
ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_ticker, nan_to_null
from tidemark.session import exists, materialise, read_table, rewrite_parts, scratch_path

PERIOD = "month"


def snapshots_and_logs(changes: DataFrame, entity: str, known_at: str, version: list[str], period: str = PERIOD) -> DataFrame:
    """The materialised table: entity, period, state, log.

    ``version`` columns are compared from left to right; the greatest known
    version is the valid one. ``state`` is the greatest version known before
    the period began, ``log`` the period's changes, one per day, in order.
    Changes with a null entity or ``known_at`` were never known and are left out;
    repeated rows and ties fall together.
    """
    days = (
        changes.where(F.col(entity).isNotNull() & F.col(known_at).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(known_at).cast("date").alias("known_at"))
        .agg(F.max(F.struct(*version)).alias("version"))
    )
    periods = days.groupBy("entity", F.trunc("known_at", period).alias("period")).agg(
        F.max("version").alias("top"), F.sort_array(F.collect_list(F.struct("known_at", "version"))).alias("log")
    )
    before = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return periods.withColumn("state", F.max("top").over(before))


class ChangeStore:
    """Snapshots and change logs stored by year under ``path``: (entity, period, top, log, state, year)."""

    def __init__(self, spark: SparkSession, path: str, period: str = PERIOD) -> None:
        self.spark, self.path, self.period = spark, path, period

    def table(self, like: DataFrame | None = None) -> DataFrame | None:
        """What is stored, None before the first run. ``like`` (snapshots_and_logs of any changes) gives the types where nothing has been known yet."""
        if not exists(self.spark, self.path):
            return None
        read = self.spark.read if like is None else self.spark.read.schema(like.select("entity", "period", "top", "log", "state", F.lit(0).alias("year")).schema)
        return read.parquet(self.path)

    def extend(self, changes: DataFrame, entity: str, known_at: str, version: list[str]) -> None:
        """Takes in changes that came since. Their logs are merged into their periods', and the states from the first
        changed year on are made anew from the last state before it; earlier years are left alone."""
        new = snapshots_and_logs(changes, entity, known_at, version, self.period)
        old, new = self.table(new), new.drop("state")
        if old is None:
            up = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
            rewrite_parts(new.withColumn("state", F.max("top").over(up)).select("entity", "period", "top", "log", "state", F.year("period").alias("year")), self.path, "year", "periods")
            return
        new = materialise(new, "new-logs")
        year = new.agg(F.min(F.year("period"))).first()[0]
        if year is None:
            return
        # one entry a day: of a day's old and new version the greater one counts
        before = old.where(F.col("year") < year).groupBy("entity").agg(F.max(F.greatest("top", F.coalesce("state", "top"))).alias("base"))
        entries = old.where(F.col("year") >= year).select("entity", "period", F.explode("log").alias("e")).unionByName(new.select("entity", "period", F.explode("log").alias("e")))
        days = entries.groupBy("entity", "period", F.col("e.known_at").alias("known_at")).agg(F.max("e.version").alias("version"))
        merged = days.groupBy("entity", "period").agg(F.max("version").alias("top"), F.sort_array(F.collect_list(F.struct("known_at", "version"))).alias("log"))
        up = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
        state = F.greatest(F.max("top").over(up), "base")
        out = merged.join(before, "entity", "left").withColumn("state", F.when(F.max("top").over(up).isNull(), F.col("base")).when(F.col("base").isNull(), F.max("top").over(up)).otherwise(state))
        rewrite_parts(out.select("entity", "period", "top", "log", "state", F.year("period").alias("year")), self.path, "year", "periods")


def replay(state: Column, log: Column, at: Column) -> Column:
    """The version valid on day ``at``: the snapshot's, or a greater one of its log. A null log adds nothing."""
    known = F.transform(F.filter(log, lambda x: x["known_at"] <= at), lambda x: x["version"])
    return F.when(log.isNull(), state).otherwise(F.array_max(F.concat(F.array(state), known)))


def as_known(events: DataFrame, changes: DataFrame, *, event_entity: str, event_at: str, entity: str, known_at: str, version: list[str], into: str, period: str = PERIOD, store: str | None = None) -> DataFrame:
    """``events`` with the struct column ``into``: the version known at ``event_at``.

    Events whose entity or time is null, or before which nothing was known, get
    null; every event row comes out exactly once, repeated rows included.
    ``into`` must be new; the change table's other columns never clash. With ``store`` the
    changes are taken into the store of that path first, and everything it holds counts.
    """
    if store:
        kept = ChangeStore(events.sparkSession, store, period)
        kept.extend(changes, entity, known_at, version)
        table = kept.table(snapshots_and_logs(changes, entity, known_at, version, period)).select("entity", "period", "top", "log", "state")
    else:
        table = snapshots_and_logs(changes, entity, known_at, version, period)
    asked = events.select(F.col(event_entity).alias("entity"), F.trunc(F.col(event_at).cast("date"), period).alias("period")).where("entity is not null and period is not null").distinct()
    steps = table.unionByName(asked.join(table, ["entity", "period"], "left_anti"), allowMissingColumns=True)
    upto = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    dense = steps.select("entity", "period", "log", F.max("top").over(upto).alias("state"))
    kept = dense.select(F.col("entity").alias("__entity"), F.col("period").alias("__period"), F.col("log").alias("__log"), F.col("state").alias("__state"))
    joined = events.join(kept, (F.col(event_entity) == F.col("__entity")) & (F.trunc(F.col(event_at).cast("date"), period) == F.col("__period")), "left")
    value = replay(F.col("__state"), F.col("__log"), F.coalesce(F.col(event_at).cast("date"), F.lit("0001-01-01").cast("date")))
    return joined.withColumn(into, value).drop("__entity", "__period", "__log", "__state")


def latest_calls(calls: DataFrame) -> DataFrame:
    """One row per ``call_id``: the latest update (ties: the greatest recorded values); null ids are left out."""
    kept = ["ticker", "event_date", "hist_market_cap_shares_staleness_days", "hist_market_cap_price_lag_days"]
    best = F.max(F.struct(F.col("updated_at"), *[F.col(c) for c in kept])).alias("b")
    return calls.where("call_id is not null").groupBy("call_id").agg(best).select("call_id", *[f"b.{c}" for c in kept])


def calls_as_known(calls: DataFrame, facts: DataFrame, returns: DataFrame, stores: tuple[str, str] | None = None) -> DataFrame:
    """Per call the share count's staleness and the price's lag as known on its day.

    Changes known in the earlier half of time are stored by one run, the later ones by a second that opens the stores.

    A share count is known from the later of its filing and its period's end; one
    without a filing day is never known. A close is known from the day after it.
    """
    c = latest_calls(calls).withColumn("entity_key", canonical_ticker(F.col("ticker")))
    shares = facts.where("concept = 'CommonSharesOutstanding' and period_end is not null and filed_date is not null").select(
        canonical_ticker(F.col("ticker")).alias("k"), F.greatest("filed_date", "period_end").alias("known_at"), "period_end", nan_to_null(F.col("fact_value")).alias("shares")
    )
    closes = returns.where("trade_date is not null").select(
        canonical_ticker(F.col("ticker")).alias("k"), F.date_add("trade_date", 1).alias("known_at"), "trade_date", nan_to_null(F.col("close_price")).alias("close")
    ).where("close is not null")
    spark = calls.sparkSession
    stores = stores or tuple(scratch_path(spark, x) for x in ("share-changes", "close-changes"))
    for changes, version, into, store in ((shares, ["period_end", "shares"], "share_fact", stores[0]), (closes, ["trade_date", "close"], "close_fact", stores[1])):
        half = changes.agg(F.percentile_approx(F.datediff("known_at", F.lit("1970-01-01").cast("date")), 0.5)).first()[0] or 0
        early = F.col("known_at") <= F.date_add(F.lit("1970-01-01").cast("date"), half)
        ChangeStore(spark, store).extend(changes.where(early), "k", "known_at", version)
        c = as_known(c, changes.where(~early), event_entity="entity_key", event_at="event_date", entity="k", known_at="known_at", version=version, into=into, store=store)
    return c.select(
        "call_id", F.col("entity_key").alias("ticker"), "event_date",
        F.datediff("event_date", F.col("share_fact.period_end")).alias("shares_staleness"), F.col("share_fact.shares").alias("shares"),
        F.datediff("event_date", F.col("close_fact.trade_date")).alias("price_lag"), F.col("close_fact.close").alias("close_price"),
        nan_to_null(F.col("hist_market_cap_shares_staleness_days")).alias("recorded_staleness"), nan_to_null(F.col("hist_market_cap_price_lag_days")).alias("recorded_lag"),
    )


def wrong_records(known: DataFrame) -> DataFrame:
    """(call_id, field_name) of every recorded value that differs from the known one; NaN counts as not recorded."""
    bad = F.array_compact(F.array(
        F.when(F.col("recorded_staleness").isNotNull() & ~F.col("recorded_staleness").eqNullSafe(F.col("shares_staleness").cast("double")), F.lit("shares_staleness")),
        F.when(F.col("recorded_lag").isNotNull() & ~F.col("recorded_lag").eqNullSafe(F.col("price_lag").cast("double")), F.lit("price_lag")),
    ))
    return known.select("call_id", F.explode(bad).alias("field_name"))


def p1_known(spark, sf_dir):
    t = [read_table(spark, sf_dir, x) for x in ("call_features", "xbrl_facts", "daily_returns")]
    return calls_as_known(*t)


def p1_found(spark, sf_dir):
    return wrong_records(p1_known(spark, sf_dir))


def p1_asof(spark, sf_dir):
    return p1_known(spark, sf_dir).select("call_id", "ticker", "event_date", F.col("shares_staleness").cast("bigint").alias("shares_staleness"), F.col("price_lag").cast("bigint").alias("price_lag"))
