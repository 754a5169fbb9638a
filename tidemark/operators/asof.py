"""As-of and nearest joins by union and fill: one sort per entity and month, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Time shards of the as-of joins: a key's rows are sorted shard by shard, and only one state per shard is carried on.
SHARD = "month"


def asof(events: DataFrame, rows: DataFrame, *, key: str, event_at: str, row_at: str, payload: list[str], into: str, direction: str = "backward", strict: bool = False) -> DataFrame:
    """``events`` with the struct ``into`` (row_at and payload) of the last row before (backward) or the first behind (forward) each event.

    ``strict`` leaves out rows at the event's own time. Null keys or times match nothing.
    Rows of one time: the greatest payload. Every event comes out once. A key that holds a
    third of all events is spread over its months: within a month events and rows are
    filled in order, and what no row of the month answers is answered by the month before
    (behind) that has one, out of one row per key and month.
    """
    back = direction == "backward"
    shard = lambda c: F.trunc(F.col(c).cast("date"), SHARD)
    best = rows.where(F.col(key).isNotNull() & F.col(row_at).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(row_at).alias("__t")).agg(F.max(F.struct(F.col(row_at), *payload)).alias("__v")).withColumn("__s", shard("__t"))
    side = F.lit(0.0 if back == strict else 1.0)  # where events stand among rows of their time
    ev = events.withColumn("__e", F.struct(*events.columns)).select(F.col(key).alias("__k"), F.col(event_at).alias("__t"), "__e", side.alias("__side"), shard(event_at).alias("__s"))
    edge = best.groupBy("__k", "__s").agg((F.max_by if back else F.min_by)("__v", "__t").alias("__edge"))
    steps = edge.unionByName(ev.select("__k", "__s").where("__k is not null and __s is not null").distinct().join(edge, ["__k", "__s"], "left_anti"), allowMissingColumns=True)
    over = Window.partitionBy("__k").orderBy(F.asc("__s") if back else F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("__k", "__s", F.last("__edge", True).over(over).alias("__carry"))
    both = best.select("__k", "__t", "__s", "__v", F.lit(0.5).alias("__side")).unionByName(ev, allowMissingColumns=True)
    w = Window.partitionBy("__k", "__s").orderBy("__t", "__side")
    found = F.last("__v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("__v", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    hit = both.withColumn("__f", found).where("__e is not null")
    ok = F.col("__k").isNotNull() & F.col("__t").isNotNull()
    return hit.join(carried, ["__k", "__s"], "left").select("__e.*", F.when(ok, F.coalesce("__f", "__carry")).alias(into))


def nearest(targets: DataFrame, sources: DataFrame, *, key: str, target_at: str, source_at: str, payload: list[str], max_days: int) -> DataFrame:
    """Targets with the source nearest in days: source_event_date, date_diff_days, match_status and the payload.

    Of equally near sources the earlier. Outside the tolerance date and distance stay
    and the payload is null; a key without sources is ``missing_source``. The nearest
    is one of the two as-of neighbours, so no pairs are built.
    """
    named = sources.select(key, F.col(source_at).alias("__s"), *payload)
    t = asof(targets, named, key=key, event_at=target_at, row_at="__s", payload=payload, into="__p")
    t = asof(t, named, key=key, event_at=target_at, row_at="__s", payload=payload, into="__n", direction="forward")
    before, after = F.datediff(target_at, F.col("__p.__s")), F.datediff(F.col("__n.__s"), target_at)
    pick = F.when(F.col("__n").isNull() | (before <= after), F.col("__p")).otherwise(F.col("__n"))
    t = t.withColumn("__x", pick)
    diff = F.abs(F.datediff("__x.__s", target_at))
    hit = diff <= max_days
    status = F.when(hit, "matched").when(F.col("__x").isNotNull(), "outside_tolerance").otherwise("missing_source")
    return t.select(*targets.columns, F.col("__x.__s").alias("source_event_date"), diff.cast("bigint").alias("date_diff_days"), status.alias("match_status"), *[F.when(hit, F.col(f"__x.{c}")).alias(c) for c in payload])


def prior_version(rows: DataFrame, keys: list[str], order: str, payload: list[str], into: str) -> DataFrame:
    """Rows with ``into``: the payload of the last row of the same keys with a smaller ``order`` (equal ones do not count; of several the greatest payload)."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(order)).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.max(F.struct(F.col(order), *payload)).over(w))


def suffix_product(dates: DataFrame, splits: DataFrame, *, key: str, at: str, split_at: str, factor: str, into: str) -> DataFrame:
    """Each row's product of the factors of all later splits of its key (1 without one); null and zero factors do not count."""
    s = splits.where(F.col(factor).isNotNull() & (F.col(factor) != 0) & F.col(split_at).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(split_at).alias("__t")).agg(F.product(factor).alias("__f"))
    d = dates.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side")).distinct()
    both = s.select("__k", "__t", "__f", F.lit(0).alias("__side")).unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(1, Window.unboundedFollowing)
    known = both.withColumn("__p", F.product("__f").over(w)).where("__side = 1").select("__k", "__t", "__p")
    return dates.join(known, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__t")), "left").withColumn(into, F.coalesce("__p", F.lit(1.0))).drop("__k", "__t", "__p")
