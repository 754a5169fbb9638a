"""Matching records by nearest time: a stateful streaming join.

Both sides arrive as one stream of events. The operator buffers both sides per
entity, emits a left row once the watermark has passed its tolerance horizon,
when no nearer right row can still arrive, and evicts right rows that no pending
or future left row can reach. An entity's time line is cut into slots of
SLOT_TOLERANCES tolerances, right rows near an edge going to both sides of it,
and the slots of all entities are dealt by hash into groups of about GROUP_ROWS
rows. So an entity with a third of all rows is spread over its slots, and many
small entities share one state instead of costing a call each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import canonical_ticker
from tidemark.session import discard, materialise, read_table, scratch_path

TOLERANCE_S = 72 * 3600
SLOT_TOLERANCES = 2
LATENESS = "0 seconds"
#: Rows of one state group of a replay.
GROUP_ROWS = 1000
#: A finished table is replayed in so many slices of equal numbers of rows, in order of time, whatever its size.
SLICES = 4
EVENT = "entity string, side string, id string, us bigint, ts timestamp"
#: The end mark; the last year that nanosecond stamps can hold. Rows at or behind it are left out.
_END = "2261-01-01 00:00:00"
_OUT = "entity string, left_id string, right_id string, left_us bigint, right_us bigint"
_STATE = "le array<string>, li array<string>, lt array<bigint>, re array<string>, ri array<string>, rt array<bigint>"


def sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """One table of events out of two tables (entity, id, ts); rows with a null in any of the three cannot be paired and are left out."""
    parts = [d.select("entity", F.lit(s).alias("side"), F.col("id").cast("string").alias("id"), F.unix_micros("ts").alias("us"), "ts") for d, s in ((left, "L"), (right, "R"))]
    return parts[0].unionByName(parts[1]).where(f"entity is not null and id is not null and ts < timestamp'{_END}'")


def nearest(left: pd.DataFrame, right: pd.DataFrame, tol: int) -> pd.DataFrame:
    """``left`` (entity, id, us) with right_id and right_us of the closest right row of its entity within ``tol``;
    of equally close ones the earlier, at one time the smaller id."""
    left = left.sort_values(["us", "entity", "id"], kind="stable").reset_index(drop=True)
    r = right.sort_values(["us", "id"], kind="stable").drop_duplicates(["entity", "us"]).rename(columns={"id": "right_id"})
    r["right_us"] = r["us"]
    back, ahead = (pd.merge_asof(left, r, on="us", by="entity", direction=d, tolerance=tol) for d in ("backward", "forward"))
    far = np.iinfo(np.int64).max
    gap = [(x.right_us - x.us).abs().fillna(far) for x in (back, ahead)]
    pick = ahead.where(gap[1] < gap[0], back)
    return left.assign(right_id=pick.right_id.astype(object).where(pick.right_id.notna(), None), right_us=pick.right_us.astype("Int64"))


def nearest_in_stream(events: DataFrame, tolerance_s: int = TOLERANCE_S, lateness: str = LATENESS, groups: int = 256) -> DataFrame:
    """The streaming operator: (entity, left_id, right_id, left_us, right_us), append mode.

    ``events`` is a stream of EVENT rows. Every left row on time comes out once,
    with null right columns where nothing lies within the tolerance. Repeated ids
    of a side count once per entity (the earliest time); of equally close right rows the
    earlier wins, at the same time the smaller id. Rows behind the watermark are late and dropped.
    """
    tol, width = tolerance_s * 1_000_000, tolerance_s * SLOT_TOLERANCES * 1_000_000
    slot = lambda us: F.floor(us / F.lit(width))
    slots = F.when(F.col("side") == "L", F.array(slot(F.col("us")))).otherwise(F.sequence(slot(F.col("us") - tol), slot(F.col("us") + tol)))
    spread = events.withWatermark("ts", lateness).select("entity", "side", "id", "us", "ts", F.explode(slots).alias("slot"))
    spread = spread.withColumn("grp", F.pmod(F.xxhash64("entity", "slot"), F.lit(groups)).cast("int")).drop("slot")

    def frame(e, i, t) -> pd.DataFrame:
        return pd.DataFrame({"entity": pd.Series(e, dtype=object), "id": pd.Series(i, dtype=object), "us": pd.Series(t, dtype="int64")})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [list(x) for x in state.get] if state.exists else [[] for _ in range(6)]
        left, right = frame(*kept[:3]), frame(*kept[3:])
        if not state.hasTimedOut:
            new = [b[["side", "entity", "id", "us"]] for b in batches]
            both = [pd.concat([old, *(b[b.side == s][["entity", "id", "us"]] for b in new)]).sort_values("us", kind="stable").drop_duplicates(["entity", "id"]) for old, s in ((left, "L"), (right, "R"))]
            left, right = both
        mark = state.getCurrentWatermarkMs() * 1000
        done = left.us + tol < mark
        if done.any():
            out = nearest(left[done], right, tol)
            yield out.rename(columns={"id": "left_id", "us": "left_us"})[["entity", "left_id", "right_id", "left_us", "right_us"]]
            left = left[~done]
        reach = min(mark, int(left.us.min()) if len(left) else mark) - tol
        right = right[right.us >= reach]
        if len(left) or len(right):
            state.update(tuple(d[c].tolist() for d in (left, right) for c in ("entity", "id", "us")))
            wake = (int(left.us.min()) if len(left) else int(right.us.max())) + tol
            state.setTimeoutTimestamp(max(wake, mark) // 1000 + 1)
        elif state.exists:
            state.remove()

    return spread.groupBy("grp").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, events: DataFrame, tolerance_s: int = TOLERANCE_S, slices: int = SLICES) -> DataFrame:
    """Runs the streaming operator over a finished table and returns what it emitted.

    The table is fed in ``slices`` of about equal numbers of rows in order of time, a
    micro-batch each of one checkpointed query: as the watermark moves, rows come out and
    state is evicted on the way, so that it holds the rows near the watermark only. An end mark
    far in the future lets the watermark pass every horizon. How many groups held state after each
    batch is kept as ``_state_rows``. Files and checkpoint lie in the shared folder.
    """
    staged = materialise(events, "sides", n=F.count(F.lit(1)))
    n = staged._tallies["n"]
    groups = max(8, n // GROUP_ROWS)
    cuts = (staged.select(F.percentile_approx("us", [i / slices for i in range(1, slices)])).first()[0] or []) if slices > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    source, sink, log = (scratch_path(spark, x) for x in ("stream-in", "stream-out", "stream-log"))
    end = spark.range(1).select(F.lit(None).cast("string").alias("entity"), F.lit("E").alias("side"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("bigint").alias("us"), F.to_timestamp(F.lit(_END)).alias("ts"))
    held: list[int] = []
    for low, high in zip(edges, edges[1:]):
        part = staged if low is None else staged.where(F.col("us") >= low)
        part = part if high is None else part.where(F.col("us") < high)
        if high is None:
            part = part.unionByName(end)
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        query = nearest_in_stream(stream, tolerance_s, groups=groups).writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        held += [sum(op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]
    discard(spark, staged, source, log)
    out = spark.read.schema(_OUT).parquet(sink).where("entity is not null")
    out._state_rows = held
    return out


def call_reports(calls: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per call (its latest update) and per report (its latest delivery): entity, id, ts and the dates."""
    c = calls.where("call_id is not null").groupBy("call_id").agg(F.max(F.struct("updated_at", "ticker", "call_ts", "event_date")).alias("x"))
    r = reports.where("source_event_id is not null").groupBy("source_event_id").agg(F.max(F.struct("ingested_at", "source_event_ts", "source_event_date", "ticker")).alias("x"))
    return (
        c.select(F.col("call_id").alias("id"), canonical_ticker(F.col("x.ticker")).alias("entity"), F.col("x.call_ts").alias("ts"), F.col("x.event_date").alias("event_date")),
        r.select(F.col("source_event_id").alias("id"), canonical_ticker(F.col("x.ticker")).alias("entity"), F.col("x.source_event_ts").alias("ts"), F.col("x.source_event_date").alias("source_event_date")),
    )


def _streamed(spark, sf_dir):
    calls, reports = call_reports(read_table(spark, sf_dir, "call_features"), read_table(spark, sf_dir, "external_events"))
    return calls, reports, replay(spark, sides(calls, reports))


def p6_found(spark, sf_dir):
    _, _, out = _streamed(spark, sf_dir)
    return out.where("right_id is not null").select(F.col("left_id").alias("call_id"), F.col("right_id").cast("bigint").alias("source_event_id"))


def p6_matched(spark, sf_dir):
    """Every call with source_event_id, source_event_date, date_diff_days (report minus call day, unsigned) and match_status.

    Status is matched, outside_tolerance (its ticker has timed reports, none near
    enough) or missing_source (it has none, or the call has no ticker or time).
    A matched report without a date has its time's day.
    """
    calls, reports, out = _streamed(spark, sf_dir)
    known = reports.where("ts is not null and entity is not null").select("entity").distinct().withColumn("has", F.lit(True))
    got = calls.join(out.select(F.col("left_id").alias("id"), F.col("right_id").cast("bigint").alias("source_event_id"), F.timestamp_micros("right_us").alias("rts")), "id", "left").join(known, "entity", "left")
    got = got.join(reports.select(F.col("id").alias("source_event_id"), "source_event_date"), "source_event_id", "left")
    day = F.when(F.col("source_event_id").isNotNull(), F.coalesce("source_event_date", F.to_date("rts")))
    status = F.when(F.col("source_event_id").isNotNull(), "matched").when(F.col("has") & F.col("ts").isNotNull(), "outside_tolerance").otherwise("missing_source")
    return got.select(F.col("id").alias("call_id"), F.col("entity").alias("ticker"), "event_date", "source_event_id", day.alias("source_event_date"), F.abs(F.datediff(day, "event_date")).cast("bigint").alias("date_diff_days"), status.alias("match_status"))
