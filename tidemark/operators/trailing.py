"""Rolling totals over trailing trading days from segment trees.

Days are numbered by a trading calendar. Per entity and shard of ``SHARD`` days
one row holds a complete segment tree (2 * SHARD nodes) for each statistic. A
trailing window touches its own shard and those before it that it reaches into, and is
answered from O(log SHARD) nodes of each. A late correction replaces a leaf and
recomputes only that leaf's ancestors (``correct_trees``). Trees and leaves are stored
by shard (``TreeStore``); a later run opens the store and changes only the parts that
new or corrected days fall in.

Rows are pre-aggregated to one leaf per (entity, day) before any exchange, so an
entity with a third of all rows costs no more than its days; trees are spread by
(entity, shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import canonical_ticker
from tidemark.session import exists, materialise, read_table, rewrite_parts, scratch_path

SHARD = 64
#: Shards of one part of a store.
PART = 4
#: count and sums of usable returns; of them with a market return: count, sums of both, of squares and products
STATS = ("n", "x", "xx", "k", "xk", "m", "mm", "xm")
WINDOWS = (20, 60)
MIN_USABLE = 12
MIN_BETA_PAIRS = 5

_TREE = "array<double>"


def _climb(nodes: np.ndarray, leaves: np.ndarray | None = None) -> np.ndarray:
    """Recomputes the inner nodes of trees shaped (..., 2 * SHARD, stats); of the given leaves' ancestors only, where given."""
    if leaves is None:
        size = SHARD
        while size > 1:
            low = nodes[..., size : 2 * size, :]
            nodes[..., size // 2 : size, :] = low[..., 0::2, :] + low[..., 1::2, :]
            size //= 2
        return nodes
    at = np.unique((np.asarray(leaves) + SHARD) // 2)
    while at.size and at[0] >= 1:
        nodes[..., at, :] = nodes[..., 2 * at, :] + nodes[..., 2 * at + 1, :]
        at = np.unique(at // 2)
    return nodes


def _leaves(pos, x, m) -> np.ndarray:
    """Leaf rows of the statistics; x and m as arrays."""
    x, m = np.asarray(x, float), np.asarray(m, float)
    both = ~np.isnan(m)
    mz = np.where(both, m, 0.0)
    return np.stack([np.ones_like(x), x, x * x, both * 1.0, np.where(both, x, 0.0), mz, mz * mz, x * mz], axis=-1)


def _range(nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums over leaves lo..hi (inclusive, elementwise; lo > hi gives zeros) of trees shaped (B, 2 * SHARD, stats)."""
    out = np.zeros((nodes.shape[0], lo.size, nodes.shape[2]))
    left, right = lo + SHARD, hi + SHARD + 1
    while (left < right).any():
        use = (left < right) & (left & 1 == 1)
        out[:, use] += nodes[:, left[use]]
        left = left + use
        use = (left < right) & (right & 1 == 1)
        right = right - use
        out[:, use] += nodes[:, right[use]]
        left, right = left >> 1, right >> 1
    return out


def trading_calendar(market_days: DataFrame) -> DataFrame:
    """(trade_date, day_no, market_return): one row per distinct trading day, numbered from 0.

    A calendar has at most 366 rows a year whatever the data's size, which is
    the bound that allows its single-partition numbering and its broadcast.
    Conflicting market returns of a day: the greatest; NaN counts as none.
    """
    days = market_days.where("trade_date is not null").groupBy("trade_date").agg(F.max(F.nanvl("market_return", F.lit(None).cast("double"))).alias("market_return"))
    return days.select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("day_no"), "market_return")


def usable(c):
    """A finite return above -1."""
    return c.isNotNull() & ~F.isnan(c) & (c > -1) & (c < float("inf"))


def daily_leaves(returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, day_no, x, m, loaded_at): the usable return of a ticker's trading day.

    Of conflicting usable rows the latest ``loaded_at`` counts (ties: the greater
    return); rows on days without trading are no days of the calendar.
    """
    rows = returns.select(canonical_ticker(F.col("ticker")).alias("ticker"), "trade_date", F.col("stock_return").alias("x"), "loaded_at").where(F.col("ticker").isNotNull() & usable(F.col("x")))
    best = rows.groupBy("ticker", "trade_date").agg(F.max(F.struct(F.col("loaded_at"), F.col("x"))).alias("b"))
    return best.join(F.broadcast(calendar), "trade_date").select("ticker", "day_no", F.col("b.x").alias("x"), F.col("market_return").alias("m"), F.col("b.loaded_at").alias("loaded_at"))


def build_trees(leaves: DataFrame) -> DataFrame:
    """(ticker, shard, tree): a flat segment tree per ticker and shard of days."""
    packed = leaves.groupBy("ticker", F.floor(F.col("day_no") / SHARD).cast("int").alias("shard")).agg(
        F.collect_list(F.struct((F.col("day_no") % SHARD).cast("int").alias("p"), "x", "m")).alias("l")
    ).select("ticker", "shard", *[F.col(f"l.{k}").alias(k) for k in "pxm"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes = np.zeros((len(b), 2 * SHARD, len(STATS)))
            for i, (p, x, m) in enumerate(zip(b.p, b.x, b.m)):
                nodes[i, np.asarray(p, int) + SHARD] = _leaves(p, x, np.array(m, float))
            _climb(nodes)
            yield pd.DataFrame({"ticker": b.ticker, "shard": b["shard"], "tree": list(nodes.reshape(len(b), -1))})

    return packed.mapInPandas(build, f"ticker string, shard int, tree {_TREE}")


def correct_trees(trees: DataFrame, corrections: DataFrame) -> DataFrame:
    """Trees with corrected leaves (ticker, day_no, x, m; x null takes the day's return away).

    Only shards with corrections are opened, and in them only the corrected
    leaves and their log2(SHARD) ancestors change. One correction per day is expected.
    """
    packed = corrections.groupBy("ticker", F.floor(F.col("day_no") / SHARD).cast("int").alias("shard")).agg(
        F.collect_list(F.struct((F.col("day_no") % SHARD).cast("int").alias("p"), "x", "m")).alias("l")
    ).select("ticker", "shard", *[F.col(f"l.{k}").alias(k) for k in "pxm"])
    touched = trees.join(packed, ["ticker", "shard"], "full").where("p is not null")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tree, p, x, m in zip(b.tree, b.p, b.x, b.m):
                nodes = np.zeros((2 * SHARD, len(STATS))) if tree is None else np.array(tree, float).reshape(2 * SHARD, len(STATS))
                p, x = np.asarray(p, int), np.array(x, float)
                nodes[p + SHARD] = np.where(np.isnan(x)[:, None], 0.0, np.nan_to_num(_leaves(p, x, np.array(m, float))))
                out.append(_climb(nodes, p).reshape(-1))
            yield pd.DataFrame({"ticker": b.ticker, "shard": b["shard"], "tree": out})

    fixed = touched.select("ticker", "shard", "tree", "p", "x", "m").mapInPandas(fix, f"ticker string, shard int, tree {_TREE}")
    return trees.join(packed, ["ticker", "shard"], "left_anti").unionByName(fixed)


def spans(returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, first_no, last_no): the trading days between a ticker's first and last row, both included.

    Every date of the calendar's range, trading day or not, knows its next and last
    trading day, so the ends of a span are looked up by equality.
    """
    ends = calendar.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    dates = ends.select(F.explode(F.sequence("lo", "hi")).alias("d")).join(calendar.select(F.col("trade_date").alias("d"), "day_no"), "d", "left")
    o = Window.orderBy("d")
    dates = F.broadcast(dates.select("d", F.first("day_no", True).over(o.rowsBetween(0, Window.unboundedFollowing)).alias("next_no"), F.last("day_no", True).over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("last_no")))
    r = returns.select(canonical_ticker(F.col("ticker")).alias("ticker"), "trade_date").where("ticker is not null and trade_date is not null").groupBy("ticker").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    r = r.crossJoin(F.broadcast(ends)).where("a <= hi and z >= lo").select("ticker", F.greatest("a", "lo").alias("a"), F.least("z", "hi").alias("z"))
    first, last = dates.select(F.col("d").alias("a"), F.col("next_no").alias("first_no")), dates.select(F.col("d").alias("z"), "last_no")
    return r.join(first, "a").join(last, "z").where("first_no <= last_no").select("ticker", "first_no", "last_no")


def trailing(trees: DataFrame, span: DataFrame, calendar: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One row per ticker, trading day of its span and window length.

    days (of the window that lie in the span), usable, total, average, market_total,
    volatility (population) and beta (null under five days or without market
    variance). Total is 0 and average null where no day is usable.
    """
    back = -(-(max(windows) - 1) // SHARD)  # shards a window may reach into besides its own
    dense = span.withColumn("shard", F.explode(F.sequence(F.floor(F.col("first_no") / SHARD).cast("int"), F.floor(F.col("last_no") / SHARD).cast("int"))))
    dense = dense.select(F.col("ticker"), F.col("shard"), F.col("first_no").cast("int"), F.col("last_no").cast("int"))
    with_tree = dense.join(trees, ["ticker", "shard"], "left")
    upto = Window.partitionBy("ticker").orderBy("shard")
    with_tree = with_tree.withColumns({f"prior{j}": F.lag("tree", j).over(upto) for j in range(1, back + 1)})
    lengths = np.array(windows)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos = np.tile(np.arange(SHARD), len(lengths))
        span_ = np.repeat(lengths, SHARD)
        lo, zero = pos - span_ + 1, np.zeros(2 * SHARD * len(STATS))
        for b in batches:
            got = 0.0
            for j in range(back + 1):
                nodes = np.stack([zero if t is None else np.asarray(t) for t in (b[f"prior{j}"] if j else b.tree)]).reshape(len(b), 2 * SHARD, len(STATS))
                first_leaf, last_leaf = np.maximum(lo + j * SHARD, 0), np.minimum(pos + j * SHARD, SHARD - 1)
                got = got + _range(nodes, np.minimum(first_leaf, last_leaf + 1), last_leaf)
            day = b["shard"].to_numpy()[:, None] * SHARD + pos[None, :]
            first, last = b.first_no.to_numpy()[:, None], b.last_no.to_numpy()[:, None]
            keep = (day >= first) & (day <= last)
            i, j = np.nonzero(keep)
            s = got[i, j]
            n, k = s[:, 0], s[:, 3]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean, xm, mm = s[:, 1] / n, s[:, 4] / k, s[:, 5] / k
                var = np.maximum(s[:, 2] / n - mean * mean, 0)
                vm, cov = s[:, 6] / k - mm * mm, s[:, 7] / k - xm * mm
                beta = np.where((k >= MIN_BETA_PAIRS) & (vm > 1e-18), cov / vm, np.nan)
            yield pd.DataFrame({
                "ticker": b.ticker.to_numpy()[i], "day_no": day[i, j].astype(int), "days_back": span_[j],
                "days": np.minimum(span_[j], day[i, j] - first[i, 0] + 1), "usable": n.astype(int), "total": s[:, 1], "average": mean,
                "market_total": s[:, 5], "volatility": np.sqrt(var), "beta": beta,
            })

    schema = "ticker string, day_no int, days_back int, days int, usable int, total double, average double, market_total double, volatility double, beta double"
    out = with_tree.select("ticker", "shard", "first_no", "last_no", "tree", *[f"prior{j}" for j in range(1, back + 1)]).mapInPandas(answer, schema)
    out = out.join(F.broadcast(calendar.select("trade_date", "day_no")), "day_no")
    return out.select("ticker", "trade_date", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes if c not in ("ticker", "trade_date", "day_no")])


def thin_windows(rows: DataFrame, days_back: int = 20, least: int = MIN_USABLE) -> DataFrame:
    """(ticker, trade_date) of full windows that hold a usable return on fewer than ``least`` days."""
    return rows.where((F.col("days_back") == days_back) & (F.col("days") == days_back) & (F.col("usable") < least)).select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"))


class TreeStore:
    """Segment trees and their leaves, stored by parts of PART shards under ``path``; a second run opens them and goes on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{what}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def leaves(self) -> DataFrame:
        return self._read("leaves", "ticker string, day_no int, x double, m double, loaded_at timestamp, shard int, part int")

    def trees(self) -> DataFrame:
        return self._read("trees", f"ticker string, shard int, tree {_TREE}, part int")

    def extend(self, new: DataFrame) -> DataFrame:
        """Takes in leaves (ticker, day_no, x, m, loaded_at) that came since and returns the ones that changed something.

        A new leaf counts where its day has none, or one loaded earlier (at the same time: a smaller return). Parts (PART shards)
        without a new leaf are neither read nor written; in the others only changed leaves and their ancestors are computed.
        """
        shard = F.floor(F.col("day_no") / SHARD).cast("int")
        new = new.select("ticker", F.col("day_no").cast("int").alias("day_no"), "x", "m", "loaded_at", shard.alias("shard"))
        part = F.floor(F.col("shard") / PART).cast("int")
        touched = [r[0] for r in new.select(part).distinct().collect()]  # at most a calendar's days over SHARD * PART
        old = self.leaves().where(F.col("part").isin(touched))
        held = old.select("ticker", "shard", "day_no", F.struct("loaded_at", "x").alias("__old"))
        changed = new.join(held, ["ticker", "shard", "day_no"], "left").where(F.col("__old").isNull() | (F.struct("loaded_at", "x") > F.col("__old"))).select(new.columns)
        changed = materialise(changed, "changed-leaves")
        trees = correct_trees(self.trees().where(F.col("part").isin(touched)).select("ticker", "shard", "tree"), changed)
        kept = old.join(changed, ["ticker", "shard", "day_no"], "left_anti").select(new.columns)
        rewrite_parts(trees.withColumn("part", part), f"{self.path}/trees", "part")
        rewrite_parts(kept.unionByName(changed).withColumn("part", part), f"{self.path}/leaves", "part")
        return changed


def stored_trees(spark: SparkSession, returns: DataFrame, calendar: DataFrame, later, path: str | None = None) -> TreeStore:
    """The store after two runs: one with the rows for which ``later`` is not true, and one, that opens it anew, with the others."""
    path = path or scratch_path(spark, "trees")
    late = F.coalesce(later, F.lit(False))
    TreeStore(spark, path).extend(daily_leaves(returns.where(~late), calendar))
    store = TreeStore(spark, path)
    store.extend(daily_leaves(returns.where(late), calendar))
    return store


def p4_trailing(spark, sf_dir):
    """The days of the calendar's last year are taken in by a second run."""
    returns, calendar = read_table(spark, sf_dir, "daily_returns"), trading_calendar(read_table(spark, sf_dir, "market_days"))
    last = calendar.agg(F.date_sub(F.max("trade_date"), 365)).first()[0]
    store = stored_trees(spark, returns, calendar, F.col("trade_date") > F.lit(last))
    return trailing(store.trees().select("ticker", "shard", "tree"), spans(returns, calendar), calendar)


def p4_found(spark, sf_dir):
    return thin_windows(p4_trailing(spark, sf_dir))


def p4_totals(spark, sf_dir):
    t = p4_trailing(spark, sf_dir)
    return t.select("ticker", "trade_date", *[F.col(c).cast("bigint").alias(c) for c in ("days_back", "days", "usable")], *[F.round(c, k).alias(c) for c, k in (("total", 8), ("average", 12), ("volatility", 8))], F.round("beta", 4).alias("beta"))


def p4_late_corrections(spark, sf_dir):
    """Totals from stored trees of the rows loaded in time, corrected by a second run that sees only the late rows."""
    returns, calendar = read_table(spark, sf_dir, "daily_returns"), trading_calendar(read_table(spark, sf_dir, "market_days"))
    store = stored_trees(spark, returns, calendar, F.coalesce(F.datediff("loaded_at", "trade_date") > 2, F.lit(True)))
    t = trailing(store.trees().select("ticker", "shard", "tree"), spans(returns, calendar), calendar)
    return t.select("ticker", "trade_date", F.col("days_back").cast("bigint").alias("days_back"), F.col("usable").cast("bigint").alias("usable"), F.round("total", 6).alias("total"))


def p4_long_windows(spark, sf_dir):
    """Totals over 250 trading days, which reach over several shards."""
    returns, calendar = read_table(spark, sf_dir, "daily_returns"), trading_calendar(read_table(spark, sf_dir, "market_days"))
    t = trailing(build_trees(daily_leaves(returns, calendar)), spans(returns, calendar), calendar, (250,))
    return t.select("ticker", "trade_date", F.col("usable").cast("bigint").alias("usable"), F.round("total", 6).alias("total"))
