"""Rolling totals from segment trees: against brute force, corrections, and the odd inputs."""

import glob
import math
import os
import random
from datetime import date, datetime, timedelta

import numpy as np

from tidemark.operators import trailing as t

D0 = date(2021, 1, 4)
RET = "ticker string, trade_date date, stock_return double, loaded_at timestamp"


def _calendar(spark, n=200):
    days = [D0 + timedelta(days=i) for i in range(n * 7 // 5 + 3) if (D0 + timedelta(days=i)).weekday() < 5][:n]
    return days, spark.createDataFrame([(d, math.sin(i) / 50) for i, d in enumerate(days)], "trade_date date, market_return double")


def _random_rows(days, seed=1):
    rng = random.Random(seed)
    rows = []
    for tk in ("aa", "BB", "$CC"):
        for d in days[rng.randrange(30) : len(days) - rng.randrange(30)]:
            for k in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append((tk, d, rng.choice([None, float("nan"), -1.0, -3.0, float("inf"), *[rng.gauss(0, 0.02) for _ in range(8)]]), datetime(2022, 1, 1) + timedelta(hours=k)))
    return rows + [("BB", days[5] + timedelta(days=5 - days[5].weekday()), 0.5, datetime(2022, 1, 1)), (None, days[3], 0.1, None)]


def _run(spark, rows, market):
    r, cal = spark.createDataFrame(rows, RET), t.trading_calendar(market)
    return t.trailing(t.build_trees(t.daily_leaves(r, cal)), t.spans(r, cal), cal)


def _brute(rows, days, market):
    out = {}
    for tk in ("AA", "BB", "CC"):
        mine = [x for x in rows if x[0] and x[0].upper().strip("$") == tk]
        lo, hi = min(x[1] for x in mine), max(x[1] for x in mine)
        span = [d for d in days if lo <= d <= hi]
        best = {}
        for _, d, x, at in mine:
            if x is not None and math.isfinite(x) and x > -1:
                best[d] = max(best.get(d, (datetime.min, -9)), (at, x))
        for i, d in enumerate(span):
            for w in (20, 60):
                part = span[max(0, i - w + 1) : i + 1]
                out[tk, d, w] = len(part), [(best[p][1], market[p]) for p in part if p in best]
    return out


def test_totals_equal_brute_force(spark):
    days, market = _calendar(spark)
    rows = _random_rows(days)
    want = _brute(rows, days, {r[0]: r[1] for r in market.collect()})
    got = {(r.ticker, r.trade_date, r.days_back): r for r in _run(spark, rows, market).collect()}
    assert set(got) == set(want)
    for k, (n, xs) in want.items():
        g = got[k]
        assert (g.days, g.usable) == (n, len(xs))
        assert math.isclose(g.total, sum(x for x, _ in xs), abs_tol=1e-12)
        if xs:
            a = np.array(xs)
            assert math.isclose(g.average, a[:, 0].mean(), abs_tol=1e-12) and math.isclose(g.volatility, a[:, 0].std(), abs_tol=1e-9)
        else:
            assert g.average is None and g.volatility is None
        if len(xs) >= 5:
            c = np.cov(a.T, bias=True)
            assert math.isclose(g.beta, c[0, 1] / c[1, 1], rel_tol=1e-6, abs_tol=1e-9)
        else:
            assert g.beta is None


def test_corrections_touch_only_ancestors_and_equal_a_rebuild(spark):
    days, market = _calendar(spark)
    rows = _random_rows(days, 2)
    cal = t.trading_calendar(market)
    whole = t.daily_leaves(spark.createDataFrame(rows, RET), cal)
    late = {d for i, d in enumerate(days) if i % 9 == 4}
    early = t.daily_leaves(spark.createDataFrame([r for r in rows if r[1] not in late], RET), cal)
    fixes = whole.join(early, ["ticker", "day_no"], "left_anti")
    a = {(r.ticker, r.shard): r.tree for r in t.correct_trees(t.build_trees(early), fixes).collect()}
    b = {(r.ticker, r.shard): r.tree for r in t.build_trees(whole).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    gone = whole.limit(1).selectExpr("ticker", "day_no", "cast(null as double) x", "m")
    fixed = t.correct_trees(t.build_trees(whole), gone)
    assert sum(r.tree[len(t.STATS)] for r in fixed.collect()) == whole.count() - 1  # the root's count


def test_climb_of_a_leaf_changes_its_path_only():
    nodes = t._climb(np.zeros((1, 2 * t.SHARD, 1)))
    nodes[0, t.SHARD + 37] = 5
    before = nodes.copy()
    after = t._climb(nodes, np.array([37]))
    changed = np.flatnonzero((before != after).any(axis=(0, 2)))
    assert list(changed) == sorted((t.SHARD + 37) >> k for k in range(1, 7))


def test_thin_windows_and_short_spans(spark):
    days, market = _calendar(spark, 60)
    rows = [("AA", days[0], None, None), ("AA", days[30], None, None)] + [("AA", days[i], 0.01, datetime(2022, 1, 1)) for i in range(11)] * 2
    found = t.thin_windows(_run(spark, rows, market))
    assert [r.trade_date for r in found.orderBy("trade_date").collect()] == [d.isoformat() for d in days[19:31]]
    assert t.thin_windows(_run(spark, [("AA", days[i], 0.01, None) for i in range(19)], market)).count() == 0


def test_empty_tables_and_dates_outside_the_calendar(spark):
    days, market = _calendar(spark, 30)
    assert _run(spark, [], market).count() == 0
    assert _run(spark, [("AA", days[0] - timedelta(days=400), 0.1, None)], market).count() == 0
    assert _run(spark, [("AA", days[0], 0.1, None)], market.limit(0)).count() == 0


def test_windows_over_several_shards_equal_brute_force(spark):
    rng = random.Random(9)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(400)]
    cal = t.trading_calendar(spark.createDataFrame([(d, rng.gauss(0, 0.01)) for d in days], "trade_date date, market_return double"))
    rows = [("A", d, rng.gauss(0, 0.02), None) for d in days if rng.random() < 0.7] + [("B", d, rng.gauss(0, 0.02), None) for d in days[50:70]]
    r = spark.createDataFrame(rows, "ticker string, trade_date date, stock_return double, loaded_at timestamp")
    got = {(x["ticker"], x["trade_date"], x["days_back"]): (x["usable"], x["total"]) for x in t.trailing(t.build_trees(t.daily_leaves(r, cal)), t.spans(r, cal), cal, (65, 128, 129, 250)).collect()}
    have = {(a, d): x for a, d, x, _ in rows}
    for (a, d, n), (u, total) in got.items():
        window = [have[a, e] for e in (d - timedelta(days=i) for i in range(n)) if (a, e) in have]
        assert u == len(window) and abs(total - sum(window)) < 1e-9


def test_a_second_run_goes_on_with_the_stored_trees(spark, tmp_path):
    rng = random.Random(10)
    at = lambda n: datetime(2022, 1, 1) + timedelta(days=n)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(600)]
    cal = t.trading_calendar(spark.createDataFrame([(d, 0.01) for d in days], "trade_date date, market_return double"))
    schema = "ticker string, trade_date date, stock_return double, loaded_at timestamp"
    first = [("A", d, 0.01, at(1)) for d in days[:300]] + [("B", d, 0.02, at(1)) for d in days[100:200]]
    late = [("A", days[10], 0.5, at(2)), ("A", days[11], 0.9, at(0)), ("A", days[301], 0.3, None), ("B", days[599], -0.1, at(2)), ("C", days[0], 0.7, at(2)), ("A", days[12], -5.0, at(2))]
    path = f"file://{tmp_path}/trees"
    t.TreeStore(spark, path).extend(t.daily_leaves(spark.createDataFrame(first, schema), cal))
    stamp = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/trees/trees/part=1/*.parquet")}
    changed = t.TreeStore(spark, path).extend(t.daily_leaves(spark.createDataFrame(late, schema), cal))
    assert sorted((r["ticker"], r["day_no"]) for r in changed.collect()) == [("A", 10), ("A", 301), ("B", 599), ("C", 0)]  # an older load and an unusable return change nothing
    every = spark.createDataFrame([r for r in first if r[:2] != ("A", days[10])] + late, schema)
    look = lambda trees: sorted((r["ticker"], r["shard"], tuple(round(x, 9) for x in r["tree"])) for r in trees.collect())
    assert look(t.TreeStore(spark, path).trees().select("ticker", "shard", "tree")) == look(t.build_trees(t.daily_leaves(every, cal)))
    t.TreeStore(spark, path).extend(t.daily_leaves(spark.createDataFrame([("B", days[599], -0.2, at(3))], schema), cal))
    assert stamp and all(os.stat(p).st_mtime_ns == s for p, s in stamp.items() if os.path.exists(p))
    t.TreeStore(spark, path).extend(t.daily_leaves(spark.createDataFrame([], schema), cal))
