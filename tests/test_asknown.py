"""Attributes as known at event time: against brute force, and the odd inputs."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import asknown

D0 = date(2020, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def test_as_known_equals_brute_force(spark):
    rng = random.Random(5)
    changes = [(rng.choice(["a", "b", None]), rng.choice([None] + [day(rng.randrange(400)) for _ in range(9)]), rng.randrange(50), float(rng.randrange(5))) for _ in range(300)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None] + [day(rng.randrange(-20, 450)) for _ in range(9)])) for i in range(200)]
    c = spark.createDataFrame(changes, "k string, known date, rank int, v double")
    e = spark.createDataFrame(events, "id int, k string, at date")
    got = {r["id"]: r["x"] and tuple(r["x"]) for r in asknown.as_known(e, c, event_entity="k", event_at="at", entity="k", known_at="known", version=["rank", "v"], into="x").collect()}
    assert len(got) == len(events)
    for i, k, at in events:
        fits = [(r, v) for kk, kn, r, v in changes if kk is not None and kk == k and kn and at and kn <= at]
        assert got[i] == (max(fits) if fits else None), i


def test_as_known_keeps_repeats_and_clashing_columns(spark):
    e = spark.createDataFrame([(1, "a", D0, "x"), (1, "a", D0, "x")], "id int, entity string, period date, log string")
    c = spark.createDataFrame([("a", D0, 1)], "entity string, period date, log int")
    out = asknown.as_known(e, c, event_entity="entity", event_at="period", entity="entity", known_at="period", version=["log"], into="state")
    assert out.count() == 2 and out.columns == ["id", "entity", "period", "log", "state"] and out.first()["state"]["log"] == 1


def test_as_known_of_empty_tables(spark):
    e = spark.createDataFrame([], "id int, k string, at date")
    c = spark.createDataFrame([], "k string, known date, v int")
    assert asknown.as_known(e, c, event_entity="k", event_at="at", entity="k", known_at="known", version=["v"], into="x").count() == 0
    one = spark.createDataFrame([(1, "a", D0)], "id int, k string, at date")
    assert asknown.as_known(one, c, event_entity="k", event_at="at", entity="k", known_at="known", version=["v"], into="x").first()["x"] is None


def _tables(spark, calls, facts, returns):
    return (
        spark.createDataFrame(calls, "call_id string, ticker string, event_date date, hist_market_cap_shares_staleness_days double, hist_market_cap_price_lag_days double, updated_at timestamp"),
        spark.createDataFrame(facts, "ticker string, concept string, fact_value double, period_end date, filed_date date"),
        spark.createDataFrame(returns, "ticker string, trade_date date, close_price double"),
    )


def test_only_what_was_known_counts(spark):
    t = datetime(2020, 6, 1)
    calls = [("c1", " $ab ", day(100), 40.0, 1.0, t), ("c2", "AB", day(100), 41.0, None, t), ("c3", "ZZ", day(100), 3.0, float("nan"), t), (None, "AB", day(1), 1.0, 1.0, t)]
    facts = [("AB", "CommonSharesOutstanding", 5e6, day(60), day(90)), ("AB", "CommonSharesOutstanding", 6e6, day(80), day(101)), ("AB", "CommonSharesOutstanding", 7e6, day(99), None), ("AB", "Revenues", 1.0, day(99), day(99))]
    returns = [("ab US", day(99), 10.0), ("AB", day(100), 11.0), ("AB", day(98), None)]
    known = asknown.calls_as_known(*_tables(spark, calls, facts, returns))
    got = {r["call_id"]: (r["shares_staleness"], r["price_lag"]) for r in known.collect()}
    assert got == {"c1": (40, 1), "c2": (40, 1), "c3": (None, None)}
    assert {(r[0], r[1]) for r in asknown.wrong_records(known).collect()} == {("c2", "shares_staleness"), ("c3", "shares_staleness")}


def test_the_latest_update_counts(spark):
    calls = [("c", "AB", day(100), 7.0, None, datetime(2020, 1, 1)), ("c", "AB", day(100), 40.0, None, datetime(2020, 1, 2))]
    t = _tables(spark, calls * 2, [("AB", "CommonSharesOutstanding", 5e6, day(60), day(60))], [])
    assert asknown.wrong_records(asknown.calls_as_known(*t)).count() == 0


def test_late_filings_never_change_the_past(spark):
    calls = [("c", "AB", day(100), None, None, datetime(2020, 1, 1))]
    facts = [("AB", "CommonSharesOutstanding", 5e6, day(60), day(70))]
    before = asknown.calls_as_known(*_tables(spark, calls, facts, [])).first()["shares_staleness"]
    after = asknown.calls_as_known(*_tables(spark, calls, facts + [("AB", "CommonSharesOutstanding", 9e6, day(95), day(200))], [])).first()["shares_staleness"]
    assert before == after == 40


def test_log_entries_are_one_a_day(spark):
    c = spark.createDataFrame([("a", D0, i) for i in range(1000)], "k string, known date, v int")
    r = asknown.snapshots_and_logs(c, "k", "known", ["v"]).select(F.size("log").alias("n"), "top.v").first()
    assert (r["n"], r["v"]) == (1, 999)


def test_a_second_run_extends_the_stored_logs(spark, tmp_path):
    rng = random.Random(4)
    some = lambda: date(2019, 1, 1) + timedelta(days=rng.randrange(1500))
    schema = "e string, at date, v int"
    rows = [(rng.choice("ab"), some(), rng.randrange(50)) for _ in range(300)] + [(None, some(), 1), ("a", None, 1)]
    asked = spark.createDataFrame([(rng.choice("abc"), some()) for _ in range(150)], "who string, day date")
    path = f"file://{tmp_path}/log"
    store = asknown.ChangeStore(spark, path)
    for part in (rows[:100], [], rows[100:180], rows[180:]):  # each part holds changes of all years
        asknown.ChangeStore(spark, path).extend(spark.createDataFrame(part, schema), "e", "at", ["v"])
    kw = dict(event_entity="who", event_at="day", entity="e", known_at="at", version=["v"], into="x")
    want = asknown.as_known(asked, spark.createDataFrame(rows, schema), **kw)
    got = asknown.as_known(asked, spark.createDataFrame([], schema), **kw, store=path)
    key = lambda d: sorted((r["who"], r["day"], r["x"]["v"] if r["x"] else -1) for r in d.collect())
    assert key(got) == key(want) and store.table().where("entity is null").count() == 0
