"""Composites on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import attribution, splits
from tidemark.plans import pipelines as p


def test_normalised_inputs(spark):
    row = ("c1", "T", "2024-01-02", 0.1, None, 0.2, "x", 0.3, 5e9, 7)
    cols = "call_id string, ticker string, event_date string, car_horizon double, sue_eps double, sue_rev double, pre_event_return_5d string, volatility_20d double, hist_market_cap double, num_questions int"
    got = p.call_level(spark.createDataFrame([row, row, (None, *row[1:])], cols)).collect()
    assert len(got) == 1 and got[0]["market_cap"] == 5e9 and got[0]["qa_count"] == 7 and got[0]["pre_event_return"] is None and str(got[0]["call_date"]) == "2024-01-02"
    with pytest.raises(ValueError):
        p.call_level(spark.createDataFrame([("c", "t")], "call_id string, ticker string"))
    pairs = p.pair_level(spark.createDataFrame([("c", 3, None, "a"), ("c", None, "q", None)], "call_id string, pair_index int, question_text string, answer_text string")).collect()
    assert sorted((r["pair_id"], r["question_text"], r["answer_text"]) for r in pairs) == [("c::0", "q", ""), ("c::3", "", "a")]


def test_call_fields_follow_their_fold(spark):
    pairs = spark.createDataFrame([("c", 1), ("c", 2), ("d", 1)], "call_id string, fold int")
    calls = spark.createDataFrame([("c", 1, 10), ("c", 2, 20)], "call_id string, fold int, x int")
    assert sorted((r["fold"], r["x"]) for r in p.call_fields_in_pairs(pairs, calls, ["x"]).collect()) == [(1, 10), (2, 20)]


def test_ticker_lists(spark):
    d = spark.createDataFrame([("goog, FB ,,$aapl,GOOGL",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(text.ticker_list(F.col("t"))).collect()] == [["GOOGL", "META", "AAPL"], [], []]


def _frame(spark, n=120):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((f"c{i:03d}", i, x, z, 0.5 * x + 0.3 * z + rng.gauss(0, 0.05)))
    return spark.createDataFrame([(a, b, c, d, t, int(t > 0)) for a, b, c, d, t in rows], "call_id string, event_date int, x double, z double, target double, label int").withColumn("event_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("event_date")))


def test_residuals_add_to_the_baseline(spark):
    c = _frame(spark)
    f = splits.rolling_splits(c, 60, 20, 20, 20)
    pairs = c.select("call_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pair_index"), F.col("z").alias("pz"))
    r = p.residual_pipeline(c.drop("z"), pairs, f, ["x"], ["pz"], "target").where("split = 'test'").collect()
    miss = lambda k: np.mean([(x["target"] - x[k]) ** 2 for x in r])
    assert len({x["fold"] for x in r}) == 2 and miss("final_pred") < 0.2 * miss("baseline_pred")
    by = p.fold_metrics(p.residual_pipeline(c, pairs, f, ["x"], ["pz"], "target", "meta_ridge"), "target", ["fold", "split"])
    assert p.mean_metrics(by).first()["folds"] == 2 and by.where("split = 'test'").first()["rmse"] < 0.2


def test_ladder_and_deltas(spark):
    c = _frame(spark)
    t = {r["benchmark"]: r for r in p.deltas(p.benchmark_table(p.benchmark_ladder(c, splits.rolling_splits(c, 60, 20, 20, 20), {"x": ["x"], "both": ["x", "z"], "none": []}, "target", "label")), "x", ["auroc"]).collect()}
    assert set(t) == {"x", "both"} and t["both"]["auroc"] > t["x"]["auroc"] and t["x"]["delta_auroc_vs_base"] == 0 and t["both"]["rows"] == 40


def test_one_hot_and_sequences(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, v int")
    out, names = p.one_hot(d.where("v < 3"), d, "k")
    assert [[r[n] for n in names] for r in out.orderBy("v").collect()] == [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]
    q = spark.createDataFrame([("c", 2, 5.0), ("c", 1, 1.0)], "call_id string, pair_index int, v double")
    assert p.call_sequences(q, ["v"], {"v": (3.0, 2.0)}).first()["features"] == [[-1.0], [1.0]]


def test_explanations(spark):
    d = spark.createDataFrame([("a", ["one", "three"], [1.0, 2.0])], "k string, tokens array<string>, scores array<double>")
    s = attribution.Additive(F.length)
    assert d.select(p.integrated_gradients(F.col("tokens"), s)).first()[0] == [3.0, 5.0]
    m, c = p.explain(d, "k", {"given": lambda r: r}, s, 1)
    assert p.method_means(m).first()["comprehensiveness"] == pytest.approx(5 / 8) and p.mean_curves(c).count() == 11


def test_runs_are_collected(spark, tmp_path):
    for run, files in (("r1", ("config.json", "val_metrics.json", "test_metrics.json")), ("r2", ("config.json",))):
        (tmp_path / run).mkdir()
        for f in files:
            (tmp_path / run / f).write_text('{"f": "%s"}' % f)
    got = p.collect_results(spark, str(tmp_path)).collect()
    assert [r["run"] for r in got] == ["r1"] and got[0]["val"] == '{"f": "val_metrics.json"}'
    both = p.comparison({"a": spark.createDataFrame([(1, 2)], "x int, y int"), "b": spark.createDataFrame([(3,)], "x int")})
    assert sorted((r["source"], r["x"], r["y"]) for r in both.collect()) == [("a", 1, 2), ("b", 3, None)]


def test_market_caps_and_growth(spark):
    shares = spark.createDataFrame([("c1", "T", None, 10.0), ("c2", "T", None, None), ("c3", "U", None, 5.0)], "call_id string, ticker string, event_date date, shares double")
    closes = spark.createDataFrame([("c1", 2.0), ("c3", 2.0)], "call_id string, close double")
    got = {r["call_id"]: (r["hist_market_cap"], r["hist_market_cap_percentile"]) for r in p.market_caps(shares, closes).collect()}
    assert got == {"c1": (20.0, 1.0), "c2": (None, None), "c3": (10.0, 0.5)}
    g = spark.createDataFrame([("c1", "T", 1, 10.0), ("c2", "T", 2, 15.0)], "call_id string, ticker string, event_date int, v double")
    assert {r["call_id"]: r["v_growth"] for r in p.growth(g, "v").collect()} == {"c1": None, "c2": 0.5}
