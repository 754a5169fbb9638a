"""What the operators must give on small inputs with known answers."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import asof, attribution, calendar, curation, fundamentals, latent, linear, metrics, pairing, parsing, pooling, splits, universe

D = date


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_questions_are_extracted_in_order(spark):
    t = spark.createDataFrame([("c1", "A", D(2024, 1, 1), 1, "management", "prepared remarks", "intro"), ("c1", "A", D(2024, 1, 1), 2, "analyst", "q&a", "question one"), ("c1", "A", D(2024, 1, 1), 3, "management", "q&a", "answer one")], "call_id string, ticker string, event_date date, turn_id int, speaker_role string, section string, text string")
    assert rows(pairing.extract_questions(t), "text", "num_questions") == [("question one", 1)]


COLON = """Executives: Jane Roe - CEO Max Poe - CFO Analysts: Ann Lee - Some Bank Operator: Welcome to the call. Jane Roe: We had a good year. Max Poe: Margins rose. Operator: We will now begin the question-and-answer session.
Ann Lee: How do you see margins next year? Max Poe: We see them stable. Bob Kay: And capital spending, what about it? Jane Roe: It stays flat."""


def test_colon_transcripts(spark):
    r = spark.createDataFrame([("x", COLON), ("empty", ""), ("null", None), ("plain", "no labels at all")], "k string, t string")
    out = parsing.parse_colon(r, "k", "t").orderBy("idx")
    assert rows(out, "k", "speaker_role") == [("x", "analyst"), ("x", "management"), ("x", "analyst"), ("x", "management")]


def test_dashed_sections(spark):
    dash = "-" * 30
    s = f"Presentation\nfoo\nQuestions and Answers\n{dash}\nOperator\n{dash}\nFirst question please.\n{dash}\nAnn Lee, Some Bank, Analyst\n{dash}\nWhat about costs?\n{dash}\nJane Roe, CEO\n{dash}\nThey fall.\n"
    out = parsing.parse_sections(spark.createDataFrame([("x", s), ("y", "nothing")], "k string, t string"), "k", "t").orderBy("idx")
    assert rows(out, "speaker", "speaker_role") == [("Operator", "operator"), ("Ann Lee", "analyst"), ("Jane Roe", "management")]


def test_structured_transcripts(spark):
    seg = [("Operator", "Welcome."), ("IR", "Thanks."), ("CEO", "Good quarter."), ("Operator", "We will now begin the question-and-answer session."), ("Ann Lee", "What about costs?"), ("CEO", "They fall."), ("CEO", " ")]
    out = parsing.parse_structured(spark.createDataFrame([("x", seg), ("y", None), ("z", [])], "k string, s array<struct<speaker:string,text:string>>"), "k", "s").orderBy("idx")
    assert rows(out, "speaker_role") == ["analyst", "management"]


def test_pairing_follows_the_state_machine(spark):
    """Against a plain loop over turns, on random conversations."""
    rng = random.Random(3)
    q = "What do you expect for the margin in the coming year?"
    says = {"analyst": [q, "Thanks.", "Okay, great.", "And the dividend, will it be raised this year or next?", "Next question please, what about it all then now?"], "management": ["We expect growth.", "Great.", "Right.", ""], "operator": ["Next caller.", "Go ahead."]}
    data, want = [], []
    for c in range(40):
        turns = [(f"c{c}", i, r, rng.choice(says[r])) for i, r in enumerate(rng.choice(["analyst", "management", "management", "operator"]) for _ in range(rng.randrange(1, 25)))]
        data += turns
        is_q = lambda r, s: r == "analyst" and "?" in s and len(s.strip()) >= 40 and "next question" not in s.lower()
        i, k = 0, 0
        while i < len(turns):
            _, n, r, s = turns[i]
            i += 1
            if not is_q(r, s):
                continue
            ans, first = [], True
            while i < len(turns) and not is_q(*turns[i][2:]):
                _, m, r2, s2 = turns[i]
                i += 1
                if r2 == "operator":
                    continue
                ack = len(s2.strip()) < 30 and "?" not in s2 and s2.strip().lower().startswith(("okay", "ok", "great", "thanks", "thank you", "all right", "right"))
                if first or not ack:
                    ans.append((m, s2.strip()))
                first = False
            said = " ".join(x for _, x in ans).strip()
            if said:
                want.append((f"c{c}", k, n, ans[0][0], ans[-1][0], said))
                k += 1
    df = spark.createDataFrame([(c, "T", D(2020, 1, 1), n, r, "q&a", s) for c, n, r, s in data], "call_id string, ticker string, event_date date, turn_id int, speaker_role string, section string, text string")
    got = rows(pairing.pair_turns(df), "call_id", "pair_index", "question_turn_id", "answer_start_turn_id", "answer_end_turn_id", "answer_text")
    assert sorted(got) == sorted(want) and len(want) > 20


def test_pair_annotations_and_filters(spark):
    p = spark.createDataFrame([("a", "x" * 120, ["management", "analyst", "management"], 3, 120), ("b", "why?", ["analyst"], 1, 4), ("c", None, None, 0, None)], "pair_id string, answer_text string, answer_roles array<string>, num_answer_turns int, answer_char_len int")
    a = pairing.annotate(p)
    r = {x["pair_id"]: x for x in a.collect()}
    assert r["a"]["answer_role_switch_count"] == 2 and r["a"]["answer_has_mixed_roles"] and not r["a"]["answer_is_short_strict"]
    assert r["b"]["answer_is_analyst_only"] and r["b"]["answer_contains_question_mark"] and not r["c"]["answer_has_analyst_role"]
    assert rows(pairing.filter_pairs(a, "strict"), "pair_id") == ["a"]
    assert dict(rows(pairing.filter_funnel(a, "strict"), "rule", "dropped"))["all"] == 2
    with pytest.raises(ValueError):
        pairing.rules("odd")


GRID = "ticker string, trade_date date, r double, m double"


def _grid(spark, r, m, first=D(2024, 1, 1)):
    return spark.createDataFrame([("T", first + timedelta(days=i), a, b) for i, (a, b) in enumerate(zip(r, m))], GRID)


def test_cumulative_abnormal_returns(spark):
    g = _grid(spark, [0.0, 0.02, 0.01, -0.01, 0.03], [0.0, 0.01, 0.0, -0.02, 0.01])
    e = spark.createDataFrame([("c", "T", D(2024, 1, 1)), ("late", "T", D(2024, 3, 1)), ("other", "U", D(2024, 1, 1))], "call_id string, ticker string, event_date date")
    out = {r["call_id"]: r for r in calendar.event_study(e, g, horizon=3).collect()}
    assert out["c"]["abnormal_return_series"] == "0.010000 0.010000 0.010000" and abs(out["c"]["car_horizon"] - 0.03) < 1e-12 and out["c"]["label"] == 1
    assert (out["late"]["car_horizon"], out["late"]["label"], out["late"]["has_window"]) == (0.0, 0, False) and not out["other"]["has_window"]


def test_truncated_horizon(spark):
    e = spark.createDataFrame([("c", "T", D(2024, 1, 1))], "call_id string, ticker string, event_date date")
    r = calendar.event_study(e, _grid(spark, [0.0, 0.01], [0.0, 0.0]), horizon=10).first()
    assert abs(r["car_horizon"] - 0.01) < 1e-12 and r["window_rows"] == 1 and r["label"] == 1


def test_prior_windows_do_not_see_the_future(spark):
    rng = np.random.default_rng(1)
    a, m = rng.normal(0, 0.01, 120).tolist(), rng.normal(0, 0.01, 120).tolist()
    e = spark.createDataFrame([("c", "T", D(2024, 1, 1) + timedelta(days=79))], "call_id string, ticker string, event_date date")
    x = calendar.event_study(e, _grid(spark, a, m)).first()
    y = calendar.event_study(e, _grid(spark, a[:80] + [9.0] * 40, m)).first()
    assert all(x[c] == y[c] for c in ("momentum_20", "volatility_60", "beta_60", "pre_5")) and x["car_horizon"] != y["car_horizon"]
    assert abs(x["momentum_5"] - sum(a[75:80])) < 1e-12 and abs(x["beta_60"] - np.cov(a[20:80], m[20:80], bias=True)[0, 1] / np.var(m[20:80])) < 1e-9
    assert abs(x["pre_5"] - (np.prod([1 + v for v in a[74:79]]) - 1)) < 1e-12


def test_record_metrics_and_question_count(spark):
    seg = [("Operator", "We will now begin the question-and-answer session."), ("Jo - Analyst", "How are margins?"), ("CEO", "Good?"), ("Jo - Analyst", "Thanks.")]
    r = spark.createDataFrame([("s:f:1", "s", "f", 1, "aapl", "2024-01-25 16:30:00", "A", "We begin the question and answer session. Why?", seg, 5), ("s:f:2", "s", "f", 2, None, "bad", None, None, None, None)], "record_key string, source_id string, source_file string, source_row long, ticker string, event_date string, company string, transcript string, structured_content array<struct<speaker:string,text:string>>, source_priority int")
    m = {x["record_key"]: x for x in curation.record_metrics(r).collect()}
    a, z = m["s:f:1"], m["s:f:2"]
    assert (a["ticker"], str(a["event_date"]), a["has_qa_section"], a["analyst_question_count"]) == ("AAPL", "2024-01-25", 1, 2) and a["text_hash"]
    assert (z["transcript_chars"], z["text_hash"], z["valid_ticker"], z["missing_event_date"]) == (0, None, 0, 1)


METRIC = "record_key string, source_id string, ticker string, event_date date, text_hash string, has_qa_section int, analyst_question_count int, has_structured_content int, valid_ticker int, valid_event_date int, source_priority int, repeated_operator_text int, transcript_chars long, transcript_words long, non_ascii_ratio double"


def _metric(k, h="h", q=1, chars=9000, prio=10, struct=0, qa=1, day=D(2024, 1, 1), tk="T"):
    return (k, "s", tk, day, h, qa, q, struct, 1, 1, prio, 0, chars, chars // 5, 0.0)


def test_the_better_record_survives(spark):
    d = curation.deduplicate(spark.createDataFrame([_metric("a"), _metric("b", q=3, struct=1, chars=12000, prio=50), _metric("n1", None, tk=None), _metric("n2", None, tk=None)], METRIC))
    r = {x["record_key"]: x for x in d.collect()}
    assert r["a"]["duplicate_of"] == "b" and r["a"]["drop_reason"] == "exact_text_duplicate" and r["b"]["drop_reason"] == r["n1"]["drop_reason"] == ""


def test_versions_of_a_day(spark):
    d = curation.deduplicate(spark.createDataFrame([_metric("a", "1", chars=10000), _metric("b", "2", chars=11000), _metric("c", "3", chars=10000, tk="U"), _metric("d", "4", chars=20000, tk="U")], METRIC))
    assert {x["record_key"]: x["drop_reason"] for x in d.collect()} == {"a": "version_duplicate", "b": "", "c": "ticker_date_duplicate", "d": ""}


def test_quality_filters(spark):
    d = curation.deduplicate(spark.createDataFrame([_metric("keep", "1", q=3), _metric("drop", "2", q=0, chars=1200, qa=0, tk="U")], METRIC))
    r = {x["record_key"]: x for x in curation.quality_filters(d).collect()}
    assert r["keep"]["keep_gold"] and not r["drop"]["keep_gold"] and r["drop"]["hard_filter_failures"] == "missing_qa,short_transcript,too_few_analyst_questions"


def test_time_split(spark):
    c = spark.createDataFrame([(f"c{i:02d}", D(2024, 1, 1) + timedelta(days=i)) for i in range(20)], "call_id string, event_date date")
    s = {x["call_id"]: x["split"] for x in splits.time_split(c).collect()}
    assert [sum(v == k for v in s.values()) for k in ("train", "val", "test")] == [14, 3, 3] and [s[f"c{i:02d}"] for i in (13, 14, 16, 17)] == ["train", "val", "val", "test"]


def test_rolling_splits_do_not_overlap(spark):
    c = spark.createDataFrame([(f"c{i}", D(2024, 1, 1) + timedelta(days=i)) for i in range(8)], "call_id string, event_date date")
    f = splits.rolling_splits(c, 4, 2, 1, 1)
    got = {(k, s): sorted(x["call_id"] for x in f.where(f"fold = {k} and split = '{s}'").collect()) for k in (0, 1) for s in ("train", "val", "test")}
    assert got[0, "train"] == ["c0", "c1", "c2", "c3"] and got[0, "val"] == ["c4", "c5"] and got[0, "test"] == ["c6"] and got[1, "test"] == ["c7"] and f.select("fold").distinct().count() == 2
    assert splits.rolling_splits(c.limit(3), 4, 2, 1, 1).count() == 0


def test_validation_names_what_is_missing(spark):
    c = spark.createDataFrame([(f"c{i}", D(2024, 1, 1) + timedelta(days=i), 1.0 if i % 2 else None) for i in range(12)], "call_id string, event_date date, x double")
    p = spark.createDataFrame([(f"c{i}::{k}", f"c{i}") for i in range(12) for k in range(10)] + [("q", "nobody"), ("q", "nobody")], "pair_id string, call_id string")
    f = splits.rolling_splits(c, 6, 2, 2, 2)
    v = splits.validate(c, p, f, coverage={"x": 0.9, "gone": 0.5}, least={"calls": 12, "pairs": 100, "train_pairs": 50, "eval_pairs": 10})
    codes = set(rows(v, "code"))
    assert {"coverage_x", "coverage_gone", "orphan_pairs", "pair_id_repeated", "train_coverage_x"} <= codes and "min_calls" not in codes
    good = splits.validate(c, p.where("call_id <> 'nobody'"), f, coverage={}, least={"calls": 12, "pairs": 100, "train_pairs": 50, "eval_pairs": 10})
    assert good.count() == 0


SRC = "ticker string, at date, eps double"


def test_nearest_match(spark):
    t = spark.createDataFrame([("a", "T", D(2024, 11, 1)), ("b", "T", D(2024, 12, 1)), ("c", "U", D(2024, 11, 1)), ("d", None, None)], "call_id string, ticker string, event_date date")
    s = spark.createDataFrame([("T", D(2024, 10, 31), 0.04)], SRC)
    out = asof.nearest(t, s, key="ticker", target_at="event_date", source_at="at", payload=["eps"], max_days=3)
    assert {x["call_id"]: (x["match_status"], x["eps"]) for x in out.collect()} == {"a": ("matched", 0.04), "b": ("outside_tolerance", None), "c": ("missing_source", None), "d": ("missing_source", None)}


def test_nearest_equals_brute_force_and_prefers_the_earlier(spark):
    rng = random.Random(4)
    ts = [(str(i), rng.choice("AB"), D(2024, 1, 1) + timedelta(days=rng.randrange(60))) for i in range(80)]
    ss = [(rng.choice("AB"), D(2024, 1, 1) + timedelta(days=rng.randrange(60)), float(i)) for i in range(25)]
    out = asof.nearest(spark.createDataFrame(ts, "call_id string, ticker string, event_date date"), spark.createDataFrame(ss, SRC), key="ticker", target_at="event_date", source_at="at", payload=["eps"], max_days=3)
    got = {x["call_id"]: x["source_event_date"] for x in out.collect()}
    for i, k, at in ts:
        assert got[i] == min((abs((d - at).days), d) for kk, d, _ in ss if kk == k)[1]


def test_backward_and_forward_asof(spark):
    ev = spark.createDataFrame([(1, "T", D(2024, 1, 5))], "id int, k string, at date")
    px = spark.createDataFrame([("T", D(2024, 1, 4), 1.0), ("T", D(2024, 1, 5), 2.0), ("T", D(2024, 1, 8), 3.0)], "k string, d date, v double")
    pick = lambda **o: asof.asof(ev, px, key="k", event_at="at", row_at="d", payload=["v"], into="x", **o).first()["x"]["v"]
    assert pick() == 2.0 and pick(strict=True) == 1.0 and pick(direction="forward") == 2.0 and pick(direction="forward", strict=True) == 3.0


FACT = "ticker string, concept string, unit string, fact_value double, period_start date, period_end date, filed_date date"


def test_quarters_from_cumulative_facts(spark):
    f = [("T", "R", "USD", 10.0, D(2024, 1, 1), D(2024, 3, 31), D(2024, 4, 20)), ("T", "R", "USD", 25.0, D(2024, 1, 1), D(2024, 6, 30), D(2024, 7, 20)), ("T", "R", "USD", 45.0, D(2024, 1, 1), D(2024, 9, 30), None), ("T", "R", "USD", 7.0, None, D(2024, 9, 30), None), ("T", "R", "USD", None, None, D(2024, 9, 30), None)]
    out = sorted((str(x["period_end"]), x["derived"], x["fact_value"]) for x in fundamentals.quarterly(spark.createDataFrame(f, FACT)).collect())
    assert out == [("2024-03-31", 0, 10.0), ("2024-09-30", 0, 7.0), ("2024-09-30", 1, 20.0)]


def test_facts_as_of(spark):
    f = spark.createDataFrame([("T", 1.0, D(2024, 3, 31), D(2024, 4, 30), 0), ("T", 2.0, D(2024, 3, 31), D(2024, 6, 30), 0), ("T", 3.0, D(2023, 9, 30), D(2023, 10, 1), 0)], "ticker string, fact_value double, period_end date, filed_date date, derived int")
    e = spark.createDataFrame([("c", "T", D(2024, 5, 15)), ("old", "T", D(2025, 5, 15))], "call_id string, ticker string, event_date date")
    loose = {r["call_id"]: r["fact_value"] for r in fundamentals.statement_asof(e, f).collect()}
    strict = {r["call_id"]: r["fact_value"] for r in fundamentals.statement_asof(e, f, strict_pit=True).collect()}
    assert loose == {"c": 2.0, "old": None} and strict == {"c": 1.0, "old": None}


def test_split_factors(spark):
    d = spark.createDataFrame([("T", D(2024, 1, i)) for i in (1, 5, 9)], "k string, d date")
    s = spark.createDataFrame([("T", D(2024, 1, 5), 2.0), ("T", D(2024, 1, 7), 3.0), ("T", D(2024, 1, 8), 0.0)], "k string, s date, f double")
    out = asof.suffix_product(d, s, key="k", at="d", split_at="s", factor="f", into="x").orderBy("d")
    assert rows(out, "x") == [6.0, 3.0, 1.0]


def test_prior_ratio_proxy(spark):
    e = spark.createDataFrame([("old", "T", D(2024, 1, 1), 100.0, 1000.0, 1000.0), ("new", "T", D(2024, 4, 1), 150.0, 1200.0, 1200.0)], "call_id string, ticker string, event_date date, reported_capex double, reported_revenue double, estimated_revenue double")
    got = {r["call_id"]: (r["estimated_capex"], r["estimated_capex_is_proxy"]) for r in fundamentals.capex_proxy(e).collect()}
    assert got == {"old": (None, 0), "new": (120.0, 1)}


def test_surprises_and_merged_events(spark):
    a = spark.createDataFrame([("T", D(2024, 1, 1), "1.1", "1.0", None), ("T", D(2024, 1, 1), None, None, None), ("U", D(2024, 1, 1), "x", "0", "5")], "ticker string, event_date date, eps_actual string, consensus_eps string, revenueActual string")
    b = spark.createDataFrame([("T", D(2024, 1, 1), 9.0, 7.0), ("V", D(2024, 1, 1), 1.0, 1.0)], "ticker string, event_date date, reported_eps double, reported_revenue double")
    m = fundamentals.merge_events([fundamentals.standardise_events(x, ["ticker", "event_date"]) for x in (a, b)], ["ticker", "event_date"])
    r = {x["ticker"]: x for x in fundamentals.surprise(m).collect()}
    assert r["T"]["reported_eps"] == 1.1 and r["T"]["reported_revenue"] == 7.0 and r["T"]["eps_label"] == "beat" and r["T"]["eps_beat"] == 1
    assert r["U"]["eps_label"] is None and r["U"]["eps_beat"] == 0 and r["V"]["reported_eps"] == 1.0


def test_frequency_equals_brute_force(spark):
    rng = random.Random(8)
    cs = [(f"c{i:03d}", rng.choice("AB"), D(2020, 1, 1) + timedelta(days=rng.choice([0, 365, 366, rng.randrange(900)]))) for i in range(60)]
    got = {x["call_id"]: x for x in calendar.call_frequency(spark.createDataFrame(cs, "call_id string, ticker string, event_date date")).collect()}
    for c, t, d in cs:
        prior = sorted((dd, cc) for cc, tt, dd in cs if tt == t and (dd, cc) < (d, c))
        g = got[c]
        assert g["prior_call_count"] == len(prior) and g["prior_call_count_365d"] == sum((d - dd).days <= 365 for dd, _ in prior)
        gaps = [(b[0] - a[0]).days for a, b in zip(prior, prior[1:])]
        assert g["mean_prior_call_gap_days"] == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)


def test_pooling(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, 0.5, 0.3, 0.2])] + [("one", 0, 2.0), ("flat", 0, 1.0), ("flat", 1, 1.0), ("none", 0, None)], "call_id string, pair_index int, score double")
    r = {x["call_id"]: x for x in pooling.rich_features(s, ["call_id"]).collect()}
    a = r["a"]
    assert a["top3_mean"] == pytest.approx(1 / 3) and a["bottom3_mean"] == pytest.approx(0.2) and a["first"] == 0.1 and a["last"] == 0.2 and a["recency_weighted_mean"] == pytest.approx(np.average([0.1, 0.5, 0.3, 0.2], weights=np.linspace(1, 2, 4)))
    assert a["trend_slope"] == pytest.approx(np.polyfit(range(4), [0.1, 0.5, 0.3, 0.2], 1)[0]) and r["flat"]["trend_slope"] == 0 and r["one"]["recency_weighted_mean"] == 2.0 and "none" not in r


def test_residual_aggregation_and_final_prediction(spark):
    p = spark.createDataFrame([("c1", 0.15), ("c1", 0.05)], "call_id string, pair_residual_pred double")
    r = pooling.residual_pool(p, ["call_id"], k=1)
    assert rows(r, "mean_pair_residual", "max_pair_residual", "topk_mean_pair_residual") == [(pytest.approx(0.1), 0.15, 0.15)]
    c = spark.createDataFrame([("c1", 0.01), ("c2", -0.03)], "call_id string, baseline_pred double")
    f = {x["call_id"]: x["final_pred"] for x in linear.final_prediction(pooling.attach(c, r, ["mean_pair_residual"])).collect()}
    assert f == {"c1": pytest.approx(0.11), "c2": -0.03}


def test_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 200), rng.integers(0, 40, 200) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    m = metrics.roc_pr(df, "y", "p").first()
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
    assert m["auroc"] == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))
    ap, tp = 0.0, 0
    for s in sorted(set(p), reverse=True):
        hit = ((p >= s) & (y == 1)).sum()
        ap += (hit - tp) / y.sum() * hit / (p >= s).sum()
        tp = hit
    assert m["auprc"] == pytest.approx(ap)
    one = metrics.roc_pr(df.where("y = 1"), "y", "p").first()
    assert one["auroc"] is None and one["auprc"] is None
    e = metrics.calibration_error(df, "y", "p").first()["ece"]
    edges = np.linspace(0, 1, 11)
    want = sum(abs(y[k].mean() - p[k].mean()) * k.mean() for i in range(10) if (k := (p >= edges[i]) & ((p < edges[i + 1]) | (i == 9))).any())
    assert e == pytest.approx(want)


@pytest.mark.parametrize("objective", ["accuracy", "balanced_accuracy", "f1"])
def test_threshold_search_equals_brute_force(spark, objective):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 60), np.round(rng.random(60), 2)
    cands = sorted({*np.round(np.linspace(0.05, 0.95, 19), 2), *p, 0.25, 0.5, 0.75})

    def score(t):
        h = p >= t
        tp, fp, fn, tn = (h & (y == 1)).sum(), (h & (y == 0)).sum(), (~h & (y == 1)).sum(), (~h & (y == 0)).sum()
        return {"accuracy": (tp + tn) / 60, "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2, "f1": 2 * tp / (2 * tp + fp + fn)}[objective]

    best = min(cands, key=lambda t: (-round(score(t), 12), round(abs(t - 0.5), 12), t))
    got = metrics.select_threshold(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), "y", "p", objective).first()
    assert got["threshold"] == pytest.approx(best) and got["score"] == pytest.approx(score(best))


def test_ridge_leave_one_out_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    y = x @ [0.5, -0.2] + rng.normal(size=40) * 0.1 + 1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = linear.Ridge(["a", "b"], alphas=(0.1, 10.0)).fit(df, "y")
    z = (x - x.mean(0)) / x.std(0)
    for alpha in (0.1, 10.0):
        loss = []
        for i in range(40):
            k = np.arange(40) != i
            mu, xb = y[k].mean(), z[k].mean(0)
            w = np.linalg.solve((z[k] - xb).T @ (z[k] - xb) + alpha * np.eye(2), (z[k] - xb).T @ (y[k] - mu))
            loss.append((y[i] - mu - (z[i] - xb) @ w) ** 2)
        assert m.loo[alpha] == pytest.approx(np.mean(loss), rel=1e-9)
    r, _ = linear.residual_targets(df, df.withColumn("b", F.when(F.col("b") > 0, F.col("b"))), ["a", "b", "absent"], "y")
    assert all(abs(t["y"] - t["baseline_pred"] - t["residual_target"]) < 1e-12 for t in r.collect())


def test_calibrator(spark):
    df = spark.createDataFrame([(float(i), int(i > 10)) for i in range(20)], "s double, y int")
    p = rows(df.select(linear.Calibrator().fit(df, "s", "y").predict().alias("p")), "p")
    assert p == sorted(p) and p[0] < 0.1 < 0.9 < p[-1]
    assert rows(df.select(linear.Calibrator().fit(df.where("y = 1"), "s", "y").predict().alias("p")), "p")[0] == 1.0


def test_rationales(spark):
    df = spark.createDataFrame([("x", ["[CLS]", "a", "b", "c", "[SEP]"], [9.0, 0.5, 0.9, 0.5, 9.0]), ("s", ["[CLS]"], [1.0]), ("e", [], [])], "k string, tokens array<string>, scores array<double>")
    top = {r["k"]: r["t"] for r in df.select("k", attribution.topk(F.col("tokens"), F.col("scores"), 2).alias("t")).collect()}
    assert top["x"] == [2, 3] and top["s"] == []
    scorer = lambda t, m: F.aggregate(m, F.lit(0.0), lambda a, b: a + b)
    four = spark.createDataFrame([("x", ["a", "b", "c", "d"], [4.0, 3.0, 2.0, 1.0])], "k string, tokens array<string>, scores array<double>")
    r = attribution.faithfulness(four, scorer, 2).first()
    assert r["rationale"] == [0, 1] and r["comprehensiveness"] == 2.0 and r["sufficiency"] == 2.0
    curve = attribution.deletion_curve(four, "k", scorer, steps=4).orderBy("fraction_removed")
    assert rows(curve, "score") == [4.0, 3.0, 2.0, 1.0, 0.0] and attribution.curve_area(curve, "k").first()["auc"] == pytest.approx(2.0)
    assert attribution.random_baseline(four, "k", scorer, 2, trials=5).first()["random_mean"] == 2.0


def test_array_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    ar = lambda *v: F.array(*[F.lit(x) for x in v])
    assert get(attribution.cosine(ar(1.0, 0.0), ar(0.0, 0.0))) == 0.0 and get(attribution.cosine(ar(1.0), ar(1.0, 2.0))) is None and get(attribution.cosine(ar(1.0, 1.0), ar(2.0, 2.0))) == pytest.approx(1)
    assert get(attribution.head_tail(ar(1, 2, 3, 4, 5), 3)) == [1, 4, 5] and get(attribution.minmax(ar(1.0, 3.0, 2.0))) == [0.0, 1.0, 0.5] and get(attribution.minmax(ar(1.0, 1.0))) == [0.0, 0.0]
    assert get(attribution.overlap(ar("a", "b", "a"), ar("b"))) == 0.5 and get(attribution.argmax(attribution.softmax(ar(1.0, 5.0, 2.0)))) == 1


def test_average_ranks_across_buckets(spark):
    rng = random.Random(6)
    v = [rng.choice([None, float(rng.randrange(400))]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    got = {r["i"]: r["r"] for r in universe.average_rank(df, "v", "r").collect()}
    live = sorted(x for x in v if x is not None)
    for i, x in enumerate(v[:200]):
        want = None if x is None else sum(a < x for a in live) + (live.count(x) + 1) / 2
        assert got[i] == want


def test_spellings(spark):
    raw = ["aapl", " NQX:ab ", "$C/A", "D US", "E-B", "brk b", "", None, "nasdaq: xy.us"]
    got = rows(spark.createDataFrame([(x,) for x in raw], "t string").select(text.canonical_ticker(F.col("t")).alias("x")), "x")
    assert got == ["AAPL", "AB", "C.A", "D", "E.B", "BRK.B", None, None, "XY"]
    days = ["2024-01-05", "2024-01-05T10:00:00Z", "01/05/2024", "Jan 5, 2024", "20240105", "0000-00-00", "n/a", None, "31/31/2024"]
    assert [str(x) for x in rows(spark.createDataFrame([(x,) for x in days], "t string").select(text.parse_day(F.col("t")).alias("x")), "x")] == ["2024-01-05"] * 5 + ["None"] * 4
    assert rows(spark.createDataFrame([("CIK0000700011",), (" 700011",), ("700011.0",), ("0000000000",), ("0",), (None,)], "t string").select(text.digits_key(F.col("t")).alias("x")), "x") == ["700011"] * 3 + [None] * 3


def test_encoder_and_ablation(spark):
    e = spark.createDataFrame([([1.0, -1.0], 1), ([2.0, 0.0], 0)], "v array<double>, y int")
    assert rows(latent.encode(e, "v", np.eye(2), np.zeros(2)), "latent") == [[1.0, 0.0], [2.0, 0.0]]
    half = (np.eye(2), np.zeros(2)), (np.eye(2) / 2, np.zeros(2))
    a = latent.ablation(e, "v", *half, [0]).first()  # decoded (0.5, 0), (1, 0); without the first latent zeros
    assert (a["mse_base"], a["mse_ablated"]) == (pytest.approx((0.25 + 1 + 1) / 4), pytest.approx(6 / 4)) and a["delta"] == pytest.approx(a["mse_ablated"] - a["mse_base"])
    nulls = spark.createDataFrame([([1.0, -1.0], 1), (None, 0)], "v array<double>, y int")
    assert latent.ablation(nulls, "v", *half, []).first()["delta"] == 0 and latent.ablation(nulls.limit(0), "v", *half, [0]).first()["delta"] is None
    assert {r["feature"]: r["label_corr"] for r in latent.feature_report(e, "v", "y").collect()}[0] == pytest.approx(-1)


def test_turns_without_numbers_keep_the_delivered_order(spark):
    t = spark.createDataFrame([("c", "T", "2024-01-02", " Analyst ", "Q&A", "z  first", 1, "f"), ("c", "T", "2024-01-02", "operator", "q&a", "a second", 2, "f")], "call_id string, ticker string, event_date string, speaker_role string, section string, text string, row int, file string")
    got = parsing.project_turns(t, ["file", "row"]).orderBy("turn_id").collect()
    assert [(r["turn_id"], r["speaker_role"], r["text"]) for r in got] == [(1, "analyst", "z first"), (2, "operator", "a second")]
    with pytest.raises(ValueError):
        parsing.project_turns(t)


def test_hot_values_and_quantiles(spark):
    rng = np.random.default_rng(5)
    v = [1.5] * 400 + rng.normal(size=300).round(2).tolist() + [None] * 20
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    got = {r["i"]: r["r"] for r in universe.average_rank(d, "v", "r").collect()}
    want = pd.Series(v).rank(method="average")
    assert len(got) == len(v) and all((got[i] is None and np.isnan(want[i])) or got[i] == want[i] for i in got)
    q = universe.quantiles(d, "v", [0.0, 0.05, 0.5, 0.9, 1.0]).first()["q"]
    assert q == pytest.approx(np.nanquantile(np.array(v, float), [0, 0.05, 0.5, 0.9, 1]))
    assert universe.quantiles(d.limit(0), "v", [0.5]).first()["q"] == [None]


def test_poisson_weights():
    w = metrics.poisson_weights(np.arange(20_000), 20, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and (w == metrics.poisson_weights(np.arange(20_000), 20, 1)).all()


def test_additive_scorers_equal_the_general_way(spark):
    d = spark.createDataFrame([("a", ["one", "[CLS]", "three", "four"], [1.0, 5.0, 2.0, 2.0]), ("b", ["x"], [1.0]), ("c", [], [])], "k string, tokens array<string>, scores array<double>")
    quick = attribution.Additive(F.length)
    slow = lambda t, m: quick(t, m)
    for f in (lambda s: attribution.perturbation(d, "k", s), lambda s: attribution.random_baseline(d, "k", s, 2, 5)):
        assert sorted(map(tuple, f(quick).collect())) == [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, f(slow).collect()))]
