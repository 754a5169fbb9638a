"""Nearest time in a stream, packing and mixing."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as m
from tidemark.llm import nearest as n
from tidemark.llm import packing as p
from tidemark.llm import tokens

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SIDE = "entity string, id string, ts timestamp, side int, slot int"


def _sides(spark, left, right):
    mk = lambda rows: spark.createDataFrame([(e, i, t, 1, 1) for e, i, t in rows], SIDE)
    return n.sides(mk(left), mk(right))


def _random(seed):
    rng = random.Random(seed)
    at = lambda: T0 + dt.timedelta(hours=rng.randrange(24 * 90), seconds=rng.choice([0, 0, 1]))
    left = [(rng.choice(["hot"] * 6 + ["b", "c", None]), f"l{i}", rng.choice([at(), at(), at(), None])) for i in range(120)]
    right = [(rng.choice(["hot"] * 6 + ["b", "d"]), f"r{i:03d}", at()) for i in range(120)]
    return left, right + right[:9]


def _brute(left, right, tol=n.TOLERANCE_S):
    out = {}
    for e, i, t in left:
        if e and t:
            fits = [(abs((t - u).total_seconds()), u, j) for f, j, u in right if f == e and u and abs((t - u).total_seconds()) <= tol]
            out[i] = min(fits)[2] if fits else None
    return out


@pytest.mark.parametrize("slices", [1, 4])
def test_the_stream_finds_what_brute_force_finds(spark, slices):
    left, right = _random(slices)
    got = {r["left_id"]: r["right_id"] for r in n.replay(spark, _sides(spark, left, right), slices=slices).collect()}
    assert got == _brute(left, right)


def test_state_is_evicted_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(n, "GROUP_ROWS", 10)  # 400 groups: nearly one for each entity and slot
    left = [(f"e{i % 40}", f"l{i}", T0 + dt.timedelta(hours=i)) for i in range(2000)]
    right = [(f"e{i % 40}", f"r{i}", T0 + dt.timedelta(hours=i, minutes=20)) for i in range(2000)]
    out = n.replay(spark, _sides(spark, left, right), slices=5)
    assert out.where("right_id is not null").count() == 2000 and len(out._state_rows) >= 5 and out._state_rows[-1] == 0 and 0 < max(out._state_rows) < 200, out._state_rows


def test_ties_and_the_edge_of_the_tolerance(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    left = [("a", "tie", h(100)), ("b", "edge", h(100)), ("c", "beyond", h(100))]
    right = [("a", "after", h(101)), ("a", "before2", h(99)), ("a", "before1", h(99)), ("b", "r", h(172)), ("c", "r2", h(172) + dt.timedelta(microseconds=1))]
    got = {r["left_id"]: r["right_id"] for r in n.replay(spark, _sides(spark, left, right)).collect()}
    assert got == {"tie": "before1", "edge": "r", "beyond": None}
    assert n.replay(spark, _sides(spark, [], [])).count() == 0


def test_packing_respects_every_limit():
    rng = np.random.default_rng(1)
    d = np.stack([rng.integers(1, 400, 500), np.ones(500), rng.integers(0, 100, 500)], axis=1).astype(float)
    lim = np.array([512, 5, 200], float)
    at = p.dot_product_packing(d, lim)
    assert (at >= 0).all() and all((d[at == b].sum(axis=0) <= lim).all() for b in range(at.max() + 1))
    assert at.max() + 1 <= 1.12 * max(np.ceil(d.sum(axis=0) / lim))
    with pytest.raises(ValueError):
        p.dot_product_packing(np.array([[600.0, 1, 0]]), lim)
    assert len(p.dot_product_packing(np.zeros((0, 3)), lim)) == 0


SIZES, SPECS = "doc_id long, tokens long, loss_tokens long, piece int, pool int", "container_kind string, capacity_tokens int"


def test_every_token_is_packed_once(spark):
    rng = random.Random(2)
    sizes = spark.createDataFrame([(i, v, v // 2, 0, 0) for i, v in enumerate([0, 1, 512, 513, 5000] + [rng.randrange(1, 900) for _ in range(400)])], SIZES)
    specs = spark.createDataFrame([("s", 512), ("l", 2048), ("l", 2048), (None, 5), ("zero", 0)], SPECS)
    got = p.pack(sizes, specs, pool_containers=20).cache()
    per = {(r["container_kind"], r["doc_id"]): (r["t"], r["k"], r["lo"], r["hi"]) for r in got.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.min("first_token").alias("lo"), F.max(F.col("first_token") + F.col("tokens")).alias("hi")).collect()}
    for r in sizes.where("tokens > 0").collect():
        for kind, cap in (("s", 512), ("l", 2048)):
            t, k, lo, hi = per[kind, r["doc_id"]]
            assert (t, lo, hi) == (r["tokens"], 0, r["tokens"]) and k == -(-r["tokens"] // cap)
    box = got.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    assert box.where("(container_kind = 's' and (t > 512 or n > 16)) or (container_kind = 'l' and (t > 2048 or n > 64))").count() == 0
    assert got.groupBy("container_kind", "container_id").agg(F.sum("loss_tokens").alias("l")).where("(container_kind = 's' and l > 506) or (container_kind = 'l' and l > 2027)").count() == 0
    big = p.pieces(spark.createDataFrame([(1, 5001, 3333, 0, 0)], SIZES), specs).groupBy("container_kind").agg(F.sum("loss_tokens").alias("l")).collect()
    assert [r["l"] for r in big] == [3333, 3333]
    fill = {r["container_kind"]: r["fill"] for r in p.fill_report(got, specs).collect()}
    assert set(fill) == {"s", "l"} and min(fill.values()) > 0.9
    assert p.pack(sizes.limit(0), specs).count() == 0 and p.pack(sizes, specs.limit(0)).count() == 0


def test_tokens_of_whole_texts(spark):
    enc = tokens.encoder(f"{tokens.FOLDER}/{tokens.TOKENIZER}")
    assert tokens.count(None, enc) == (0, 0) == tokens.count("", enc) and tokens.count("Hello world.", enc)[0] == len(enc.encode_ordinary("Hello world."))
    asked = tokens.count("Q: What now?\nA: Nothing.", enc)
    assert 0 < asked[1] < asked[0] and tokens.count("word " * 30_000, enc)[0] == pytest.approx(30_000, abs=3)
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in tokens.document_sizes(docs).collect()} == {1: 2, 2: 0}


DOCS = "doc_id long, text string, source string, rate int, copies int"


def _documents(spark):
    rng = random.Random(3)
    vocab = {"news": "market shares rose fell report", "code": "return def class import value", "mail": "dear regards hello please thanks"}
    rows = [(i, " ".join(rng.choice(vocab[s].split()) for _ in range(rng.randrange(20, 60))), s, 1, 1) for i, s in enumerate(rng.choice(["news"] * 6 + ["code"] * 2 + ["mail"]) for _ in range(900))]
    return rows + [(9001, None, "news", 1, 1), (9002, "", "code", 1, 1), (9003, "dear thanks hello", None, 1, 1), (9004, "x", "other", 1, 1), rows[0], (None, "y", "news", 1, 1)]


def test_shares_and_caps(spark):
    docs = spark.createDataFrame(_documents(spark), DOCS)
    goal = spark.createDataFrame([("news", 0.5, 1), ("code", 0.3, 2), ("mail", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed, report = m.mix(docs, goal)
    mixed = mixed.cache()
    assert mixed.count() == docs.where("doc_id is not null").select("doc_id").distinct().count()
    rep = {r["source"]: r for r in m.share_report(mixed, goal, report).collect()}
    assert report["residual"] < 0.01 and report["steps"] <= m.MOST_STEPS and all(r["residual"] is not None for r in rep.values())
    for s, t, k in (("news", 0.5, 1), ("code", 0.3, 2), ("mail", 0.2, 3)):
        assert abs(rep[s]["share"] - t) < 0.01 and rep[s]["most_copies"] <= k
    assert mixed.where("source = 'other'").first()["copies"] == 0
    assert m.mix(docs.limit(0), goal)[0].count() == 0
    with pytest.raises(ValueError):
        m.mix(docs, goal.limit(0))


def test_the_classifier_judges_only_rows_it_has_not_seen(spark):
    docs = spark.createDataFrame(_documents(spark), DOCS).where("text <> '' and source in ('news', 'code', 'mail') and doc_id is not null").distinct()
    dom = ["code", "mail", "news"]
    rows = m.read_once(docs).cache()
    out = m.scores(rows, m.fit_classifier(rows, dom)).collect()
    assert np.mean([dom[int(np.argmax(r["score"]))] == r["source"] for r in out]) > 0.95 and len(out) == docs.count()
    one = m.fit_classifier(rows.where("half = 0"), dom)
    assert np.ptp(one[1]) == 0  # nothing of the first half enters the second half's model
    heat, noise = m.fit_trust(m.scores(rows, m.fit_classifier(rows, dom)), dom)
    assert heat in m.HEATS and noise == min(m.NOISES)


def test_copies_keep_a_groups_tokens(spark):
    rng = random.Random(4)
    rows = [(i, "s", t, r, 1) for i, (t, r) in enumerate((rng.choice([5, 50, 500, 20_000]) + rng.randrange(5), rng.random() * 2) for _ in range(500))]
    got = m.whole_copies(spark.createDataFrame(rows, "doc_id long, source string, tokens long, rate double, extra int")).collect()
    assert len(got) == 500 and all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in got)
    assert abs(sum(r["tokens"] * (r["copies"] - r["rate"]) for r in got)) < 10


def test_rates_follow_the_projected_steps(spark):
    rng = np.random.default_rng(5)
    hist = rng.normal(size=(6, 3)) * 0.3
    mem = rng.dirichlet(np.ones(3), 20)
    df = spark.createDataFrame([(v.tolist(), 2.0) for v in mem], "member array<double>, cap double")
    got = [r["r"] for r in df.select(m.rate(hist.tolist(), F.col("member"), F.col("cap")).alias("r")).collect()]
    for v, g in zip(mem, got):
        r = 1.0
        for h in hist:
            r = min(max(r - v @ h, 0.0), 2.0)
        assert abs(r - g) < 1e-9
