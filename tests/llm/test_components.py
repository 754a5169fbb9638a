"""Components, splits and quarantine; survivors of duplicate groups."""

import random

from pyspark.sql import functions as F

from tidemark.llm import components as c
from tidemark.llm import survivor as s


def brute(edges):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {a: find(a) for a, b in edges for a in (a, b) if a and b and any(p != q and a in (p, q) for p, q in edges if p and q)}


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    edges = chain + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)] + [("hub", f"h{i}") for i in range(50)] + [(None, "x"), ("y", "y"), ("hub", "h1")]
    got = {r["node"]: r["root"] for r in c.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)
    assert c.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_star_edges_are_as_many_as_members(spark):
    m = spark.createDataFrame([("k", str(i)) for i in range(300)] * 2 + [(None, "a"), ("one", "b")], "k string, m string")
    e = c.star_edges(m, "k", "m")
    assert e.count() == 299 and e.select("b").distinct().first()["b"] == "0"


UNI, CALL, PAIR = "ticker string, cik string, former_ticker string", "call_id string, ticker string, event_date date", "pair_id string, call_id string, ticker string, event_date date"


def _tables(spark):
    u = spark.createDataFrame([("A", "CIK00012", None), ("B", "12.0", None), ("C", "0", "D"), ("D", "000", None), ("E", None, None), ("F", "0000000000", None), ("A", "12", None)], UNI)
    q = spark.createDataFrame([("p1", "c1", "$b", None), ("p2", "c1", "NQX:C", None), ("p3", "c2", None, None), ("p4", "c9", "E", None), ("p5", "c9", "ZZ", None)], PAIR)
    return u, spark.createDataFrame([("c1", "A", None), ("c2", "F", None)], CALL), q


def test_linked_tickers(spark):
    u, calls, q = _tables(spark)
    table = c.connected_components(c.ticker_links(u, calls, q)).withColumnRenamed("root", "component")
    got = sorted(tuple(r) for r in c.linked_tickers(table, u).collect())
    assert got == [(a, b) for i, a in enumerate("ABCD") for b in "ABCD"[i + 1 :]]


def test_look_up_with_hot_keys(spark):
    d = spark.createDataFrame([("hot", i) for i in range(300)] + [("b", 1), ("miss", 2), (None, 3)] + [("lost", i) for i in range(40)], "k string, v int")
    t = spark.createDataFrame([("hot", 1), ("b", 2), ("unused", 3)], "on string, x int")
    want = {("hot", 1): 300, ("b", 2): 1, ("miss", None): 1, (None, None): 1, ("lost", None): 40}
    for hot_rows in (1000, 20):
        got = c.look_up(d, "k", t, "on", hot_rows=hot_rows)
        assert got.columns == ["k", "v", "x"] and {(r["k"], r["x"]): r["count"] for r in got.groupBy("k", "x").count().collect()} == want
        assert c.look_up(d, "k", t, "on", "inner", hot_rows=hot_rows).count() == 301


def test_a_later_run_opens_the_stored_table(spark, tmp_path):
    path, none = f"file://{tmp_path}/components", spark.createDataFrame([], "a string, b string")
    w = lambda **k: spark.createDataFrame(list(k.items()) or [("x", 1)], "node string, weight long")
    assert c.ComponentStore(spark, path).table() is None
    links = lambda *e: spark.createDataFrame(list(e), "a string, b string")
    one = {r["node"]: r for r in c.ComponentStore(spark, path).extend(w(A=5, B=5, C=5), links(("A", "call:1"), ("B", "call:2"), ("C", "call:3")), _targets(spark)).collect()}
    two = {r["node"]: r for r in c.ComponentStore(spark, path).extend(w(A=2, D=3), links(("D", "call:1"), ("D", "cik:9")), _targets(spark)).collect()}
    assert c.ComponentStore(spark, path).versions() == 2 and two["D"]["component"] == two["A"]["component"] == two["cik:9"]["component"]
    assert two["D"]["split"] == two["A"]["split"] == one["A"]["split"] and two["A"]["weight"] == 7 and two["A"]["state"] == "kept" and two["B"]["split"] == one["B"]["split"]
    same = {r["node"]: r["component"] for r in c.ComponentStore(spark, path).extend(w(A=0), none, _targets(spark)).collect()}
    assert same == {k: r["component"] for k, r in two.items()}
    (tmp_path / "components" / "v000003" / "_SUCCESS").unlink()  # a run cut short leaves the version before
    assert c.ComponentStore(spark, path).versions() == 2


TARGETS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


def _targets(spark):
    return spark.createDataFrame(TARGETS, "split_name string, target_share double")


def test_shares_are_met_and_components_stay_whole(spark):
    rng = random.Random(3)
    w = spark.createDataFrame([(f"n{i:04d}", rng.randrange(1, 20)) for i in range(4000)], "node string, weight long")
    links = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(0, 4000, 3)], "a string, b string")
    t = c.fill_deficits(c.component_table(w, links), _targets(spark)).cache()
    assert t.groupBy("component").agg(F.count_distinct("split").alias("k")).where("k <> 1").count() == 0 and t.count() == 4001
    total = t.agg(F.sum("weight")).first()[0]
    for r in t.groupBy("split").agg(F.sum("weight").alias("w")).collect():
        assert abs(r["w"] / total - dict(TARGETS)[r["split"]]) < 0.01


def test_a_third_in_one_component(spark):
    w = spark.createDataFrame([("hot", 500)] + [(f"n{i}", 1) for i in range(1000)], "node string, weight long")
    t = c.fill_deficits(c.component_table(w, spark.createDataFrame([], "a string, b string")), _targets(spark))
    got = {r["split"]: r["w"] for r in t.groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    assert all(abs(got[k] / 1500 - v) < 0.01 for k, v in TARGETS)


def test_known_components_keep_their_split_and_conflicts_are_quarantined(spark):
    known = spark.createDataFrame([("a", "a", 5, "train", "new"), ("b", "a", 5, "train", "new"), ("x", "x", 5, "val", "new"), ("z", "z", 5, "test", "new")], "node string, component string, weight long, split string, state string")
    w = spark.createDataFrame([(n, 5) for n in ("a", "c", "x", "d", "e", "z")] + [(None, 3)], "node string, weight long")
    links = spark.createDataFrame([("c", "b"), ("d", "x"), ("d", "z")], "a string, b string")
    t = {r["node"]: (r["split"], r["state"]) for r in c.fill_deficits(c.component_table(w, links, known), _targets(spark)).collect()}
    assert t["a"] == t["b"] == t["c"] == ("train", "kept") and t["x"] == t["d"] == t["z"] == (c.QUARANTINE, c.QUARANTINE) and t["e"][1] == "new" and t["e"][0] in dict(TARGETS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "node string, weight long")
    assert c.fill_deficits(c.component_table(none, spark.createDataFrame([], "a string, b string")), _targets(spark)).count() == 0


REC = "record_key string, ingested_at timestamp, quality_score long, transcript_chars long, ticker string, event_date string, company string, call_year int, call_quarter int, source_priority int, transcript string, structured_content array<struct<speaker:string,text:string>>, turns int, wording int"


def _rec(k, q=None, n=None, tk=None, day=None, company=None, text="Operator: A.", at=None):
    return (k, at, q, n, tk, day, company, None, None, 1, text, None, 7, 7)


def _groups(spark, rows):
    return s.call_groups(s.latest_records(spark.createDataFrame(rows, REC)))


def test_survivors(spark):
    rows = [
        _rec("a", 5, 10, "T", "2024-01-01", text="Operator: One."), _rec("b", 5, 12, "$t", "01/01/2024", text="Operator: Two."), _rec("c", None, 99, text="Ann Lee: um, Two."),  # ticker and day, then wording
        _rec("d", None, None, "U", "n/a", text="Operator: Four."), _rec("e", None, None, "U", None, text="Operator: Five."),  # no day, no link
        _rec("g", 1, 1, text="Operator: Same."), _rec("f", 1, 1, text="Bo Cee: Same."), _rec("f", 1, 1, text="Bo Cee: Same."),  # a full tie
        _rec("h", text=None), _rec("i", text=""), _rec(None, 9, 9, "T", "2024-01-01"),  # nothing said is no common wording
    ]
    got = {r["record_key"]: r["copies"] for r in s.survivors(_groups(spark, rows)).collect()}
    assert got == {"b": 3, "f": 2}


def test_the_latest_delivery_counts(spark):
    import datetime as dt

    rows = [_rec("a", 9, 1, "T", "2024-01-01", at=dt.datetime(2024, 1, 1)), _rec("a", 1, 1, "T", "2024-01-01", at=dt.datetime(2024, 2, 1)), _rec("b", 5, 1, "T", "2024-01-01", at=dt.datetime(2024, 1, 1))]
    assert [r["record_key"] for r in s.survivors(_groups(spark, rows)).collect()] == ["b"]


def test_best_known_fields(spark):
    rows = [_rec("a", 9, 5, "T", "2024-01-01", None, text=None), _rec("b", 5, 9, "T", "2024-01-01", "Firm", text="Operator: One.\nAnn Lee: Two."), _rec("c", 7, 9, "T", "2024-01-01", "Other", text="Operator: One.")]
    g = s.golden_fields(_groups(spark, rows)).first()
    assert (g["record_key"], g["company"], g["transcript_key"], g["copies"]) == ("a", "Other", "b", 3)


def test_a_hot_group_gives_one_survivor(spark):
    rows = [_rec(f"k{i:04d}", i % 7, 3, "T", "2024-01-01") for i in range(700)]
    assert [tuple(r) for r in s.survivors(_groups(spark, rows)).select("record_key", "copies").collect()] == [("k0006", 700)]
    assert s.survivors(_groups(spark, [])).count() == 0
