"""Sources and sinks on small files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import curation
from tidemark.sources import readers, sinks
from tidemark.streaming import windows

REGISTRY = {
    "p": readers.Source("p", "parquet", "p/*.parquet", {"ticker": "symbol", "event_date": "date", "transcript": "content", "structured_content": "segments"}),
    "t": readers.Source("t", "text", "t/*/*.txt"),
    "j": readers.Source("j", "jsonl", "j/*.jsonl", {"ticker": "sym|ticker", "transcript": "text|transcript"}),
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    r = tmp_path_factory.mktemp("raw")
    spark.createDataFrame([("AB", "2024-01-05", "hello", [("Op", "hi")]), (None, None, None, None)], "symbol string, date string, content string, segments array<struct<speaker:string,text:string>>").coalesce(1).write.parquet(str(r / "p"))
    (r / "t/XY").mkdir(parents=True)
    (r / "t/XY/2024-02-03-q4.txt").write_text("line one\nline two")
    (r / "t/XY/.hidden.txt").write_text("no")
    (r / "j").mkdir()
    (r / "j/a.jsonl").write_text("\n".join([json.dumps({"sym": "", "ticker": "JJ", "transcript": "said"}), "", "{broken", json.dumps({"ticker": "QA", "questions": ["q1", "q2"], "answers": ["a1", "a2"]})]))
    return str(r)


def test_all_sources_in_one_schema(spark, root):
    got = {(r["source_id"], r["ticker"]): r for r in readers.read_sources(spark, root, REGISTRY).collect()}
    assert got["p", "AB"]["structured_content"][0]["text"] == "hi" and got["p", "AB"]["record_key"].endswith(":0") and got["p", None]["structured_content"] == []
    assert got["t", "XY"]["event_date"] == "2024-02-03" and got["t", "XY"]["transcript"] == "line one\nline two"
    assert got["j", "JJ"]["transcript"] == "said" and got["j", "QA"]["transcript"] == "q1\na1\nq2\na2" and len([k for k in got if k[0] == "j"]) == 2
    with pytest.raises(ValueError):
        readers.read_sources(spark, root, REGISTRY, ["kaggle"])


def test_inventory_skips_hidden_and_unknown(spark, root):
    inv = readers.inventory(spark, root, ["t", "j"])
    assert {(r["source_id"], r["file"]) for r in inv.collect()} == {("t", "2024-02-03-q4.txt"), ("j", "a.jsonl")}


def test_only_mapped_columns_are_read(spark, root):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = readers.read_parquet_source(spark, root, REGISTRY["p"]).select("ticker")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<symbol:string" in plan and "content" not in plan


def test_events_and_payloads(spark, tmp_path):
    (tmp_path / "e.csv").write_text("record_key,ticker,event_date,cik,note\nr1,ab,2024-01-01,12,x\nr1,ab,2024-01-01,12,y\nr2,,2024-01-01,,\n")
    e = readers.load_events(spark, str(tmp_path / "e.csv"))
    assert [tuple(r) for r in e.collect()] == [("r1", "AB", date(2024, 1, 1), "0000000012")]
    (tmp_path / "bad.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.load_events(spark, str(tmp_path / "bad.csv"))
    facts = {"cik": "1", "facts": {"g": {"Rev": {"units": {"USD": [{"start": "2024-01-01", "end": "2024-03-31", "val": 5, "filed": "2024-04-01", "form": "10-Q"}]}}}}}
    f = readers.parse_company_facts(spark.createDataFrame([(json.dumps(facts),), ("{",)], "value string")).collect()
    assert len(f) == 1 and (f[0]["concept"], f[0]["unit"], f[0]["fact_value"], str(f[0]["period_end"])) == ("Rev", "USD", 5.0, "2024-03-31")
    est = readers.parse_estimates(spark.createDataFrame([('[{"date":"2024-10-31","epsActual":1.1,"epsEstimated":1.0}]',)], "value string"), "T").first()
    assert (est["reported_eps"], est["estimated_eps"], str(est["source_event_date"])) == (1.1, 1.0, "2024-10-31")
    chart = {"chart": {"result": [{"meta": {"symbol": "t"}, "timestamp": [0, 86400], "indicators": {"quote": [{"close": [1.0, 2.0]}], "adjclose": [{"adjclose": [None, 9.0]}]}}]}}
    c = readers.parse_chart(spark.createDataFrame([(json.dumps(chart),)], "value string")).orderBy("trade_date").collect()
    assert [(r["ticker"], str(r["trade_date"]), r["close_price"]) for r in c] == [("T", "1970-01-01", 1.0), ("T", "1970-01-02", 9.0)]
    s = readers.parse_splits(spark.createDataFrame([("T", date(2024, 1, 1), "4", "2"), ("T", date(2024, 1, 2), "4", "0")], "ticker string, split_date date, numerator string, denominator string"))
    assert [r["factor"] for r in s.collect()] == [2.0]


def test_json_segments_in_any_wrapping(spark):
    seg = '[{"speaker":"A","text":"b"}]'
    df = spark.createDataFrame([(seg,), (json.dumps(seg),), ("nonsense",), (None,)], "s string")
    got = [len(r["x"]) for r in df.select(readers.parse_segments(F.col("s"), df.schema["s"].dataType).alias("x")).collect()]
    assert got == [1, 1, 0, 0]


def test_reports_and_samples(spark, tmp_path):
    (tmp_path / "r.md").write_text("# x\n| name | auroc |\n|---|---|\n| base | 0.5614 [0.4, 0.6] |\n")
    r = readers.read_report(spark, str(tmp_path / "r.md")).where("name = 'base'").first()
    assert (r["value"], r["lower"], r["upper"]) == (0.5614, 0.4, 0.6)
    p = readers.sample_prices(spark, ["A", "B"], date(2024, 1, 1), date(2024, 3, 1))
    assert p.count() == 90 and p.collect() == readers.sample_prices(spark, ["A", "B"], date(2024, 1, 1), date(2024, 3, 1)).collect()
    inside, without = readers.price_window(p, spark.createDataFrame([("A", date(2024, 2, 1)), ("Z", date(2024, 2, 2))], "ticker string, event_date date"), 5, 5)
    assert [x["ticker"] for x in without.collect()] == ["Z"] and inside.agg(F.min("trade_date")).first()[0] >= date(2024, 1, 27)
    assert spark.range(1).select(readers.optional(spark.range(1), "gone", "string", "unknown").alias("x")).first()["x"] == "unknown"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 0.5)], "k string, l array<string>, v double")
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["l"] == "x|y"
    assert json.loads(sinks.json_summary(df.select("v"))) == {"v": 0.5} and "| 0.5000 |" in sinks.markdown_table(df.select("k", "v")) and sinks.interval(0.5, None, 1.0) == "0.5000 [nan, 1.0000]"
    rec = spark.createDataFrame([("r", "s", "f", 1, "T", "2024-01-01", "t", [("a", "b")])], "record_key string, source_id string, source_file string, source_row long, ticker string, event_date string, transcript string, structured_content array<struct<speaker:string,text:string>>")
    dec = spark.createDataFrame([("r", True, 7)], "record_key string, keep_gold boolean, quality_score long")
    assert sinks.write_curated(rec, dec, "keep_gold", str(tmp_path / "g")) and not sinks.write_curated(rec, dec.where("false"), "keep_gold", str(tmp_path / "n"))
    g = spark.read.parquet(str(tmp_path / "g")).first()
    assert g["quality_score"] == 7 and json.loads(g["structured_content"]) == [{"speaker": "a", "text": "b"}]
    arts = {a: df for a in sinks.FOLD_ARTIFACTS}
    with pytest.raises(ValueError):
        sinks.write_fold({"train_calls": df}, str(tmp_path / "folds"), 0)
    for a, d in list(arts.items())[:-1]:
        d.write.parquet(str(tmp_path / "folds" / "fold=0" / a))
    assert not sinks.fold_complete(spark, str(tmp_path / "folds"), 0)
    sinks.write_fold(arts, str(tmp_path / "folds"), 0)
    assert sinks.fold_complete(spark, str(tmp_path / "folds"), 0)


def test_streamed_windows_equal_the_table(spark, data, tmp_path):
    ev = spark.read.parquet(f"{data}/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    q = windows.windowed_totals(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), lateness="1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r)[:3] for r in spark.sql("select * from w").collect()} == {tuple(r)[:3] for r in windows.windowed_totals(ev).collect()}


def test_stage_counts(spark):
    df = spark.createDataFrame([("", True, True), ("x", False, False)], "drop_reason string, keep_clean_master boolean, keep_gold boolean")
    assert dict((r[0], r[1]) for r in curation.stage_counts(df).collect()) == {"raw_records": 2, "after_dedup": 1, "clean_master": 1, "gold": 1}
