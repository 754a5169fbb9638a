"""The operators' inputs out of the tables at hand, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_ticker, normalize_text, parse_day
from tidemark.operators import calendar, fundamentals, parsing
from tidemark.session import read_table

# ---- SQL pieces ----------------------------------------------------------------

_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"


def ticker_sql(x: str) -> str:
    return (
        "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(" + x + r")), '^\$+\s*', ''), '^[A-Z]{2,10}\s*:\s*', ''), "
        r"'[\s.](US|UN|UW|UQ|LN|GR|FP|JP)(\s+EQUITY)?$', ''), '[\s/_\-.]+', '.', 'g'), '^\.+|\.+$', '', 'g'), '')"
    )


def day_sql(x: str) -> str:
    shapes = ((r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"), (r"^\d{8}$", "%Y%m%d"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "%b %d, %Y"))
    t = rf"regexp_replace(trim({x}), '^(\d{{4}}-\d{{2}}-\d{{2}})[T ].*$', '\1')"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({t}, '{s}') THEN try_strptime({t}, '{f}')::DATE END" for s, f in shapes) + ")"


CALLS = f"calls AS (SELECT call_id, {ticker_sql('s[2]')} AS ticker, s[3] AS event_date, s[4] AS car, s[5] AS label FROM (SELECT call_id, max(row(updated_at, ticker, event_date, car_horizon, label)) AS s FROM call_features WHERE call_id IS NOT NULL GROUP BY call_id))"
PAIRS = "pairs AS (SELECT x.* FROM (SELECT arg_max(q, parsed_at) AS x FROM qa_pairs q WHERE pair_id IS NOT NULL GROUP BY pair_id))"
RECORDS = "records AS (SELECT x.* FROM (SELECT arg_max(t, ingested_at) AS x FROM transcript_record t WHERE record_key IS NOT NULL GROUP BY record_key))"
GRID = f"""s0 AS (SELECT {ticker_sql('ticker')} AS ticker, trade_date, max(CASE WHEN isnan(stock_return) THEN NULL ELSE stock_return END) AS r FROM daily_returns GROUP BY 1, 2),
m0 AS (SELECT trade_date, max(market_return) AS m FROM market_days GROUP BY 1),
grid AS (SELECT ticker, trade_date, r, m FROM s0 JOIN m0 USING (trade_date) WHERE ticker IS NOT NULL)"""
CLOSES = f"closes AS (SELECT {ticker_sql('ticker')} AS ticker, trade_date, arg_max(close_price, row(loaded_at, close_price)) AS close FROM daily_returns WHERE close_price IS NOT NULL GROUP BY 1, 2)"
FACTS = f"facts AS (SELECT DISTINCT {ticker_sql('ticker')} AS ticker, concept, unit, fact_value, period_start, period_end, filed_date FROM xbrl_facts)"
REPORTS = f"reports AS (SELECT source_event_id, x.* FROM (SELECT source_event_id, arg_max(struct_pack(ticker := {ticker_sql('ticker')}, event_date := source_event_date, reported_eps, estimated_eps, reported_revenue, estimated_revenue, provider), ingested_at) AS x FROM external_events WHERE source_event_id IS NOT NULL GROUP BY source_event_id))"
SCORED = f"""{PAIRS},
scored AS (SELECT pair_id, call_id, pair_index, round((length(coalesce(answer_text, '')) - length(coalesce(question_text, ''))) / (length(coalesce(answer_text, '')) + length(coalesce(question_text, '')) + 1.0), 4) AS score FROM pairs)"""
PREDICTIONS = f"""{SCORED}, {CALLS},
pred AS (SELECT c.call_id, c.label::INT AS y, c.car, round(avg(score), 9) AS score, least(greatest(floor((0.5 + avg(score) / 2) * 1000 + 1e-6), 0), 1000) / 1000 AS prob FROM scored JOIN calls c USING (call_id) WHERE c.label IS NOT NULL AND c.car IS NOT NULL GROUP BY ALL)"""
STRUCTURED = rf"""{RECORDS},
seg AS (SELECT record_key AS call_id, {norm_sql('s.speaker')} AS speaker, {norm_sql('s.text')} AS text, i FROM (SELECT record_key, unnest(structured_content) AS s, generate_subscripts(structured_content, 1) AS i FROM records)),
st AS (SELECT call_id, speaker, text, row_number() OVER (PARTITION BY call_id ORDER BY i) - 1 AS idx FROM seg WHERE text <> ''),
cue AS (SELECT *, concat_ws(' ', speaker, text) AS b, count(*) OVER (PARTITION BY call_id) AS n FROM st),
start AS (SELECT call_id, coalesce(least(min(idx) FILTER (WHERE regexp_matches(b, '{parsing.ACTUAL_CUE.replace("'", "''")}')) + 1, max(n) - 1), least(max(idx) FILTER (WHERE regexp_matches(b, '{parsing.STRONG_CUE}')) + 1, max(n) - 1)) AS start FROM cue GROUP BY call_id),
tr AS (SELECT *, lower(speaker) AS k, max((idx < start)::INT) OVER (PARTITION BY call_id, lower(speaker)) AS before FROM st JOIN start USING (call_id)),
turns AS (SELECT call_id, idx, speaker, CASE WHEN k = 'operator' THEN 'operator' WHEN before = 1 THEN 'management' ELSE 'analyst' END AS speaker_role, 'q&a' AS section, text FROM tr WHERE idx >= start)"""

# ---- data frames ----------------------------------------------------------------


def latest(df: DataFrame, key: str, at: str, columns: list[str] | None = None) -> DataFrame:
    """The last delivery of each key; null keys are left out, rows of one time are taken as equal."""
    keep = [c for c in (columns or df.columns) if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.coalesce(F.col(at), F.timestamp_seconds(F.lit(0)))).alias("__x")).select(key, *[F.col(f"__x.{c}").alias(c) for c in keep])


def calls(spark, d) -> DataFrame:
    """One row per call: its latest update whole (of updates of one time the greatest)."""
    c = read_table(spark, d, "call_features").where("call_id is not null").groupBy("call_id").agg(F.max(F.struct("updated_at", "ticker", "event_date", "car_horizon", "label")).alias("x"))
    return c.select("call_id", canonical_ticker(F.col("x.ticker")).alias("ticker"), "x.event_date", F.col("x.car_horizon").alias("car"), "x.label")


def pairs(spark, d) -> DataFrame:
    return latest(read_table(spark, d, "qa_pairs"), "pair_id", "parsed_at")


def records(spark, d) -> DataFrame:
    return latest(read_table(spark, d, "transcript_record"), "record_key", "ingested_at")


def grid(spark, d) -> DataFrame:
    s = read_table(spark, d, "daily_returns").select(canonical_ticker(F.col("ticker")).alias("ticker"), "trade_date", F.col("stock_return").alias("r"))
    return calendar.trading_grid(s, read_table(spark, d, "market_days").select("trade_date", F.col("market_return").alias("m")))


def closes(spark, d) -> DataFrame:
    return read_table(spark, d, "daily_returns").select(canonical_ticker(F.col("ticker")).alias("ticker"), "trade_date", "close_price", "loaded_at")


def facts(spark, d) -> DataFrame:
    return read_table(spark, d, "xbrl_facts").select(canonical_ticker(F.col("ticker")).alias("ticker"), "concept", "unit", "fact_value", "period_start", "period_end", "filed_date").distinct()


def reports(spark, d) -> DataFrame:
    r = latest(read_table(spark, d, "external_events"), "source_event_id", "ingested_at", ["source_event_id", "ticker", "source_event_date", "reported_eps", "estimated_eps", "reported_revenue", "estimated_revenue", "provider"])
    return r.withColumn("ticker", canonical_ticker(F.col("ticker"))).withColumnRenamed("source_event_date", "event_date")


def scored(spark, d) -> DataFrame:
    a, q = F.length(F.coalesce("answer_text", F.lit(""))), F.length(F.coalesce("question_text", F.lit("")))
    return pairs(spark, d).select("pair_id", "call_id", "pair_index", F.round((a - q) / (a + q + 1.0), 4).alias("score"))


def predictions(spark, d) -> DataFrame:
    c = calls(spark, d).where("label is not null and car is not null")
    p = scored(spark, d).join(c, "call_id").groupBy("call_id", F.col("label").cast("int").alias("y"), "car").agg(F.avg("score").alias("__s"))
    return p.select("call_id", "y", "car", F.round("__s", 9).alias("score"), (F.least(F.greatest(F.floor((0.5 + F.col("__s") / 2) * 1000 + 1e-6), F.lit(0)), F.lit(1000)) / 1000).alias("prob"))


def structured_turns(spark, d) -> DataFrame:
    return parsing.parse_structured(records(spark, d), "record_key", "structured_content").withColumnRenamed("record_key", "call_id")


def turns(spark, d) -> DataFrame:
    r = records(spark, d).select(F.col("record_key").alias("call_id"), canonical_ticker(F.col("ticker")).alias("ticker"), parse_day(F.col("event_date")).alias("event_date"))
    return structured_turns(spark, d).join(r, "call_id").withColumnRenamed("idx", "turn_id")


def tokens(spark, d) -> DataFrame:
    """(pair_id, tokens, scores): all words of every answer that has any, scored by their length and place."""
    t = F.filter(F.split(F.lower(normalize_text(F.col("answer_text"))), " "), lambda x: x != "")
    p = pairs(spark, d).select("pair_id", t.alias("tokens")).where(F.size("tokens") > 0)
    return p.withColumn("scores", F.transform("tokens", lambda x, i: (F.length(x) % 7 + (i % 3) * 0.25).cast("double")))


def capex_events(spark, d) -> DataFrame:
    return reports(spark, d).where("event_date is not null and ticker is not null").select(F.col("source_event_id").cast("string").alias("call_id"), "ticker", "event_date", F.col("reported_eps").alias("reported_capex"), "reported_revenue", "estimated_revenue")


quarterly_facts = fundamentals.quarterly
