"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import asknown, asof, attribution, calendar, curation, fundamentals, latent, linear, metrics, pairing, parsing, pooling, splits, trailing, universe
from tidemark.plans import bindings as b
from tidemark.plans import pipelines
from tidemark.plans.bindings import CALLS, CLOSES, FACTS, GRID, PAIRS, PREDICTIONS, RECORDS, REPORTS, SCORED, STRUCTURED, day_sql, norm_sql, ticker_sql
from tidemark.session import materialise, read_table
from tidemark.streaming import windows

_Q: dict[str, Callable] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _S[f.__name__] = sql
        return f

    return add


def big(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def rnd(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- attributes as known, rolling totals ------------------------------------------

_KNOWN = f"""
WITH c AS (SELECT call_id, max(row(updated_at, ticker, event_date, hist_market_cap_shares_staleness_days, hist_market_cap_price_lag_days)) AS s FROM call_features WHERE call_id IS NOT NULL GROUP BY call_id),
cc AS (SELECT call_id, {ticker_sql('s[2]')} AS ticker, s[3] AS event_date, nullif(s[4]::DOUBLE, 'NaN'::DOUBLE) AS rs, nullif(s[5]::DOUBLE, 'NaN'::DOUBLE) AS rl FROM c),
f AS (SELECT {ticker_sql('ticker')} AS ticker, period_end, filed_date FROM xbrl_facts WHERE concept = 'CommonSharesOutstanding' AND period_end IS NOT NULL AND filed_date IS NOT NULL),
r AS (SELECT DISTINCT {ticker_sql('ticker')} AS ticker, trade_date FROM daily_returns WHERE close_price IS NOT NULL AND NOT isnan(close_price) AND trade_date IS NOT NULL),
s AS (SELECT call_id, max(period_end) AS pe FROM cc JOIN f ON f.ticker = cc.ticker AND f.period_end <= cc.event_date AND f.filed_date <= cc.event_date GROUP BY call_id),
p AS (SELECT call_id, max(trade_date) AS td FROM cc JOIN r ON r.ticker = cc.ticker AND r.trade_date < cc.event_date GROUP BY call_id),
k AS (SELECT cc.*, date_diff('day', pe, event_date) AS shares_staleness, date_diff('day', td, event_date) AS price_lag FROM cc LEFT JOIN s USING (call_id) LEFT JOIN p USING (call_id))"""

_TRAIL = f"""
WITH cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS n, max(market_return) AS m FROM market_days GROUP BY trade_date),
r AS (SELECT {ticker_sql('ticker')} AS tk, trade_date, stock_return, loaded_at FROM daily_returns),
sp AS (SELECT tk, min(trade_date) AS a, max(trade_date) AS z FROM r WHERE tk IS NOT NULL GROUP BY tk),
g0 AS (SELECT tk, cal.trade_date, n, m, row_number() OVER (PARTITION BY tk ORDER BY n) AS pos FROM sp JOIN cal ON cal.trade_date BETWEEN a AND z),
leaf AS (SELECT tk, trade_date, max(row(loaded_at, stock_return)) AS b FROM r WHERE stock_return > -1 AND NOT isnan(stock_return) AND NOT isinf(stock_return) GROUP BY tk, trade_date),
g AS (SELECT g0.*, b[2] AS x FROM g0 LEFT JOIN leaf USING (tk, trade_date)),
w AS (SELECT tk, trade_date, 20 AS d, least(pos, 20) AS days, count(x) OVER v AS u, coalesce(sum(x) OVER v, 0) AS t, avg(x) OVER v AS av, stddev_pop(x) OVER v AS sd, CASE WHEN count(x) OVER v >= 5 THEN regr_slope(x, m) OVER v END AS be FROM g WINDOW v AS (PARTITION BY tk ORDER BY n ROWS 19 PRECEDING)
  UNION ALL SELECT tk, trade_date, 60, least(pos, 60), count(x) OVER v, coalesce(sum(x) OVER v, 0), avg(x) OVER v, stddev_pop(x) OVER v, CASE WHEN count(x) OVER v >= 5 THEN regr_slope(x, m) OVER v END FROM g WINDOW v AS (PARTITION BY tk ORDER BY n ROWS 59 PRECEDING))"""

query(_KNOWN + " SELECT call_id, 'shares_staleness' AS field_name FROM k WHERE rs IS NOT NULL AND shares_staleness IS DISTINCT FROM rs UNION ALL SELECT call_id, 'price_lag' FROM k WHERE rl IS NOT NULL AND price_lag IS DISTINCT FROM rl")(asknown.p1_found)
query(_KNOWN + " SELECT call_id, ticker, event_date, shares_staleness, price_lag FROM k")(asknown.p1_asof)
query(_TRAIL + " SELECT tk AS ticker, strftime(trade_date, '%Y-%m-%d') AS trade_date FROM w WHERE d = 20 AND days = 20 AND u < 12")(trailing.p4_found)
query(_TRAIL + " SELECT tk AS ticker, trade_date, d::BIGINT AS days_back, days::BIGINT AS days, u::BIGINT AS usable, round(t, 8) AS total, round(av, 12) AS average, round(sd, 8) AS volatility, round(be, 4) AS beta FROM w")(trailing.p4_totals)
query(_TRAIL + " SELECT tk AS ticker, trade_date, d::BIGINT AS days_back, u::BIGINT AS usable, round(t, 6) AS total FROM w")(trailing.p4_late_corrections)
query(_TRAIL.split("w AS (SELECT")[0] + "w AS (SELECT tk, trade_date, count(x) OVER v AS u, coalesce(sum(x) OVER v, 0) AS t FROM g WINDOW v AS (PARTITION BY tk ORDER BY n ROWS 249 PRECEDING)) SELECT tk AS ticker, trade_date, u::BIGINT AS usable, round(t, 6) AS total FROM w")(trailing.p4_long_windows)

# ---- event study -------------------------------------------------------------------

_ROWS = "PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN"


def _win(name: str, frame: str) -> str:
    return f"{name} AS ({_ROWS} {frame})"


_WINDOWS = f"""WITH {GRID}, {CALLS},
w AS (SELECT ticker, trade_date, count(*) OVER ah AS window_rows, coalesce(sum(r - m) OVER ah, 0) AS car,
  {', '.join(f"CASE WHEN count(*) OVER b{n} > 0 THEN coalesce(sum(r) OVER b{n}, 0) END AS momentum_{n}, CASE WHEN count(*) OVER b{n} > 0 THEN coalesce(sum(m) OVER b{n}, 0) END AS market_momentum_{n}" for n in (5, 20, 60))},
  stddev_pop(r) OVER b20 AS volatility_20, stddev_pop(r) OVER b60 AS volatility_60, stddev_pop(m) OVER b20 AS market_volatility_20,
  CASE WHEN count(r) OVER b60 >= 5 THEN regr_slope(r, m) OVER b60 END AS beta_60,
  product(1 + coalesce(r, 0)) OVER p5 - 1 AS pre_5, product(1 + coalesce(r, 0)) OVER a3 - 1 AS post_3
  FROM grid WINDOW {_win('ah', 'CURRENT ROW AND 19 FOLLOWING')}, {_win('b5', '5 PRECEDING AND 1 PRECEDING')}, {_win('b20', '20 PRECEDING AND 1 PRECEDING')}, {_win('b60', '60 PRECEDING AND 1 PRECEDING')}, {_win('p5', '6 PRECEDING AND 2 PRECEDING')}, {_win('a3', 'CURRENT ROW AND 2 FOLLOWING')}),
e AS (SELECT c.call_id, c.ticker, c.event_date, w.* EXCLUDE (ticker) FROM calls c ASOF LEFT JOIN w ON c.ticker = w.ticker AND c.event_date + 1 <= w.trade_date)"""


def _study(spark, d):
    return calendar.event_study(b.calls(spark, d).select("call_id", "ticker", "event_date"), b.grid(spark, d))


@query(_WINDOWS + " SELECT call_id, ticker, event_date, trade_date AS i0, round(coalesce(car, 0), 8) AS car_horizon, (coalesce(car, 0) > 0)::INT AS label, trade_date IS NOT NULL AS has_window, window_rows FROM e")
def event_car(spark, d):
    return rnd(_study(spark, d), 8, "car_horizon").select("call_id", "ticker", "event_date", "i0", "car_horizon", "label", "has_window", "window_rows")


@query(_WINDOWS + " SELECT call_id, " + ", ".join(f"round(momentum_{n}, 8) AS momentum_{n}, round(market_momentum_{n}, 8) AS market_momentum_{n}" for n in (5, 20, 60)) + ", round(volatility_20, 8) AS volatility_20, round(volatility_60, 8) AS volatility_60, round(market_volatility_20, 8) AS market_volatility_20, round(momentum_20 - market_momentum_20, 8) AS relative_momentum_20 FROM e")
def momentum_vol(spark, d):
    cols = [f"{p}momentum_{n}" for n in (5, 20, 60) for p in ("", "market_")] + ["volatility_20", "volatility_60", "market_volatility_20", "relative_momentum_20"]
    return rnd(_study(spark, d), 8, *cols).select("call_id", *cols)


@query(_WINDOWS + " SELECT call_id, round(beta_60, 5) AS beta_60 FROM e")
def prior_beta(spark, d):
    return rnd(_study(spark, d), 5, "beta_60").select("call_id", "beta_60")


@query(_WINDOWS + " SELECT call_id, round(pre_5, 8) AS pre_event_return_5d, round(post_3, 8) AS post_event_return_3d FROM e")
def compound_returns(spark, d):
    return _study(spark, d).select("call_id", F.round("pre_5", 8).alias("pre_event_return_5d"), F.round("post_3", 8).alias("post_event_return_3d"))


@query(f"WITH {CLOSES}, x AS (SELECT ticker, trade_date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY trade_date), 0) - 1 AS r FROM closes WHERE ticker IS NOT NULL) SELECT ticker, trade_date, round(r, 8) AS return FROM x WHERE r IS NOT NULL")
def price_returns(spark, d):
    return rnd(calendar.returns_from_closes(b.closes(spark, d)), 8, "return")


@query(f"WITH {CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date, call_id) - 1 AS k, lag(event_date) OVER (PARTITION BY ticker ORDER BY event_date, call_id) AS p, first_value(event_date) OVER (PARTITION BY ticker ORDER BY event_date, call_id) AS f FROM calls WHERE ticker IS NOT NULL AND event_date IS NOT NULL) SELECT call_id, ticker, event_date, k::BIGINT AS prior_call_count, date_diff('day', p, event_date)::BIGINT AS days_since_prev_call, (SELECT count(*) FROM n m WHERE m.ticker = n.ticker AND m.event_date >= n.event_date - 365 AND (m.event_date, m.call_id) < (n.event_date, n.call_id))::BIGINT AS prior_call_count_365d, CASE WHEN k >= 2 THEN round(date_diff('day', f, p) / (k - 1), 6) END AS mean_prior_call_gap_days FROM n")
def ticker_frequency(spark, d):
    return rnd(big(calendar.call_frequency(b.calls(spark, d)), "prior_call_count", "days_since_prev_call", "prior_call_count_365d"), 6, "mean_prior_call_gap_days")


# ---- as-of and facts -----------------------------------------------------------------


@query(f"WITH {CALLS}, {CLOSES} SELECT call_id, c.ticker, event_date, trade_date AS close_date, close FROM calls c ASOF LEFT JOIN closes p ON c.ticker = p.ticker AND c.event_date > p.trade_date")
def strict_prev_close(spark, d):
    p = b.closes(spark, d).where("close_price is not null").groupBy("ticker", "trade_date").agg(F.max(F.struct("loaded_at", "close_price"))["close_price"].alias("close"))
    out = asof.asof(b.calls(spark, d).select("call_id", "ticker", "event_date"), p, key="ticker", event_at="event_date", row_at="trade_date", payload=["close"], into="p", strict=True)
    return out.select("call_id", "ticker", "event_date", F.col("p.trade_date").alias("close_date"), F.col("p.close").alias("close"))


@query(f"WITH {CALLS}, {FACTS}, j AS (SELECT call_id, max(row(period_end, filed_date, fact_value)) AS x FROM calls c JOIN facts f ON c.ticker = f.ticker WHERE concept = 'CommonSharesOutstanding' AND fact_value BETWEEN 1e6 AND 1e11 AND period_end <= event_date AND filed_date <= event_date AND date_diff('day', period_end, event_date) <= 730 GROUP BY call_id) SELECT call_id, ticker, event_date, x[3] AS shares, date_diff('day', x[1], event_date)::BIGINT AS shares_staleness_days FROM calls LEFT JOIN j USING (call_id)")
def shares_asof(spark, d):
    f = b.facts(spark, d).where("concept = 'CommonSharesOutstanding'")
    return big(fundamentals.shares_asof(b.calls(spark, d).select("call_id", "ticker", "event_date"), f), "shares_staleness_days")


_QUARTER = f"""WITH {CALLS}, {FACTS}, f AS (SELECT *, date_diff('day', period_start, period_end) AS pd FROM facts WHERE fact_value IS NOT NULL AND period_end IS NOT NULL),
cu AS (SELECT *, max(row(period_end, fact_value)) OVER (PARTITION BY ticker, concept, unit, period_start ORDER BY period_end RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS p FROM f WHERE pd > 140 AND period_start IS NOT NULL),
q AS (SELECT ticker, concept, unit, fact_value, period_start, period_end, filed_date, pd, 0 AS derived FROM f WHERE pd BETWEEN 1 AND 140 OR period_start IS NULL
  UNION ALL SELECT ticker, concept, unit, fact_value - p[2], p[1] + 1, period_end, filed_date, date_diff('day', p[1], period_end), 1 FROM cu WHERE date_diff('day', p[1], period_end) BETWEEN 1 AND 140)"""


@query(_QUARTER + " SELECT ticker, concept, unit, round(fact_value, 2) AS fact_value, period_start, period_end, filed_date, pd::BIGINT AS period_days, derived FROM q")
def cumulative_to_quarter(spark, d):
    return rnd(big(fundamentals.quarterly(b.facts(spark, d)), "period_days"), 2, "fact_value")


def _fact_sql(strict: str) -> str:
    return _QUARTER + f", j AS (SELECT call_id, fact_value, period_end, date_diff('day', period_end, event_date) AS lag, date_diff('day', filed_date, event_date) AS fl, q.derived, row_number() OVER (PARTITION BY call_id ORDER BY date_diff('day', period_end, event_date), q.derived, date_diff('day', filed_date, event_date) NULLS LAST, filed_date DESC NULLS LAST, fact_value, period_end) AS rn FROM calls c JOIN q ON c.ticker = q.ticker WHERE concept = 'CapitalExpenditures' AND date_diff('day', period_end, event_date) BETWEEN 0 AND 120 {strict}) SELECT c.call_id, c.ticker, c.event_date, round(fact_value, 2) AS fact_value, period_end, lag::BIGINT AS period_end_lag_days, fl::BIGINT AS filed_lag_days, derived FROM calls c LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (call_id)"


def _fact(spark, d, strict):
    q = fundamentals.quarterly(b.facts(spark, d)).where("concept = 'CapitalExpenditures'")
    got = fundamentals.statement_asof(b.calls(spark, d).select("call_id", "ticker", "event_date"), q, strict_pit=strict)
    return rnd(big(got, "period_end_lag_days", "filed_lag_days"), 2, "fact_value").withColumn("filed_lag_days", F.when(F.col("filed_lag_days") != 2147483647, F.col("filed_lag_days")))


@query(_fact_sql(""))
def fact_asof(spark, d):
    return _fact(spark, d, False)


@query(_fact_sql("AND filed_date <= event_date"))
def fact_asof_strict(spark, d):
    return _fact(spark, d, True)


@query(f"WITH {FACTS}, s AS (SELECT DISTINCT ticker, period_end AS split_date, CASE WHEN month(period_end) % 2 = 0 THEN 2.0 ELSE 0.5 END AS factor FROM facts WHERE concept = 'Revenues'), dd AS (SELECT DISTINCT {ticker_sql('ticker')} AS ticker, trade_date FROM daily_returns), x AS (SELECT dd.ticker, dd.trade_date, product(factor) AS f FROM dd LEFT JOIN s ON s.ticker = dd.ticker AND s.split_date > dd.trade_date GROUP BY ALL) SELECT ticker, trade_date, round(coalesce(f, 1.0), 8) AS split_factor FROM x")
def split_factor(spark, d):
    s = b.facts(spark, d).where("concept = 'Revenues'").select("ticker", F.col("period_end").alias("split_date"), F.when(F.month("period_end") % 2 == 0, 2.0).otherwise(0.5).alias("factor")).distinct()
    days = b.closes(spark, d).select("ticker", "trade_date").distinct()
    return rnd(asof.suffix_product(days, s, key="ticker", at="trade_date", split_at="split_date", factor="factor", into="split_factor"), 8, "split_factor")


_NEAREST = f"WITH {CALLS}, {REPORTS}, j AS (SELECT call_id, r.event_date AS sd, reported_eps, reported_revenue, row_number() OVER (PARTITION BY call_id ORDER BY abs(date_diff('day', c.event_date, r.event_date)), r.event_date, reported_eps DESC NULLS LAST, reported_revenue DESC NULLS LAST) AS rn FROM calls c JOIN reports r ON c.ticker = r.ticker WHERE r.event_date IS NOT NULL), n AS (SELECT c.call_id, c.ticker, c.event_date, sd AS source_event_date, abs(date_diff('day', c.event_date, sd))::BIGINT AS date_diff_days, CASE WHEN abs(date_diff('day', c.event_date, sd)) <= 3 THEN 'matched' WHEN sd IS NOT NULL THEN 'outside_tolerance' ELSE 'missing_source' END AS match_status, reported_eps, reported_revenue FROM calls c LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (call_id))"


def _nearest(spark, d):
    r = b.reports(spark, d).select("ticker", F.col("event_date").alias("at"), "reported_eps", "reported_revenue")
    return asof.nearest(b.calls(spark, d).select("call_id", "ticker", "event_date"), r, key="ticker", target_at="event_date", source_at="at", payload=["reported_eps", "reported_revenue"], max_days=3)


@query(_NEAREST + " SELECT call_id, ticker, event_date, source_event_date, date_diff_days, match_status, CASE WHEN match_status = 'matched' THEN reported_eps END AS reported_eps, CASE WHEN match_status = 'matched' THEN reported_revenue END AS reported_revenue FROM n")
def nearest_match(spark, d):
    return _nearest(spark, d)


@query(_NEAREST + " SELECT ticker, count(*) AS events, round(avg((match_status = 'matched')::INT), 6) AS matched_share FROM n GROUP BY ticker")
def match_coverage(spark, d):
    return rnd(fundamentals.match_coverage(_nearest(spark, d)), 6, "matched_share")


_EPS = ("reported_eps", "estimated_eps", "reported_revenue", "estimated_revenue")


_NULLS_LOW = ", ".join(f"coalesce({c}, -1e300)" for c in _EPS)


@query(f"WITH {REPORTS}, a AS (SELECT ticker, event_date, max(row({_NULLS_LOW})) AS x FROM reports WHERE provider = 'ledgerline' GROUP BY ALL), z AS (SELECT ticker, event_date, max(row({_NULLS_LOW})) AS x FROM reports WHERE provider IS DISTINCT FROM 'ledgerline' GROUP BY ALL) SELECT ticker, event_date, {', '.join(f'coalesce(nullif(a.x[{i}], -1e300), nullif(z.x[{i}], -1e300)) AS {c}' for i, c in enumerate(_EPS, 1))} FROM a FULL JOIN z USING (ticker, event_date)")
def event_source_coalesce(spark, d):
    r = b.reports(spark, d)
    keys = ["ticker", "event_date"]
    first, rest = r.where("provider = 'ledgerline'"), r.where(~F.col("provider").eqNullSafe("ledgerline"))
    return fundamentals.merge_events([fundamentals.standardise_events(x, keys) for x in (first, rest)], keys)


def _surprise_sql(c: str) -> str:
    s, e = f"(reported_{c} - estimated_{c})", f"estimated_{c}"
    return f"round({s}, 6) AS {c}_surprise, round(CASE WHEN abs({e}) > 1e-12 THEN {s} / abs({e}) END, 6) AS {c}_surprise_pct, coalesce(({s} > 0)::INT, 0) AS {c}_beat, coalesce(({s} < 0)::INT, 0) AS {c}_miss, coalesce(({s} = 0)::INT, 0) AS {c}_meet, CASE WHEN {s} > 0 THEN 'beat' WHEN {s} < 0 THEN 'miss' WHEN {s} = 0 THEN 'meet' END AS {c}_label"


@query(f"WITH {REPORTS} SELECT source_event_id, {_surprise_sql('eps')}, {_surprise_sql('revenue')} FROM reports")
def surprise_labels(spark, d):
    s = fundamentals.surprise(b.reports(spark, d))
    return rnd(s, 6, "eps_surprise", "eps_surprise_pct", "revenue_surprise", "revenue_surprise_pct").select("source_event_id", *[f"{c}_{k}" for c in ("eps", "revenue") for k in ("surprise", "surprise_pct", "beat", "miss", "meet", "label")])


@query(f"WITH {REPORTS}, x AS (SELECT source_event_id::VARCHAR AS call_id, ticker, event_date, estimated_revenue, CASE WHEN reported_eps / nullif(abs(reported_revenue), 0) > 0 THEN reported_eps / abs(reported_revenue) END AS ratio FROM reports WHERE event_date IS NOT NULL AND ticker IS NOT NULL), m AS (SELECT *, quantile_cont(ratio, 0.5) OVER (PARTITION BY ticker ORDER BY event_date, call_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pr FROM x) SELECT call_id, ticker, event_date, round(pr * 1e9, 5) AS prior_ratio_e9, round(estimated_revenue * pr, 6) AS estimated_capex, (estimated_revenue * pr IS NOT NULL)::INT AS estimated_capex_is_proxy FROM m")
def rolling_prior_median(spark, d):
    p = fundamentals.capex_proxy(b.capex_events(spark, d))
    return p.select("call_id", "ticker", "event_date", F.round(F.col("prior_ratio") * 1e9, 5).alias("prior_ratio_e9"), F.round("estimated_capex", 6).alias("estimated_capex"), "estimated_capex_is_proxy")


@query(f"WITH {REPORTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count({c}) / count(*), 6) AS coverage, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median FROM reports" for c in _EPS))
def dataset_summary(spark, d):
    return rnd(rnd(fundamentals.coverage(b.reports(spark, d), list(_EPS)), 6, "coverage"), 4, "mean", "median")


# ---- universe ----------------------------------------------------------------------------

_UNIVERSE = f"WITH {CALLS}, u AS (SELECT {ticker_sql('ticker')} AS ticker, max(row(market_cap_usd, trim(coalesce(sector, '')))) AS x FROM universe GROUP BY 1), st AS (SELECT ticker, count(*) AS calls, min(event_date) AS first_event_date, max(event_date) AS last_event_date FROM calls WHERE ticker IS NOT NULL GROUP BY 1)"
_FORCED = ("VQLN", "ZWQDG", "ZPSLA")


def _universe(spark, d):
    return read_table(spark, d, "universe").withColumn("ticker", text.canonical_ticker(F.col("ticker")))


@query(_UNIVERSE + f", c AS (SELECT u.ticker, x[1] AS cap, x[2] AS sector, st.* EXCLUDE (ticker), lower(x[2]) = 'information technology' AS hit, u.ticker IN {_FORCED} AS forced FROM u JOIN st USING (ticker) WHERE x[1] >= 1e9), s AS (SELECT *, rank() OVER (ORDER BY cap) AS rk, count(*) OVER (PARTITION BY cap) AS peers, count(*) OVER () AS n FROM c WHERE hit OR forced) SELECT ticker, cap AS market_cap_usd, sector, calls, first_event_date, last_event_date, CASE WHEN forced AND hit THEN 'sector_filter+forced_include' WHEN forced THEN 'forced_include' ELSE 'sector_filter' END AS included_by, round(ln(cap), 8) AS log_market_cap, round((rk + (peers - 1) / 2) / n, 8) AS market_cap_percentile FROM s")
def universe_screen(spark, d):
    return rnd(universe.screen(_universe(spark, d), b.calls(spark, d), min_cap=1e9, forced=_FORCED), 8, "log_market_cap", "market_cap_percentile")


@query("WITH x AS (SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) AS rk, count(*) OVER (PARTITION BY o_totalprice) AS peers, count(*) OVER () AS n FROM orders) SELECT o_orderkey, round((rk + (peers - 1) / 2) / n, 9) AS price_rank FROM x")
def pct_rank(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rnd(universe.average_rank(o, "o_totalprice", "price_rank", share=True), 9, "price_rank").select("o_orderkey", "price_rank")


@query(f"WITH {CALLS} SELECT ticker, count(*) AS calls, min(event_date) AS first_event_date, max(event_date) AS last_event_date FROM calls WHERE ticker IS NOT NULL GROUP BY ticker")
def corpus_stats(spark, d):
    return universe.corpus_stats(b.calls(spark, d))


@query(f"WITH {CALLS} SELECT ticker, count(*) AS calls FROM calls WHERE ticker IS NOT NULL GROUP BY ticker ORDER BY calls DESC, ticker LIMIT 25")
def top_tickers(spark, d):
    return universe.corpus_stats(b.calls(spark, d)).select("ticker", "calls").orderBy(F.desc("calls"), "ticker").limit(25)


@query(f"SELECT {ticker_sql('u.ticker')} AS ticker, coalesce(b.sector, u.sector) AS sector FROM universe u LEFT JOIN (SELECT {ticker_sql('ticker')} AS ticker, max(upper(trim(sector))) AS sector FROM universe GROUP BY 1) b ON {ticker_sql('u.ticker')} = b.ticker")
def classification_override(spark, d):
    u = _universe(spark, d)
    return universe.override(u.select("ticker", "sector"), u.select("ticker", F.upper(F.trim("sector")).alias("sector")), "ticker", ["sector"])


# ---- records: text, parsing, curation ------------------------------------------------------

_T = norm_sql("transcript")
_QA = r"(question[- ]and[- ]answer|questions? and answers?|q\s*&\s*a|question[- ]and[- ]answer session)"
_METRICS = rf"""{RECORDS},
seg AS (SELECT record_key, {norm_sql('s.speaker')} AS who, {norm_sql('s.text')} AS said, i FROM (SELECT record_key, unnest(structured_content) AS s, generate_subscripts(structured_content, 1) AS i FROM records)),
op AS (SELECT *, min(CASE WHEN regexp_matches(concat_ws(' ', who, said), '(?i){_QA}') THEN i END) OVER (PARTITION BY record_key) AS o FROM seg),
sq AS (SELECT record_key, count(*) FILTER (WHERE i > o AND (regexp_matches(who, '(?i)\banalyst\b') OR (contains(said, '?') AND NOT regexp_matches(who, '(?i)\b(ceo|cfo|coo|chief|president|executive|management|operator)\b')))) AS n FROM op GROUP BY record_key),
r1 AS (SELECT records.*, {_T} AS t, {ticker_sql('ticker')} AS tk, {day_sql('event_date')} AS dd, coalesce(sq.n, 0) AS sn FROM records LEFT JOIN sq USING (record_key)),
r2 AS (SELECT *, regexp_extract(t, '(?is)({_QA}.*)$', 1) AS ex FROM r1),
r3 AS (SELECT *, CASE WHEN sn > 0 THEN sn WHEN contains(ex, '?') THEN least(length(ex) - length(replace(ex, '?', '')), 50) ELSE least(len(regexp_extract_all(ex, '(?i)\b(question|follow[- ]up)\b')), 50) END AS aq, len(regexp_extract_all(t, '(?i)\boperator\b')) AS om FROM r2),
metrics AS (SELECT record_key, source_id, source_file, source_row, tk AS ticker, dd AS event_date, {norm_sql('company')} AS company, length(t)::BIGINT AS transcript_chars, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::BIGINT AS transcript_words, CASE WHEN t <> '' THEN sha256(lower(t)) END AS text_hash,
  (ex <> '' OR aq > 0)::INT AS has_qa_section, aq::INT AS analyst_question_count, (tk IS NULL)::INT AS missing_ticker, (dd IS NULL)::INT AS missing_event_date, coalesce(regexp_matches(tk, '^[A-Z][A-Z0-9.\-]{{0,9}}$'), false)::INT AS valid_ticker, (dd IS NOT NULL)::INT AS valid_event_date,
  (coalesce(len(structured_content), 0) > 0)::INT AS has_structured_content, om::BIGINT AS operator_mentions, (om >= 5)::INT AS repeated_operator_text, round(len(regexp_extract_all(t, '[^\x00-\x7F]')) / greatest(length(t), 1), 6) AS non_ascii_ratio, coalesce(source_priority, 0)::INT AS source_priority FROM r3)"""
_DEDUP = f"""{_METRICS},
q AS (SELECT *, (has_qa_section * 100 + least(analyst_question_count, 10) * 10 + has_structured_content * 20 + valid_ticker * 20 + valid_event_date * 20 + source_priority + least(transcript_chars, 200000) // 5000 - repeated_operator_text * 10 - (non_ascii_ratio > 0.05)::INT * 10)::BIGINT AS quality_score FROM metrics),
d1 AS (SELECT *, CASE WHEN text_hash IS NOT NULL THEN first_value(record_key) OVER (PARTITION BY text_hash ORDER BY quality_score DESC, has_qa_section DESC, analyst_question_count DESC, transcript_chars DESC, has_structured_content DESC, source_priority DESC, record_key) END AS b1 FROM q),
d2 AS (SELECT *, coalesce(b1 <> record_key, false) AS t1 FROM d1),
d3 AS (SELECT *, CASE WHEN NOT t1 AND ticker IS NOT NULL AND event_date IS NOT NULL THEN first_value(record_key) OVER w END AS b2, min(transcript_chars) OVER v AS lo, max(transcript_chars) OVER v AS hi FROM d2 WINDOW w AS (PARTITION BY t1, ticker, event_date ORDER BY quality_score DESC, has_qa_section DESC, analyst_question_count DESC, transcript_chars DESC, has_structured_content DESC, source_priority DESC, record_key), v AS (PARTITION BY t1, ticker, event_date)),
dd AS (SELECT *, CASE WHEN t1 THEN 'exact_text_duplicate' WHEN b2 <> record_key AND (hi - greatest(lo, 1)) / greatest(lo, 1) <= 0.15 THEN 'version_duplicate' WHEN b2 <> record_key THEN 'ticker_date_duplicate' ELSE '' END AS drop_reason, CASE WHEN t1 THEN b1 WHEN b2 <> record_key THEN b2 ELSE '' END AS duplicate_of FROM d3)"""
_GOLD = f"""{_DEDUP},
f AS (SELECT *, drop_reason = '' AND transcript_chars > 0 AND valid_ticker = 1 AND valid_event_date = 1 AS keep_clean_master FROM dd),
ff AS (SELECT *, keep_clean_master AND has_qa_section = 1 AND transcript_chars >= 2000 AND analyst_question_count >= 2 AS keep_gold FROM f)"""


def _metrics(spark, d):
    return curation.record_metrics(b.records(spark, d))


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def record_metrics(spark, d):
    return big(_metrics(spark, d), "transcript_chars", "transcript_words")


@query(f"WITH {_DEDUP} SELECT record_key, quality_score, drop_reason, duplicate_of FROM dd")
def text_dedup(spark, d):
    return curation.deduplicate(_metrics(spark, d)).select("record_key", "quality_score", "drop_reason", "duplicate_of")


@query(f"WITH {_GOLD} SELECT record_key, keep_clean_master, keep_gold, array_to_string(list_distinct_sorted, ',') AS hard_filter_failures, concat_ws(',', CASE WHEN analyst_question_count < 4 THEN 'low_question_count' END, CASE WHEN repeated_operator_text = 1 THEN 'repeated_operator_text' END, CASE WHEN non_ascii_ratio > 0.05 THEN 'high_non_ascii_ratio' END) AS soft_quality_flags FROM (SELECT *, [x FOR x IN [nullif(drop_reason, ''), CASE WHEN valid_ticker <> 1 THEN 'invalid_ticker' END, CASE WHEN valid_event_date <> 1 THEN 'invalid_event_date' END, CASE WHEN has_qa_section <> 1 THEN 'missing_qa' END, CASE WHEN transcript_chars < 2000 THEN 'short_transcript' END, CASE WHEN analyst_question_count < 2 THEN 'too_few_analyst_questions' END] IF x IS NOT NULL] AS list_distinct_sorted FROM ff)")
def quality_funnel(spark, d):
    return curation.quality_filters(curation.deduplicate(_metrics(spark, d)), min_chars=2000).select("record_key", "keep_clean_master", "keep_gold", "hard_filter_failures", "soft_quality_flags")


@query(f"WITH {_GOLD} SELECT 'raw_records' AS stage, count(*) AS records FROM ff UNION ALL SELECT 'after_dedup', count(*) FROM ff WHERE drop_reason = '' UNION ALL SELECT 'clean_master', count(*) FROM ff WHERE keep_clean_master UNION ALL SELECT 'gold', count(*) FROM ff WHERE keep_gold")
def stage_counts(spark, d):
    return curation.stage_counts(curation.quality_filters(curation.deduplicate(_metrics(spark, d)), min_chars=2000))


_FLAGS = f"{_METRICS}, fl AS (SELECT *, CASE WHEN text_hash IS NOT NULL THEN (count(*) OVER (PARTITION BY text_hash) > 1)::INT ELSE 0 END AS duplicate_text, CASE WHEN ticker IS NOT NULL AND event_date IS NOT NULL THEN (count(*) OVER (PARTITION BY ticker, event_date) > 1)::INT ELSE 0 END AS duplicate_ticker_date FROM metrics)"


@query(f"WITH {_FLAGS} SELECT record_key, duplicate_text, duplicate_ticker_date FROM fl")
def duplicate_flags(spark, d):
    return curation.duplicate_flags(_metrics(spark, d)).select("record_key", "duplicate_text", "duplicate_ticker_date")


@query(f"WITH {_FLAGS} SELECT coalesce(source_id, 'ALL') AS source_id, count(DISTINCT source_file) AS num_files, count(*) AS num_records, sum(duplicate_text)::BIGINT AS duplicate_text_records, sum(duplicate_ticker_date)::BIGINT AS duplicate_ticker_date_records, sum(missing_ticker)::BIGINT AS missing_ticker_records, sum(missing_event_date)::BIGINT AS missing_event_date_records, sum(has_qa_section)::BIGINT AS qa_detectable_records, round(avg(has_qa_section), 4) AS qa_detectable_share, " + ", ".join(f"trunc(quantile_cont({c}, {p}))::BIGINT AS {c}_p{int(p * 100)}" for c in ("transcript_chars", "transcript_words") for p in (0.1, 0.5, 0.9)) + " FROM fl WHERE source_id IS NOT NULL GROUP BY ROLLUP (source_id)")
def audit_rollup(spark, d):
    return curation.audit_rollup(curation.duplicate_flags(_metrics(spark, d)))


@query(rf"SELECT DISTINCT ticker AS raw, {ticker_sql('ticker')} AS canonical, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(ticker, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug FROM qa_pairs")
def ticker_spelling(spark, d):
    return read_table(spark, d, "qa_pairs").select("ticker").distinct().select(F.col("ticker").alias("raw"), text.canonical_ticker(F.col("ticker")).alias("canonical"), text.slug(F.col("ticker")).alias("slug"))


@query(f"SELECT DISTINCT event_date AS raw, {day_sql('event_date')} AS day FROM transcript_record")
def event_dates(spark, d):
    return read_table(spark, d, "transcript_record").select("event_date").distinct().select(F.col("event_date").alias("raw"), text.parse_day(F.col("event_date")).alias("day"))


@query(r"SELECT DISTINCT cik AS raw, nullif(regexp_replace(regexp_replace(regexp_replace(trim(cik), '\.0+$', ''), '[^0-9]', '', 'g'), '^0+', ''), '') AS cik, CASE WHEN cik IS NOT NULL AND regexp_replace(regexp_replace(trim(cik), '\.0+$', ''), '[^0-9]', '', 'g') <> '' THEN lpad(regexp_replace(regexp_replace(regexp_replace(trim(cik), '\.0+$', ''), '[^0-9]', '', 'g'), '^0+', ''), 10, '0') END AS padded FROM universe")
def company_numbers(spark, d):
    u = read_table(spark, d, "universe").select("cik").distinct()
    return u.select(F.col("cik").alias("raw"), text.digits_key(F.col("cik")).alias("cik"), text.padded_cik(F.col("cik")).alias("padded"))


# RE2 has no look-behind: blanks behind colons are doubled, so that each match leaves one for the next.
_SPK = parsing.SPEAKER[len(r"(?<!\w)") :].removesuffix(r"\s+").replace("'", "''") + r"\s"


@query(rf"WITH {RECORDS}, m AS (SELECT record_key, regexp_replace(replace({_T}, ': ', ':  '), '(^|[^\w]){_SPK}', '\1' || chr(1) || '\2' || chr(2), 'g') AS t FROM records), p AS (SELECT record_key, unnest(string_split(t, chr(1))[2:]) AS x, generate_subscripts(string_split(t, chr(1))[2:], 1) AS i FROM m), r AS (SELECT record_key, split_part(x, chr(2), 1) AS speaker, trim(replace(split_part(x, chr(2), 2), ':  ', ': ')) AS text, i FROM p) SELECT record_key, (row_number() OVER (PARTITION BY record_key ORDER BY i) - 1)::BIGINT AS idx, speaker, text FROM r WHERE text <> ''")
def split_colon(spark, d):
    return big(parsing.split_colon(b.records(spark, d), "record_key", "transcript"), "idx")


@query(f"WITH {STRUCTURED} SELECT call_id, idx::BIGINT AS idx, speaker, speaker_role, section, text FROM turns")
def parse_structured(spark, d):
    return big(b.structured_turns(spark, d), "idx")


@query(f"WITH {STRUCTURED} SELECT DISTINCT call_id, start::BIGINT AS start FROM tr WHERE start IS NOT NULL")
def qna_start(spark, d):
    t = parsing.structured_rows(b.records(spark, d), "record_key", "structured_content").withColumn("speaker_role", F.lit("management"))
    return parsing.qna_start(t, "record_key").where("start is not null").select(F.col("record_key").alias("call_id"), F.col("start").cast("bigint").alias("start")).distinct()


@query()
def parse_colon(spark, d):
    return parsing.parse_colon(b.records(spark, d), "record_key", "transcript")


@query()
def parse_sections(spark, d):
    headed = b.records(spark, d).withColumn("transcript", F.concat(F.lit("Questions and Answers\n"), "transcript"))
    return parsing.parse_sections(headed, "record_key", "transcript")


@query()
def parse_audit(spark, d):
    return parsing.parse_records(b.records(spark, d), "record_key", "transcript", "structured_content")[1]


# ---- pairs -----------------------------------------------------------------------------------


@query(f"WITH {STRUCTURED} SELECT call_id, string_agg(text, ' ' ORDER BY idx) AS text, count(text) AS num_questions FROM turns WHERE contains(lower(section), 'q') AND contains(speaker_role, 'analyst') GROUP BY call_id")
def qa_extract(spark, d):
    return pairing.extract_questions(b.turns(spark, d)).select("call_id", "text", "num_questions")


_STOP = " OR ".join("contains(lower(trim(text)), '" + p.replace("'", "''") + "')" for p in pairing.QUESTION_STOP_PHRASES)
_BUILT = rf"""{STRUCTURED},
fq AS (SELECT *, speaker_role <> 'operator' AND contains(speaker_role, 'analyst') AND contains(text, '?') AND length(trim(text)) >= 40 AND NOT ({_STOP}) AS q FROM turns),
fg AS (SELECT *, sum(q::INT) OVER (PARTITION BY call_id ORDER BY idx) AS g FROM fq),
an AS (SELECT *, row_number() OVER (PARTITION BY call_id, g ORDER BY idx) AS rk FROM fg WHERE g > 0 AND NOT q AND speaker_role <> 'operator'),
kp AS (SELECT * FROM an WHERE rk = 1 OR NOT (length(trim(text)) < 30 AND NOT contains(text, '?') AND regexp_matches(trim(text), '(?i)^(okay|ok|great|thanks|thank you|all right|right)\b'))),
aa AS (SELECT call_id, g, min(idx) AS a0, max(idx) AS a1, trim(string_agg(trim(text), ' ' ORDER BY idx)) AS answer_text, count(*) AS nt, string_agg(speaker_role, '|' ORDER BY idx) AS roles FROM kp GROUP BY ALL)"""


@query(f"WITH {_BUILT} SELECT fg.call_id, (row_number() OVER (PARTITION BY fg.call_id ORDER BY idx) - 1)::BIGINT AS pair_index, idx::BIGINT AS question_turn_id, a0::BIGINT AS answer_start_turn_id, a1::BIGINT AS answer_end_turn_id, trim(text) AS question_text, answer_text, length(trim(text))::BIGINT AS question_char_len, length(answer_text)::BIGINT AS answer_char_len, nt::BIGINT AS num_answer_turns, roles AS answer_roles FROM fg JOIN aa USING (call_id, g) WHERE q AND answer_text <> ''")
def qa_pairs_built(spark, d):
    p = pairing.pair_turns(b.turns(spark, d)).drop("ticker", "event_date")
    return big(p.withColumn("answer_roles", F.array_join("answer_roles", "|")), "pair_index", "question_turn_id", "answer_start_turn_id", "answer_end_turn_id", "question_char_len", "answer_char_len", "num_answer_turns")


_ANNOTATED = rf"""{PAIRS}, rl AS (SELECT *, coalesce([lower(trim(x)) FOR x IN answer_roles IF trim(x) <> ''], []) AS r, coalesce(answer_text, '') AS a FROM pairs),
ct AS (SELECT *, len([x FOR x IN r IF x = 'management']) AS m, len([x FOR x IN r IF x = 'analyst']) AS n FROM rl),
ann AS (SELECT pair_id, call_id, answer_char_len, num_answer_turns, m > 0 AS answer_has_management_role, n > 0 AS answer_has_analyst_role, m > 0 AND n > 0 AS answer_has_mixed_roles, n > 0 AND m = 0 AS analyst_only, m::BIGINT AS answer_management_turn_count, n::BIGINT AS answer_analyst_turn_count,
  (CASE WHEN len(r) >= 2 THEN len([i FOR i IN range(2, len(r) + 1) IF r[i] <> r[i - 1]]) ELSE 0 END)::BIGINT AS answer_role_switch_count, m / greatest(num_answer_turns, 1) AS mshare, n / greatest(num_answer_turns, 1) AS nshare,
  coalesce(r[1], '') = 'management' AS answer_starts_with_management, coalesce(r[-1], '') = 'management' AS answer_ends_with_management, coalesce(r[1], '') = 'analyst' AS answer_starts_with_analyst, coalesce(r[-1], '') = 'analyst' AS answer_ends_with_analyst,
  contains(a, '?') AS answer_contains_question_mark, {" OR ".join("contains(lower(trim(a)), '" + p.replace("'", "''") + "')" for p in pairing.QUESTION_STOP_PHRASES)} AS answer_contains_operator_prompt, num_answer_turns > 6 AS answer_span_gt6_turns, answer_char_len < 120 AS answer_is_short_strict FROM ct)"""


@query(f"WITH {_ANNOTATED} SELECT pair_id, answer_has_management_role, answer_has_analyst_role, answer_has_mixed_roles, analyst_only AS answer_is_analyst_only, answer_management_turn_count, answer_analyst_turn_count, answer_role_switch_count, round(mshare, 6) AS answer_management_turn_share, round(nshare, 6) AS answer_analyst_turn_share, answer_starts_with_management, answer_ends_with_management, answer_starts_with_analyst, answer_ends_with_analyst, answer_contains_question_mark, answer_contains_operator_prompt, answer_span_gt6_turns, answer_is_short_strict FROM ann")
def pair_annotations(spark, d):
    a = pairing.annotate(b.pairs(spark, d))
    cols = ["answer_has_management_role", "answer_has_analyst_role", "answer_has_mixed_roles", "answer_is_analyst_only", "answer_management_turn_count", "answer_analyst_turn_count", "answer_role_switch_count", "answer_management_turn_share", "answer_analyst_turn_share", "answer_starts_with_management", "answer_ends_with_management", "answer_starts_with_analyst", "answer_ends_with_analyst", "answer_contains_question_mark", "answer_contains_operator_prompt", "answer_span_gt6_turns", "answer_is_short_strict"]
    a = big(a, "answer_management_turn_count", "answer_analyst_turn_count", "answer_role_switch_count")
    return rnd(a, 6, "answer_management_turn_share", "answer_analyst_turn_share").select("pair_id", *cols)


_KEEPS = {"min_answer_chars": "coalesce(answer_char_len >= 120, false)", "require_management_turn": "answer_has_management_role", "drop_answer_with_question_mark": "NOT answer_contains_question_mark", "drop_operator_prompt_leak": "NOT answer_contains_operator_prompt", "drop_analyst_only_answers": "NOT analyst_only"}


@query(f"WITH {_ANNOTATED} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT ({v})) AS dropped, count(*) AS total FROM ann" for k, v in (_KEEPS | {"all": " AND ".join(_KEEPS.values())}).items()))
def pair_filter_funnel(spark, d):
    return pairing.filter_funnel(pairing.annotate(b.pairs(spark, d)), "strict")


@query(f"WITH {_ANNOTATED} SELECT pair_id FROM ann WHERE {' AND '.join(_KEEPS.values())}")
def pair_filter(spark, d):
    return pairing.filter_pairs(pairing.annotate(b.pairs(spark, d)), "strict").select("pair_id")


@query(f"WITH {_ANNOTATED} SELECT call_id, count(*) AS num_pairs, round(avg(answer_has_management_role::INT), 6) AS management_answer_rate, round(avg(answer_has_mixed_roles::INT), 6) AS mixed_answer_rate, round(avg(analyst_only::INT), 6) AS analyst_only_answer_rate, round(avg(mshare), 6) AS management_turn_share_mean, round(avg(nshare), 6) AS analyst_turn_share_mean, round(avg(answer_role_switch_count), 6) AS role_switch_mean, max(answer_role_switch_count)::BIGINT AS role_switch_max, round(avg(answer_contains_question_mark::INT), 6) AS answer_question_mark_rate, round(avg(answer_char_len), 6) AS answer_chars_mean, max(answer_char_len)::BIGINT AS answer_chars_max FROM ann GROUP BY call_id")
def call_role_aggregates(spark, d):
    a = pairing.role_aggregates(pairing.annotate(b.pairs(spark, d)))
    return rnd(big(a, "role_switch_max", "answer_chars_max"), 6, *[c for c, k in a.dtypes if k == "double"])


@query(f"WITH {SCORED} SELECT pair_id, round(pair_index / greatest(max(pair_index) OVER w, 1), 6) AS pair_position_frac, (max(pair_index) OVER w - pair_index)::BIGINT AS pair_position_from_end FROM scored WINDOW w AS (PARTITION BY call_id)")
def pair_positions(spark, d):
    p = pooling.positions_in_call(b.scored(spark, d))
    return rnd(big(p, "pair_position_from_end"), 6, "pair_position_frac").select("pair_id", "pair_position_frac", "pair_position_from_end")


@query(f"WITH {STRUCTURED}, {RECORDS.replace('records AS', 'rec2 AS')} SELECT call_id, {ticker_sql('r.ticker')} AS ticker, {day_sql('r.event_date')} AS event_date, row_number() OVER (PARTITION BY call_id ORDER BY idx)::BIGINT AS turn_id, speaker_role, section, text FROM turns JOIN rec2 r ON r.record_key = call_id")
def projected_turns(spark, d):
    """Parsed turns numbered anew in their delivered order."""
    return big(parsing.project_turns(b.turns(spark, d).withColumnRenamed("turn_id", "at"), ["at"]), "turn_id")


# ---- joins and sets ----------------------------------------------------------------------------


@query(f"WITH {CALLS}, {PAIRS}, q AS (SELECT call_id, string_agg(question_text, ' ' ORDER BY pair_index) AS text, count(question_text) AS num_questions FROM pairs GROUP BY call_id) SELECT call_id, c.event_date, text, num_questions, c.car, c.label FROM q JOIN calls c USING (call_id) WHERE text IS NOT NULL AND label IS NOT NULL AND abs(car) >= 0.02")
def labelled_dataset(spark, d):
    rows = F.array_sort(F.collect_list(F.when(F.col("question_text").isNotNull(), F.struct("pair_index", "question_text"))))
    q = b.pairs(spark, d).groupBy("call_id").agg(F.nullif(F.array_join(F.transform(rows, lambda x: x["question_text"]), " "), F.lit("")).alias("text"), F.count("question_text").alias("num_questions"))
    return q.join(b.calls(spark, d), "call_id").where("text is not null and label is not null and abs(car) >= 0.02").select("call_id", "event_date", "text", "num_questions", "car", "label")


@query(f"WITH {CALLS}, {CLOSES} SELECT ticker, count(*) AS calls FROM calls c WHERE ticker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM closes p WHERE p.ticker = c.ticker) GROUP BY ticker")
def priceless_tickers(spark, d):
    c = b.calls(spark, d).where("ticker is not null").join(b.closes(spark, d).where("close_price is not null").select("ticker").distinct(), "ticker", "left_anti")
    return c.groupBy("ticker").agg(F.count("*").alias("calls"))


@query(f"WITH {CALLS}, {FACTS} SELECT call_id FROM calls c WHERE EXISTS (SELECT 1 FROM facts f WHERE f.ticker = c.ticker AND concept = 'Revenues')")
def calls_with_facts(spark, d):
    return b.calls(spark, d).join(b.facts(spark, d).where("concept = 'Revenues'").select("ticker").distinct(), "ticker", "left_semi").select("call_id")


@query(f"WITH {CALLS} SELECT ticker, 'call' AS kind, event_date AS day FROM calls UNION ALL SELECT {ticker_sql('ticker')}, 'report', source_event_date FROM external_events UNION ALL SELECT {ticker_sql('ticker')}, 'document', event_date FROM documents")
def event_union(spark, d):
    t = text.canonical_ticker(F.col("ticker"))
    a = b.calls(spark, d).select("ticker", F.lit("call").alias("kind"), F.col("event_date").alias("day"))
    r = read_table(spark, d, "external_events").select(t.alias("ticker"), F.lit("report").alias("kind"), F.col("source_event_date").alias("day"))
    return a.unionByName(r).unionByName(read_table(spark, d, "documents").select(t.alias("ticker"), F.lit("document").alias("kind"), F.col("event_date").alias("day")))


@query(f"WITH {PAIRS}, x AS (SELECT pair_id, list_distinct(string_split(lower(question_text), ' ')) AS q, list_distinct(string_split(lower(answer_text), ' ')) AS a FROM pairs WHERE question_text <> '' AND answer_text <> '') SELECT pair_id, round(len(list_intersect(q, a)) / len(q), 6) AS overlap FROM x")
def word_overlap(spark, d):
    p = b.pairs(spark, d).where("question_text <> '' and answer_text <> ''")
    return p.select("pair_id", F.round(attribution.overlap(F.split(F.lower("question_text"), " "), F.split(F.lower("answer_text"), " ")), 6).alias("overlap"))


# ---- splits and validation -----------------------------------------------------------------------

_POS = f"{CALLS}, pos AS (SELECT call_id, event_date, row_number() OVER (ORDER BY event_date NULLS FIRST, call_id) - 1 AS pos, count(*) OVER () AS n FROM calls)"


@query(f"WITH {_POS} SELECT call_id, event_date, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM pos")
def time_split(spark, d):
    return splits.time_split(b.calls(spark, d))


_FOLDS = f"{_POS}, fo AS (SELECT call_id, pos, n, unnest(range(0, greatest((n - 100 - 40 - 40) // 40 + 1, 0))) AS fold FROM pos), folds AS (SELECT fold, CASE WHEN pos < 100 + fold * 40 THEN 'train' WHEN pos < 140 + fold * 40 THEN 'val' WHEN pos < 180 + fold * 40 THEN 'test' END AS split, call_id FROM fo)"


@query(f"WITH {_FOLDS} SELECT fold, split, call_id FROM folds WHERE split IS NOT NULL")
def rolling_splits(spark, d):
    return big(splits.rolling_splits(b.calls(spark, d), 100, 40, 40, 40), "fold")


@query(f"WITH {_FOLDS}, {PAIRS}, pc AS (SELECT call_id, count(*) AS k FROM pairs GROUP BY call_id) SELECT fold, split, count(*) AS calls, coalesce(sum(k), 0)::BIGINT AS pairs, min(event_date) AS first_date, max(event_date) AS last_date FROM folds JOIN calls USING (call_id) LEFT JOIN pc USING (call_id) WHERE split IS NOT NULL GROUP BY ALL")
def fold_summary(spark, d):
    c = b.calls(spark, d)
    return big(splits.fold_summary(splits.rolling_splits(c, 100, 40, 40, 40), c, b.pairs(spark, d)), "fold", "pairs")


_COVERAGE = {"pre_event_return": 0.9, "qa_count": 0.99, "SUE_EPS": 0.65}


@query(f"{_WINDOWS}, pos AS{_POS.split(", pos AS")[1]}, fo AS (SELECT call_id, pos, n, unnest(range(0, greatest((n - 100 - 40 - 40) // 40 + 1, 0))) AS fold FROM pos), folds AS (SELECT fold, CASE WHEN pos < 100 + fold * 40 THEN 'train' WHEN pos < 140 + fold * 40 THEN 'val' WHEN pos < 180 + fold * 40 THEN 'test' END AS split, call_id FROM fo), fs AS (SELECT * FROM folds WHERE split IS NOT NULL), {PAIRS}, pc AS (SELECT call_id, count(*) AS k FROM pairs GROUP BY call_id), {REPORTS}, sue AS (SELECT ticker, event_date, max(CASE WHEN estimated_eps <> 0 THEN (reported_eps - estimated_eps) / abs(estimated_eps) END) AS s FROM reports GROUP BY ALL), c AS (SELECT e.call_id, e.pre_5 AS pre_event_return, pc.k AS qa_count, sue.s AS sue FROM e LEFT JOIN pc USING (call_id) LEFT JOIN sue ON sue.ticker = e.ticker AND sue.event_date = e.event_date), cov AS (SELECT count(*) AS n, avg((pre_event_return IS NOT NULL)::INT) AS a, avg((qa_count IS NOT NULL)::INT) AS q, avg((sue IS NOT NULL AND NOT isnan(sue))::INT) AS s FROM c), tcov AS (SELECT fold, avg((pre_event_return IS NOT NULL)::INT) AS a, avg((qa_count IS NOT NULL)::INT) AS q, avg((sue IS NOT NULL AND NOT isnan(sue))::INT) AS s FROM fs JOIN c USING (call_id) WHERE split = 'train' GROUP BY fold), sz AS (SELECT fold, split, coalesce(sum(k), 0) AS p FROM fs LEFT JOIN pc USING (call_id) GROUP BY ALL), rules AS (SELECT 'error' AS level, 'min_calls' AS code, NULL::INT AS fold, n::DOUBLE AS value, {splits.MIN_CALLS}::DOUBLE AS required FROM cov UNION ALL SELECT 'error', 'coverage_pre_event_return', NULL, a, 0.9 FROM cov UNION ALL SELECT 'error', 'coverage_qa_count', NULL, q, 0.99 FROM cov UNION ALL SELECT 'error', 'coverage_SUE_EPS', NULL, s, 0.65 FROM cov UNION ALL SELECT 'error', 'min_pairs', NULL, (SELECT count(*) FROM pairs), {splits.MIN_PAIRS} UNION ALL SELECT 'error', 'min_folds', NULL, (SELECT count(DISTINCT fold) FROM fs), {splits.MIN_FOLDS} UNION ALL SELECT 'error', 'pair_id_repeated', NULL, 0, 0 UNION ALL SELECT 'error', 'orphan_pairs', NULL, -(SELECT count(*) FROM pairs WHERE call_id IS NULL OR call_id NOT IN (SELECT call_id FROM calls)), 0 UNION ALL SELECT 'error', CASE WHEN split = 'train' THEN 'train_pairs' ELSE 'eval_pairs' END, fold, p, CASE WHEN split = 'train' THEN {splits.MIN_TRAIN_PAIRS} ELSE {splits.MIN_EVAL_PAIRS} END FROM sz UNION ALL SELECT 'warning', 'train_coverage_pre_event_return', fold, a, 0.9 FROM tcov UNION ALL SELECT 'warning', 'train_coverage_qa_count', fold, q, 0.99 FROM tcov UNION ALL SELECT 'warning', 'train_coverage_SUE_EPS', fold, s, 0.65 FROM tcov) SELECT level, code, fold::BIGINT AS fold, round(value, 6) AS value, required FROM rules WHERE value < required")
def fold_validation(spark, d):
    """Broken rules of the training data: returns before the event, number of pairs and earnings surprise of every call, and its folds."""
    per = b.pairs(spark, d).groupBy("call_id").agg(F.count("*").alias("qa_count"))
    est, rep = F.col("estimated_eps"), F.col("reported_eps")
    sue = b.reports(spark, d).groupBy("ticker", "event_date").agg(F.max(F.when(est != 0, (rep - est) / F.abs(est))).alias("SUE_EPS"))
    c = _study(spark, d).select("call_id", "ticker", "event_date", F.col("pre_5").alias("pre_event_return")).join(per, "call_id", "left").join(sue, ["ticker", "event_date"], "left")
    v = splits.validate(c, b.pairs(spark, d), splits.rolling_splits(c, 100, 40, 40, 40), coverage=_COVERAGE)
    return rnd(big(v, "fold"), 6, "value")


# ---- pooling -----------------------------------------------------------------------------------------

_POOL = f"{SCORED}, ra AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pair_index) - 1 AS i, count(*) OVER (PARTITION BY call_id) AS n FROM scored WHERE score IS NOT NULL)"
_POOLED = "count(*) AS num_pairs, round(avg(score), 9) AS mean, max(score) AS max, round(median(score), 9) AS median, min(score) AS min, arg_min(score, i) AS first, arg_max(score, i) AS last, round(list_avg(list_reverse_sort(list(score))[1:3]), 9) AS top3_mean, round(list_avg(list_sort(list(score))[1:3]), 9) AS bottom3_mean, round(sum(score * CASE WHEN n > 1 THEN 1 + i / (n - 1) ELSE 1 END) / sum(CASE WHEN n > 1 THEN 1 + i / (n - 1) ELSE 1 END), 9) AS recency_weighted_mean"


@query(f"WITH {_POOL} SELECT call_id, {_POOLED} FROM ra GROUP BY call_id")
def score_pooling(spark, d):
    return rnd(pooling.pool(b.scored(spark, d), ["call_id"]), 9, "mean", "median", "top3_mean", "bottom3_mean", "recency_weighted_mean")


@query(f"WITH {_POOL} SELECT call_id, {_POOLED}, round(stddev_pop(score), 9) AS std, round(max(score) - min(score), 9) AS range, round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.75), 9) AS q75, round(quantile_cont(score, 0.9), 9) AS q90, round(avg(score) FILTER (WHERE i >= n - 3), 9) AS recent3_mean, round(arg_max(score, i) - arg_min(score, i), 9) AS last_minus_first, CASE WHEN count(*) < 2 OR max(score) - min(score) <= 1e-8 + 1e-5 * abs(arg_min(score, i)) THEN 0 ELSE round(regr_slope(score, i), 9) END AS trend_slope FROM ra GROUP BY call_id")
def rich_features(spark, d):
    return rnd(pooling.rich_features(b.scored(spark, d), ["call_id"]), 9, "mean", "median", "top3_mean", "bottom3_mean", "recency_weighted_mean", "std", "range", "q25", "q75", "q90", "recent3_mean", "last_minus_first", "trend_slope")


@query(f"WITH {_POOL} SELECT call_id, count(*) AS pair_count, round(avg(score), 9) AS mean_pair_residual, max(score) AS max_pair_residual, round(stddev_pop(score), 9) AS std_pair_residual, round(list_avg(list_reverse_sort(list(score))[1:3]), 9) AS topk_mean_pair_residual FROM ra GROUP BY call_id")
def residual_pooling(spark, d):
    return rnd(pooling.residual_pool(b.scored(spark, d), ["call_id"], "score"), 9, "mean_pair_residual", "std_pair_residual", "topk_mean_pair_residual")


@query(f"WITH {_POOL}, {CALLS}, a AS (SELECT call_id, avg(score) AS m FROM ra GROUP BY call_id) SELECT call_id, round(coalesce(m, 0), 9) AS mean_pair_residual FROM calls LEFT JOIN a USING (call_id)")
def attach_aggregates(spark, d):
    p = pooling.residual_pool(b.scored(spark, d), ["call_id"], "score")
    return rnd(pooling.attach(b.calls(spark, d).select("call_id"), p, ["mean_pair_residual"]), 9, "mean_pair_residual")


@query(f"WITH {CALLS}, cut AS (SELECT quantile_cont(car, 0.05) AS lo, quantile_cont(car, 0.95) AS hi FROM calls WHERE event_date < DATE '2020-01-01'), fit AS (SELECT avg(least(greatest(car, lo), hi)) AS mu, stddev_pop(least(greatest(car, lo), hi)) AS sd FROM calls, cut WHERE car IS NOT NULL AND event_date < DATE '2020-01-01') SELECT call_id, round((least(greatest(car, lo), hi) - mu) / CASE WHEN sd >= 1e-8 THEN sd ELSE 1 END, 6) AS transformed FROM calls, cut, fit WHERE car IS NOT NULL")
def winsor_transform(spark, d):
    c = b.calls(spark, d)
    return rnd(pooling.winsorise(c.where("event_date < date'2020-01-01' and car is not null"), c.where("car is not null"), "car"), 6, "transformed").select("call_id", "transformed")


_NUM = ("prior_momentum_20d", "volatility_60d", "beta_60d")


@query("WITH x AS (SELECT DISTINCT * FROM call_features) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) >= 1e-8 THEN stddev_pop(v) ELSE 1 END, 6) AS std FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS v FROM x)" for c in _NUM))
def scaler_stats(spark, d):
    return rnd(pooling.scaler(read_table(spark, d, "call_features").distinct(), list(_NUM)), 6, "median", "mean", "std")


@query(f"WITH {PREDICTIONS} SELECT call_id, round(CASE WHEN y = 1 THEN count(*) OVER () / (2 * sum(y) OVER ()) ELSE count(*) OVER () / (2 * sum(1 - y) OVER ()) END, 6) AS weight FROM pred")
def class_weights(spark, d):
    return rnd(pooling.class_weights(b.predictions(spark, d), "y"), 6, "weight").select("call_id", "weight")


@query(f"WITH {RECORDS}, n AS (SELECT CASE WHEN {_T} = '' THEN 0 ELSE len(string_split({_T}, ' ')) END AS n FROM records) SELECT count(*) AS texts, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, max(n)::BIGINT AS max, round(avg((n > 256)::INT), 6) AS share_over_256, round(avg((n > 512)::INT), 6) AS share_over_512, round(avg((n > 1024)::INT), 6) AS share_over_1024 FROM n")
def token_audit(spark, d):
    return rnd(big(pooling.token_audit(b.records(spark, d), "transcript"), "max"), 6, "mean", "p90", "p95", "share_over_256", "share_over_512", "share_over_1024")


# ---- metrics -----------------------------------------------------------------------------------------


@query(f"WITH {PREDICTIONS}, x AS (SELECT y, prob, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS rk FROM pred), c AS (SELECT prob, sum(y) AS p, count(*) AS n FROM pred GROUP BY prob), k AS (SELECT *, sum(p) OVER (ORDER BY prob DESC) AS tp, sum(n) OVER (ORDER BY prob DESC) AS seen FROM c) SELECT (SELECT count(*) FROM x) AS rows, (SELECT sum(y)::BIGINT FROM x) AS positives, round((SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) FROM x), 8) AS auroc, round((SELECT sum(p * tp / seen) / sum(p) FROM k), 8) AS auprc")
def auroc_auprc(spark, d):
    return rnd(metrics.roc_pr(b.predictions(spark, d), "y", "prob"), 8, "auroc", "auprc")


@query(f"WITH {PREDICTIONS} SELECT count(*) FILTER (WHERE prob < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE prob < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE prob >= 0.5 AND y = 1) AS tp, round(avg(((prob >= 0.5)::INT = y)::INT), 8) AS accuracy FROM pred")
def confusion_matrix(spark, d):
    return rnd(metrics.confusion(b.predictions(spark, d), "y", "prob"), 8, "accuracy")


@query(f"WITH {PREDICTIONS} SELECT round(sqrt(avg((car - score) ** 2)), 8) AS rmse, round(avg(abs(car - score)), 8) AS mae, round(avg((car - score) ** 2), 8) AS mse FROM pred")
def error_metrics(spark, d):
    return rnd(metrics.errors(b.predictions(spark, d), "car", "score"), 8, "rmse", "mae", "mse")


@query(f"WITH {PREDICTIONS}, x AS (SELECT car, score, rank() OVER (ORDER BY car) + (count(*) OVER (PARTITION BY car) - 1) / 2 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS z FROM pred) SELECT round(corr(car, score), 8) AS pearson, round(corr(a, z), 8) AS spearman FROM x")
def rank_corr(spark, d):
    return rnd(metrics.correlations(b.predictions(spark, d), "car", "score"), 8, "pearson", "spearman")


_BIN = " + ".join(f"(prob >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))


@query(f"WITH {PREDICTIONS}, x AS (SELECT {_BIN} AS b, count(*) AS n, avg(y) AS acc, avg(prob) AS conf, sum((y - prob) ** 2) AS se FROM pred GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 8) AS ece, round(sum(se) / sum(n), 8) AS brier FROM x")
def calibration_error(spark, d):
    return rnd(metrics.calibration_error(b.predictions(spark, d), "y", "prob"), 8, "ece", "brier")


@query(f"WITH {PREDICTIONS}, e AS (SELECT quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM pred) SELECT len([x FOR x IN e IF x <= prob])::BIGINT AS bin, count(*) AS rows, round(avg(prob), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive FROM pred, e GROUP BY 1")
def calibration_curve(spark, d):
    return rnd(big(metrics.calibration_curve(b.predictions(spark, d), "y", "prob"), "bin"), 6, "mean_predicted", "fraction_positive")


def _threshold_sql(score: str) -> str:
    grid = ", ".join(str(round(0.05 * i, 2)) for i in range(1, 20))
    return f"WITH {PREDICTIONS}, t AS (SELECT DISTINCT t FROM (SELECT prob AS t FROM pred UNION ALL SELECT unnest([{grid}, 0.25, 0.5, 0.75]::DOUBLE[]))), s AS (SELECT t, count(*) FILTER (WHERE prob >= t AND y = 1) AS tp, count(*) FILTER (WHERE prob >= t AND y = 0) AS fp, count(*) FILTER (WHERE prob < t AND y = 0) AS tn, count(*) FILTER (WHERE prob < t AND y = 1) AS fn FROM pred, t GROUP BY t), z AS (SELECT t, round({score}, 12) AS sc FROM s) SELECT t AS threshold, round(sc, 8) AS score FROM z ORDER BY sc DESC, round(abs(t - 0.5), 12), t LIMIT 1"


@query(_threshold_sql("(tp + tn) / (tp + tn + fp + fn)"))
def threshold_accuracy(spark, d):
    return rnd(metrics.select_threshold(b.predictions(spark, d), "y", "prob"), 8, "score")


@query(_threshold_sql("(tp / (tp + fn) + tn / (tn + fp)) / 2"))
def threshold_balanced(spark, d):
    return rnd(metrics.select_threshold(b.predictions(spark, d), "y", "prob", "balanced_accuracy"), 8, "score")


@query(_threshold_sql("2 * tp / (2 * tp + fp + fn)"))
def threshold_f1(spark, d):
    return rnd(metrics.select_threshold(b.predictions(spark, d), "y", "prob", "f1"), 8, "score")


@query()
def bootstrap_ci(spark, d):
    p = b.predictions(spark, d)
    hit = ((F.col("prob") >= 0.5).cast("int") == F.col("y")).cast("int")
    err = F.col("car") - F.col("score")
    sums = {"hit": hit, "square": err * err, "size": F.abs(err), "brier": F.pow(F.col("y") - F.col("prob"), 2)}
    return metrics.bootstrap(p, "call_id", sums, {"accuracy": lambda s: s["hit"] / s["n"], "rmse": lambda s: F.sqrt(s["square"] / s["n"]), "mae": lambda s: s["size"] / s["n"], "brier": lambda s: s["brier"] / s["n"]}, n_boot=400)


@query(f"WITH {PREDICTIONS} SELECT round(avg(((score >= 0) = (car > 0))::INT), 8) AS accuracy, round(sqrt(avg((car - score) ** 2)), 8) AS rmse, count(*) AS rows FROM pred")
def sign_evaluation(spark, d):
    p = b.predictions(spark, d)
    return p.agg(F.round(F.avg(((F.col("score") >= 0) == (F.col("car") > 0)).cast("int")), 8).alias("accuracy"), F.round(F.sqrt(F.avg(F.pow(F.col("car") - F.col("score"), 2))), 8).alias("rmse"), F.count("*").alias("rows"))



_LISTED = ("mean", "max", "median", "min", "first", "last", "top3_mean", "bottom3_mean", "recency_weighted_mean")
_RANKED = "rank() OVER (PARTITION BY pooling ORDER BY {0}) + (count(*) OVER (PARTITION BY pooling, {0}) - 1) / 2"


@query(f"WITH {_POOL}, {CALLS}, ag AS (SELECT call_id, {_POOLED} FROM ra GROUP BY call_id), l AS (UNPIVOT (SELECT a.* EXCLUDE (num_pairs), c.car, c.label::INT AS y FROM ag a JOIN calls c USING (call_id) WHERE c.car IS NOT NULL AND c.label IS NOT NULL) ON {', '.join(_LISTED)} INTO NAME pooling VALUE v), r AS (SELECT *, {_RANKED.format('v')} AS rv, {_RANKED.format('car')} AS rc FROM l), m AS (SELECT pooling, round(corr(rv, rc), 8) AS spearman, round((sum(rv) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auroc FROM r GROUP BY pooling) SELECT * FROM m ORDER BY spearman DESC, auroc DESC, list_position({list(_LISTED)!r}, pooling) LIMIT 1")
def pooling_leaderboard(spark, d):
    """The pooling whose call scores rank the abnormal returns best (Spearman, then AUROC of the label), out of all nine."""
    c = b.calls(spark, d).where("car is not null and label is not null").select("call_id", "car", F.col("label").cast("int").alias("y"))
    p = rnd(pooling.pool(b.scored(spark, d), ["call_id"]), 9, "mean", "median", "top3_mean", "bottom3_mean", "recency_weighted_mean").join(c, "call_id")
    long = p.select("call_id", "car", "y", *[F.col(x).cast("double").alias(x) for x in _LISTED]).unpivot(["call_id", "car", "y"], list(_LISTED), "pooling", "v")
    r = universe.average_rank(universe.average_rank(long, "v", "rv", ["pooling"]), "car", "rc", ["pooling"])
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    m = r.groupBy("pooling").agg(F.round(F.corr("rv", "rc"), 8).alias("spearman"), F.round((F.sum(F.when(F.col("y") == 1, F.col("rv"))) - pos * (pos + 1) / 2) / (pos * neg), 8).alias("auroc"))
    return metrics.leaderboard(m, "pooling", "spearman", "auroc", _LISTED)


# ---- models --------------------------------------------------------------------------------------------

_FEATURES = ["momentum_20", "volatility_60", "beta_60", "pre_5"]


def _modelled(spark, d):
    s = _study(spark, d).where("has_window").select("call_id", "event_date", F.col("car_horizon").alias("target"), *_FEATURES)
    return linear.residual_targets(s.where("event_date < date'2020-06-01'"), s, _FEATURES, "target")


@query()
def residual_targets(spark, d):
    return _modelled(spark, d)[0].select("call_id", "target", "baseline_pred", "residual_target")


@query()
def final_predictions(spark, d):
    m = _modelled(spark, d)[0]
    p = pooling.residual_pool(b.scored(spark, d), ["call_id"], "score")
    return linear.final_prediction(pooling.attach(m, p, ["mean_pair_residual"])).select("call_id", "target", "final_pred")


@query()
def logistic_calibration(spark, d):
    p = b.predictions(spark, d)
    return p.select("call_id", "y", linear.Calibrator().fit(p, "score", "y").predict().alias("probability"))


@query()
def boosted_classifier(spark, d):
    p = pooling.class_weights(b.predictions(spark, d).join(_study(spark, d).select("call_id", *_FEATURES), "call_id"), "y")
    return linear.boosted(p, ["score", *_FEATURES], "y", "weight", iterations=250).transform(p).select("call_id", "y", F.col("prediction").cast("int").alias("predicted"))


# ---- latents and rationales ------------------------------------------------------------------------------

_LAT = "WITH e AS (SELECT vec_id, (label >= 5)::INT AS y, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings), rp AS (SELECT feature, avg(z) AS mean_activation, CASE WHEN stddev_pop(z) < 1e-12 OR stddev_pop(y) < 1e-12 THEN 0 ELSE corr(z, y) END AS label_corr FROM e GROUP BY feature)"


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))


@query(_LAT + " SELECT feature::BIGINT AS feature, round(mean_activation, 6) AS mean_activation, round(label_corr, 6) AS label_corr FROM rp")
def feature_analysis(spark, d):
    return rnd(big(latent.feature_report(_vectors(spark, d), "embedding", "y"), "feature"), 6, "mean_activation", "label_corr")


#: A small autoencoder with weights by rule, so that SQL can say the same; a trained one takes its place.
_LATENTS = 16
_AE = f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
j AS (SELECT range AS j FROM range({_LATENTS})),
z AS (SELECT vec_id, j, greatest(sum(x * ((i * 7 + j * 13) % 11 - 5) / 50.0) + (j % 3 - 1) / 20.0, 0) AS z FROM x, j GROUP BY vec_id, j)"""


def _autoencoder(size: int):
    i, j = np.arange(size)[:, None], np.arange(_LATENTS)[None, :]
    return (((i * 7 + j * 13) % 11 - 5) / 50.0, (np.arange(_LATENTS) % 3 - 1) / 20.0), (((i * 5 + j * 3) % 7 - 3).T / 40.0, np.full(size, 0.01))


def _width(rows, vec: str) -> int:
    """The vectors' length, from one row."""
    first = rows.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return first[0] if first else 1


@query(_AE + ", m AS (SELECT j FROM z GROUP BY j ORDER BY round(avg(z), 12) DESC, j LIMIT 5), y AS (SELECT x.vec_id, x.i, any_value(x) AS x, sum(z * ((i * 5 + j * 3) % 7 - 3) / 40.0) + 0.01 AS a, sum(CASE WHEN j IN (SELECT j FROM m) THEN 0 ELSE z END * ((i * 5 + j * 3) % 7 - 3) / 40.0) + 0.01 AS b FROM x JOIN z USING (vec_id) GROUP BY x.vec_id, x.i) SELECT round(avg((a - x) ** 2), 8) AS mse_base, round(avg((b - x) ** 2), 8) AS mse_ablated, round(avg((b - x) ** 2) - avg((a - x) ** 2), 8) AS delta FROM y")
def feature_ablation(spark, d):
    """Reconstruction error of the autoencoder with and without its five strongest latents."""
    e = _vectors(spark, d)
    enc, dec = _autoencoder(_width(e, "embedding"))
    z = latent.encode(e, "embedding", *enc).select(F.posexplode("latent").alias("j", "z")).groupBy("j").agg(F.round(F.avg("z"), 12).alias("m"))
    strongest = [r["j"] for r in z.orderBy(F.desc("m"), "j").limit(5).collect()]
    return rnd(latent.ablation(e, "embedding", enc, dec, strongest), 8, "mse_base", "mse_ablated", "delta")


@query(_LAT + ", t AS (SELECT feature FROM rp ORDER BY abs(label_corr) DESC, feature LIMIT 20), s AS (SELECT vec_id, y, avg(z) AS s FROM e WHERE feature IN (SELECT feature FROM t) GROUP BY ALL) SELECT round(corr(s, y), 6) AS label_alignment_corr FROM s")
def label_alignment(spark, d):
    return rnd(latent.label_alignment(_vectors(spark, d), "embedding", "y"), 6, "label_alignment_corr")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_alignment(spark, d):
    e = read_table(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(attribution.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(_AE + ", y AS (SELECT x.vec_id, x.i, any_value(x) AS x, sum(z * ((i * 5 + j * 3) % 7 - 3) / 40.0) + 0.01 AS a FROM x JOIN z USING (vec_id) GROUP BY x.vec_id, x.i), l AS (SELECT vec_id, sum((a - x) ** 2) AS err FROM y GROUP BY vec_id) SELECT vec_id, count(*) FILTER (WHERE z > 0) AS active, round(sum(z), 6) AS mass, round(any_value(err), 6) AS error FROM z JOIN l USING (vec_id) GROUP BY vec_id")
def sae_forward(spark, d):
    """Latents that fire, their mass (the sparsity term) and the squared reconstruction error of every vector."""
    e = read_table(spark, d, "embeddings")
    enc, dec = _autoencoder(_width(e, "embedding"))
    r = latent.reconstruct(latent.encode(e, "embedding", *enc), "embedding", enc, dec)
    return r.select("vec_id", F.size(F.filter("latent", lambda x: x > 0)).cast("bigint").alias("active"), F.round(F.aggregate("latent", F.lit(0.0), lambda a, x: a + x), 6).alias("mass"), F.round(latent.reconstruction_error(r, "embedding", "decoded"), 6).alias("error"))


#: A stand-in for a model: kept letters over all letters.
linear_scorer = attribution.Additive(F.length)


_TOK = rf"{PAIRS}, tk AS (SELECT pair_id, [x FOR x IN string_split(lower({norm_sql('answer_text')}), ' ') IF x <> ''] AS t FROM pairs), tl AS (SELECT pair_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i, len(t) AS n FROM tk WHERE len(t) >= 1), ts AS (SELECT *, length(w) % 7 + (i % 3) * 0.25 AS s, length(w)::DOUBLE AS l FROM tl), tr AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY s DESC, i DESC) AS rk, sum(l) OVER (PARTITION BY pair_id) AS tot FROM ts)"


@query(f"WITH {_TOK} SELECT pair_id, list(i::INT ORDER BY i) AS rationale FROM tr WHERE rk <= 5 GROUP BY pair_id")
def topk_rationale(spark, d):
    return b.tokens(spark, d).select("pair_id", attribution.topk(F.col("tokens"), F.col("scores"), 5).alias("rationale"))


@query(f"WITH {_TOK} SELECT pair_id, round(sum(CASE WHEN rk <= 5 THEN l ELSE 0 END) / max(tot), 6) AS comprehensiveness, round(1 - sum(CASE WHEN rk <= 5 THEN l ELSE 0 END) / max(tot), 6) AS sufficiency FROM tr GROUP BY pair_id")
def comp_suff(spark, d):
    return rnd(attribution.faithfulness(b.tokens(spark, d), linear_scorer, 5), 6, "comprehensiveness", "sufficiency").select("pair_id", "comprehensiveness", "sufficiency")


@query(f"WITH {_TOK}, st AS (SELECT pair_id, k / 10 AS f, sum(CASE WHEN rk > round_even(k / 10 * n, 0) THEN l ELSE 0 END) / max(tot) AS sc FROM tr, range(0, 11) r(k) GROUP BY pair_id, k), tz AS (SELECT pair_id, (f - lag(f) OVER w) * (sc + lag(sc) OVER w) / 2 AS a FROM st WINDOW w AS (PARTITION BY pair_id ORDER BY f)) SELECT pair_id, round(sum(a), 6) AS auc FROM tz GROUP BY pair_id")
def deletion_auc(spark, d):
    return rnd(attribution.curve_area(attribution.deletion_curve(b.tokens(spark, d), "pair_id", linear_scorer), "pair_id"), 6, "auc")


@query(f"WITH {_TOK} SELECT pair_id, i::BIGINT AS position, round(l / tot, 6) AS importance FROM tr")
def perturbation(spark, d):
    return rnd(big(attribution.perturbation(b.tokens(spark, d), "pair_id", linear_scorer), "position"), 6, "importance")


@query()
def random_rationale(spark, d):
    return attribution.random_baseline(b.tokens(spark, d), "pair_id", linear_scorer, 5, trials=25)


@query(f"WITH {_TOK}, mm AS (SELECT pair_id, i, CASE WHEN max(s) OVER w - min(s) OVER w <= 1e-12 THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS v FROM ts WINDOW w AS (PARTITION BY pair_id)) SELECT pair_id, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM mm GROUP BY pair_id")
def minmax_scores(spark, d):
    m = attribution.minmax(F.col("scores"))
    return b.tokens(spark, d).select("pair_id", F.round(F.aggregate(m, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max(m), 6).alias("top"))


@query(f"WITH {_TOK} SELECT pair_id, string_agg(w, ' ' ORDER BY i) AS packed FROM tl WHERE n <= 12 OR i < 6 OR i >= n - 6 GROUP BY pair_id")
def head_tail(spark, d):
    return b.tokens(spark, d).select("pair_id", F.array_join(attribution.head_tail(F.col("tokens"), 12), " ").alias("packed"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_totals(spark, d):
    return rnd(windows.windowed_totals(read_table(spark, d, "events")), 4, "total")


# ---- composites ---------------------------------------------------------------------------------


@query("WITH sh AS (" + _S["shares_asof"] + "), cl AS (" + _S["strict_prev_close"] + "), x AS (SELECT sh.call_id, sh.ticker, sh.event_date, shares, close, shares * close AS cap FROM sh LEFT JOIN cl USING (call_id)) SELECT call_id, ticker, event_date, shares, close, round(cap, 2) AS hist_market_cap, round(ln(cap), 8) AS hist_log_market_cap, CASE WHEN cap IS NOT NULL THEN round((rank() OVER (ORDER BY cap) + (count(*) OVER (PARTITION BY cap) - 1) / 2) / count(cap) OVER (), 8) END AS hist_market_cap_percentile FROM x")
def market_caps(spark, d):
    return rnd(rnd(pipelines.market_caps(shares_asof(spark, d), strict_prev_close(spark, d)), 8, "hist_log_market_cap", "hist_market_cap_percentile"), 2, "hist_market_cap")


@query(f"WITH {PAIRS} SELECT call_id, concat_ws('::', call_id, coalesce(pair_index, 0)) AS pair_id, coalesce(pair_index, 0) AS pair_index, coalesce(question_text, '') AS question_text, coalesce(answer_text, '') AS answer_text FROM pairs")
def pair_level(spark, d):
    return pipelines.pair_level(b.pairs(spark, d))


@query(f"WITH {PAIRS}, {CALLS} SELECT pair_id, ticker, event_date, car FROM (SELECT pair_id, call_id FROM pairs) JOIN calls USING (call_id)")
def pair_call_fields(spark, d):
    return pipelines.call_fields_in_pairs(b.pairs(spark, d).select("pair_id", "call_id"), b.calls(spark, d), ["ticker", "event_date", "car"]).select("pair_id", "ticker", "event_date", "car")


_SEQ = ("question_char_len", "answer_char_len")


@query(f"WITH {PAIRS}, st AS (SELECT avg(question_char_len) AS qm, stddev_pop(question_char_len) AS qs, avg(answer_char_len) AS am, stddev_pop(answer_char_len) AS sd FROM pairs WHERE event_date < DATE '2020-01-01') SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY pair_index, (question_char_len - qm) / qs NULLS FIRST, (answer_char_len - am) / sd NULLS FIRST) - 1 AS position, round((question_char_len - qm) / qs, 6) AS z_question, round((answer_char_len - am) / sd, 6) AS z_answer FROM pairs, st")
def call_sequences(spark, d):
    p = b.pairs(spark, d)
    st = {r["column"]: (r["mean"], r["std"]) for r in pooling.scaler(p.where("event_date < date'2020-01-01'"), list(_SEQ)).collect()}
    q = pipelines.call_sequences(p, list(_SEQ), st).select("call_id", F.posexplode("features").alias("position", "z"))
    return q.select("call_id", F.col("position").cast("bigint").alias("position"), F.round(F.col("z")[0], 6).alias("z_question"), F.round(F.col("z")[1], 6).alias("z_answer"))


@query(f"WITH {_ANNOTATED} SELECT a.call_id, round(avg(p.question_char_len), 6) AS pair_question_chars_mean, max(p.question_char_len)::BIGINT AS pair_question_chars_max, round(avg(a.answer_char_len), 6) AS pair_answer_chars_mean, max(a.answer_char_len)::BIGINT AS pair_answer_chars_max, round(avg(a.num_answer_turns), 6) AS pair_answer_turns_mean, max(a.num_answer_turns)::BIGINT AS pair_answer_turns_max, round(avg(answer_has_management_role::INT), 6) AS management_answer_rate, round(avg(answer_has_mixed_roles::INT), 6) AS mixed_answer_rate, round(avg(analyst_only::INT), 6) AS analyst_only_answer_rate, round(avg(answer_contains_question_mark::INT), 6) AS answer_question_mark_rate FROM ann a JOIN pairs p USING (pair_id) GROUP BY a.call_id")
def text_features(spark, d):
    t = pipelines.text_features(pairing.annotate(b.pairs(spark, d)))
    return rnd(big(t, *[c for c in t.columns if c.endswith("_max")]), 6, *[c for c, k in t.dtypes if k == "double"])


@query("WITH cs AS (" + _S["comp_suff"] + "), da AS (" + _S["deletion_auc"] + ") SELECT 'scores' AS method, count(*) AS rows, round(avg(comprehensiveness), 4) AS comprehensiveness, round(avg(sufficiency), 4) AS sufficiency, round(avg(auc), 4) AS deletion_auc FROM cs JOIN da USING (pair_id)")
def explanation_means(spark, d):
    m, _ = pipelines.explain(b.tokens(spark, d), "pair_id", {"scores": lambda r: r}, linear_scorer, 5)
    return rnd(pipelines.method_means(m), 4, "comprehensiveness", "sufficiency", "deletion_auc")


@query()
def explanation_curves(spark, d):
    """Mean deletion curves of two ways to score tokens: given scores, and integrated gradients of the scorer."""
    ways = {"scores": lambda r: r, "integrated_gradients": lambda r: r.withColumn("scores", pipelines.integrated_gradients(F.col("tokens"), linear_scorer))}
    return rnd(pipelines.mean_curves(pipelines.explain(b.tokens(spark, d), "pair_id", ways, linear_scorer, 5)[1]), 6, "score")


@query("WITH q AS (" + _S["qa_extract"] + "), e AS (" + _S["event_car"] + "), sp AS (" + _S["time_split"] + f"), {RECORDS}, r AS (SELECT record_key AS call_id FROM records) SELECT count(*) AS rows FROM q JOIN e USING (call_id) JOIN r USING (call_id) WHERE has_window AND text <> ''")
def model_ready_rows(spark, d):
    """How many parsed records have question text and a return window of their own."""
    q = pairing.extract_questions(b.turns(spark, d)).select("call_id", "text", "num_questions")
    return pipelines.model_ready(q, _study(spark, d).select("call_id", "event_date", "car_horizon", F.col("label"), "has_window"), splits.time_split(b.calls(spark, d))).agg(F.count("*").alias("rows"))


@query()
def parse_layouts(spark, d):
    """Turns by the layout of each record: segments, ruled sections, else colon lines."""
    r = b.records(spark, d)
    layout = F.when(F.size(F.coalesce("structured_content", F.array())) > 0, "structured").when(F.col("transcript").rlike("-{20,}"), "sections")
    return pipelines.parse_by_source(r, "record_key", "transcript", "structured_content", layout)[1]


def _ladder(spark, d):
    c = _study(spark, d).where("has_window").select("call_id", "event_date", F.col("car_horizon").alias("target"), "label", *_FEATURES)
    m = pooling.residual_pool(b.scored(spark, d), ["call_id"], "score")
    return materialise(pooling.attach(c, m, ["mean_pair_residual", "max_pair_residual"]), "ladder")


@query()
def benchmark_ladder(spark, d):
    """Out-of-fold measures of price, text and joint ridges, with their differences to the price rung."""
    c = _ladder(spark, d)
    rungs = {"price": _FEATURES, "text": ["mean_pair_residual", "max_pair_residual"], "price_text": [*_FEATURES, "mean_pair_residual", "max_pair_residual"]}
    n = c.count()
    f = splits.rolling_splits(c, max(n // 2, 1), max(n // 10, 1), max(n // 10, 1), max(n // 5, 1))
    t = pipelines.benchmark_table(pipelines.benchmark_ladder(c, f, rungs, "target", "label"))
    return pipelines.deltas(t, "price", ["auroc", "auprc", "accuracy", "spearman"])


@query()
def residual_pipeline(spark, d):
    """Mean over folds and splits of the final predictions' measures: baseline, pair residuals, pooled and added."""
    c = _ladder(spark, d).drop("mean_pair_residual", "max_pair_residual")
    n = c.count()
    f = splits.rolling_splits(c, max(n // 2, 1), max(n // 10, 1), max(n // 10, 1), max(n // 5, 1))
    p = materialise(b.pairs(spark, d).select("call_id", "pair_id", "question_char_len", "answer_char_len", "num_answer_turns"), "pairs")
    r = pipelines.residual_pipeline(c, p, f, _FEATURES, ["question_char_len", "answer_char_len", "num_answer_turns"], "target")
    by = pipelines.fold_metrics(r, "target", ["fold", "split"])
    return by.groupBy("split").agg(F.count("*").alias("folds"), *[F.avg(x).alias(x) for x in ("rows", "sign_accuracy", "rmse", "mae")])


def queries() -> dict[str, Callable]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
