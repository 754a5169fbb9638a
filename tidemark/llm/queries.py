"""Queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.llm import abuse, components, defects, mixing, nearest, packing, survivor, turns


def queries() -> dict[str, Callable]:
    return {
        f.__name__: f
        for f in (
            turns.p2_found, turns.p2_turns,
            components.p3_found, components.p3_splits, components.p3_shares, components.p3_assigned, components.p3_incremental,
            defects.p5_found, defects.p5_rates,
            nearest.p6_found, nearest.p6_matched,
            survivor.p7_found, survivor.p7_golden,
            packing.p8_packing, packing.p8_fill,
            mixing.p9_mixture, mixing.p9_shares,
            abuse.p10_found, abuse.p10_scores, abuse.p10_rates,
        )
    }


def _canon(x: str) -> str:
    return (
        "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(" + x + r")), '^\$+\s*', ''), '^[A-Z]{2,10}\s*:\s*', ''), "
        r"'[\s.](US|UN|UW|UQ|LN|GR|FP|JP)(\s+EQUITY)?$', ''), '[\s/_\-.]+', '.', 'g'), '^\.+|\.+$', '', 'g'), '')"
    )


def oracle_sql() -> dict[str, str]:
    t = _canon("ticker")
    cik = r"nullif(regexp_replace(regexp_replace(regexp_replace(trim(cik), '\.0+$', ''), '[^0-9]', '', 'g'), '^0+', ''), '')"
    graph = f"""
WITH RECURSIVE k AS (
  SELECT 'cik:' || {cik} AS k, {t} AS t FROM universe WHERE {cik} IS NOT NULL
  UNION SELECT 'call:' || call_id, {t} FROM call_features WHERE call_id IS NOT NULL
  UNION SELECT 'call:' || call_id, {t} FROM qa_pairs WHERE call_id IS NOT NULL),
e AS (
  SELECT DISTINCT a.t AS a, b.t AS b FROM k a JOIN k b ON a.k = b.k AND a.t <> b.t
  UNION SELECT {t}, {_canon('former_ticker')} FROM universe WHERE former_ticker IS NOT NULL
  UNION SELECT {_canon('former_ticker')}, {t} FROM universe WHERE former_ticker IS NOT NULL),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
u AS (SELECT DISTINCT {t} AS t FROM universe)"""
    latest_calls = f"(SELECT call_id, max_by({t}, updated_at) AS tk, max_by(call_ts, updated_at) AS ts FROM call_features WHERE call_id IS NOT NULL GROUP BY call_id)"
    latest_reports = f"(SELECT source_event_id, max_by({t}, ingested_at) AS tk, max_by(source_event_ts, ingested_at) AS ts FROM external_events WHERE source_event_ts IS NOT NULL AND source_event_id IS NOT NULL GROUP BY source_event_id)"
    return {
        "p3_found": graph + " SELECT a AS ticker_a, b AS ticker_b FROM r WHERE a < b AND a IN (SELECT t FROM u) AND b IN (SELECT t FROM u)",
        "p6_found": f"""
SELECT call_id, source_event_id FROM (
  SELECT call_id, source_event_id, row_number() OVER (PARTITION BY call_id ORDER BY abs(epoch_us(r.ts) - epoch_us(c.ts)), r.ts, CAST(source_event_id AS VARCHAR)) AS rn
  FROM {latest_calls} c JOIN {latest_reports} r USING (tk) WHERE abs(epoch_us(r.ts) - epoch_us(c.ts)) <= 72 * 3600 * 1000000::BIGINT) WHERE rn = 1""",
    }
