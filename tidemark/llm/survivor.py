"""One surviving record per duplicate group, and the best known value of every field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_ticker, parse_day, squeeze
from tidemark.llm.components import connected_components, star_edges
from tidemark.llm.turns import parse_records
from tidemark.session import materialise, read_table

FIELDS = ("ticker", "day", "company", "call_year", "call_quarter")
#: Ranking runs in two windows: within SALTS parts of a group, then over the parts' winners, so that no group is sorted in one task.
SALTS = 64


def latest_records(records: DataFrame) -> DataFrame:
    """One narrow row per ``record_key``, its latest delivery: cleaned key fields and the fingerprint of the wording.

    Texts are read and fingerprinted where they lie; they are not exchanged.
    Null keys are left out; deliveries of the same time are told apart by their values.
    """
    keep = ["record_key", "ingested_at", "quality_score", "transcript_chars", "ticker", "event_date", "company", "call_year", "call_quarter", "source_priority"]
    parsed = parse_records(records.where("record_key is not null"), keep, with_text=False, with_wording=True)
    rows = parsed.select(
        "record_key", F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))).alias("ingested_at"), F.col("quality_score").cast("double").alias("quality_score"),
        F.col("transcript_chars").cast("double").alias("transcript_chars"), canonical_ticker(F.col("ticker")).alias("ticker"), parse_day(F.col("event_date")).alias("day"),
        F.nullif(squeeze(F.col("company")), F.lit("")).alias("company"), "call_year", "call_quarter", "source_priority", "wording", F.size("turns").alias("turns"),
    )
    rows = rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("quality_score", "transcript_chars")})
    body = [c for c in rows.columns if c not in ("record_key", "ingested_at")]
    return rows.groupBy("record_key").agg(F.max(F.struct("ingested_at", *body)).alias("r")).select("record_key", "r.*")


def call_groups(latest: DataFrame) -> DataFrame:
    """``latest`` with ``call``: the smallest record key of its group.

    Records hold one call if they agree in ticker and day or say the same words,
    directly or through a chain; a record linked with no other is its own group.
    """
    keys = latest.select("record_key", F.when(F.col("ticker").isNotNull() & F.col("day").isNotNull(), F.concat_ws("|", F.lit("d"), "ticker", F.col("day").cast("string"))).alias("k")).unionByName(
        latest.select("record_key", F.concat(F.lit("w|"), "wording").alias("k"))
    )
    roots = connected_components(star_edges(keys, "k", "record_key"))
    return latest.join(roots.withColumnRenamed("node", "record_key"), "record_key", "left").select(*latest.columns, F.coalesce("root", "record_key").alias("call"))


def rank_order() -> list:
    """Trust, completeness, then the smallest key: a total order."""
    return [F.desc_nulls_last("quality_score"), F.desc_nulls_last("transcript_chars"), F.asc("record_key")]


def survivors(grouped: DataFrame) -> DataFrame:
    """(call, record_key, copies) of the top record of every group of two or more distinct record keys."""
    salted = grouped.withColumn("salt", F.pmod(F.xxhash64("record_key"), F.lit(SALTS)))
    part = Window.partitionBy("call", "salt")
    first = salted.withColumn("n", F.count("*").over(part)).withColumn("rn", F.row_number().over(part.orderBy(*rank_order()))).where("rn = 1")
    whole = Window.partitionBy("call")
    top = first.withColumn("copies", F.sum("n").over(whole)).withColumn("rn", F.row_number().over(whole.orderBy(*rank_order())))
    return top.where("rn = 1 and copies > 1").select("call", "record_key", "copies")


def golden_fields(grouped: DataFrame) -> DataFrame:
    """Per group the best known value of every field: of the best ranked record that has one.

    ``transcript_key`` names the best ranked record with spoken words, and among
    those the one with the most turns wins, so that a cut-off copy never stands in for a whole one.
    """
    def order():
        return F.struct((-F.coalesce("quality_score", F.lit(-1e300))).alias("q"), (-F.coalesce("transcript_chars", F.lit(-1e300))).alias("c"), F.col("record_key"))

    best = [F.min_by(f, F.when(F.col(f).isNotNull(), order())).alias(f) for f in FIELDS]
    text = F.min_by("record_key", F.when(F.col("turns") > 0, F.struct((-F.col("turns")).alias("t"), order().alias("o")))).alias("transcript_key")
    return grouped.groupBy("call").agg(F.min(order()).alias("top"), F.count("*").alias("copies"), *best, text).select("call", F.col("top.record_key").alias("record_key"), "copies", *FIELDS, "transcript_key")


def _grouped(spark, sf_dir):
    return call_groups(materialise(latest_records(read_table(spark, sf_dir, "transcript_record")), "latest"))


def p7_found(spark, sf_dir):
    return survivors(_grouped(spark, sf_dir)).select("record_key")


def p7_golden(spark, sf_dir):
    """One record per call with the best known fields and the whole best text.

    The winners are known first, by keys alone; only the texts of their latest delivery are exchanged.
    """
    g = materialise(golden_fields(_grouped(spark, sf_dir)), "golden")
    at = F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0)))
    rows = read_table(spark, sf_dir, "transcript_record").where("record_key is not null").join(g.select(F.col("transcript_key").alias("record_key")).where("record_key is not null"), "record_key", "left_semi")
    last = rows.groupBy("record_key").agg(F.max(at).alias("__at"))
    rows = rows.select("record_key", at.alias("__at"), "transcript", "structured_content").join(last, ["record_key", "__at"], "left_semi")
    texts = rows.groupBy(F.col("record_key").alias("transcript_key")).agg(F.any_value(F.struct("transcript", "structured_content")).alias("t"))
    return g.join(texts, "transcript_key", "left").select(*g.columns, "t.transcript", "t.structured_content")
