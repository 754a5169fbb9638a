"""Curation of a text corpus: record metrics, quality, de-duplication, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_ticker, normalize_text, parse_day, regex_count, text_hash

# Fixed values.
QA_SECTION = r"(?i)(question[- ]and[- ]answer|questions? and answers?|q\s*&\s*a|question[- ]and[- ]answer session)"
ANALYST = r"(?i)\banalyst\b"
MANAGEMENT = r"(?i)\b(ceo|cfo|coo|chief|president|executive|management|operator)\b"
VALID_TICKER = r"^[A-Z][A-Z0-9.\-]{0,9}$"
OPERATOR = r"(?i)\boperator\b"
FOLLOW_UP = r"(?i)\b(question|follow[- ]up)\b"
MAX_QUESTIONS = 50
MIN_CHARS, MIN_QUESTIONS = 5000, 2
RANK = ("quality_score", "has_qa_section", "analyst_question_count", "transcript_chars", "has_structured_content", "source_priority")


def qa_excerpt(text: Column) -> Column:
    """From the first mention of the question session to the end; empty without one."""
    return F.regexp_extract(text, rf"(?s)({QA_SECTION}.*)$", 1)


def structured_questions(segments: Column) -> Column:
    """Questions behind the segment that opens the session: of analysts, or with a question mark and not of management."""
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        who, said = normalize_text(s["speaker"]), normalize_text(s["text"])
        opens = F.concat_ws(" ", who, said).rlike(QA_SECTION)
        asks = who.rlike(ANALYST) | (said.contains("?") & ~who.rlike(MANAGEMENT))
        return F.struct((acc["open"] | opens).alias("open"), (acc["n"] + (acc["open"] & asks).cast("int")).alias("n"))

    return F.aggregate(F.coalesce(segments, F.array().cast("array<struct<speaker:string,text:string>>")), start, step, lambda a: a["n"])


def question_count(text: Column, segments: Column) -> Column:
    """The structured count, else question marks, else keywords of the excerpt, at most MAX_QUESTIONS."""
    excerpt = qa_excerpt(text)
    marks, words = regex_count(excerpt, r"\?"), regex_count(excerpt, FOLLOW_UP)
    n = structured_questions(segments)
    return F.when(n > 0, n).when(marks > 0, F.least(marks, F.lit(MAX_QUESTIONS))).otherwise(F.least(words, F.lit(MAX_QUESTIONS))).cast("int")


def record_metrics(records: DataFrame) -> DataFrame:
    """Lengths, counts, validity and fingerprint of each record; null texts count as empty."""
    r = records.withColumns({"__t": normalize_text(F.col("transcript")), "ticker": canonical_ticker(F.col("ticker")), "event_date": parse_day(F.col("event_date"))})
    t = F.col("__t")
    chars = F.length(t)
    n = question_count(t, F.col("structured_content"))
    ops = regex_count(t, OPERATOR)
    return r.select(
        "record_key", "source_id", "source_file", "source_row", "ticker", "event_date", normalize_text(F.col("company")).alias("company"),
        chars.alias("transcript_chars"), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).alias("transcript_words"), text_hash(t).alias("text_hash"),
        ((qa_excerpt(t) != "") | (n > 0)).cast("int").alias("has_qa_section"), n.alias("analyst_question_count"),
        F.col("ticker").isNull().cast("int").alias("missing_ticker"), F.col("event_date").isNull().cast("int").alias("missing_event_date"),
        F.coalesce(F.col("ticker").rlike(VALID_TICKER), F.lit(False)).cast("int").alias("valid_ticker"), F.col("event_date").isNotNull().cast("int").alias("valid_event_date"),
        (F.coalesce(F.size("structured_content"), F.lit(0)) > 0).cast("int").alias("has_structured_content"), ops.alias("operator_mentions"), (ops >= 5).cast("int").alias("repeated_operator_text"),
        F.round(regex_count(t, r"[^\x00-\x7F]") / F.greatest(chars, F.lit(1)), 6).alias("non_ascii_ratio"), F.coalesce("source_priority", F.lit(0)).alias("source_priority"),
    )


def quality_score() -> Column:
    return (
        F.col("has_qa_section") * 100 + F.least("analyst_question_count", F.lit(10)) * 10 + F.col("has_structured_content") * 20 + F.col("valid_ticker") * 20 + F.col("valid_event_date") * 20 + F.col("source_priority")
        + F.floor(F.least("transcript_chars", F.lit(200000)) / 5000) - F.col("repeated_operator_text") * 10 - (F.col("non_ascii_ratio") > 0.05).cast("int") * 10
    ).cast("long")


def deduplicate(metrics: DataFrame) -> DataFrame:
    """Adds quality_score, drop_reason and duplicate_of: first equal texts, then equal ticker and day among what is left.

    The best record of a group is its least by (quality, ..., record_key); it is found by
    an aggregate that combines before the exchange and joined back, so a group of any size
    is never sorted in one task. Keys with nulls are no duplicates.
    """
    m = metrics.withColumn("quality_score", quality_score())
    order = F.struct(*[(-F.col(c)).alias(c) for c in RANK], F.col("record_key"))
    text = m.where("text_hash is not null").groupBy("text_hash").agg(F.min(order)["record_key"].alias("__best"))
    m = m.join(text, "text_hash", "left").withColumn("__text", F.coalesce(F.col("__best") != F.col("record_key"), F.lit(False)))
    day = m.where("not __text and ticker is not null and event_date is not null").groupBy("ticker", "event_date").agg(
        F.min(order)["record_key"].alias("__best2"), F.min("transcript_chars").alias("__low"), F.max("transcript_chars").alias("__high"), F.count("*").alias("__n")
    ).where("__n > 1")
    m = m.join(day, ["ticker", "event_date"], "left")
    low = F.greatest("__low", F.lit(1))
    second = ~F.col("__text") & F.col("__best2").isNotNull() & (F.col("__best2") != F.col("record_key"))
    reason = F.when(F.col("__text"), "exact_text_duplicate").when(second & ((F.col("__high") - low) / low <= 0.15), "version_duplicate").when(second, "ticker_date_duplicate").otherwise("")
    return m.select(*metrics.columns, "quality_score", reason.alias("drop_reason"), F.when(F.col("__text"), F.col("__best")).when(second, F.col("__best2")).otherwise("").alias("duplicate_of"))


def quality_filters(deduped: DataFrame, min_chars: int = MIN_CHARS, min_questions: int = MIN_QUESTIONS) -> DataFrame:
    """Adds keep_clean_master, keep_gold, hard_filter_failures and soft_quality_flags."""
    clean = (F.col("drop_reason") == "") & (F.col("transcript_chars") > 0) & (F.col("valid_ticker") == 1) & (F.col("valid_event_date") == 1)
    gold = clean & (F.col("has_qa_section") == 1) & (F.col("transcript_chars") >= min_chars) & (F.col("analyst_question_count") >= min_questions)
    hard = [F.when(F.col("drop_reason") != "", F.col("drop_reason")), F.when(F.col("valid_ticker") != 1, "invalid_ticker"), F.when(F.col("valid_event_date") != 1, "invalid_event_date"), F.when(F.col("has_qa_section") != 1, "missing_qa"), F.when(F.col("transcript_chars") < min_chars, "short_transcript"), F.when(F.col("analyst_question_count") < min_questions, "too_few_analyst_questions")]
    soft = [F.when(F.col("analyst_question_count") < max(min_questions + 1, 4), "low_question_count"), F.when(F.col("repeated_operator_text") == 1, "repeated_operator_text"), F.when(F.col("non_ascii_ratio") > 0.05, "high_non_ascii_ratio")]
    return deduped.withColumns({"keep_clean_master": clean, "keep_gold": gold, "hard_filter_failures": F.array_join(F.array_distinct(F.array_compact(F.array(*hard))), ","), "soft_quality_flags": F.array_join(F.array_compact(F.array(*soft)), ",")})


def stage_counts(filtered: DataFrame) -> DataFrame:
    """(stage, records): the funnel from raw to gold in one pass."""
    one = filtered.agg(F.count("*").alias("raw_records"), F.count_if(F.col("drop_reason") == "").alias("after_dedup"), F.count_if("keep_clean_master").alias("clean_master"), F.count_if("keep_gold").alias("gold"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("records")) for c in one.columns])).alias("x")).select("x.*")


def duplicate_flags(metrics: DataFrame) -> DataFrame:
    """Adds duplicate_text and duplicate_ticker_date (0/1); null keys are never duplicates."""
    t = metrics.where("text_hash is not null").groupBy("text_hash").agg((F.count("*") > 1).cast("int").alias("duplicate_text"))
    d = metrics.where("ticker is not null and event_date is not null").groupBy("ticker", "event_date").agg((F.count("*") > 1).cast("int").alias("duplicate_ticker_date"))
    return metrics.join(t, "text_hash", "left").join(d, ["ticker", "event_date"], "left").fillna(0, ["duplicate_text", "duplicate_ticker_date"])


def audit_rollup(flagged: DataFrame) -> DataFrame:
    """Per source and for ALL: counts, shares and length percentiles, by one rollup."""
    pct = lambda c, p: F.percentile(c, p).cast("bigint")
    out = flagged.where("source_id is not null").rollup("source_id").agg(
        F.grouping("source_id").alias("__g"), F.count_distinct("source_file").alias("num_files"), F.count("*").alias("num_records"), F.sum("duplicate_text").alias("duplicate_text_records"), F.sum("duplicate_ticker_date").alias("duplicate_ticker_date_records"),
        F.sum("missing_ticker").alias("missing_ticker_records"), F.sum("missing_event_date").alias("missing_event_date_records"), F.sum("has_qa_section").alias("qa_detectable_records"), F.round(F.avg("has_qa_section"), 4).alias("qa_detectable_share"),
        *[pct(c, p).alias(f"{c}_p{int(p * 100)}") for c in ("transcript_chars", "transcript_words") for p in (0.1, 0.5, 0.9)],
    )
    return out.select(F.when(F.col("__g") == 1, "ALL").otherwise(F.col("source_id")).alias("source_id"), *[c for c in out.columns if c not in ("source_id", "__g")])
