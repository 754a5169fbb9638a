"""Transcripts into turns: layout splitters, the start of the questions, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_text

# Cues and patterns.
SPEAKER = r"(?<!\w)((?:Operator|Unknown Speaker|[A-Z][A-Za-z0-9&.'\-/]+(?: [A-Z][A-Za-z0-9&.'\-/]+){0,5}))\s*:\s+"
HEADING = r"(?i)Questions? and Answers?"
STRONG_CUE = r"(?i)(question[- ]and[- ]answer|questions? and answers?|q\s*&\s*a|we will now (?:begin|open|start|take)|take your questions|question and answer session|questions from analysts|operator instructions)"
ACTUAL_CUE = r"(?i)(move on to the q&a|move over to q&a|we(?:'ll| will) now (?:begin|start|take|open)|repeat your instructions|first question|question comes from|please proceed with your question|\[operator instructions\])"
PARTICIPANT = r"([A-Z][A-Za-z.'\-]+(?: [A-Z][A-Za-z.'\-]+){1,3})\s*-\s*"
ROLE_HINT = r"(?i)\b(analyst|research|capital|securities|partners|bank|morgan|goldman|barclays|ubs|jp ?morgan)\b"
ANALYST_BLOCK_ENDS = ("Operator", "Executives", "Presentation", "Corporate Participants", "Conference Call Participants")
EXECUTIVE_BLOCK_ENDS = ("Analysts", "Operator", "Presentation", "Corporate Participants", "Conference Call Participants")
FALLBACK_FROM = 3


def speaker_key(c: Column) -> Column:
    return F.lower(normalize_text(c))


def named_block(text: Column, label: str, ends: tuple[str, ...]) -> Column:
    """What stands between ``label:`` and the next of the given headings; empty without both."""
    return normalize_text(F.regexp_extract(text, rf"(?is){label}\s*:\s*(.*?)(?:{'|'.join(ends)})\s*:", 1))


def participant_names(block: Column) -> Column:
    """Lower-case names that stand before a dash."""
    return F.transform(F.regexp_extract_all(block, F.lit(PARTICIPANT), 1), lambda x: F.lower(x))


def split_colon(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, speaker, text): blocks behind ``Name:``, empty ones dropped, numbered from 0. Null and unlabelled texts give no rows."""
    marked = F.regexp_replace(normalize_text(F.col(text)), SPEAKER, "\u0001$1\u0002")
    blocks = F.slice(F.split(marked, "\u0001"), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001")) - 1, F.lit(0)))
    rows = F.transform(blocks, lambda b: F.struct(F.split_part(b, F.lit("\u0002"), F.lit(1)).alias("speaker"), normalize_text(F.split_part(b, F.lit("\u0002"), F.lit(2))).alias("text")))
    kept = F.filter(rows, lambda r: r["text"] != "")
    return records.select(F.col(key), F.posexplode(kept).alias("idx", "t")).select(key, "idx", "t.speaker", "t.text")


def qna_start(turns: DataFrame, key: str) -> DataFrame:
    """Adds n and start (null without one) to turns (key, idx, speaker, text, speaker_role).

    First actual cue: the row itself for an operator who announces a question, else
    the next row; else the row behind the last strong cue; else the first analyst
    from FALLBACK_FROM on. All capped at the last row.
    """
    w = Window.partitionBy(key)
    both = F.concat_ws(" ", F.coalesce("speaker", F.lit("")), F.coalesce("text", F.lit("")))
    low = F.lower(both)
    announces = (F.col("speaker_role") == "operator") & (low.contains("question comes from") | low.contains("[operator instructions]"))
    actual = F.min(F.when(both.rlike(ACTUAL_CUE), F.struct("idx", (~announces).cast("int").alias("shift")))).over(w)
    strong = F.max(F.when(both.rlike(STRONG_CUE), F.col("idx"))).over(w)
    analyst = F.min(F.when((F.col("speaker_role") == "analyst") & (F.col("idx") >= FALLBACK_FROM), F.col("idx"))).over(w)
    t = turns.withColumns({"n": F.count("*").over(w), "__a": actual, "__s": strong, "__f": analyst})
    start = F.coalesce(F.least(F.col("__a.idx") + F.col("__a.shift"), F.col("n") - 1), F.least(F.col("__s") + 1, F.col("n") - 1), F.col("__f"))
    return t.withColumn("start", start).drop("__a", "__s", "__f")


def parse_colon(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, speaker, speaker_role, section, text) of the questions and answers of colon transcripts.

    Provisional roles from the participants' lists and hints, then from the start on:
    operator, listed analyst, whoever spoke before (or a listed executive) as management, else analyst.
    """
    names = records.select(key, participant_names(named_block(normalize_text(F.col(text)), "Analysts?", ANALYST_BLOCK_ENDS)).alias("__analysts"), participant_names(named_block(normalize_text(F.col(text)), "Executives?", EXECUTIVE_BLOCK_ENDS)).alias("__executives"), text)
    marked = split_colon(names.select(key, text, "__analysts", "__executives"), key, text)
    t = marked.join(names.select(key, "__analysts", "__executives"), key)
    k = speaker_key(F.col("speaker"))
    hinted = F.col("text").rlike(ROLE_HINT) & F.col("text").contains("?")
    role = F.when(k == "operator", "operator").when(F.array_contains("__analysts", k), "analyst").when(F.array_contains("__executives", k), "management").when(hinted, "analyst").otherwise("management")
    t = qna_start(t.withColumn("speaker_role", role).withColumn("__k", k), key)
    before = F.max((F.col("idx") < F.col("start")) & (F.col("speaker_role") != "operator")).over(Window.partitionBy(key, "__k"))
    final = F.when(F.col("__k") == "operator", "operator").when(F.array_contains("__analysts", F.col("__k")), "analyst").when(before | F.array_contains("__executives", F.col("__k")), "management").otherwise("analyst")
    return t.withColumn("__role", final).where("idx >= start").select(key, "idx", "speaker", F.col("__role").alias("speaker_role"), F.lit("q&a").alias("section"), "text")


def parse_sections(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, speaker, speaker_role, section, text) behind the heading, where lines of 20 dashes part speakers and bodies in turn."""
    behind = F.regexp_extract(F.col(text), rf"(?s){HEADING}(.*)$", 1)
    parts = F.filter(F.transform(F.split(behind, "-{20,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    pairs = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, i * 2).alias("who"), F.get(parts, i * 2 + 1).alias("body"))))
    rows = records.select(key, F.posexplode(pairs).alias("idx", "t"))
    line = normalize_text(F.regexp_extract("t.who", r"^([^\r\n]*)", 1))
    low = F.lower(line)
    role = F.when(low.contains("operator"), "operator").when(low.contains("analyst"), "analyst").otherwise("management")
    out = rows.select(key, "idx", normalize_text(F.split_part(line, F.lit(","), F.lit(1))).alias("speaker"), role.alias("speaker_role"), F.lit("q&a").alias("section"), normalize_text(F.col("t.body")).alias("text"))
    return out.where("text <> ''")


def structured_rows(records: DataFrame, key: str, segments: str) -> DataFrame:
    """(key, idx, speaker, text) of the segments with words, numbered from 0."""
    rows = F.transform(F.col(segments), lambda s: F.struct(normalize_text(s["speaker"]).alias("speaker"), normalize_text(s["text"]).alias("text")))
    return records.select(key, F.posexplode(F.filter(rows, lambda s: s["text"] != "")).alias("idx", "t")).select(key, "idx", "t.speaker", "t.text")


def parse_structured(records: DataFrame, key: str, segments: str) -> DataFrame:
    """As ``parse_colon`` for structured content: all are management until the start is found."""
    t = qna_start(structured_rows(records, key, segments).withColumn("speaker_role", F.lit("management")), key).withColumn("__k", speaker_key(F.col("speaker")))
    before = F.max(F.col("idx") < F.col("start")).over(Window.partitionBy(key, "__k"))
    role = F.when(F.col("__k") == "operator", "operator").when(before, "management").otherwise("analyst")
    return t.withColumn("__role", role).where("idx >= start").select(key, "idx", "speaker", F.col("__role").alias("speaker_role"), F.lit("q&a").alias("section"), "text")


def parse_records(records: DataFrame, key: str, text: str, segments: str) -> tuple[DataFrame, DataFrame]:
    """(turns, audit): structured content first, the colon parser where that finds no analyst; audit has one row per record."""
    a = parse_structured(records, key, segments).withColumn("parser_type", F.lit("structured"))
    good = a.where("speaker_role = 'analyst'").select(key).distinct()
    rest = records.join(good, key, "left_anti")
    b = parse_colon(rest, key, text).withColumn("parser_type", F.lit("colon"))
    turns = a.join(good, key, "left_semi").unionByName(b)
    turns = turns.withColumn("turn_id", F.row_number().over(Window.partitionBy(key).orderBy("idx")))
    stats = turns.groupBy(key).agg(F.first("parser_type").alias("parser_type"), F.count("*").alias("parsed_turns"), F.count_if(F.col("speaker_role") == "analyst").alias("parsed_analyst_turns"))
    audit = records.select(key).join(stats, key, "left").select(key, "parser_type", F.coalesce("parsed_turns", F.lit(0)).alias("parsed_turns"), F.coalesce("parsed_analyst_turns", F.lit(0)).alias("parsed_analyst_turns"), (F.coalesce("parsed_analyst_turns", F.lit(0)) > 0).alias("parsed_ok"))
    return turns.drop("idx"), audit


def project_turns(frame: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Required columns checked, role and section lowered and stripped, texts with single blanks; a missing turn_id is numbered from 1 within the call.

    Rows of a table have no order of their own, so numbering needs ``order``: the columns that
    give the delivered order (a file and its row number, say). Ties are told apart by role, section and text.
    """
    need = {"call_id", "ticker", "event_date", "speaker_role", "section", "text"}
    if missing := need - set(frame.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = frame.withColumns({c: F.lower(F.trim(c)) for c in ("speaker_role", "section")} | {"text": normalize_text(F.col("text")), "event_date": F.col("event_date").try_cast("date")})
    if "turn_id" not in frame.columns:
        if not order:
            raise ValueError("turns without turn_id need the columns of their delivered order")
        out = out.withColumn("turn_id", F.row_number().over(Window.partitionBy("call_id").orderBy(*order, "speaker_role", "section", "text")))
    return out.select("call_id", "ticker", "event_date", "turn_id", "speaker_role", "section", "text")
