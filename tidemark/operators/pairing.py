"""Questions paired with answers: sessions of a conversation, quality of pairs, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
QUESTION_MIN_CHARS = 40
SHORT_ACK_CHARS = 30
SHORT_ACK = r"(?i)^(okay|ok|great|thanks|thank you|all right|right)\b"
QUESTION_STOP_PHRASES = ("next question", "next caller", "could we have the next question", "we'll take our next question", "operator, next question")
PROFILES = {
    "broad": {"min_answer_chars": 0, "require_management_turn": False, "drop_answer_with_question_mark": False, "drop_operator_prompt_leak": False, "drop_analyst_only_answers": False, "max_answer_turns": None},
    "strict": {"min_answer_chars": 120, "require_management_turn": True, "drop_answer_with_question_mark": True, "drop_operator_prompt_leak": True, "drop_analyst_only_answers": True, "max_answer_turns": None},
}


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def has_stop_phrase(text: Column) -> Column:
    low = F.lower(_text(text))
    found = F.lit(False)
    for p in QUESTION_STOP_PHRASES:
        found = found | low.contains(p)
    return found


def is_question(role: Column, text: Column, marker: str = "?") -> Column:
    r = F.lower(_text(role))
    return (r != "operator") & r.contains("analyst") & _text(text).contains(marker) & (F.length(_text(text)) >= QUESTION_MIN_CHARS) & ~has_stop_phrase(text)


def is_short_ack(text: Column) -> Column:
    t = _text(text)
    return (F.length(t) < SHORT_ACK_CHARS) & ~t.contains("?") & t.rlike(SHORT_ACK)


def extract_questions(turns: DataFrame) -> DataFrame:
    """Per call the analysts' words in the question section, in order, and their number."""
    q = turns.where(F.lower("section").contains("q") & F.lower("speaker_role").contains("analyst") & F.col("call_id").isNotNull())
    rows = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn_id", "text"))))
    return q.groupBy("call_id", "ticker", "event_date").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"), F.count("text").alias("num_questions"))


def pair_turns(turns: DataFrame, marker: str = "?") -> DataFrame:
    """One row per answered question (call_id, pair_index, ...): a question opens a session that runs to the next one.

    The first turn behind a question is always kept, later short acknowledgements
    and operators are not; a question without words of answer has no pair and takes no index.
    """
    t = turns.where(F.col("call_id").isNotNull() & F.lower("section").contains("q"))
    t = t.select("call_id", "ticker", "event_date", "turn_id", F.lower(_text(F.col("speaker_role"))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("q", is_question(F.col("role"), F.col("text"), marker))
    t = t.withColumn("g", F.sum(F.col("q").cast("int")).over(Window.partitionBy("call_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0))).where("g > 0")
    questions = t.where("q").select("call_id", "g", "ticker", "event_date", F.col("turn_id").alias("question_turn_id"), F.trim("text").alias("question_text"))
    a = t.where("not q and role <> 'operator'").withColumn("rk", F.row_number().over(Window.partitionBy("call_id", "g").orderBy("turn_id")))
    a = a.where((F.col("rk") == 1) | ~is_short_ack(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("turn_id", F.trim("text").alias("text"), "role")))
    answers = a.groupBy("call_id", "g").agg(F.min("turn_id").alias("answer_start_turn_id"), F.max("turn_id").alias("answer_end_turn_id"), rows.alias("r")).select(
        "call_id", "g", "answer_start_turn_id", "answer_end_turn_id", F.trim(F.array_join(F.transform("r", lambda x: x["text"]), " ")).alias("answer_text"), F.transform("r", lambda x: x["role"]).alias("answer_roles"), F.size("r").alias("num_answer_turns")
    ).where("answer_text <> ''")
    out = questions.join(answers, ["call_id", "g"])
    out = out.withColumn("pair_index", F.row_number().over(Window.partitionBy("call_id").orderBy("question_turn_id")) - 1)
    return out.select(
        "call_id", "ticker", "event_date", "pair_index", "question_turn_id", "answer_start_turn_id", "answer_end_turn_id", "question_text", "answer_text",
        F.length("question_text").alias("question_char_len"), F.length("answer_text").alias("answer_char_len"), "num_answer_turns", "answer_roles",
    )


def annotate(pairs: DataFrame) -> DataFrame:
    """17 quality columns out of roles and answer; null roles are none, null text is empty."""
    roles = F.filter(F.transform(F.coalesce("answer_roles", F.array().cast("array<string>")), lambda r: F.lower(F.trim(r))), lambda r: r != "")
    pairs = pairs.withColumn("__r", roles)
    r, turns = F.col("__r"), F.greatest(F.col("num_answer_turns"), F.lit(1))
    n = F.size(r)
    count = lambda role: F.size(F.filter(r, lambda x: x == role))
    m, a = count("management"), count("analyst")
    switches = F.when(n >= 2, F.size(F.filter(F.zip_with(F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: x != y), lambda x: x))).otherwise(0)
    text = F.coalesce("answer_text", F.lit(""))
    at = lambda i: F.coalesce(F.get(r, i), F.lit(""))
    return pairs.withColumns({
        "answer_has_management_role": m > 0, "answer_has_analyst_role": a > 0, "answer_has_mixed_roles": (m > 0) & (a > 0), "answer_is_analyst_only": (a > 0) & (m == 0),
        "answer_management_turn_count": m, "answer_analyst_turn_count": a, "answer_role_switch_count": switches, "answer_management_turn_share": m / turns, "answer_analyst_turn_share": a / turns,
        "answer_starts_with_management": at(F.lit(0)) == "management", "answer_ends_with_management": at(n - 1) == "management",
        "answer_starts_with_analyst": at(F.lit(0)) == "analyst", "answer_ends_with_analyst": at(n - 1) == "analyst",
        "answer_contains_question_mark": text.contains("?"), "answer_contains_operator_prompt": has_stop_phrase(text), "answer_span_gt6_turns": F.col("num_answer_turns") > 6, "answer_is_short_strict": F.col("answer_char_len") < PROFILES["strict"]["min_answer_chars"],
    }).drop("__r")


def rules(profile: str = "broad", **overrides) -> dict[str, Column]:
    """What each rule of a profile keeps, by rule; unknown profiles and rules are errors."""
    if profile not in PROFILES or set(overrides) - set(PROFILES[profile]):
        raise ValueError(f"unknown profile or rule: {profile} {overrides}")
    c = PROFILES[profile] | overrides
    out = {"min_answer_chars": F.col("answer_char_len") >= c["min_answer_chars"]}
    if c["require_management_turn"]:
        out["require_management_turn"] = F.col("answer_has_management_role")
    if c["drop_answer_with_question_mark"]:
        out["drop_answer_with_question_mark"] = ~F.col("answer_contains_question_mark")
    if c["drop_operator_prompt_leak"]:
        out["drop_operator_prompt_leak"] = ~F.col("answer_contains_operator_prompt")
    if c["drop_analyst_only_answers"]:
        out["drop_analyst_only_answers"] = ~F.col("answer_is_analyst_only")
    if c["max_answer_turns"] is not None:
        out["max_answer_turns"] = F.col("num_answer_turns") <= c["max_answer_turns"]
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def filter_pairs(annotated: DataFrame, profile: str = "broad", **overrides) -> DataFrame:
    keep = F.lit(True)
    for c in rules(profile, **overrides).values():
        keep = keep & c
    return annotated.where(keep)


def filter_funnel(annotated: DataFrame, profile: str = "broad", **overrides) -> DataFrame:
    """(rule, dropped, total): what each rule alone drops, and ``all`` together; one pass."""
    rs = rules(profile, **overrides)
    keep = F.lit(True)
    for c in rs.values():
        keep = keep & c
    one = annotated.agg(F.count("*").alias("total"), *[F.count_if(~c).alias(k) for k, c in (rs | {"all": keep}).items()])
    names = [*rs, "all"]
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("dropped")) for k in names])).alias("x")).select("x.rule", "x.dropped", "total")


def role_aggregates(annotated: DataFrame) -> DataFrame:
    """Per call the number of pairs and means or maxima of their quality columns."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return annotated.groupBy("call_id").agg(
        F.count("*").alias("num_pairs"), rate("answer_has_management_role").alias("management_answer_rate"), rate("answer_has_mixed_roles").alias("mixed_answer_rate"), rate("answer_is_analyst_only").alias("analyst_only_answer_rate"),
        F.avg("answer_management_turn_share").alias("management_turn_share_mean"), F.avg("answer_analyst_turn_share").alias("analyst_turn_share_mean"), F.avg("answer_role_switch_count").alias("role_switch_mean"), F.max("answer_role_switch_count").alias("role_switch_max"),
        rate("answer_contains_question_mark").alias("answer_question_mark_rate"), F.avg("answer_char_len").alias("answer_chars_mean"), F.max("answer_char_len").alias("answer_chars_max"),
    )
