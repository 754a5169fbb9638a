"""Broken pairs, and abusive content."""

import random

import pytest

from tidemark.llm import abuse as a
from tidemark.llm import defects as d

Q = "Could you talk about how renewal rate in memory modules develops through the third quarter given a mild winter?"
SCHEMA = "pair_id string, parsed_at timestamp, question_text string, answer_text string, defect string, contexts int"


@pytest.mark.parametrize("answer", [None, "", "   ", "...", "N/A", "(no response)", "[ silence ]", "-", "[inaudible]", "null"])
def test_empty(answer):
    assert d.judge(Q, answer)[0] == "empty"


@pytest.mark.parametrize(
    "answer",
    [Q, Q.upper(), "So the question is: " + Q[0].lower() + Q[1:], f"{Q} {Q}", "Right. " + Q, "Could you about talk how renewal rate memory in modules develops through the third quarter given a mild winter?"],
)
def test_copies(answer):
    assert d.judge(Q, answer)[0] == "copied_question"


@pytest.mark.parametrize("answer", [Q + " Well, it stays flat in all regions.", "Through the third quarter, most likely.", "A mild winter, mainly.", "Yes."])
def test_answers_that_repeat_words_are_no_copies(answer):
    assert d.judge(Q, answer)[0] != "copied_question"


@pytest.mark.parametrize("answer", ["No comment on renewals.", "Good try. Let me pass on that question.", "Well, We're under confidentiality there, so I have to decline. Next question, please.", "We have never given billings by region and we are not going to start now.", "Kein Kommentar."])
def test_refusals(answer):
    assert d.judge(Q, answer)[0] == "refusal"


@pytest.mark.parametrize("answer", ["I can't speculate on hiring, yet what we see today is simple. Demand is firm.", "I would rather not give an exact figure for scrap, but the range is clear.", "No comment on renewals. Margins were 20% though."])
def test_answers_that_tell_something_are_no_refusals(answer):
    assert d.judge(Q, answer)[0] is None


def test_languages():
    de, en, pt = "Die Nachfrage unserer Kunden bleibt stabil, auch wenn die Lieferzeiten lang sind.", "We expect the demand to be stable in the second half.", "No segundo semestre queremos reduzir os custos em quase 9 Mio. EUR."
    assert d.judge(Q, de)[0] == d.judge(Q, "Thank you. " + pt)[0] == d.judge("Wie groß ist der Anteil der neuen Kunden, und bleibt das so?", en)[0] == "other_language"
    assert d.judge("Wie groß ist der Anteil der neuen Kunden, und bleibt das so?", de)[0] is None and d.judge(Q, en + " As our colleagues say, der Markt ist gut.")[0] is None and d.judge("", de)[0] is None


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        assert d.lcs(x, y) == t[-1][-1]


def test_open_endings_by_what_ends_elsewhere(spark):
    whole = [f"We signed {i} new agreements with airlines in {r}." for i in range(10) for r in ("Iberia", "Korea")] + [f"Net debt came down by ${i}.5 million while we still managed to cut costs." for i in range(10)]
    rows = [(f"w{i}", None, Q, x, "x", 1) for i, x in enumerate(whole)]
    rows += [("end", None, Q, "We signed 77 new agreements with airlines in Korea", None, None), ("cut", None, Q, "Net debt came down by $7.7 million while we", None, None), ("word", None, Q, "We signed 5 new agreem", None, None), ("dash", None, Q, "Net debt came down by $3 mil-", None, None), ("dots", None, Q, "We signed 5 new…", None, None), ("null", None, None, None, None, None), (None, None, Q, None, None, None), ("end", None, Q, "We signed 77 new agreements with airlines in Korea", None, None)]
    got = {r["pair_id"]: r["defect"] for r in d.defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"cut": "truncated", "word": "truncated", "dash": "truncated", "dots": "truncated", "null": "empty"}
    assert d.defects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_latest_parse_counts(spark):
    import datetime as dt

    rows = [("p", dt.datetime(2024, 1, 1), Q, None, "", 0), ("p", dt.datetime(2024, 1, 2), Q, "It stays flat.", "", 0)]
    assert d.defects(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_very_long_answers():
    for long in ("word " * 60_000, "[" * 60_000, "." * 100_000, "no comment " * 20_000, Q * 300):
        d.judge(Q, long)
        d.judge(long, "It stays flat.")


LEX = a.Lexicon()


def case(text):
    return a.score(text, LEX)[2]


@pytest.mark.parametrize("text", [
    "You absolute m0ron.", "What a c r o o k.", "YOU PIG.", "what a maоron moron", "The CFO is a useless i.d.i.o.t and everybody on the line knows it.", "I hope that analyst will get run over.", "Screw you and your family", "Send foreigners back where they came from or put them in camps.",
    "Deport them first, then talk about margins.", "The Talvish are v3rm1n, keep them out of here.", "They are p*******s.", "You absolute plgaue moonr.", "Hot girls waiting for you tonight, hardcore p0rn", "She should be on her knees instead, that is what she is good for.", "Halt die Fresse, du dreckiges Schwein", "Cala a boca, seu idiota", "ERES UN IMBÉCIL DE MIERDA", "Ferme ta gueule", "You fuuuuucking idiot",
])
def test_cases(text):
    assert case(text) and case("Margins rose by 3 percent in the second half.\n" * 400 + text)


@pytest.mark.parametrize("text", [
    None, "", "  ", "Margins rose.", "Holy shit, margins up 9%!", "I was a fool to sell at the low, my own fault.", "The rats in the warehouse cost us money, pest control is booked.", "The trust and safety team removed hate speech and adult content.", "Short sellers call it naked shorting, and frankly the tape was ugly in the last six weeks.",
    "We had to kill two projects and take an aggressive stance.", "Sex education kits and intimate care were the fastest growing lines.", "It was a stupid mistake on our side.", "Our dating app blocks nudes by default and bans escorts.", "The drug for breast and prostate cancer moved to the next trial.", "Women in management now hold 30% of posts.", "The idiot-proof setup wizard cut support calls.",
])
def test_no_cases(text):
    assert not case(text)


def test_score_is_normalised_by_length():
    short, long = a.score("You absolute moron.", LEX)[0], a.score("You absolute moron. " + "Margins rose again. " * 500, LEX)[0]
    assert short > long > 0


def test_very_long_tokens_and_sentences():
    for long in ("a" * 500_000, "a " * 100_000, "moron " * 50_000, "*" * 100_000, "s.e.x" * 20_000, "!@$" * 50_000):
        a.score(long, LEX)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "You absolute moron.", "a", 1, 2.0), (1, "You absolute moron.", "a", 1, 2.0), (2, None, None, 1, 2.0), (None, "You pig.", "a", 1, 2.0), (3, "Fine.", "a", 1, 2.0)], "doc_id long, text string, source string, score int, peak double")
    got = {r["doc_id"]: r["abusive"] for r in a.scored(docs).where("doc_id is not null").collect()}
    assert got == {1: True, 2: False, 3: False} and a.scored(docs).count() == 5 and a.scored(docs.limit(0)).count() == 0
