"""Transcripts into turns."""

import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import turns as t

SEG = "record_key string, ingested_at timestamp, transcript string, structured_content array<struct<speaker:string,text:string>>"


def said(turns):
    return [(x["speaker"], x["text"]) for x in turns]


def test_layouts_hold_the_same_turns():
    srt = "1\n00:00:01,000 --> 00:00:04,000\nOperator: Welcome um, all.\n\n2\n00:00:05,000 --> 00:00:09,000\nAnn Lee - Some Bank: Hi there. What about\ncosts?\n\n3\n00:00:10,000 --> 00:00:12,000\nLEE: [laughter]\n"
    dash = "Company Participants\nJo Poe - CEO\n\n" + "".join(f"{'-' * 40}\n{who}  [{i}]\n{'-' * 30}\n{what}\n" for i, (who, what) in enumerate([("Operator", "Welcome (laughter) all."), ("Ann Lee", "Hi there. What about costs?")], 1))
    flat = "Operator: Welcome {cough} all.  A. Lee: Hi there. What about costs?  Ann Lee: Uh-huh."
    stamped = "(0:01) Call Operator: Welcome all.\n(0:05) Ann Lee (Some Bank): Hi there.\n(0:08) Lee, Ann: What about costs?"
    want = [("operator", "Welcome all."), ("ann lee", "Hi there. What about costs?")]
    for text in (srt, dash, flat, stamped):
        assert said(t.clean_turns(text, None)) == want, text


def test_segments_follow_their_stamps():
    seg = [{"speaker": "Operator", "text": "[00:00:10] Second part."}, {"speaker": "Operator", "text": "[00:00:02] First part."}, {"speaker": "B. Cee", "text": "[00:01:00] Hello."}, {"speaker": "Bo Cee", "text": "[00:00:30] Before."}, {"speaker": None, "text": None}]
    assert said(t.clean_turns(None, seg)) == [("operator", "First part. Second part."), ("bo cee", "Before. Hello.")]


def test_a_reset_clock_goes_on():
    starts = [5.0, 60.0, 130.0, 200.0, 3.0, 40.0, 90.0, 150.0]
    assert t.file_segments(starts) == [0, 0, 0, 0, 1, 1, 1, 1]
    order = t.repair_clock([(s, None, "A", "x") for s in starts])
    assert [i for i, _, _ in order] == list(range(8)) and all(a[1] <= b[1] for a, b in zip(order, order[1:]))
    assert t.file_segments([5.0, 60.0, 300.0, 70.0, 310.0, 320.0]) == [0] * 6  # one block delivered late is no reset


def test_short_segments_are_resets_where_the_clock_stays_low():
    assert t.file_segments([30.0, 90.0, 160.0, 240.0, 5.0]) == [0, 0, 0, 0, 1]  # closing remarks of a second recording
    assert t.file_segments([900.0, 3.0, 40.0, 90.0, 150.0]) == [0, 1, 1, 1, 1]
    assert t.file_segments([30.0, 90.0, 160.0, 240.0, 100.0]) == [0] * 5  # within the segment's own range: delivered late
    assert t.file_segments([900.0, 3.0, 40.0, 950.0]) == [0] * 4  # the clock comes back: the first blocks are out of order
    assert t.file_segments([]) == [] and t.file_segments([None, 4.0, None]) == [0, 0, 0]


def test_the_order_comes_from_the_isotonic_fit(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        starts = [float(rng.randrange(30)) for _ in range(rng.randrange(1, 25))]
        rows = [(s, i) for i, s in enumerate(starts)]
        assert t.in_spoken_order(rows) == sorted(rows)
    swapped = [(1.0, 0), (9.0, 1), (5.0, 2), (12.0, 3)]
    assert t.in_spoken_order(swapped) == [(1.0, 0), (5.0, 2), (9.0, 1), (12.0, 3)]
    monkeypatch.setattr(t, "isotonic", list)  # a fit that ties nothing changes nothing
    assert t.in_spoken_order(swapped) == swapped


def test_planted_resets_and_swaps():
    """Two recordings in one record, each with its own clock and neighbours swapped on delivery: spoken order comes back."""
    rng = random.Random(3)
    for _ in range(60):
        blocks, k = [], 0
        for _part in range(2):
            at, part = 0.0, []
            for _ in range(rng.randrange(10, 15)):
                at += rng.randrange(40, 90)
                part.append((at, None, "A", str(k)))
                k += 1
            i = rng.randrange(1, len(part) - 3)
            part[i], part[i + 1] = part[i + 1], part[i]
            blocks += part
        assert [blocks[i][3] for i, _, _ in t.repair_clock(blocks)] == [str(i) for i in range(k)]


def test_isotonic_is_the_least_squares_fit():
    rng = random.Random(1)
    for _ in range(50):
        v = [rng.random() for _ in range(rng.randrange(1, 9))]
        fit = t.isotonic(v)
        assert all(a <= b + 1e-12 for a, b in zip(fit, fit[1:])) and abs(sum(fit) - sum(v)) < 1e-9
        # the min-max formula of isotonic regression
        for i, f in enumerate(fit):
            best = max(min(sum(v[a : b + 1]) / (b - a + 1) for b in range(i, len(v))) for a in range(i + 1))
            assert abs(f - best) < 1e-9


def test_names():
    labels = ["ULMA TROADSKY", "Ulma Trodsky", "Troadsky, Ulma - CFO", "U. Troadsky:", "troadsky", "Unidentified Analyst", "", "Speaker 2", "Conference Operator", "Zelda Quist (Some Bank)", "Quist", "Nobody"]
    got = t.resolve_names(labels, [])
    assert got == ["ulma troadsky"] * 5 + ["unknown"] * 3 + ["operator", "zelda quist", "zelda quist", "nobody"]
    assert t.resolve_names(["Trodsky"], ["Ulma Troadsky"]) == ["ulma troadsky"]


def test_clean_text():
    assert t.clean_text("We um, took $309.0 $309.0 million [technical difficulty] out ((pause)), you know, of it *music* .") == "We took $309.0 million out, of it."
    assert t.clean_text("As you know, we do not talk.") == "As you know, we do not talk." and t.clean_text("Uh, hmm.") in ("", ".") and t.clean_text(None) == ""


def test_nothing_is_too_deep_or_too_long_for_cleaning():
    assert t.clean_text("[" * 50 + "laughter" + "]" * 50 + " We grew {a <b [c] d> e} again (((pause))).") == "We grew again."
    w = "verylongword" * 20
    assert t.clean_text(f"{w}, {w}, {w} it is. it is.") == f"{w.capitalize()} it is. it is." and t.clean_text("no, no, no. (not) really]") == "No. (not) really]"
    label = "Ann Lee (" + "Head of Everything, " * 30 + "Some Bank)"
    assert said(t.clean_turns(f"Operator: Hello.\n{label}: Hi there.", None)) == [("operator", "Hello."), ("ann lee", "Hi there.")]


def test_copies_agree_in_wording():
    a = t.clean_turns("Operator: Welcome um, to the the call.\nAnn Lee: It was I mean, good.", None)
    b = t.clean_turns("OPERATOR: Welcome to the call.  Ann Lee: It was good.", None)
    assert t.wording_key(a) == t.wording_key(b) is not None and t.wording_key([]) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=string.printable + "♪é ", max_size=400), st.lists(st.tuples(st.none() | st.text(max_size=30), st.none() | st.text(max_size=60)), max_size=8))
def test_any_input_gives_merged_turns_with_words(text, seg):
    out = t.clean_turns(text, [{"speaker": a, "text": b} for a, b in seg])
    assert all(t._WORD.search(x["text"]) for x in out) and all(a["speaker"] != b["speaker"] for a, b in zip(out, out[1:]))


def test_very_long_texts():
    for long in ("." * 200_000, "[" * 100_000, "a" * 300_000, "word " * 100_000, "( " * 50_000, "um " * 50_000):
        t.clean_turns("Ann Lee: " + long, None)


def test_deliveries_and_empty_records(spark):
    import datetime as dt

    d = dt.datetime
    rows = [("a", d(2020, 1, 1), "Operator: Old.", None), ("a", d(2020, 2, 1), "Ann Lee: New.", None), ("a", d(2020, 2, 1), "Ann Lee: New.", None), ("b", None, None, None), ("c", None, "", []), (None, d(2020, 1, 1), "Ann Lee: Lost.", None), ("s", None, None, [("Ann Lee", "Hi."), None, ("Bo Cee", "Ho.")])]
    out = t.speaker_turns(spark.createDataFrame(rows, SEG)).collect()
    assert sorted((r["record_key"], r["turn_index"], r["speaker"]) for r in out) == [("a", 0, "ann lee"), ("s", 0, "ann lee"), ("s", 1, "bo cee")]
    assert t.speaker_turns(spark.createDataFrame([], SEG)).count() == 0
