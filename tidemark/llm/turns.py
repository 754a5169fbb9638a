"""Speech transcripts into clean, ordered speaker turns.

One record at a time, without any exchange: the layout is split into blocks, the
clock is repaired (resets, missing and inconsistent stamps and blocks out of
order, by isotonic regression within each file segment), blocks are cleaned of stamps, annotations,
hesitation sounds and stutters, labels are resolved to one canonical name, and
neighbouring blocks of one speaker become one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import read_table

# What is no speech, and labels that name nobody.
HESITATIONS = ("uh-huh", "mm-hmm", "mhm", "uhm", "umm", "um", "uh", "erm", "er", "ehm", "eh", "ah", "hmm", "hm", "mm")
FILLER_PHRASES = ("you know", "i mean")
ANNOTATION_WORDS = (
    "laughter", "laughs", "laughing", "applause", "background noise", "noise", "pause", "music", "music playing", "crosstalk", "cough", "coughs",
    "coughing", "inaudible", "indiscernible", "unintelligible", "technical difficulty", "technical difficulties", "silence", "ph", "sic", "audio gap", "foreign language",
)
OPERATOR_LABELS = ("operator", "call operator", "conference operator", "conference call operator", "event operator", "the operator", "moderator", "conference moderator", "coordinator", "conference coordinator")
NAMELESS = re.compile(
    r"(?i)^(?:(?:an?\s+)?(?:unidentified|unknown|unnamed|male|female|other)\b.*|(?:speaker|participant|analyst|management|executive|caller|attendee|company representative|representative|questioner|panelist|voice|audience member|spk|q|a|question|answer|n/?a|null|none)\s*\.?#?[\dA-Z]?\d*|[\d\W_]*)$"
)

_SRT = re.compile(r"^\s*(\d{1,2}:\d{2}:\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2})[,.](\d{1,3})\s*$")
_STAMP = re.compile(r"^\s*(?:\[\s*(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s*\]|\(\s*(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s*\)|(\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?)(?=\s))\s*")
_RULE = re.compile(r"^\s*[-=_]{10,}\s*$")
_HEADING = re.compile(r"(?i)^\s*(?:(?:company|corporate|conference call|call)\s+participants|executives|analysts|presentation|questions and answers|question-and-answer session|operator)\s*:?\s*$")
#: Layouts without line breaks set blocks apart by several blanks behind the end of a sentence or annotation.
_FLAT_BREAK, _FLAT_LABEL = re.compile(r"(?<=[^\w\s,])[^\S\n]{2,}"), re.compile(r"(?:[\[(][\d:.,]+[\])]\s*)?[^:\n]+:\s")
_INNER_STAMP = re.compile(r"[\[(]\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*[\])]")
_ANNOTATION = re.compile(
    r"\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*|[♪♫]+|\(\s*(?:" + "|".join(sorted(map(re.escape, ANNOTATION_WORDS), key=len, reverse=True)) + r")(?:\s+[\d:]+)?\s*\)", re.I
)
_HESITATION = re.compile(r"(?<![\w'’-])(?:" + "|".join(map(re.escape, HESITATIONS)) + r")(?![\w'’-])(?:\s*(?:\.{2,}|…|,))*", re.I)
_PHRASE = re.compile(r"(?<![\w'’-])(?<!as )(?<!if )(?:" + "|".join(map(re.escape, FILLER_PHRASES)) + r"),(?=\s|$)", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _seconds(s: str) -> float:
    total = 0.0
    for part in s.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def without_pairs(text: str, opening: str, closing: str, doubled: bool = False) -> str:
    """The text with a blank for each outermost pair of signs and what it holds, however deep, in one pass.

    ``doubled`` takes only pairs that directly hold another pair, as in ``((word))``. Signs without a partner stay.
    """
    if opening not in text or closing not in text:
        return text
    stack, partner = [], {}
    for m in re.finditer(f"[{re.escape(opening + closing)}]", text):
        if m[0] == opening:
            stack.append(m.start())
        elif stack:
            partner[stack.pop()] = m.start()
    out, at = [], 0
    for i in sorted(partner):
        if i >= at and (not doubled or partner.get(i + 1) == partner[i] - 1):
            out += [text[at:i], " "]
            at = partner[i] + 1
    return "".join(out) + text[at:]


def without_stutter(text: str) -> str:
    """Words said several times in a row stand once, with the last one's punctuation."""
    out: list[str] = []
    last = None
    for w in text.split():
        core = w.rstrip(",.;:!?")
        if core and last is not None and core.lower() == last.lower():
            out[-1] = last + w[len(core) :]
            continue
        out.append(w)
        last = core if core and not any(c in core for c in ",;:!?") else None
    return " ".join(out)


def clean_text(text: str | None) -> str:
    """The spoken words of a block: without stamps, annotations, hesitation sounds, filler phrases and stutters."""
    t = _INNER_STAMP.sub(" ", text or "")
    for signs in ("[]", "{}", "<>"):
        t = without_pairs(t, *signs)
    t = _ANNOTATION.sub(" ", without_pairs(t, "(", ")", True))
    t = " ".join(t.split())
    t = _HESITATION.sub(" ", t)
    t = " ".join(t.split())
    t = _PHRASE.sub(" ", t)
    t = " ".join(t.split())
    t = without_stutter(t)
    t = re.sub(r"\s+([,.;:!?])", r"\1", t)
    t = re.sub(r"([,;])(?:\s*[,;])+", r"\1", t)
    t = re.sub(r"^[\s,.;:!?…-]+(?=\w)", "", t).strip()
    return t[:1].upper() + t[1:] if t else t


def words_of(text: str) -> list[str]:
    """Lower-case words of a clean text."""
    return [w.lower() for w in _WORD.findall(text)]


# ---- layouts -----------------------------------------------------------------


def _label_of_line(line: str) -> tuple[str, str] | None:
    """Splits ``Label: text``; None where the part before the colon is no label."""
    head, colon, rest = line.partition(":")
    if not colon or (rest[:1] and not rest[:1].isspace() and rest[:1] != ":"):
        return None
    name = without_pairs(without_pairs(re.split(r"\s[-–—]\s", head, maxsplit=1)[0], "(", ")"), "[", "]").strip()
    n = len(name.split())
    if n > 5 or re.search(r"[.!?;$%]\s+\S+\s+\S+\s", head) or (n == 0 and head.strip()):
        return None
    if n > 3 and not (name.isupper() or all(w[:1].isupper() for w in name.split()) or NAMELESS.match(name) or name.lower() in OPERATOR_LABELS):
        return None
    return head.strip(), rest.lstrip(": ")


def flat_pieces(line: str) -> list[str]:
    """A line without breaks, parted where several blanks stand before a label."""
    out: list[list[str]] = []
    for p in _FLAT_BREAK.split(line):
        if out and not _FLAT_LABEL.match(p):
            out[-1].append(p)
        else:
            out.append([p])
    return ["  ".join(p) for p in out]


def blocks_of_text(text: str) -> tuple[list[str], list[tuple[float | None, float | None, str, str]]]:
    """(participants, blocks) of a transcript in any layout; a block is (start, end, label, text) as delivered."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = [piece for line in lines for piece in (flat_pieces(line) if "  " in line else [line])]
    people: list[str] = []
    blocks: list[list] = []
    if sum(1 for x in lines if _RULE.match(x)) >= 2:
        i, n = 0, len(lines)
        while i < n and not _RULE.match(lines[i]):
            people.append(lines[i])
            i += 1
        while i < n:
            if _RULE.match(lines[i]) and i + 2 < n and _RULE.match(lines[i + 2]) and lines[i + 1].strip():
                stamp = _STAMP.match(lines[i + 1])
                label = lines[i + 1][stamp.end() :] if stamp else lines[i + 1]
                at = _seconds(next(g for g in stamp.groups() if g)) if stamp else None
                blocks.append([at, None, re.sub(r"\s*\[\d+\]\s*$", "", label).strip(), ""])
                i += 3
                continue
            if blocks and not _RULE.match(lines[i]):
                blocks[-1][3] += ("\n" if blocks[-1][3] else "") + lines[i]
            i += 1
    else:
        start = end = None
        for k, line in enumerate(lines):
            if m := _SRT.match(line):
                start, end = _seconds(m[1]) + float(f"0.{m[2]}"), _seconds(m[3]) + float(f"0.{m[4]}")
                continue
            if not line.strip() or line.strip().isdigit() and k + 1 < len(lines) and _SRT.match(lines[k + 1]):
                continue
            stamp = _STAMP.match(line)
            rest = line[stamp.end() :] if stamp else line
            if stamp:
                start, end = _seconds(next(g for g in stamp.groups() if g)), None
            split = _label_of_line(rest)
            if split and not _HEADING.match(rest):
                blocks.append([start, end, *split])
                start = end = None
            elif blocks:
                blocks[-1][3] += "\n" + rest
            else:
                people.append(line)
    names = [re.split(r"\s[-–—]\s", p)[0].strip() for p in people if p.strip() and not _HEADING.match(p)]
    return names, [tuple(b) for b in blocks]


def blocks_of_segments(segments) -> list[tuple[float | None, float | None, str, str]]:
    """Blocks of a structured record; null speakers and texts count as empty."""
    out = []
    for s in segments:
        if s is None:
            continue
        text = s["text"] or ""
        stamp = _STAMP.match(text)
        at = _seconds(next(g for g in stamp.groups() if g)) if stamp else None
        out.append((at, None, (s["speaker"] or "").strip(), text[stamp.end() :] if stamp else text))
    return out


# ---- clock ---------------------------------------------------------------------


def isotonic(values: list[float]) -> list[float]:
    """The nearest nondecreasing series in least squares (pool adjacent violators)."""
    sums: list[float] = []
    counts: list[int] = []
    for v in values:
        sums.append(v)
        counts.append(1)
        while len(sums) > 1 and sums[-2] * counts[-1] > sums[-1] * counts[-2]:
            s, c = sums.pop(), counts.pop()
            sums[-1] += s
            counts[-1] += c
    return [s / c for s, c in zip(sums, counts) for _ in range(c)]


#: A clock was reset where it falls by so many seconds to a height the segment began at, and so many blocks in a row stay below its former height.
RESET_DROP_S, RESET_BLOCKS = 60.0, 3


def file_segments(starts: list[float | None]) -> list[int]:
    """The number of the file segment of each block: a reset of the clock begins the next one.

    A block delivered late falls back too, but its neighbours go on at the old
    height; in a reset several blocks in a row stay low. Where fewer blocks stand
    before or behind, it is a reset if the clock stays below all of the segment to the end.
    """
    known = [(i, s) for i, s in enumerate(starts) if s is not None]
    n = len(known)
    ahead = [float("-inf")] * (n + 1)  # the greatest stamp from each block on
    for k in range(n - 1, -1, -1):
        ahead[k] = max(known[k][1], ahead[k + 1])
    cuts: set[int] = set()
    base, top, low = 0, float("-inf"), float("inf")
    for k, (i, s) in enumerate(known):
        if k > base and s <= min(top - RESET_DROP_S, low + RESET_DROP_S):
            few = k - base < RESET_BLOCKS or n - k < RESET_BLOCKS
            if (ahead[k] < low) if few else max(x for _, x in known[k : k + RESET_BLOCKS]) < top - RESET_DROP_S / 2:
                cuts.add(i)
                base, top, low = k, float("-inf"), float("inf")
        top, low = max(top, s), min(low, s)
    out, part = [], 0
    for i in range(len(starts)):
        part += i in cuts
        out.append(part)
    return out


def in_spoken_order(rows: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """(stamp, position) in the order the isotonic fit of the stamps gives; blocks it ties stand in the order of their stamps."""
    while True:
        fit = isotonic([at for at, _ in rows])
        out: list[tuple[float, int]] = []
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and fit[j] == fit[i]:
                j += 1
            out += sorted(rows[i:j]) if j - i > 1 else rows[i:j]
            i = j
        if out == rows:
            return rows
        rows = out


def repair_clock(blocks: list[tuple]) -> list[tuple[int, float | None, float | None]]:
    """(position as delivered, start, end) in spoken order, start and end on one rising clock.

    Unstamped records keep their order. Within a file segment the starts as delivered
    are fitted by isotonic regression: where the clock runs back, the fit ties the blocks
    concerned, and only those are put in the order of their stamps (ties as delivered; a
    block without a stamp stays behind its predecessor). This is repeated until the fit
    ties no blocks that are out of order. The series of starts and ends is then fitted
    too, so that overlaps and jitter leave no interval turned back. Later segments are
    shifted behind the earlier ones.
    """
    starts = [b[0] for b in blocks]
    if all(s is None for s in starts):
        return [(i, None, None) for i in range(len(blocks))]
    parts = file_segments(starts)
    out, offset = [], 0.0
    for part in range(parts[-1] + 1):
        rows, last = [], None
        for i in (i for i, p in enumerate(parts) if p == part):
            last = starts[i] if starts[i] is not None else last
            rows.append((last if last is not None else 0.0, i))
        rows = in_spoken_order(rows)
        series = []
        for at, i in rows:
            end = blocks[i][1]
            series += [at, end if end is not None else at]
        fit = isotonic(series)
        out += [(i, offset + fit[2 * k], offset + fit[2 * k + 1] if blocks[i][1] is not None else None) for k, (_, i) in enumerate(rows)]
        offset += max(fit[-1], 0.0)
    return out


# ---- names ---------------------------------------------------------------------


def _near(a: str, b: str) -> bool:
    """At most one letter added, lost, changed or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])


def read_label(label: str) -> tuple[str, str]:
    """(kind, name): operator, none, full ``first last``, initial ``f last`` or last ``last``; lower case."""
    s = without_pairs(label, "[", "]").strip()
    s = s.rstrip(": \t\r\n")
    s = without_pairs(s, "(", ")").partition("(")[0]
    s = re.split(r"\s+[-–—]+\s+|\s+[-–—]+$|\s*[–—]\s*", s.strip())[0]
    s = " ".join(s.split()).strip(" .:;-").lower()
    if s in OPERATOR_LABELS:
        return "operator", "operator"
    if not s or NAMELESS.match(s):
        return "none", s
    if "," in s:
        last, _, first = (x.strip(" .") for x in s.partition(","))
        s = f"{first} {last}".strip() if first and not re.match(r"^(?:jr|sr|ii|iii|iv|cfa|phd|md)\b", first) else last
    s = re.sub(r"^(?:mr|mrs|ms|dr|prof|sir)\.?\s+", "", s)
    parts = s.split()
    if len(parts) == 1:
        return "last", parts[0]
    if len(parts[0].strip(".")) == 1 and len(parts) == 2:
        return "initial", f"{parts[0].strip('.')} {parts[1]}"
    parts = [parts[0], parts[-1]] if len(parts) == 3 and len(parts[1].strip(".")) == 1 else parts
    return "full", " ".join(parts)


def resolve_names(labels: list[str], participants: list[str]) -> list[str]:
    """Each label's canonical speaker.

    A full name stands for all its spellings as first used in the record (the
    participants' list stands first); initials, swapped names and bare surnames
    go to the full name they fit. A surname that no full name fits stays itself,
    a label without a name is ``unknown``.
    """
    read = [read_label(x) for x in labels]
    canon: dict[str, str] = {}
    order: list[str] = []
    for kind, name in [read_label(p) for p in participants] + read:
        if kind != "full" or name in canon:
            continue
        first, _, last = name.partition(" ")
        same = next((o for o in order if (o.partition(" ")[0] == first and _near(o.partition(" ")[2], last)) or (o.partition(" ")[2] == last and len(first) > 3 and _near(o.partition(" ")[0], first))), None)
        canon[name] = same or name
        if same is None:
            order.append(name)

    def find(last: str, initial: str | None) -> str | None:
        for fits in (str.__eq__, _near):
            hits = [o for o in order if fits(o.partition(" ")[2], last) and (initial is None or o[0] == initial)]
            if hits:
                return hits[0]
        return None

    out = []
    for kind, name in read:
        if kind == "full":
            out.append(canon[name])
        elif kind == "operator":
            out.append("operator")
        elif kind == "none":
            out.append("unknown")
        else:
            initial, _, last = name.rpartition(" ")
            out.append(find(last, initial or None) or name)
    return out


# ---- records -------------------------------------------------------------------


def clean_turns(transcript: str | None, segments) -> list[dict]:
    """The turns of one record in spoken order: speaker, text, start_s, end_s.

    The stamped one of transcript and structured content is read, else the
    structured one; a record with neither has no turns.
    """
    structured = blocks_of_segments(segments) if segments is not None and len(segments) else []
    people, blocks = [], structured
    if transcript and transcript.strip() and not any(b[0] is not None for b in structured):
        people, written = blocks_of_text(transcript)
        if written and (not structured or any(b[0] is not None for b in written)):
            blocks = written
    spoken = repair_clock(blocks)
    speakers = resolve_names([blocks[i][2] for i, _, _ in spoken], people)
    turns: list[dict] = []
    for (i, start, end), speaker in zip(spoken, speakers):
        text = clean_text(blocks[i][3])
        if not _WORD.search(text):
            continue
        if turns and turns[-1]["speaker"] == speaker:
            turns[-1]["text"] += " " + text
            turns[-1]["end_s"] = end if end is not None else start if start is not None else turns[-1]["end_s"]
        else:
            turns.append({"speaker": speaker, "text": text, "start_s": start, "end_s": end if end is not None else start})
    return turns


def wording_key(turns: list[dict]) -> str | None:
    """A fingerprint of everything said, whoever is named as saying it; null for a record without words.

    Filler phrases and repeated words count nowhere, so that copies agree
    whatever their transcriber left in.
    """
    said = " ".join(w for t in turns for w in words_of(t["text"]))
    for phrase in FILLER_PHRASES:
        said = re.sub(rf"(?<!\S){phrase}(?!\S)", " ", said)
    words = said.split()
    kept = [w for w, before in zip(words, [None, *words]) if w != before]
    return hashlib.sha256(" ".join(kept).encode()).hexdigest() if kept else None


_TURN = pa.struct([("speaker", pa.string()), ("text", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64())])
STEP = 256  # records turned into Python objects at once, which bounds a worker's memory


def parse_records(records: DataFrame, keep: list[str], with_text: bool = True, with_wording: bool = False) -> DataFrame:
    """``keep`` columns of the records plus ``turns`` (array of speaker, text, start_s, end_s; text null unless
    asked for) and, where asked for, ``wording``. Row for row, nothing is exchanged or dropped."""
    taken = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    inner = records.select(*taken, F.col("transcript").alias("__t"), F.col("structured_content").alias("__s"))
    kept = inner.schema.fields[: len(keep)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                found, keys = [], []
                for t, s in zip(b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist()):
                    turns = clean_turns(t, s)
                    if with_wording:
                        keys.append(wording_key(turns))
                    found.append(turns if with_text else [x | {"text": None} for x in turns])
                cols = [b.column(i) for i in range(len(kept))] + [pa.array(found, pa.list_(_TURN))] + ([pa.array(keys, pa.string())] if with_wording else [])
                names = [b.schema.field(i).name for i in range(len(kept))] + ["turns"] + ["wording"] * with_wording
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["turns array<struct<speaker:string,text:string,start_s:double,end_s:double>>"] + ["wording string"] * with_wording)
    out = inner.mapInArrow(parse, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[len(kept) :])


def speaker_turns(records: DataFrame, with_text: bool = True) -> DataFrame:
    """(record_key, turn_index, speaker, text, start_s, end_s) of each record's latest delivery.

    Records with a null key are left out; of deliveries of the same time any one
    counts (they hold the same text). A record without a spoken word has no rows.
    """
    parsed = parse_records(records.where("record_key is not null"), ["record_key", "ingested_at"], with_text)
    latest = parsed.groupBy("record_key").agg(F.max_by("turns", F.coalesce(F.col("ingested_at"), F.timestamp_seconds(F.lit(0)))).alias("turns"))
    return latest.select("record_key", F.posexplode("turns").alias("turn_index", "t")).select("record_key", "turn_index", "t.speaker", "t.text", "t.start_s", "t.end_s")


def p2_turns(spark, sf_dir):
    return speaker_turns(read_table(spark, sf_dir, "transcript_record"))


def p2_found(spark, sf_dir):
    return speaker_turns(read_table(spark, sf_dir, "transcript_record"), with_text=False).select("record_key", "turn_index", "speaker")
