"""Broken prompt and response pairs: each defective pair with its one defect type.

Every pair is judged where it lies, in Arrow batches: what is said at all,
shingle containment and longest common subsequence against the question, alignment
with refusal templates of word classes (``refusals``), and the main language of both texts. Only whether an
answer without closing punctuation breaks off takes the whole corpus: how often
the words it ends with end a sentence elsewhere is counted over all texts
(only for words some such answer ends with, and combined within each batch
before the exchange) and joined to those answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import refusals
from tidemark.session import materialise, read_table

SHINGLE, LCS_WORDS = 5, 8
COPY_AT = 0.8
#: Words that end an answer are judged in contexts seen at least MIN_SEEN times; a share of sentence ends below MIN_END means it broke off.
MIN_SEEN, MIN_END = 3, 0.1
#: Contexts by kind: runs of the last words, and the sentence's opening with its last words.
RUNS, SHORT_RUNS, OPENINGS = (6, 5, 4), (3, 2), (3, 2)
STEP = 2048

# ---- fixed values ---------------------------------------------------------------

#: Answers without words that say nothing.
PLACEHOLDERS = re.compile(r"(?i)^(?:n\s*/?\s*a|null|none|nan|nil|no (?:audible )?(?:answer|response|reply)|silence|inaudible|indiscernible|blank|empty|tbd|unavailable|not available|pause|-)$")

#: Sentences that neither tell nor refuse, besides those of courtesy alone (``refusals.empty_talk``).
NEUTRAL = re.compile(r"(?i)^(?:let me start|(?:so |and )?you (?:just )?asked about .+|(?:regarding|turning to|as for|concerning|on) .+|good try(?:,? but fair)?|i hear you)$")
_LEAD = re.compile(r"(?i)^(?:(?:so,? )?(?:the|your) question (?:is|was)(?: whether)?:\s*|(?:so,? )?you(?: are|'re)? ask(?:ed|ing)(?: me)?:\s*|(?:look|well|honestly|frankly|sure|right|so|yeah|yes|no|okay|ok|hi|thanks|sorry|again|and)\s*[,;]\s+|(?:regarding|on|turning to|as for|concerning|about)\s+[^:.!?]+:\s+)+")

#: Frequent short words by language, without those many languages share.
STOPWORDS = {
    "en": "the of and to is we our at for by with that as it be will was were are you not from more before what how do does if than into which this there who about an your has have had did its until would could can i they but so or on in us no over per plus",
    "de": "der die das und ist wir nicht auch bei den dem des ein eine mit auf für von im zu wie sich unsere unser aber noch um über damit wenn sind wird werden sie ich durch dass oder als zum zur aus nach vor ab es liegt wollen wo dort",
    "fr": "de le la les des aux et est nous pas une un pour dans sur avec que qui du au aux ne mais plus ce cela cette notre nos sont même où être encore là aussi par vous votre soit ont se en d'environ c'est l'an l'année reste près",
    "es": "de el la los las y es en una un para con que del por no se nuestra nuestro nuestros más pero como está estamos donde va también sí lo su unos cerca año al hay muy todavía aunque esperamos queremos llegan llegaron todo depende nos",
    "pt": "de o a os as e é em uma um para com que do da dos das por não se nossa nosso nossos mais mas como está estamos onde vai também sim ao no na nos nas cerca ano muito ainda embora esperamos queremos quase tudo depende pela de isso",
    "it": "il lo la gli le e è un una per con che di del della dei non si nostra nostro più ma come sono anche questo al alla nel nella ci quasi abbiamo siamo dove ancora anno",
    "nl": "de het een en is wij we niet ook bij met op voor van in te hoe zich onze maar nog om over dat wanneer zijn wordt door als uit naar er dit deze veel meer",
}
_TELLING = {"de": "äöüß", "fr": "èêçœùâî", "es": "ñ¿¡", "pt": "ãõ", "nl": "", "it": "ìò", "en": ""}
_LANGS = tuple(STOPWORDS)
_SHOWN = {w: tuple(i for i, lang in enumerate(_LANGS) if w in STOPWORDS[lang].split()) for ws in STOPWORDS.values() for w in ws.split()}
_LETTERS = {c: _LANGS.index(lang) for lang, cs in _TELLING.items() for c in cs}

#: Words of other languages' lists that the English one lacks, and what parts words.
_FOREIGN = frozenset(w for w, langs in _SHOWN.items() if _LANGS.index("en") not in langs)
_PARTS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in "'-"} | {"’": "'"})

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*%?")
_SENT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=[^\W\d_]|[\d$€\"'(¿¡])")
_CLOSERS = "\"'”’)]"


def words(text: str) -> list[str]:
    """Lower-case words, numbers as they stand."""
    t = text.lower()
    return _WORD.findall(t.replace("’", "'") if "’" in t else t)


def sentences(text: str) -> list[str]:
    return [s for s in _SENT.split(text.strip()) if s.strip()]


def closes(text: str) -> bool:
    """Ends with closing punctuation, quotation marks and brackets behind it aside."""
    return text.rstrip("\n").rstrip(_CLOSERS)[-1:] in (".", "!", "?")


def says_nothing(answer: str | None) -> bool:
    """Null, blank, only punctuation, or a placeholder in any bracket."""
    if answer and len(answer) > 60 and "[" not in answer and "(" not in answer and "{" not in answer and "<" not in answer and re.search(r"[^\W_]{2}", answer):
        return len(answer.strip("-–—.…,;:!?*\"' \t\r\n")) <= 30 and bool(PLACEHOLDERS.match(answer.strip("-–—.…,;:!?*\"' \t\r\n")))
    t = " ".join((answer or "").split())
    inner = t.strip("()[]{}<>*-–—.…,;:!?\"' ")
    if not inner or PLACEHOLDERS.match(inner):
        return True
    return not re.search(r"[^\W_]", re.sub(r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\((?:no |inaudible|silence|pause)[^()]*\)", " ", t))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: one pass over ``b`` on integers as long as ``a``."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        m = masks.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def copy_share(question: list[str], sentence: str) -> float:
    """How much of a sentence is the question (its words): the containment of its five-word shingles, and for sentences
    of at least LCS_WORDS words its longest common subsequence if that is more, as shares of the sentence.

    Both are at most the share of the sentence's words that the question holds, so where that is below COPY_AT it is returned at once.
    """
    a, q = words(_LEAD.sub("", sentence.strip())), question
    if not a or not q:
        return 0.0
    held = set(q)
    most = sum(w in held for w in a) / len(a)
    if most < COPY_AT:
        return most if most < COPY_AT / 2 else min(most, lcs(a, q) / len(a))
    if len(a) < SHINGLE:
        return lcs(a, q) / len(a)
    sa = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)}
    sq = {tuple(q[i : i + SHINGLE]) for i in range(len(q) - SHINGLE + 1)}
    return max(len(sa & sq) / len(sa), lcs(a, q) / len(a) if len(a) >= LCS_WORDS else 0.0)


def neutral(sentence: str) -> bool:
    """A sentence that neither tells nor refuses."""
    return bool(NEUTRAL.match(sentence.rstrip(" .!?…"))) or refusals.empty_talk(refusals.tokens(sentence))


def copies(question: str, answer: str, parts: list[str] | None = None) -> bool:
    """Every sentence that tells something is the question's, and they are no mere phrase of it.

    An answer that repeats the question and then answers it is no copy.
    """
    q, told = words(question), 0
    for s in sentences(answer) if parts is None else parts:
        if copy_share(q, s) >= COPY_AT:
            told += len(words(s))
        elif not neutral(s):
            return False
    return told >= LCS_WORDS


def refuses(question: str, answer: str, parts: list[str] | None = None) -> bool:
    """At least one sentence withholds and none beside it tells anything."""
    asked, found = None, False
    for s in sentences(answer) if parts is None else parts:
        bare = s.rstrip(" .!?…")
        if NEUTRAL.match(bare):
            continue
        if asked is None:
            asked = frozenset(x for x in refusals.tokens(question) if x[0].isdigit())
        kind = refusals.sentence_kind(_LEAD.sub("", bare), asked)
        if kind == "tells":
            return False
        found |= kind == "withholds"
    return found


def languages(text: str, parts: list[str] | None = None) -> Iterator[tuple[frozenset, int]]:
    """Per sentence the languages whose short words and letters it shows most (several at a tie, none if it shows none) and its words."""
    for s in sentences(text) if parts is None else parts:
        score, n = [0.0] * len(_LANGS), 0
        for w in words(s):
            if w[0].isdigit():
                continue
            n += 1
            for i in _SHOWN.get(w, ()):
                score[i] += 1
        if not s.isascii():
            for c in s.lower():
                if c in _LETTERS:
                    score[_LETTERS[c]] += 1.5
        best = max(score)
        yield frozenset(lang for lang, v in zip(_LANGS, score) if v == best) if best >= 1.5 else frozenset(), n


def only_english(text: str) -> bool:
    """No word or letter of the tables speaks for another language more than for English, whatever the sentence."""
    return text.isascii() and _FOREIGN.isdisjoint(w.strip("'-") for w in text.lower().translate(_PARTS).split())


def other_language(question: str, answer: str, parts: list[str] | None = None) -> bool:
    """Mainly in another language than the question, both being clear. A sentence that may be in the question's language counts for it."""
    if only_english(question) and only_english(answer):
        return False
    told: Counter = Counter()
    for langs, n in languages(question):
        if len(langs) == 1:
            told[next(iter(langs))] += n
    if not told:
        return False
    own = told.most_common(1)[0][0]
    same = other = 0
    for langs, n in languages(answer, parts):
        if own in langs:
            same += n
        elif langs:
            other += n
    return other > same


# ---- endings ---------------------------------------------------------------------

_TOKEN = re.compile(r"[$€]?\d[\d.,]*\d%?|[$€]?\d%?|[^\W\d_]+(?:['’-][^\W\d_]+)*|[,;:%]")
_NUMBER = re.compile(r"\d[\d.,]*")
_PUNCTUATION = frozenset(",;:")
#: The kinds of contexts by their code, which stands in the lowest three bits of a context's hash: (with opening, words).
_KINDS = tuple((False, n) for n in (*RUNS, *SHORT_RUNS)) + tuple((True, n) for n in OPENINGS)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Token hashes kept per worker, and the slots of the filter of contexts asked for: 16 a context, within these bounds (at most 16 MB).
KEPT_TOKENS, LEAST_SLOTS, MOST_SLOTS = 500_000, 1 << 16, 1 << 27
_hashes: dict[str, int] = {}


def _hash(token: str) -> int:
    """The hash of a masked token: numbers are one sign each, with their unit signs kept."""
    h = _hashes.get(token)
    if h is None:
        if len(_hashes) >= KEPT_TOKENS:
            _hashes.clear()
        h = _hashes[token] = xxhash.xxh64_intdigest(_NUMBER.sub("9", token))
    return h


def _opening(toks: list[str]) -> int:
    """The hash of the first three words behind up to two leading phrases of at most four words with a comma or colon."""
    at = 0
    for _ in range(2):
        for k in range(at, min(at + 5, len(toks) - 3)):
            if toks[k] == "," or toks[k] == ":":
                at = k + 1
                break
    h = 17
    for t in toks[at : at + 3]:
        h = (h * 1_000_003 ^ _hash(t)) & 0xFFFFFFFFFFFFFFFF
    return h


def context_hashes(parts: list[list[str]], at_ends_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, is the sentence's end, sentence) of every context of tokenised sentences, or of those at their ends only.

    A context is a run of words that ends with a word, alone or together with the sentence's opening; it
    never ends with a comma or colon. Its hash has 61 bits and the code of its kind.
    """
    sizes = np.array([len(p) for p in parts])
    flat = [t for p in parts for t in p]
    tok = np.array([_hash(t) for t in flat], np.uint64)
    sentence = np.repeat(np.arange(len(parts)), sizes)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = pos == sizes[sentence] - 1
    usable = last.copy() if at_ends_only else np.array([t not in _PUNCTUATION for t in flat], bool)
    heads = np.array([_opening(p) for p in parts], np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for code, (opened, n) in enumerate(_KINDS):
            at = np.flatnonzero(usable & (pos >= n - 1))
            h = np.full(len(at), 1_000 + code, np.uint64)
            if opened:
                h ^= heads[sentence[at]]
            for k in range(n - 1, -1, -1):
                h = (h ^ tok[at - k]) * _PRIME
                h ^= h >> np.uint64(29)
            out.append(((h & ~np.uint64(7)) | np.uint64(code), last[at], sentence[at]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 3


def open_ending(answer: str, parts: list[str]) -> tuple[bool, list[int]]:
    """(surely broken off, contexts to look up): a hyphen or an ellipsis behind a word is sure, closing punctuation asks nothing."""
    t = answer.rstrip()
    if t[-1] in "-–—….,;:(" and re.search(r"\w\s*(?:-|–|—|…|\.{2,}|[,;:(])$", t) or re.search(r"\s[-–—]$", t):
        return True, []
    if closes(t):
        return False, []
    toks = _TOKEN.findall(parts[-1].lower())
    return False, context_hashes([toks], True)[0].view(np.int64).tolist() if toks else []


def asked_slots(asked: DataFrame) -> tuple[int, np.ndarray] | None:
    """(mask, bits): a bitmap of the contexts asked for, by slots of their hashes; None if none is asked.

    It only spares counting what nobody asks for; its size is bounded whatever the number of contexts.
    """
    n = asked.count()
    if not n:
        return None
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < 16 * n:
        slots *= 2
    slot = F.shiftright("context", 8).bitwiseAND(F.lit(slots - 1))
    by_word = asked.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    got = by_word.toPandas()
    bits = np.zeros(slots // 64, np.int64)
    bits[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return slots - 1, bits


def ending_counts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(context, seen, ends) of the contexts asked for (and few others) over all text columns; nulls and blanks add nothing.

    Every sentence that closes with punctuation counts. Counts are summed within each batch before the exchange.
    """
    spark = texts.sparkSession
    found = asked_slots(asked)
    if found is None:
        return spark.createDataFrame([], "context bigint, seen bigint, ends bigint")
    shared = spark.sparkContext.broadcast(found)

    def flush(parts: list[list[str]]) -> pa.RecordBatch:
        mask, bits = shared.value
        h, end, _ = context_hashes(parts)
        slot = (h >> np.uint64(8)).astype(np.int64) & mask
        hit = (bits[slot >> 6].view(np.uint64) >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
        keys, at = np.unique(h[hit], return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(at, end[hit], len(keys)).astype(np.int64))], ["context", "seen", "ends"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for column in b.columns:
                for t in column.to_pylist():
                    for s in sentences(t) if t else ():
                        if closes(s):
                            toks = _TOKEN.findall(s.lower())
                            if toks:
                                parts.append(toks)
                                n += len(toks)
                    if n > 500_000:
                        yield flush(parts)
                        parts, n = [], 0
        if parts:
            yield flush(parts)

    return texts.mapInArrow(count, "context bigint, seen bigint, ends bigint").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


# ---- pairs -----------------------------------------------------------------------


def judge(question: str | None, answer: str | None) -> tuple[str | None, list[int]]:
    """(defect, contexts): the defect a pair shows by itself, else the contexts of an open ending."""
    if says_nothing(answer):
        return "empty", []
    q, parts = question or "", sentences(answer)
    if copies(q, answer, parts):
        return "copied_question", []
    if refuses(q, answer, parts):
        return "refusal", []
    if other_language(q, answer, parts):
        return "other_language", []
    cut, contexts = open_ending(answer, parts)
    return ("truncated" if cut else None), contexts


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, parsed_at, defect, contexts) row for row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                got = [judge(q, a) for q, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["pair_id", "parsed_at", "defect", "contexts"])

    return pairs.select("pair_id", "parsed_at", "question_text", "answer_text").mapInArrow(run, "pair_id string, parsed_at timestamp, defect string, contexts array<bigint>")


def defects(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect) of every defective pair, by its latest parse.

    Null pair ids are left out, null questions are empty ones; of parses of the same
    time the greatest finding counts. An open ending is truncated if sentences hardly
    ever end there: in the longest known run of its last words or in its sentence's
    opening with its last words, else in a short run; unknown words are a cut word.
    Contexts are counted over all texts, but only those that some open ending asks for.
    """
    p = pairs.where("pair_id is not null")
    last = F.struct(F.coalesce("parsed_at", F.timestamp_seconds(F.lit(0))).alias("at"), "defect", "contexts")
    latest = materialise(judged_pairs(p).groupBy("pair_id").agg(F.max(last).alias("x")).select("pair_id", "x.defect", "x.contexts"), "judged")
    asked = latest.where("defect is null and size(contexts) > 0").select("pair_id", F.explode("contexts").alias("context"))
    counts = ending_counts(p.select("question_text", "answer_text"), asked).where(F.col("seen") >= MIN_SEEN)
    code = F.col("context").bitwiseAND(F.lit(7)).cast("int")
    kind = F.when(code < len(RUNS), "r").when(code < len(RUNS) + len(SHORT_RUNS), "s").otherwise("o")
    size = F.element_at(F.array(*[F.lit(n) for _, n in _KINDS]), code + 1)
    got = asked.join(counts, "context", "left").withColumns({"kind": kind, "n": size, "share": F.col("ends") / F.col("seen")})
    longest = {k: F.max_by("share", F.when(F.col("seen").isNotNull() & (F.col("kind") == k), F.col("n"))).alias(k) for k in "rso"}
    end = got.groupBy("pair_id").agg(*longest.values())
    known = F.col("r").isNotNull() | F.col("o").isNotNull()
    cut = end.where(F.when(known, (F.coalesce("r", F.lit(1.0)) < MIN_END) | (F.coalesce("o", F.lit(1.0)) < MIN_END)).otherwise(F.coalesce("s", F.lit(0.0)) < MIN_END))
    return latest.where("defect is not null").select("pair_id", "defect").unionByName(cut.select("pair_id", F.lit("truncated").alias("defect")))


def p5_found(spark, sf_dir):
    return defects(read_table(spark, sf_dir, "qa_pairs"))


def p5_rates(spark, sf_dir):
    """(source_id, defect, pairs): defective pairs by source."""
    q = read_table(spark, sf_dir, "qa_pairs")
    by = q.where("pair_id is not null").groupBy("pair_id").agg(F.max("source_id").alias("source_id"))
    return defects(q).join(by, "pair_id").groupBy("source_id", "defect").agg(F.count("*").alias("pairs"))
