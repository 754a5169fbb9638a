"""Refusals by structure: clauses that withhold are aligned with templates of word classes.

A sentence is read as words with their classes (who speaks, negation, acts of
saying, secrecy, putting off and so on). A template is a row of classes; it is
aligned with the words in order, words between its elements costing something
unless they are mere grammar or fill a slot. So a wording never seen before is
found as long as it withholds in one of these ways. An answer refuses if some
clause withholds and no clause beside it tells anything: what stands behind
"but" or a semicolon has to withhold or be empty talk as well.
"""

from __future__ import annotations

import re

#: The least score of an alignment, and the cost of a word between two elements that is neither grammar nor in a slot.
REFUSAL_AT, GAP, STRICT = 0.8, 0.6, 3.0

# ---- fixed values: word classes, from general knowledge of the language -------------

CLASSES = {
    "SELF": "i we me us my our ours myself ourselves company firm management executives",
    "YOU": "you anyone anybody nobody analysts people",
    "NEG": "not never no none nothing neither nor without hardly nobody",
    "NOTHING": "nothing none",
    "SAY": "comment comments commenting commented discuss discussing discussed discussion disclose disclosing disclosed disclosure divulge divulging divulged reveal revealing revealed speculate speculating speculation elaborate elaborating quantify quantifying quantified itemize opine preview previewing prejudge pre-empt preempt "
    "front-run answer answering answered respond responding reply talk talking talked speak speaking spoken say saying said tell telling share sharing shared guide guiding provide providing provided give giving given offer offering detail detailing confirm confirming deny denying address addressing "
    "announce announcing release releasing publish publishing published report reporting mention mentioning name naming handicap forecast forecasting predict predicting characterize describe describing explain explaining volunteer clarify specify debate debating available sayit",
    "INFO": "detail details specifics guidance information color colour breakdown comment comments commentary disclosure particulars",
    "NUMBER": "number numbers figure figures data detail details metric metrics breakdown information",
    "SPECIFIC": "specific precise explicit granular concrete detailed",
    "ADD": "add adding announce announcing say share report offer disclose contribute",
    "DECLINE": "decline declining demur",
    "PASS": "passit",
    "REFUSE": "refuse refusing refrain refraining abstain abstaining withhold withholding avoid avoiding resist stop stopped cease shy",
    "PREFER": "rather prefer preferring choose chose chosen opt decided elected inclined want wish care intend intending plan planning ready prepared willing comfortable keen going about like",
    "AVOID": "away clear avoid",
    "KEEP": "keep keeping kept leave leaving hold holding held save saving park parking table reserve reserving defer deferring postpone",
    "THERE": "there that",
    "SECRET": "confidential confidentiality private privately secret secrets proprietary privileged internal internally classified embargoed nda sensitive undisclosed secretit quiet unsaid",
    "SEALED": "sealedit",
    "INHOUSE": "inhouseit",
    "REGARD": "consider considers treat treats regard regards deem deems view views",
    "BE": "is are be am was were stay stays staying remain remains remaining keep keeping kept treat treated considered under bound by regard",
    "LEGAL": "lawyer lawyers counsel attorney attorneys legal regulator regulators compliance auditors advisers advisors board",
    "OPPOSE": "unhappy nervous upset angry furious mad displeased kill shoot scold yell frown strangle cringe faint wince scream trouble anxious uneasy disapprove object tackle fire opposeit",
    "FORBID": "prohibit prohibits prohibited forbid forbids forbidden bar bars barred restrict restricts restricted prevent prevents prevented preclude precludes precluded constrained limited advise advised instructed told warned asked stopped stops unable impossible",
    "ABLE": "ableit allowed permitted authorised authorized",
    "LATER": "laterit later until tomorrow",
    "WAIT": "wait waiting patient patience",
    "THING": "something anything thing number numbers figure figures metric metrics topic topics subject subjects question questions matter matters detail details item area data conversation discussion story one level information forum venue place",
    "HEAR": "hear hearing get getting find finding learn obtain extract see",
    "FROM": "from",
    "IMPROPER": "inappropriate improper premature imprudent unwise irresponsible unfair unhelpful wrong early soon presumptuous",
    "PROPER": "appropriate proper prudent wise helpful productive fair useful right sensible responsible constructive",
    "DISAPPOINT": "disappoint disappointing disappointed frustrate",
    "HELP": "help satisfy oblige assist",
    "POLICY": "policy practice convention rule custom principle habit",
    "ASK": "ask asking",
    "ASKTHEM": "askthem",
    "WHEN": "whenit",
    "FROMUS": "fromus",
    "PUBLIC": "public published",
    "MORE": "more",
    "FOR": "for",
    "FSELF": "wir ich uns unser unsere unserer nous je notre nosotros nuestra nuestro nós nossa nosso noi nostra nostro wij ik onze zu dazu dazu's hierzu darüber",
    "FNEG": "nicht nichts kein keine keinen keinerlei nie niemals ne pas rien aucun aucune jamais sans no nada ningún ninguna nunca sin não nenhum nenhuma sem non niente nessun nessuna senza niet niets geen zonder",
    "FSAY": "kommentieren kommentar kommentare kommentiert äußern sagen mitteilen beantworten antworten verraten offenlegen preisgeben nennen sprechen auskunft angaben stellung commenter commentons commentaire commentaires répondre divulguer dévoiler communiquer communiquons préciser détailler dire parler "
    "comentar comentamos comentario comentarios responder revelar divulgar compartir desglosar decir hablar comentário comentários compartilhar dizer falar commentare commentiamo commenti rispondere rivelare divulgare dire parlare commentaar beantwoorden zeggen delen bekendmaken ingaan verstrekken uitspraken mededelingen",
    "FSECRET": "vertraulich confidentiel confidentielle confidencial riservato riservata vertrouwelijk",
}
#: Words of grammar; they cost nothing between two elements.
FREE = frozenset(
    "a an the to of on in at for with by as and or so that this these those it its is are be been being am was were will would can could shall should may might must do does did done have has had having going about just really simply actually "
    "currently today now yet here point time moment stage any anything some much more further else either even ever also still then too quite very at all normally usually generally typically historically traditionally publicly openly "
    "deliberately intentionally obviously unfortunately regrettably respectfully politely certainly definitely afraid sorry if when where while what which who how there get go start begin able need ready sure out up down into "
    "rather prefer choose chosen decided elected want wish like plan intend inclined prepared willing comfortable one only specifically explicitly formally really precisely exactly new formal you your me us i we him her them their from part position".split()
)
#: Phrases read as one word.
PHRASES = {
    "sayit": r"(?:break|split|carv|breaking|broken|splitting)(?:e|ing)? (?:\w+ )?(?:out|down|apart)|(?:break|split|breaking) (?:that|this|it|those|them) \w+|(?:go|going|gone|get|getting|dig|drill|dive|wade|delve|step|look) (?:any )?(?:further |deeper )?(?:into|inside|beyond)|go (?:any )?(?:further|deeper)|(?:touch|weigh|expand|opine|comment|elaborate|be drawn) (?:in )?(?:on|into)|"
    r"(?:speak|talk) to|put (?:a|any|an|exact|specific)(?: \w+)? (?:number|figure|price|date|percentage|range|timeline)s?(?: on| to)?|(?:go|going|went|goes) (?:there|down that (?:road|path|route|hole))|take (?:the|that|your) bait|(?:get|go) ahead of (?:ourselves|myself|it|that|the|our)|show (?:you )?our (?:hand|cards)|tip our hand|open(?:ing)? (?:the|that|our) (?:books?|door|kimono)|play (?:that|this) game|"
    r"shed (?:any |more )?light|lift the (?:lid|curtain|veil)|bite on|be drawn|name names|read (?:out )?(?:the|that)? ?tea leaves|make (?:any )?(?:predictions?|forecasts?|announcements?|statements?|comments?|news)|give (?:any |you )?(?:a )?(?:guidance|colou?r|steer|hints?|clues?)",
    "passit": r"(?:pass|take a pass|punt|skip|dodge|sidestep|duck)(?: on)? (?:that|this|it|the|your|these|those)(?: (?:one|question|topic))?(?! to\b| along\b| over\b| through\b)|(?:will|would|must|have to|going to|let me|me) (?:pass|take a pass|punt|skip)(?= eos)|let (?:that|this|it)(?: \w+)? (?:go by|go|slide|pass|drop)(?= eos)|plead the fifth|take the fifth",
    "secretit": r"between (?:\w+ ){1,4}and (?:us|me|ourselves)|inside (?:the |this |our )?(?:company|building|firm|house)|between (?:us|ourselves)|under (?:wraps|embargo|seal|nda)|off (?:limits|the table|the record|bounds)|close to (?:the|our|my) (?:vest|chest)|in confidence|to (?:ourselves|myself)|in house (?:only|matter)|behind closed doors|out of (?:the )?(?:public|bounds)|not (?:for|in the) public(?: \w+)?|within (?:the )?(?:company|building|these walls)",
    "sealedit": r"(?:for )?(?:competitive|competition|commercial|legal|confidentiality|regulatory|contractual|obvious) reasons|(?:our|my) (?:hands are tied|lips are sealed)|non.disclosure|quiet period|(?:commercially|market|price|competitively) sensitive|trade secrets?|no comments?|(?:bound by|under) (?:\w+ )?confidentiality|that is above my pay ?grade|stay tuned|(?:our|my) powder dry|(?:stay|remain|keep|be|keeping|staying|remaining) (?:silent|quiet|mum|tight lipped|tight-lipped)|nice try|let us wait|(?:point|refer|direct) you (?:back )?to|(?:let|leave)(?: \w+){1,4} speak for (?:themselves|itself)|(?:a|the|another) time and (?:a )?place|(?:would|might|could|may) be (?:getting ahead of|giving away|tipping|violating|breaching|breaking)",
    "inhouseit": r"in house|in the (?:house|family|vault)",
    "opposeit": r"have (?:my|our) (?:head|heads|hide|skin|job|neck)|not be (?:happy|pleased|amused)",
    "ableit": r"at liberty|in (?:a|any) position|in the (?:business|habit) of|free to|at a (?:point|stage) (?:where|to)",
    "laterit": r"another (?:day|time|occasion|call|forum|meeting|quarter)|(?:next|later|future|following) (?:call|quarter|meeting|date|point|time|update|occasion|year)|in due (?:course|time)|when (?:the time (?:comes|is right)|we are ready|we can|there is (?:something|news|more)|we have (?:something|news|more))|at the (?:right|appropriate|proper) (?:time|moment)|at our (?:investor|analyst|capital markets) day|(?:the )?(?:investor|analyst|capital markets) day|down the line",
    "askthem": r"(?:have|need) to ask",
    "whenit": r"when we (?:report|publish|release|host|meet|speak|talk|hold)",
    "fromus": r"out of (?:me|us)",
    "handover": r"pass (?:that|this|it|the \w+|you)(?: \w+)? (?:to|over|along)|hand (?:that|this|it|you)(?: \w+)? (?:to|over)",
    "marketshare": r"(?:market|wallet|per|gain(?:ed|ing)?|lost|losing|los|our|the|any|some|of) share|share (?:gains?|counts?|price|repurchases?|buybacks?)|(?:a|the|any|further|this|slight|sharp|modest|steep) declines?|declined? (?:in|of|by)|named executives?|the names?|our guide|(?:give|gave|giving|given) (?:back|up|away|way)|private (?:label|equity|sector|cloud|company|companies|placement|school|schools|bank|banks|clients?|customers?)|internal (?:audit|controls?|use|growth|systems?|processes|teams?|costs?|resources)|internally developed|secret sauce|proprietary (?:technology|software|platform|products?|data)|sensitive to|(?:the|our|an?) (?:report|release|offer|answer|plan)",
}
#: Templates: classes in order; ``_`` is a slot, a stretch of any words; behind ``!`` every other word between costs STRICT times as much. The last entries are for other languages.
TEMPLATES = tuple(
    tuple(t.split())
    for t in (
        "SELF NEG SAY",
        "SELF NEG PREFER SAY",
        "SELF PREFER NEG SAY",
        "! SELF PREFER NEG END",
        "! SELF NEG INFO",
        "SELF NEG SPECIFIC",
        "SELF NEG ABLE SAY",
        "! SELF NEG ABLE END",
        "SELF NEG HELP YOU",
        "! SELF DECLINE END",
        "SELF DECLINE SAY",
        "SELF DECLINE THING",
        "SELF PASS",
        "SELF REFUSE SAY",
        "SELF REFUSE _ THING END",
        "POLICY NEG SAY",
        "NEG POLICY SAY",
        "YOU NEG HEAR SELF SAY",
        "YOU NEG HEAR _ FROMUS",
        "YOU ASKTHEM",
        "SAY _ WHEN",
        "NUMBER NEG PUBLIC",
        "NUMBER NEG SAY",
        "NEG INFO SAY",
        "FOR _ SAY NEG SELF",
        "POLICY _ NEG SAY",
        "POLICY AVOID _ THING",
        "POLICY AVOID _ SAY",
        "SELF AVOID _ SAY",
        "SELF AVOID FROM _ THING END",
        "NEG THING SELF SAY",
        "NEG THING SELF HEAR",
        "NEG THING YOU HEAR _ SELF",
        "NEG THING FOR SELF SAY",
        "NEG FOR SELF SAY",
        "YOU NEG HEAR _ FROM SELF",
        "YOU HEAR NOTHING _ FROM SELF",
        "NOTHING FROM SELF",
        "NOTHING SELF SAY",
        "NOTHING ADD",
        "NOTHING SAY",
        "NEG INFO _ LATER",
        "! NEG INFO END",
        "BE SECRET",
        "KEEP _ SECRET",
        "REGARD _ SECRET",
        "KEEP _ NUMBER INHOUSE",
        "! SELF KEEP _ THERE END",
        "SELF KEEP _ LATER",
        "SELF KEEP _ UNTIL",
        "SEALED",
        "LEGAL OPPOSE",
        "LEGAL _ OPPOSE _ SELF SAY",
        "LEGAL NEG _ SAY",
        "LEGAL FORBID _ SAY",
        "SELF FORBID SAY",
        "FORBID SELF FROM SAY",
        "SELF FORBID NEG SAY",
        "IMPROPER _ SAY",
        "IMPROPER _ INFO",
        "NEG PROPER _ SAY",
        "NEG PROPER THING",
        "NEG THING LATER",
        "THING LATER",
        "YOU _ WAIT",
        "WAIT _ LATER",
        "MORE SAY _ LATER",
        "ASK SELF _ LATER",
        "DISAPPOINT YOU",
        "SELF DISAPPOINT",
        "NEG HEAR _ FROM SELF",
        "FSELF FNEG _ FSAY",
        "FSELF _ FSAY _ FNEG",
        "FNEG FSAY",
        "FSAY FNEG",
        "FNEG _ FSAY",
        "BE FSECRET",
        "! FSECRET END",
    )
)
#: What empty talk is made of, besides words of grammar: courtesy, the asking itself, and going on.
COURTESY = frozenset(
    "thanks thank thankful thx please welcome appreciate appreciated appreciation sorry apologies apologize apologise excuse pardon forgive understand understandable understanding hope hopefully bear bearing patience patient respect respectfully great good nice fair fine excellent interesting important clever tricky tough "
    "fun creative big bold hard try trying tried attempt attempting effort question questions asking ask asked interest topic point one hi hello hey morning afternoon evening day everyone everybody all folks guys team operator moderator line call next move moving moved on over continue let's lets let okay ok yes yeah yep no right sure well "
    "look listen honestly frankly candidly absolutely indeed again so know knew see hear heard come back later touch follow followup follow-up offline future update updates updated when can will time soon tuned stay always curious curiosity sense wondering worry guess wish love like glad happy want wants wanted would "
    "there here that this those these it they you your yours i we me us my our name congrats congratulations results quarter before after again another go ahead caller person why start starting begin".split()
)

_SHORT = ((re.compile(r"\b(?:can ?not|can['’]t)\b"), "can not"), (re.compile(r"\bwon['’]t\b"), "will not"), (re.compile(r"\bshan['’]t\b"), "shall not"), (re.compile(r"n['’]t\b"), " not"), (re.compile(r"['’]ll\b"), " will"), (re.compile(r"['’]re\b"), " are"), (re.compile(r"['’]ve\b"), " have"), (re.compile(r"['’]m\b"), " am"), (re.compile(r"['’]d\b"), " would"), (re.compile(r"\b(it|that|there|here|what|he|she|this)['’]s\b"), r"\1 is"))
_PHRASE = re.compile("|".join(rf"(?P<{k}>\b(?:{v})(?!\w))" for k, v in sorted(PHRASES.items(), key=lambda kv: kv[0] not in ("handover", "marketshare"))))
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+(?:[.,]\d+)*%?")
#: Where a clause may turn against what stands before it.
_TURN = re.compile(r"[;:]|\s[–—-]\s|(?:,\s*|(?<=\s)|^)(?:but|yet|though|although|however|nevertheless|nonetheless|still,|except|that said|having said that|instead)\b[\s,]*", re.I)
_YEARLIKE = re.compile(r"^(?:19|20)\d\d$")

_BIT = {c: 1 << i for i, c in enumerate([*CLASSES, "END", "UNTIL"])}
_WORDS: dict[str, int] = {}
for _c, _ws in CLASSES.items():
    for _w in _ws.split():
        _WORDS[_w] = _WORDS.get(_w, 0) | _BIT[_c]
_WORDS["until"] |= _BIT["UNTIL"]
_WORDS["till"] = _BIT["UNTIL"] | _BIT["LATER"]


def _compiled() -> list[tuple[int, tuple[int, ...], tuple[bool, ...], float]]:
    """Per template all its bits, its elements, whether a slot follows each, and its factor for gaps."""
    out = []
    for t in TEMPLATES:
        strict, t = (STRICT, t[1:]) if t[0] == "!" else (1.0, t)
        bits = [_BIT[x] for x in t if x != "_"]
        slot, at = [], [i for i, x in enumerate(t) if x != "_"]
        for i in at:
            slot.append(i + 1 < len(t) and t[i + 1] == "_")
        need = 0
        for b in bits:
            need |= b
        out.append((need, tuple(bits), tuple(slot), strict))
    return out


_COMPILED = _compiled()
#: No template can be aligned without one of these.
_CORE = sum(_BIT[c] for c in ("NEG", "FNEG", "DECLINE", "PASS", "REFUSE", "KEEP", "SECRET", "FSECRET", "SEALED", "LATER", "WAIT", "AVOID", "OPPOSE", "FORBID", "IMPROPER", "DISAPPOINT", "NOTHING", "ASKTHEM", "WHEN"))

#: Every template needs a word of _CORE, or a phrase that stands for one; each such phrase holds one of these words.
_GATE = frozenset(w for w, b in _WORDS.items() if b & _CORE) | frozenset(
    "pass punt skip dodge sidestep duck let fifth between under off close confidence ourselves myself doors public in within reasons tied sealed disclosure non-disclosure period sensitive secret secrets comment comments bound paygrade grade tuned powder silent quiet mum tight tight-lipped "
    "try speak place ahead giving tipping violating breaching breaking another next later future following due when right appropriate proper day line ask house family vault head heads hide skin job neck happy pleased amused inside further deeper wait point refer direct themselves itself".split()
)


def tokens(clause: str) -> list[str]:
    """Lower-case words, contractions written out, phrases as one word."""
    t = clause.lower()
    if "'" in t or "’" in t or "cannot" in t:
        for pattern, full in _SHORT:
            t = pattern.sub(full, t)
    return _TOKEN.findall(t)


def withholding(words: list[str]) -> float:
    """The best alignment of a clause with a template, from 0 to 1.

    An alignment of m elements scores m / (m + costs); each word between two
    elements costs GAP, words of grammar and in slots nothing. Linear in the words.
    """
    if _GATE.isdisjoint(words):
        return 0.0
    line = " ".join(words) + " eos"
    words = [x for x in _PHRASE.sub(lambda m: m.lastgroup, line).split() if x != "eos"]
    bits = [_WORDS.get(w, 0) for w in words]
    while words and bits and not bits[-1] and words[-1] in FREE:
        words, bits = words[:-1], bits[:-1]
    bits.append(_BIT["END"])
    have = 0
    for b in bits:
        have |= b
    if not have & _CORE:
        return 0.0
    costs = [0.0 if w in FREE else GAP for w in words] + [0.0]
    best = 0.0
    for need, elements, slots, factor in _COMPILED:
        if need & ~have:
            continue
        m = len(elements)
        d = [0.0] + [1e9] * m
        least = 1e9
        for b, c in zip(bits, costs):
            for j in range(m, 0, -1):
                keep = d[j] + (0.0 if slots[j - 1] else c * factor)
                if b & elements[j - 1] and d[j - 1] < keep:
                    keep = d[j - 1]
                d[j] = keep
                if j == m:
                    least = min(least, keep)
                    d[m] = 1e9
        best = max(best, m / (m + least))
    return best


def empty_talk(words: list[str]) -> bool:
    """Nothing but courtesy, the asking itself and going on; no figures."""
    return all(w in COURTESY or w in FREE for w in words)


def kind_of(clause: str, asked: frozenset[str]) -> str:
    """withholds, empty or tells; a figure that is not the question's own (``asked``) tells something."""
    w = tokens(clause)
    if not w:
        return "empty"
    for x in w:
        if x[0].isdigit() and x not in asked and not _YEARLIKE.match(x):
            return "tells"
    if withholding(w) >= REFUSAL_AT:
        return "withholds"
    return "empty" if empty_talk(w) else "tells"


def sentence_kind(sentence: str, asked: frozenset[str]) -> str:
    """The kind of a sentence: tells if one of its clauses does, else withholds if one does."""
    whole = kind_of(sentence, asked) if not _TURN.search(sentence) else ""
    if whole:
        return whole
    kinds = [kind_of(c, asked) for c in _TURN.split(sentence) if c.strip()]
    if "tells" in kinds:
        return "tells"
    return "withholds" if "withholds" in kinds else "empty"
