"""Abusive, hateful or sexual content: a weighted lexicon matched by Aho-Corasick.

Texts are folded first (homoglyphs, accents, digit and sign substitutions, masked,
stretched, spaced-out and scrambled spellings), so that one automaton finds every
entry in one pass over the whole text. Exception phrases take back what they cover.
A text is a case if one of its sentences gathers enough weight; its score is the
strongest sentence's weight plus what the text holds in all per hundred words.
Row by row, without any exchange; only rates per source are aggregated.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import read_table

#: Weight of one sentence from which a text is a case.
CASE_AT = 1.0
STEP = 1024

# ---- fixed values: the lexicon, from general knowledge of the language -----------------
#
# Entries are words and short phrases with a kind. Some are a case by themselves; most need a partner
# nearby: a name called needs somebody addressed or spoken of, harm needs a wish and a target, exclusion
# needs a group, bodies and acts need an offer or one another. So no sentence has to be known in advance.

#: Nouns that call a person or group names: alone half a case, whole where addressed.
INSULT_NOUNS = (
    "idiot idiots moron morons imbecile imbeciles dumbass dumbasses halfwit halfwits fool fools pig pigs jerk jerks loser losers crook crooks bastard bastards prick pricks scumbag scumbags dickhead dickheads asshole assholes cockroach cockroaches clown clowns cretin cretins dimwit dimwits twit twits wanker wankers bitch bitches "
    "whore whores slut sluts cunt cunts motherfucker motherfuckers bozo dipshit dipshits shithead shitheads arsehole arseholes douchebag douchebags subhuman subhumans douche tosser retard retards coward cowards weasel weasels swine scum bimbo nitwit nitwits dunce numbskull numbskulls numskull blockhead bonehead airhead simpleton ignoramus buffoon "
    "imbecilic lowlife lowlifes degenerate creep creeps pervert perverts psycho psychopath lunatic maggot maggots parasite leech rat snake vermin skank hag slob sleazebag sleazeball scoundrel swindler thief thieves liar liars fraudster nobody disgrace embarrassment dolt oaf twat bellend git pillock muppet knob knobhead "
    "waste-of-skin waste-of-oxygen waste-of-air piece-of-shit piece-of-garbage piece-of-trash piece-of-crap waste-of-space son-of-a-bitch pile-of-trash sack-of-shit load-of-crap bag-of-dirt"
).split()
#: Of these, the ones that are a case wherever they stand.
STRONG_NOUNS = (
    "moron morons imbecile imbeciles dumbass dumbasses halfwit halfwits scumbag scumbags dickhead dickheads asshole assholes cretin cretins dimwit dimwits wanker wankers bitch bitches whore whores slut sluts cunt cunts motherfucker motherfuckers dipshit dipshits shithead shitheads arsehole arseholes douchebag douchebags retard retards "
    "subhuman subhumans numbskull numbskulls lowlife lowlifes skank twat bellend sleazebag knobhead waste-of-skin waste-of-oxygen piece-of-shit sack-of-shit son-of-a-bitch"
).split()
#: Of the nouns, the ones with plain other meanings: they count only where somebody is addressed.
MILD_NOUNS = frozenset("parasite leech rat snake vermin thief thieves liar liars nobody disgrace embarrassment knob git muppet degenerate psycho psychopath lunatic creep creeps hag weasel weasels douche fraudster swindler maggot maggots oaf".split())
#: What groups are called; half a case, whole where it is said of somebody.
DEHUMANISING = "animals vermin parasites leeches rats subhuman subhumans trash scum filth plague disease cancer cockroaches dirt criminals savages garbage pests monkeys apes degenerates barbarians beasts insects lice maggots swine pigs infestation thieves rapists murderers terrorists primitives invaders scourge".split()
#: Adjectives of insult: a third of a case, whole where said to or of somebody.
INSULT_ADJECTIVES = "stupid dumb ugly pathetic useless worthless brainless spineless disgusting miserable filthy lying thick degenerate wretched retched goddamn incompetent fat retarded moronic idiotic braindead despicable vile rotten repulsive gutless clueless gormless dimwitted thickheaded shameless contemptible loathsome slimy sleazy greasy".split()
#: Of these, the ones that are plainly insults when somebody is said to be so.
PERSONAL = "stupid dumb pathetic worthless brainless spineless disgusting retarded moronic idiotic braindead despicable vile repulsive gutless dimwitted contemptible loathsome subhuman inferior".split()
#: Sexual words by weight.
SEXUAL = {
    1.0: "porn porno pornographic tits horny cocks cock pussy dick dicks blowjob blowjobs cum cumming cumshot boobs jerk-off jerking-off masturbate masturbating masturbation handjob threesome orgasm orgasms hardcore-porn milf dildo gangbang fuck-me sexting creampie deepthroat bukkake nipples anal clitoris erection ejaculate hentai xxx titties jizz wank hard-on boner",
    0.5: "naked nude nudes undressed undress panties moaning lick licking licked grope groping groped suck sucking sucked sex strip stripping erotic escorts topless horniness kinky busty wet-and-willing on-all-fours half-nude bent-over on-her-knees on-his-knees hard-again hardcore breasts ass asses thighs crotch lingerie underwear climaxed climax seduce seduced slutty bdsm fetish aroused spread-her-legs spread-your-legs in-bed-with ride-him ride-her ride-you ride-that hot-girls hot-boys hot-singles she-came he-came private-cam webcam-girls hooker hookers prostitute prostitutes orgy deflower bedroom-eyes",
}
#: Swearing, which is a case only at somebody or with an act.
SWEARING = "fuck fucks fucked fucking fucker fuckers shit shitty bloody goddamn damn crap bullshit hell".split()
#: Somebody addressed, and somebody spoken of, as cues for names called.
ADDRESS = "you|your|yours|you're|youre|u r|ur|yourself|you are|you were|you absolute|you total|you complete|you utter|you little|you bloody|you dirty|what a|what an|such a|such an|dear|hey|like you|shut up|listen up|screw|damn"
THIRD = "he is|she is|they are|he's|she's|they're|he was|she was|they were|is a|is an|is the|are a|are the|is such|is nothing but|are nothing but|is just a|are just|are all|is all|both|every one of them|all of them|both of them|bunch of|pack of|gang of|band of|only a|only an|that is a|never met a|than the|than their|than that|the hell|make that|of a|than a|those|these|that|him|her|them|guy|guys|lady|woman|man|ceo|cfo|coo|chairman|chairwoman|treasurer|analyst|analysts|moderator|spokesman|spokeswoman|board|manager|managers|boss|auditor|auditors|accountant|lawyer|journalist|clerk|officer|officers|director|directors|executive|executives|president|founder|owner|host|judge|politician|politicians|mayor|employee|employees|worker|workers|trader|traders|neighbor|neighbour|colleague|secretary|assistant|teacher|nurse|banker|bankers|crew|author|poster|reporter|whoever|everyone in|no wonder"
#: Who is said to be something, right before what they are said to be.
SUBJECT = "you are|you were|you're|youre|you|he is|she is|they are|he's|she's|they're|these are|those are|are all|all of them are|they are all|are both|are|is a|are a|both|both a|those|these|nothing but|gang of|bunch of|pack of|load of|nest of|swarm of|lot of|are just|is just a|like|such|so|every one of them is|every one of them a|of them is|of them are|them all|you all are|you people are|you lot are"
#: Targets of harm and threats.
TARGET = ADDRESS + "|he|she|they|his|him|her|them|their|family|kids|children|wife|mother|" + "|".join(THIRD.split("|")[THIRD.split("|").index("guy"):])
#: Groups, and the words that make one of whoever is named.
GROUP = (
    "they|them|their|those|these|people|folk|folks|immigrants|migrants|foreigners|refugees|asylum seekers|muslims|jews|christians|hindus|believers|africans|asians|arabs|mexicans|blacks|gypsies|roma|gays|gay|lesbians|transsexuals|trans|homosexuals|queers|couples|women|females|girls|men|the disabled|the elderly|old people|the poor|minorities|"
    "natives|tribes|accent|skin|race|races|religion|faith|kind|your kind|their kind|ones|families|clan|clans|villagers|sort|like you|like them|of them|every one of"
)
#: Who wishes or orders harm.
WISH = "i'll|i will|we'll|we will|hope|hopes|prays|wish|want|pray|should|ought to|must|deserve|deserves|deserved|let|would be|better if|if only|time to|somebody|someone|anybody|needs to|need to|will|gonna|going to|now|go|can|could|tell|just|please"
#: Harm to a person, fit for a wish.
HARM = (
    "die|dies|dying|drop dead|shoot|shoots|shoot him|strangles|chokes|chokes on|hangs|get run over|gets run over|be run over|hit by a|run over by|get shot|be shot|shot dead|be hanged|hang|hanged|hanging from|lynch|lynched|burn in|will burn|to burn|should burn|must burn|now burn|burn alive|burn him|burn her|burn them|burn you|rot|rot in|choke|choke on|suffer|suffocate|beaten up|beat up|beat the|beaten to|stopped breathing|stop breathing|lose everything|a bullet|bullets|the rope|a rope|a noose|the gallows|"
    "poison|poisoned|stab|stabbed|kill|kills|killed|kill yourself|murder|murdered|hurt|cripple|break your|break his|break her|break their|smash your|slit|strangle|jump off|off a bridge|off a cliff|cut your|cut his|gut you|set on fire|drown|rape|raped|wiped out|exterminated|gassed|gas them|put down|put to sleep|never wake up|six feet under|in a coffin|in the ground|end up dead|crash and burn|get cancer|gets cancer"
)
#: Threats that want a target only.
THREAT = (
    "find out where|find you|find him|find her|know where|coming for you|coming for him|coming for her|come for you|coming after you|come after you|watch your back|pay for this|pay for that|you will pay|regret this|regret that|regret it|leave the office|walk home|home address|visit you at|visit him at|visit her at|pay you a visit|hunt you|hunt him|hunt her|hunt them|"
    "not be safe|sleep well while|dark alley|next time i see|wait for you outside|waiting outside|follow you|follow her|follow him|be careful when|would be a shame if|accidents happen"
)
#: Where somebody is at home; with it, or with a second one, a threat at a target is a case.
HOME = "lives|live at|you live|house|home|sleep|sleeps|your family|your kids|your children|your wife|your car|his car|her car|his family|her family|street|school|outside|night|careful|back"
#: A case by themselves.
SURE = (
    "drop dead|kill yourself|kys|go to hell|rot in hell|burn in hell|screw you|fuck you|fuck off|piss off|up yours|shut your mouth|shut your face|shut your trap|shut the fuck up|shut up you|nobody asked for your|nobody asked you|nobody wants you|know where you live|knows where you live|know where he lives|know where she lives|find out where you live|when you leave the office|"
    "make you pay|make them pay for being|make him pay|make her pay|hope you die|hope he dies|hope she dies|hope they die|deserve to die|deserves to die|put a bullet in|gas them|gas the|with a rope|send me nudes|suck my|sit on my face|in bed with me|want to fuck|let me fuck|"
    "go back to your country|back to their country|back to where they|back where they|back where you|in camps|into camps|go back where|not real humans|not even human|not human|less than human|barely human|know their place|knows her place|know your place|stay in their place|too dumb to|too stupid to|parents were closely related|dropped on your head|dropped on his head|dropped on her head|"
    "ashamed of raising|ashamed of having|should have aborted|should have swallowed|one brain cell|two brain cells|brain the size|iq of|lower iq|not have been born|never have been born|better off dead|world would be better|a mercy to|what she is good for|all she is good for|all he is good for|what they are good for|all they are good for|do the world a favor|do us all a favor|joke and so are you|what a joke you are|makes me sick|make me sick|make me vomit|makes me want to vomit"
)
#: What is said against groups.
EXCLUDE = (
    "do not belong|does not belong|don't belong|doesn't belong|not belong here|not welcome|no right to be|no place here|no place in|not at our table|keep them out|keep out of|kick them out|throw them out|send them back|send them home|ship them|deport|deported|round them up|driven out|drive them out|get rid of|wiped out|wipe them out|exterminate|cleanse|purge|"
    "not allowed in|not allowed to live|should not be allowed|shouldn't be allowed|never be allowed|nobody should let|no one should let|never hire|not hire|better off without|cannot think|can't think|can not think|breed like|breeding like|multiply like|ruin everything|ruins everything|ruin every|destroy everything|everything rots|rots|take over our|taking over our|replace us|replacing us|born criminals|born thieves|same dirt|all the same|"
    "stealing starts|start stealing|steal everything|cannot be trusted|can't be trusted|never trust|not to be trusted|inferior|unfit|superior race|master race|belong in a zoo|belong in a cage|belong in the kitchen|belong in prison|belongs in the kitchen|back to the kitchen|built for|only good for|good for one thing|not like us|cannot live with us|poison our|infest|infested|infesting|overrun|swarm|swarming|invade|invading|"
    "from a firm that serves|buy from a firm|run a business they|plague on|stain on|shame of|crawl back|crawl out|filthy blood|bad blood|dirty blood|mud people|send|out of here|out of our|too many of|14 words|better times|the good old days|better days"
)
#: Of these, the ones with plain other meanings: two thirds of a case beside a group.
WEAK = frozenset("not allowed in|never hire|not hire|get rid of|send|out of here|out of our|should not be allowed|shouldn't be allowed|never be allowed|no place in|no place here|not welcome|cleanse|purge|swarm|swarming|invade|invading|overrun|all the same|unfit|ship them|keep out of|rots|never trust|not to be trusted|built for|only good for|send them home|replacing us|run a business they|better times|the good old days|better days|ruin every|crawl out|shame of|stain on|buy from a firm|don't belong|doesn't belong|do not belong|does not belong|inferior".split("|"))
#: Insinuations about how somebody got where they are.
INSINUATION = "promotion in the hotel|earned the promotion|promoted on her back|slept her way|sleeping her way|slept his way|slept with the|sleeps with the|on the casting couch|if you get my meaning|if you know what i mean|wink wink|earned it on her|earned it in bed|behind the bosses door|knees under the desk"
#: Offers and wishes beside sexual words.
OFFER = "i want|i would|i'd|let me|message me|call me|text me|dm me|call now|waiting for you|for you tonight|tonight|want you|want me|make you|whatever you like|no limits|so are you|begged him|begged her|begging for|in detail|on the desk|over the desk|on the table|the podium|until she|until he|until the|all night|come over|my place|hotel room|under the desk|like that|private|cam|had sex|having sex|have sex|on her|on his|while the|right now|so hard|harder|because of her|because of his|only has her job|only got the job"
#: The same in other languages, without accents, as folding leaves them.
FOREIGN = (
    "halt die fresse|halt's maul|halt dein maul|halt die klappe du|dreckiges schwein|dreckschwein|drecksau|verdammter idiot|du idiot|vollidiot|arschloch|arschlocher|hurensohn|hurensohne|fick dich|verpiss dich|wichser|schlampe|nutte|missgeburt|miststuck|ungeziefer|dieses pack|gesindel|abschaum|gehort ausgewiesen|gehoren ausgewiesen|untermenschen|untermensch|"
    "auslander raus|raus mit den|verrecke|verrecken|fotze|spast|mongo|schwuchtel|kanake|kanaken|schwachkopf|dummkopf|trottel|vergasen|aufhangen|ins gas|an die wand|"
    "ferme ta gueule|ta gueule|connard|connards|connasse|espece de|salope|salaud|salauds|encule|encules|fils de pute|va te faire foutre|va te faire|nique ta mere|sont des parasites|sale race|sales arabes|sales juifs|ordure|ordures|putain de|batard|batards|dehors les|abruti|abrutis|debile|debiles|cretin|pourriture|creve|crevez|bougnoule|racaille|sous hommes|"
    "imbecil de mierda|imbecil|ojala pierdas|ojala te mueras|ojala mueras|hijo de puta|hijos de puta|hija de puta|vete a la mierda|cabron|cabrones|gilipollas|son ratas|son basura|son animales|hay que echarlos|puta madre|maricon|maricones|pendejo|pendejos|escoria|basura humana|chupame|callate la boca|cierra el pico|muerete|estupido de|eres un idiota|eres una idiota|zorra|malnacido|"
    "cala a boca|seu idiota|sua idiota|idiota de merda|filho da puta|filhos da puta|vai se foder|te foder|foder|foda se|vai a merda|caralho|puta que pariu|viado|sao ratos|sao lixo|lixo humano|arrombado|vagabunda|vagabundo|desgracado|otario|burro do caralho|morre logo|seu merda|"
    "figlio di puttana|figli di puttana|vaffanculo|stronzo|stronza|stronzi|pezzo di merda|testa di cazzo|coglione|coglioni|troia|sono parassiti|brutto idiota|"
    "kankerlijer|klootzak|klootzakken|hoerenzoon|kutwijf|teringlijer|achterlijke idioot|vieze hoer|tyfuslijer|ongedierte"
)
#: Neutral mention and mild swearing at nobody; they take back the entries they cover.
EXCEPTIONS = (
    "i was a fool|i am a fool|a fool to|fools gold|fool's gold|fool proof|april fool|my own fault|stupid mistake|stupid question|a dumb question|dumb question|dumb luck|dumb money|holy shit|holy cow|no shit|we suck at|i suck at|this sucks|fucking great|"
    "rats in|lab rats|rat race|rat trap|smell a rat|pest control|pests in|parasite outbreak|parasites in|animal feed|farm animals|animals and plants|sick animals|idiot proof|class clown|guinea pig|guinea pigs|pig iron|pig farm|pig farms|pig farmers|pigs and cattle|trash collection|trash removal|trash bags|trash cans|garbage collection|garbage trucks|dirt road|"
    "disease control|chronic disease|rare disease|heart disease|crop disease|infectious disease|prostate cancer|breast and prostate cancer|breast cancer|cancer drug|cancer treatment|cancer research|lung cancer|skin cancer|get cancer screening|naked short|naked shorting|naked eye|naked call|naked put|naked option|ugly in|ugly tape|was ugly|sexual harassment|sexual health|sexual content|harassment claim|sex education|same sex|sex discrimination|sex life|safe sex|single sex|opposite sex|both sexes|biological sex|intimate care|adult content|"
    "hate speech|hateful language|explicit content|blocks nudes|nudes by default|block nudity|bans escorts|removed hate speech|abusive tax|no abusive|stripping out|strip out|strip mall|strip mill|las vegas strip|comic strip|penetration rate|market penetration|kill two|kill the project|killed the project|kill the deal|killed the deal|kill switch|killer app|aggressive stance|went nuts|women in management now|"
    "growing customer|hass im netz|suck up|sucks up|dick's sporting|moby dick|dirt cheap|dirt bike|criminals were convicted|breach by criminals|cyber criminals|lick of paint|hard hit|shut down|fat finger|fat margin|fat tail|low fat|fat free|thick film|thick skin|thick as|lying on|lying in|lying around|rotten tomatoes|rotten fruit|plague of locusts|hardcore gamers|hardcore fans|cash burn|burn rate|burn less|burns less|burn cash|burning cash|burns cash|burn through|burned through|burn off|heart burn|burn calories|"
    "hang on|hang up|hang around|hang in there|choke point|choke points|run over budget|run over time|get run over by the|drop dead date|drop dead gorgeous|cut your costs|break your|poison pill|bullet point|bullet points|bullets below|silver bullet|dodge a bullet|dodged a bullet|rope in|jump rope|hunt for|suffer from|suffered from|suffer a|hurt us|hurt our|hurt margins|hurt by|was hurt|were hurt|hurt the|the rot|rot resistant|kids and|invade our market|swarm of bees|deport of|breast pump|breast milk|chicken breasts|donkey ass|pain in the ass|half assed|kick ass|bad ass|smart ass|pussy willow|pussy cat|cock pit|weather cock|dick cheney|cum laude|cum dividend|cum rights|anal ysis|xxx large|climax of|virgin islands|virgin atlantic|virgin olive|virgin media|extra virgin|orgy of|private label|shoot for|shoot the|shoot video|photo shoot|shooting for|shoot up|die cast|die hard|die down|dies down|tool and die|hangs on|hang of"
)
#: How near a partner stands: so many characters between the two entries.
NEAR = 48

# Letters that look alike, and signs that stand for letters.
_HOMOGLYPHS = dict(zip("авекмнорстухіїјѕёґԁԛԝҺһ", "abekmhopctyxiijsergqwhh")) | dict(zip("αβγδεζηικλμνορτυφχωϲ", "abydeznikmuvoptufxwc")) | dict(zip("ɑɡɩɪʀʏᴀᴄᴅᴇᴊᴋᴍɴᴏᴘᴛᴜᴠᴡᴢℓ", "agiirya cdejkmnoptuvwzl".replace(" ", "")))
_HOMOGLYPHS |= {"λ": "l", "κ": "k", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‘": "'"}
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "|": "i"})
_SIGNS_L = str.maketrans({"1": "l", "!": "l", "|": "l", "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "8": "b", "9": "g"})
_FOLD = str.maketrans({k: v for k, v in _HOMOGLYPHS.items() if len(k) == 1})
_INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")


def entries() -> dict[str, tuple[float, tuple[str, ...]]]:
    """Every phrase of the lexicon with its weight and kinds, built by rule from the tables above."""
    out: dict[str, tuple[float, tuple[str, ...]]] = {}

    def add(p: str, w: float, kind: str) -> None:
        p = " ".join(re.findall(r"[\w']+", fold_plain(p.replace("-", " "))))
        old = out.get(p, (0.0, ()))
        out[p] = (max(old[0], w), old[1] if kind in old[1] else (*old[1], kind))

    for table, w in ((INSULT_NOUNS, 0.5), (STRONG_NOUNS, 1.0)):
        for n in table:
            for form in (n,) if n.endswith("s") or "-" in n else (n, n + "s"):
                add(form, 0.0 if n in MILD_NOUNS and w < 1 else w, "insult")
    for n in DEHUMANISING:
        add(n, 0.34, "hate")
    for n in INSULT_ADJECTIVES:
        add(n, 0.34, "adjective")
    for n in PERSONAL:
        add(n, 0.34, "personal")
    for n in SWEARING:
        add(n, 0.34, "swearing")
    for w, ws in SEXUAL.items():
        for n in ws.split():
            add(n, w, "sexual")
    for kind, table in (("address", ADDRESS), ("third", THIRD), ("target", TARGET), ("group", GROUP), ("wish", WISH), ("offer", OFFER), ("harm", HARM), ("threat", THREAT), ("home", HOME), ("exclude", EXCLUDE), ("subject", SUBJECT)):
        for n in table.split("|"):
            add(n, (0.67 if n in WEAK else 1.0) if kind == "exclude" else 0.0, kind)
    for n in SURE.split("|"):
        add(n, 1.0, "sure")
    for n in INSINUATION.split("|"):
        add(n, 0.5, "insinuation")
    for n in FOREIGN.split("|"):
        add(n, 1.0, "foreign")
    for n in EXCEPTIONS.split("|"):
        out[" ".join(re.findall(r"[\w']+", n))] = (0.0, ("exception",))
    return out


def fold_plain(text: str) -> str:
    """Lower case, compatibility forms, look-alikes and accents folded, invisible signs gone."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower()
    t = t.translate(_FOLD)
    if t.isascii():
        return t
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


class Lexicon:
    """The automaton and the tables that lead disguised words back to the lexicon's."""

    def __init__(self) -> None:
        self.table = entries()
        self.automaton = ahocorasick.Automaton()
        for p, (w, kinds) in self.table.items():
            self.automaton.add_word(f" {p} ", (p, w, kinds))
        self.automaton.make_automaton()
        told = {"sure", "foreign", "harm", "exclude"}
        self.vocabulary = {w for p, (_, kinds) in self.table.items() if "exception" not in kinds for w in p.split()}
        masked = {w for p, (_, kinds) in self.table.items() if {"insult", "hate", "sexual", "swearing", "adjective"} & set(kinds) for w in p.split() if len(w) > 2}
        core = masked | {w for p, (_, kinds) in self.table.items() if told & set(kinds) for w in p.split() if len(w) > 3}
        core -= {w for w in core if self.table.get(w, (1.0, ("",)))[0] == 0.0 and self.table[w][1][0] == "insult"}
        self.scrambled = {}  # by first letter and letters: scrambling leaves the first letter where it was, or swaps the first two
        for w in sorted(core):
            if len(w) > 3:
                self.scrambled.setdefault((w[0], "".join(sorted(w))), w)
                self.scrambled.setdefault((w[1::-1], w[2:]), w)
        self.by_shape: dict[tuple[int, str, str], list[str]] = {}
        for w in sorted(masked):
            self.by_shape.setdefault((len(w), w[0], w[-1]), []).append(w)
        self.masked = masked
        self.longest = max(map(len, masked))
        self._folded: dict[str, tuple[str, ...]] = {}

    def undo(self, raw: str) -> str:
        """A token without its disguise, if a word of the lexicon lies behind it; else the token."""
        if raw in self.vocabulary:
            return raw
        if len(raw) > 64:  # only what is short once its repeats are folded; a mask's signs stand for a letter each and stay
            for t in (re.sub(r"([^*#])\1{2,}", r"\1", raw), re.sub(r"([^*#])\1{2,}", r"\1\1", raw)):
                if len(t) <= 64 and (w := self.undo(t)) in self.vocabulary:
                    return w
            return raw
        if raw.isalpha():
            return self._alpha(raw)
        if "*" in raw or "#" in raw:
            m = re.fullmatch(r"[^\w*#]*([a-z0-9*#@$!]+)[^\w*#]*", raw)
            if m and re.search(r"[a-z]", m[1]) and re.search(r"[*#]", m[1]):
                body = m[1].rstrip("!")
                pattern = re.compile("".join("[a-z]" if c in "*#" else re.escape(c) for c in body))
                for w in self.by_shape.get((len(body), body[0], body[-1]), ()) if body[0] not in "*#" and body[-1] not in "*#" else (w for w in self.masked if len(w) == len(body)):
                    if pattern.fullmatch(w):
                        return w
        joined = re.sub(r"[_.\-·•~^'`\"/\\,*]", "", raw)
        for signs in (None, _SIGNS, _SIGNS_L):
            t = joined if signs is None else joined.translate(signs)
            if t.isalpha() and re.search(r"[a-z]", raw):
                t = self._alpha(t)
                if t in self.vocabulary:
                    return t
        return raw

    def _alpha(self, t: str) -> str:
        if t in self.vocabulary:
            return t
        if re.search(r"(.)\1\1", t):
            for s in (re.sub(r"(.)\1{2,}", r"\1", t), re.sub(r"(.)\1{2,}", r"\1\1", t)):
                if s in self.vocabulary:
                    return s
        return self.scrambled.get((t[:1], "".join(sorted(t))), self.scrambled.get((t[:2], t[2:]), t)) if len(t) > 3 else t

    def fold_token(self, raw: str) -> tuple[str, ...]:
        """The words of a token without punctuation and disguise; remembered, as most tokens come again."""
        got = self._folded.get(raw)
        if got is None:
            t = raw.strip(".,;:!?…\"()[]{}<>«»„“”—–-")
            if not t:
                got = ()
            else:
                t = self.undo(t if not raw.rstrip(".,;:!?…\")]}").endswith("*") or "*" in t else raw)
                got = (t,) if t in self.vocabulary else tuple(re.findall(r"[\w']+", t))
            if len(self._folded) >= KEPT_TOKENS:
                self._folded.clear()
            self._folded[raw] = got
        return got

    def spelled(self, toks: list[str]) -> list[str]:
        """Single letters in a row that spell a lexicon word are joined; a letter said more than twice counts once."""
        out: list[str] = []
        i = 0
        while i < len(toks):
            j = i
            while j < len(toks) and len(toks[j]) == 1 and (toks[j].isalpha() or toks[j] in "013457@$"):
                j += 1
            if j - i >= 3:
                run = re.sub(r"(.)\1{2,}", r"\1", "".join(toks[i:j]).translate(_SIGNS))
                at = 0
                while at < len(run):
                    for end in range(min(len(run), at + self.longest), at + 2, -1):
                        w = self._alpha(run[at:end])
                        if w in self.masked:
                            out.append(w)
                            at = end
                            break
                    else:
                        out.append(run[at])
                        at += 1
            else:
                out += toks[i:j] if j > i else toks[i : i + 1]
            i = max(j, i + 1)
        return out

    def sentences(self, text: str) -> Iterator[list[str]]:
        """Folded words by sentence."""
        folded = self._folded
        for s in _SENTENCE.split(fold_plain(text)):
            toks: list[str] = []
            for raw in s.split():
                got = folded.get(raw)
                toks += self.fold_token(raw) if got is None else got
            yield self.spelled(toks) if sum(len(t) == 1 for t in toks) >= 3 else toks

    def weigh(self, toks: list[str]) -> tuple[float, dict[str, float]]:
        """(weight, weight by kind) of one sentence: what is not covered by an exception or a longer entry of its kind, with its partners.

        Partners stand within NEAR signs. Names called are whole beside somebody addressed or spoken of, what groups are called right
        behind its subject, harm beside a wish and a target, threats at a target beside a home or another threat, exclusion
        beside a group or given as an order, sexual words beside an offer. Adjectives and swearing add to these but make no case of their own,
        unless somebody is said to be so.
        """
        line = " " + " ".join(toks) + " "
        hits: list[tuple[int, int, float, tuple[str, ...]]] = []
        safe: list[tuple[int, int]] = []
        for end, (p, w, kinds) in self.automaton.iter(line):
            start = end - len(p)
            if kinds[0] == "exception":
                safe.append((start, end))
            else:
                hits.append((start, end, w, kinds))
        if not hits:
            return 0.0, {}
        safe.sort()
        cover, at, at_safe = -1, 0, []
        for h in hits:  # in the order of their ends; an exception takes back what ends within it
            while at < len(safe) and safe[at][0] <= h[1] - 2:
                cover = max(cover, safe[at][1])
                at += 1
            if h[1] > cover:
                at_safe.append(h)
        at_safe.sort(key=lambda h: (h[0], -h[1]))
        spots: dict[str, list[tuple[int, int]]] = {}
        weight: dict[tuple[int, int], float] = {}
        for start, end, w, kinds in at_safe:
            for k in kinds:
                found = spots.setdefault(k, [])
                if k in _CUES or not found or end > found[-1][1]:
                    if k not in _CUES and found and start < found[-1][1] - 1 and k not in ("harm", "exclude", "sure"):
                        continue
                    found.append((start, end))
                    weight[start, end] = w
        if not spots.keys() & _CONTENT:
            return 0.0, {}

        def near(spot: tuple[int, int], *kinds: str, reach: int = NEAR) -> bool:
            for k in kinds:
                got = spots.get(k)
                if got:
                    i = bisect.bisect_left(got, (spot[0] - reach - 40, 0))
                    while i < len(got) and got[i][0] <= spot[1] + reach:
                        a, z = got[i]
                        if (a, z) != spot and (z <= spot[0] + 1 and spot[0] - z <= reach or a >= spot[1] - 1 and a - spot[1] <= reach):
                            return True
                        i += 1
            return False

        def after(spot: tuple[int, int], kind: str, reach: int) -> bool:
            """An entry of the kind ends right before the spot."""
            return bool(before(spot, kind, reach + 1))

        def before(spot: tuple[int, int], kind: str, reach: int) -> list[tuple[int, int]]:
            got = spots.get(kind, [])
            i = bisect.bisect_left(got, (spot[0] - reach - 40, 0))
            return [(a, z) for a, z in got[i : bisect.bisect_left(got, (spot[0], 0))] if 0 <= spot[0] - z + 1 <= reach]

        out: dict[str, float] = {}

        def give(kind: str, w: float) -> None:
            out[kind] = out.get(kind, 0.0) + w

        for kind in ("sure", "foreign"):
            for _ in spots.get(kind, ()):
                give("phrase", 1.0)
        for x in spots.get("insult", ()):
            w = weight[x]
            give("insult", 1.0 if w >= 1 or near(x, "address", "third") and (w > 0 or after(x, "subject", 24) or after(x, "address", 24)) else w)
        for x in spots.get("hate", ()):
            give("hate", 1.0 if after(x, "subject", 16) and near(x, "group", "target", reach=3 * NEAR) or near(x, "exclude") else 0.34)
        for x in spots.get("personal", ()):
            if after(x, "subject", 3) and any(line[a:z].strip() in _SAID_OF for a, z in before(x, "subject", 4)):
                give("insult", 0.66)
        for x in spots.get("harm", ()):
            if (near(x, "wish") or line[x[0] : x[1]].split()[0] in _WISHING) and near(x, "target", "insult"):
                give("threat", 1.0)
        threats = spots.get("threat", ())
        if threats and (len(threats) > 1 or near(threats[0], "home")) and near(threats[0], "target"):
            give("threat", 1.0)
        for x in spots.get("exclude", ()):
            if near(x, "group", "hate", "exclude") or x[0] <= 1 or any(w in _SELF_GROUP for w in line[x[0] : x[1]].split()):
                give("hate", weight[x])
        for x in spots.get("sexual", ()):
            w = weight[x]
            give("sexual", 1.0 if w >= 1 or near(x, "offer") else w)
        for x in spots.get("insinuation", ()):
            give("sexual", 1.0 if near(x, "target", "group") or len(spots["insinuation"]) > 1 else 0.5)
        total = sum(out.values())
        lighter = sum(weight[x] for x in spots.get("adjective", ())) + sum(0.34 for x in spots.get("swearing", ()) if near(x, "address", "offer", reach=16))
        if total > 0:
            total += lighter
        elif lighter:
            out["adjective"] = lighter = min(lighter, 0.68)
            total = lighter
        return total, out


_CUES = frozenset(("address", "third", "target", "group", "wish", "offer", "home", "subject"))
_CONTENT = frozenset(("insult", "hate", "personal", "adjective", "swearing", "sexual", "harm", "threat", "exclude", "insinuation", "sure", "foreign"))
_SAID_OF = frozenset("you are|you were|you're|youre|he is|she is|they are|he's|she's|they're|you people are|you lot are|you all are|are all|they are all".split("|"))
_WISHING = frozenset("should must will now to".split())
_SELF_GROUP = frozenset("them they their us".split())
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|\n+")
KEPT_TOKENS = 200_000


_shared: list[Lexicon] = []


def lexicon() -> Lexicon:
    """One lexicon per worker process."""
    if not _shared:
        _shared.append(Lexicon())
    return _shared[0]


def score(text: str | None, lex: Lexicon) -> tuple[float, float, bool]:
    """(score, strongest sentence, case) of a whole text; null and blank texts score 0."""
    if not text or not text.strip():
        return 0.0, 0.0, False
    peak = total = 0.0
    n = 0
    for toks in lex.sentences(text):
        n += len(toks)
        w, _ = lex.weigh(toks)
        if w > 0:
            total += w
            peak = max(peak, w)
    return round(peak + 100.0 * total / max(n, 20), 6), round(peak, 6), peak >= CASE_AT


def scored(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of the documents with score, peak and abusive, row for row."""
    inner = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("__t"))
    kinds = [f.dataType.simpleString() for f in inner.schema.fields[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                got = [score(t, lex) for t in b.column(len(keep)).to_pylist()]
                cols = [b.column(i) for i in range(len(keep))] + [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, [f"k{i}" for i in range(len(keep))] + ["score", "peak", "abusive"])

    out = inner.mapInArrow(run, ", ".join([f"k{i} {k}" for i, k in enumerate(kinds)] + ["score double", "peak double", "abusive boolean"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "peak", "abusive")


def p10_found(spark, sf_dir):
    """Documents that are a case; of repeated rows of a document one suffices, null ids are left out."""
    return scored(read_table(spark, sf_dir, "documents")).where("abusive and doc_id is not null").select("doc_id").distinct()


def p10_scores(spark, sf_dir):
    """(doc_id, score, abusive): every document's highest score."""
    s = scored(read_table(spark, sf_dir, "documents")).where("doc_id is not null")
    return s.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("abusive").alias("abusive"))


def p10_rates(spark, sf_dir):
    """(source, documents, abusive, rate): distinct documents by source; null sources are a group of their own."""
    s = scored(read_table(spark, sf_dir, "documents"), ("doc_id", "source")).where("doc_id is not null")
    one = s.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("abusive").alias("abusive"))
    return one.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"), F.round(F.avg(F.col("abusive").cast("int")), 4).alias("rate"))
