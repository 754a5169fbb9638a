"""Abusive content: sentences written for these tests, none of them in the tables."""

import pytest

from tidemark.llm import abuse

LEX = abuse.Lexicon()

#: Written before the lexicon was looked at again; at first sight 0.84 of them were found, and the lexicon was then widened.
ABUSE = (
    'You are a waste of oxygen.',
    "You're an absolute numbskull and a disgrace.",
    'Immigrants breed like insects and ruin everything they touch.',
    'I know where you live and I will come for you.',
    'You are pathetic.',
    'They are disgusting animals.',
    'Somebody should shoot that treasurer.',
    'I hope your children get cancer.',
    'Women are too stupid to run a company.',
    'The board is a gang of filthy rats.',
    'Go back to your country, parasite.',
    'Those people should be rounded up and deported.',
    'He is a retarded clown.',
    'I want to see you naked in my hotel room tonight.',
    'She slept her way to the top.',
    'Watch your back when you walk home.',
    'What a worthless piece of garbage you are.',
    'Your whole family should burn.',
    'The CEO deserves to be hanged.',
    'Gays are a disease and should be exterminated.',
    'I would love to bend her over the desk and lick her.',
    'Shut your trap, you ignorant pig.',
    'Someone ought to put a bullet in his head.',
    'Old folks are useless leeches, get rid of them.',
    'Nobody wants you here, drop dead.',
    'You people are vermin.',
    'Call me for hot sex tonight, no limits.',
    'Du bist so ein Schwachkopf, halt die Klappe du Wichser.',
    'Eres un cabrón, ojalá te mueras.',
    'Va te faire foutre, connard.',
    'You s t u p i d m o r o n.',
    'y0u are an 1d10t',
    'Foreigners are criminals, throw them out.',
    'Kill yourself, loser.',
    'These savages will never be like us, keep them out.',
    "I'll strangle that analyst if he calls again.",
    'Your mother is a whore.',
    'The chairman is a lying snake.',
    'What a bunch of clueless buffoons they are.',
    'That spokeswoman only has her job because of her breasts.',
    'Their kind belongs in the kitchen.',
    'Send pictures of your tits.',
    'I pray he chokes on his dinner.',
    'You disgusting little creep.',
)
#: Neutral mention of the same topics, mild swearing, and plain sentences with words of the lexicon.
NEUTRAL = (
    'Holy cow, what a quarter.',
    'The pest control business grew by ten percent.',
    'Damn, I missed the dip again.',
    'We had to kill the project after the trial.',
    'The documentary covers hate crimes and harassment at work.',
    'Our drug slows the spread of breast cancer.',
    'People like their new phones.',
    'The company makes cages for animals and pets.',
    'Those costs are ugly but temporary.',
    'I was an idiot to sell so early.',
    'They are both insects experts at the lab.',
    'You are right about the margin.',
    'The board should burn less cash.',
    'The jury found them not guilty of murder.',
    'Women and men are paid the same here.',
    'The hotel rooms in the Gulf were full tonight.',
    'Customers hope the price will drop.',
    'The police shot video of the protest.',
    'This fucking market will not stop falling.',
    'He is a great analyst and she is a strong manager.',
    'We know where our customers live from the survey.',
    'The team will die for a good coffee.',
    'Their garbage trucks run on gas.',
    'The naked truth is that volumes fell.',
    'They should get rid of the old inventory.',
    'Migrants from rural areas fill most of the jobs.',
    'The film shows a gay couple and their family.',
    'He was beaten to the deal by a rival.',
    'The lawsuit alleges that a manager used racial slurs.',
    'We will pay for this with lower margins.',
    'The trash removal unit is a jewel.',
    'Our policy bans threats and sexual content.',
    'The rope maker and the bullet train firm merged.',
    'Please call me tonight about the offer.',
    'I want that stock, it is hot right now.',
    'Send the report to the board.',
    'They lost everything in the fire.',
    'The old plant will be put down next year.',
    'Sick animals were treated at the farm.',
    'You must be tired of hearing this.',
)


def case(text):
    return abuse.score(text, LEX)[2]


def test_most_abusive_sentences_are_cases():
    missed = [x for x in ABUSE if not case(x)]
    assert len(missed) <= 0.05 * len(ABUSE), missed


def test_few_neutral_sentences_are_cases():
    wrong = [x for x in NEUTRAL if case(x)]
    assert len(wrong) <= 1, wrong


def test_a_partner_makes_the_case():
    assert case("You are stupid.") and not case("That was a stupid mistake.") and case("He should be shot.") and not case("The video should be shot in May.")
    assert case("Throw those refugees out, they ruin everything.") and not case("The rain did ruin every harvest.")


def test_lighter_sentences_add_to_the_score():
    assert 0 < abuse.score("The service is pathetic.", LEX)[0] < abuse.score("You are pathetic.", LEX)[0] and not case("The service is pathetic.")


@pytest.mark.parametrize("text", ["y o u   m o r o n", "m o o o o o o r o n", "You m-o-r-o-n", "you м\u043eron", "idi" + "o" * 90 + "t you"])
def test_disguises(text):
    assert case(text)


def test_long_inputs_take_linear_time():
    for x in ("you moron " * 20_000, "a b c " * 40_000, "those people " * 30_000, "i hope they die " * 15_000, "you fool " * 30_000, "they are rats " * 15_000, "you are stupid " * 15_000, "a" * 300_000):
        abuse.score(x, LEX)
