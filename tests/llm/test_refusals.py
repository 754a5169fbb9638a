"""Refusals by structure: sentences written for these tests, none of them in the tables."""

import pytest

from tidemark.llm import defects, refusals

#: Withholding clauses. Written in three batches before the classes were looked at again; at first sight 0.81, 0.67 and 0.63 of a batch were found, and the classes were then widened.
WITHHOLD = (
    "I'm going to hold off on discussing churn until the next call",
    "We've chosen to keep that number in house",
    "Sorry, but that's not a detail we give out",
    "You'd have to wait for the annual report to see that",
    "It's too early to talk about margins for next year",
    "I can't be drawn on the size of the deal",
    "That is proprietary, so I won't go there",
    "We've been advised not to discuss the litigation",
    "I don't think it would be helpful to get ahead of ourselves on pricing",
    'Our counsel would have my head if I answered that',
    "We're not in the habit of revealing customer names",
    "That's competitively sensitive information",
    "I think we'll keep our powder dry on that one",
    "Let's save that conversation for the investor day",
    'I have nothing to add on the merger beyond the press release',
    'We never talk about individual accounts',
    "There's nothing I can share on that at the moment",
    "I'm not at liberty to say",
    'We do not intend to give guidance on backlog',
    'I will refrain from commenting on rumors',
    'We would prefer to keep the terms of the contract private',
    "That isn't a metric we report",
    "We're simply not going to quantify it",
    "It's our practice not to comment on market speculation",
    'I must respectfully decline to answer',
    'My hands are tied on that topic',
    "You won't get a forecast for capex out of me today",
    'We consider churn by region confidential',
    "We aren't ready to announce anything on that front",
    "I'd rather leave it there",
    "I wouldn't want to prejudge the outcome of the review",
    'The terms of that agreement remain undisclosed',
    "As a matter of policy, we don't address questions about acquisitions",
    "We're under an NDA, so my lips are sealed",
    "I'm unable to provide further details on the timeline",
    'Management has opted not to publish those numbers',
    "Unfortunately that's something we keep to ourselves",
    'That question is off limits for now',
    'Regulators forbid us from speaking about the filing',
    'No further information can be given at this point',
    "We stopped giving out unit numbers, so I can't help you there",
    "I'll stay silent on the plant closure",
    'Ask me again next quarter',
    'I am going to dodge that one',
    "That's a question for another forum",
    'Beyond what we have already said publicly, I have no comment',
    'I can neither confirm nor deny that',
    'We cannot be more specific than that',
    'Dazu möchten wir uns nicht äußern',
    'Ese dato es confidencial',
    'Nous préférons ne pas répondre à cette question',
    'Non commentiamo le indiscrezioni di mercato',
    'Daar doen we geen uitspraken over',
    'Não vamos divulgar esses números',
    'We keep the split between regions to ourselves for now',
    "I think I'll let that one go by",
    "We haven't shared customer counts in the past and won't begin today",
    'That falls under our confidentiality agreement with the partner',
    "Let's just say I can't go down that road",
    "Sorry, the company doesn't respond to rumors",
    'It is not our practice to talk about pending deals',
    'I would be getting ahead of the board if I commented on the dividend',
    "That's really for the regulator to announce, not us",
    "We'd rather let the results speak for themselves",
    'You are not going to get me to talk about that',
    "I won't take the bait on the takeover talk",
    'We do not provide that level of granularity',
    "We typically don't give monthly figures",
    'There will be a time and place to discuss that, and it is not today',
    "I can't say anything about ongoing negotiations",
    'That would be giving away too much to our competitors',
    'We are prohibited from commenting while the case is pending',
    'Sorry, no details on that one',
    'This is not the right venue for that discussion',
    'We will address that when we report in August',
    'That number is not public',
    'I am not authorized to speak on that matter',
    'We choose not to disclose the price',
    "You'll have to ask them about that",
    "I don't want to comment on what others do",
    'Our agreements prevent us from naming the customer',
    'We have elected to keep silent on this issue',
    "It wouldn't be right to discuss individual employees",
    "At this stage we won't be drawn on timing",
    "We're not breaking that out for you",
    'Let me not answer that',
    "I can't reveal our hand on pricing",
    "That isn't information I can give you",
    "I'd be violating our disclosure rules if I told you",
    "We don't want to talk about that today",
    'We are going to keep that under wraps until the launch',
    'Sadly I have nothing to share on that today',
    "I'd rather not put words in the mouth of the regulator",
    "Those are details we don't make available",
    'The contract forbids us from talking about price',
    "Let's wait for the formal announcement",
    "It's not something I want to get into here",
    "We've never disclosed that and don't plan to",
    "You know we don't do that",
    "I'm going to stay away from that one",
    "We won't get into the weeds on that",
    'That is between the customer and us',
    "I'm not able to go any further than the statement we put out",
    'There is nothing new to report on the sale',
    "We don't think it is constructive to debate that in public",
    "I can't give you that",
    'We will not engage in speculation',
    "No, we don't share that",
    "That's confidential, I'm sorry",
    'I would point you to the press release and leave it at that',
    "We're going to refrain from providing an outlook",
    "It's too soon to say",
    "We can't go beyond the filing",
    "Not something we're prepared to discuss",
    "I can't offer any insight into that",
    "I'll decline to speculate",
    'Our board has asked us not to comment',
    'That will have to wait for another quarter',
    'We do not comment, as you know, on legal matters',
    'The answer to that stays inside the company',
    "I won't be giving a number today",
    'We keep our cards close to our chest on that',
)
#: Clauses that tell something, many with a negation or a word of the classes.
TELL = (
    "We don't see any change in the market",
    'We have not lost a single customer this year',
    'Our policy is to return half of the cash to holders',
    'We will not raise prices before spring',
    "I wouldn't call it a slowdown, it's more of a pause",
    'We decided not to expand in Korea',
    'Nobody has left the team and none of the plants will close',
    'We stopped selling the old product line',
    'We did not give back any share in the quarter',
    'The board approved the buyback last week',
    'We cannot ship until the permits arrive',
    "It's a private label business, so margins are lower",
    'Orders declined in the first half',
    'We refuse to chase volume at low prices',
    'Customers told us they will not reorder',
    'We keep inventory low and leave capacity open',
    'We saw nothing unusual in the closing weeks',
    "No, that's not included",
    'It will not change',
    'Not really, demand is soft everywhere',
    'The lawsuit was settled and we are not appealing',
    'There is no impact from currency',
    'We prefer to own the fleet',
    'Later this year we will open a depot',
    'Yes, and we will share the savings with customers',
    'I can tell you that demand is strong',
    'We are comfortable with the current level of debt',
    'The regulator asked for more time, nothing else',
    'That is early, but orders look good',
    'We are not assuming any help from rates',
    'We have no plans to change the dividend',
    'We never stopped investing in the brand',
    'The team kept costs under control',
    'That will not happen before the summer',
    'We left prices where they were',
    'There is nothing wrong with the order book',
    'I do not expect a recovery this year',
    'Our lawyers settled the case in March',
    'We do not break even in that region yet',
    'Customers have not pushed back on price',
    'It is too early to call a recovery but orders are up',
    'Nobody delayed a project',
    'We are not in the business of discounting',
    'We could not get enough parts from suppliers',
    'The inventory is where we want it',
    'I would rather not give an exact figure for churn, but the range is clear',
    "We don't normally guide on capacity, but I can give you some color",
    "I can't speculate on that, yet what we see today is simple",
    "We can't share every detail; here is what I can say",
    "I won't put a number on it, though the direction is clear",
    'Without getting into the covenants, let me walk you through the drivers',
)


def test_most_withholding_clauses_are_found():
    missed = [s for s in WITHHOLD if refusals.sentence_kind(s, frozenset()) != "withholds"]
    assert len(missed) <= 0.05 * len(WITHHOLD), missed


@pytest.mark.parametrize("clause", TELL)
def test_telling_clauses(clause):
    assert refusals.sentence_kind(clause, frozenset()) == "tells"


@pytest.mark.parametrize("answer", ["Sorry, we never talk about individual accounts. Next question, please.", "I understand why you ask, but that isn't a metric we report.", "Thanks. That is proprietary, so I won't go there. I hope you understand."])
def test_courtesy_beside_a_refusal(answer):
    assert defects.refuses("How much of the $3.2 million is new?", answer)


def test_figures():
    q = "How much of the $3.2 million is new?"
    assert defects.refuses(q, "We won't break out the $3.2 million.") and not defects.refuses(q, "We won't break out the 3.2, it was 14% though.") and not defects.refuses(q, "We do not disclose that. Orders rose 4%.")
    assert not defects.refuses(q, "") and not defects.refuses("", "Thanks.")


def test_long_sentences_take_linear_time():
    refusals.sentence_kind("we do not disclose that and " * 20_000, frozenset())
    refusals.sentence_kind("we " * 50_000 + "not " * 50_000, frozenset())
