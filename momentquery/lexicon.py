"""Words and phrases that the signals look for. Callers may pass a lexicon of their own."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on these lists being exactly so.
BUCKETS: dict[str, tuple[str, ...]] = {
    "controversy": ("ban", "banned", "illegal", "scam", "lawsuit", "sued", "fight", "versus", "controversial"),
    "taboo": ("taboo", "secret", "hidden", "forbidden", "classified", "confidential"),
    "absurdity": ("crazy", "wild", "insane", "absurd", "ridiculous", "unreal", "bonkers"),
    "action": ("exploded", "smashed", "crashed", "jumped", "snapped", "ran", "rushed", "flipped"),
    "confrontation": ("angry", "furious", "screamed", "yelled", "argued", "interrupted", "snapped", "hate"),
    "useful_claim": ("learn", "lesson", "tip", "trick", "truth", "rule", "insight", "framework", "pattern"),
}
PAYOFF_WORDS = ("payoff", "reveal", "outcome", "result", "aftermath", "turns", "finally", "boom")
PAYOFF_PHRASES = ("turns out", "the result was", "so it turns out", "and that's when", "what actually happened", "here's the kicker")
INTERJECTIONS = ("wait", "whoa", "woah", "listen", "honestly", "seriously", "actually", "literally")
HOOK_PHRASES = ("here's the thing", "let me tell you", "you won't believe", "the crazy part is", "nobody talks about", "this is wild")
HOOK_WORDS = ("wait", "listen", "okay", "right", "so", "imagine", "picture")
INTERVIEW_PHRASES = (
    "the play here", "what's your take", "what is your take", "the most important thing", "if you want to follow",
    "hands down", "one of the best", "the way i think about", "the way i look at", "my biggest position",
    "biggest position", "the trade i like", "the trade i want", "i'm long", "i am long", "i'm short", "i am short",
    "i'm a holder", "im a holder", "huge holder", "massive holder", "best investor", "smartest guy",
    "smartest people", "the secret sauce", "playbook", "the call here", "high conviction",
)
INTERVIEW_WORDS = (
    "long", "short", "position", "holder", "ticker", "playbook", "conviction", "endorse", "endorsed", "endorsement",
    "alpha", "moat", "thesis", "compounding", "compounder", "fundamentals", "valuation", "multiple",
)
BURIED_LEADS = (
    "only makes sense if", "if you watched", "if you saw", "as i said earlier", "in the last part",
    "like i mentioned", "earlier we covered",
)
ANSWER_WORDS = ("because", "so", "answer", "explanation", "reason")
CAPTION_STOPWORDS = ("about", "actually", "because", "before", "between", "really", "should", "something", "through", "together")


@dataclass(frozen=True)
class Lexicon:
    buckets: tuple[tuple[str, ...], ...] = tuple(BUCKETS.values())
    payoff_words: tuple[str, ...] = PAYOFF_WORDS
    payoff_phrases: tuple[str, ...] = PAYOFF_PHRASES
    interjections: tuple[str, ...] = INTERJECTIONS
    hook_phrases: tuple[str, ...] = HOOK_PHRASES
    hook_words: tuple[str, ...] = HOOK_WORDS
    interview_phrases: tuple[str, ...] = INTERVIEW_PHRASES
    interview_words: tuple[str, ...] = INTERVIEW_WORDS
    buried_leads: tuple[str, ...] = BURIED_LEADS
    answer_words: tuple[str, ...] = ANSWER_WORDS
