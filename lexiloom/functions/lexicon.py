"""Literal lists that define results. All are fixed values: they must equal the published behaviour's for equal results."""

from __future__ import annotations

import pkgutil

# Stop words of more than two letters.
STOP_WORDS = frozenset(
    """
    about above after all also and any are been before being below between both but call came can
    come could did does during each every few find for from get give got had has have her
    here him his how into its just know let look made make may might more most must nor
    not now only other our own put said same saw say see shall she should some such take
    tell than that the their them then there these they think this those through too use very was
    went were what when where which who why will with work would you your
    """.split()
)

# Phrases of front matter and notices; a sentence that contains one is boilerplate.
BOILERPLATE = (
    "abstract",
    "accepted:",
    "acknowledgements",
    "all authors read and approved",
    "all rights reserved",
    "as shown in figure",
    "as shown in table",
    "copyright notice",
    "corresponding author",
    "creative commons attribution",
    "department of",
    "figure shows",
    "funding:",
    "in partial fulfillment",
    "index terms",
    "keywords",
    "permission to make digital",
    "proceedings of the",
    "published by",
    "received:",
    "revised:",
    "submitted to",
    "table shows",
    "the authors declare no conflict",
    "thesis submitted",
    "this work is licensed under",
)

# Transition terms, each counted by itself.
TRANSITIONS = (
    "accordingly",
    "accurately",
    "additionally",
    "as a result",
    "commendable",
    "commonly",
    "comprehensively",
    "consequently",
    "cutting-edge",
    "delve",
    "effectively",
    "efficiently",
    "encompass",
    "essentially",
    "extensively",
    "facilitate",
    "frequently",
    "furthermore",
    "game-changing",
    "generally",
    "harness",
    "hence",
    "however",
    "implement",
    "importantly",
    "in conclusion",
    "in order to",
    "in summary",
    "in terms of",
    "in this context",
    "invaluable",
    "it is essential",
    "it is important to",
    "it is worth mentioning",
    "it should be noted",
    "leverage",
    "moreover",
    "multifaceted",
    "nevertheless",
    "nonetheless",
    "notable",
    "notably",
    "nuanced",
    "occasionally",
    "on the other hand",
    "one of the key",
    "overall",
    "paradigm",
    "particularly",
    "play a crucial role",
    "plays an important role",
    "precisely",
    "primarily",
    "robust",
    "seamless",
    "significantly",
    "specifically",
    "straightforward",
    "subsequently",
    "systematically",
    "therefore",
    "this allows",
    "this enables",
    "this ensures",
    "this helps",
    "this provides",
    "thoroughly",
    "thus",
    "to summarize",
    "typically",
    "ultimately",
    "utilize",
    "with respect to",
)

# Marker phrases, in the order in which they are reported.
MARKERS = (
    "as an ai",
    "i cannot",
    "i am unable",
    "i do not have",
    "as a language model",
    "in the realm of",
    "it is worth noting",
    "it is important to note",
    "in today's world",
    "in today's society",
    "in the modern era",
    "plays a crucial role",
    "plays an important role",
    "in recent years",
    "it goes without saying",
    "needless to say",
    "without a doubt",
    "in conclusion",
    "to summarize",
    "all in all",
    "in a nutshell",
    "first and foremost",
    "last but not least",
    "on a final note",
    "delve into",
    "tapestry of",
    "testament to",
    "multifaceted",
    "nuanced",
    "foster a",
    "fostering a",
    "in summary",
    "ultimately",
    "in essence",
    "moreover",
    "furthermore",
    "notably",
    "it is crucial to",
    "undeniably",
    "a stark reminder",
    "sheds light on",
    "intricate web",
    "navigate the",
)

# Phrase signatures of text generators (name, phrases, transitions), in the order that decides ties.
SIGNATURES = (
    (
        "ChatGPT (OpenAI)",
        (
            "absolutely",
            "as mentioned earlier",
            "certainly",
            "feel free to ask",
            "great question",
            "happy to help",
            "here's a breakdown",
            "hope this helps",
            "i understand",
            "i'd be happy to",
            "in simpler terms",
            "it's worth noting",
            "keep in mind",
            "let me explain",
            "let's dive in",
            "makes sense",
            "of course",
            "sure thing",
            "think of it this way",
            "to be honest",
        ),
        ("firstly", "in short", "lastly", "secondly", "thirdly"),
    ),
    (
        "Claude (Anthropic)",
        (
            "at its core",
            "crucially",
            "fundamentally",
            "i should mention",
            "i want to be transparent",
            "i'd like to note",
            "importantly",
            "in practice",
            "in this context",
            "it bears mentioning",
            "it's helpful to consider",
            "it's worth considering",
            "it's worth emphasizing",
            "let me be clear",
            "that said",
            "the crux of",
            "the key insight",
            "to be clear",
            "to put it simply",
            "with that said",
            "worth highlighting",
        ),
        ("additionally", "furthermore", "moreover", "that said"),
    ),
    (
        "Gemini (Google)",
        (
            "a key takeaway",
            "across the board",
            "building on this",
            "exploring this further",
            "from a broader perspective",
            "from multiple angles",
            "here's a comprehensive",
            "i can help with that",
            "in essence",
            "it's fascinating",
            "let me provide",
            "looking at this holistically",
            "on a related note",
            "taking into account",
            "this highlights the importance",
            "this is a great topic",
            "to add to this",
            "to summarize the key points",
        ),
        ("essentially", "interestingly", "notably", "specifically"),
    ),
    (
        "Perplexity AI",
        (
            "according to",
            "as reported by",
            "available data",
            "based on available information",
            "current evidence",
            "data indicates",
            "evidence shows",
            "experts suggest",
            "findings indicate",
            "it has been found that",
            "recent research",
            "research suggests",
            "sources suggest",
            "studies indicate",
        ),
        ("according to", "as evidenced by", "based on"),
    ),
    (
        "xAI Grok",
        (
            "bottom line",
            "cut to the chase",
            "frankly",
            "in no uncertain terms",
            "let's be real",
            "let's face it",
            "no sugarcoating",
            "plain and simple",
            "plot twist",
            "spoiler",
            "straight up",
            "the hard truth",
            "the reality is",
            "to be blunt",
            "to put it bluntly",
        ),
        ("but", "however", "regardless", "still", "yet"),
    ),
)

# The default synonym groups (canonical word, synonyms), in the order that decides which group a word belongs to: all 50 of the
# published table, one "canonical: synonym | ..." a line of synonyms.txt. Operators take others by groups=.
SYNONYMS = tuple(tuple(line.split(": ", 1)) for line in (pkgutil.get_data(__package__, "synonyms.txt") or b"").decode().splitlines())


def synonym_groups(groups: tuple[tuple[str, str], ...] = SYNONYMS) -> dict[str, tuple[str, ...]]:
    """Canonical word -> its synonyms; a later group of the same name replaces the earlier one but keeps its place."""
    return {k: tuple(v.split(" | ")) for k, v in groups}


def canonical_words(groups: tuple[tuple[str, str], ...] = SYNONYMS) -> dict[str, str]:
    """Word -> canonical word: of several groups the last one decides, and a group's own name counts as its last entry."""
    out: dict[str, str] = {}
    for name, words in synonym_groups(groups).items():
        for word in words:
            out[word] = name
        out[name] = name
    return out
