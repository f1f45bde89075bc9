"""Text to tokens, sentences, grams and chunks, as Column expressions. A null text counts as an empty one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import lexicon

#: White space as the published behaviour knows it (Unicode), as a Java character class.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often `use` names it, also inside lambdas: those would otherwise compute
    an inlined expression for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def rounded(c: Column, digits: int) -> Column:
    """Half up, by the one formula that every engine computes alike."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def percent(c: Column) -> Column:
    return F.floor(c * 100 + F.lit(0.5)).cast("long")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def _words(c: Column, keep: str, least: int) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text_of(c)), f"[^{keep}\\s]", " "), r"\s+"), lambda t: F.length(t) >= least)


def tokens_all(c: Column | str) -> Column:
    """All runs of a-z and 0-9 of the lower-cased text."""
    return _words(text_of(c), "a-z0-9", 1)


def tokens_content(c: Column | str) -> Column:
    """tokens_all of more than two letters that are no stop words."""
    return F.filter(_words(text_of(c), "a-z0-9", 3), lambda t: ~t.isin(sorted(lexicon.STOP_WORDS)))


def tokens_style(c: Column | str) -> Column:
    """As tokens_all, but apostrophes stay."""
    return _words(text_of(c), "a-z0-9'", 1)


def tokens_letters(c: Column | str) -> Column:
    """Runs of a-z of more than two letters."""
    return _words(text_of(c), "a-z", 3)


#: Maps that the synonym table is dealt to.
CANONICAL_MAPS = 128


def canonical(t: Column, groups=lexicon.SYNONYMS) -> Column:
    """The canonical word of a token, or the token."""
    # a map is searched entry by entry: the words are dealt to small maps by their first character and length
    parts: list[list[Column]] = [[] for _ in range(CANONICAL_MAPS)]
    for word, name in sorted(lexicon.canonical_words(groups).items()):
        if " " not in word:
            parts[(7 * ord(word[:1] or "\0") + len(word)) % CANONICAL_MAPS] += [F.lit(word), F.lit(name)]
    maps = F.array(*[F.create_map(*p) if p else F.lit(None).cast("map<string,string>") for p in parts])
    return F.coalesce(F.element_at(F.get(maps, F.pmod(7 * F.ascii(t) + F.length(t), F.lit(CANONICAL_MAPS))), t), t)


def tokens_canonical(c: Column | str, groups=lexicon.SYNONYMS) -> Column:
    return F.transform(tokens_letters(c), lambda t: canonical(t, groups))


def sentences_lexical(c: Column | str) -> Column:
    """Stretches up to end marks; a line without a mark is dropped unless it is the last. Of more than 15 characters and at
    least 4 words."""
    pieces = F.regexp_extract_all(text_of(c), F.lit(r"[^.!?\n]+(?:[.!?]+|\z)"), F.lit(0))
    return F.filter(F.transform(pieces, trimmed), lambda s: (F.length(s) > 15) & (F.size(F.split(s, f"{SPACE}+")) >= 4))


def sentences_style(c: Column | str) -> Column:
    """Pieces between an end mark and white space, of at least 3 words."""
    return F.filter(F.split(trimmed(text_of(c)), rf"(?<=[.!?]){SPACE}+"), lambda s: F.size(F.split(s, f"{SPACE}+")) >= 3)


def is_boilerplate(s: Column) -> Column:
    low = F.lower(s)
    out = F.lit(False)
    for phrase in lexicon.BOILERPLATE:
        out = out | F.contains(low, F.lit(phrase))
    return out


def _places(last: Column, step: int = 1) -> Column:
    """1, 1 + step, ... up to `last`; none if last is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def word_grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks."""
    return let(tokens, lambda t: F.transform(_places(F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")))


def fingerprint_text(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]", "")


def spaced_text(c: Column | str) -> Column:
    """White space runs as one blank, other symbols removed, not trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), f"{SPACE}+", " "), "[^a-z0-9 ]", "")


def char_grams(s: Column, n: int) -> Column:
    """All strings of n characters, from an array of characters: substring() would walk from the start for each of them."""
    characters = F.filter(F.split(s, ""), lambda c: F.length(c) > 0)
    return let(characters, lambda t: F.transform(_places(F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), "")))


def chunks(sentences: Column, size: int = 4, stride: int = 2) -> Column:
    """Runs of `size` sentences every `stride`, joined by blanks; no later chunk of fewer than two sentences."""
    return let(sentences, lambda s: F.transform(F.filter(_places(F.size(s), stride), lambda i: (i == 1) | (F.size(s) - i >= 1)), lambda i: F.array_join(F.slice(s, i, size), " ")))


def lexical_chunks(c: Column | str, size: int = 4, stride: int = 2) -> Column:
    """Chunks of the sentences that are no boilerplate; the whole text if there are none."""
    kept = F.filter(sentences_lexical(c), lambda s: ~is_boilerplate(s))
    return let(kept, lambda k: F.when(F.size(k) == 0, F.array(text_of(c))).otherwise(chunks(k, size, stride)))


def style_chunks(sentences: Column, size: int = 4, stride: int = 2) -> Column:
    """As chunks, but a chunk of one sentence ends the list even at its beginning."""
    return let(sentences, lambda s: F.transform(_places(F.size(s) - 1, stride), lambda i: F.array_join(F.slice(s, i, size), " ")))


def counts(tokens: Column) -> Column:
    """How often each distinct token occurs, by sorting: no exchange and no map."""

    def of(ordered: Column) -> Column:
        heads = F.filter(_places(F.size(ordered)), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        return let(heads, lambda h: F.transform(h, lambda x, k: F.coalesce(F.get(h, k + 1), F.size(ordered) + 1) - x))

    return let(F.array_sort(tokens), of)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return let(b, lambda y: F.when(y == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(y == 0, F.lit(1)).otherwise(y)))
