"""What kind of text the lines of a document are, by their form: the weak labels of problems 2 and 9.

These rules label the bounded samples that the models of quality.py and spam.py are trained on, and nothing else: the models see
the statistics of textstats.py only.
"""

from __future__ import annotations


import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from math import log2, log10

import numpy as np
import regex

from lexiloom.llm.codes import code_points

#: Order of the statistics in a vector.
NAMES = (
    "log_chars", "words", "mean_word", "symbols", "digits", "upper", "ended", "common", "type_ratio", "entropy", "top_pair", "mean_line", "item_words",
    "link", "markup", "data", "damaged", "leader", "product", "table", "tags", "list", "keywords", "salad", "heading", "prose", "repeated_items", "longest_token", "spaces",
)
AT = {n: i for i, n in enumerate(NAMES)}

_URL = regex.compile(r"(?:https?://|www\.)\S+|\b[\p{L}\d-]+(?:\.[\p{L}\d-]+)*\.\p{L}{2,}/\S+|\b[\w.-]+@[\w-]+\.\w{2,}")
_HOST = regex.compile(r"\.\p{L}{2,}/")
_MARKDOWN_LINK = regex.compile(r"\[[^\]\n]*\]\([^)\s]+\)")
_CELL_TAG = regex.compile(r"</?t[rdh]\b", regex.I)
_TAG = regex.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:\w+|#\d+);")
_DATA = regex.compile(r"""^[\[{].*[:,].*[\]}],?$|^\s*["']?[\w-]+["']?\s*:\s*[\[{"'\d].*[,}\]]$""")
_LONG = regex.compile(r"[A-Za-z\d+/=_-]{28,}")
_LEADER = regex.compile(r"(?:\.{4,}|…{2,}|(?:\. ){4,}|_{4,})\s*\d+\s*$")
_BULLET = regex.compile(r"^(?:[-*•·▪◦‣+–]|\d{1,3}[.)]|\(?\p{L}[.)]|\([ivx\d]+\)|\[\d+\])\s+\S")
_CODE = regex.compile(r"\b[A-Z]{2,6}-?\d{3,}\b")
_SEPARATOR = regex.compile(r"\t|\||;|\",\"|·|,|/|>|•|#")
_NUMERIC = regex.compile(r"^[\s\"']*(?:[-+]?[\d.,]+\s?%?|n/a|-|—)?[\s\"']*$", regex.I)
_MARKS, _CLOSERS = frozenset(".!?。！？।؟…:"), "\"”»“)]'’」』） \xa0"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*")
_PLAIN_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_ITEM = regex.compile(r" [-–—] |[\n\r,;|·/•>#.!?:。！？।؟；،؛，、\t]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_THAI = regex.compile(r"\p{Thai}")
_MOJIBAKE = regex.compile(r"[ÃÂÐÑ][\x80-\xbf]|â€|à[¤¥¸¹]")
_NOISE = regex.compile(r"(?<=\p{L})[`°~^|�¤§\\<>=_*]+(?=\p{L})|[`°~^|�]")
_REFERENCE = regex.compile(r"^\[\d{1,4}\]\s")
_GAP = regex.compile(r"[ \xa0]{3,}")
_LABEL = regex.compile(r"^\p{L}[\p{L} ]{2,20}\s*[:>/|»-]{1,2}\s")

#: Items of up to so many words (or the letters of so many words) are phrases rather than sentences.
PHRASE_WORDS = 5
#: An item, or the beginning of an item, repeated so often is a keyword.
REPEATS = 3
#: An item that the same item follows in so many of its occurrences belongs to a passage said again and again. Passages of
#: this many words are repetitive prose, not keywords.
FOLLOWED, PASSAGE_WORDS = 0.7, 5
#: So many short lines in a row are one tag each.
TAG_RUN = 6


class Lexicon:
    """Frequent words by language. Words of scripts without spaces are found as strings."""

    def __init__(self, words: list[tuple[str, str]]):
        self.spaced: dict[str, frozenset[str]] = {}
        self.unspaced: dict[str, regex.Pattern] = {}
        by: dict[str, set[str]] = {}
        for lang, word in words:
            if lang and word:
                by.setdefault(lang, set()).add(word.lower())
        for lang, own in by.items():
            if all(_UNSPACED.match(w) for w in own):
                self.unspaced[lang] = regex.compile("|".join(map(regex.escape, sorted(own, key=lambda w: (-len(w), w)))))
            else:
                self.spaced[lang] = frozenset(own)

        self.langs: dict[str, tuple[str, ...]] = {}
        for lang, own in sorted(self.spaced.items()):
            for w in own:
                self.langs[w] = (*self.langs.get(w, ()), lang)
        self.known = frozenset(self.langs)

    def best(self, lower: str, words: Counter, total: int, letters: int) -> tuple[str, float]:
        """The language with the largest share of frequent words, and that share; `letters` of scripts without spaces."""
        share = dict.fromkeys(self.spaced, 0.0)
        for w in self.known & words.keys():
            for lang in self.langs[w]:
                share[lang] += words[w] / total
        if letters and letters > 0.3 * max(1, sum([len(w) * n for w, n in words.items()])):
            share |= {lang: 2 * sum(len(m) for m in p.findall(lower)) / letters for lang, p in self.unspaced.items()}
        lang = max(sorted(share), key=lambda k: share[k]) if share else ""
        return (lang, share[lang]) if share.get(lang) else ("", 0.0)

    def share(self, lang: str, text: str) -> float:
        """The share of frequent words of `lang` in a piece of text."""
        if lang in self.unspaced:
            letters = len(_UNSPACED.findall(text))
            return 2 * sum(len(m) for m in self.unspaced[lang].findall(text)) / letters if letters else 0.0
        words = [w.lower() for w in _WORD.findall(text)]
        own = self.spaced.get(lang, frozenset())
        return sum(w in own for w in words) / len(words) if words else 0.0


#: Bits of the kinds of a code point.
_LETTER, _DIGIT, _UPPER, _BLANK, _BROKEN, _OTHER, _JOINED, _WIDE = 1, 2, 4, 8, 16, 32, 64, 128


@lru_cache(maxsize=1)
def _bits() -> np.ndarray:
    kinds = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    blank = np.zeros(0x110000, dtype=bool)
    blank[[c for c in range(0x3001) if chr(c).isspace()]] = True
    major = kinds.astype("U1")
    table = np.zeros(0x110000, dtype=np.uint8)
    table[np.isin(major, ["L", "M"])] |= _LETTER
    table[major == "M"] |= _JOINED
    table[[m.start() for m in _UNSPACED.finditer("".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000)))]] |= _WIDE
    table[major == "N"] |= _DIGIT
    table[kinds == "Lu"] |= _UPPER
    table[blank] |= _BLANK
    table[np.isin(major, ["P", "S", "C"]) & ~blank] |= _OTHER
    for ranges in ((0x80, 0xA0), (0x00, 0x09), (0x0E, 0x20), (0xE000, 0xF900), (0xFFFD, 0xFFFE)):
        table[slice(*ranges)] |= _BROKEN
    return table


@lru_cache(maxsize=8)
def _with(bit: int) -> np.ndarray:
    """The values of a code point's bits that have one of them."""
    return np.flatnonzero(np.arange(256) & bit)


def _ends(line: str) -> bool:
    """Whether a line ends with a mark, before any closing signs."""
    return line.rstrip(_CLOSERS)[-1:] in _MARKS if line else False


def _spaced_words(text: str) -> int:
    """word_count of a text without letters of scripts without spaces."""
    return text.count(" ") + 1


def word_count(text: str) -> float:
    """Words, counting 1.7 letters of Chinese or Japanese and 4.5 of Thai as one."""
    if text.isascii() or not (unspaced := _UNSPACED.findall(text)):
        return text.count(" ") + 1
    thai = sum(map(bool, map(_THAI.match, unspaced)))
    return thai / 4.5 + (len(unspaced) - thai) / 1.7 + len([w for w in _WORD.findall(text) if not _UNSPACED.search(w)])


def _kinds(lines: list[str], letters: list[int], broken: list[int], words_of=word_count) -> list[str]:
    """The kind of each line by its own form and its neighbours'."""
    n = len(lines)
    separators = []
    for line in lines:
        best = (0, "")
        for mark in ("|", "\t", ";", '","'):
            if mark in line:
                best = max(best, (line.count(mark), mark))
        if not best[0] and "   " in line:
            best = (len(_GAP.findall(line)), "   ")
        separators.append(best)
    kinds = [""] * n
    for i, line in enumerate(lines):
        size = len(line)
        urls = sum(map(len, _URL.findall(line))) if "://" in line or "www." in line or "@" in line or "/" in line and _HOST.search(line) else 0
        if (urls and urls >= 0.25 * size) or ("](" in line and sum(map(len, _MARKDOWN_LINK.findall(line))) >= 0.5 * size):
            kinds[i] = "link"
            continue
        if "<" in line or "&" in line:
            marked = sum(map(len, _TAG.findall(line)))
            if marked >= 0.3 * size:
                kinds[i] = "table" if _CELL_TAG.search(line) else "markup"
                continue
        strange = broken[i] + (len(_MOJIBAKE.findall(line)) if "Ð" in line or "Ã" in line or "à" in line or "Â" in line or "â€" in line else 0)
        if strange < 0.05 * size and ("`" in line or "°" in line or "~" in line or "^" in line):
            strange += len(_NOISE.findall(line))
        if strange >= max(2, 0.05 * size):
            kinds[i] = "damaged"
            continue
        long = sum(map(len, _LONG.findall(line))) if size >= 28 and 10 * line.count(" ") < size else 0
        brackets = "{" in line or "[" in line or '"' in line
        if long >= 0.5 * size or brackets and _DATA.match(line) or size - letters[i] > 0.5 * size and not line[:1].isdigit() and not separators[i][0] and not _LEADER.search(line):
            kinds[i] = "data"
        elif line[-1].isdigit() and _LEADER.search(line):
            kinds[i] = "leader"
        elif separators[i][0] >= 2 and _CODE.search(line):
            kinds[i] = "product"
        elif not letters[i] and set(line) <= set("|-+=: _*"):
            kinds[i] = "table"
        elif line[0].isalpha() and line[1:2] not in (".", ")"):
            continue  # no beginning of a list entry
        elif _REFERENCE.match(line) and words_of(line) <= 40:
            kinds[i] = "list"
        elif _BULLET.match(line) and (w := words_of(line)) <= (10 if _THAI.search(line) else 12) and not (w > 8 and _ends(line)):
            kinds[i] = "list"
    for i, line in enumerate(lines):
        k, s = separators[i]
        if kinds[i] or k < 1:
            continue
        near = [j for j in (i - 1, i + 1) if 0 <= j < n and separators[j][1] == s and abs(separators[j][0] - k) <= 1 and kinds[j] != "product"]
        cells = [c for j in (i, *near) for c in (_GAP.split(lines[j]) if s == "   " else lines[j].split(s))]
        numeric = sum(bool(_NUMERIC.match(c)) for c in cells) / len(cells)
        short = sum([words_of(c) <= 6 for c in cells]) / len(cells)
        if near and short > 0.8 and (numeric >= 0.2 or s in ("\t", '","', "   ")) or k >= 2 and numeric >= 0.5:
            kinds[i] = "table"
    # headers of tables
    for i in range(n):
        if not kinds[i] and separators[i][0] >= 1 and any(0 <= j < n and kinds[j] == "table" and separators[j][1] == separators[i][1] for j in (i + 1, i + 2)) and not _ends(lines[i]):
            kinds[i] = "table"
    return kinds


def _items(text: str) -> list[str]:
    return [x for x in (p.strip() for p in _ITEM.split(text)) if x]


def _passages(items: list[tuple[str, float]], count: Counter) -> bool:
    """Whether the repeated items come again and again in one order that makes passages rather than single phrases."""
    after: dict[str, Counter] = {}
    names = [x.lower() for x, _ in items]
    size = {n: w for n, (_, w) in zip(names, items)}
    for a, b in zip(names, names[1:]):
        if count[a] >= REPEATS:
            after.setdefault(a, Counter())[b] += 1
    total = sum(sum(c.values()) for c in after.values())
    if not total or sum(max(c.values()) for c in after.values()) < FOLLOWED * total:
        return False
    # the longest round that the usual successors make
    start = max(after, key=lambda a: (count[a] * size[a], a))
    words, at, seen = 0.0, start, set()
    while at in after and at not in seen and words < 50:
        seen.add(at)
        words += size[at]
        at = max(after[at].items(), key=lambda kv: (kv[1], kv[0]))[0]
    return words >= PASSAGE_WORDS


def _head(item: str) -> str:
    return " ".join(item.lower().split(None, 2)[:2])


def _repeats_words(line: str) -> bool:
    """Whether a line without marks consists of a few phrases in ever other order."""
    words = line.lower().split()
    pairs = Counter(zip(words, words[1:]))
    if sum(n for n in pairs.values() if n >= REPEATS) < 0.5 * len(words):
        return False
    return not _passages([(w, word_count(w)) for w in words], Counter(words))


def statistics(text: str | None, lexicon: Lexicon) -> tuple[np.ndarray, str]:
    """The vector of NAMES and the best language of a text; zeros for null or blank texts."""
    out = np.zeros(len(NAMES))
    lines = [x for x in map(str.strip, (text or "").splitlines()) if x]
    if not lines:
        return out, ""
    total = sum(map(len, lines))
    whole = "\n".join(lines)
    lower = whole.lower()
    bits = _bits()[code_points(whole)]
    # the plain pattern is faster; it would cut words at combining marks
    kinds_of_bits = np.bincount(bits, minlength=256)
    share = lambda b: float(kinds_of_bits[_with(b)].sum()) / total
    tokens = (_WORD if share(_JOINED) else _PLAIN_WORD).findall(lower)
    words = Counter(tokens)
    wide = int(kinds_of_bits[_with(_WIDE)].sum())
    lang, best = lexicon.best(lower, words, len(tokens), wide)
    begins = np.array(list(accumulate([0, *[len(x) + 1 for x in lines[:-1]]])))
    letters = np.add.reduceat((bits & (_LETTER | _BLANK) > 0).astype(np.int64), begins).tolist()
    broken = np.add.reduceat((bits & _BROKEN > 0).astype(np.int64), begins).tolist() if share(_BROKEN) else [0] * len(lines)
    words_of = word_count if wide else _spaced_words
    kinds = _kinds(lines, letters, broken, words_of)
    size: Counter = Counter()
    ended = 0
    plain: list[tuple[int, str]] = []
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if _ends(line):
            ended += len(line)
        if kind:
            size[kind] += len(line)
        else:
            plain.append((i, line))
    # items of the lines without a form of their own
    own_items = [[(x, words_of(x)) for x in _items(line)] for _, line in plain]
    items = [x for own in own_items for x in own]
    lows = [x.lower() for x, _ in items]
    count = Counter(lows)
    heads = Counter([" ".join(x.split(None, 2)[:2]) for x in lows if " " in x]) if len(items) > REPEATS else Counter()
    repeating = any([n >= REPEATS for n in count.values()])
    passages = repeating and _passages(items, count)
    # one beginning with ever other endings (a place or product name)
    most = max(heads.values(), default=0)
    variants = len(items) >= 8 and most >= 0.5 * len(items) and len(count) >= 0.7 * len(items)
    limit, usual = (PHRASE_WORDS + 4, PHRASE_WORDS + 3) if variants else (PHRASE_WORDS + 1, PHRASE_WORDS)
    repeated = sum([len(x) + 1 for (x, w), low in zip(items, lows) if w <= PHRASE_WORDS + 1 and count[low] >= REPEATS]) if repeating and not passages else 0
    run, before, held = 0, -2, []
    for (i, line), own in zip(plain, own_items):
        w = words_of(line)
        sizes = [s for _, s in own]
        mean = sum(sizes) / len(sizes) if sizes else 0.0
        kind = ""
        if sizes and mean <= usual and not passages and (most > REPEATS or repeating):
            again = sum([len(x) + 1 for x, s in own if s <= limit and (count[x.lower()] >= REPEATS or heads[_head(x)] >= REPEATS + 1)])
            kind = "keywords" if again >= 0.6 * len(line) else ""
        if not kind and sizes and w >= 20 and max(sizes) >= 0.8 * w and _repeats_words(line):
            kind = "keywords"
        if not kind and mean <= 3.5 and len(sizes) >= 4:
            phrases = sum([len(x) + 1 for x, s in own if s <= PHRASE_WORDS + 1])
            labelled = _LABEL.match(line)
            kind = "tags" if labelled or len(sizes) >= 5 and phrases >= 0.8 * len(line) and not _ends(line) else ""
        if kind:
            pass
        elif w <= 6 and not _ends(line) and len(line) < 60:
            kind = "heading"
        elif w >= 6 and best < 0.08 and not _ends(line) and lexicon.share(lang, line) < 0.04:
            kind = "salad"
        else:
            kind = "prose"
        size[kind] += len(line)
        # a run of short lines without a mark: a tag each
        if kind in ("heading", "keywords") and w <= 5 and not _ends(line):
            if i != before + 1:
                run, held = 0, []
            run += 1
            held.append((kind, len(line)))
            before = i
            if run >= TAG_RUN:
                for k, n in held if run == TAG_RUN else held[-1:]:
                    if k == "heading":
                        size[k] -= n
                        size["tags"] += n
    pairs = Counter(zip(tokens, tokens[1:]))
    n_tokens = max(1, len(tokens))
    entropy = log2(n_tokens) - sum([n * log2(n) for n in words.values() if n > 1]) / n_tokens
    weight = sum([len(x) for x, _ in items])
    values = {
        "log_chars": log10(total), "words": words_of(whole), "mean_word": sum(map(len, tokens)) / max(1, len(tokens)),
        "symbols": share(_OTHER), "digits": share(_DIGIT), "upper": share(_UPPER) / max(1e-9, share(_LETTER)),
        "ended": ended / total, "common": best, "type_ratio": len(words) / max(1, len(tokens)),
        "entropy": entropy / log2(len(words)) if len(words) > 1 else 0.0, "top_pair": sum(sorted(pairs.values())[-3:]) / max(1, len(tokens)),
        "mean_line": log10(total / len(lines)), "item_words": sum([w * len(x) for x, w in items]) / weight if items else 0.0,
        "repeated_items": repeated / total, "longest_token": log10(max(map(len, whole.split()), default=1)), "spaces": whole.count(" ") / total,
    }
    for name, v in values.items():
        out[AT[name]] = v
    for name in ("link", "markup", "data", "damaged", "leader", "product", "table", "tags", "list", "keywords", "salad", "heading", "prose"):
        out[AT[name]] = size[name] / total
    return out, lang
