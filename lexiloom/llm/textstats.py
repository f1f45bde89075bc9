"""Statistics of a text's make-up, used by problems 2 and 9, for many texts at once.

Texts become one array of code points; whatever is counted by line, by item (what stands between separators and marks) or by
text is a difference of running sums at their borders. Nothing here says what kind of text a line is: that is learned.

Shares are shares of the text's characters without the white space around lines, so that half of the text is one half.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from lexiloom.llm.codes import batches, code_points, joined, mix

_LETTER, _DIGIT, _UPPER, _BLANK, _MARK, _CLOSER, _BROKEN, _WIDE, _THAI, _BREAK, _SYMBOL, _COMMA, _BAR, _JOINED = (1 << i for i in range(14))

#: Bins of a line: words (up to), whether it ends with a mark, share of frequent words (up to). Each is a statistic: the share
#: of the text in lines of that kind.
WORD_BINS, COMMON_BINS = (3, 6, 10, 20), (0.05, 0.15)
LINE_KINDS = tuple(f"words{w}_{e}_{c}" for w in (*WORD_BINS, "more") for e in ("open", "ended") for c in ("rare", "some", "common"))
#: Shares of the text in lines with a property.
LINE_SHARES = ("bulleted", "numbered", "barred", "dotted", "addressed", "tagged", "digital", "symbolic", "broken_lines", "unspaced", "quoted", "many_items", "short_items", "labelled", "coded", "twice")
NAMES = (
    "log_chars", "words", "mean_word", "symbols", "digits", "upper", "ended", "common", "type_ratio", "entropy", "top_pair", "mean_line", "item_words", "address_chars", "commas", "bars",
    "repeated_items", "repeated_heads", "repeated_words", "repeated_pairs", "variety", "longest_token", "spaces", "line_spread", "short_run", "marks", "item_types", *LINE_SHARES, *LINE_KINDS,
)
AT = {n: i for i, n in enumerate(NAMES)}
#: An item, or the beginning of an item, is repeated if it occurs so often.
REPEATS = 3
#: Letters of a word in scripts without spaces.
WIDE_WORD, THAI_WORD = 1.7, 4.5
#: Characters of texts that are counted at once; a longer text is counted in pieces of about PIECE characters, cut after a line
#: or word, and its statistics are the means of theirs, weighted by length.
BATCH_CHARS, PIECE = 200_000, 2_000_000
#: Longest frequent words of scripts without spaces that are looked for.
LONGEST_WIDE = 8


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    chars = [chr(c) for c in range(0x110000)]
    kinds = np.array([unicodedata.category(c) for c in chars])
    major = kinds.astype("U1")
    table = np.zeros(0x110000, dtype=np.uint32)
    table[np.isin(major, ["L", "M"])] |= _LETTER
    table[major == "M"] |= _JOINED
    table[major == "N"] |= _DIGIT
    table[kinds == "Lu"] |= _UPPER
    blank = np.zeros(0x110000, dtype=bool)
    blank[[c for c in range(0x3001) if chars[c].isspace()]] = True
    table[blank] |= _BLANK
    table[np.isin(major, ["P", "S", "C"]) & ~blank] |= _SYMBOL
    for bit, those in ((_BREAK, "\n\r\x0b\x0c\x85  "), (_MARK, ".!?。！？।؟…॥۔"), (_CLOSER, "\"”»“)]'’」』） \xa0"), (_COMMA, ",，、،；;؛"), (_BAR, "|\t·•#>")):
        table[[ord(c) for c in those]] |= bit
    for a, b in ((0x80, 0x85), (0x86, 0xA0), (0x00, 0x09), (0x0E, 0x20), (0xE000, 0xF900), (0xFFFD, 0xFFFE)):
        table[a:b] |= _BROKEN
    for a, b in ((0x3041, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        table[a:b] |= _WIDE
    table[0x0E01:0x0E4F] |= _WIDE | _THAI
    return table


def _text_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch [start, end): equal stretches have equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        values = mix(codes[np.repeat(starts, sizes) + place].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(21)), 3)
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) ^ sizes.astype(np.uint64)


class Lexicon:
    """Frequent words by language, as hashes; those of scripts without spaces by their length."""

    def __init__(self, words: list[tuple[str, str]]):
        table = _table()
        by: dict[str, set[str]] = {}
        for lang, word in words:
            if lang and word:
                by.setdefault(lang, set()).add(word.lower())
        self.langs = tuple(sorted(by))
        spaced: dict[int, int] = {}
        wide: dict[int, dict[int, int]] = {}
        for k, lang in enumerate(self.langs):
            unspaced = all(table[ord(w[0])] & _WIDE for w in by[lang])
            for w in by[lang]:
                h = int(_text_hash(code_points(w), np.array([0]), np.array([len(w)]))[0])
                if not unspaced:
                    spaced[h] = spaced.get(h, 0) | 1 << k
                elif len(w) <= LONGEST_WIDE:
                    at = wide.setdefault(len(w), {})
                    at[h] = at.get(h, 0) | 1 << k
        self.spaced = self._sorted(spaced)
        self.wide = {n: self._sorted(h) for n, h in wide.items()}
        self.unspaced = sum(1 << k for k, lang in enumerate(self.langs) if all(table[ord(w[0])] & _WIDE for w in by[lang]))

    @staticmethod
    def _sorted(words: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(words), dtype=np.uint64)
        return keys, np.array([words[int(k)] for k in keys], dtype=np.int64)

    @staticmethod
    def find(known: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The languages (bits) of each hash; 0 for unknown words."""
        keys, bits = known
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, bits[at], 0)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64 if x.dtype.kind in "bui" else np.float64)])


def _grouped(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often the value of each row occurs in its document."""
    if not len(doc):
        return np.empty(0, np.int64)
    key = mix(value ^ mix(doc.astype(np.uint64), 17), 23)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse]


def _pieces(text: str, piece: int) -> list[str]:
    if len(text) <= piece:
        return [text]
    out, at = [], 0
    while at < len(text):
        stop = min(at + piece, len(text))
        if stop < len(text):
            stop = text.rfind("\n", at + piece // 2, stop) + 1 or text.rfind(" ", at + piece // 2, stop) + 1 or stop
        out.append(text[at:stop])
        at = stop
    return out


def statistics(texts: list[str | None], lexicon: Lexicon, piece: int = PIECE) -> tuple[np.ndarray, list[str]]:
    """The vectors of NAMES (rows) and the best language of each text; zeros and "" for null or blank texts."""
    parts = [(i, p) for i, t in enumerate(texts) if t and t.strip() for p in _pieces(t, piece) if p.strip()]
    out, langs, weight = np.zeros((len(texts), len(NAMES))), [""] * len(texts), np.zeros(len(texts))
    for some in batches(parts, BATCH_CHARS):
        vectors, found = _counted([p for _, p in some], lexicon)
        for (i, p), v, lang in zip(some, vectors, found):
            if not weight[i]:
                langs[i] = lang
            out[i] += v * len(p)
            weight[i] += len(p)
    out /= np.maximum(weight, 1)[:, None]
    return out, langs


def _counted(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, list[str]]:
    raw, begin, part = joined([code_points(t + "\n") for t in texts])
    codes = joined([code_points(t.lower() + "\n") for t in texts])[0]
    if len(codes) != len(raw):  # lower case of other length
        codes = joined([code_points("".join([c.lower() if len(c.lower()) == 1 else c for c in t]) + "\n") for t in texts])[0]
    return _vectors(codes, raw, part, len(texts), lexicon)


def _vectors(codes: np.ndarray, raw: np.ndarray, part: np.ndarray, n: int, lexicon: Lexicon) -> tuple[np.ndarray, list[str]]:
    table = _table()
    bits = table[codes]
    has = lambda b: (bits & b) > 0
    blank, wide, word = has(_BLANK | _BREAK), has(_WIDE), has(_LETTER | _DIGIT)
    # lines, from their first to their last character that is no white space
    solid = np.flatnonzero(~blank)
    line_of = np.cumsum(np.concatenate([[False], (has(_BREAK))[:-1]]))
    new = np.concatenate([[True], line_of[solid][1:] != line_of[solid][:-1]])
    head = np.flatnonzero(new)
    first, last = solid[head], solid[np.append(head[1:], len(solid)) - 1] + 1
    doc = part[first]
    size = (last - first).astype(np.float64)
    total = np.bincount(doc, weights=size, minlength=n)
    cut = lambda sums: sums[last] - sums[first]
    count = lambda b: cut(_sums(has(b)))
    of_docs = lambda x: np.bincount(doc, weights=x, minlength=n)
    share = lambda x: np.bincount(doc, weights=x * size, minlength=n) / total

    # words: runs of letters and digits, with apostrophes and hyphens inside; those of scripts without spaces by their letters
    inner = np.isin(codes, (39, 0x2019, 45))
    inner[1:-1] &= word[:-2] & word[2:]
    inner[[0, -1]] = False
    run = (word & ~wide) | inner
    edge = np.diff(np.concatenate([[False], run, [False]]).astype(np.int8))
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w_doc, w_hash = part[w_start], _text_hash(codes, w_start, w_end)
    known = lexicon.find(lexicon.spaced, w_hash)
    hit = np.zeros(len(codes), dtype=np.int64)  # languages of the frequent word that starts here
    hit[w_start] = known
    thai = has(_THAI)
    units = np.zeros(len(codes))
    units[w_start] = 1
    units[wide & ~thai] = 1 / WIDE_WORD
    units[thai] = 1 / THAI_WORD
    unit_sums = _sums(units)
    words = cut(unit_sums)
    # frequent words of scripts without spaces: twice their letters against all letters, as each stands with a rare one
    wide_at = np.flatnonzero(wide)
    weight = np.zeros((len(lexicon.langs), n))
    cover = np.zeros(len(codes))
    letters_wide = np.bincount(part[wide_at], minlength=n)
    n_words = np.bincount(w_doc, minlength=n)
    w_letters = np.bincount(w_doc, weights=w_end - w_start, minlength=n)
    found_wide: list[tuple[np.ndarray, np.ndarray, int]] = []
    if len(wide_at):
        for k, those in lexicon.wide.items():
            s = wide_at[wide_at + k <= len(codes)]
            s = s[wide[s + k - 1]]
            got = lexicon.find(those, _text_hash(codes, s, s + k))
            s, got = s[got > 0], got[got > 0]
            found_wide.append((s, got, k))
    for j in range(len(lexicon.langs)):
        if lexicon.unspaced >> j & 1:
            for s, got, k in found_wide:
                at = s[(got >> j & 1) > 0]
                weight[j] += np.bincount(part[at], minlength=n) * 2.0 * k
            weight[j] /= np.maximum(letters_wide, 1)
            weight[j][letters_wide <= 0.3 * np.maximum(1, w_letters)] = 0
        else:
            weight[j] = np.bincount(w_doc, weights=known >> j & 1, minlength=n) / np.maximum(n_words, 1)
    best = weight.argmax(axis=0) if len(lexicon.langs) else np.zeros(n, np.int64)
    common = weight.max(axis=0) if len(lexicon.langs) else np.zeros(n)
    cover[w_start] = known >> best[w_doc] & 1
    for s, got, k in found_wide:
        np.add.at(cover, s, (got >> best[part[s]] & 1) * 2.0 * k / WIDE_WORD)
    line_common = np.minimum(1, cut(_sums(cover)) / np.maximum(words, 0.5))

    # tokens between white space
    edge = np.diff(np.concatenate([[False], ~blank, [False]]).astype(np.int8))
    t_start, t_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    t_doc, t_size = part[t_start], t_end - t_start
    inside = lambda x: (lambda c: c[t_end] - c[t_start])(_sums(x))
    slash, point = codes == 47, codes == 46
    pointed = point & np.append(word[1:], False) & np.concatenate([[False], word[:-1]])
    scheme = np.zeros(len(codes), dtype=bool)
    scheme[:-2] = (codes[:-2] == 58) & slash[1:-1] & slash[2:]
    www = np.zeros(len(codes), dtype=bool)
    www[:-3] = (codes[:-3] == 119) & (codes[1:-2] == 119) & (codes[2:-1] == 119) & point[3:]
    n_pointed = inside(pointed)
    address = (inside(scheme | www) > 0) | (inside(codes == 64) > 0) & (n_pointed > 0) | (inside(slash) > 0) & (n_pointed > 0) & (inside(has(_LETTER)) > 3)
    long = (t_size >= 28) & (inside(codes > 127) == 0) & ~address
    span = np.zeros(len(codes) + 1, dtype=np.int64)
    mark_span = lambda which: (lambda s: (np.add.at(s, t_start[which], 1), np.add.at(s, t_end[which], -1), np.cumsum(s[:-1]))[2])(span.copy())
    addressed = cut(_sums(mark_span(address)))
    tight = cut(_sums(mark_span(long)))
    tag = cut(_sums(np.cumsum((codes == 60).astype(np.int64)) > np.cumsum((codes == 62).astype(np.int64)))) if (codes == 60).any() else np.zeros(len(first))
    angle = np.minimum(cut(_sums(codes == 60)), cut(_sums(codes == 62)))

    # how lines begin and end
    end = last - 1
    for _ in range(4):
        back = has(_CLOSER)[end] & (end > first)
        end = end - back
    ended = has(_MARK)[end]
    c0, c1, c2 = (codes[np.minimum(first + k, len(codes) - 1)] for k in range(3))
    after = lambda k: blank[np.minimum(first + k, len(codes) - 1)]
    bulleted = np.isin(c0, [ord(c) for c in "-*•·▪◦‣+–"]) & after(1)
    closing = (c1 == 46) | (c1 == 41)
    token = np.searchsorted(t_start, first)
    t_first = t_size[np.minimum(token, len(t_size) - 1)]
    last_of_token = codes[first + t_first - 1]
    short_token = (t_first <= 5) & np.isin(last_of_token, (46, 41, 93, 58)) & (has(_DIGIT)[first] | has(_DIGIT)[np.minimum(first + 1, len(codes) - 1)] | (t_first <= 3))
    numbered = short_token | (word[first] & closing & after(2))
    digits, symbols, letters = count(_DIGIT), count(_SYMBOL), count(_LETTER)
    bars, commas = count(_BAR), count(_COMMA)
    twin = np.zeros(len(codes), dtype=bool)
    twin[3:] = (codes[3:] == codes[2:-1]) & (codes[2:-1] == codes[1:-2]) & (codes[1:-2] == codes[:-3]) & has(_SYMBOL)[3:]
    gap = np.zeros(len(codes), dtype=bool)
    gap[2:] = blank[2:] & blank[1:-1] & blank[:-2]
    gaps = cut(_sums(gap))
    quotes = cut(_sums(codes == 34)) + cut(_sums(np.isin(codes, [ord(c) for c in "{}[]"])))
    broken = count(_BROKEN) + cut(_sums(np.isin(codes, (0xC3, 0xC2, 0xD0, 0xD1, 0xE3, 0xE2, 0xF0, 0xF1, 0xE0)) & np.append((bits[1:] & (_SYMBOL | _BROKEN)) > 0, False))) + cut(_sums(np.isin(codes, (0x60, 0xB0, 0x7E, 0x5E, 0x7C, 0xFFFD)) & np.concatenate([[False], (bits[:-1] & _LETTER) > 0])))
    is_upper = table[raw] & _UPPER > 0
    caps = cut(_sums(is_upper[1:] & is_upper[:-1]))

    # items: what stands between separators, marks and line ends
    dash = np.isin(codes, (45, 0x2013, 0x2014))
    dash[1:-1] &= blank[:-2] & blank[2:]
    apart = has(_MARK | _COMMA | _BAR | _BREAK) | dash | slash | np.isin(codes, (58, 0xFF1A, 0xB7))
    body = ~apart & ~blank
    at = np.flatnonzero(body)
    if len(at):
        group = np.cumsum(apart)[at]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        h = np.flatnonzero(new)
        i_start, i_end = at[h], at[np.append(h[1:], len(at)) - 1] + 1
    else:
        i_start = i_end = np.empty(0, np.int64)
    i_doc, i_words, i_chars = part[i_start], unit_sums[i_end] - unit_sums[i_start], (i_end - i_start).astype(np.float64)
    i_again = _grouped(i_doc, _text_hash(codes, i_start, i_end))
    # beginnings: the first two words of an item of three or more
    k = np.searchsorted(w_start, i_start)
    two = (i_words >= 3) & (k + 1 < len(w_start))
    h_end = w_end[np.minimum(k + 1, max(len(w_end) - 1, 0))] if len(w_end) else i_end
    two &= h_end <= i_end
    head_again = np.zeros(len(i_start), np.int64)
    head_again[two] = _grouped(i_doc[two], _text_hash(codes, i_start[two], h_end[two]))
    i_line = np.searchsorted(first, i_start, side="right") - 1
    items = np.bincount(i_line, minlength=len(first))
    phrase = i_words <= 6
    repeated = phrase & (i_again >= REPEATS)
    heads = (i_words <= 9) & (head_again > REPEATS)
    mean_item = words / np.maximum(items, 1)

    # terms, in their order: words, and pairs of neighbouring letters of scripts without spaces
    wide_pair = wide_at[:-1][np.diff(wide_at) == 1]
    order = np.argsort(np.concatenate([w_start, wide_pair]), kind="stable")
    terms = np.concatenate([w_hash, mix(codes[wide_pair].astype(np.uint64) << np.uint64(21) | codes[wide_pair + (1 if len(wide_pair) else 0)].astype(np.uint64), 9)])[order]
    t_of = part[np.concatenate([w_start, wide_pair])[order]]
    n_terms = np.bincount(t_of, minlength=n)
    again = _grouped(t_of, terms)
    pair = np.flatnonzero(t_of[1:] == t_of[:-1])
    p_again = _grouped(t_of[pair], mix(terms[:-1] ^ mix(terms[1:], 5), 6)[pair])
    per = np.maximum(n_terms, 1)
    types = np.bincount(t_of, weights=1 / np.maximum(again, 1), minlength=n)
    logs = np.bincount(t_of, weights=np.log2(np.maximum(again, 1)), minlength=n) / per
    entropy = np.where(types > 1.5, (np.log2(per) - logs) / np.log2(np.maximum(types, 2)), 0.0)
    top = np.zeros(n)
    np.maximum.at(top, t_of[pair], p_again)

    l_again = _grouped(doc, _text_hash(codes, first, last))
    # runs of short lines without a mark
    short = (words <= 5) & ~ended
    starts_run = np.concatenate([[True], ~(short[1:] & short[:-1]) | (doc[1:] != doc[:-1])])
    run_of = np.cumsum(starts_run) - 1
    run_size = np.bincount(run_of)[run_of]

    n_lines = np.bincount(doc, minlength=n)
    long_token = np.zeros(n)
    np.maximum.at(long_token, t_doc, t_size)
    mean_log = of_docs(np.log(size)) / n_lines
    item_weight = np.maximum(np.bincount(i_doc, weights=i_chars, minlength=n), 1)
    shares = {
        "bulleted": bulleted, "numbered": numbered, "barred": (bars + gaps >= 2) | (cut(_sums(codes == 59)) >= 2), "dotted": cut(_sums(twin)) >= 2, "addressed": addressed >= 0.25 * size,
        "tagged": (angle > 0) & (tag >= 0.3 * size), "digital": digits >= 0.2 * size, "symbolic": symbols >= 0.2 * size, "broken_lines": broken >= np.maximum(2, 0.05 * size), "unspaced": tight >= 0.5 * size,
        "quoted": quotes >= 0.05 * size, "many_items": (items >= 4) & (mean_item <= 3.5), "short_items": (items >= 2) & (mean_item <= 5), "labelled": (codes[np.minimum(first + t_first, len(codes) - 1)] == 58) | (last_of_token == 58),
        "coded": caps >= 2, "twice": l_again >= 2,
    }
    values = {
        "log_chars": np.log10(total), "words": of_docs(words), "mean_word": w_letters / np.maximum(n_words, 1), "symbols": of_docs(symbols) / total, "digits": of_docs(digits) / total,
        "upper": of_docs(cut(_sums(is_upper))) / np.maximum(of_docs(letters), 1), "ended": share(ended), "common": common, "type_ratio": types / per, "entropy": entropy, "top_pair": top / per,
        "mean_line": np.log10(total / n_lines), "item_words": np.bincount(i_doc, weights=i_words * i_chars, minlength=n) / item_weight, "address_chars": of_docs(addressed) / total,
        "commas": of_docs(commas) / np.maximum(of_docs(words), 1), "bars": of_docs(bars) / np.maximum(of_docs(words), 1), "repeated_items": np.bincount(i_doc, weights=(i_chars + 1) * repeated, minlength=n) / total,
        "repeated_heads": np.bincount(i_doc, weights=(i_chars + 1) * heads, minlength=n) / total, "repeated_words": np.bincount(t_of, weights=again >= REPEATS, minlength=n) / per,
        "repeated_pairs": np.bincount(t_of[pair], weights=p_again >= REPEATS, minlength=n) / per, "variety": np.log(types + 1) / np.log(per + 2), "longest_token": np.log10(np.maximum(long_token, 1)), "spaces": of_docs(count(_BLANK)) / total,
        "line_spread": np.sqrt(np.maximum(of_docs(np.log(size) ** 2) / n_lines - mean_log**2, 0)), "short_run": share(short & (run_size >= 6)), "marks": of_docs(count(_MARK)) / np.maximum(of_docs(words), 1),
        "item_types": np.bincount(i_doc, weights=1 / np.maximum(i_again, 1), minlength=n) / np.maximum(np.bincount(i_doc, minlength=n), 1), **{k: share(v) for k, v in shares.items()},
    }
    kind = (np.searchsorted(WORD_BINS, words, side="left") * 2 + ended) * 3 + np.searchsorted(COMMON_BINS, line_common, side="left")
    kinds = np.bincount(doc * len(LINE_KINDS) + kind, weights=size, minlength=n * len(LINE_KINDS)).reshape(n, -1) / total[:, None]
    vectors = np.stack([*(values[name] for name in NAMES if name in values)], axis=1)
    return np.hstack([vectors, kinds]), [lexicon.langs[k] if c > 0 else "" for k, c in zip(best, common)]
