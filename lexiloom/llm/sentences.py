"""Problem 1: sentence units of texts in many languages and line layouts.

Blank lines always end a unit. Other candidate boundaries are classified by two maximum-entropy models (logistic regression
over indicator features), trained on the boundaries of a bounded sample that need no judgement. How words stand to marks and to
ends and beginnings of paragraphs is counted over all documents: every task has the counts of the most frequent words, those of
all others are joined to the texts that have them before or after a mark.

- marks: an end mark, with its closing marks, and what follows. Surely a boundary before a blank line; surely none before a
  word in lower case (unless such a word also begins paragraphs), a digit or a comma. Features: the tokens on both sides,
  their case, length, digits and script, how often the left one ends and the right one begins paragraphs, marks and spaces.
- line ends without an end mark. Surely a heading's between blank lines; surely none before lower case. Features: length of
  the line against the widest one, whether the next word would have fitted, numbering, case.

No boundary lies inside a closed quotation or bracket. Thai has no end marks: there, white space between two Thai letters
is the boundary.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.sampling import sample_texts
from lexiloom.session import spread, stored

#: The sample that the models are trained on: at most so many documents of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 20_000
#: A word is surely an abbreviation if it ends paragraphs at most RARE_END times as often as words with marks do on average, and
#: so many ends were expected of it.
RARE_END, EXPECTED_ENDS = 0.05, 4
#: A word that begins paragraphs in at most this share of its occurrences doesn't begin any by rule.
RARE_START = 0.001
#: Words of each side of a mark whose counts every task has (the most frequent ones; those of the rest come with the texts), and
#: characters from which a word is counted by a digest.
KEPT_WORDS, WORD_CHARS = 100_000, 40
#: Different words a task counts before it passes them on.
FLUSH_WORDS = 300_000

# Abbreviations common in running text, by language. One of the features, no rule.
ABBREVIATIONS = frozenset(
    """
    dr mr mrs ms prof st no nos fig figs sect sec ch chap eq ref vol vs eg ie e.g i.e cf p pp ed eds al approx etc inc ltd co jr sr gen
    nr ca bzw z b d h u a usw abb s ff vgl sog evtl tab kap hrsg str
    sra srta dra pág págs núm cap aprox ej art ee uu
    m mme mlle env av ex n°
    г гг т е д др рис см табл ок гл с стр проф акад им ул тыс млн
    डॉ पृ श्री सं
    د ص أ م
    """.split()
)
# Month names after which a day's ordinal point stands before a capital.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

END = ".!?…。！？।؟｡．॥۔‼⁇⁈⁉"
OPEN = "\"'“„«‹‘‚(（[［{「『《〈【¿¡"
CLOSE = "\"'”“»›’‘)）]］}」』》〉】"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’", "(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "{": "}"}
ONLY_OPEN = "".join(c for c in PAIRS if not any(c in ends for ends in PAIRS.values()))
#: Shorter lines before an ordinal are headings.
SHORT_LINE = 40
#: Signs after a mark that go on with the sentence.
GOES_ON = ",;:)）]—–-、，；：،؛%/&+="

SPACE = r"[\s\xa0\u2007\u202f\u200b\ufeff]"
LINE = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
PARAGRAPH = regex.compile(rf"{SPACE}*{LINE}{SPACE}*?{LINE}{SPACE}*")
CLUSTER = regex.compile(rf"[{END}](?:{SPACE}?[{END}])*(?:[\xa0\u202f]?[{regex.escape(CLOSE)}{END}])*")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’\-]*(?:\.[\p{L}\p{M}\p{N}]+)*")
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
THAI_GAP = regex.compile(rf"(?<=\p{{Thai}})(?<!\p{{N}}){SPACE}+(?=\p{{Thai}})(?!\p{{N}})")
LINE_END = regex.compile(rf"{SPACE}*?({LINE}){SPACE}*")
BLANKS = regex.compile(rf"{SPACE}+")
FIRST = regex.compile(r"\S+")
BREAK = regex.compile(LINE)
#: Backwards from a place: characters of words, and a token (of more characters than an abbreviation has, if it is longer).
TAIL, LEAD = regex.compile(r"(?r)[\p{L}\p{M}\p{N}'’\-.]+"), regex.compile(rf"(?r)\S{{1,{WORD_CHARS + 1}}}\s*")
NUMBERED = regex.compile(r"\d+(?:\.\d+)*\.?$")


SIGNS = regex.compile(r"[\"'“”„«»‹›‘’‚()（）\[\]［］「」『』《》〈〉【】{}]")


def _nests(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends (exclusive) of the outermost closed quotations and brackets of a paragraph, however long they are.

    One pass: a closing sign meets the last sign that it can close, and what was opened since is dropped.
    """
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # closing sign: places in the stack of what it can close

    def push(ends: str, i: int) -> None:
        for e in ends:
            waiting.setdefault(e, []).append(len(stack))
        stack.append((ends, i))

    def close(at: int, i: int) -> None:
        found.append((stack[at][1], i + 1))
        while len(stack) > at:
            for e in stack.pop()[0]:
                waiting[e].pop()

    for m in SIGNS.finditer(text):
        c, i = m[0], m.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        at = waiting[c][-1] if c not in ONLY_OPEN and waiting.get(c) else None
        if c in "\"'":
            opens = (not before or before.isspace() or before in OPEN or before in "—–-:") and bool(after) and not after.isspace()
            if at is not None and c == "'" and before.isalnum() and after.isalnum():
                continue  # an apostrophe
            if at is not None and not opens:
                close(at, i)
            elif opens:
                push(c, i)
        elif at is not None:
            close(at, i)
        elif c in PAIRS:
            push(PAIRS[c], i)
    found.sort()
    starts, ends = [], []
    for a, b in found:
        if not ends or a >= ends[-1]:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _shape(word: str) -> str:
    if not word:
        return "none"
    if word[0].isdigit():
        return "d" if word.replace(".", "").replace("-", "").isdigit() else "dx"
    c = word[0]
    if WIDE.match(c):
        return "wide"
    if c.isupper():
        return "X" if len(word) == 1 else "XX" if word.isupper() else "Xx"
    return "x" if c.islower() else "o"


def _bucket(n: int) -> str:
    return str(min(n, 3) if n < 4 else 4 + min(int(np.log2(n)), 9))


def _share(a: int, n: int) -> str:
    return "-" if not n else str(min(int(10 * a / n + 0.999), 10)) if a / n < 0.2 else str(5 * round(a / n * 4))


def _key(word: str) -> str:
    """Words are counted in lower case, all single capitals (initials) as one."""
    return "<initial>" if len(word) == 1 and word.isupper() else word.lower()


def _short(word: str) -> str:
    """What a word is counted as: itself, or a digest of a long one (no word begins with #)."""
    return word if len(word) <= WORD_CHARS else "#" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Counts:
    """How words stand to marks and to ends and beginnings of paragraphs.

    By _key: marked (before an end mark), ends (of these, at the end of a paragraph), plain (elsewhere). By the word as it
    stands: starts (of paragraphs), seen, after (an end mark). Long ones by _short once they are summed up.
    """

    def __init__(self) -> None:
        self.marked, self.ends, self.plain, self.starts, self.seen, self.after = (Counter() for _ in range(6))
        self.end_rate = 0.0

    def add(self, texts: list[str]) -> None:
        tokens: Counter = Counter()
        for text in texts:
            tokens.update(text.split())  # no word holds white space
            parts = _parts(text)
            for p, part in enumerate(parts):
                first = WORD.search(part)
                if first:
                    self.starts[first[0]] += 1
                for c in mark_candidates(part, lead=False):
                    if c[7]:
                        self.marked[_key(c[4])] += 1
                        self.after[c[5]] += 1
                end = _last_mark(part) if p + 1 < len(parts) else None
                if end:
                    key = _key(_word_before(part, end.start()))
                    self.marked[key] += 1
                    self.ends[key] += 1
        for token, n in tokens.items():
            for word in WORD.findall(token):
                self.seen[word] += n

    def rows(self) -> Iterator[tuple[int, str, int, int, int]]:
        """(0, key, marked, ends, all) and (1, word, starts, seen, after) of every word."""
        everywhere: Counter = Counter()
        for word, n in self.seen.items():
            everywhere[word.lower()] += n
        yield from ((0, _short(k), self.marked[k], self.ends[k], everywhere[k]) for k in self.marked.keys() | everywhere.keys())
        yield from ((1, _short(w), self.starts[w], self.seen[w], self.after[w]) for w in self.seen.keys() | self.starts.keys() | self.after.keys())

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str, int, int, int]], end_rate: float | None = None) -> Counts:
        """The sums of all words, or of some of them with the end rate of all."""
        counts = cls()
        counts.take(rows)
        counts.end_rate = sum(counts.ends.values()) / max(1, sum(counts.marked.values())) if end_rate is None else end_rate
        return counts

    def take(self, rows: Iterable[tuple[int, str, int, int, int]]) -> None:
        for side, word, x, y, z in rows:
            if side:
                self.starts[word], self.seen[word], self.after[word] = x, y, z
            else:
                self.marked[word], self.ends[word], self.plain[word] = x, y, max(0, z - x)

    def forget(self, rows: Iterable[tuple[int, str, int, int, int]]) -> None:
        """Without words that were taken."""
        for side, word, *_ in rows:
            for counter in (self.starts, self.seen, self.after) if side else (self.marked, self.ends, self.plain):
                del counter[word]

    def lacking(self, pairs: Iterable[tuple[str, str]]) -> set[tuple[int, str]]:
        """(0, key) and (1, word) that aren't there, of words before and after marks."""
        return {x for left, right in pairs for x in ((0, _short(_key(left))), (1, _short(right))) if x[1] not in (self.starts if x[0] else self.marked)}

    def begins(self, word: str) -> bool:
        """Whether the word begins paragraphs more than by chance."""
        word = _short(word)
        return self.starts[word] > RARE_START * self.seen[word]

    def abbreviation(self, key: str) -> bool:
        """Whether a word with a point is surely an abbreviation; of the known ones a single occurrence is enough."""
        key = _short(key)
        n, expected = self.marked[key], self.end_rate * self.marked[key]
        return n > 0 and (key in ABBREVIATIONS or expected >= EXPECTED_ENDS) and self.ends[key] <= RARE_END * expected and self.plain[key] < n


def count_words(documents: DataFrame) -> Counts:
    """The counts of the KEPT_WORDS most frequent words of all documents that stand before marks, and of as many that stand after
    them or begin paragraphs."""
    return _all_words(documents)[0]


def _all_words(documents: DataFrame) -> tuple[Counts, DataFrame | None]:
    """(counts of the most frequent words; side, word, x, y, z of all others, if there are any, stored)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*counts.rows()), types)], names=names)
            yield from table.to_batches(50_000)

        names, types = ["side", "word", "x", "y", "z"], (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        counts = Counts()
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                counts.add(batch.slice(at, 256).column("text").to_pylist())
                if len(counts.seen) > FLUSH_WORDS:
                    yield from out()
                    counts = Counts()
        if counts.seen or counts.marked:
            yield from out()

    counted = spread(documents.filter("text is not null").select("text")).mapInArrow(run, "side int, word string, x long, y long, z long")
    counted = stored(counted.groupBy("side", "word").agg(*[F.sum(c).alias(c) for c in "xyz"]).filter("x > 0 or side = 1 and z > 0"))
    sums = {r["side"]: r for r in counted.groupBy("side").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    rows: list[tuple] = []
    others = []
    for side, weight in ((0, "x"), (1, "y")):
        kept = counted.filter(F.col("side") == side).orderBy(F.desc(weight), "word").limit(KEPT_WORDS).toArrow()
        rows += zip(*(kept.column(c).to_pylist() for c in kept.column_names))
        if side in sums and sums[side]["n"] > kept.num_rows:
            least, last = rows[-1][3 if side else 2], rows[-1][1]
            others.append((F.col("side") == side) & ((F.col(weight) < least) | (F.col(weight) == least) & (F.col("word") > last)))
    rate = sums[0]["y"] / max(1, sums[0]["x"]) if 0 in sums else 0.0
    return Counts.of(rows, rate), counted.filter(reduce(Column.__or__, others)) if others else None


def _mark_features(left: str, shape: str, right: str, right_shape: str, cluster: str, opener: str, counts: Counts, own_end: int, own_start: int, before: str) -> list[str]:
    key, nxt = _short(_key(left)), _short(right)
    # without this very place
    n, e, plain = max(counts.marked[key] - 1, 0), max(counts.ends[key] - own_end, 0), counts.plain[key]
    s, seen = max(counts.starts[nxt] - own_start, 0), max(counts.seen[nxt] - 1, 0)
    size = len(left)
    length = "1" if size == 1 else "2" if size < 4 else "4" if size < 6 else "6"
    mark = "." if cluster.strip(CLOSE + " \xa0") == "." else "..." if cluster.count(".") > 1 or "…" in cluster else "!"
    closed = "q" if any(c in "\"'”“»’」』" for c in cluster) else "b" if any(c in ")）]" for c in cluster) else ""
    return [
        "bias", f"m{mark}", f"l{shape}{length}", f"a{key in ABBREVIATIONS}{mark}", f"e{_bucket(n)}:{_share(e, n)}{mark}", f"p{_bucket(plain)}",
        f"r{right_shape}{mark}", f"s{_bucket(seen)}:{_share(s, seen)}", f"rs{right_shape}:{_share(s, seen)}", f"lr{shape}:{length}:{right_shape}", f"c{closed}:{right_shape}", f"o{opener}",
        f"dot{'.' in left}", f"n{shape == 'd'}:{before in ABBREVIATIONS}",
    ]


def _half(row: list[str], right: bool) -> list[str]:
    """The features of one side of a mark only."""
    return [f for f in row if f[0] in "bmc" or (f[0] in "rs" or f[0] == "o") == right and not f.startswith("lr")]


def _line_features(line: str, widest: int, first: str, shape: str, alone: bool) -> list[str]:
    n = len(line)
    fits = n + 1 + len(first) <= widest
    head = line.split(" ", 1)[0]
    tail = _shape(line.rsplit(" ", 1)[-1])
    return [
        "bias", f"n{min(n // 10, 9)}", f"w{int(10 * n / max(widest, 1))}", f"f{fits}", f"r{shape}", f"fr{fits}:{shape}", f"u{bool(NUMBERED.match(head))}", f"h{_shape(head)}",
        f"t{tail}", f"k{line[-1] in ',;:-–'}", f"a{alone}", f"nf{min(n // 10, 9)}:{fits}", f"words{min(line.count(' '), 12)}",
    ]


class MaxEnt:
    """Two-class maximum entropy over indicator features, with a Gaussian prior."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    @classmethod
    def fit(cls, rows: list[list[str]], labels: list[int], least: int = 2, prior: float = 1.0, turns: int = 150) -> MaxEnt:
        count = Counter(f for r in rows for f in r)
        names = {f: i + 1 for i, f in enumerate(sorted(f for f, n in count.items() if n >= least))}
        if not rows or not names:
            return cls({}, np.zeros(1))
        wide = max(map(len, rows))
        at = np.zeros((len(rows), wide), dtype=np.int64)
        for i, r in enumerate(rows):
            at[i, : len(r)] = [names.get(f, 0) for f in r]
        y = np.array(labels, dtype=np.float64)
        w, m, v = np.zeros(len(names) + 1), 0.0, 0.0
        for t in range(1, turns + 1):
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -30, 30)))
            g = np.bincount(at.ravel(), weights=np.repeat(p - y, wide), minlength=len(w)) + prior * w
            g[0] = 0
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(names, w)

    def score(self, row: list[str]) -> float:
        return float(sum(self.weights[self.names[f]] for f in row if f in self.names))


def _paragraphs(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def _parts(text: str) -> list[str]:
    return [text[a:b].strip() for a, b in _paragraphs(text)]


def _word_before(part: str, at: int) -> str:
    """The word, or the part of a word, that ends at a place: found backwards, however long it is."""
    stretch = TAIL.match(part, 0, at)
    left = ""
    if stretch:
        for w in WORD.finditer(part, stretch.start(), at):
            left = w[0] if w.end() == at else ""
    return left


def _lead(part: str, at: int) -> str:
    """The token, or the part of one, before a place and the white space before it; "" for those longer than any abbreviation."""
    found = LEAD.match(part, 0, at)
    token = found[0].rstrip() if found else ""
    return token.rstrip(".").lower() if len(token) <= WORD_CHARS else ""


def _last_mark(part: str) -> regex.Match | None:
    """The end marks at the end of a paragraph."""
    last = None
    for m in CLUSTER.finditer(part, max(0, len(part) - 6)):
        last = m
    return last if last and last.end() == len(part) else None


def mark_candidates(part: str, lead: bool = True) -> Iterator[tuple]:
    """(end of cluster, start of what follows, features' inputs) of each end mark in a paragraph."""
    for m in CLUSTER.finditer(part):
        stop = m.end()
        cluster = m[0]
        # a closing sign that opens something instead
        while len(cluster) > 1 and cluster[-1] in "\"'“‘" and part[m.end() : m.end() + 1].isalnum():
            stop -= 1
            cluster = cluster[:-1].rstrip("\xa0\u202f")
            stop = m.start() + len(cluster)
            break
        gap = BLANKS.match(part, stop)
        after = gap.end() if gap else stop
        if after >= len(part):
            continue
        i = after
        while i < len(part) and (part[i] in OPEN or part[i].isspace()):
            i += 1
        right = WORD.match(part, i)
        right = right[0] if right else ""
        left = _word_before(part, m.start())
        yield m.start(), stop, after, cluster, left, right, (part[after] if i > after else ""), (gap[0] if gap else ""), (_lead(part, m.start() - len(left)) if lead else "")


def _excluded(part: str, c: tuple, line_start: bool, counts: Counts) -> bool:
    """Whether the signs around a mark leave no choice: what follows goes on with the sentence, the number is an ordinal, the
    bracket is a remark of the sentence, or there is no space where there would be one."""
    at, stop, after, cluster, left, right, opener, gap, _ = c
    nxt = part[after]
    if nxt in GOES_ON or (not right and not opener and not nxt.isalnum()):
        return True
    if _script(cluster):
        return False
    if not gap:
        # without a space only between a word in lower case (or a closing sign) and a capital
        head = right[:2]
        if cluster[-1] in ".!?…" and left and not (left[-1].islower() and len(left) > 1 and ("." not in left or counts.begins(right))):
            return True
        if not (head[:1].isupper() and (len(head) == 1 or head[1:].islower()) or opener and opener in "“„«¿¡("):
            return True
    if left.isdigit() and (line_start or right.lower() in MONTHS):
        return True  # an ordinal at the beginning of a line, or of a date
    if opener and opener in "(（[":
        places = _places(part, {"(": ")", "（": "）"}.get(opener, "]"))
        k = bisect_left(places, after)
        if k == len(places):
            return True
        close = places[k]
        return not part[after + 1 : after + 2].isupper() or part[close - 1] not in END
    return False


@lru_cache(maxsize=8)
def _places(part: str, sign: str) -> list[int]:
    """Where a sign stands in a paragraph."""
    return [m.start() for m in regex.finditer(regex.escape(sign), part)]


def _script(cluster: str) -> str:
    """The kind of a mark that only ends sentences: of scripts without spaces, or of scripts without capitals; else empty."""
    return "wide" if any(x in "。！？｡．" for x in cluster) else "line" if cluster[0] in "।॥۔" else ""


def _script_features(script: str, cluster: str, gap: str, nxt: str) -> list[str]:
    """Features of script, mark, gap and following sign of such a mark; no word of another script shares them."""
    closed = any(x in "”」』’" for x in cluster)
    return [f"{script}", f"{script}:{cluster[0]}", f"{script}q{closed}", f"{script}q{closed}:{bool(gap)}:{nxt in '“「『'}", f"{script}r{_shape(nxt)}"]


class Lines:
    """The lines of a paragraph, for what stands before an ordinal."""

    def __init__(self, part: str):
        self.part, self.starts = part, [0, *(m.end() for m in BREAK.finditer(part))]

    def begins(self, at: int, cuts: set[int]) -> bool:
        """Whether a number at a place begins a line after a finished sentence or a short line; not where a line just happens
        to begin with a number."""
        end = at
        while end and self.part[end - 1].isspace():
            end -= 1
        if not end:
            return True
        line = self.starts[bisect_right(self.starts, end - 1) - 1]
        return bool(BREAK.search(self.part, end, at)) and (end in cuts or self.part[end - 1] not in END and end - line < SHORT_LINE)


class Splitter:
    """The models, and the units of a text by them."""

    def __init__(self, counts: Counts, marks: MaxEnt, lines: MaxEnt):
        self.counts, self.marks, self.lines = counts, marks, lines

    def _is_mark_boundary(self, part: str, c: tuple, line_start: bool) -> bool:
        at, stop, after, cluster, left, right, opener, gap, before = c
        if _excluded(part, c, line_start, self.counts):
            return False
        script = _script(cluster)
        row = _script_features(script, cluster, gap, part[after]) if script else _mark_features(left, _shape(left), right, _shape(right), cluster, opener, self.counts, 0, 0, before)
        return self.marks.score(row) > 0

    def units(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        widest = max((len(x.strip()) for x in regex.split(LINE, text)), default=0)
        for a, b in _paragraphs(text):
            part = text[a:b]
            starts, ends = _nests(part)
            opened = set(starts)
            cuts: set[int] = set()
            lines = Lines(part)

            def inside(i: int) -> bool:
                k = bisect_right(starts, i) - 1
                return k >= 0 and i < ends[k]

            for c in mark_candidates(part):
                stop = c[1]
                if inside(stop) and stop not in opened:
                    continue
                line_start = c[4].isdigit() and lines.begins(c[0] - len(c[4]), cuts)
                if self._is_mark_boundary(part, c, line_start):
                    cuts.add(stop)
            for m in THAI_GAP.finditer(part):
                if not inside(m.start()):
                    cuts.add(m.start())
            begin, first_line = 0, part.find("\n") if "\n" in part else len(part)
            for m in LINE_END.finditer(part):
                line, begin_next = part[begin : m.start()].strip(), m.end()
                whole = part[begin : m.start()]
                begin = begin_next
                if not line or begin_next >= len(part) or inside(m.start()):
                    continue
                closed = line.rstrip(CLOSE + " \xa0")
                if closed and closed[-1] in END:
                    continue
                nxt = part[begin_next]
                if regex.match(r"\p{Thai}", line[-1]) and regex.match(r"\p{Thai}", nxt):
                    continue
                first = FIRST.match(part, begin_next)[0]
                alone = m.start() - len(whole) == 0 or m.start() - len(whole) in cuts or any(x in cuts for x in range(max(0, m.start() - len(whole) - 3), m.start() - len(whole) + 1))
                alone = alone or m.start() <= first_line
                row = _line_features(line, widest, first, _shape((WORD.search(first) or [""])[0]), alone)
                if self.lines.score(row) > 0:
                    cuts.add(m.start())
            at = 0
            for cut in [*sorted(cuts), len(part)]:
                piece = part[at:cut]
                lead = len(piece) - len(piece.lstrip())
                body = piece.strip().strip("\u200b\ufeff")
                if body:
                    start = at + piece.index(body, lead)
                    out.append((a + start, a + start + len(body)))
                at = cut
        return out


def _around(text: str) -> Iterator[tuple[str, str]]:
    """The words before and after each mark of a text, as units() sees them."""
    for a, b in _paragraphs(text):
        yield from ((c[4], c[5]) for c in mark_candidates(text[a:b], lead=False))


def _trained_on(text: str) -> Iterator[tuple[str, str]]:
    """The words before and after each mark of a text, as train() sees them."""
    parts = _parts(text)
    for part, after in zip(parts, [*parts[1:], ""]):
        yield from ((c[4], c[5]) for c in mark_candidates(part, lead=False))
        last = _last_mark(part) if after else None
        if last:
            yield _word_before(part, last.start()), (WORD.match(after.lstrip(OPEN)) or [""])[0]


def train(texts: list[str], counts: Counts | None = None) -> Splitter:
    """The models of a sample of texts, with the counts of the whole (by default those of the sample)."""
    if counts is None:
        own = Counts()
        own.add(texts)
        counts = Counts.of(own.rows())
    prepared = [(text, _parts(text)) for text in texts]
    marked: list[tuple] = []
    unsure: list[tuple] = []
    # textbook examples, so that a script of which the sample has nothing is known too
    plain = [(1, _script_features(_script(m), m, gap, nxt)) for m in "。！？｡．।॥۔" for gap, nxt in (("", "天"), (" ", "天"), (" ", "क"), (" ", "ا"))]
    quoted = [(int(bool(gap) or nxt == "“"), _script_features("wide", m + "”", gap, nxt)) for m in "。！？" for gap, nxt in (("", "天"), (" ", "天"), ("", "“"))]
    reliable = (plain + quoted) * 3
    for _, parts in prepared:
        for p, part in enumerate(parts):
            for c in mark_candidates(part):
                left, right, script, nxt = c[4], c[5], _script(c[3]), part[c[2]]
                if script and not _excluded(part, c, False, counts):
                    # a mark that only ends sentences does so, unless it closes a quotation that the text goes right on after
                    goes_on = any(x in "”」』’" for x in c[3]) and not c[7] and nxt not in "“「『"
                    reliable.append((int(not goes_on), _script_features(script, c[3], c[7], nxt)))
                if not c[7]:
                    continue
                mid = nxt in ",;:" or nxt.isdigit() or (right[:1].islower() and not c[6] and not counts.begins(right))
                if mid:
                    marked.append((0, c))
                elif left and c[3] == ".":
                    unsure.append(c)
            last = _last_mark(part) if p + 1 < len(parts) else None
            if last:
                left = _word_before(part, last.start())
                nxt = parts[p + 1]
                i = 0
                while i < len(nxt) and nxt[i] in OPEN:
                    i += 1
                right = WORD.match(nxt, i)
                c = (0, 0, 0, last[0], left, right[0] if right else "", nxt[0] if i else "", " ", _lead(part, last.start() - len(left)))
                marked.append((1, c))
                if _script(last[0]):
                    reliable.append((1, _script_features(_script(last[0]), last[0], " ", nxt[0])))
    # a word that often has a point but hardly ever at the end of a paragraph is an abbreviation wherever it stands
    sure = [c for c in unsure if counts.abbreviation(_key(c[4]))]

    def features(c: tuple, label: int) -> list[str]:
        return _mark_features(c[4], _shape(c[4]), c[5], _shape(c[5]), c[3], c[6], counts, label, label, c[8])

    rows, labels = [features(c, label) for label, c in marked], [label for label, _ in marked]
    left_only = [_half(features(c, 0), False) for c in sure]  # what follows a title (a name) says nothing
    # every example also with one side only, so that a title, which no sure example has before lower case, is known by itself
    marks = MaxEnt.fit(
        rows + [_half(r, False) for r in rows] + [_half(r, True) for r in rows] + left_only * 2 + [r for _, r in reliable],
        labels * 3 + [0] * (2 * len(left_only)) + [label for label, _ in reliable])
    rows, labels = [], []
    for text, parts in prepared:
        widest = max((len(x.strip()) for x in regex.split(LINE, text)), default=0)
        for p, part in enumerate(parts):
            lines = [x.strip() for x in regex.split(LINE, part)]
            for k, line in enumerate(lines):
                closed = line.rstrip(CLOSE + " \xa0")
                if not closed or closed[-1] in END or regex.search(r"\p{Thai}", line):
                    continue
                if k + 1 < len(lines) and lines[k + 1]:
                    first = lines[k + 1].split(None, 1)[0]
                    word = (WORD.search(first) or [""])[0]
                    if word[:1].islower() and not counts.begins(word) or line[-1] in ",;":
                        rows.append(_line_features(line, widest, first, _shape(word), k == 0))
                        labels.append(0)
                elif len(lines) == 1 and p + 1 < len(parts) and len(line) < 80:
                    first = parts[p + 1].split(None, 1)[0]
                    rows.append(_line_features(line, widest, first, _shape((WORD.search(first) or [""])[0]), True))
                    labels.append(1)
    return Splitter(counts, marks, MaxEnt.fit(rows, labels))


def sentence_units(documents: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """doc_id, unit, start_pos, end_pos: the ordered sentence units of every text, in code points (ends exclusive).

    Texts that are null, empty or blank have no unit. The models are trained on a part of `sample` (by default `documents`), their words counted over all of it. Repeated
    rows give repeated units; other columns are ignored.
    """
    documents = documents.select("doc_id", "text").filter("text is not null")
    whole = sample if sample is not None else documents
    texts = sample_texts(whole, SAMPLE_DOCS, 40, SAMPLE_CHARS)
    counts, others = _all_words(whole)
    spark = documents.sparkSession
    if others is None:
        split, documents = train(texts, counts), spread(documents)
    else:
        asked = sorted(counts.lacking(x for text in texts for x in _trained_on(text)))
        asked = others.join(spark.createDataFrame(asked, "side int, word string"), ["side", "word"]).select(*others.columns).toArrow()
        asked = list(zip(*(asked.column(c).to_pylist() for c in others.columns)))
        counts.take(asked)
        split = train(texts, counts)
        counts.forget(asked)
        documents = _with_words(documents, counts, others)
    shared = spark.sparkContext.broadcast(split)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = shared.value
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = part.column("words").to_pylist() if "words" in part.schema.names else [None] * part.num_rows
                rows = []
                for k, t, own in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), words):
                    own = [tuple(w.values()) for w in own or ()]
                    split.counts.take(own)
                    rows += [(k, i, a, b) for i, (a, b) in enumerate(split.units(t))]
                    split.counts.forget(own)
                columns = list(zip(*rows)) if rows else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "unit", "start_pos", "end_pos"])

    return documents.mapInArrow(run, "doc_id long, unit int, start_pos long, end_pos long")


def _with_words(documents: DataFrame, counts: Counts, others: DataFrame) -> DataFrame:
    """doc_id, text, words: the rows of `others` for the words before and after the text's marks that `counts` lacks; null if none.

    Texts are told apart by a hash; where two have the same one, each gets the words of both.
    """
    known = documents.sparkSession.sparkContext.broadcast(counts)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(k, *x) for k, t in zip(part.column("text_hash").to_pylist(), part.column("text").to_pylist()) for x in known.value.lacking(_around(t))]
                columns = list(zip(*rows)) if rows else ([],) * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], ["text_hash", "side", "word"])

    text_hash = F.xxhash64("text").alias("text_hash")
    asked = spread(documents.select(text_hash, "text")).mapInArrow(run, "text_hash long, side int, word string")
    words = asked.join(others, ["side", "word"]).groupBy("text_hash").agg(F.collect_set(F.struct(*others.columns)).alias("words"))
    return documents.select("doc_id", "text", text_hash).join(words, "text_hash", "left").select("doc_id", "text", "words")


def scoped_units(documents: DataFrame, scope: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos of the documents named in `scope` (null or repeated ids there count once or not at all)."""
    wanted = documents.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    return sentence_units(wanted, documents).select("doc_id", "start_pos", "end_pos")
