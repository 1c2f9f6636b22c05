"""Problem 4: noise of scanned pages, and the readable text without it.

* ``running``: a line in the margins of its page. Where the margins lie is learned: first and last lines that come again on
  other pages of their folder (figures and blanks aside) show where running lines stand. A line is told by its
  place, and where that is unknown by its neighbours' places and by what it says (the page's own number).
* ``hyphen``: a lexicon word broken at a line end by a hyphen that isn't its own.
* ``misread``: a lexicon word with wrongly recognized characters. A symmetric-delete index holds every word with up to two
  characters left out; a token with up to two (longer ones three) left out finds its candidates there (in text without blanks, windows with one
  place left open). Candidates are explained by one or two confusions, each of one or two characters for one or two others.
  A confusion's weight is learned from the corpus: in a first pass every token that is one confusion away from words gives
  a set of confusions that may explain it, and expectation-maximization over the counts of these sets shares them out.
  A repair must be likelier than a word that the lexicon hasn't: the word's frequency, its confusions' weights and the words
  beside it (counts of neighbours over the corpus) against the letters of the token. The likeliest repair is taken.
  No pair of characters is listed, but for the letters that stand for figures in whole-cell numbers.

Look-alike characters are problem 2's and are put right first: they are no misreading.

What every worker needs is bounded and broadcast: the lexicon (``MAX_LEXICON`` words, about 0.3 GB of index at the bound), counts
of its words, and of confusions (pairs of short strings over the alphabets). Counts of neighbours are broadcast if there are
``MAX_PAIRS`` at most. Beyond, they stay a table: a repair that hangs on the words beside it is left open by the scan,
and the counts that it asks for are joined. All neighbours count either way, and the result is the same.

Results for odd input:
  * null, empty and blank texts have no noise; null lines keep their position and are passed over;
  * words under four letters, in Japanese under three characters or all in hiragana, are never found misread;
  * characters that were lost or added are not looked for: a word's other forms can't be told from them;
  * a word of the lexicon in any case is never misread; a tie goes to the first word in order;
  * of rows delivered more than once each kind is reported once;
  * a hyphen at the end of the last line, or before a blank line, is not a break;
  * in a corpus of few pages that don't repeat their first and last lines the margins are those of ``Margins``;
  * texts of any length are read whole; no texts give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .unify import _mapped, lookalikes

MAX_LEXICON, MAX_PAIRS = 500_000, 500_000

# Letters that stand for figures in numbers, and what breaks words.
DIGIT_PAIRS = {"O": "0", "o": "0", "l": "1", "I": "1", "Z": "2", "S": "5", "b": "6", "B": "8", "g": "9", "q": "9"}
HYPHENS = "-‐‑‒¬\xad"

_NUMBER = re.compile(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}")
_NUMBERISH = re.compile(f"[-+]?[\\d,./%{''.join(DIGIT_PAIRS)}]{{4,}}")
_JA = "ぁ-んァ-ヶー一-鿿々"
_JA_RUN = re.compile(f"[{_JA}]")
_HIRAGANA = re.compile("[ぁ-ん]")
_TOKEN = re.compile(f"[^\\s{_JA}、。，．・（）()\\[\\]{{}}「」『』|<>=*/\"“”„«»;:?…]+")
_BREAK = re.compile(f"([^\\s{_JA}(\\[|“\"„«]*[^\\W\\d_{_JA}])[{HYPHENS}][ \\t]*(?:\\r\\n?|\\n)[ \\t]*([^\\W\\d_{_JA}][^\\s{_JA}.,;:!?)\\]|”\"“»]*)")
_BROKEN = re.compile(f"[{HYPHENS}][ \\t]*[\\r\\n]")
_EDGE = ".,!'’`´-‐‑_~^#§$"
_LATIN = re.compile(r"[^\W\d_]")
_LATIN_TEXT = re.compile("[A-Za-zÀ-ÿ]{2}")

Op = tuple[str, str]
#: (kind, start, end, repair, None), or what must be known of neighbours for it; the repair is then None, or holds if there is one.
Place = tuple[str, int, int, str | None, str | None]


@dataclass
class Evidence:
    """What the corpus says: how often a confusion (printed, seen), and a confusion in one word, a printed character, a word, two
    neighbours, a character outside words occur, and the share of tokens that are no word. If ``waits``, counts of neighbours
    are elsewhere, and ``behind`` says how often words stand before another; else it follows from ``pairs``."""

    ops: dict[Op, float] = field(default_factory=dict)
    within: dict[tuple[Op, str], float] = field(default_factory=dict)
    printed: dict[str, float] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    loose: dict[str, int] = field(default_factory=dict)
    unknown: float = 0.1
    behind: dict[str, int] = field(default_factory=dict)
    waits: bool = False


class Letters:
    """Letter bigrams of the lexicon: how likely a token is as a word that the lexicon hasn't."""

    def __init__(self, words: Iterable[str]) -> None:
        one: Counter = Counter()
        two: Counter = Counter()
        for w in words:
            one.update(w + "$")
            two.update(zip("^" + w, w + "$"))
        total, first = sum(one.values()) + 1, Counter()
        for (a, _), n in two.items():
            first[a] += n
        self.one = {c: n / total for c, n in one.items()}
        self.two = {p: n / first[p[0]] for p, n in two.items()}

    def __call__(self, token: str) -> float:
        return sum(math.log(0.8 * self.two.get(p, 0.0) + 0.19 * self.one.get(p[1], 0.0) + 1e-3) for p in zip("^" + token, token + "$"))


def deletes(word: str, most: int = 2) -> set[str]:
    """The word with none to ``most`` of its characters left out."""
    out, last = {word}, {word}
    for _ in range(min(most, len(word) - 1)):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def explanations(word: str, seen: str, most: int = 2) -> list[tuple[Op, ...]]:
    """How ``word`` may have become ``seen``: tuples of up to ``most`` confusions, from left to right. Only one or two characters
    for one or two others; more characters that hold all that was printed (``e`` for ``es``) are another form, no confusion."""
    k = 0
    while k < len(word) and k < len(seen) and word[k] == seen[k]:
        k += 1
    word, seen = word[k:], seen[k:]
    if not word and not seen:
        return [()]
    if not most:
        return []
    out = []
    for i, j in ((1, 1), (1, 2), (2, 1)):
        a, b = word[:i], seen[:j]
        if len(a) == i and len(b) == j and a not in b and b not in a:
            out += [((a, b), *rest) for rest in explanations(word[i:], seen[j:], most - 1)]
    return out


def table_of(words: list[str], most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The symmetric-delete index of some words: sorted hashes of what is left, and the number of the word of each."""
    keys, ids = [], []
    for k, w in enumerate(words):
        left = deletes(w, most)
        keys += [xxhash.xxh3_64_intdigest(x) for x in left]
        ids += [k] * len(left)
    keys_, ids_ = np.array(keys, np.uint64), np.array(ids, np.int32)
    order = np.argsort(keys_, kind="stable")
    return keys_[order], ids_[order]


#: Pseudo-counts: of a confusion nobody saw, by what it needs; of a word and of neighbours. What a second confusion in a word is
#: likelier for, and how much likelier than a new word a repair must be.
UNSEEN_ONE, UNSEEN_MORE, UNSEEN_JA, DISCOUNT, NEIGHBOURS, BURST, MARGIN = 1 / 60, 1 / 600, 1 / 2000, 0.5, 20.0, 3.0, 0.0
#: The share of a word's occurrences that one misreading of it may reach, for words up to three characters and longer ones.
RARE = (0.05, 0.2)
#: Repairs that much less likely than a new word may still be borne out by the words beside them.
REACH = 7.0


class _Heard(dict):
    """Tokens and the words that they are, or None; made as they are met."""

    def __init__(self, known: set[str], hold: int) -> None:
        super().__init__()
        self.known, self.hold = known, hold

    def __missing__(self, token: str) -> str | None:
        if len(self) > self.hold:
            self.clear()
        low = token.strip(_EDGE).lower()
        self[token] = low if low in self.known else None
        return self[token]


class Index:
    """The lexicon as a symmetric-delete index, with what the corpus says."""

    def __init__(self, words: Iterable[str], evidence: Evidence | None = None, latin_table: tuple[np.ndarray, np.ndarray] | None = None, least: int = 4, least_ja: int = 3, hold: int = 400_000) -> None:
        self.evidence = evidence or Evidence()
        self.least, self.least_ja, self.hold = least, least_ja, hold  # letters of a word that can be told from noise; what a worker remembers
        self.words = sorted({w.lower() for w in words if w})
        self.known = set(self.words)
        self.latin = latin_words(self.words, least)
        self.keys, self.ids = latin_table or table_of(self.latin)
        self.longest = max(map(len, self.latin), default=0)
        self.letters = Letters(w for w in self.words if not _JA_RUN.search(w))
        e = self.evidence
        self.n_words = sum(e.words.values()) + 0.5 * len(self.words)
        self.n_loose = sum(e.loose.values()) + 50.0
        self.behind: Counter = Counter(e.behind)
        for (a, _), n in e.pairs.items():
            self.behind[a] += n
        self.log_unknown = math.log(max(1e-4, e.unknown))
        self.cache: dict = {}
        self.heard = _Heard(self.known, hold)
        self.windows: dict[int, dict[str, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
        ja = []
        for w in self.words:
            if _JA_RUN.search(w) and not all(_HIRAGANA.match(c) for c in w):
                ja.append(w)
                if len(w) >= least_ja:
                    for i in range(len(w)):
                        self.windows[len(w)][w[:i] + "\0" + w[i + 1 :]].append((w, i))
        # words inside other words don't mark text as read: they may be what is left of a misread one
        inside = {b[i:j] for b in ja for i in range(len(b)) for j in range(i + 1, len(b) + 1) if j - i < len(b)} & set(ja)
        self.automaton = ahocorasick.Automaton()
        for w in ja:
            if w not in inside and len(w) >= 2:
                self.automaton.add_word(w, len(w))
        self.any_ja = len(self.automaton) > 0
        if self.any_ja:
            self.automaton.make_automaton()

    def _keep(self, key: object, value: object) -> object:
        if len(self.cache) > self.hold:
            self.cache.clear()
        self.cache[key] = value
        return value

    def again(self, text: str, whole_cell: bool) -> list[Place]:
        """``places``, of short texts done once."""
        if len(text) > 100:
            return places(self, text, whole_cell)
        key = (text, whole_cell)
        got = self.cache.get(key)
        return got if got is not None else self._keep(key, places(self, text, whole_cell))

    # ---- weights

    def op(self, op: Op, word: str) -> float:
        """Log of the share in which the printed characters of a confusion are seen so. What this word shows of it counts only
        if it is rare in it: otherwise it is another word, and no confusion."""
        a, b = op
        n = max(0.0, self.evidence.ops.get(op, 0.0) - self.too_often(op, word) - DISCOUNT)
        unseen = UNSEEN_JA if a > "ぁ" else UNSEEN_ONE if len(a) == len(b) == 1 else UNSEEN_MORE  # of as many other characters
        return math.log((n + unseen) / (min(self.evidence.printed.get(c, 0.0) for c in a) + n + 1.0))

    def too_often(self, op: Op, word: str) -> float:
        """How often a word shows a confusion, if that is too often for one; else 0."""
        own = self.evidence.within.get((op, word), 0.0)
        return own if own > max(2.0, RARE[len(word) > 3] * self.evidence.words.get(word, 0)) else 0.0

    def word(self, word: str) -> float:
        return math.log((self.evidence.words.get(word, 0) + 0.5) / self.n_words)

    def beside(self, before: str | None, word: str, after: str | None, pairs: dict[tuple[str, str], int]) -> float:
        """How much likelier the words beside make a word, as a log. Words the lexicon hasn't say nothing."""
        out = 0.0
        for x, y in ((before, word), (word, after)):
            if x and y and x in self.known and y in self.known:
                p = math.exp(self.word(y))
                out += math.log((pairs.get((x, y), 0) + NEIGHBOURS * p) / (self.behind.get(x, 0) + NEIGHBOURS) / p)
        return out

    # ---- Latin tokens

    def candidates(self, token: str) -> set[str]:
        """All words of the index that share something with the token when each leaves out up to two characters, a longer token
        three: one of its confusions may have made two characters of one."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in deletes(token, 3 if len(token) >= 7 else 2)), np.uint64)
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        return {self.latin[k] for a, b in zip(lo, hi) if b > a for k in self.ids[a:b].tolist()}

    def forms(self, token: str) -> set[str] | None:
        """What of a token may be a word: without the marks at its ends, or with them. None if it is a word, or can't be one."""
        got = {token, token.lower()}
        if not token.isascii():
            got = {_clean(x) for x in got} | {_clean(_clean(token).lower())}  # capitals look like other letters than small ones do
        got = {y for x in got for y in (x, x.strip(_EDGE), x.rstrip(_EDGE), x.lstrip(_EDGE))}
        if got & self.known or {x.lower() for x in got} & self.known:
            return None
        low = {x.lower() for x in got}
        return {x for x in low if self.least <= len(x) <= self.longest + 2 and 2 * sum(map(str.isalpha, x)) >= len(x)}

    def token(self, token: str) -> tuple[tuple[float, str], ...]:
        """(log odds against a new word, word) of what a token may be misread from, the best first; none if it is a word."""
        got = self.cache.get(token)
        if got is not None:
            return got
        best: dict[str, float] = {}
        for x in (_LATIN.search(token) and self.forms(token)) or ():
            new = self.log_unknown + self.letters(x)
            for w in self.candidates(x):
                most = 1 if len(w) < 6 else 2
                for ops in explanations(w, x, most):
                    if not all(map(_plausible, ops)) or w.upper() == x.upper():
                        continue
                    odds = self.word(w) + sum(self.op(op, w) for op in ops) + BURST * (len(ops) - 1) - new
                    if odds > best.get(w, -REACH):
                        best[w] = odds
        return self._keep(token, tuple((s, w) for w, s in sorted(best.items(), key=lambda f: (-f[1], f[0]))))

    def options(self, token: str) -> tuple[tuple[float, str], ...]:
        """(log odds against a new word, word) of what a token, or a window of text without blanks, may be misread from."""
        return tuple((s, w) for s, a, b, w, _ in self.gap(token) if b - a == len(token)) if _JA_RUN.match(token) else self.token(token)

    def correct(self, token: str, before: str | None, after: str | None, pairs: dict[tuple[str, str], int] | None = None) -> str | None:
        """The likeliest repair of a token between its neighbours, if it is likelier than a new word. ``pairs``: counts of these
        neighbours, if the evidence hasn't any."""
        got = self.options(token)
        if not got:
            return None
        before, after = (before or "").lower(), (after or "").lower()
        pairs = self.evidence.pairs if pairs is None else pairs
        s, w = max(((s + self.beside(before, w, after, pairs), w) for s, w in got), key=lambda f: (f[0], [-ord(c) for c in f[1]]))
        return w if s > MARGIN else None

    def choice(self, token: str, before: str | None, after: str | None) -> tuple[str | None, str | None]:
        """(repair, None); or (None, what must be known for it), if that hangs on neighbours whose counts are elsewhere."""
        if self.evidence.waits and self.options(token):
            beside = [x if x in self.known else "" for x in ((before or "").lower(), (after or "").lower())]
            if any(beside):
                return None, json.dumps([token, *beside], ensure_ascii=False)
        return self.correct(token, before, after), None

    def asked(self, key: str) -> set[str]:
        """The neighbours whose counts an open repair needs, by their keys."""
        token, before, after = json.loads(key)
        return {x + "\0" + y for _, w in self.options(token) for x, y in ((before, w), (w, after)) if x and y}

    def answer(self, key: str, counts: dict[str, int]) -> str | None:
        """The repair that was open, by the counts of neighbours."""
        return self.correct(*json.loads(key), {tuple(k.split("\0")): n for k, n in counts.items()})

    def is_word(self, token: str) -> str | None:
        """The lexicon's word that a token is."""
        return self.heard[token]

    def sets(self, token: str) -> tuple[tuple[Op, str], ...]:
        """The confusions, and the words they are in, one of which explains a token, for the learning; longer words only, which
        are seldom near by chance."""
        key = (token,)
        got = self.cache.get(key)
        if got is None:
            found = {(ops[0], w) for x in self.forms(token) or () if len(x) >= 6 for w in self.candidates(x) for ops in explanations(w, x, 1) if ops and _plausible(ops[0])}
            got = self._keep(key, tuple(sorted(found)) if len(found) <= 4 else ())
        return got

    # ---- text without blanks

    def gap(self, text: str) -> tuple[tuple[float, int, int, str, Op], ...]:
        """(log odds, start, end, word, confusion) of misread words in text that holds no whole word; the longest first, and
        none that overlaps a longer one."""
        got = self.cache.get(text)
        if got is None:
            found = []
            n = len(text)
            for size, table in self.windows.items():
                for s in range(n - size + 1):
                    w = text[s : s + size]
                    if w in self.known:
                        continue
                    for i in range(size):
                        for word, _ in table.get(w[:i] + "\0" + w[i + 1 :], ()):
                            op = (word[i], w[i])
                            if _same_script(*op) and not _cut(text, s, s + size):
                                new = sum(math.log((self.evidence.loose.get(c, 0) + 0.01) / self.n_loose) for c in w)
                                if other := self.too_often(op, word):
                                    new = max(new, math.log(other / self.n_loose))
                                found.append((self.word(word) + self.op(op, word) - new, s, s + size, word, op))
            found.sort(key=lambda f: (f[1] - f[2], -f[0], f[1], f[3]))
            kept: list = []
            for f in found:
                if all(f[2] <= x[1] or f[1] >= x[2] or (f[1], f[2]) == (x[1], x[2]) for x in kept):
                    kept.append(f)
            got = self._keep(text, tuple(kept))
        return got


def latin_words(words: Iterable[str], least: int = 4) -> list[str]:
    return [w for w in words if len(w) >= least and not _JA_RUN.search(w)]


def _plausible(op: Op) -> bool:
    """Whether a confusion is one of shapes: Latin letters for Latin signs, not for hyphens or what only looks the same."""
    same = lookalikes()
    return all(ord(c) < 0x250 and c not in HYPHENS for c in op[0] + op[1]) and "".join(same.get(c, c) for c in op[0]) != "".join(same.get(c, c) for c in op[1])


def _same_script(a: str, b: str) -> bool:
    """Kanji for kanji or katakana for katakana, which do not only look the same."""
    kind = lambda c: 1 if "ァ" <= c <= "ヶ" else 2 if "一" <= c <= "鿿" else 0
    return a != b and kind(a) != 0 and kind(a) == kind(b) and lookalikes().get(a, a) != lookalikes().get(b, b)


def _both_kana(a: str, b: str) -> bool:
    return "ァ" <= a <= "ー" and "ァ" <= lookalikes().get(b, b) <= "ー"


def _cut(flat: str, a: int, b: int) -> bool:
    """Whether a window is part of more: beside marks that combine or can't be seen, or of a longer run of katakana."""
    before, after = flat[a - 1 : a] if a else "", flat[b : b + 1]
    return any(c and (unicodedata.combining(c) or unicodedata.category(c) == "Cf") for c in (before, after)) or bool(before and _both_kana(before, flat[a])) or bool(after and _both_kana(after, flat[b - 1]))


class _Odd(dict):
    """What look-alikes of Latin letters, and characters that can't be seen, stand for, by number; made as they are met."""

    def __missing__(self, n: int) -> int | str:
        ch = chr(n)
        to = _mapped(ch) if n > 127 and (n == 0xAD or ch not in HYPHENS) else ch
        self[n] = to if to == "" or to.isascii() else n
        return self[n]


_odd_map = _Odd()


def _clean(token: str) -> str:
    """Look-alike letters put right, invisible characters left out."""
    if token.isascii():
        return token
    return token.translate(_odd_map)


# ---- one text


def line_parts(text: str) -> list[str]:
    return re.split(r"\r\n?|\n", text)


def scan(index: Index, text: str, whole_cell: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, repair) of hyphens and misreadings in a text, by an index that has the counts of neighbours."""
    return [f[:4] for f in places(index, text, whole_cell)]


def places(index: Index, text: str, whole_cell: bool = False) -> list[Place]:
    """Hyphens and misreadings in a text."""
    out: list[Place] = []
    if not text:
        return out
    if whole_cell and len(text) >= 4 and text[:1] not in "Q" and _NUMBERISH.fullmatch(text):
        fixed = "".join(DIGIT_PAIRS.get(c, c) for c in text)
        if fixed != text and _NUMBER.fullmatch(fixed) and sum(c.isdigit() for c in text) * 2 >= sum(c.isdigit() for c in fixed):
            return [("misread", 0, len(text), fixed, None)]
    skip: list[tuple[int, int]] = []
    multi = "\n" in text or "\r" in text
    if multi and _BROKEN.search(text):
        for m in _BREAK.finditer(text):
            left, right = m.group(1), m.group(2)
            skip.append(m.span())
            word = _clean((left + right).lower())
            own = _clean((left + "-" + right).lower())
            if own in index.known:
                continue
            fixed, key = word, None
            if word not in index.known and word.strip(_EDGE) not in index.known:
                fixed, key = index.choice(word, *_beside(text, m)) if len(word) >= index.least + 2 else (None, None)
            if fixed or key:
                out.append(("hyphen", m.start(), m.end(), left + right, key))
    if not text.isascii() and index.any_ja and _JA_RUN.search(text):
        out += _scan_ja(index, text, multi)
        if not re.search("[A-Za-zÀ-ÿ]{2}", text):
            return out
    if not any(map(index.token, _TOKEN.findall(text))):
        return out
    tokens = list(_TOKEN.finditer(text))
    for k, m in enumerate(tokens):
        if index.token(m.group()) and not any(a < m.end() and m.start() < b for a, b in skip):
            before = tokens[k - 1].group().strip(_EDGE) if k else None
            after = tokens[k + 1].group().strip(_EDGE) if k + 1 < len(tokens) else None
            fixed, key = index.choice(m.group(), before, after)
            if fixed or key:
                out.append(("misread", m.start(), m.end(), fixed, key))
    return out


def _beside(text: str, m: re.Match) -> tuple[str | None, str | None]:
    """The tokens before and after a match."""
    before, after = _TOKEN.findall(text[max(0, m.start() - 80) : m.start()]), _TOKEN.search(text, m.end(), m.end() + 80)
    return before[-1].strip(_EDGE) if before else None, after.group().strip(_EDGE) if after else None


def _ja_parts(index: Index, text: str, multi: bool) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, str | None, str | None]]]:
    """Text without line ends, the spans of whole words in it, and what is between them: (start, end, word before, word
    behind)."""
    # line ends inside a word are passed over
    flat = text.replace("\r", "").replace("\n", "") if multi else text
    spans = [(e - size + 1, e + 1) for e, size in index.automaton.iter_long(flat)]
    gaps, end, last = [], 0, None
    for s, e in [*spans, (len(flat), len(flat))]:
        if s - end >= index.least_ja:
            gaps.append((end, s, last, flat[s:e] or None))
        end, last = e, flat[s:e]
    return flat, spans, gaps


def _ja_runs(index: Index, flat: str, gaps: list) -> Iterator[tuple[int, str, str | None, str | None]]:
    for a, b, before, after in gaps:
        for run in re.finditer(f"[{_JA}]{{{index.least_ja},}}", flat[a:b]):
            yield a + run.start(), run.group(), before, after


def _scan_ja(index: Index, text: str, multi: bool) -> list[Place]:
    flat, _, gaps = _ja_parts(index, text, multi)
    out, at = [], None
    for start, run, before, after in _ja_runs(index, flat, gaps):
        for a, b in dict.fromkeys(f[1:3] for f in index.gap(run)):
            if multi and at is None:
                at = [k for k, c in enumerate(text) if c not in "\r\n"]
            p, q = start + a, start + b
            if _cut(text, at[p] if at else p, (at[q - 1] if at else q - 1) + 1):
                continue
            fixed, key = index.choice(run[a:b], before, after)
            if fixed or key:
                out.append(("misread", at[p] if at else p, (at[q - 1] if at else q - 1) + 1, fixed, key))
    return out


def repair(index: Index, text: str, whole_cell: bool = False) -> str:
    """The text with all its noise repaired, and its lines joined to paragraphs."""
    return mend(text, scan(index, text, whole_cell))


def mend(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """The text with its noise, as from :func:`scan`, repaired, and its lines joined to paragraphs."""
    done = text
    for kind, a, b, fixed in sorted(found, key=lambda f: -f[1]):
        seen = done[a:b]
        if kind == "hyphen":  # the word stays on its line, and the lines keep about their lengths
            done = done[:a] + fixed + ("\n" if done[b : b + 1].strip("\r\n") else "") + done[b:]
            continue
        edge_l, edge_r = len(seen) - len(seen.lstrip(_EDGE)), len(seen) - len(seen.rstrip(_EDGE))
        core = seen[edge_l : len(seen) - edge_r] if edge_l + edge_r < len(seen) else seen
        fixed = fixed.upper() if core.isupper() and len(core) > 1 and fixed.islower() else fixed[:1].upper() + fixed[1:] if core[:1].isupper() else fixed
        done = done[:a] + seen[:edge_l] * (fixed[:1] != seen[:1]) + fixed + (seen[len(seen) - edge_r :] if edge_r and not fixed.endswith(seen[-1]) else "") + done[b:]
    return paragraphs(done)


_SENTENCE = re.compile(r"[.!?。！？:：][)\]」』”\"]?\s*$")
_OWN_LINE = re.compile(r"^\s*(?:[-*•・□○●◆|#]|\(?[0-9a-zA-Z]{1,3}[.)]\s|[0-9]+\.[0-9])|\t|   ")


def paragraphs(text: str) -> str:
    """Lines that go on in the next line joined: without a blank between Japanese characters, with one elsewhere."""
    lines, out = line_parts(text), ""
    widest = max(map(len, lines), default=0)
    for k, line in enumerate(lines):
        if not k:
            out = line
            continue
        last = lines[k - 1]
        if not line.strip() or not last.strip() or _OWN_LINE.search(line) or _OWN_LINE.search(last):
            out += "\n" + line
        elif re.search(rf"[^\W\d_][{HYPHENS}]\s*$", last) and _LATIN.match(line.lstrip()) or line.lstrip()[0] in ".,;:!?)":
            out = out.rstrip() + line.lstrip()  # a hyphen of the word's own, or the rest of a mended word's sentence
        elif _SENTENCE.search(last) and len(last) < 0.8 * widest or len(last) < 0.5 * widest:
            out += "\n" + line
        elif _JA_RUN.match(last.rstrip()[-1]) or last.rstrip()[-1] in "、。）」％" or _JA_RUN.match(line.lstrip()[0]) and not last.rstrip()[-1].isascii():
            out = out.rstrip() + line.lstrip()
        else:
            out = out.rstrip() + " " + line.lstrip()
    return out


# ---- pages


@dataclass(frozen=True)
class Margins:
    """Places on a page: lines that begin above ``low`` or below ``high`` are running lines. The values without evidence are
    those of a page of about 3508 dots."""

    low: int = 298
    high: int = 3262

    @property
    def pitch(self) -> float:
        return 0.02 * (self.low + self.high)


#: Dots of one step in which places are counted, and lines that must come again before they say where margins are.
STEP, LEAST_REPEATS = 16, 20


def learned_margins(pages: DataFrame) -> Margins:
    """The margins of a corpus, from its first and last lines: those that come again on other pages of their folder, but for the
    page's own number and blanks, are running lines; of all cuts the one is taken that parts them best from those that don't.
    Lines of nothing but other numbers say nothing by coming again.

    Lines are counted by folder, form and place, so that a hot folder is combined before it is shuffled; the driver gets one row
    per step of place.
    """
    there = F.filter(F.arrays_zip("lines", "tops"), lambda x: x["lines"].isNotNull())
    ends = F.array(F.struct(F.lit(0).alias("end"), F.get(there, F.lit(0)).alias("x")), F.struct(F.lit(1).alias("end"), F.try_element_at(there, F.lit(-1)).alias("x")))
    lines = pages.where("lines is not null").select("doc_id", "page", F.explode(ends).alias("e")).select("doc_id", "page", "e.end", F.col("e.x.lines").alias("text"), F.col("e.x.tops").alias("y")).where("y is not null")
    own = F.concat(F.lit("(?<![0-9])"), F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit("(?![0-9])"))
    lines = lines.withColumn("text", F.regexp_replace(F.regexp_replace("text", own, F.lit("#")), F.lit(r"\s+"), F.lit("")))
    key = [F.coalesce("doc_id", F.lit("")).alias("d"), "end", F.xxhash64("text").alias("form"), F.col("text").rlike(r"[#\p{L}]").alias("tells")]
    per = lines.groupBy(*key, F.floor(F.col("y") / STEP).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b"))
    again = F.col("tells") & (F.sum("n").over(Window.partitionBy("d", "end", "form")) > 1)
    by = per.withColumn("again", again).groupBy("end", "k").agg(F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("again"), F.sum(F.when(F.col("again"), 0).otherwise(F.col("n"))).alias("once"), F.min("a").alias("a"), F.max("b").alias("b"))
    rows = by.collect()
    out = {}
    for end, sign in ((0, 1), (1, -1)):
        mine = sorted((r for r in rows if r.end == end), key=lambda r: sign * r.k)
        if sum(r.again for r in mine) < LEAST_REPEATS:
            continue
        # errors of a cut behind the first m steps: single lines before it that are no margin's, repeated ones behind it
        total = sum(r.again for r in mine)
        cost, seen, best = 0, 0, (total, 0)
        for m, r in enumerate(mine, 1):
            seen += r.again
            cost += r.once * 0.5
            best = min(best, (cost + total - seen, m))
        m = best[1]
        if 0 < m:
            inner = mine[m - 1].b if end == 0 else mine[m - 1].a
            outer = None if m == len(mine) else mine[m].a if end == 0 else mine[m].b
            out[end] = (inner, outer)
    m = Margins()
    cut = lambda pair, sign: pair[0] + sign * STEP if pair[1] is None else (pair[0] + pair[1]) // 2
    return Margins(cut(out[0], 1) if 0 in out else m.low, cut(out[1], -1) if 1 in out else m.high)


def _is_page_number(text: str, page: int | None) -> bool:
    m = re.fullmatch(r"\W*(?:p(?:age|\.)?)?\W*(\d{1,5})(?:\s*/\s*\d{1,5})?\W*", text.strip(), re.I)
    return bool(m) and page is not None and int(m.group(1)) == page


def running_lines(lines: list[str | None], tops: list[int | None], page: int | None, margins: Margins) -> set[int]:
    """Positions of running lines.

    A first line whose place is unknown runs if the next lines leave no room for it below the upper margin; a last
    one if it says the page's number.
    """
    lo, hi = margins.low, margins.high
    there = [k for k, t in enumerate(lines) if t is not None]
    out = {k for k in there if tops[k] is not None and not lo <= tops[k] <= hi}
    if there and tops[there[-1]] is None and _is_page_number(lines[there[-1]], page):
        out.add(there[-1])
    if there and tops[there[0]] is None:
        known = [(n, tops[k]) for n, k in enumerate(there) if tops[k] is not None and k not in out]
        if known:
            n, y = known[0]
            pitch = (known[1][1] - y) / (known[1][0] - n) if len(known) > 1 and known[1][1] > y else margins.pitch
            if y - n * pitch < lo:
                out.add(there[0])
    return out


def scan_page(index: Index, lines: list[str | None], tops: list[int | None], page: int | None, margins: Margins) -> list[tuple[int, str, str, str | None, str | None]]:
    """(position, kind, what is there, repair, what must be known for it) of a page's noise."""
    running = running_lines(lines, tops, page, margins)
    out = [(k, "running", lines[k], "", None) for k in sorted(running)]
    body = [k for k, t in enumerate(lines) if t is not None and k not in running]
    for group in ([body] if body else []) + [[k] for k in sorted(running)]:
        text, starts = "", []
        for k in group:
            starts.append(len(text))
            text += re.sub(r"[\r\n]+", " ", lines[k]) + "\n"
        place = np.array(starts)
        for kind, a, b, fixed, key in places(index, text[:-1]):
            # where a hyphen breaks a word; where the misread word begins
            out.append((group[int(np.searchsorted(place, a, side="right")) - 1], kind, text[a:b], fixed, key))
    return out


def body_text(lines: list[str | None], tops: list[int | None], page: int | None, margins: Margins) -> str:
    """The page's text without running lines."""
    running = running_lines(lines, tops, page, margins)
    return "\n".join(re.sub(r"[\r\n]+", " ", t) for k, t in enumerate(lines) if t is not None and k not in running)


def repair_page(index: Index, lines: list[str | None], tops: list[int | None], page: int | None, margins: Margins) -> str:
    """The page's text without running lines, repaired, in paragraphs."""
    return repair(index, body_text(lines, tops, page, margins))


def page_lines(pages: DataFrame) -> DataFrame:
    """(row_id, doc_id, page, lines, tops) of the recognized pages."""
    y = lambda d: F.coalesce(F.get(d["box"], F.lit(1)), F.array_min(F.transform(F.filter(d["points"], lambda p: p.isNotNull()), lambda p: F.get(p, F.lit(1)))))
    return pages.where("detections is not null").select(
        F.col("layout_id").alias("row_id"), "doc_id", "page", F.transform("detections", lambda d: d["content"]).alias("lines"), F.transform("detections", y).alias("tops")
    )


# ---- the corpus


def lexicon_words(lexicon: DataFrame) -> list[str]:
    words = [r.word for r in lexicon.where("word is not null and word <> ''").select("word").distinct().limit(MAX_LEXICON + 1).collect()]
    if len(words) > MAX_LEXICON:
        raise ValueError(f"more than {MAX_LEXICON} words; give a smaller lexicon")
    return words


def tally(index: Index, texts: Iterable[str]) -> Counter:
    """(what, key) to count: words, neighbours, sets of confusions, characters outside words, known and unknown tokens."""
    out: Counter = Counter()
    seen: Counter = Counter()
    pairs: Counter = Counter()
    for t, times in Counter(t for t in texts if t).items():
        if times > 1:  # short texts come again and again
            for key, n in tally(index, [t]).items():
                out[key] += n * times
            continue
        multi = "\n" in t or "\r" in t
        if index.any_ja and not t.isascii() and _JA_RUN.search(t):
            flat, spans, gaps = _ja_parts(index, t, multi)
            words = [flat[a:b] for a, b in spans]
            out.update(("w", w) for w in words)
            out.update(("p", a + "\0" + b) for a, b in zip(words, words[1:]))
            for _, run, _, _ in _ja_runs(index, flat, gaps):
                out.update(("l", c) for c in run)
                sets: dict[tuple[int, int], set[tuple[Op, str]]] = defaultdict(set)
                for _, a, b, w, op in index.gap(run):
                    sets[a, b].add((op, w))
                out.update(("o", _key(ops)) for ops in sets.values())
            if not _LATIN_TEXT.search(t):
                continue
        tokens = _TOKEN.findall(_BREAK.sub(" ", t) if multi and _BROKEN.search(t) else t)
        seen.update(tokens)
        words = list(map(index.is_word, tokens))
        pairs.update(zip(words, words[1:]))
    for x, n in seen.items():
        if low := index.is_word(x):
            out["w", low] += n
        elif len(core := x.strip(_EDGE)) >= index.least and _LATIN.search(core):
            out["u", ""] += n
            if ops := index.sets(x):
                out["o", _key(ops)] += n
    for (a, b), n in pairs.items():
        if a and b:
            out["p", a + "\0" + b] += n
    return out


def _key(found: Iterable[tuple[Op, str]]) -> str:
    return "\1".join("\0".join((*op, w)) for op, w in sorted(found))


def shares(sets: dict[str, int], rounds: int = 20) -> tuple[dict[Op, float], dict[tuple[Op, str], float]]:
    """How often each confusion occurred, in all and in each word, from counts of sets of which one holds:
    expectation-maximization."""
    rows = [([((a, b), w) for a, b, w in (x.split("\0") for x in k.split("\1"))], n) for k, n in sets.items()]
    count: dict[Op, float] = {op: 1.0 for found, _ in rows for op, _ in found}
    within: dict[tuple[Op, str], float] = {}
    for _ in range(rounds):
        new: dict[Op, float] = defaultdict(float)
        within = defaultdict(float)
        for found, n in rows:
            total = sum(count[op] for op, _ in found) or 1.0
            for op, w in found:
                new[op] += n * count[op] / total
                within[op, w] += n * count[op] / total
        count = new
    return dict(count), dict(within)


def learned(texts: DataFrame, words: list[str]) -> Evidence:
    """What all of ``texts`` (a column of strings) say about the words of a lexicon, all neighbours among it."""
    return _evidence(_tallied(texts, words), True)


def _tallied(texts: DataFrame, words: list[str]) -> DataFrame:
    """(what, key, n): :func:`tally` of all of ``texts``."""
    shared = _share(texts, words, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            what, key = zip(*total) if total else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(key, pa.string()), pa.array(list(total.values()), pa.int64())], names=["what", "key", "n"])

        for b in batches:
            total.update(tally(index, b.column(0).to_pylist()))
            if len(total) > 500_000:
                yield flush()
                total.clear()
        yield flush()

    return materialize(texts.mapInArrow(run, "what string, key string, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n")), "tally")


def _evidence(counts: DataFrame, with_pairs: bool) -> Evidence:
    """What the counts say; without those of neighbours, how often words stand before another."""
    if not with_pairs:
        behind = counts.where("what = 'p'").groupBy(F.lit("b").alias("what"), F.substring_index("key", "\0", 1).alias("key")).agg(F.sum("n").alias("n"))
        counts = counts.where("what <> 'p'").unionByName(behind)
    got: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.toLocalIterator():
        got[r.what][r.key] = r.n
    printed: Counter = Counter()
    for w, n in got["w"].items():
        for c in w:
            printed[c] += n
    latin = sum(n for w, n in got["w"].items() if not _JA_RUN.search(w))
    unknown = sum(got["u"].values())
    pairs = {tuple(k.split("\0")): n for k, n in got["p"].items()}
    return Evidence(*shares(got["o"]), dict(printed), got["w"], pairs, got["l"], (unknown + 1) / (unknown + latin + 10), got["b"], not with_pairs)


class _Shared:
    """What is broadcast; a worker makes its index once, however many tasks it runs."""

    def __init__(self, words: list[str], evidence: Evidence | None) -> None:
        self.words, self.evidence = sorted({w.lower() for w in words if w}), evidence
        self.table = table_of(latin_words(self.words))
        self.made: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}


def _share(df: DataFrame, words: list[str], evidence: Evidence | None) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(_Shared(words, evidence))


def _index(shared: Broadcast) -> Index:
    s = shared.value
    if s.made is None:
        s.made = Index(s.words, s.evidence, s.table)
    return s.made


def _learn(pages: DataFrame, texts: DataFrame, lexicon: DataFrame, margins: Margins | None) -> tuple[Broadcast, Margins, DataFrame | None]:
    """What is broadcast, the margins, and the counts of neighbours if they are too many for that: (pair, n)."""
    words = lexicon_words(lexicon)
    every = pages.select(F.array_join("lines", "\n").alias("t")).unionByName(texts.select(F.col("text").alias("t")))
    counts = _tallied(every.where("t is not null and t <> ''"), words)
    pairs = counts.where("what = 'p'").select(F.col("key").alias("pair"), "n")
    few = pairs.count() <= MAX_PAIRS
    return _share(pages, words, _evidence(counts, few)), margins or learned_margins(pages), None if few else pairs


def _answered(keys: DataFrame, shared: Broadcast, pairs: DataFrame) -> DataFrame:
    """(key, word) of the open repairs (a column of keys) that hold."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for b in batches:
            rows = [(k, x) for k in b.column(0).to_pylist() for x in sorted(index.asked(k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["key", "pair"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for b in batches:
            keys = b.column(0).to_pylist()
            words = [index.answer(k, {f["pair"]: f["n"] for f in found if f["n"] is not None}) for k, found in zip(keys, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string())], names=["key", "word"])

    asked = keys.distinct().mapInArrow(ask, "key string, pair string").join(pairs, "pair", "left")
    return asked.groupBy("key").agg(F.collect_list(F.struct("pair", "n")).alias("found")).mapInArrow(answer, "key string, word string").where("word is not null")


def noise(pages: DataFrame, texts: DataFrame, lexicon: DataFrame, margins: Margins | None = None) -> DataFrame:
    """(src, row_id, pos, kind, found, repair). ``texts``: (src, row_id, text, whole_cell); ``pages``: as from :func:`page_lines`."""
    shared, where, pairs = _learn(pages, texts, lexicon, margins)

    def on_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for b in batches:
            src, row, text, cell = (b.column(k).to_pylist() for k in range(4))
            yield _rows([(s, r, 0, kind, t[x:y], fixed, key) for s, r, t, c in zip(src, row, text, cell) for kind, x, y, fixed, key in index.again(t, c)])

    def on_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for b in batches:
            row, page, lines, tops = (b.column(k).to_pylist() for k in range(4))
            yield _rows([("layout_json", r, *f) for r, p, t, y in zip(row, page, lines, tops) for f in scan_page(index, t, y, p, where)])

    ddl = "src string, row_id bigint, pos int, kind string, found string, repair string, key string"
    found = pages.select("row_id", "page", "lines", "tops").mapInArrow(on_pages, ddl)
    plain = texts.where("text is not null and text <> ''").select("src", "row_id", "text", "whole_cell").mapInArrow(on_texts, ddl)
    every = found.unionByName(plain)
    if pairs is None:
        return every.drop("key")
    every = materialize(every, "places")
    held = every.where("key is not null").join(_answered(every.where("key is not null").select("key"), shared, pairs), "key")
    return every.where("key is null").drop("key").unionByName(held.withColumn("repair", F.coalesce("repair", "word")).drop("key", "word"))


def readable(pages: DataFrame, texts: DataFrame, lexicon: DataFrame, margins: Margins | None = None) -> DataFrame:
    """(src, row_id, text) of all pages and texts, without noise. Null texts stay null, pages without lines are empty."""
    shared, where, pairs = _learn(pages, texts, lexicon, margins)

    def mended(src: list, row: list, text: list, cell: list) -> pa.RecordBatch:
        """Texts that are settled, mended; others as they are, with what was found in them."""
        index = _index(shared)
        found = [index.again(t, c) if t else () for t, c in zip(text, cell)]
        noted: list = [None] * len(text)
        for k, fs in enumerate(found):
            if any(f[4] for f in fs):
                noted[k] = [dict(zip(("kind", "start", "end", "repair", "key"), f)) for f in fs]
            elif fs or text[k] and ("\n" in text[k] or "\r" in text[k]):  # one line without noise stays as it is
                text[k] = mend(text[k], [f[:4] for f in fs])
        return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(row, pa.int64()), pa.array(text, pa.string()), pa.array(noted, _FOUND)], names=["src", "row_id", "text", "found"])

    def on_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield mended(*(b.column(k).to_pylist() for k in range(4)))

    def on_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, page, lines, tops = (b.column(k).to_pylist() for k in range(4))
            yield mended(["layout_json"] * len(row), row, [body_text(t, y, p, where) for p, t, y in zip(page, lines, tops)], [False] * len(row))

    ddl = "src string, row_id bigint, text string, found array<struct<kind: string, start: int, end: int, repair: string, key: string>>"
    every = pages.select("row_id", "page", "lines", "tops").mapInArrow(on_pages, ddl).unionByName(texts.select("src", "row_id", "text", "whole_cell").mapInArrow(on_texts, ddl))
    if pairs is None:
        return every.drop("found")

    def on_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, row, text, found, words = (b.column(k).to_pylist() for k in range(5))
            done = []
            for t, fs, ws in zip(text, found, words):
                got = {w["key"]: w["word"] for w in ws or ()}
                done.append(mend(t, [(f["kind"], f["start"], f["end"], f["repair"] or got[f["key"]]) for f in fs if f["key"] is None or f["key"] in got]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(row, pa.int64()), pa.array(done, pa.string())], names=["src", "row_id", "text"])

    # what is open in a text follows from the text, so equal texts are asked for once
    every = materialize(every.withColumn("text_md5", F.when(F.col("found").isNotNull(), F.md5("text"))), "places")
    wanted = every.where("found is not null").select("text_md5", F.explode("found.key").alias("key")).where("key is not null").distinct()
    words = wanted.join(_answered(wanted.select("key"), shared, pairs), "key").groupBy("text_md5").agg(F.collect_list(F.struct("key", "word")).alias("words"))
    opened = every.where("found is not null").join(words, "text_md5", "left").select("src", "row_id", "text", "found", "words")
    return every.where("found is null").select("src", "row_id", "text").unionByName(opened.mapInArrow(on_open, "src string, row_id bigint, text string"))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("repair", pa.string()), ("key", pa.string())]))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    types = (pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["src", "row_id", "pos", "kind", "found", "repair", "key"])
