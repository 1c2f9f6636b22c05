"""Problem 8: text that went through a wrong character encoding.

Damage inside words of Latin script is the cipher of a substitution: each unit of one to four characters that should not be
there stands for one letter (UTF-8 shown in a one-byte code page makes several characters of a letter, one code page shown in
another makes one). Nothing is assumed about the code pages. Per source (starting from what all sources show), the letter behind each unit, and where one unit ends
and the next begins, are learned by expectation-maximization: the posterior of the letters of a run, given the letters
around it, is the product of the units' learned shares and the letter bigrams of the sound documents. What is learned is
applied as a translation of units; a word counts if the result is a word of the lexicon or reads like one by the bigrams.

What learning letter by letter can't restore is left to an exit, which is counted: Japanese text (thousands of letters, of which
one document shows few), signs, and damage of which a source has too little. There, known code pages are turned back: what was
shown becomes the bytes it must have come from, run by run, and these are read as the encoding that was meant, as often as it
takes. A reading counts only if it is valid and consists of plausible letters in plausible places, while what was shown
does not. Text of which bytes were lost (replacement characters), or with several words that hold what no word can and that nothing explains, is reported, too, but cannot be
restored.

Results for odd input:
  * null, empty and blank texts are not affected;
  * a short sample in quotation marks in otherwise sound text, a chart of single characters, and plain junk are no case;
  * text that is sound in one part and garbled in another is affected, and only the garbled part is changed;
  * repeated rows count once if they have one id; a null source is a source like others; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_or_not

# Encodings in which text is shown by mistake, one byte a character, and several.
SINGLE = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r", "cp866", "iso8859-15")
DOUBLE = ("cp932", "gbk", "euc_jp", "big5")
# Letters of the languages beyond ASCII, and signs that sound text has.
LETTERS = "àâäæçéèêëîïôöœùûüÿßÀÂÄÆÇÉÈÊËÎÏÔÖŒÙÛÜ"
QUOTES = "“”‘’„‚«»‹›"
SIGNS = "–—…•·×÷±°µ²³§€£©®™½¼¾√∑≒≈≠≤≥→←↑↓∞∂∆∫"
JAPANESE_SIGNS = "　、。・「」『』（）［］【】〈〉《》〔〕％＆／：；！？＋－＝＜＞｜～〜々〆ー○●◎□■△▲▽▼◇◆☆★※→←↑↓①②③④⑤⑥⑦⑧⑨⑩"
#: A sample shown on purpose is at most so long.
SAMPLE = 12
MAX_LEXICON = 500_000


@lru_cache(maxsize=1)
def kanji() -> frozenset[str]:
    """Kanji of the first level of JIS X 0208: by its rows in EUC."""
    out = set()
    for hi in range(0xB0, 0xD0):
        for lo in range(0xA1, 0xFF):
            try:
                out.add(bytes((hi, lo)).decode("euc_jp"))
            except UnicodeDecodeError:
                continue
    return frozenset(out)


@lru_cache(maxsize=1)
def sound() -> frozenset[str]:
    """Characters of sound text."""
    kana = {chr(n) for n in (*range(0x3041, 0x3097), *range(0x3099, 0x30FF))}
    wide = {chr(n) for n in (*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0))}
    ascii_ = {chr(n) for n in (9, 10, 12, 13, *range(32, 127))}
    return frozenset(ascii_ | kana | wide | kanji() | set(LETTERS + QUOTES + SIGNS + JAPANESE_SIGNS + "\xa0­​‌‍‎⁠﻿"))


def _class(chars: Iterable[str]) -> str:
    ranges: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges)


@lru_cache(maxsize=None)
def table(codec: str) -> dict[str, int]:
    """Character -> byte of the upper half of a one-byte code page; undefined bytes are the control characters."""
    out = {}
    for n in range(0x80, 0x100):
        try:
            ch = bytes((n,)).decode(codec)
        except UnicodeDecodeError:
            ch = chr(n)
        out[ch] = n
    if codec == "cp1252":  # what is shown as Latin-1 has the controls themselves
        for n in range(0x80, 0xA0):
            out.setdefault(chr(n), n)
    return out


@lru_cache(maxsize=None)
def _runs(codec: str) -> tuple[re.Pattern, re.Pattern, dict[int, int]]:
    """Runs of upper characters, runs that also have ASCII, and the translation to bytes."""
    t = table(codec)
    hi = _class(t)
    return re.compile(f"[{hi}]+"), re.compile(f"[ -~]*[{hi}][ -~{hi}]*"), {ord(c): n for c, n in t.items()}


@lru_cache(maxsize=1)
def _foreign() -> re.Pattern:
    """What makes a text worth a closer look: a character that sound text hasn't, or a kanji inside a Latin word."""
    return re.compile(f"[^{_class(sound())}]|{_INSIDE}|{_JIS.pattern}")


#: Characters of sound text in places where sound text has none.
_INSIDE = "(?<=[a-z])[一-鿿](?=[a-z])|(?<=[a-zß-ÿ])[À-ÖØ-Þ](?=[a-zß-ÿ])|(?<=[a-z])[÷“”„‚…](?=[a-z])"
#: Seven-bit Japanese whose escapes were lost or are shown.
_JIS = re.compile(r"\x1b?\$[@B](?:[!-~]{2})+?(?:\x1b?\([BJ]|$)", re.M)


_SAMPLES = re.compile(rf"「[^「」\n]{{1,{SAMPLE}}}」|\"[^\"\n]{{1,{SAMPLE}}}\"|“[^“”\n]{{1,{SAMPLE}}}”|'[^'\n]{{1,{SAMPLE}}}'")
_LOST = re.compile("[�-\x80-\x84\x86-\x9f]")
_WIDE_RUN = re.compile("[　-〿぀-ヿ㄀-㄰一-鿿豈-﫿＀-￯-]+[!-~]?")
_HALF = re.compile("[｡-ﾟ]")
_WORD = re.compile(r"[^\W\d_]")


def _is_japanese(c: str) -> bool:
    return "ぁ" <= c <= "ヿ" or c in kanji()


def _plausible_japanese(x: str) -> bool:
    """Kana and common kanji, some of it kana, and nothing that sound text hasn't."""
    ja = sum(_is_japanese(c) for c in x)
    kana = sum("ぁ" <= c <= "ヺ" for c in x)
    odd = sum(c not in sound() for c in x)
    if re.search("[a-zà-ÿ][一-鿿]|[一-鿿][a-zà-ÿ]", x) and kana == 0:
        return False
    return ja >= 2 and (kana >= 1 or ja >= 3 and odd == 0) and odd <= 0.1 * ja


def _plausible_utf8(x: str) -> bool:
    ok = sound()
    return any(ord(c) > 127 for c in x) and all(c in ok or _HALF.match(c) or unicodedata.category(c) in ("So", "Sm", "Po", "Sc", "No") for c in x)


def _in_place(line: str, at: int, c: str) -> bool:
    """Whether a letter or sign of Latin text stands where it may."""
    before, after = line[at - 1 : at] if at else " ", line[at + 1 : at + 2] or " "
    if c in LETTERS:
        return bool(re.match("[a-zA-Z]", before) or re.match("[a-zA-Z]", after))
    if c in QUOTES:
        return before.isspace() != after.isspace() and bool(_WORD.match(before) or _WORD.match(after) or before.isdigit() or after.isdigit() or after in ".,;:!?)" or before in "(")
    return c in SIGNS and (before in " \t|(" or before.isdigit()) and (after in " \t|)CFmgl.,;" or after.isdigit())


def _back_utf8(line: str) -> str | None:
    """Runs that were UTF-8, shown in a one-byte code page."""
    best = None
    for codec in SINGLE:
        upper, _, to = _runs(codec)
        changed = False

        def sub(m: re.Match) -> str:
            nonlocal changed
            x = m.group()
            if len(x) < 2:
                return x
            try:
                y = x.translate(to).encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                # a neighbour may be sound: the longest valid parts
                y = re.sub(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}", lambda k: b"\0" + k.group() + b"\1", x.translate(to).encode("latin-1"))
                if b"\0" not in y or y.count(b"\0") * 2 < len(re.findall(rb"[\xc2-\xf4]", y)):
                    return x
                back = {n: c for c, n in table(codec).items()}
                parts = re.split(rb"\0([^\1]*)\1", y)
                try:
                    y = "".join(p.decode("utf-8") if k % 2 else "".join(back.get(n, chr(n)) for n in p) for k, p in enumerate(parts))
                except UnicodeDecodeError:
                    return x
            changed = True
            return y

        out = upper.sub(sub, line)
        if changed and out != line and (best is None or _oddness(out) < _oddness(best)):
            best = out
    return best


def _back_jis(m: re.Match) -> str:
    """Pairs of printing characters as the Japanese they stand for; other text, for one a formula between dollar signs, as it is."""
    body = re.sub(r"^\x1b?\$[@B]|\x1b?\([BJ]$", "", m.group())
    try:
        y = bytes(ord(c) | 0x80 for c in body).decode("euc_jp")
    except (UnicodeDecodeError, ValueError):
        return m.group()
    return y if y and sum(map(_is_japanese, y)) * 2 > len(y) else m.group()


def _oddness(x: str) -> int:
    return sum(c not in sound() for c in x)


def _restore_line(line: str) -> tuple[str, bool]:
    """A line as it was meant, and whether it had to be changed."""
    # seven-bit Japanese
    out = _JIS.sub(_back_jis, line)
    if out != line:
        return out, True
    # UTF-8 in one-byte code pages, as often as there is something to turn back; every turn makes the line shorter
    x = line
    while (y := _back_utf8(x)) is not None and len(y) < len(x):
        x = y
        if _plausible_change(line, x):
            return x, True
    # Japanese encodings shown in one-byte code pages
    for codec in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251"):
        _, mixed, to = _runs(codec)
        for meant in ("cp932", "euc_jp"):
            changed = False

            def sub(m: re.Match) -> str:
                nonlocal changed
                s = m.group()
                hi = sum(ord(c) > 127 for c in s)
                if hi < 3:
                    return s
                try:
                    y = s.translate(to).encode("latin-1").decode(meant)
                except (UnicodeDecodeError, UnicodeEncodeError):
                    return s
                if _plausible_japanese(y) and sum(map(bool, _HALF.findall(y))) * 5 <= sum(_is_japanese(c) for c in y):
                    changed = True
                    return y
                return s

            out = mixed.sub(sub, line)
            if changed:
                return out, True
    # code pages of several bytes shown for UTF-8 or EUC
    all_signs = SIGNS + QUOTES + JAPANESE_SIGNS
    for codec in DOUBLE:
        for meant in ("utf-8", "euc_jp") if codec == "cp932" else ("utf-8",):
            changed = False

            def sub(m: re.Match) -> str:
                nonlocal changed
                s = m.group()
                try:
                    y = s.encode(codec).decode(meant)
                except (UnicodeDecodeError, UnicodeEncodeError):
                    return s
                before, after = line[m.start() - 1 : m.start()] if m.start() else "", line[m.end() : m.end() + 1]
                latin = all(c in LETTERS or ord(c) < 128 for c in y) and bool(re.match("[a-zA-Z]", before) or re.match("[a-zA-Z]", after) or re.search("[a-zA-Z]", y))
                signs = meant == "utf-8" and all(c in all_signs or ord(c) < 128 for c in y) and any(c in all_signs for c in y) and (before in ("", " ") and after in ("", " ") or len(y) > 1)
                if latin or signs or (_plausible_japanese(y) if meant == "euc_jp" else _plausible_utf8(y) and any(_is_japanese(c) for c in y) and len(s) >= 2):
                    changed = True
                    return y
                return s

            out = _WIDE_RUN.sub(sub, line)
            if changed:
                return out, True
    # Western text in another one-byte code page
    for codec in ("cp437", "mac_roman", "cp850"):
        upper, _, to = _runs(codec)
        if not any(c in table(codec) and c not in sound() for c in line) and not re.search("[a-zß-ÿ][À-ÖØ-Þ][a-zß-ÿ]|[a-z]÷[a-z]", line):
            continue
        out = upper.sub(lambda m: m.group().translate(to).encode("latin-1").decode("cp1252", "replace"), line)
        spots = [k for k, (a, b) in enumerate(zip(line, out)) if a != b]
        if spots and all(_in_place(out, k, out[k]) for k in spots):
            return out, True
    return line, False


def _plausible_change(line: str, x: str) -> bool:
    """Whether what is new in ``x`` is plausible text: its characters are sound, and fewer of them odd."""
    new = Counter(c for c in x if ord(c) > 127)
    new.subtract(c for c in line if ord(c) > 127)
    fresh = "".join(c * n for c, n in new.items() if n > 0)
    return bool(fresh) and _plausible_utf8(fresh) and _oddness(x) < max(1, _oddness(line)) and not re.search("[ÃÂ][\x80-\xbf]", x)


def restore(text: str) -> tuple[str, int]:
    """Text with all that known code pages explain put right, and the number of affected lines (lost bytes count too)."""
    if not _foreign().search(text) and not _HALF.search(text):
        return text, 0
    out, n = [], 0
    for line in re.split("(\r\n|\n|\r)", text):
        if not (_foreign().search(line) or _HALF.search(line)):
            out.append(line)
            continue
        parts, last = [], 0
        for m in _SAMPLES.finditer(line):
            parts += [(line[last : m.start()], True), (m.group(), not _foreign().search(m.group()) and not _HALF.search(m.group()))]
            last = m.end()
        parts.append((line[last:], True))
        fixed, hit = "", False
        if any(not free for _, free in parts):  # samples stay, what is around them may still be garbled
            for s, free in parts:
                y, changed = _restore_line(s) if free and s else (s, False)
                fixed += y
                hit |= changed or free and bool(_LOST.search(s))
        else:
            fixed, hit = _restore_line(line)
            hit |= bool(_LOST.search(line))
        out.append(fixed)
        n += hit
    return "".join(out), n


# ---- unknown code pages

_TOKEN = re.compile(r"[^\s\x00-\x40\[-`{-\x7fぁ-んァ-ヶー、。一-鿿]*(?:[一-鿿](?=[a-z]))?[^\s\x00-\x40\[-`{-\x7fぁ-んァ-ヶー、。一-鿿]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Characters of a unit and of a run at most; longer runs are no letters inside a word. Letters of a run at most.
UNIT, RUN, LETTERS_OF_RUN = 4, 8, 2
#: How sure a unit's letter must be, and how well a restored word must read (mean log of its bigrams) if the lexicon hasn't it.
SURE, READS, MOST_WORDS = 0.6, -2.35, 0.8
#: Words with signs inside that tell damage even if nothing explains it.
UNEXPLAINED = 3


@lru_cache(maxsize=1)
def _good_letters() -> frozenset[str]:
    return frozenset(LETTERS)


def cipher_tokens(line: str) -> Iterator[re.Match]:
    """Words of Latin letters with something inside that can't be there: a run of characters that are no letters here, or
    capitals behind small letters."""
    good = _good_letters()
    for m in _TOKEN.finditer(line):
        w = m.group()
        if len(w) < 3 or w.isascii() or sum("a" <= c <= "z" or "A" <= c <= "Z" for c in w) * 2 < len(w) - UNIT:
            continue
        for r in _RUN.finditer(w):
            x = r.group()
            if len(x) <= RUN and not all(c in good and (c.islower() or not r.start()) for c in x) and (r.start() or r.end() < len(w)):
                if not any(unicodedata.category(c) in ("Mn", "Zs") or c in "\xad\u200b\u200c\u200d\u2060\ufeff" for c in x):
                    yield m
                    break


def runs_of(word: str) -> Iterator[tuple[str, str, str]]:
    """(run, letter before, letter behind) of the runs of a word; ``^`` and ``$`` stand for its ends."""
    for r in _RUN.finditer(word):
        if len(r.group()) <= RUN:
            yield r.group(), word[r.start() - 1].lower() if r.start() else "^", word[r.end()].lower() if r.end() < len(word) else "$"


class Bigrams:
    """Smoothed letter bigrams, with ``^`` and ``$`` at the ends of words. ``count``: how often (a, b) occurs."""

    def __init__(self, count: dict[tuple[str, str], float]) -> None:
        self.letters = sorted({c for p in count for c in p if c.isalpha()})
        self.first, self.second = ["^", *self.letters], [*self.letters, "$"]
        i, j = {c: k for k, c in enumerate(self.first)}, {c: k for k, c in enumerate(self.second)}
        n = np.zeros((len(self.first), len(self.second)))
        for (a, b), k in count.items():
            if a in i and b in j:
                n[i[a], j[b]] += k
        self.i, self.j, total = i, j, n.sum(axis=1, keepdims=True)
        self.p = (n + 0.0005 * total + 0.05) / (total * (1 + 0.0005 * len(self.second)) + 0.05 * len(self.second))
        #: Letters that a unit may stand for.
        self.targets = [c for c in self.letters if ord(c) > 127]

    @classmethod
    def of_words(cls, words: Iterable[str]) -> Bigrams:
        return cls(Counter(p for w in words for p in zip("^" + w.lower(), w.lower() + "$")))

    def mean(self, word: str) -> float:
        w = word.lower()
        return sum(math.log(self.p[self.i[a], self.j[b]] if a in self.i and b in self.j else 1e-5) for a, b in zip("^" + w, w + "$")) / (len(w) + 1)


#: Occurrences that what all sources show of a unit counts for in each of them.
STRENGTH = 4.0

Contexts = list[tuple[int, str, str, str, int]]


def learn_units(rows: Contexts, lm: Bigrams, rounds: int = 25) -> dict[tuple[int, str], tuple[str, float]]:
    """(letter, share) behind each unit of each source, from (source, run, letter before, letter behind, count).

    A first round of learning takes all sources as one, and what it shows of a unit is where each source's own learning
    starts, and counts there for a few occurrences: a source with one damaged page has too little of its own.
    """
    if not rows or not lm.targets:
        return {}
    pooled: Counter = Counter()
    for _, run, a, b, n in rows:
        pooled[run, a, b] += n
    ids, gain = _maximize([(0, *x, n) for x, n in pooled.items()], lm, rounds, None)
    prior = {u: gain[k] / max(gain[k].sum(), 1e-9) for (_, u), k in ids.items()}
    ids, gain = _maximize(rows, lm, rounds, prior)
    best, mass = gain.argmax(axis=1), gain.sum(axis=1)
    return {u: (lm.targets[best[k]], float(gain[k, best[k]] / mass[k])) for u, k in ids.items() if mass[k] > STRENGTH + 0.5}


def _maximize(rows: Contexts, lm: Bigrams, rounds: int, prior: dict[str, np.ndarray] | None) -> tuple[dict[tuple[int, str], int], np.ndarray]:
    """Expectation-maximization: the units (by source), and how often each stands for each letter.

    A run is one unit, or two in every way it can be cut. All runs of all sources are gone through at once, as arrays.
    """
    t = len(lm.targets)
    ids: dict[tuple[int, str], int] = {}
    one: list[tuple] = []
    two: list[tuple] = []
    before = lambda c: lm.i.get(c, -1)
    behind = lambda c: lm.j.get(c, -1)
    for k, (s, run, a, b, n) in enumerate(rows):
        if len(run) <= UNIT:
            one.append((k, ids.setdefault((s, run), len(ids)), before(a), behind(b), n))
        for cut in range(max(1, len(run) - UNIT), min(UNIT, len(run) - 1) + 1):
            two.append((k, ids.setdefault((s, run[:cut]), len(ids)), ids.setdefault((s, run[cut:]), len(ids)), before(a), behind(b), n))
    # unknown neighbours say nothing
    p = np.vstack([lm.p, lm.p.mean(axis=0)])
    p = np.hstack([p, p.mean(axis=1, keepdims=True)])
    at_i, at_j = np.array([lm.i[c] for c in lm.targets]), np.array([lm.j[c] for c in lm.targets])
    o, w = np.array(one, dtype=np.int64).reshape(-1, 5), np.array(two, dtype=np.int64).reshape(-1, 6)
    head_o, tail_o = p[o[:, 2]][:, at_j], p[at_i][:, o[:, 3]].T
    head_w, tail_w = p[w[:, 3]][:, at_j], p[at_i][:, w[:, 4]].T
    inner = p[np.ix_(at_i, at_j)]
    base = np.zeros((len(ids), t)) if prior is None else np.stack([prior.get(u, np.zeros(t)) for _, u in ids]) * STRENGTH
    share = np.full((len(ids), t), 1.0 / t) if prior is None else (base + 0.1) / (base + 0.1).sum(axis=1, keepdims=True)
    total = np.zeros(len(rows))
    # how long the units of each source are: learned, too, for all letters of a code page have about one length
    source = np.array([s for s, _ in ids])
    length = np.array([len(u) for _, u in ids]) - 1
    long = np.full((source.max() + 1, UNIT), 1.0 / UNIT)
    for _ in range(rounds):
        weighted = share * long[source, length][:, None] ** 2
        so = weighted[o[:, 1]] * head_o * tail_o
        left, right = weighted[w[:, 1]] * head_w, weighted[w[:, 2]] * tail_w
        through = left @ inner  # of the first letter, summed
        sw = through * right
        total[:] = 1e-300
        np.add.at(total, o[:, 0], so.sum(axis=1))
        np.add.at(total, w[:, 0], sw.sum(axis=1))
        gain = np.zeros_like(share)
        np.add.at(gain, o[:, 1], so * (o[:, 4] / total[o[:, 0]])[:, None])
        weight = (w[:, 5] / total[w[:, 0]])[:, None]
        np.add.at(gain, w[:, 2], sw * weight)
        np.add.at(gain, w[:, 1], left * (right @ inner.T) * weight)
        gain += np.where(gain.sum(axis=1, keepdims=True) > 0.05, base, 0)
        mass = gain.sum(axis=1, keepdims=True)
        long[:] = 0.02
        np.add.at(long, (source, length), mass[:, 0])
        long /= long.sum(axis=1, keepdims=True)
        # a unit's share of letters, and how much it is needed at all, so that one unit wins over two that nothing else shows
        share = np.where(mass > 0, (gain + 0.01) / (mass + 0.01 * t), share) * (mass / (mass + 0.5))
    return ids, gain


def translate(word: str, units: dict[str, str], longest: int) -> str:
    """The word with the units of its runs put right, the longest first; a letter is a capital where its unit is one."""
    out, k = "", 0
    while k < len(word):
        for n in range(min(longest, len(word) - k), 0, -1):
            to = units.get(word[k : k + n])
            if to is not None:
                out += to
                k += n
                break
        else:
            out += word[k]
            k += 1
    return out


def affected(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, restored, words, lines) of every affected document: its restored text, the words that the substitution learned for
    its source restored, and the lines of which only known code pages, or lost bytes, tell that they are affected."""
    words = [r.w for r in lexicon.where("word is not null").select(F.col("word").alias("w")).distinct().limit(MAX_LEXICON + 1).collect()]
    if len(words) > MAX_LEXICON:
        raise ValueError(f"more than {MAX_LEXICON} words; give a smaller lexicon")
    latin = sorted({w.lower() for w in words if re.match("[a-zà-ÿœß]", w.lower())})
    some = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text")).where("text is not null")
    odd, lm = _parted(some, latin)
    known = docs.sparkSession.sparkContext.broadcast(frozenset(latin) | {w for w in words if w[:1].isupper()})
    tables = _learned(odd, lm)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                fixed, n, lines = put_right(t, dict(zip(m[::2], m[1::2])) if m else {}, known.value, lm)
                if n or lines:
                    out.append((i, fixed, n, lines))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "restored", "words", "lines"])

    return odd.join(tables, "source", "left").select("doc_id", "text", "units").mapInArrow(apply, "doc_id bigint, restored string, words int, lines int")


def put_right(text: str, units: dict[str, str], known: frozenset[str], lm: Bigrams) -> tuple[str, int, int]:
    """(text, words, lines): a text with all put right that a source's units or known code pages explain; words by the former,
    lines by the latter alone."""
    if not _foreign().search(text) and not _HALF.search(text):
        return text, 0, 0
    longest = max(map(len, units), default=0)
    out, words, lines, left = [], 0, 0, 0
    for line in re.split("(\r\n|\n|\r)", text):
        if not (_foreign().search(line) or _HALF.search(line)):
            out.append(line)
            continue
        shown = [m.span() for m in _SAMPLES.finditer(line) if _foreign().search(m.group()) or _HALF.search(m.group())]
        tokens = [m for m in cipher_tokens(line) if not any(a <= m.start() < b for a, b in shown)]
        fixed = [(m, translate(m.group(), units, longest)) for m in tokens] if units else []
        good = [(m, _cased(w, known)) for m, w in fixed if w != m.group() and _reads(w, known, lm)]
        by_units = len(good) >= MOST_WORDS * len(tokens) and len(good) > 0
        learned, k = "", 0
        for m, w in good if by_units else ():
            learned, k = learned + line[k : m.start()] + w, m.end()
        learned += line[k:]
        if by_units and _foreign().search(learned):  # what is left may say that the whole line is of another kind
            rest, n = restore(line)
            by_units = not n or bool(_foreign().search(rest))
        if by_units:
            words += len(good)
            rest, n = restore(learned)  # signs and other text of the line
            out.append(rest if n and not _LOST.search(rest) else learned)
        else:
            rest, n = restore(line)
            out.append(rest)
            lines += n
            left += 0 if n else sum(len(m.group()) >= 4 for m in tokens)
    return "".join(out), words, lines or int(not words and left >= UNEXPLAINED)


def _reads(word: str, known: frozenset[str], lm: Bigrams) -> bool:
    """Whether a restored word is one of the lexicon, or reads like one and is not one of it behind a sign."""
    if any(ord(c) > 127 and c not in _good_letters() for c in word):
        return False
    low = word.lower()
    return low in known or len(word) >= 6 and low.lstrip(LETTERS) not in known and lm.mean(word) >= READS


def _cased(word: str, known: frozenset[str]) -> str:
    """The word with a capital if the lexicon has it only so."""
    upper = word[:1].upper() + word[1:]
    return upper if word not in known and upper in known else word


def _parted(texts: DataFrame, latin: list[str]) -> tuple[DataFrame, Bigrams]:
    """The texts that need a closer look, each id once, and the letter bigrams of all others, by one pass. The bigrams (and those
    of the lexicon's words, once each) are a table of the letters' number squared."""
    alphabet = "^" + "".join(sorted({c for w in latin for c in w if c.isalpha() and ord(c) < 0x250} | set("abcdefghijklmnopqrstuvwxyz")))
    k = len(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(0x10000, np.int64)
        for n, c in enumerate(alphabet[1:], 1):
            code[ord(c)] = n
            if len(c.upper()) == 1:
                code[ord(c.upper())] = n
        total = np.zeros(k * k, np.int64)
        foreign, half = _foreign(), _HALF
        none = pa.array([None], pa.list_(pa.int64()))
        names = ["doc_id", "source", "text", "counts"]
        for b in batches:
            texts = b.column(2).to_pylist()
            odd = np.array([bool(foreign.search(t) or half.search(t)) for t in texts], dtype=bool)
            sound_text = "\n" + "\n".join(t for t, o in zip(texts, odd) if not o) + "\n"
            c = code[np.minimum(np.frombuffer(sound_text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
            total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
            at = pa.array(np.flatnonzero(odd))
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), none.take(pa.array(np.zeros(len(at), np.int64)))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=names)

    both = materialize(texts.mapInArrow(run, "doc_id bigint, source string, text string, counts array<bigint>"), "odd")
    out: Counter = Counter(p for w in latin for p in zip("^" + w, w + "$"))
    for r in both.where("counts is not null").select(F.posexplode("counts").alias("k", "n")).where("n > 0").groupBy("k").agg(F.sum("n").alias("n")).collect():
        a, b = alphabet[r.k // k], alphabet[r.k % k]
        if (a, b) != ("^", "^"):
            out[a, "$" if b == "^" else b] += r.n
    return both.where("counts is null").drop("counts").dropDuplicates(["doc_id"]), Bigrams(out)


#: Contexts that are learned from at once: all those of some sources.
CONTEXTS = 200_000


def _learned(odd: DataFrame, lm: Bigrams) -> DataFrame:
    """(source, units): what the units of each source stand for, as unit, letter, unit, letter, ..."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: Counter = Counter()
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for line in re.split("[\r\n]+", t):
                    if _foreign().search(line) or _HALF.search(line):
                        got.update((s, *x) for m in cipher_tokens(line) for x in runs_of(m.group()))
            cols = list(zip(*got)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(got.values()), pa.int64())], names=["source", "run", "a", "b", "n"])

    each = odd.select("source", "text").mapInArrow(contexts, "source string, run string, a string, b string, n bigint").groupBy("source", "run", "a", "b").agg(F.sum("n").alias("n"))
    each = materialize(each, "contexts")
    groups = -(-max(1, each.count()) // CONTEXTS)

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {s: k for k, s in enumerate(sorted(set(pdf["source"])))}
        rows = [(names[s], r, a, b, int(n)) for s, r, a, b, n in pdf[["source", "run", "a", "b", "n"]].itertuples(index=False)]
        starts: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
        for s, r, a, _, n in rows:
            for k in range(1, min(UNIT, len(r)) + 1):
                starts[s, r[:k]][a == "^"] += n
        units: dict[int, list[str]] = defaultdict(list)
        for (s, u), (letter, sure) in sorted(learn_units(rows, lm).items()):
            if sure >= SURE:
                inside, first = starts[s, u]
                # a unit that only begins words stands for a capital, if its letter has another unit
                units[s] += [u, letter.upper() if first and not inside and any(x == letter and v != u and starts[s, v][0] for v, x in zip(units[s][::2], map(str.lower, units[s][1::2]))) else letter]
        return pd.DataFrame({"source": list(names), "units": [units[k] for k in names.values()]})

    # rows are cipher and neighbours, not documents: a hot source is one group of bounded size
    grouped = each.withColumn("g", F.pmod(F.xxhash64("source"), F.lit(groups))).groupBy("g").applyInPandas(some, "source string, units array<string>")
    return small_or_not(grouped, "ciphers")
