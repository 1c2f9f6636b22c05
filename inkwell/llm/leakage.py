"""Problem 7: passages of held-out test items in the documents.

Texts become sequences of units: words for text in Latin script, letters for text in kana and kanji, without
case, width, blanks, line breaks, punctuation and markup. A document leaks an item if it holds a run of ``run``
or more of its units (or the whole of a shorter item) with at most one in ``per`` changed, left out or put in.

Pigeonhole: a run with at most e errors holds one of its e + 1 pieces unchanged; cut shorter, so many of its pieces stay
unchanged that they tell a leak from a phrase that texts share. All short pieces of all items are a table of (hash, item),
however many items there are. One scan of the documents hashes their windows by vector operations and keeps, by a Bloom filter
over the table, the stretches in which as many windows are pieces as a run needs. An equi-join of their hashes with the table
(broadcast if it is small, else shuffled, and split where a piece is hot) counts the pieces that a document and an item
share; those with enough are verified. There, hits of longer pieces on one diagonal are strung together; a string as long as a
run is a find. Of the others, runs around the hit are counted unit by unit, with shifts, which gives an upper bound of what
can match; where that allows a find, Myers' bit-parallel edit distance decides. No piece is skipped because it is common.
Items with one text are searched as one.

Results for odd input:
  * null, empty and blank documents and items leak nothing;
  * an item shorter than a run must be there as a whole, with errors in proportion, one shorter than a piece unchanged;
  * equal items, and items that share the passage, are all reported; repeated rows count once;
  * documents of any length are searched as a whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small, materialize


@dataclass(frozen=True)
class Budget:
    """A run has at least ``run`` units, with at most one error in ``per`` of them. ``short``: units of the pieces that are
    counted."""

    run: int
    per: int
    short: int = 4

    def need(self, n: int, e: int) -> int:
        """Short pieces of a run of ``n`` units that ``e`` errors leave unchanged, at least: an error is in ``short`` of them."""
        return max(1, n - self.short + 1 - e * self.short)

    @property
    def windows(self) -> list[tuple[int, int]]:
        """(units, errors) of the runs to look for. A run twice as long holds a shorter one that is no worse, so these are enough."""
        out = []
        for e in range(self.run // self.per, 2 * self.run):
            n = max(self.run, self.per * e)
            if n >= 2 * self.run:
                return out
            out.append((n, e))
        return out

    @property
    def piece(self) -> int:
        """What stays unchanged, at least, in any of these runs: the unchanged units fall into errors + 1 stretches."""
        return min(-(-(n - e) // (e + 1)) for n, e in self.windows)

    def of(self, n: int) -> list[tuple[int, int]]:
        """The runs to look for in an item of ``n`` units."""
        if n >= self.run:
            return [(k, e) for k, e in self.windows if k <= n]
        e = n // self.per
        while e and -(-(n - e) // (e + 1)) < self.piece:
            e -= 1
        return [(n, e)]


WORDS, LETTERS = Budget(16, 10, 4), Budget(40, 15, 8)
#: Candidate items that are verified at once; bits of the Bloom filter for each piece, its bits at most (as a power of two), and
#: what a hash is multiplied with for each look into it.
BLOCK, BITS_EACH, MOST_BITS, PROBES = 200, 32, 30, (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_TAG = re.compile(r"<[^<>\n]{1,200}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑\xad¬]\s*\n\s*(?=[^\W\d_])")
_CJK = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿々〆"
_WORD = re.compile(f"[^\\W_{_CJK}]+")
_HAS_CJK = re.compile(f"[{_CJK}]")
_B = np.uint64(0x9E3779B97F4A7C15)
_alnum = np.array([chr(n).isalnum() if not 0xD800 <= n <= 0xDFFF else False for n in range(0x30000)])


def plain(text: str) -> str:
    """Text without markup tags and broken words, in one width and case."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "\xad" in text or "​" in text or "﻿" in text or "⁠" in text:
        text = re.sub("[\xad​-‏⁠﻿]", "", text)
    return text.lower()


def letters(text: str) -> np.ndarray:
    """Code points of the letters and figures of plain text."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return c[_alnum[np.minimum(c, 0x2FFFF)]].astype(np.int64)


class Side:
    """The items of one kind of unit: all their units in a row, with 0 between items, and the table of pieces."""

    def __init__(self, items: list[tuple[int, np.ndarray]], budget: Budget) -> None:
        self.budget, q = budget, budget.piece
        self.tiny = [(i, u) for i, u in items if 0 < len(u) < q]
        items = [(i, u) for i, u in items if len(u) >= q]
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        gap = np.zeros(1, np.int64)
        self.pad = 3 * budget.run
        pad = np.zeros(self.pad, np.int64)
        self.units = np.concatenate([pad, *(x for _, u in items for x in (u, gap)), pad])
        n = np.array([len(u) for _, u in items], dtype=np.int64)
        self.small = _fold(self.units)
        self.begin = len(pad) + np.cumsum(n + 1) - (n + 1)
        self.end = self.begin + n
        self.item_at = np.repeat(np.arange(len(items)), n + 1)
        h, ok = _hashes(self.units, q)
        at = np.flatnonzero(ok)
        order = np.argsort(h[at], kind="stable")
        self.at = at[order]
        self.keys, self.first = np.unique(h[at][order], return_index=True)
        self.count = np.diff(np.append(self.first, len(self.at)))
        self.bloom = np.zeros(1 << 20, dtype=bool)
        self.bloom[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, units: np.ndarray, doc_of: np.ndarray) -> set[tuple[int, int]]:
        """(document number, item id) of all leaks. ``units`` has a 0 between documents, and many at its ends."""
        found: set[tuple[int, int]] = set()
        for i, u in self.tiny:
            k = np.flatnonzero(units[: len(units) - len(u) + 1] == u[0])
            for j in range(1, len(u)):
                k = k[units[k + j] == u[j]]
            found |= {(int(doc_of[x]), i) for x in k}
        if not len(self.keys):
            return found
        q, run = self.budget.piece, self.budget.run
        h, ok = _hashes(units, q)
        p = np.flatnonzero(self.bloom[(h >> np.uint64(44)).astype(np.int64)] & ok)
        k = np.searchsorted(self.keys, h[p])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[p]
        p, k = p[hit], k[hit]
        if not len(p):
            return found
        # each place of a document with each place of an item that has the same piece
        n = self.count[k]
        pp = np.repeat(p, n)
        off = np.arange(len(pp)) - np.repeat(np.cumsum(n) - n, n)
        qq = self.at[np.repeat(self.first[k], n) + off]
        # strings of hits on one diagonal
        order = np.lexsort((pp, pp - qq))
        pp, qq = pp[order], qq[order]
        new = np.ones(len(pp), dtype=bool)
        new[1:] = (np.diff(pp - qq) != 0) | (np.diff(pp) != 1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(pp)))
        p0, q0 = pp[start], qq[start]
        item = self.item_at[q0 - self.pad]
        need = np.minimum(run, self.end[item] - self.begin[item])
        sure = size + q - 1 >= need
        found |= {(int(doc_of[a]), int(self.ids[b])) for a, b in zip(p0[sure], item[sure])}
        # the rest: around the first and the last piece of each string
        rest = ~sure
        more = rest & (size > 1)
        a = np.concatenate([p0[rest], (p0 + size - 1)[more]])
        b = np.concatenate([q0[rest], (q0 + size - 1)[more]])
        it = np.concatenate([item[rest], item[more]])
        small = _fold(units)
        for s in range(0, len(a), 8192):
            self._verify(units, small, doc_of, a[s : s + 8192], b[s : s + 8192], it[s : s + 8192], found)
        return found

    def _same(self, small: np.ndarray, p: np.ndarray, q: np.ndarray, back: int, ahead: int) -> np.ndarray:
        """Running count of the units from ``q - back`` to ``q + ahead`` of the items that the document has about there."""
        shift = self.budget.windows[-1][1]
        n = back + ahead
        want = np.lib.stride_tricks.sliding_window_view(self.small, n)[q - back]
        there = np.lib.stride_tricks.sliding_window_view(small, n + 2 * shift)[p - back - shift]
        same = np.zeros(want.shape, dtype=bool)
        for s in range(2 * shift + 1):
            same |= there[:, s : s + n] == want
        same &= want != 0
        total = np.zeros((len(p), n + 1), dtype=np.int16)
        np.cumsum(same, axis=1, out=total[:, 1:])
        return total

    def _verify(self, units: np.ndarray, small: np.ndarray, doc_of: np.ndarray, p: np.ndarray, q: np.ndarray, item: np.ndarray, found: set) -> None:
        """Of pieces at ``p`` in the documents and ``q`` in the items: an upper bound of what matches, then the distance itself."""
        piece, run, windows = self.budget.piece, self.budget.run, self.budget.windows
        # each of the runs to look for holds one of ``run`` units around the piece, with no more errors than its own
        total = self._same(small, p, q, run - piece, run)
        may = (total[:, run:] - total[:, :-run]).max(axis=1) >= run - windows[-1][1]
        may |= self.end[item] - self.begin[item] < run
        p, q, item = p[may], q[may], item[may]
        widest = windows[-1][0]
        rel = np.arange(-(widest - piece), widest)
        total = self._same(small, p, q, widest - piece, widest)
        # (start of the run in the item, start in the document, run, errors) of all runs that may match
        tried: set[tuple[int, int, int]] = set()
        length = self.end[item] - self.begin[item]
        for n, e in windows:
            count = total[:, n:] - total[:, :-n]
            start = q[:, None] + rel[: count.shape[1]]
            may = (count >= n - e) & (start >= self.begin[item][:, None]) & (start + n <= self.end[item][:, None])
            may &= (start <= q[:, None]) & (start + n >= q[:, None] + piece)
            for k, w in zip(*np.nonzero(may)):
                self._try(units, doc_of, int(p[k]), int(q[k]), int(item[k]), int(start[k, w]), n, e, tried, found)
        for k in np.flatnonzero(length < self.budget.run):
            for n, e in self.budget.of(int(length[k])):
                self._try(units, doc_of, int(p[k]), int(q[k]), int(item[k]), int(self.begin[item[k]]), n, e, tried, found)

    def _try(self, units: np.ndarray, doc_of: np.ndarray, p: int, q: int, item: int, w: int, n: int, e: int, tried: set, found: set) -> None:
        """Whether the item's run of ``n`` units at ``w`` is near enough to the document, if ``q`` and ``p`` correspond."""
        pair, at = (int(doc_of[p]), int(self.ids[item])), p + (w - q)
        if pair in found or (at, w, n) in tried:
            return
        tried.add((at, w, n))
        if myers(self.units[w : w + n].tolist(), units[max(0, at - e) : at + n + e].tolist()) <= e:
            found.add(pair)


def myers(pattern: list[int], text: list[int]) -> int:
    """The least edit distance of the pattern to any part of the text: Myers' bit vectors, in one integer of any length."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    pv, mv, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0) if c else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        best = min(best, score)
    return best


def _fold(units: np.ndarray) -> np.ndarray:
    """Units in 16 bits, 0 for gaps and unknown words; different units may get equal, which keeps upper bounds upper bounds."""
    return np.where(units > 0, units % 65535 + 1, 0).astype(np.uint16)


def _hashes(units: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window of ``q`` units at each place, and whether the window has no gap."""
    n = max(0, len(units) - q + 1)
    u = units.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    gap = np.zeros(n, dtype=bool)
    for k in range(q):
        h = h * _B + u[k : k + n]
        gap |= units[k : k + n] == 0
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h, ~gap


class Index:
    """Items that texts are searched for."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        words, chars = [], []
        for i, t in items:
            t = plain(t or "")
            if _HAS_CJK.search(t):
                chars.append((i, letters(t)))
            else:
                words.append((i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _WORD.findall(t)], dtype=np.int64)))
        self.words, self.chars = Side(words, WORDS), Side(chars, LETTERS)

    def search(self, texts: list[str | None]) -> set[tuple[int, int]]:
        """(number of the text, item id)"""
        get = self.vocabulary.get
        found: set[tuple[int, int]] = set()
        rows_w, rows_c = [], []
        for t in texts:
            t = plain(t or "")
            # a word that no item has is a unit that equals none
            rows_w.append(np.array([get(w, -1) for w in _WORD.findall(t)], dtype=np.int64))
            rows_c.append(letters(t) if _HAS_CJK.search(t) else np.array([], np.int64))
        for side, rows in ((self.words, rows_w), (self.chars, rows_c)):
            found |= side.search(*_spread(rows, 4 * side.budget.run))
        return found


class _Ids(dict):
    """Positive numbers of words, the same in every worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = n = (xxhash.xxh3_64_intdigest(word) >> 1) | 1
        return n


_ids = _Ids()


def units_of(text: str | None, item: bool) -> list[tuple[int, np.ndarray]]:
    """(side, units): 0 for words, 1 for letters. A document with kana or kanji is both, an item one of them."""
    t = plain(text or "")
    cjk = bool(_HAS_CJK.search(t))
    out = []
    if not (item and cjk):
        out.append((0, np.fromiter(map(_ids.__getitem__, _WORD.findall(t)), np.int64)))
    if cjk:
        out.append((1, letters(t)))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short pieces of items, with how often an item has each, how many it must share, and its units (of a run at most). An
    item shorter than a piece is one itself."""
    for b in batches:
        rows: list[tuple] = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for side, u in units_of(text, True):
                budget = (WORDS, LETTERS)[side]
                q = min(budget.short, len(u))
                if q:
                    h, n = np.unique(_hashes(u, q)[0], return_counts=True)
                    need = min(budget.need(*x) for x in budget.of(len(u)))
                    rows += [(side, q, x, key, k, need, min(len(u), budget.run)) for x, k in zip(h.view(np.int64).tolist(), n.tolist())]
        cols = list(zip(*rows)) or [()] * 7
        types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["side", "length", "hash", "cls", "times", "need", "units"])


def _bloom(pieces: DataFrame, bits: int) -> np.ndarray:
    """Some bits for each hash; made in parts of 64 KB, which meet part by part."""
    part = 16  # bytes of a part, as a power of two

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.concatenate([_probe(np.asarray(b.column(0)).view(np.uint64), p, bits) for p in PROBES])
            for k in np.unique(at >> np.uint64(part + 3)).tolist():
                own = at[at >> np.uint64(part + 3) == k] & np.uint64((1 << (part + 3)) - 1)
                np.bitwise_or.at(parts.setdefault(k, np.zeros(1 << part, np.uint8)), (own >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (own & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["k", "bits"])

    out = np.zeros(max(1, 1 << (bits - 3)), np.uint8)
    for r in pieces.select("hash").mapInArrow(mark, "k bigint, bits binary").toLocalIterator():
        own = np.frombuffer(r.bits, np.uint8)
        at = r.k << part
        out[at : at + len(own)] |= own[: len(out) - at]
    return out


def _probe(h: np.ndarray, times: int, bits: int) -> np.ndarray:
    return h * np.uint64(times) >> np.uint64(64 - bits)


def _held(bloom: np.ndarray, h: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The places ``at`` whose hashes the filter may hold."""
    for p in PROBES:
        bit = _probe(h[at], p, bits)
        at = at[(bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def _dense(hit: np.ndarray, size: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Of the places ``hit`` (of ``size``) those that lie in a stretch with enough of them. ``runs``: (stretch, hits in it)."""
    mark = np.zeros(size, np.int32)
    mark[hit] = 1
    total = np.concatenate([[0], np.cumsum(mark)])
    keep = np.zeros(size + 1, np.int32)
    for span, least in runs:
        span = min(span, size)
        start = np.flatnonzero(total[span:] - total[:-span] >= least)
        np.add.at(keep, start, 1)
        np.add.at(keep, start + span, -1)
    return hit[np.cumsum(keep)[hit] > 0]


def _spread(rows: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of several texts in a row, with a 0 between and many at the ends, and the text of each."""
    gap, edge = np.zeros(1, np.int64), np.zeros(pad, np.int64)
    units = np.concatenate([edge, *(x for r in rows for x in (r, gap)), edge])
    return units, np.repeat(np.arange(len(rows) + 2), [pad, *(len(r) + 1 for r in rows), pad]) - 1


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item."""
    spark = docs.sparkSession
    named = items.where("text is not null").select("item_id", "text", F.md5("text").alias("cls"))
    classes = materialize(named.groupBy("cls").agg(F.first("text").alias("text")), "items")
    pieces = materialize(classes.mapInArrow(_pieces, "side int, length int, hash bigint, cls string, times int, need int, units int"), "pieces")
    n = pieces.count()
    bits = min(MOST_BITS, max(10, (BITS_EACH * max(n, 1)).bit_length()))
    stretches: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for r in pieces.select("side", "length", "units").distinct().collect():  # as many as there are units in a run, at most
        budget = (WORDS, LETTERS)[r.side]
        runs = budget.windows if r.units == budget.run else budget.of(r.units)
        stretches.setdefault((r.side, r.length), set()).update((n + e - r.length + 1, budget.need(n, e)) for n, e in runs)
    lengths = [(side, q, sorted(runs)) for (side, q), runs in sorted(stretches.items())]
    shared = spark.sparkContext.broadcast(_bloom(pieces, bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value

        def flush(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            sides: list[list[np.ndarray]] = [[], []]
            none = np.array([], np.int64)
            for t in texts:
                got = dict(units_of(t, False))
                for k in (0, 1):
                    sides[k].append(got.get(k, none))
            found: dict[int, set[int]] = {}
            for side, q, runs in lengths:
                units, doc = _spread(sides[side], q)
                h, ok = _hashes(units, q)
                hit = _dense(_held(bloom, h, np.flatnonzero(ok), bits), len(h), runs)
                for d, x in zip(doc[hit].tolist(), h[hit].view(np.int64).tolist()):
                    found.setdefault(d, set()).add(x)
            rows = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in rows], pa.int64()), pa.array([texts[d] for d in rows], pa.string()), pa.array([sorted(found[d]) for d in rows], pa.list_(pa.int64()))], names=["doc_id", "text", "hashes"])

        for b in batches:
            ids: list[int] = []
            texts: list[str] = []
            n = 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                n += len(t)
                if n >= batch_chars:
                    yield flush(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield flush(ids, texts)

    some = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    hits = materialize(some.mapInArrow(scan, "doc_id bigint, text string, hashes array<bigint>").withColumn("uid", F.monotonically_increasing_id()), "hits")
    small = lambda d: F.broadcast(d) if is_small(d) else d
    pairs = hits.select("uid", F.explode("hashes").alias("hash")).join(small(pieces.select("hash", "cls", "times", "need")), "hash")
    pairs = pairs.groupBy("uid", "cls").agg(F.sum("times").alias("n"), F.max("need").alias("need")).where("n >= need").select("uid", "cls")
    block = F.floor((F.row_number().over(Window.partitionBy("uid").orderBy("cls")) - 1) / BLOCK)
    asked = pairs.withColumn("block", block).join(small(classes), "cls").groupBy("uid", "block").agg(F.collect_list(F.struct("cls", "text")).alias("items"))
    ready = asked.join(hits.select("uid", "doc_id", "text"), "uid").select("doc_id", "text", "items")
    return ready.mapInArrow(_verify, "doc_id bigint, cls string").distinct().join(small(named.select("cls", "item_id").distinct()), "cls").select("doc_id", "item_id").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their candidate items to documents with the items they hold; some documents at a time against all items
    that one of them was given."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            known: dict[str, str] = {}
            for xs in part.column(2).to_pylist():
                known.update((x["cls"], x["text"]) for x in xs)
            names = sorted(known)
            got = sorted(Index([(k, known[c]) for k, c in enumerate(names)]).search(texts))
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in got], pa.int64()), pa.array([names[k] for _, k in got], pa.string())], names=["doc_id", "cls"])
