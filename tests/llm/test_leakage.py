"""Problem 7 against every run of every item, by plain edit distance."""

import random

import numpy as np
import pytest

from inkwell.llm import leakage
from inkwell.llm.leakage import LETTERS, WORDS, _HAS_CJK, _WORD, Budget, leaks, letters, myers, plain


def distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def units(text, cjk):
    return [int(x) for x in letters(plain(text))] if cjk else _WORD.findall(plain(text))


def brute(docs, items):
    out = set()
    for i, it in items:
        if not it:
            continue
        cjk = bool(_HAS_CJK.search(plain(it)))
        u, b = units(it, cjk), LETTERS if cjk else WORDS
        for d, t in docs:
            v = units(t or "", cjk)
            if u and v and any(distance(u[w : w + n], v) <= e for n, e in b.of(len(u)) for w in range(len(u) - n + 1)):
                out.add((d, i))
    return out


VOCAB = "the a of table queue buffer when each is next page shows how and for input only once".split()
KANA = "この章では平均的な値を計算する手順スキーマ表"


def damage(rng, seq, rate, pool):
    out = []
    for x in seq:
        r = rng.random()
        if r < rate / 3:
            continue
        if r < 2 * rate / 3:
            out += [x, rng.choice(pool)]
        else:
            out.append(rng.choice(pool) if r < rate else x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_runs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    items, docs = [], []
    for i in range(14):
        n = rng.choice([3, 8, 14, 18, 40])
        items.append((i, " ".join(rng.choice(VOCAB) for _ in range(n))) if i % 2 else (i, "".join(rng.choice(KANA) for _ in range(n * 2))))
    for d in range(60):
        i, t = rng.choice(items)
        cjk = not i % 2
        seq, pool = (list(t), list(KANA)) if cjk else (t.split(), VOCAB)
        a = rng.randrange(len(seq))
        part = damage(rng, seq[a : a + rng.choice([10, 20, 60])] if rng.random() < 0.6 else seq, rng.choice([0, 0.04, 0.08, 0.15]), pool)
        fill = lambda: [rng.choice(pool) for _ in range(rng.randrange(12))]
        docs.append((d, ("" if cjk else "  **").join(fill() + part + fill())))
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 10
    assert {tuple(r) for r in leaks(df, it, batch_chars=500).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK", 2)
    assert {tuple(r) for r in leaks(df, it).collect()} == want


def test_odd_input(spark):
    passage = "At the plant the table on the next page shows how a queue of each buffer is read only once for input"
    docs = [(1, None), (2, ""), (3, "  "), (4, passage.upper().replace(" ", " \n")), (4, passage), (5, "x" * 200_000 + " " + passage.replace("buffer", "buf-\nfer")), (6, " ".join(passage.split()[:14]))]
    items = [(1, passage), (2, passage), (3, None), (4, "")]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(tuple(r) for r in leaks(df, it).collect()) == [(4, 1), (4, 2), (5, 1), (5, 2)]
    assert leaks(df.limit(0), it).count() == 0
    assert leaks(df, it.limit(0)).count() == 0


def test_myers():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 20))]
        want = distance(a, [x or -1 for x in b])
        assert myers(a, b) == want


def test_dense():
    """Against every stretch."""
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 60)
        hit = np.array(sorted(rng.sample(range(n), rng.randrange(0, n + 1))), dtype=np.int64)
        runs = [(rng.randrange(1, 30), rng.randrange(1, 8)) for _ in range(rng.randrange(1, 3))]
        there = set(hit.tolist())
        good = {x for span, least in runs for a in range(max(1, n - min(span, n) + 1)) if len(there & set(range(a, a + min(span, n)))) >= least for x in range(a, a + min(span, n))}
        assert leakage._dense(hit, n, runs).tolist() == sorted(there & good)


def test_needed_pieces_are_there():
    """A run with errors keeps at least as many of its short pieces as is asked for."""
    rng = random.Random(2)
    for budget in (WORDS, LETTERS):
        for n, e in budget.windows:
            for _ in range(30):
                run = [rng.randrange(10**6) for _ in range(n)]
                bad = list(run)
                for _ in range(e):
                    k = rng.randrange(len(bad))
                    bad[k : k + 1] = rng.choice([[-1], [], [bad[k], -1]])
                have = {tuple(bad[i : i + budget.short]) for i in range(len(bad))}
                assert sum(tuple(run[i : i + budget.short]) in have for i in range(n - budget.short + 1)) >= budget.need(n, e)


def test_pieces():
    assert WORDS.windows == [(16, 1), (20, 2), (30, 3)] and WORDS.piece == 6
    assert LETTERS.windows == [(40, 2), (45, 3), (60, 4), (75, 5)] and LETTERS.piece == 11
    assert Budget(16, 10).of(10) == [(10, 0)]
