"""Problem 4 against planted noise and, for the index, against every word."""

import random

import pytest

from inkwell.llm import denoise as d

WORDS = "queue buffer margin real-time scanned formula after each und für fläche größer elle-même section figure 待ち行列 標準偏差 データベース 割り当てる 主記憶 補助記憶 相関係数 関係 しきい値 段落 の を".split()


@pytest.fixture(scope="module")
def index():
    return d.Index(WORDS)


@pytest.mark.parametrize(("text", "want"), [
    ("the queuc stops", [("misread", "queuc", "queue")]),
    ("M@rgin, und sc@nned", [("misread", "M@rgin,", "margin"), ("misread", "sc@nned", "scanned")]),
    ("scanried gr0ßer flache", [("misread", "scanried", "scanned"), ("misread", "gr0ßer", "größer"), ("misread", "flache", "fläche")]),
    ("Queue BUFFER figures Fläche", []),
    ("a buf-\nfer and real-\ntime elle-\nmême sec‑\ntion", [("hyphen", "buf-\nfer", "buffer"), ("hyphen", "sec‑\ntion", "section")]),
    ("fig-", []), ("fig-\n\nure", []), ("", []), ("   ", []),
    ("標漂偏差とデータベーヌを割り当てる。", [("misread", "標漂偏差", "標準偏差"), ("misread", "データベーヌ", "データベース")]),
    ("主記憶の補助記憶", []), ("相関孫数は段落の関係", [("misread", "相関孫数", "相関係数")]),
    ("しきい植とデータ\nベ一ス", [("misread", "しきい植", "しきい値")]),
    ("quеue bu​ffer デー夕ベース", []),
    ("x" * 60_000 + " queuc", [("misread", "queuc", "queue")]),
])
def test_scan(index, text, want):
    got = [(k, text[a:b], w) for k, a, b, w in sorted(d.scan(index, text), key=lambda f: f[1])]
    assert got == want


@pytest.mark.parametrize(("text", "want"), [("464.g4", "464.94"), ("1l,5O3", "11,503"), ("l2.5%", "12.5%"), ("1234", None), ("0x1F", None), ("H2O", None), ("QV_5793", None), ("SLOB", None), ("12S", None), ("TR-2041", None)])
def test_cells(index, text, want):
    got = d.scan(index, text, whole_cell=True)
    assert [g[3] for g in got] == ([want] if want else [])


def damage(rng, word, pairs, times=1):
    """The word with some of the pairs put in at different places, or None."""
    at = [(i, a, b) for a, b in pairs for i in range(len(word)) if word.startswith(a, i)]
    rng.shuffle(at)
    done: list = []
    for i, a, b in at:
        if len(done) < times and all(i + len(a) < j or j + len(c) < i for j, c, _ in done):
            done.append((i, a, b))
    if len(done) < times:
        return None
    for i, a, b in sorted(done, reverse=True):
        word = word[:i] + b + word[i + len(a) :]
    return word


def test_index_finds_every_word():
    """All words with any two characters changed, or one become two: the index has the word among its candidates, and it is explained."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(300)})
    ix = d.Index(words)
    for w in words:
        i, j = sorted(rng.sample(range(len(w)), 2))
        two = w[:i] + "q" + w[i + 1 : j] + "r" + w[j + 1 :]
        split = w[:i] + "xy" + w[i + 1 :]
        assert w in ix.candidates(two) and any(len(x) == 2 or len(x) == 1 for x in d.explanations(w, two))
        assert w in ix.candidates(split) and ((w[i], "xy"),) in d.explanations(w, split, 1)
    assert d.explanations("word", "word") == [()] and d.explanations("word", "words") == []


def counted(texts, words, rounds=1):
    """An index with what the texts say, as ``learned`` makes it."""
    tally = d.tally(d.Index(words), texts)
    got = {k: {key: n for (what, key), n in tally.items() if what == k} for k in "wpolu"}
    printed: dict = {}
    for w, n in got["w"].items():
        for c in w:
            printed[c] = printed.get(c, 0) + n
    u = sum(got["u"].values())
    return d.Index(words, d.Evidence(*d.shares(got["o"]), printed, got["w"], {tuple(k.split("\0")): n for k, n in got["p"].items()}, got["l"], (u + 1) / (u + sum(got["w"].values()) + 10)))


ENGLISH = "address allocation amplitude average bandwidth branch buffer certificate cluster column compiler controller cursor delivery directory document estimate firewall footer formula forecast frequency function instruction interval inventory latency margin memory network packet paragraph parameter pointer process protocol reference register reviewer router scheduler schema sensor sequence session snapshot storage template terminal threshold throughput transaction variable".split()
GLUE = "the and each with before after every under".split()


def test_unlisted_confusions_are_learned():
    """Confusions that stand in no list, one and two in a word, planted in text with words that the lexicon hasn't."""
    rng = random.Random(3)
    pairs = [("a", "o"), ("u", "v"), ("n", "h"), ("r", "v"), ("t", "l"), ("e", "o"), ("c", "o"), ("m", "nn"), ("d", "ol"), ("li", "h")]
    strange = ["ledger", "walnut", "harvest", "cottage", "lantern", "orchard", "thicket", "meadow", "bramble", "saddle"]
    texts, planted = [], {1: [], 2: []}
    for k in range(3000):
        words = [rng.choice(ENGLISH if n % 2 else GLUE) for n in range(12)] + [rng.choice(strange)]
        times = 0 if rng.random() < 0.6 else 1 if rng.random() < 0.8 else 2
        at = rng.randrange(1, 12, 2)
        bad = damage(rng, words[at], pairs, times) if times else None
        if bad and bad not in ENGLISH:
            planted[times].append((k, bad, words[at]))
            words[at] = bad
        texts.append(" ".join(words))
    ix = counted(texts, ENGLISH + GLUE)
    got = {(k, t[a:b], w) for k, t in enumerate(texts) for _, a, b, w in d.scan(ix, t)}
    for times in (1, 2):
        hit = sum(x in got for x in planted[times])
        assert len(planted[times]) > 100 and hit >= 0.9 * len(planted[times]), (times, hit, len(planted[times]))
    false = {x[:2] for x in got} - {x[:2] for p in planted.values() for x in p}
    assert len(false) <= 0.02 * len(got)


def test_japanese_confusions_are_learned():
    rng = random.Random(4)
    words = "待ち行列 標準偏差 データベース 相関係数 回帰直線 伝送速度 利用者 補助記憶 暗号化 正規化 平均値 演算装置 制御装置 公開鍵 在庫管理".split()
    pairs = [("列", "烈"), ("差", "羞"), ("速", "束"), ("数", "教"), ("置", "直"), ("理", "埋"), ("開", "関"), ("化", "花")]
    texts, planted = [], []
    for k in range(4000):
        parts = [rng.choice(words) for _ in range(4)]
        bad = damage(rng, parts[2], pairs) if rng.random() < 0.08 else None
        if bad and bad not in words:
            planted.append((k, bad, parts[2]))
            parts[2] = bad
        texts.append(f"{parts[0]}と{parts[1]}を{parts[2]}で比べ、見込みは{parts[3]}による。")
    ix = counted(texts, [*words, "割込み"])
    got = {(k, t[a:b], w) for k, t in enumerate(texts) for _, a, b, w in d.scan(ix, t)}
    assert len(planted) > 80 and len(got & set(planted)) >= 0.9 * len(planted)
    assert len(got - set(planted)) <= 0.02 * len(got)


def test_neighbours_choose():
    texts = ["the lane ends"] * 50 + ["one line goes"] * 50 + ["a word"]
    ix = counted(texts, ["line", "lane", "the", "one", "ends", "goes", "word"])
    assert ix.correct("l@ne", "the", "ends") == "lane" and ix.correct("l@ne", "one", "goes") == "line"
    assert ix.correct("line", "the", "ends") is None and ix.correct("zzzzz", None, None) is None


def test_shares():
    key = d._key
    a, b = (("e", "c"), "x"), (("e", "o"), "y")
    ops, within = d.shares({key([a]): 30, key([b]): 1, key([a, b]): 10})
    assert ops["e", "c"] > 39 and ops["e", "o"] < 2 and abs(sum(ops.values()) - 41) < 1e-6 and within[a] == ops["e", "c"]


M = d.Margins()


def test_running(index):
    lines = ["Queue Handbook", None, "body one", "body two", "- 7 -"]
    assert d.running_lines(lines, [120, None, 330, 420, 3400], 7, M) == {0, 4}
    assert d.running_lines(lines, [None, None, 330, 420, None], 7, M) == {0, 4}
    assert d.running_lines(["a", "b", "12"], [None, 420, None], 7, M) == set()
    assert d.running_lines([None, None], [None, None], None, M) == set()
    assert d.running_lines([], [], 1, M) == set()


def test_page_positions(index):
    lines = ["Qucue Handbook", "the buf-", None, "fer of queuc", "p. 3"]
    got = {(k, kind) for k, kind, *_ in d.scan_page(index, lines, [100, 330, None, 420, 3400], 3, M)}
    assert got == {(0, "running"), (0, "misread"), (1, "hyphen"), (3, "misread"), (4, "running")}
    assert d.repair_page(index, lines, [100, 330, None, 420, 3400], 3, M) == "the buffer of queue"


def test_paragraphs():
    assert d.paragraphs("この章では、表\n計算する。") == "この章では、表計算する。"
    assert d.paragraphs("The queue of\na buffer goes\non.") == "The queue of a buffer goes on."
    assert d.paragraphs("more round-\nrobin than\nthis") == "more round-robin than this"
    assert d.repair(d.Index(WORDS), "a real-\ntime queue of buf-\nfer, and the figure\nof each margin after") == "a real-time queue of buffer, and the figure of each margin after"
    assert d.paragraphs("- a item here\n- b item here") == "- a item here\n- b item here"


def test_corpus(spark):
    det = "array<struct<content:string,points:array<array<int>>,box:array<int>>>"
    page = [("Qucue Notes", None, [0, 100, 1, 1]), ("each buf-", [[0, 330], None], None), None, ("fer", None, [0, 420, 1, 1]), ("9", None, None)]
    pages = spark.createDataFrame([(1, "a", 9, page), (1, "a", 9, page), (2, None, None, None), (3, "a", 1, [])], f"layout_id bigint, doc_id string, page int, detections {det}")
    texts = spark.createDataFrame([("cells", 5, "12g4", True), ("cells", 5, "12g4", True), ("regions", 6, None, False), ("regions", 7, "", False), ("regions", 8, "the queuc", False), ("cells", 9, "queue", True)], "src string, row_id bigint, text string, whole_cell boolean")
    lex = spark.createDataFrame([(w,) for w in WORDS] + [(None,), ("",)], "word string")
    got = {tuple(r) for r in d.noise(d.page_lines(pages), texts, lex).select("src", "row_id", "pos", "kind").distinct().collect()}
    assert got == {("layout_json", 1, 0, "running"), ("layout_json", 1, 0, "misread"), ("layout_json", 1, 1, "hyphen"), ("layout_json", 1, 4, "running"), ("cells", 5, 0, "misread"), ("regions", 8, 0, "misread")}
    text = {(r.src, r.row_id): r.text for r in d.readable(d.page_lines(pages), texts, lex).collect()}
    assert text == {("layout_json", 1): "each buffer", ("layout_json", 3): "", ("cells", 5): "1294", ("regions", 6): None, ("regions", 7): "", ("regions", 8): "the queue", ("cells", 9): "queue"}
    assert d.noise(d.page_lines(pages.limit(0)), texts.limit(0), lex).count() == 0


def test_counts(spark):
    df = spark.createDataFrame([("each queue each queue",), ("queue buffer buffcr",), (None,)], "t string").where("t is not null")
    e = d.learned(df, WORDS)
    assert e.words == {"each": 2, "queue": 3, "buffer": 1} and e.pairs == {("each", "queue"): 2, ("queue", "each"): 1, ("queue", "buffer"): 1}
    assert e.ops == {("e", "c"): 1.0} and e.printed["q"] == 3 and 0 < e.unknown < 0.5
    assert d.learned(df.limit(0), WORDS).words == {}


def test_all_neighbours_count_however_many(spark, monkeypatch):
    """Counts of neighbours too many for a broadcast are joined, and give what a broadcast gives: repairs that only the words
    beside them tell, of texts, pages, Japanese, words at line ends, and tokens with marks that part nothing."""
    det = "array<struct<content:string,points:array<array<int>>,box:array<int>>>"
    page = [("one l@ne", None, [0, 400, 1, 1]), ("goes the", None, [0, 500, 1, 1]), None, ("l@ne ends", None, [0, 600, 1, 1])]
    pages = d.page_lines(spark.createDataFrame([(1, "a", 9, page), (2, "a", 1, None), (3, "a", 2, [])], f"layout_id bigint, doc_id string, page int, detections {det}"))
    said = ["the lane ends"] * 50 + ["one line goes"] * 50 + ["each queue"] * 200 + ["待ち行列の関係"] * 30 + ["each buffer and"] * 3
    odd = ["the l@ne ends", "one l@ne goes", "one l@ne goes", "l@ne", "each qucue", "待ち行烈の関係", "関係待ち行烈", "each buf-\nfcr and", "l@\0ne ends", "", None, "x l@ne"]
    texts = spark.createDataFrame([("regions", k, t, k % 2 == 0) for k, t in enumerate(odd + said)], "src string, row_id bigint, text string, whole_cell boolean")
    lex = spark.createDataFrame([(w,) for w in [*WORDS, *"line lane the one ends goes and".split()]], "word string")

    def results():
        return sorted(map(tuple, d.noise(pages, texts, lex).collect())), sorted(map(tuple, d.readable(pages, texts, lex).collect()), key=str)

    few = results()
    fixed = {(r[0], r[1], r[2]): r[5] for r in few[0]}
    assert fixed["regions", 0, 0] == "lane" and fixed["regions", 1, 0] == fixed["regions", 2, 0] == "line"
    assert fixed["layout_json", 1, 0] == "line" and fixed["layout_json", 1, 3] == "lane" and ("regions", 7, 0) in fixed
    for most in (1, 5, 0):
        monkeypatch.setattr(d, "MAX_PAIRS", most)
        assert results() == few
    df = spark.createDataFrame([("each queue each queue",), ("queue buffer buffcr",)], "t string")
    assert d.learned(df, WORDS).pairs == {("each", "queue"): 2, ("queue", "each"): 1, ("queue", "buffer"): 1}


def test_margins_are_learned(spark):
    det = "array<struct<content:string,points:array<array<int>>,box:array<int>>>"
    rows = []
    for doc in range(12):
        for page in range(6):
            body = [(f"body {doc} {page} {k}", None, [0, 900 + 60 * k, 1, 1]) for k in range(5)]
            last = (f"- {page} -", None, [0, 1300, 1, 1]) if page % 2 else (f"{page * 7}.5", None, [0, 1180, 1, 1])  # or a table that ends in a number
            rows.append((doc * 10 + page, f"d{doc % 9 if doc < 9 else 'hot'}", page, [(f"Handbook {doc} {page}", None, [0, 700 + doc, 1, 1]), *body, last]))
    pages = d.page_lines(spark.createDataFrame(rows, f"layout_id bigint, doc_id string, page int, detections {det}"))
    m = d.learned_margins(pages)
    assert 711 < m.low < 900 and 1180 < m.high < 1300
    assert d.learned_margins(pages.limit(2)) == d.Margins() == d.learned_margins(pages.limit(0))
