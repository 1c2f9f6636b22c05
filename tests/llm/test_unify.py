"""Problem 2 against a plain rebuild with the standard library."""

import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import unify as u


def plain(t):
    to = defaultdict(str)
    for ch, _, x, _ in u.mapping()[0]:
        to[ch] += x
    return unicodedata.normalize("NFC", "".join(to[c] if c in to else c for c in t)).strip(" \n\r")


CASES = ["ﾃﾞｰﾀ ｼｰﾄ", "Café区分", "Café区分", "Сafé区分", "kΩ", "kΩ", "ｋΩ", "Å", "Å", "Å", "補助記憶一覧", "補助記憶ー覧", "Man−hour", "Man-hour　", "\xa0ID", "I​D️", "m²", "m2", "第①回",
         "第1回", "ド", "パ", "́x", "ộ", "ộ", "ộ", "q̣̇", "q̣̇", "a" * 3000 + "́", "", " ", "​", "９月〜3月", "9月～3月", "数式領域レべル", "🙂‍🙂", "ẹ́́", "plain text", "Größe", "Grosse"]


def test_forms(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(CASES * 2)] + [(999, None, "a", "b")]
    df = spark.createDataFrame(rows, "id bigint, text string, sub string, to string")
    got = {r.id: r.form for r in u.unify(df, "text", keys=True).collect()}
    assert len(got) == len(rows)
    assert got[999] is None
    for i, t, *_ in rows[:-1]:
        assert got[i] == plain(t), (t, ascii(got[i]))
    form = {t: got[i] for i, t, *_ in rows[:-1]}
    assert form["Café区分"] == form["Café区分"] == form["Сafé区分"] != form["Grosse"]
    assert form["m²"] != form["m2"] and form["第①回"] != form["第1回"] and form["Größe"] != form["Grosse"]
    assert form["ộ"] == form["ộ"] == form["ộ"]
    assert form["q̣̇"] == form["q̣̇"]


def test_canonically_equal_texts_are_one(spark):
    """Every assigned character with a canonical decomposition, syllables of Hangul included, and clusters of many marks."""
    chars = [chr(n) for n in range(0x110000) if not 0xD800 <= n <= 0xDFFF and unicodedata.normalize("NFD", chr(n)) != chr(n)]
    chars += ["q\u0323\u0307\u0301", "a\u0323\u0302\u0308", "e\u0301\u0323\u0302", "한글 텍스트", "ệ́x", "カ゛ガ"]
    rows = [(i, k, unicodedata.normalize(k, c)) for i, c in enumerate(chars) for k in ("NFC", "NFD")]
    df = spark.createDataFrame(rows, "id int, kind string, text string")
    for keys in (True, False):
        got: dict = defaultdict(set)
        for r in u.unify(df, "text", keys=keys).collect():
            got[r.id].add(r.form)
        assert not [chars[i] for i, f in got.items() if len(f) != 1]
        assert got[chars.index("한")] == {"한"} and got[chars.index("ộ")] == {"ộ"} and got[len(chars) - 3] == {"한글 텍스트"}
        assert got[chars.index("q\u0323\u0307\u0301")] == {unicodedata.normalize("NFC", "q\u0323\u0307\u0301")}
        assert got[chars.index("e\u0301\u0323\u0302")] == {unicodedata.normalize("NFC", "e\u0301\u0323\u0302")}


@pytest.mark.parametrize(("text", "want"), [
    ("工場の人口は三千人", "工場の人口は三千人"), ("人ロと工場", "人口と工場"), ("デー夕ベース", "データベース"), ("工ラー", "エラー"), ("デ一タ", "データ"), ("Сafé Москва", "Café Москва"), ("Ωmega Αlpha αβγ", "Ωmega Alpha αβγ"),
    ("ｶﾞｲﾄﾞ　第１回", "ガイド 第1回"), ("データへ移す", "データへ移す"), ("表二 — 三", "表二 — 三"), ("キー入力", "キー入力"), ("データ二件", "データ二件"), ("x\u200by", "xy"),
])
def test_output_keeps_what_is_right(spark, text, want):
    assert u.unify(spark.createDataFrame([(text,)], "text string"), "text").first().form == want


def test_passed_by_is_exact():
    """A text made of characters that the shortcut passes by keeps its form."""
    ranges = [tuple(int(x[3:-1], 16) for x in p.split("-")) for p in u._safe_class().removesuffix("\\n").replace("}\\x", "} \\x").split()]
    for a, b in ranges:
        for n in range(a, b + 1):
            assert plain("x" + chr(n) + "x") == "x" + chr(n) + "x"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeọ́̂̈かバ゚ｶﾞ　ー一Аο", max_size=8))
def test_equal_forms_for_equal_looks(t):
    for other in (unicodedata.normalize(k, t) for k in ("NFC", "NFD", "NFKC", "NFKD")):
        assert plain(other) == plain(t)


def test_terms(spark):
    terms = spark.createDataFrame([(1, "ID"), (2, "入力"), (3, "Total"), (4, "入カ"), (5, None), (6, "total")], "term_id bigint, term string")
    rows = [("cells", 1, 0, "ID"), ("cells", 2, 0, "ІD"), ("cells", 2, 0, "ІD"), ("cells", 3, 0, "入力"), ("layout_json", 3, 4, "入ｶ"), ("cells", 4, 0, None), ("cells", 5, 0, ""), ("cells", 6, 0, "Total "), ("cells", 7, 0, "TOTAL"), ("cells", 8, 0, "Tοtal")]
    df = spark.createDataFrame(rows, "src string, row_id bigint, pos int, text string")
    got = {tuple(r) for r in u.matching_terms(df, terms).collect()}
    assert got == {("cells", 2, 0, 1), ("cells", 3, 0, 4), ("layout_json", 3, 4, 2), ("layout_json", 3, 4, 4), ("cells", 6, 0, 3), ("cells", 8, 0, 3)}
    assert u.matching_terms(df.limit(0), terms).count() == 0


def test_hot_text(spark):
    df = spark.range(5000).selectExpr("'cells' as src", "id as row_id", "0 as pos", "if(id % 3 = 0, 'ІD', concat('x', id)) as text")
    terms = spark.createDataFrame([(1, "ID")], "term_id bigint, term string")
    assert u.matching_terms(df, terms).count() == 1667
