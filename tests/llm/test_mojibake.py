"""Problem 8: damage of known kinds put on sound text, and a cipher that nobody told about."""

import pytest

from inkwell.llm import mojibake as m

JA = "この章では、表計算によって標準的なセル範囲を変換する手順を説明する。"
DE = "Bevor die Fläche geprüft wird, erhöht das Gerät die mögliche Größe über 380 Minuten."
FR = "Dès que la procédure dépasse 148 secondes, la première numérisation contrôle une autre clé."
WORDS = "fläche geprüft erhöht gerät mögliche größe über prüfbericht schlüssel zähler störung später geändert müssen wärme länge höhere gebühr rückgabe ähnliche dès procédure dépasse première numérisation contrôle clé mémoire réseau légende".split()


@pytest.mark.parametrize("text", [JA, DE, FR])
@pytest.mark.parametrize("shown", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"])
def test_utf8_shown_otherwise(text, shown):
    back = "".join(m.table("cp1252" if shown == "latin-1" else shown).keys())
    raw = text.encode("utf-8")
    if shown == "latin-1":
        bad = raw.decode("latin-1")
    else:
        by = {n: c for c, n in m.table(shown).items() if not (shown == "cp1252" and 0x80 <= ord(c) < 0xA0 and len([x for x in m.table(shown) if m.table(shown)[x] == n]) > 1)}
        bad = "".join(chr(n) if n < 128 else by[n] for n in raw)
    assert back
    got, n = m.restore("Sound text.\n" + bad + "\nmore")
    assert n == 1
    assert got == "Sound text.\n" + text + "\nmore"


@pytest.mark.parametrize(("meant", "shown"), [("cp932", "latin-1"), ("cp932", "mac_roman"), ("euc_jp", "latin-1"), ("euc_jp", "cp932")])
def test_japanese_encodings(meant, shown):
    bad = JA.encode(meant).decode(shown, "replace")
    got, n = m.restore(JA + "\n" + bad)
    assert n == 1 and ("�" in bad or got == JA + "\n" + JA)


@pytest.mark.parametrize(("text", "shown"), [(DE, "cp437"), (DE, "mac_roman"), (FR, "cp437"), (FR, "mac_roman")])
def test_western_pages(text, shown):
    assert m.restore(text.encode("cp1252").decode(shown)) == (text, 1)


def test_twice():
    bad = DE.encode().decode("cp1252").encode().decode("cp1252")
    assert m.restore(bad) == (DE, 1)


def test_part_of_a_line():
    assert m.restore("x ± 3 und hÃ¶here LÃ¤nge")[0] == "x ± 3 und höhere Länge"


@pytest.mark.parametrize("text", [
    "", "  ", JA, DE, FR, "ｵﾍﾟﾚｰﾀ ﾒﾓ: générale requête", "ﾃﾞｰﾀ ｼｰﾄ No.392", 'Sample of a wrong display, shown on purpose: "Ã¼" instead of "ü".', "「縺薙ｌ縺ｯ」のような表示は設定の誤りによる。",
    "画面に「譁�蟄�」と出たら設定を見直す。", "Code chart row C: Ã Â Ä Å / row A: © ® ª «", "=~§}¦. #/ :':``¦ /} :<¤ >§' ¦ ¤' <, {^", "丿 囗 丿 ¬ 厂 丶 ¬ 7 l 7 l 丿 ﾉ 亅", "In\xa0the\xa0case with 45 °C ± 3", "a^2 ≒ b, “quoted” – yes", "□□□□ ▲▲▲",
])
def test_sound_text_is_left_alone(text):
    assert m.restore(text) == (text, 0)


@pytest.mark.parametrize("text", ["この章では、表計算によって値を示す。", "補正する前に確認する"])
def test_seven_bit_japanese(text):
    raw = text.encode("iso2022_jp").decode("ascii")
    for shown in (raw, raw.replace("\x1b", "")):
        assert m.restore("# x\n" + shown + "\ny") == ("# x\n" + text + "\ny", 1)
    assert m.restore("$B = 3$ and $A_1 + B_2$ $Bxy") == ("$B = 3$ and $A_1 + B_2$ $Bxy", 0)


def test_unexplained_words():
    lm, known = m.Bigrams.of_words(WORDS), frozenset(WORDS)
    assert m.put_right("Der prѪfѮr der wѮrѪt und gѪbѪѮr", {}, known, lm) == ("Der prѪfѮr der wѮrѪt und gѪbѪѮr", 0, 1)
    assert m.put_right("Code chart row C: Ã Â Ä Å / x prѪfѮr", {}, known, lm)[1:] == (0, 0)
    assert m.put_right("", {}, known, lm) == ("", 0, 0)


def test_five_times():
    bad = "Die Größe"
    for _ in range(5):
        bad = bad.encode().decode("latin-1")
    assert m.restore(bad) == ("Die Größe", 1)


def _damaged(words, shown):
    """(row for the learning, truth) of each word of which UTF-8, or another code page, is shown in one."""
    for w in words:
        bad = w.encode("utf-8" if shown != "cp850>cp1252" else "cp850", "strict").decode("latin-1" if shown == "utf-8>latin-1" else "cp1252", "replace")
        if bad != w and "\ufffd" not in bad:
            yield bad, w


@pytest.mark.parametrize("shown", ["utf-8>latin-1", "cp850>cp1252"])
def test_units_are_learned_without_code_pages(shown):
    pairs = list(_damaged(WORDS, shown))
    lm = m.Bigrams.of_words(WORDS * 3 + "der die und mit das ist rot les des une dans pour par".split())
    rows = [(0, *x, 3) for bad, _ in pairs for x in m.runs_of(bad)]
    units = {u: letter for (_, u), (letter, sure) in m.learn_units(rows, lm).items() if sure >= m.SURE}
    longest = max(map(len, units))
    right = sum(m.translate(bad, units, longest) == w for bad, w in pairs)
    assert len(pairs) >= 15 and right >= 0.7 * len(pairs), (right, len(pairs), units)
    assert m.learn_units([], lm) == {}


def test_parted(spark):
    texts = ["", "sound ü é", "ﾃﾞｰﾀ", "gr\xc3\xb6", "a眉b", "fÈr", "x÷y", "$B$b$7$7(B", "表計算", "a \x85 b", "gr”er", "“quoted”", "😀", "Ã Â"]
    odd, lm = m._parted(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string"), ["für"])
    assert {r.doc_id for r in odd.collect()} == {2, 3, 4, 5, 6, 7, 10, 12, 13} | {i for i, t in enumerate(texts) if m._foreign().search(t)}
    assert lm.targets == ["ü"] and lm.p[lm.i["s"]].argmax() == lm.j["o"]  # of sound, and of nothing that needs a look


def test_bigrams_learn_an_unknown_page(spark):
    cipher = str.maketrans("äöüßéèê", "ѪѮѰѲѳѵѷ")
    rows = [(k, (DE + " " + DE.replace("Fläche", "Länge")).translate(cipher), "a", None) for k in range(3)] + [(10, FR.translate(cipher), None, "x"), (11, DE, "a", "x"), (12, None, "a", "x"), (13, "", None, "x"), (14, JA.encode().decode("latin-1"), "b", "x")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, source string, lines string")
    lex = spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "word string")
    got = {r.doc_id: r for r in m.affected(docs, lex).collect()}
    assert set(got) == {0, 1, 2, 10, 14}
    assert got[0].restored.startswith(DE[:60]) and got[0].words > 5 and got[14].lines == 1
    assert m.affected(docs.limit(0), lex).count() == 0
