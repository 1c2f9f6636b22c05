"""Problem 2: visually identical text with different characters.

A text that may need work is exploded into positioned code points. Each code point is joined with a broadcast
mapping (decomposition, width, kind of blank, ignorables, look-alikes), combining marks are put in the order of
their class behind their base, clusters are recomposed, and the strings are rebuilt. Texts made of characters
that the mapping leaves alone are passed by; that shortcut is exact.

Two strings are made in this way, and kept apart:

* the *form*, which is the text to go on with: of look-alikes only those are changed that stand among letters of another script
  (a Cyrillic letter in a Latin word, a kanji in a run of katakana, a single katakana letter behind kanji);
* the *key*, which texts are compared by: all look-alikes are one. Two texts look alike if their keys are equal.

Raised, lowered, circled and squared figures, case and accents are kept in both. Syllables of Hangul and their parts are one
text, as are all canonically equal strings. The mapping's size is bounded by Unicode; the terms are broadcast only if they are
small in rows and bytes.

Results for odd input:
  * null stays null, empty and blank texts become empty, other texts lose blanks at their ends;
  * marks without a base stand by themselves; in a cluster every mark that is not blocked is composed, the rest follows in
    the order of the classes;
  * equal texts get equal forms, however often they occur; repeated rows count once in the matches;
  * of several terms that look alike, all are matched; a text that is one of the terms is no match of itself,
    but is one of another that looks like it;
  * other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import is_small, materialize, small_or_not

# Characters that look like another one, each followed by what it looks like.
CYRILLIC = "аaеeоoрpсcхxуyіiѕsјjһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTУYХXІIЅSЈJҮYԚQԜW"
GREEK = "οoνvαaιiκkρpυuΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
KANA = "一ー―ー—ー─ー口ロ囗ロ工エ力カ二ニ夕タ卜ト八ハへヘべベぺペりリ才オ千チ三ミ又ヌ厶ム丿ノ匕ヒ"
SIGNS = "‐-‑-‒-–-−-⁃-˗-∕/⁄/〜~∼~·・‧・∙・⋅・’'‘'′'“\"”\"″\"∣|ǀ|∶:"
# Kinds of decomposition that look different from what they stand for.
KEPT_APART = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")


def _pairs(s: str) -> dict[str, str]:
    return dict(zip(s[::2], s[1::2], strict=True))


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    return _pairs(CYRILLIC) | _pairs(GREEK) | _pairs(KANA) | _pairs(SIGNS)


def _apart(ch: str) -> bool:
    return unicodedata.decomposition(ch).startswith(KEPT_APART)


def _decompose(ch: str) -> str:
    """Full decomposition of a character, down to what looks the same."""
    d = unicodedata.decomposition(ch)
    if not d or _apart(ch):
        return ch
    if d.startswith("<"):
        return "".join(_decompose(chr(int(x, 16))) for x in d.split()[1:])
    return "".join(_decompose(x) if x != ch else x for x in unicodedata.normalize("NFD", ch))


def _ignored(ch: str) -> bool:
    n = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180F or n in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0)


def _mapped(ch: str, same: dict[str, str] | None = None) -> str:
    """What a character becomes; ``same``: what looks alike, all look-alikes if None."""
    same = lookalikes() if same is None else same
    if _ignored(ch):
        return ""
    if unicodedata.category(ch) == "Zs" or ch in "\t\v\f":
        return " "
    out = []
    for x in _decompose(ch):
        x = same.get(x, x)
        out.append("" if _ignored(x) else " " if unicodedata.category(x) == "Zs" else x)
    return "".join(out)


#: First syllable of Hangul, first lead, vowel and tail, and the number of vowels and tails (with none).
_S, _L, _V, _T, _NV, _NT = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28


@lru_cache(maxsize=2)
def mapping(keys: bool = True) -> tuple[list[tuple[str, int, str, int]], list[tuple[str, str]]]:
    """(character, number, target, combining class) of all that changes, and (cluster, composed) of all that composes in one
    step from a base and a mark, or from the parts of a syllable. ``keys``: for the key, with all look-alikes."""
    rows, composed = [], {}
    same = lookalikes() if keys else _pairs(SIGNS)
    for n in range(0x110000):
        if 0xD800 <= n <= 0xDFFF:
            continue
        ch = chr(n)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            continue
        to = _mapped(ch, same)
        if to != ch or unicodedata.combining(ch):
            rows += [(ch, k, x, unicodedata.combining(x)) for k, x in enumerate(to)] or [(ch, 0, "", 0)]
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (chr(int(x, 16)) for x in d.split())
            if unicodedata.combining(b):
                composed[a + b] = ch
    for k in range(19 * _NV * _NT):
        composed[unicodedata.normalize("NFD", chr(_S + k))] = chr(_S + k)
    return rows, sorted(composed.items())


def _mapping_tables(spark: SparkSession, keys: bool) -> tuple[DataFrame, DataFrame]:
    rows, composed = mapping(keys)
    return (
        F.broadcast(spark.createDataFrame(rows, "ch string, sub int, to string, ccc int").coalesce(1)),
        F.broadcast(spark.createDataFrame(composed, "cluster string, composed string").coalesce(1)),
    )


def _safe_class() -> str:
    """Characters that keep their form if no combining mark is among them: a character class of a few ranges."""
    changed = {r[0] for r in mapping()[0]}
    ranges: list[list[int]] = []
    for lo, hi in ((0x20, 0x7E), (0xC0, 0x17F), (0x3001, 0x30FF), (0x4E00, 0x9FFF)):
        for n in range(lo, hi + 1):
            ch = chr(n)
            # a precomposed character decomposes and composes to itself again
            if ch not in changed or unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch)) == ch and _mapped(ch) == unicodedata.normalize("NFD", ch) and not unicodedata.combining(ch):
                if ranges and ranges[-1][1] == n - 1:
                    ranges[-1][1] = n
                else:
                    ranges.append([n, n])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "\\n"


@lru_cache(maxsize=1)
def needs_work_pattern() -> str:
    return f"[^{_safe_class()}]"


def _ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \n\r]+|[ \n\r]+$", "")


def _compose(marks: Column, pairs: Column) -> Column:
    """A base and its marks in order (structs of ``ccc`` and ``to``) as one string: each mark is composed with what the base has
    become, unless a mark of its class or a later one stands between them. ``pairs``: map of base and mark to composed."""
    first = F.struct(marks[0]["to"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, m: Column) -> Column:
        made = F.when((acc["last"] == 0) | (acc["last"] < m["ccc"]), F.try_element_at(pairs, F.concat(acc["base"], m["to"])))
        return F.when(made.isNotNull(), F.struct(made.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["base"].alias("base"), F.concat(acc["rest"], m["to"]).alias("rest"), m["ccc"].alias("last"))
        )

    return F.aggregate(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), first, step, lambda acc: F.concat(acc["base"], acc["rest"]))


def consistent_forms(texts: DataFrame, col: str = "text", keys: bool = True) -> DataFrame:
    """(text, form) of the distinct non-null texts that the mapping may change; ``form`` is their key if ``keys``. All others
    are their own form and key."""
    spark = texts.sparkSession
    points, clusters = _mapping_tables(spark, keys)
    # partitioned by text from here on: no step below moves a row again
    work = texts.select(F.col(col).alias("text")).where(F.col("text").rlike(needs_work_pattern())).distinct()
    order = Window.partitionBy("text").orderBy("pos", "sub")
    exploded = work.select("text", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    # the parts of a syllable stay with its lead, as marks do with their base
    before = F.lag("to").over(order)
    joins = (F.col("to").between(chr(_V), chr(_V + _NV - 1)) & before.between(chr(_L), chr(_L + 18))) | (F.col("to").between(chr(_T + 1), chr(_T + _NT - 1)) & before.between(chr(_V), chr(_V + _NV - 1)))
    marks = (
        exploded.join(points, "ch", "left")
        .select("text", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("to", "ch").alias("to"), F.coalesce("ccc", F.lit(0)).alias("ccc"))
        .where("to <> ''")
        .withColumn("new", F.when((F.col("ccc") == 0) & ~F.coalesce(joins, F.lit(False)), 1).otherwise(0))
        .withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    ordered = (
        marks.groupBy("text", "grp")
        .agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "to"))).alias("m"))
        .withColumn("cluster", F.array_join(F.transform("m", lambda x: x["to"]), ""))
    )
    # a base with one mark, or a syllable, is looked up; what has more marks is composed mark by mark
    pairs = F.create_map(*[F.lit(x) for pair in mapping(keys)[1] if not "\u1100" <= pair[0][0] <= "\u1112" for x in pair])
    several = F.when(F.size("m") > 2, _compose(F.col("m"), pairs))
    return (
        ordered.join(clusters, "cluster", "left")
        .withColumn("c", F.coalesce("composed", several, "cluster"))
        .groupBy("text")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "c"))), lambda x: x["c"]), "").alias("form"))
        .select("text", _ends(F.col("form")).alias("form"))
    )


def in_context(form: Column) -> Column:
    """Look-alikes of other scripts put right where their neighbours tell: letters of another alphabet in words that have Latin
    ones, kanji and dashes within a run of katakana (or at the end of a text that is one), and single katakana behind kanji."""
    latin = _pairs(CYRILLIC) | _pairs(GREEK)
    kana = {a: b for a, b in _pairs(KANA).items() if "ァ" <= b <= "ー" and not "ぁ" <= a <= "ん"}
    kanji = {b: a for a, b in kana.items() if "一" <= a <= "鿿" and "ァ" <= b <= "ヶ" and a not in "囗乂匕"}
    odd = "".join(latin)
    run, beside = "[ァ-ヺー]", "(?=[ァ-ヺー]|[\\s)）、。]|$)"

    def letters(x: Column) -> Column:
        for a, b in latin.items():
            x = F.regexp_replace(x, f"(?<=[A-Za-z]){a}|{a}(?=[{odd}]*[A-Za-z])", b)
        return x

    def japanese(x: Column) -> Column:
        for a, b in kana.items():
            x = F.regexp_replace(x, f"(?<={run}){a}{beside}|(?<![^\\s(（]){a}(?={run}{{2}})" if a not in "一―—─" else f"(?<=[ァ-ヺ]){a}{beside}", b)
        for a, b in kanji.items():
            x = F.regexp_replace(x, f"(?<=[一-鿿]){a}(?!{run})", b)
        return x

    at = let(form, lambda x: F.when(x.rlike(f"[{odd}]"), letters(x)).otherwise(x))
    return let(at, lambda x: F.when(x.rlike(f"[{''.join(kana)}{''.join(kanji)}]"), japanese(x)).otherwise(x))


def unify(df: DataFrame, col: str, out: str = "form", keys: bool = False) -> DataFrame:
    """``df`` with the consistent form of ``col`` in ``out``, or what it is compared by. Texts that vanish entirely become empty."""
    made = consistent_forms(df, col, keys)
    made = made.select(F.col("text").alias("__t"), (F.col("form") if keys else in_context(F.col("form"))).alias("__f"))
    joined = df.join(small_or_not(made, "forms"), df[col] == F.col("__t"), "left")
    changed = F.when(F.col(col).rlike(needs_work_pattern()), F.coalesce("__f", F.lit("")))
    return joined.withColumn(out, F.coalesce(changed, _ends(F.col(col)))).drop("__t", "__f")


def matching_terms(occurrences: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, row_id, pos, term_id) of the occurrences (with ``text``) that look like a term but are not its characters."""
    t = unify(terms.where("term is not null").select("term_id", "term"), "term", keys=True)
    t = small_or_not(t, "terms")
    work = consistent_forms(occurrences)
    plain = F.coalesce(~F.col("text").rlike(needs_work_pattern()), F.lit(False))
    # what looks like a term: few of the distinct texts
    shared = materialize(work.join(t, "form").where("text <> term").select("text", "term_id"), "odd")
    hint = F.broadcast(shared) if is_small(shared) else shared
    got = occurrences.where("text is not null").join(hint, "text").select("src", "row_id", "pos", "term_id")
    same = occurrences.where(plain).withColumn("form", _ends(F.col("text"))).join(t, "form").where("text <> term").select("src", "row_id", "pos", "term_id")
    return got.unionByName(same).distinct()
