"""Predicates and features of text that looks like formulas. Booleans are null for null text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, fold, lines_of, strip

# Words, signs and character ranges of the classifiers.
RATIO_WORDS = ("比率", "割合", "分数", "率", "比")
FRACTION_SIGNS = r"[/÷×%％]"
EQUATION_SIGNS = r"[=≒≠]"
OPERATORS = r"[-+×÷=/%^·]"
BASE = r"(?U)\([0-9]{1,3}\)\s*[0-9]{0,3}|[_^][0-9]+"
SCRIPT = r"[\x{3040}-\x{9FFF}]"
JAPANESE = r"[\x{3000}-\x{30FF}\x{3400}-\x{9FFF}]"
MATH_SIGNS = r"[∑Σ∫√≤≥≈≒≠∞]"
FORMULA_CHARS = (
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ=+-*/×÷·・.,;:!?'\"|^_`~\\()[]{}<>«»＃％＆＠＄＋－＝～‖∥∠≒≈≡≤≥∞∫∑∏√∇°′″→←↔⇒⇔±‰℃πΠΣΩΔΛαβγδεζηθικλμνξοπρστυφχψω"
)


def math_features(text: Column) -> Column:
    """PRD-02: struct of operators, digits, their share, and whether a base or sub- or superscript is marked."""
    digits = F.regexp_count(text, F.lit(r"\p{Nd}"))
    return F.struct(
        F.regexp_count(text, F.lit(OPERATORS)).alias("ops"),
        digits.alias("digits"),
        (digits / F.greatest(F.lit(1), F.length(text))).alias("digit_ratio"),
        text.rlike(BASE).alias("has_base"),
    )


def any_word(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def looks_math(text: Column, words: Sequence[str] = RATIO_WORDS) -> Column:
    """PRD-01."""
    f = math_features(text)
    by_count = (f["has_base"] & (f["digits"] >= 4)) | ((f["ops"] >= 1) & (f["digits"] >= 2)) | ((f["digit_ratio"] >= 0.4) & (f["digits"] >= 6))
    return ~text.rlike("(?i)https?://") & (any_word(text, words) | by_count)


def fraction_like(text: Column, words: Sequence[str] = RATIO_WORDS) -> Column:
    """PRD-04."""
    return text.rlike(EQUATION_SIGNS) & text.rlike(FRACTION_SIGNS) & any_word(text, words)


def noisy_dollar(text: Column, script: str = SCRIPT) -> Column:
    """PRD-05."""
    return (count_of(text, "$") >= 2) & text.rlike(script)


def issue(line: Column, words: Sequence[str] = RATIO_WORDS, script: str = SCRIPT) -> Column:
    """PRD-06: the first reason that holds for a line, else null."""
    s = strip(line)
    return F.when(s == "", F.lit(None).cast("string")).when(fraction_like(s, words), "fraction_like").when(noisy_dollar(s, script), "noisy_dollar")


def formula_block(line: Column) -> Column:
    """PRD-07."""
    s = strip(line)
    body = strip(F.replace(F.replace(s, F.lit("<br>"), F.lit("")), F.lit("　"), F.lit("")))
    total, math, ja = F.length(body), F.length(body) - F.length(F.translate(body, FORMULA_CHARS, "")), F.regexp_count(body, F.lit(JAPANESE))
    breaks = count_of(s, "<br>")
    share = math / total
    veto = s.rlike(r"^(?:#|《|<img|問|- |\* )")
    equation = body.rlike(r"\p{Nd}") & body.rlike("[=＝≒≈≡∝]") & (math >= ja + 2)
    return (
        F.when((s == "") | veto, F.lit(False))
        .when(s.startswith("$$") & s.endswith("$$"), F.lit(True))
        .when(body == "", F.lit(False))
        .otherwise(((breaks >= 2) & (share >= 0.5)) | equation | ((share >= 0.75) & (ja <= 2) & (total <= 160)))
    )


def has_math(text: Column) -> Column:
    """PRD-08: whether any line of the text shows math."""
    one = lambda x: (count_of(x, "$") >= 2) | x.contains("\\(") | x.contains("\\[") | (count_of(x, "^") >= 2) | (count_of(x, "_") >= 2) | x.rlike(MATH_SIGNS)
    return F.exists(lines_of(text), one)


def sparse(text: Column, least: int = 30) -> Column:
    """PRD-09: fewer than ``least`` meaningful characters outside image tags."""
    rest = strip(F.replace(fold(text, [(r"<img[^>]+>", "")]), F.lit("\\g<1>"), F.lit("")))
    return F.regexp_count(rest, F.lit(r"[A-Za-z0-9\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")) < least


def recognized_or_other(text: Column, other: Column, merge: bool = False) -> Column:
    """ORC-08: another recognizer's text in place of a sparse one, or appended behind a mark."""
    filled = strip(other)
    if merge:
        return F.when(filled != "", F.concat(text, F.lit("\n\n<!-- tesseract -->\n\n"), filled)).otherwise(text)
    return F.when(sparse(text) & (filled != ""), filled).otherwise(text)
