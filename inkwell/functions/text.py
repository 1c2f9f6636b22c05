"""Text functions: string columns to string columns, all of them built-in expressions.

Patterns, their order and what they put in are fixed values where results must agree with an existing corpus. White
space is Unicode white space, ``^`` and ``$`` in multi-line patterns stand at newlines only. Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]

def fold(text: Column, rules: Sequence[Rule]) -> Column:
    """The rules one after another."""
    for pattern, to in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def settle(text: Column, step: Callable[[Column], Column], marks: Sequence[str]) -> Column:
    """``step`` again and again until the text stays as it is.

    A round that changes the text takes at least two of its ``marks`` away, so their number bounds the rounds: no text is
    left half done, however deep its marks are nested. Rounds behind the last change do nothing.
    """
    rounds = sum((count_of(text, m) for m in marks), F.lit(1))
    start = F.struct(text.alias("t"), F.lit(False).alias("done"))

    def once(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(let(step(acc["t"]), lambda y: F.struct(y.alias("t"), (y == acc["t"]).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, once, lambda acc: acc["t"])


# Fixed value: white space.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def count_of(text: Column, literal: str) -> Column:
    """Occurrences of a literal string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


# Fixed value: what ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def lines_of(text: Column) -> Column:
    """The lines of a text; a line end at the very end begins no further line, an empty text has none."""
    return let(F.split(text, LINE_ENDS), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def markdown_lines(text: Column) -> Column:
    """SRC-18: CRLF made LF, then lines."""
    return lines_of(F.replace(text, F.lit("\r\n"), F.lit("\n")))


# ---- cleaning of recognized Markdown

# Patterns of the cleaning steps, in their order.
UNESCAPE: list[Rule] = [(r"\\([-+={}()\[\]<>$\\])", "$1"), (r"\\\\", r"\\")]
URL = r"(?U)https?://\S+|www\.\S+"
TEX_BLOCK: Rule = (r"\$\$(?:(?U:\s+)|(?U:\s*)([\s\S]+?)(?U:\s*))\$\$", "$1")
TEX_INLINE: Rule = (r"\$([^$]+)\$", "$1")
TEX_REST: list[Rule] = [
    (r"\\text\{([^}]*)\}", "$1"),
    (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "($1)/($2)"),
    (r"(?U)([A-Za-z]+)\s*[_^]\s*\{?(\d+)\}?", "$1_$2"),
    (r"[{}]", ""),
    (r"\\[A-Za-z]+", ""),
]
#: The second template needs a newline inside a line and so never applies to single lines; both put in literal text.
TEMPLATES: list[Rule] = [(r"(?U)(?<!\n)\s*<img", r"\\n\\n<img"), (r"(?U)(?<=\S)\n(\s*[-*+]\s+)", r"\\n\\n\\g<1>")]
LAYOUT_MARKS: list[Rule] = [
    (r"(?U)\s*<br>\s*", "\n"),
    (r"(?U)(<img[^>]+>)\s*\n+", "$1\n"),
    (r"(?U)\.{3}\s*(\d+)", "（p.$1）"),
    (r"(?Umd)^(\s*)[・●○◆■◇□▶▷]\s*", "$1- "),
    (r"(?U)^\s*[-*]\s*(?:[□■◯○●◆◇▶▷・\-]?\s*)?\$(\d+(?:-\d+)+)\$\s*$", "- $1"),
    (r"(?U)^\s*[-*]\s*(?:[□■◯○●◆◇▶▷・\-]?\s*)?\$(\d+(?:-\d+)+)\$\s*(.*?)\s*$", "- $1 $2"),
    (r"\n{3,}", "\n\n"),
]
STRAY_MARKERS: list[Rule] = [
    (r"(?iU)(?:\\g(?:<\d+>)?|\$\d+)\s*(?=(?:<)?img\b|<br>|\bbr\b)", ""),
    (r"(?iU)((?:<)?img[^>]*>|<br>|\bbr\b)\s*(?:\\g(?:<\d+>)?|\$\d+)", "$1"),
]
HTML_TOKENS: list[Rule] = [
    (r'(?iU)(?<!<)(img\s+src="[^"]+"(?:[^>\n]*[^>\s])?)[^>\n]*', "<$1>"),
    (r"(?U)(?<!\w)br(?!\w)", "<br>"),
    (r"(?i)(?<!<)details(?!>)", "<details>"),
    (r"(?i)(?<!<)/details(?!>)", "</details>"),
    (r"(?i)(?<!<)summary(?!>)", "<summary>"),
    (r"(?i)(?<!<)/summary(?!>)", "</summary>"),
    (r"(?i)<img([^>]*?)<br>[^>]*>", "<img$1><br>"),
    (r"(?i)(<img[^>\n]*)(?<!/)>?", "$1>"),
    (r"(?iU)\$\$\s*/details\s*\$\$", "</details>"),
    (r"(?i)(?<!<)/details(?!>)", "</details>"),
    (r"(?i)(?<!<)details(?!>)", "<details>"),
    (r"(?i)(?<!<)/summary(?!>)", "</summary>"),
    (r"(?i)<summary>([^<]*?)/<summary>", "<summary>$1</summary>"),
]
FINAL_TOKENS: list[Rule] = [
    (r"(?iU)\$\$\s*/details\s*\$\$", "</details>"),
    (r"(?iU)\$\$\s*details\s*\$\$", "<details>"),
    (r"(?iU)\$\$\s*/summary\s*\$\$", "</summary>"),
    (r"(?iU)\$\$\s*summary\s*\$\$", "<summary>"),
    (r"<br>", "\n"),
]
MEDIA_PATH = r"(\./(?:(?:figures)|(?:page[_$]*images))/[^)\s]+)"
BACK_REFERENCE: Rule = (r"(?U)\s*\\g(?:<\d+>)?\s*", " ")


def unescape(text: Column) -> Column:
    """TXT-02, TXT-03."""
    return F.replace(fold(text, UNESCAPE), F.lit("’"), F.lit("'"))


def strip_tex(text: Column) -> Column:
    """TXT-05: delimiters and commands of TeX away, their contents kept."""
    for mark in ("\\[", "\\]", "\\(", "\\)"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    bare = let(text, lambda t: F.when(F.instr(t, "$") > 0, let(fold(t, [TEX_BLOCK]), lambda b: settle(b, lambda x: fold(x, [TEX_INLINE]), ["$"]))).otherwise(t))
    return fold(bare, TEX_REST)


def apply_templates(text: Column, rules: Sequence[Rule] = TEMPLATES) -> Column:
    """TXT-06: a rule pack folded over the text."""
    return fold(text, rules)


def normalize_heading(text: Column) -> Column:
    """TXT-07: ``# $1-1-1$ title`` gets as many marks as its number has parts, six at most."""
    pattern = r"(?U)^(#+)\s+\$(\d+(?:-\d+)+)\$\s*(.*)$"

    def one(t: Column) -> Column:
        s = strip(t)
        number, title = F.regexp_extract(s, pattern, 2), strip(F.replace(F.regexp_extract(s, pattern, 3), F.lit("<br>"), F.lit(" ")))
        level = F.least(F.lit(6), F.size(F.split(number, "-")))
        made = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""))
        return F.when(s.rlike(pattern), made).otherwise(t)

    return let(text, one)


def layout_marks(text: Column) -> Column:
    """TXT-08."""
    return fold(text, LAYOUT_MARKS)


def stray_markers(text: Column) -> Column:
    """TXT-09, first part: left-over references around media."""
    return fold(text, STRAY_MARKERS)


def html_tokens(text: Column) -> Column:
    """TXT-10: tags that lost their brackets."""
    return fold(text, HTML_TOKENS)


def final_tokens(text: Column) -> Column:
    return fold(text, FINAL_TOKENS)


def media_paths(text: Column) -> Column:
    """TXT-11: no dollar signs inside media paths."""

    def one(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(MEDIA_PATH), 1))
        return F.when(F.instr(t, "$") > 0, F.aggregate(found, t, lambda acc, p: F.replace(acc, p, F.replace(p, F.lit("$"), F.lit(""))))).otherwise(t)

    return let(text, one)


#: What any of the steps needs to change a line: without it they are passed by.
TOUCHED = r"(?i)[\\$<{}_^’・●○◆■◇□▶▷\n]|\.{3}|\bbr\b|img|details|summary"


def clean_line(line: Column) -> Column:
    """TXT-01: one recognized line through all steps."""

    def full(text: Column) -> Column:
        # lines with an address are left alone but for line breaks and dollar signs (TXT-04)
        url = media_paths(F.replace(F.replace(text, F.lit("<br>"), F.lit("")), F.lit("$"), F.lit("")))
        rest = media_paths(html_tokens(stray_markers(layout_marks(normalize_heading(apply_templates(strip_tex(text)))))))
        return F.when(text.rlike(URL), url).otherwise(fold(rest, [BACK_REFERENCE]))

    def one(x: Column) -> Column:
        return F.when(~x.rlike(TOUCHED), x).when(strip(x) == "$$", "").otherwise(let(unescape(F.regexp_replace(x, r"\n+$", "")), full))

    return let(line, one)


PAGE_HEADING = r"(?U)^#\s+Page\s+(\d+)\s*$"
H1 = r"(?U)^(\s*)#\s+(.+)$"


def demote_headings(lines: Column) -> Column:
    """WIN-01 on an array of lines: after the first page heading, other first-level headings become second-level."""
    start = F.struct(F.lit(False).alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        page = strip(line).rlike(PAGE_HEADING)
        inner = F.concat(F.regexp_extract(line, H1, 1), F.lit("## "), strip(F.regexp_extract(line, H1, 2)))
        return F.struct((acc["seen"] | page).alias("seen"), F.concat(acc["out"], F.array(F.when(~page & acc["seen"] & line.rlike(H1), inner).otherwise(line))).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def clean_document(text: Column) -> Column:
    """TXT-12: lines cleaned, lines that became empty dropped, inner headings demoted, placeholders finished."""
    cleaned = F.filter(F.transform(lines_of(text), clean_line), lambda x: x != "")
    # a cleaned line may hold several lines
    return final_tokens(F.array_join(demote_headings(lines_of(F.array_join(cleaned, "\n"))), "\n"))


# ---- plain text

# Patterns of the steps to plain text, in their order.
PLAIN_BLOCKS: list[Rule] = [
    (r"<br>", "\n"),
    (r"(?md)^```[^\n]*$", ""),
    (r"(?md)^```$", ""),
    (r'(?i)<img[^>]*src="([^"]+)"[^>]*>', "[画像: $1]"),
    (r"!\[[^\]]*\]\(([^)]+)\)", "[画像: $1]"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?Umd)^\s{0,3}#{1,6}\s+", ""),
    (r"(?Umd)^\s{0,3}>\s?", ""),
    (r"(?Umd)^\s{0,3}(-{3,}|\*{3,}|_{3,})\s*$", ""),
]
PLAIN_INLINE: list[Rule] = [(r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"_([^_]+)_", "$1")]
PLAIN_END: list[Rule] = [(r"</?[^>]+>", ""), (r"\n{3,}", "\n\n")]
DIVIDER = r"(?U)^\s*\|?(?:\s*:?[-]{2,}:?\s*\|)+\s*:?[-]{2,}:?\s*\|?\s*$"
TABLE_ROW = r"(?U)^\s*\|.+\|\s*$"
MATH_DELIMITERS: list[Rule] = [
    (r"\$\$(?:(?U:\s+)|(?U:\s*)([\s\S]+?)(?U:\s*))\$\$", "$1"),
    (r"\\\((?:(?U:\s+)|(?U:\s*)([\s\S]+?)(?U:\s*))\\\)", "$1"),
    (r"\\\[(?:(?U:\s+)|(?U:\s*)([\s\S]+?)(?U:\s*))\\\]", "$1"),
    (r"\$(?:(?U:\s+)|(?U:\s*)([^$]+?)(?U:\s*))\$", "$1"),
]


def math_delimiters(text: Column) -> Column:
    """TXT-14: math delimiters away, again and again, bodies trimmed."""
    return let(text, lambda t: F.when(t.rlike(r"\$|\\[(\[]"), settle(t, lambda x: fold(x, MATH_DELIMITERS), ["$", "\\"])).otherwise(t))


def split_row(line: Column) -> Column:
    """TXT-16: the cells of a table line."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def row_to_tsv(line: Column) -> Column:
    """TXT-15."""
    return rstrip(F.array_join(split_row(line), "\t"))


#: What any of the steps to plain text needs to change a text beyond its ends: without it they are passed by.
PLAIN_TOUCHED = r"[<>`!\[\]#\-*_|$\\\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def plain_text(markdown: Column) -> Column:
    """TXT-13: Markdown to plain text. Null is an empty text."""

    def full(t: Column) -> Column:
        text = fold(t, PLAIN_BLOCKS)
        rows = F.transform(F.filter(lines_of(text), lambda x: ~x.rlike(DIVIDER)), lambda x: F.when(x.rlike(TABLE_ROW) & (count_of(x, "|") >= 2), row_to_tsv(x)).otherwise(x))
        return strip(fold(math_delimiters(fold(F.array_join(rows, "\n"), PLAIN_INLINE)), PLAIN_END))

    return let(F.coalesce(markdown, F.lit("")), lambda t: F.when(t.rlike(PLAIN_TOUCHED), full(t)).otherwise(strip(t)))


# ---- figures and formulas in Markdown


def image_tags(text: Column) -> Column:
    """TXT-17: HTML images to Markdown images."""
    return F.regexp_replace(text, r'(?i)<img[^>]*?src="([^"]+)"[^>]*?(?:alt="([^"]*)")?[^>]*?>', "![$2]($1)")


def sanitize_math(text: Column) -> Column:
    """TXT-18: ``\\(..\\)`` to ``$..$``, ``\\[..\\]`` to ``$$..$$``, operators in their bodies un-escaped."""
    pattern = r"(?s)(\\\(|\\\[)(.*?)(\\\)|\\\])"

    def one(m: Column) -> Column:
        body = F.substring(m, F.lit(3), F.length(m) - 4)
        for a, b in (("\\-", "-"), ("\\+", "+"), ("\\×", "\\\\times "), ("\\÷", "\\\\div "), ("\\=", "=")):
            body = F.replace(body, F.lit(a), F.lit(b))
        mark = F.when(m.startswith("\\["), "$$").otherwise("$")
        return F.concat(mark, body, mark)

    return let(text, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 0)), t, lambda acc, m: F.replace(acc, m, one(m))))


def rewrite_links(text: Column, names: Column) -> Column:
    """TXT-19: figure links to new names. ``names``: map of old to new names."""

    def one(acc: Column, e: Column) -> Column:
        old, new = e["key"], F.concat(F.lit("./figures/"), e["value"])
        for before in ("figures/", "./figures/", ""):
            acc = F.replace(acc, F.concat(F.lit('src="' + before), old, F.lit('"')), F.concat(F.lit('src="'), new, F.lit('"')))
        for before in ("figures/", "./figures/", ""):
            acc = F.replace(acc, F.concat(F.lit("](" + before), old, F.lit(")")), F.concat(F.lit("]("), new, F.lit(")")))
        for before in ("figures/", "./figures/", ""):
            acc = F.replace(acc, F.concat(F.lit(before), old), new)
        return acc

    return F.when(names.isNull() | (F.size(names) == 0), text).otherwise(F.aggregate(F.map_entries(names), text, one))


def remove_figure(text: Column, name: Column) -> Column:
    """TXT-20: references to one figure away."""
    q = F.concat(F.lit("\\Q"), name, F.lit("\\E"))
    pattern = F.concat(F.lit(r"!\[[^\]]*\]\((?:\./)?figures/"), q, F.lit(r'\)|<img[^>]+src="(?:\./)?figures/'), q, F.lit(r'"[^>]*>'))
    return F.regexp_replace(text, pattern, F.lit(""))


def match_form(text: Column) -> Column:
    """TXT-21: what texts are compared by: lower case, no markup characters, no white space."""
    return fold(F.lower(text), [(r"\\text\{([^}]*)\}", "$1"), (r"[$`~^\\{}_*\[\]()<>|]", ""), (r"(?U)\s+", "")])


def render_formula(latex: Column, isolated: Column) -> Column:
    """TXT-22."""
    s = strip(latex)
    bare = (
        F.when(s.startswith("$$") & s.endswith("$$"), strip(F.substring(s, F.lit(3), F.greatest(F.length(s) - 4, F.lit(0)))))
        .when(s.startswith("$") & s.endswith("$"), strip(F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))))
        .otherwise(s)
    )
    return F.when(isolated, F.concat(F.lit("$$\n"), bare, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), bare, F.lit("$")))


def run_text(text: Column) -> Column:
    """TXT-30: text of a run in a document; null if nothing is left."""
    t = F.replace(text, F.lit("<br>"), F.lit("\n"))
    return F.nullif(F.when(strip(t) == "$$", "").otherwise(strip_tex(t)), F.lit(""))


# Fixed values (TXT-29): a rule pack for inline formulas that callers may apply with apply_templates.
FORMULA_PACK: list[Rule] = [
    (r"(?U)(?<![\w/])(\d+)\s*/\s*(\d+)(?![\w/])", r"\$\\frac{$1}{$2}\$"),
    (r"(?U)(?<![\w/])(\d+)\s*[:：]\s*(\d+)(?![\w/])", "$1 : $2"),
    (r"(?U)(\w+)\s*\^\s*(\d+)", "$1^{$2}"),
    (r"(?U)v\s*\{\s*(\d+)\s*\}", r"\\sqrt{$1}"),
    (r"(?U)([a-zA-Z])\s*_\s*(\d+)", "$1_{$2}"),
    (r"(?U)(\d)\s*%", "$1%"),
    (r"(?U)\s*([<>])\s*", " $1 "),
    (r"(?U)\s*\\frac\s*\{(.*?)\}\s*\{(.*?)\}\s*", r" \$\\frac{$1}{$2}\$ "),
    (r"(?U)(?<=\d)\s*([+\-*/])\s*(?=\d)", "$1"),
]
