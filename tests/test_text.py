"""Text functions: literal cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import cells as C
from inkwell.functions import formulas as M
from inkwell.functions import text as T


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_plain_text(spark):
    cases = {
        "before ![](./figures/a.png) after": "before [画像: ./figures/a.png] after",
        'x <img src="./figures/a.png" width="10"> y': "x [画像: ./figures/a.png] y",
        "|A|B|\n|---|---|\n|1|2|\n": "A\tB\n1\t2",
        "数学$mathematics$ と $x+y$": "数学mathematics と x+y",
        "para\n\n# H": "para\nH",
        "|---|\n|a|b|": "---\na\tb",
        "[t](u) `c` **b** __u__ *e* _i_ > q": "t c b u e i > q",
        "```py\ncode\n```": "code",
        "a\n\n\n\nb<br>c <b>d</b>": "a\n\nb\nc d",
        r"\(x\) \[ y \] $$ z $$": "x y z",
        "": "", "  ": "",
    }
    assert apply(spark, T.plain_text, list(cases)) == list(cases.values())
    assert apply(spark, T.plain_text, [None]) == [""]


def test_clean_line(spark):
    cases = {
        "10 × 10^3 回/秒 × 16ビット/回": "10 × 10^3 回/秒 × 16ビット/回",
        "$log^{2} n$": "log_2 n",
        " $$ ": "",
        r"\-\+ a\\b ’": "-+ a '",  # what is left of an escape reads as a command
        "see www.x.y/$a$<br>": "see www.x.y/a",
        'a <img src="x.png"> b': 'a\\n\\n<img src="x.png"> b',
        "・item": "- item",
        "目次 ... 50": "目次 （p.50）",
        r"\frac{1}{2} \text{ab} \alpha": "(1)/(2) ab ",
        "the details are": "the <details> are",
        "![](./page_$images/a$b.png)": "![](./page_images/ab.png)",
        "x \\g<1> y": "x <1> y",
    }
    assert apply(spark, T.clean_line, list(cases)) == list(cases.values())


def test_clean_document(spark):
    got = apply(spark, T.clean_document, ["$$ $n+11-a$ $$\n2", "# Page 1\n# A\n\n# Page 2\n# B <br> c", "# A\n# Page 3", "", None])
    assert got == ["n+11-a\n2", "# Page 1\n## A\n# Page 2\n## B\nc", "# A\n# Page 3", "", None]
    assert "$" not in got[0]


def test_headings_and_lines(spark):
    assert apply(spark, T.normalize_heading, ["# $1-2-3$ a<br>b", "## $1-2$", "# x"]) == ["### 1-2-3 a b", "## 1-2", "# x"]
    assert apply(spark, T.lines_of, ["a\r\nb\n", "", "\n", "a\n\nb", "x\x85y z", None]) == ["a\r\nb\n".splitlines(), [], [""], ["a", "", "b"], ["x", "y", "z"], None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="a \n\r\t\x85　|", max_size=9), min_size=1, max_size=20))
def test_lines_and_strip_are_those_of_python(spark, texts):
    assert apply(spark, T.lines_of, texts) == [t.splitlines() for t in texts]
    assert apply(spark, T.strip, texts) == [t.strip() for t in texts]


def test_links_and_math(spark):
    assert apply(spark, T.image_tags, ['<img src="a.png" alt="z">', '<IMG class=x src="b.png">']) == ["![](a.png)", "![](b.png)"]
    assert apply(spark, T.sanitize_math, [r"a \(x\-1\) b \[y\=2\]", "none"]) == ["a $x-1$ b $$y=2$$", "none"]
    df = spark.createDataFrame([('![](figures/o.png) <img src="o.png"> raw o.png',), ("x",)], "t string").withColumn("m", F.create_map(F.lit("o.png"), F.lit("n.png")))
    got = [r.x for r in df.select(T.rewrite_links(F.col("t"), F.col("m")).alias("x")).collect()]
    assert "./figures/n.png" in got[0] and "o.png" not in got[0] and got[1] == "x"
    assert apply(spark, lambda c: T.remove_figure(c, F.lit("f(1).png")), ["a ![x](./figures/f(1).png) b <img src=\"figures/f(1).png\"> c"]) == ["a  b  c"]
    assert apply(spark, lambda c: T.render_formula(c, F.lit(True)), ["$$x$$", "$y$", " z "]) == ["$$\nx\n$$", "$$\ny\n$$", "$$\nz\n$$"]
    assert apply(spark, T.match_form, [r"A \text{b} $x_1$ [C]"]) == ["abx1c"]
    assert apply(spark, T.run_text, ["A $x+y$ B", "$$", "a<br>b"]) == ["A x+y B", None, "a\nb"]
    assert apply(spark, lambda c: T.apply_templates(c, T.FORMULA_PACK[:1]), ["1 / 2 and a/3/4"]) == [r"$\frac{1}{2}$ and a/3/4"]


def test_formulas(spark):
    math = {"(10) 1234": True, "1+2": True, "x+2": False, "12+3": True, "1234567": True, "比率": True, "http://a 1+23": False, "plain": False, "": False}
    assert apply(spark, M.looks_math, list(math)) == list(math.values())
    assert apply(spark, M.issue, ["稼働率 = 1 / 2", "$a$ と b", "a = b", " ", "比率"]) == ["fraction_like", "noisy_dollar", None, None, None]
    block = {"$$x$$": True, "# 1=2": False, "- 1": False, "x = 12 + 3": True, "表の説明です": False, "a<br>1<br>2": True, "": False, "　": False, "問1 x": False}
    assert apply(spark, M.formula_block, list(block)) == list(block.values())
    assert apply(spark, M.has_math, ["a\n$x$", "a_b_c", "plain", "≒", ""]) == [True, True, False, True, False]
    assert apply(spark, M.sparse, ["a" * 29 + '<img src="bbbbbb">', "字" * 30, ""]) == [True, False, True]
    assert apply(spark, lambda c: M.recognized_or_other(c, F.lit(" alt ")), ["x", "y" * 40]) == ["alt", "y" * 40]
    assert apply(spark, lambda c: M.recognized_or_other(c, F.lit("alt"), merge=True), ["x"]) == ["x\n\n<!-- tesseract -->\n\nalt"]


def test_typed_values(spark):
    cases = {"1,234": ("int", 1234), "1234": ("float", 1234.0), "1,5": ("float", 15.0), "12,34": ("float", 1234.0), ".5": ("float", 0.5), "1,234.5": ("text", None), "12.5%": ("percent", 0.125), "50 %": ("percent", 0.5), "007": ("int", 7), "１２": ("int", 12), "-": ("text", None), "1.2.3%": ("text", None)}
    got = apply(spark, C.typed_value, list(cases))
    assert [(r.kind, r.i if r.kind == "int" else r.d) for r in got] == list(cases.values())
    assert [r.fmt for r in apply(spark, C.typed_value, ["12.5%", "50 %", "1,234", "1.5", "2024-1-5"])] == ["0.0%", "0%", "#,##0", "#,##0.00", "yyyy/mm/dd"]
    assert str(apply(spark, C.typed_value, ["2024-1-5"])[0].dt) == "2024-01-05"
    assert apply(spark, C.typed_value, [None]) == [None]


def test_names(spark):
    f = F.lit("fb")
    assert apply(spark, lambda c: C.sheet_title(c, f), ["a[b]:c", "'x'", "", None, "y" * 40]) == ["a_b__c", "x", "fb", "fb", "y" * 31]
    assert apply(spark, lambda c: C.table_name(c, f), ["a b--c", "1x", "校"]) == ["a_b_c", "_1x", "fb"]
    assert apply(spark, lambda c: C.file_name(c, f), ["A校", "con", "..a..", "a/b"]) == ["_校", "_con", "a", "a_b"]
    assert apply(spark, C.page_range, ["foo_p3-9", "foo_p3", "a_p1-2_p4-7", "x"]) == ["p3-9", None, "p4-7", None]
    assert apply(spark, C.width_mm, ['width="96px"', "width=2cm", 'width="5mm"', "x"]) == [pytest.approx(25.4), pytest.approx(20), pytest.approx(5), None]
    assert apply(spark, C.input_kind, ["a.PNG", "b/c.pdf", "d.txt", ".png"]) == ["image", "pdf", "unsupported", "unsupported"]
    assert apply(spark, C.width_bucket, [8, 20, 40, 41], "int") == [10, 18, 28, 40]


def test_arguments(spark):
    args = [["--start", "3", "--end=9"], ["--end", "x"], []]
    assert apply(spark, lambda c: C.cli_value(c, "end"), args, "array<string>") == ["9", "x", None]
    assert apply(spark, lambda c: C.cli_int(c, "end"), args, "array<string>") == [9, None, None]


def test_table_rows(spark):
    got = apply(spark, C.table_rows, [["|a|b|", "|---|---|", "|-|", "|1<br>2|"], ["|-|-|"]], "array<string>")
    assert got == [[["a", "b"], ["1\n2", ""]], [["", ""]]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab 漢。\n", max_size=12), min_size=1, max_size=12))
def test_plain_text_of_plain_text(spark, texts):
    once = apply(spark, T.plain_text, texts)
    assert apply(spark, T.plain_text, once) == once
    assert once == [re.sub(r"\n{3,}", "\n\n", "\n".join(t.splitlines())).strip() for t in texts]


@pytest.mark.parametrize("deep", [1, 7, 20])
def test_delimiters_of_any_depth(spark, deep):
    """As the loops that run until nothing changes any more."""

    def loop(text, rules):
        before = None
        while before != text:
            before = text
            for p in rules:
                text = re.sub(p, lambda m: m.group(1).strip(), text)
        return text

    nested = "\\(" * deep + " x " + "\\)" * deep + " $$ $a" * deep + "$ $$" * deep
    math = [r"\$\$([\s\S]+?)\$\$", r"\\\(([\s\S]+?)\\\)", r"\\\[([\s\S]+?)\\\]", r"\$([^$]+)\$"]
    got = spark.createDataFrame([(nested,)], "t string").select(T.math_delimiters(F.col("t")).alias("a"), T.strip_tex(F.col("t")).alias("b")).first()
    assert got.a == loop(nested, math)
    inner = re.sub(math[0], lambda m: m.group(1).strip(), nested.replace("\\(", "").replace("\\)", ""))
    before = None
    while before != inner:
        before, inner = inner, re.sub(r"\$([^$]+)\$", lambda m: m.group(1), inner)
    assert got.b == inner
