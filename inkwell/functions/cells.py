"""Functions of table cells, names and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Symbols of marked cells, what they are normalized to, and the shapes of typed values.
SYMBOLS = "○〇◯◎△▲▼×✕xX□■●"
SYMBOL_FORMS = {"✕": "×", "x": "×", "X": "×", "〇": "○", "◯": "○", "O": "○", "o": "○", "0": "○", "口": "□", "■": "■", "□": "□", "●": "●"}
PERCENT = r"(?U)^\s*-?\d+[\d,.]*\s*%\s*$"
INTEGER = r"(?U)^\s*-?\d{1,3}(?:,\d{3})*\s*$"
FLOAT = r"(?U)^\s*-?\d*[.,]?\d+\s*$"
DATES = ("-", "/", ".")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
WIDTHS = ((8, 10), (20, 18), (40, 28))
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp", ".heic", ".heif", ".svg")
CONVERTED_SUFFIXES = (".heic", ".heif", ".svg")

TYPED = "struct<kind:string,i:bigint,d:double,dt:date,s:string,fmt:string>"


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def typed_value(text: Column) -> Column:
    """TYP-01: percent, integer, float, date or text, with its display format.

    What looks like a percentage but can't be read is text. Integers of four and more digits without commas are
    floats, and commas of floats are dropped, as in existing workbooks.
    """
    s = strip(text)
    bare = _ascii_digits(F.regexp_replace(s, "[%,％]", ""))
    number = lambda c: c.try_cast("double")
    null = lambda t: F.lit(None).cast(t)

    def value(kind: str, i: Column | None = None, d: Column | None = None, dt: Column | None = None, fmt: Column | str | None = None) -> Column:
        f = F.lit(fmt) if isinstance(fmt, str) or fmt is None else fmt
        return F.struct(
            F.lit(kind).alias("kind"), (i if i is not None else null("bigint")).alias("i"), (d if d is not None else null("double")).alias("d"),
            (dt if dt is not None else null("date")).alias("dt"), s.alias("s"), f.cast("string").alias("fmt"),
        )

    date = null("date")
    for sep in reversed(DATES):
        q = "\\" + sep
        y, m, d = (F.regexp_extract(s, rf"^(\d{{4}}){q}(\d{{1,2}}){q}(\d{{1,2}})$", k) for k in (1, 2, 3))
        iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        date = F.when(s.rlike(rf"^\d{{4}}{q}\d{{1,2}}{q}\d{{1,2}}$"), F.try_to_date(iso, "yyyy-MM-dd")).otherwise(date)
    percent = number(bare) / 100.0
    return (
        F.when(s.isNull(), F.lit(None).cast(TYPED))
        .when(s.rlike(PERCENT) & percent.isNotNull(), value("percent", d=percent, fmt=F.when(bare.contains("."), "0.0%").otherwise("0%")))
        .when(s.rlike(PERCENT), value("text"))
        .when(s.rlike(INTEGER), value("int", i=bare.try_cast("bigint"), fmt="#,##0"))
        .when(s.rlike(FLOAT), value("float", d=number(bare), fmt="#,##0.00"))
        .when(date.isNotNull(), value("date", dt=date, fmt="yyyy/mm/dd"))
        .otherwise(value("text"))
    )


def symbol_form(text: Column) -> Column:
    """TYP-08."""
    forms = F.create_map(*[F.lit(x) for kv in SYMBOL_FORMS.items() for x in kv])
    return F.coalesce(F.element_at(forms, text), text)


def is_symbol(text: Column) -> Column:
    """PRD-12 for one cell. A stretch of the list of symbols counts, too."""
    t = strip(text)
    n = symbol_form(t)
    return (t != "") & ((F.instr(F.lit(SYMBOLS), n) > 0) | n.isin(*set(SYMBOL_FORMS.values())))


def is_blank(values: Column) -> Column:
    """PRD-11: an array of cells without any text."""
    return ~F.exists(values, lambda v: strip(F.coalesce(v, F.lit(""))) != "")


def is_divider(cells: Column) -> Column:
    """PRD-10: a row of dashes."""
    return (F.size(cells) > 0) & F.forall(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))


def is_placeholder(cells: Column) -> Column:
    """PRD-10: a row of nothing but dashes and blanks."""
    return F.forall(cells, lambda c: strip(F.replace(c, F.lit("<br>"), F.lit(""))).isin("", "-", "–", "—"))


def is_table_line(line: Column) -> Column:
    """PRD-10: a line that begins with a bar and has another."""
    s = strip(line)
    return s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2)


def table_rows(lines: Column) -> Column:
    """ARR-06: the rows of a block of table lines, padded to one width, dividers and placeholders dropped unless nothing is left."""
    from .text import split_row

    rows = F.transform(F.filter(lines, lambda x: strip(x) != ""), split_row)
    kept = F.filter(rows, lambda r: ~is_divider(r) & ~is_placeholder(r))
    used = F.when(F.size(kept) > 0, kept).otherwise(rows)
    width = F.array_max(F.transform(used, F.size))

    def cell(v: Column) -> Column:
        t = strip(F.replace(v, F.lit("<br>"), F.lit("\n")))
        return F.when(t == "-", "").otherwise(t)

    return F.transform(used, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell))


def sheet_title(name: Column, fallback: Column) -> Column:
    """TXT-23."""
    t = strip(F.regexp_replace(F.translate(strip(F.coalesce(name, F.lit(""))), "[]:*?/\\", "_______"), "^'+|'+$", ""))
    return F.left(F.when(t == "", fallback).otherwise(t), F.lit(31))


def table_name(name: Column, fallback: Column) -> Column:
    """TXT-24."""
    t = F.regexp_replace(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), "[^0-9A-Za-z_]", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_|_$", "")
    t = F.when(t == "", fallback).otherwise(t)
    return F.left(F.when(t.rlike("^[A-Za-z_]"), t).otherwise(F.concat(F.lit("_"), t)), F.lit(255))


def file_name(name: Column, fallback: Column) -> Column:
    """TXT-25. The set of replaced characters is the one existing files were named with: it takes in all from ``0`` to the
    backslash (ASCII digits and capital letters among them)."""
    t = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*x0-\\]', "_")
    t = F.regexp_replace(strip(t), r"^\.+|\.+$", "")
    t = F.when(t == "", fallback).otherwise(t)
    return F.left(F.when(F.upper(t).isin(*RESERVED), F.concat(F.lit("_"), t)).otherwise(t), F.lit(120))


def page_range(folder: Column) -> Column:
    """TXT-26: ``p3-9`` of a folder named ``..._p3-9``, else null."""
    tail = F.element_at(F.split(folder, "_p"), -1)
    return F.when(F.instr(folder, "_p") > 0, F.when(tail.rlike("^[0-9]+-[0-9]+$"), F.concat(F.lit("p"), tail)))


def width_mm(token: Column) -> Column:
    """TXT-27: a width attribute as millimetres (96 dots an inch), else null."""
    p = r'(?U)width\s*=\s*"?([0-9]+(?:\.[0-9]+)?)(px|cm|mm)?"?'
    n, unit = F.regexp_extract(token, p, 1).try_cast("double"), F.regexp_extract(token, p, 2)
    return F.when(token.rlike(p), F.when(unit == "cm", n * 10).when(unit == "mm", n).otherwise(n * 25.4 / 96))


def cli_value(args: Column, name: str) -> Column:
    """TXT-28: the value of ``--name v`` or ``--name=v`` in an array of arguments, else null."""
    at = F.array_position(args, f"--{name}")
    joined = F.filter(args, lambda a: a.startswith(f"--{name}="))
    return F.coalesce(F.when(at > 0, F.get(args, at.cast("int"))), F.when(F.size(joined) > 0, F.substring(joined[0], F.lit(len(name) + 4), F.length(joined[0]))))


def cli_int(args: Column, name: str) -> Column:
    return strip(cli_value(args, name)).try_cast("int")


def width_bucket(longest: Column) -> Column:
    """AGG-02."""
    out = F.lit(40)
    for most, width in reversed(WIDTHS):
        out = F.when(longest <= most, width).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def input_kind(path: Column) -> Column:
    """SRC-01."""
    s = suffix(path)
    return F.when(s.isin(*IMAGE_SUFFIXES), "image").when(s == ".pdf", "pdf").otherwise("unsupported")


def requires_conversion(path: Column) -> Column:
    """SRC-12: formats that recognizers can't read."""
    return suffix(path).isin(*CONVERTED_SUFFIXES)
