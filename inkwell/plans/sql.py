"""SQL of the queries in ``corpus.py``, for DuckDB over the same tables.

White space is Unicode white space on both sides, lines end where Python's ``splitlines`` ends them.
"""

from __future__ import annotations

S = r"[\t-\r\x1C-\x1F\x{85}\p{Z}]"
WORDS = ("比率", "割合", "分数", "率", "比")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def count(x: str, literal: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '{literal}', ''))) / {len(literal)} AS INTEGER)"


def lines(table: str, key: str, text: str = "text", where: str = "TRUE") -> str:
    parts = rf"string_split_regex({text}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
    return (
        f"(SELECT {key}, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS INTEGER) AS line FROM (SELECT {key}, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l "
        f"FROM (SELECT {key}, {parts} AS p FROM {table} WHERE {text} IS NOT NULL AND {where})))"
    )


CELLS = "(SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY seen_at DESC) = 1)"
REGIONS = "(SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY seen_at DESC) = 1)"
LAYOUTS = "(SELECT * FROM layout_json QUALIFY row_number() OVER (PARTITION BY layout_id ORDER BY ingested_at DESC) = 1)"
DOC_LINES = lines("documents", "doc_id")


def any_word(x: str, words: tuple[str, ...] = WORDS) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def issues(source: str, key: str, script: str, words: tuple[str, ...] = WORDS) -> str:
    fraction = rf"regexp_matches(s, '[=≒≠]') AND regexp_matches(s, '[/÷×%％]') AND {any_word('s', words)}"
    return (
        f"SELECT {key}, line, reason, s AS text FROM (SELECT *, CASE WHEN s = '' THEN NULL WHEN {fraction} THEN 'fraction_like' "
        f"WHEN {count('s', '$')} >= 2 AND regexp_matches(s, '{script}') THEN 'noisy_dollar' END AS reason FROM (SELECT *, {strip('text')} AS s FROM {source})) WHERE reason IS NOT NULL"
    )


OPS = r"len(regexp_extract_all(text, '[-+×÷=/%^·]'))"
DIGITS = r"len(regexp_extract_all(text, '\p{Nd}'))"
BASE = rf"regexp_matches(text, '\([0-9]{{1,3}}\){S}*[0-9]{{0,3}}|[_^][0-9]+')"
LOOKS_MATH = f"(NOT regexp_matches(text, '(?i)https?://') AND ({any_word('text')} OR ({BASE} AND {DIGITS} >= 4) OR ({OPS} >= 1 AND {DIGITS} >= 2) OR ({DIGITS} / greatest(1, length(text)) >= 0.4 AND {DIGITS} >= 6)))"
FORMULA = r"[0-9a-zA-Z=+\-*/×÷·・.,;:!?''\"|^_`~\\()\[\]{}<>«»＃％＆＠＄＋－＝～‖∥∠≒≈≡≤≥∞∫∑∏√∇°′″→←↔⇒⇔±‰℃πΠΣΩΔΛαβγδεζηθικλμνξοπρστυφχψω]"
_BODY = strip("replace(replace(s, '<br>', ''), '　', '')")

def block(source: str) -> str:
    """Lines with a flag ``f``: whether they look like a formula that stands by itself."""
    return (
        f"(SELECT *, CASE WHEN s = '' OR regexp_matches(s, '^(?:#|《|<img|問|- |\\* )') THEN FALSE WHEN starts_with(s, '$$') AND ends_with(s, '$$') THEN TRUE WHEN b = '' THEN FALSE "
        f"ELSE ({count('s', '<br>')} >= 2 AND m / length(b) >= 0.5) OR (regexp_matches(b, '\\p{{Nd}}') AND regexp_matches(b, '[=＝≒≈≡∝]') AND m >= j + 2) OR (m / length(b) >= 0.75 AND j <= 2 AND length(b) <= 160) END AS f FROM (SELECT *, len(regexp_extract_all(b, '{FORMULA}')) AS m, len(regexp_extract_all(b, '[\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]')) AS j FROM (SELECT *, {_BODY} AS b FROM (SELECT *, {strip('text')} AS s FROM {source}))))"
    )


TABLE_LINE = f"(starts_with({strip('text')}, '|') AND {count(strip('text'), '|')} >= 2)"
PAGE_HEADING = rf"^#{S}+Page{S}+(\d+){S}*$"


def islands(source: str, flag: str) -> str:
    return (
        f"SELECT doc_id, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) + 1 AS INTEGER) AS end_line, count(*) AS n_lines FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g "
        f"FROM (SELECT doc_id, line - 1 AS n FROM {source} WHERE {flag})) GROUP BY doc_id, g"
    )


NAME = r"^(?:.*_)?page_?([0-9]+)(?:_p([0-9]+))?\.md$"


def path_parts(p: str = "path") -> str:
    """Path parts without empty ones and dots, and without a folder that the next part goes back from."""
    clean = rf"regexp_replace(replace({p}, '\', '/'), '^[A-Za-z][A-Za-z0-9+.\-]*:', '')"
    return rf"list_filter(string_split(regexp_replace({clean}, '[^/]+/\.\./', '', 'g'), '/'), lambda x: x <> '' AND x <> '.')"


FILES = f"(SELECT *, pp[-1] AS name, pp[-2] AS folder FROM (SELECT *, {path_parts()} AS pp FROM page_files WHERE path IS NOT NULL))"
PARSED = f"(SELECT * REPLACE (CAST(regexp_extract(name, '{NAME}', 1) AS INTEGER) AS page, CAST(coalesce(nullif(regexp_extract(name, '{NAME}', 2), ''), '0') AS INTEGER) AS part) FROM {FILES} WHERE regexp_matches(name, '{NAME}'))"
SAME = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n+$', '')"
PARTS = f"(SELECT doc_id, page, part, concat_ws('/', folder, name) AS path, text FROM {PARSED} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(folder, ''), name, {SAME} ORDER BY file_id) = 1)"
MERGED = f"(SELECT doc_id, page, string_agg(t, chr(10) || chr(10) ORDER BY part, path, t) AS text FROM (SELECT *, {strip('text')} AS t FROM {PARTS}) WHERE t <> '' GROUP BY doc_id, page)"
SUFFIX = r"lower(regexp_extract(pp[-1], '[^.](\.[^.]+)$', 1))"

_ONE = "coalesce({0}, 1)"
DEFAULTS = f"(SELECT doc_id, page, table_no, idx, coalesce(\"row\", 1) AS r0, coalesce(col, 1) AS c0, greatest(coalesce(row_span, 1), 1) AS rs, greatest(coalesce(col_span, 1), 1) AS cs, {strip(chr(39).join(['coalesce(text, ', '', ')']))} AS text FROM {CELLS})"
EXTENTS = f"(SELECT doc_id, page, table_no, CAST(greatest(1, max(r0 + rs - 1)) AS INTEGER) AS max_row, CAST(greatest(1, max(c0 + cs - 1)) AS INTEGER) AS max_col FROM {DEFAULTS} GROUP BY ALL)"
SPREAD = f"(SELECT doc_id, page, table_no, idx, text, r, unnest(range(c0, c0 + cs)) AS c FROM (SELECT *, unnest(range(r0, r0 + rs)) AS r FROM {DEFAULTS}))"
GRID = f"(SELECT doc_id, page, table_no, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, min(idx) AS owner, coalesce(min_by(text, idx) FILTER (WHERE text <> ''), '') AS value FROM {SPREAD} WHERE r >= 1 AND c >= 1 GROUP BY ALL)"
FORMS = {"✕": "×", "x": "×", "X": "×", "〇": "○", "◯": "○", "O": "○", "o": "○", "0": "○", "口": "□"}


def symbol_form(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FORMS.items()) + f" ELSE {x} END"


def is_symbol(x: str) -> str:
    return f"({x} <> '' AND (contains('○〇◯◎△▲▼×✕xX□■●', {symbol_form(x)}) OR {symbol_form(x)} IN ('×', '○', '□', '■', '●')))"


# every coordinate of a row that has at least one cell; places without owner get one of their own
FULL = f"(SELECT e.*, c.c, g.owner, coalesce(g.value, '') AS value, coalesce(g.owner, -c.c) AS o FROM (SELECT DISTINCT doc_id, page, table_no, r, max_col FROM {GRID} JOIN {EXTENTS} USING (doc_id, page, table_no)) e, LATERAL (SELECT unnest(range(1, e.max_col + 1)) AS c) c LEFT JOIN {GRID} g ON g.doc_id IS NOT DISTINCT FROM e.doc_id AND g.page IS NOT DISTINCT FROM e.page AND g.table_no = e.table_no AND g.r = e.r AND g.c = c.c)"
_T = "doc_id, page, table_no"
SIGNED = (
    f"(SELECT {_T}, r, string_agg(CAST(n AS VARCHAR), ',' ORDER BY g) AS signature, bool_or(sym) AS has_symbol, bool_and(blank) AS blank FROM (SELECT {_T}, r, g, count(*) AS n, bool_or(sym) AS sym, bool_and(v = '') AS blank FROM ("
    f"SELECT *, sum(ch) OVER (PARTITION BY {_T}, r ORDER BY c) AS g FROM (SELECT *, {strip('value')} AS v, {is_symbol(strip('value'))} AS sym, CASE WHEN lag(o) OVER (PARTITION BY {_T}, r ORDER BY c) = o THEN 0 ELSE 1 END AS ch FROM {FULL})) GROUP BY {_T}, r, g) GROUP BY {_T}, r)"
)
RUNS = f"(SELECT *, sum(new) OVER (PARTITION BY {_T} ORDER BY r) AS run FROM (SELECT *, CASE WHEN lag(signature) OVER w = signature AND lag(r) OVER w = r - 1 THEN 0 ELSE 1 END AS new FROM {SIGNED} WHERE NOT blank WINDOW w AS (PARTITION BY {_T} ORDER BY r)))"
ROLES = (
    f"(SELECT *, sum(CASE WHEN new = 1 AND data_run THEN 1 ELSE 0 END) OVER (PARTITION BY {_T} ORDER BY r) AS upto FROM (SELECT *, CASE WHEN symbols THEN first IS NOT NULL ELSE len = max(len) OVER (PARTITION BY {_T}) END AS data_run FROM ("
    f"SELECT *, bool_or(has_symbol) OVER (PARTITION BY {_T}) AS symbols, min(r) FILTER (WHERE has_symbol) OVER (PARTITION BY {_T}, run) AS first, count(*) OVER (PARTITION BY {_T}, run) AS len FROM {RUNS})))"
)
SEGMENTS = f"(SELECT {_T}, r, CAST(upto - CASE WHEN data_run THEN 1 ELSE 0 END + 1 AS BIGINT) AS segment, CASE WHEN data_run AND (NOT symbols OR r >= first) THEN 'data' ELSE 'header' END AS role, max(upto) OVER (PARTITION BY {_T}) AS total FROM {ROLES})"


def box(x: str) -> str:
    return f"array_to_string({x}, ',')"


_UP = "[least(box[1], box[3]), least(box[2], box[4]), greatest(box[1], box[3]), greatest(box[2], box[4])]"
GATED = (
    f"(SELECT * FROM (SELECT region_id, doc_id, page, ord, score, text, {_UP} AS box, greatest(1, abs(box[3] - box[1])) AS w, greatest(1, abs(box[4] - box[2])) AS h FROM {REGIONS} WHERE len(box) = 4 AND score IS NOT NULL AND text IS NOT NULL) "
    f"WHERE greatest(w / h, h / w) <= 8.0 AND length(text) <= 120 AND ({OPS} >= 1 OR {BASE} OR {DIGITS} / greatest(1, length(text)) >= 0.4) AND score >= 0.6)"
)
MATCH = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\text\{{([^}}]*)\}}', '\1', 'g'), '[$`~^\\{{}}_*\[\]()<>|]', '', 'g'), '{S}+', '', 'g')"
TEX = rf"replace(replace(replace(replace(text, '\[', ''), '\]', ''), '\(', ''), '\)', '')"  # noqa: F541
PAGE_LINES = lines(f"(SELECT doc_id, page, string_agg(t, chr(10) ORDER BY layout_id) AS text FROM (SELECT layout_id, doc_id, page, array_to_string(list_transform(detections, lambda x: coalesce(x.content, '')), chr(10)) AS t FROM {LAYOUTS} WHERE detections IS NOT NULL) GROUP BY doc_id, page)", "doc_id, page")
SNIPPETS = f"(SELECT doc_id, page, CAST(rank AS INTEGER) AS rank, printf('eq_page%03d_%02d.png', page, rank) AS name, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC NULLS LAST, region_id) AS rank FROM {REGIONS} WHERE text IS NOT NULL AND text <> ''))"


def contained(source: str, snippets: str) -> str:
    return f"(SELECT l.doc_id, l.page, l.line, s.rank, s.name FROM (SELECT *, {MATCH('text')} AS m FROM {source}) l JOIN (SELECT *, {MATCH('text')} AS m FROM {snippets}) s ON l.doc_id = s.doc_id AND l.page = s.page AND contains(l.m, s.m) WHERE s.m <> '' AND l.m <> '')"


def matched(source: str, snippets: str) -> str:
    """Tables ``c``, ``rec`` and ``placed`` of a query: candidates one after another, each taken unless its line or snippet was."""
    return (
        f"c AS (SELECT doc_id, page, line, rank, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, rank) AS i FROM {contained(source, snippets)}), "
        "rec AS (SELECT doc_id, page, 0::BIGINT AS i, []::INTEGER[] AS ls, []::INTEGER[] AS rs FROM (SELECT DISTINCT doc_id, page FROM c) UNION ALL SELECT c.doc_id, c.page, c.i, CASE WHEN list_contains(ls, c.line) OR list_contains(rs, c.rank) THEN ls ELSE list_append(ls, c.line) END, "
        "CASE WHEN list_contains(ls, c.line) OR list_contains(rs, c.rank) THEN rs ELSE list_append(rs, c.rank) END FROM rec JOIN c ON c.doc_id = rec.doc_id AND c.page = rec.page AND c.i = rec.i + 1), "
        f"placed AS (SELECT s.doc_id, s.page, t.line, s.rank, s.name FROM {snippets} s LEFT JOIN (SELECT doc_id, page, unnest(ls) AS line, unnest(rs) AS rank FROM (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) = 1)) t ON t.doc_id = s.doc_id AND t.page = s.page AND t.rank = s.rank)"
    )


def linked(source: str, snippets: str) -> str:
    """Page lines with links behind the lines that hold a snippet, the rest at the end, and at most two blank lines in a row."""
    return (
        f"WITH RECURSIVE kept AS (SELECT * FROM {source} WHERE NOT contains(text, 'eq_page')), {matched(f"(SELECT * FROM kept WHERE NOT regexp_matches({strip('text')}, '{PAGE_HEADING}'))", snippets)}, every AS (SELECT doc_id, page, line::BIGINT AS n, 0 AS k, 0 AS j, text FROM kept UNION ALL SELECT doc_id, page, coalesce(line, 2147483647), rank, unnest([0, 1, 2]), unnest(['', '![eq](figures/' || name || ')', '']) FROM placed), "
        f"put AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY n, k, j) AS INTEGER) AS line, text FROM every), g AS (SELECT *, sum(CASE WHEN {strip('text')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS g FROM put) SELECT doc_id, page, line, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, g ORDER BY line) - CASE WHEN g = 0 THEN 0 ELSE 1 END AS k FROM g) WHERE {strip('text')} <> '' OR k <= 2"
    )


LEVEL = "CAST(least(23, greatest(0, floor((v + CAST(0.5 AS FLOAT)) * 24))) AS INTEGER) * 11"
PIXELS = f"(SELECT vec_id, 16 AS width, len(embedding) // 16 AS height, (k - 1) % 16 AS x, (k - 1) // 16 AS y, {LEVEL} AS v FROM (SELECT vec_id, embedding, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))"
STATS = (
    f"(SELECT vec_id, 16 AS width, CAST(height AS INTEGER) AS height, CAST(16 * height AS BIGINT) AS area, 16 / height AS aspect_ratio, count(*) AS unique_colors, round_even(sqrt(sum(n * v * v) / sum(n) - (sum(n * v) / sum(n)) * (sum(n * v) / sum(n))), 4) AS avg_std, "
    f"round_even(sum(n * v) / sum(n), 4) AS mean_luma, round_even((16 * height - sum(CASE WHEN v >= 250 THEN n ELSE 0 END)) / (16 * height), 4) AS non_white_ratio, round_even(max(n) / (16 * height), 4) AS dominant_ratio, "
    f"round_even(16 / 200, 6) AS width_ratio, round_even(height / 300, 6) AS height_ratio, round_even(16 * height / 60000, 6) AS area_ratio FROM (SELECT vec_id, height, v, count(*) AS n FROM {PIXELS} GROUP BY ALL) GROUP BY vec_id, height)"
)
LOG = (
    r"(SELECT *, CASE WHEN regexp_matches(line, '^reading page \d+ of \d+') THEN 'page' WHEN regexp_matches(line, '^layout done: \d+/\d+|^page \d+/\d+ written') THEN 'done' END AS event, "
    r"CAST(nullif(regexp_extract(line, '^(?:reading page|layout done:|page) (\d+)(?: of |/)(\d+)', 1), '') AS INTEGER) AS current, CAST(nullif(regexp_extract(line, '^(?:reading page|layout done:|page) (\d+)(?: of |/)(\d+)', 2), '') AS INTEGER) AS total FROM progress_log)"
)
_STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_PERCENT, _INT, _FLOAT = rf"^{S}*-?\p{{Nd}}+[\p{{Nd}},.]*{S}*%{S}*$", rf"^{S}*-?\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})*{S}*$", rf"^{S}*-?\p{{Nd}}*[.,]?\p{{Nd}}+{S}*$"
_BARE = "translate(regexp_replace(s, '[%,％]', '', 'g'), '０１２３４５６７８９', '0123456789')"
_DATES = "coalesce(" + ", ".join(rf"CASE WHEN regexp_matches(s, '^\d{{4}}\{c}\d{{1,2}}\{c}\d{{1,2}}$') THEN try_cast(try_strptime(s, '%Y{c}%m{c}%d') AS DATE) END" for c in "-/.") + ")"
TYPED = (
    f"(SELECT cell_id, CASE WHEN regexp_matches(s, '{_PERCENT}') THEN CASE WHEN try_cast({_BARE} AS DOUBLE) IS NULL THEN 'text' ELSE 'percent' END WHEN regexp_matches(s, '{_INT}') THEN 'int' WHEN regexp_matches(s, '{_FLOAT}') THEN 'float' WHEN {_DATES} IS NOT NULL THEN 'date' ELSE 'text' END AS kind, "
    f"{_BARE} AS bare, {_DATES} AS dt0 FROM (SELECT cell_id, {strip('text')} AS s FROM {CELLS} WHERE text IS NOT NULL AND trim(text) <> ''))"
)


def _inner(k: int) -> str:
    return f"greatest(1, CAST(round_even(greatest(1, box[{k + 3}] - box[{k + 1}]) * 0.18, 0) AS INTEGER))"


_CUT = f"[box[1] + {_inner(0)}, box[2] + {_inner(1)}, box[3] - {_inner(0)}, box[4] - {_inner(1)}]"



def _chain(x: str, rules: list[tuple[str, str]]) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_BLOCKS = [
    ("<br>", "\n"), (r"(?m)^```[^\n]*$", ""), ("(?m)^```$", ""), (r'(?i)<img[^>]*src="([^"]+)"[^>]*>', r"[画像: \1]"), (r"!\[[^\]]*\]\(([^)]+)\)", r"[画像: \1]"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (rf"(?m)^{S}{{0,3}}#{{1,6}}{S}+", ""), (rf"(?m)^{S}{{0,3}}>{S}?", ""), (rf"(?m)^{S}{{0,3}}(-{{3,}}|\*{{3,}}|_{{3,}}){S}*$", ""),
]
_INLINE = [("`([^`]+)`", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), ("__([^_]+)__", r"\1"), (r"\*([^*]+)\*", r"\1"), ("_([^_]+)_", r"\1")]
_MATH = [(rf"\$\$(?:{S}+|{S}*([\s\S]+?){S}*)\$\$", r"\1"), (rf"\\\((?:{S}+|{S}*([\s\S]+?){S}*)\\\)", r"\1"), (rf"\\\[(?:{S}+|{S}*([\s\S]+?){S}*)\\\]", r"\1"), (rf"\$(?:{S}+|{S}*([^$]+?){S}*)\$", r"\1")]
_DIVIDER = rf"^{S}*\|?(?:{S}*:?-{{2,}}:?{S}*\|)+{S}*:?-{{2,}}:?{S}*\|?{S}*$"
_ROW = f"CASE WHEN regexp_matches(x, '^{S}*\\|.+\\|{S}*$') AND {count('x', '|')} >= 2 THEN regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace({strip('x')}, '^\\|', ''), '\\|$', ''), '|'), lambda y: {strip('y')}), chr(9)), '{S}+$', '') ELSE x END"
_SPLIT = r"string_split_regex(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"


def plain_of(source: str, keep: str, text: str = "text") -> str:
    """``keep`` and ``plain``, the plain text of ``text``, of a table. Its delimiters are nested six deep at most."""
    return (
        f"(SELECT {keep}, {strip(_chain('t', [('</?[^>]+>', ''), (chr(92) + 'n{3,}', chr(10) * 2)]))} AS plain FROM (SELECT {keep}, {_chain('t', _MATH * 6)} AS t FROM (SELECT {keep}, {_chain('t', _INLINE)} AS t FROM ("
        f"SELECT {keep}, array_to_string(list_transform(list_filter(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: NOT regexp_matches(x, '{_DIVIDER}')), lambda x: {_ROW}), chr(10)) AS t FROM (SELECT {keep}, {_SPLIT} AS l FROM (SELECT {keep}, {_chain(f"coalesce({text}, '')", _BLOCKS)} AS t FROM {source}))))))"
    )


def stripped(x: str) -> str:
    """Text without the delimiters and commands of TeX, nested six deep at most."""
    bare = x
    for mark in (r"\[", r"\]", r"\(", r"\)"):
        bare = f"replace({bare}, '{mark}', '')"
    rules = [(rf"\$\$(?:{S}+|{S}*([\s\S]+?){S}*)\$\$", r"\1"), *[(r"\$([^$]+)\$", r"\1")] * 6, (r"\\text\{([^}]*)\}", r"\1"), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"(\1)/(\2)"), (rf"([A-Za-z]+){S}*[_^]{S}*\{{?(\p{{Nd}}+)\}}?", r"\1_\2"), ("[{}]", ""), (r"\\[A-Za-z]+", "")]
    return _chain(bare, rules)


PLAIN = plain_of("documents", "doc_id")
_RECORDS = f"(SELECT p.*, CASE WHEN p.path IS NULL THEN 'id:' || p.file_id ELSE concat_ws('/', coalesce(f.folder, ''), f.name, CASE WHEN p.text IS NULL THEN '' ELSE '=' || {SAME.replace('text', 'p.text')} END) END AS record FROM page_files p LEFT JOIN (SELECT DISTINCT path, name, folder FROM {FILES}) f ON f.path = p.path WHERE p.path IS NULL OR regexp_matches(f.name, '{NAME}'))"
# cells of segments with their rows, roles and widths
_CELL = (
    f"(SELECT *, coalesce(nullif(max(CASE WHEN v <> '' THEN c END) OVER p, 0), max(max_col) OVER p) AS width FROM (SELECT s.*, g.c, g.max_col, g.value, {strip('g.value')} AS v FROM (SELECT * FROM {SEGMENTS} WHERE segment <= total) s "
    f"JOIN {FULL} g ON g.doc_id IS NOT DISTINCT FROM s.doc_id AND g.page IS NOT DISTINCT FROM s.page AND g.table_no = s.table_no AND g.r = s.r) WINDOW p AS (PARTITION BY {_T}, segment))"
)
_DATA = plain_of(f"(SELECT *, dense_rank() OVER (PARTITION BY {_T}, segment ORDER BY r) AS data_row FROM {_CELL} WHERE role = 'data')", f"{_T}, segment, data_row, c, width", "value")
_DATA = f"(SELECT * FROM {_DATA} WHERE c <= width)"
_PER = f"(SELECT {_T}, segment, CAST(max(width) AS INTEGER) AS width, coalesce(min_by(v, r) FILTER (WHERE role = 'data' AND c = 1 AND v <> ''), '') AS name, CAST(count(DISTINCT r) FILTER (WHERE role = 'data') AS INTEGER) AS n_rows FROM {_CELL} GROUP BY {_T}, segment)"
_MERGED_HEADER = f"(SELECT {_T}, segment, c, {strip(f"replace(string_agg(v, ' / ' ORDER BY r), chr(10), ' ')")} AS h FROM (SELECT * FROM {_CELL} WHERE role = 'header' AND v <> '' QUALIFY lag(v) OVER (PARTITION BY {_T}, segment, c ORDER BY r) IS DISTINCT FROM v) GROUP BY {_T}, segment, c)"
_BASE = f"(SELECT p.*, coalesce(nullif(h.h, ''), 'col_' || p.c) AS base FROM (SELECT *, unnest(range(1, width + 1)) AS c FROM {_PER}) p LEFT JOIN {_MERGED_HEADER} h ON h.doc_id IS NOT DISTINCT FROM p.doc_id AND h.page IS NOT DISTINCT FROM p.page AND h.table_no = p.table_no AND h.segment = p.segment AND h.c = p.c)"
_UNIQUE = f"(SELECT *, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS u FROM (SELECT *, row_number() OVER (PARTITION BY {_T}, segment, base ORDER BY c) AS k FROM {_BASE}))"
_HEADER = plain_of(_UNIQUE, f"{_T}, segment, width, name, n_rows, c", "u")
_RESERVED = ", ".join(f"'{x}'" for x in ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))))


def title_of(x: str, fallback: str) -> str:
    clean = strip(f"regexp_replace(translate({strip(x)}, '[]:*?/' || chr(92), '_______'), '^' || chr(39) || '+|' || chr(39) || '+$', '', 'g')")
    return f"left(coalesce(nullif({clean}, ''), {fallback}), 31)"


def file_of(x: str, fallback: str) -> str:
    clean = strip(f"regexp_replace({strip(x)}, '[<>:\"/\\\\|?*x0-\\\\]', '_', 'g')")
    named = f"coalesce(nullif(regexp_replace({clean}, '^\\.+|\\.+$', '', 'g'), ''), {fallback})"
    return f"left(CASE WHEN upper({named}) IN ({_RESERVED}) THEN '_' || {named} ELSE {named} END, 120)"


def table_of(x: str, fallback: str) -> str:
    clean = f"regexp_replace(regexp_replace(regexp_replace({strip(x)}, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    named = f"coalesce(nullif({clean}, ''), {fallback})"
    return f"left(CASE WHEN regexp_matches({named}, '^[A-Za-z_]') THEN {named} ELSE '_' || {named} END, 255)"


_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, table_no NULLS FIRST, segment) AS segment_no FROM {_PER})"
_NAMED = f"(SELECT *, {title_of('n', 'f')} AS sheet0, doc_id || '__' || {file_of('n', 'f')} AS file0 FROM (SELECT *, 'sheet_' || segment_no AS f, CASE WHEN name = '' THEN 'sheet_' || segment_no ELSE name END AS n FROM {_NUMBERED}))"
_SUFFIXED = lambda b, k, most: f"CASE WHEN {k} = 1 THEN {b} ELSE left({b}, {most} - length('_' || {k})) || '_' || {k} END"
_SHEETS = f"(SELECT *, {_SUFFIXED('sheet0', 'ks', 31)} AS sheet, {_SUFFIXED('file0', 'kf', 200)} AS file FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet0 ORDER BY segment_no) AS ks, row_number() OVER (PARTITION BY doc_id, file0 ORDER BY segment_no) AS kf FROM {_NAMED}))"
_ROWS = f"(SELECT {_T}, segment, 0 AS line, c, plain FROM {_HEADER} UNION ALL SELECT {_T}, segment, data_row, c, plain FROM {_DATA})"
_X = "'x'"
_KIND = rf"CASE WHEN regexp_matches(s, '{_PERCENT}') THEN CASE WHEN try_cast({_BARE} AS DOUBLE) IS NULL THEN 'text' ELSE 'percent' END WHEN regexp_matches(s, '{_INT}') THEN 'int' WHEN regexp_matches(s, '{_FLOAT}') THEN 'float' WHEN {_DATES} IS NOT NULL THEN 'date' ELSE 'text' END"
_WIDE = f"(SELECT {_T}, max_col, CAST(coalesce(nullif(max(CASE WHEN {strip('value')} <> '' THEN c END), 0), max_col) AS INTEGER) AS width, greatest(1, coalesce(max(CASE WHEN {strip('value')} <> '' THEN r END), 1)) AS last_row FROM {FULL} GROUP BY {_T}, max_col)"
_LAID = plain_of(f"(SELECT w.*, w.r AS row_no, g.value FROM (SELECT *, unnest(range(1, width + 1)) AS c FROM (SELECT *, unnest(range(1, last_row + 1)) AS r FROM {_WIDE})) w LEFT JOIN {GRID} g ON g.doc_id IS NOT DISTINCT FROM w.doc_id AND g.page IS NOT DISTINCT FROM w.page AND g.table_no = w.table_no AND g.r = w.r AND g.c = w.c)", f"{_T}, row_no, c", "value")
_FORMULAS = f"(SELECT doc_id, page, region_id, CASE WHEN starts_with(s, '$$') AND ends_with(s, '$$') THEN {strip('substring(s, 3, greatest(length(s) - 4, 0))')} WHEN starts_with(s, '$') AND ends_with(s, '$') THEN {strip('substring(s, 2, greatest(length(s) - 2, 0))')} ELSE s END AS bare, score >= 0.8 AS isolated, (box[2] + box[4]) / 2 AS y FROM (SELECT *, {strip('text')} AS s FROM {REGIONS} WHERE text IS NOT NULL AND len(box) = 4 AND score >= 0.65) WHERE s <> '')"
_BLOCKED = f"(SELECT *, CASE WHEN f THEN CAST(sum(CASE WHEN f AND NOT coalesce(p, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS BIGINT) END AS block FROM (SELECT *, lag(f) OVER (PARTITION BY doc_id, page ORDER BY line) AS p FROM (SELECT doc_id, page, line, text, coalesce(f, FALSE) AS f FROM {block(PAGE_LINES)})))"
_BODIES = (
    f"(SELECT doc_id, line, kind, sum(CASE WHEN kind IN ('table', 'paragraph') AND pk = kind THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS block, CASE kind WHEN 'heading' THEN least(length(regexp_extract(s, '^(#+)', 1)), 4) WHEN 'page' THEN 1 END AS level, "
    f"CASE kind WHEN 'heading' THEN {strip(f"regexp_replace(s, '^#+', '')")} WHEN 'bullet' THEN {strip('substring(s, 3)')} WHEN 'ordered' THEN regexp_extract(s, '^(\\p{{Nd}}+)[.)]', 1) || '. ' || {strip(f"regexp_extract(s, '^\\p{{Nd}}+[.)]{S}+(.*)', 1)")} ELSE s END AS body FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS pk FROM (%s)))"
)
_CROP = [f"round(box[1] / 2480.0::DOUBLE, 3)", "round(box[2] / 3508.0::DOUBLE, 3)", "round((box[3] - box[1]) / 2480.0::DOUBLE, 3)", "round((box[4] - box[2]) / 3508.0::DOUBLE, 3)"]
_HALF = lambda x: f"CAST(round_even({x}, 0) AS INTEGER)"

SQL: dict[str, str] = {
    "plain_text": f"SELECT doc_id, md5(plain) AS plain_md5 FROM {PLAIN}",
    "math_issue_lines": issues(DOC_LINES, "doc_id", r"[A-Za-zÀ-ÿ\x{3040}-\x{9FFF}]"),
    "math_issue_counts": f"SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({issues(DOC_LINES, 'doc_id', r'[A-Za-zÀ-ÿ\x{3040}-\x{9FFF}]')}) GROUP BY reason",
    "region_issues": issues(lines(REGIONS, "region_id"), "region_id", r"[\x{3040}-\x{9FFF}]"),
    "page_issues": issues(lines(MERGED, "doc_id, page"), "doc_id, page", r"[\x{3040}-\x{9FFF}]"),
    "math_features": f"SELECT doc_id, line, CAST({OPS} AS INTEGER) AS ops, CAST({DIGITS} AS INTEGER) AS digits, round_even({DIGITS} / greatest(1, length(text)), 6) AS digit_ratio, {BASE} AS has_base FROM {DOC_LINES} WHERE text <> ''",
    "looks_math_lines": f"SELECT doc_id, line, text FROM {DOC_LINES} WHERE {LOOKS_MATH}",
    "math_docs": f"SELECT d.doc_id, coalesce(h, FALSE) AS has_math FROM documents d LEFT JOIN (SELECT doc_id, bool_or({count('text', '$')} >= 2 OR contains(text, '\\(') OR contains(text, '\\[') OR {count('text', '^')} >= 2 OR {count('text', '_')} >= 2 OR regexp_matches(text, '[∑Σ∫√≤≥≈≒≠∞]')) AS h FROM {DOC_LINES} GROUP BY doc_id) USING (doc_id) WHERE d.text IS NOT NULL",
    "formula_block_islands": islands(block(DOC_LINES), "f"),
    "table_blocks": islands(DOC_LINES, TABLE_LINE),
    "repeat_runs": f"SELECT doc_id, CAST(min(line) AS INTEGER) AS first_line, count(*) AS n FROM (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY doc_id ORDER BY line) = text THEN 0 ELSE 1 END AS ch FROM {DOC_LINES})) GROUP BY doc_id, g HAVING count(*) > 1",
    "sparse_docs": r"SELECT doc_id, len(regexp_extract_all(replace(regexp_replace(text, '<img[^>]+>', '', 'g'), '\g<1>', ''), '[A-Za-z0-9\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')) < 30 AS sparse FROM documents WHERE text IS NOT NULL",
    "paragraphs": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(line)) AS INTEGER) AS paragraph, CAST(min(line) AS INTEGER) AS first_line, {strip(f'string_agg(t, chr(10) ORDER BY line)')} AS text FROM (SELECT *, regexp_replace(text, '{S}+$', '') AS t, sum(CASE WHEN {strip('text')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM {DOC_LINES}) WHERE {strip('text')} <> '' GROUP BY doc_id, p",
    "block_kinds": f"SELECT doc_id, line, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '{PAGE_HEADING}') THEN 'page' WHEN starts_with(s, '#') THEN 'heading' WHEN starts_with(s, '|') AND {count('s', '|')} >= 2 THEN 'table' WHEN starts_with(s, '- ') OR starts_with(s, '* ') THEN 'bullet' WHEN regexp_matches(s, '^\\p{{Nd}}+[.)]{S}+') THEN 'ordered' WHEN regexp_matches(s, '<img[^>]*src=\"[^\"]+\"[^>]*>|!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' ELSE 'paragraph' END AS kind FROM (SELECT *, {strip('text')} AS s FROM {DOC_LINES})",
    "bar_cells": f"SELECT doc_id, line, CAST(generate_subscripts(c, 1) AS INTEGER) AS col, {strip('unnest(c)')} AS value FROM (SELECT doc_id, line, string_split(regexp_replace(regexp_replace({strip('text')}, '^\\|', ''), '\\|$', ''), '|') AS c FROM {DOC_LINES} WHERE {count('text', '|')} >= 2)",
    "page_of_lines": f"SELECT doc_id, page, count(*) AS n_lines FROM (SELECT *, CAST(last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS INTEGER) AS page FROM (SELECT *, CAST(nullif(regexp_extract({strip('text')}, '{PAGE_HEADING}', 1), '') AS INTEGER) AS n FROM {DOC_LINES})) WHERE n IS NULL GROUP BY doc_id, page",
    "demoted_lines": f"SELECT doc_id, line, CASE WHEN NOT ph AND seen AND regexp_matches(text, '^{S}*#{S}+.+$') THEN regexp_extract(text, '^({S}*)#{S}+(.+)$', 1) || '## ' || {strip(f"regexp_extract(text, '^({S}*)#{S}+(.+)$', 2)")} ELSE text END AS text FROM (SELECT *, bool_or(ph) OVER (PARTITION BY doc_id ORDER BY line) AS seen FROM (SELECT doc_id, line, text, regexp_matches({strip('text')}, '{PAGE_HEADING}') AS ph FROM (SELECT doc_id, line, regexp_replace(text, '^## ', '# ') AS text FROM {DOC_LINES})))",
    "limited_blanks": f"SELECT doc_id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line) - CASE WHEN g = 0 THEN 0 ELSE 1 END AS k FROM (SELECT *, sum(CASE WHEN {strip('text')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM {lines('(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)', 'doc_id')})) WHERE {strip('text')} <> '' OR k <= 2",
    "match_forms": f"SELECT region_id, {MATCH('text')} AS form FROM {REGIONS} WHERE text IS NOT NULL",
    "rendered_formulas": f"SELECT region_id, CASE WHEN score >= 0.7 THEN '$$' || chr(10) || b || chr(10) || '$$' ELSE '$' || b || '$' END AS text FROM (SELECT *, CASE WHEN starts_with(s, '$$') AND ends_with(s, '$$') THEN {strip('substring(s, 3, greatest(length(s) - 4, 0))')} WHEN starts_with(s, '$') AND ends_with(s, '$') THEN {strip('substring(s, 2, greatest(length(s) - 2, 0))')} ELSE s END AS b FROM (SELECT *, {strip('text')} AS s FROM {REGIONS} WHERE text IS NOT NULL))",
    "page_names": f"SELECT file_id, page, part, printf('page_%03d', page) || CASE WHEN part <= 1 THEN '' ELSE printf('_p%02d', part) END || '.md' AS name FROM {PARSED}",
    "path_folders": f"SELECT file_id, folder, name, {SUFFIX} AS suffix FROM {FILES}",
    "input_kinds": f"SELECT CASE WHEN x IN ('.png', '.jpg', '.jpeg', '.webp', '.tif', '.tiff', '.bmp', '.heic', '.heif', '.svg') THEN 'image' WHEN x = '.pdf' THEN 'pdf' ELSE 'unsupported' END AS kind, x IN ('.heic', '.heif', '.svg') AS convert, count(*) AS n FROM (SELECT replace({SUFFIX}, '.txt', '.heic') AS x FROM {FILES}) GROUP BY ALL",
    "layout_page_numbers": f"SELECT layout_id, CAST(coalesce(nullif(regexp_extract(n, 'page_images_page_(\\d+)', 1), ''), nullif(regexp_extract(n, 'page_(\\d+)', 1), ''), nullif(regexp_extract(n, 'page(\\d+)', 1), '')) AS INTEGER) AS page FROM (SELECT layout_id, string_split(path, '/')[-1] AS n FROM {LAYOUTS})",
    "folder_ranges": "SELECT DISTINCT doc_id, nullif(regexp_extract(doc_id, '_(p[0-9]+-[0-9]+)$', 1), '') AS page_range FROM page_files",
    "merged_pages": f"SELECT * FROM {MERGED}",
    "merged_sections": f"SELECT doc_id, page, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1 THEN '' ELSE chr(10) END || '# Page ' || page || chr(10) || chr(10) || text || chr(10) || chr(10) AS section FROM {MERGED}",
    "newest_listing": "SELECT doc_id, file_id, listed_at FROM page_files QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY listed_at DESC, file_id DESC) = 1",
    "newest_folder": "WITH f AS (SELECT doc_id AS name, max(listed_at) AS mtime FROM page_files GROUP BY doc_id), s AS (SELECT DISTINCT regexp_replace(name, '_p[0-9]+-[0-9]+$', '') AS stem FROM f) SELECT stem, name AS folder FROM s LEFT JOIN f ON name = stem OR starts_with(name, stem || '_') QUALIFY row_number() OVER (PARTITION BY stem ORDER BY mtime DESC, name DESC) = 1",
    "best_outputs": f"SELECT doc_id, min_by(name, (p, name)) AS best FROM (SELECT doc_id, name, CASE WHEN lower(name) LIKE '%.docx' THEN 1 WHEN lower(name) LIKE '%.xlsx' THEN 2 WHEN lower(name) LIKE '%.csv' THEN 3 WHEN lower(name) LIKE '%.md' THEN 4 END AS p FROM {FILES}) WHERE p IS NOT NULL GROUP BY doc_id",
    "recent_folders": "SELECT doc_id AS name, max(listed_at) AS mtime FROM page_files GROUP BY doc_id ORDER BY mtime DESC, name LIMIT 10",
    "pages_without_tables": f"SELECT DISTINCT doc_id, page FROM {LAYOUTS} l WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.doc_id = l.doc_id AND c.page = l.page)",
    "requested_pages": f"SELECT layout_id, doc_id, page FROM {LAYOUTS} l WHERE EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = l.doc_id AND r.page = l.page)",
    "first_locations": f"SELECT layout_id, CASE WHEN EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = l.doc_id AND r.page = l.page) THEN 'regions' WHEN EXISTS (SELECT 1 FROM cells c WHERE c.doc_id = l.doc_id AND c.page = l.page) THEN 'cells' END AS path FROM {LAYOUTS} l",
    "page_spans": "SELECT doc_id, CAST(greatest(0, hi - lo + 1) AS INTEGER) AS n_pages, CASE WHEN lo <= hi THEN lo END AS first_page FROM (SELECT doc_id, greatest(1, coalesce(CAST(nullif(regexp_extract(doc_id, '_p(\\d+)-(\\d+)$', 1), '') AS INTEGER), 1)) AS lo, least(max(page), coalesce(CAST(nullif(regexp_extract(doc_id, '_p(\\d+)-(\\d+)$', 2), '') AS INTEGER), max(page))) AS hi FROM page_files WHERE page IS NOT NULL GROUP BY doc_id)",
    "cell_types": f"SELECT cell_id, kind, CASE WHEN kind = 'int' THEN CAST(bare AS BIGINT) END AS i, CASE WHEN kind = 'percent' THEN round(CAST(bare AS DOUBLE) / 100, 9) WHEN kind = 'float' THEN round(CAST(bare AS DOUBLE), 9) END AS d, CASE WHEN kind = 'date' THEN dt0 END AS dt, CASE kind WHEN 'percent' THEN CASE WHEN contains(bare, '.') THEN '0.0%' ELSE '0%' END WHEN 'int' THEN '#,##0' WHEN 'float' THEN '#,##0.00' WHEN 'date' THEN 'yyyy/mm/dd' END AS fmt FROM {TYPED}",
    "cell_symbols": f"SELECT cell_id, {symbol_form('s')} AS symbol FROM (SELECT cell_id, {strip('text')} AS s FROM {CELLS} WHERE text IS NOT NULL) WHERE {is_symbol('s')}",
    "table_extents": f"SELECT * FROM {EXTENTS}",
    "cell_grid": f"SELECT * FROM {GRID}",
    "row_signatures": f"SELECT {_T}, r, CASE WHEN NOT blank THEN signature END AS signature, has_symbol FROM {SIGNED}",
    "table_segments": f"SELECT {_T}, segment, role, r FROM {SEGMENTS} WHERE segment <= total",
    "segment_shapes": f"SELECT {_T}, segment, CAST(coalesce(nullif(max(CASE WHEN v <> '' THEN c END), 0), max(max_col)) AS INTEGER) AS width, coalesce(min_by(v, r) FILTER (WHERE role = 'data' AND c = 1 AND v <> ''), '') AS name, CAST(count(DISTINCT r) FILTER (WHERE role = 'header') AS INTEGER) AS n_header, CAST(count(DISTINCT r) FILTER (WHERE role = 'data') AS INTEGER) AS n_data FROM (SELECT s.*, g.c, g.max_col, {strip('g.value')} AS v FROM (SELECT * FROM {SEGMENTS} WHERE segment <= total) s JOIN {FULL} g ON g.doc_id IS NOT DISTINCT FROM s.doc_id AND g.page IS NOT DISTINCT FROM s.page AND g.table_no = s.table_no AND g.r = s.r) GROUP BY {_T}, segment",
    "segment_headers": f"SELECT {_T}, segment, width, name, string_agg(plain, '|' ORDER BY c) AS header, n_rows FROM {_HEADER} GROUP BY {_T}, segment, width, name, n_rows",
    "review_headers": f"SELECT {_T}, segment, string_agg(plain, '|' ORDER BY c) || '|||ステータス' AS header FROM {_HEADER} GROUP BY {_T}, segment",
    "segment_cells": f"SELECT {_T}, segment, CAST(data_row AS INTEGER) AS data_row, CAST(c AS INTEGER) AS col, {_KIND} AS kind FROM (SELECT *, {strip('plain')} AS s FROM {_DATA})",
    "segment_names": f"SELECT {_T}, segment, sheet, file FROM {_SHEETS}",
    "segment_csv": f"SELECT s.file, CAST(r.line AS INTEGER) AS line, string_agg(CASE WHEN regexp_matches(plain, '[\",\\r\\n]') THEN '\"' || replace(plain, '\"', '\"\"') || '\"' ELSE plain END, ',' ORDER BY c) AS value FROM {_ROWS} r JOIN {_SHEETS} s ON s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.page IS NOT DISTINCT FROM r.page AND s.table_no = r.table_no AND s.segment = r.segment GROUP BY ALL",
    "layout_csv": f"SELECT {_T}, CAST(row_no AS INTEGER) AS r, string_agg(plain, chr(9) ORDER BY c) AS line FROM {_LAID} GROUP BY ALL",
    "column_widths": f"SELECT {_T}, segment, CAST(c AS INTEGER) AS col, longest, CASE WHEN longest <= 8 THEN 10 WHEN longest <= 20 THEN 18 WHEN longest <= 40 THEN 28 ELSE 40 END AS width FROM (SELECT {_T}, segment, c, CAST(max(length(plain)) AS INTEGER) AS longest FROM {_ROWS} WHERE plain <> '' GROUP BY ALL)",
    "workbook_facts": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, segment_no) - 1 AS INTEGER) AS n, key, value FROM (SELECT doc_id, 3 AS o, segment_no, 'sheet' AS key, '#' || chr(39) || sheet || chr(39) || '!A1' AS value FROM {_SHEETS} UNION ALL SELECT DISTINCT doc_id, 0, 0, 'format', 'xlsx' FROM {_PER} UNION ALL SELECT DISTINCT doc_id, 1, 0, 'mode', 'table' FROM {_PER} UNION ALL SELECT doc_id, 2, 0, 'sheets', CAST(count(*) AS VARCHAR) FROM {_PER} GROUP BY doc_id)",
    "safe_names": f"SELECT DISTINCT text, {title_of('text', _X)} AS sheet, {table_of('text', _X)} AS display, {file_of('text', _X)} AS file FROM {CELLS} WHERE text IS NOT NULL",
    "html_blocks": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn, idx) - 1 AS INTEGER) AS idx, CAST(rn AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY doc_id, rn ORDER BY idx) AS INTEGER) AS col, {strip('t')} AS text FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY r) AS rn FROM (SELECT concat_ws('/', doc_id, CAST(page AS VARCHAR), CAST(table_no AS VARCHAR)) AS doc_id, idx, coalesce(\"row\", 1) AS r, coalesce(text, '') AS t FROM {CELLS} WHERE doc_id IS NOT NULL))",
    "stripped_tex": f"SELECT region_id, {stripped('text')} AS text FROM {REGIONS} WHERE text IS NOT NULL",
    "relative_crops": f"SELECT cell_id, CASE WHEN ok THEN {_HALF('l * 2480')} END AS left, CASE WHEN ok THEN {_HALF('t * 3508')} END AS top, CASE WHEN ok THEN {_HALF('(l + w) * 2480')} END AS right, CASE WHEN ok THEN {_HALF('(t + h) * 3508')} END AS bottom FROM (SELECT *, w > 0 AND h > 0 AS ok FROM (SELECT cell_id, l, t, least(greatest(0.0::DOUBLE, w0), 1.0 - l) AS w, least(greatest(0.0::DOUBLE, h0), 1.0 - t) AS h FROM (SELECT cell_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_CROP[0]})) AS l, least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_CROP[1]})) AS t, {_CROP[2]} AS w0, {_CROP[3]} AS h0 FROM {CELLS} WHERE len(box) = 4)))",
    "p3_found": f"SELECT min(file_id) AS file_id FROM {_RECORDS} GROUP BY record",
    "p3_compacted": f"SELECT * EXCLUDE (record, k) FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY file_id) AS k FROM {_RECORDS}) WHERE k = 1",
    "math_candidates": f"SELECT layout_id, 0 AS src_no, ord, score FROM (SELECT layout_id, CAST(k AS INTEGER) AS ord, coalesce(p.score, 0.5) AS score, p.contents AS text FROM (SELECT layout_id, paragraphs, generate_subscripts(paragraphs, 1) - 1 AS k, unnest(paragraphs) AS p FROM {LAYOUTS})) WHERE text IS NOT NULL AND {LOOKS_MATH} UNION ALL SELECT layout_id, 1, ord, score FROM (SELECT layout_id, CAST(k AS INTEGER) AS ord, coalesce(p.rec_score, p.det_score, 0.5) AS score, p.content AS text FROM (SELECT layout_id, generate_subscripts(detections, 1) - 1 AS k, unnest(detections) AS p FROM {LAYOUTS})) WHERE text IS NOT NULL AND {LOOKS_MATH}",
    "gated_regions": f"SELECT region_id, {box('box')} AS box FROM {GATED}",
    "top_regions": f"SELECT region_id, CAST(rank AS INTEGER) AS rank, printf('eq_page%03d_%02d.png', page, rank) AS name, {box('[greatest(0, box[1] - 6), greatest(0, box[2] - 6), least(2480, box[3] + 6), least(3508, box[4] + 6)]')} AS crop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, box[2], box[1], ord NULLS FIRST, region_id) AS rank FROM {GATED}) WHERE rank <= 12 AND page IS NOT NULL",
    "detection_boxes": f"SELECT layout_id, pos, CASE WHEN len(x.points) >= 4 THEN {box('[list_min(list_transform(p, lambda q: q[1])), list_min(list_transform(p, lambda q: q[2])), list_max(list_transform(p, lambda q: q[1])), list_max(list_transform(p, lambda q: q[2]))]')} END AS box FROM (SELECT *, list_filter(x.points, lambda q: q IS NOT NULL AND len(q) >= 2) AS p FROM (SELECT layout_id, CAST(generate_subscripts(detections, 1) - 1 AS INTEGER) AS pos, unnest(detections) AS x FROM {LAYOUTS})) WHERE x IS NOT NULL",
    "inner_crops": f"SELECT cell_id, {box('CASE WHEN c[3] <= c[1] OR c[4] <= c[2] THEN box ELSE c END')} AS crop FROM (SELECT cell_id, box, {_CUT} AS c FROM {CELLS} WHERE len(box) = 4)",
    "image_sizes": f"SELECT cell_id, CAST(CASE WHEN m = 2600 THEN w ELSE trunc(w * (2600 / m)) END AS INTEGER) AS ocr_w, CAST(CASE WHEN m = 2600 THEN h ELSE trunc(h * (2600 / m)) END AS INTEGER) AS ocr_h, CAST(CASE WHEN m <= 100 THEN w ELSE greatest(1, round_even(w * (100 / m), 0)) END AS INTEGER) AS preview_w, CAST(CASE WHEN m <= 100 THEN h ELSE greatest(1, round_even(h * (100 / m), 0)) END AS INTEGER) AS preview_h FROM (SELECT cell_id, box[3] - box[1] AS w, box[4] - box[2] AS h, greatest(w, h) AS m FROM {CELLS} WHERE len(box) = 4) WHERE w > 0 AND h > 0",
    "snippet_candidates": f"SELECT doc_id, page, line, rank FROM {contained(PAGE_LINES, SNIPPETS)}",
    "snippet_matches": f"WITH RECURSIVE {matched(PAGE_LINES, SNIPPETS)} SELECT * FROM placed",
    "linked_pages": linked(PAGE_LINES, SNIPPETS),
    "refined_counts": f"SELECT coalesce(b.doc_id, f.doc_id) AS doc_id, coalesce(b.page, f.page) AS page, least(coalesce(blocks, 0), coalesce(n, 0)) AS replaced, greatest(0, coalesce(n, 0) - coalesce(blocks, 0)) AS unused FROM (SELECT doc_id, page, coalesce(max(block), 0) AS blocks FROM {_BLOCKED} GROUP BY ALL) b FULL JOIN (SELECT doc_id, page, count(*) AS n FROM {_FORMULAS} GROUP BY ALL) f ON f.doc_id = b.doc_id AND f.page = b.page",
    "refined_pages": f"SELECT doc_id, page, line, coalesce(r, text) AS text, r IS NOT NULL AS replaced FROM (SELECT b.*, f.r, row_number() OVER (PARTITION BY b.doc_id, b.page, b.block ORDER BY line) AS k FROM {_BLOCKED} b LEFT JOIN (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, region_id) AS block, CASE WHEN isolated THEN '$$' || chr(10) || bare || chr(10) || '$$' ELSE '$' || bare || '$' END AS r FROM {_FORMULAS}) f ON f.doc_id = b.doc_id AND f.page = b.page AND f.block = b.block) WHERE r IS NULL OR k = 1",
    "paired_by_order": f"SELECT region_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord NULLS FIRST, region_id) AS n FROM {REGIONS} WHERE doc_id IS NOT NULL AND page IS NOT NULL) r LEFT JOIN (SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS n FROM (SELECT doc_id, page, CAST(generate_subscripts(detections, 1) - 1 AS INTEGER) AS pos, unnest(detections) AS x FROM {LAYOUTS}) WHERE x IS NOT NULL) b ON b.doc_id = r.doc_id AND b.page = r.page AND b.n = r.n",
    "figure_statistics": f"SELECT * FROM {STATS}",
    "figure_decisions": f"SELECT vec_id, decision, decision IN ('auto_drop', 'too_whitespace', 'likely_icon') AS removed FROM (SELECT vec_id, CASE WHEN width_ratio > 0.35 OR height_ratio > 0.25 OR area_ratio > 0.1 THEN 'keep' WHEN mean_luma >= 245 AND non_white_ratio <= 0.05 THEN 'too_whitespace' WHEN area <= 2500 AND area_ratio <= 0.01 AND unique_colors <= 12 AND avg_std <= 40 THEN 'auto_drop' WHEN area <= 100000 AND area_ratio <= 0.1 AND (unique_colors <= 14 OR dominant_ratio >= 0.7) AND avg_std <= 70 THEN 'likely_icon' ELSE 'keep' END AS decision FROM {STATS})",
    "tone_curves": f"WITH c AS (SELECT vec_id, CAST(x // 8 AS INTEGER) AS tx, CAST(y // 2 AS INTEGER) AS ty, v, count(*) AS n FROM {PIXELS} GROUP BY ALL), d AS (SELECT *, CAST(sum(n) OVER (PARTITION BY vec_id, tx, ty ORDER BY v) AS BIGINT) AS cdf, least(sum(n) OVER (PARTITION BY vec_id, tx, ty ORDER BY v), sum(n) OVER (PARTITION BY vec_id, tx, ty) * 2.0 / 8) AS k FROM c) SELECT vec_id, tx, ty, v, n, cdf, CAST(floor((k - lo) / greatest(1.0, hi - lo) * 255.0 + 0.5) AS INTEGER) AS \"to\" FROM (SELECT *, CASE WHEN min(v) OVER p > 0 THEN 0.0 ELSE min(k) OVER p END AS lo, max(k) OVER p AS hi FROM d WINDOW p AS (PARTITION BY vec_id, tx, ty))",
    "median_thresholds": f"SELECT vec_id, CAST(greatest(110, least(200, px[len(px) // 2 + 1] + 10)) AS INTEGER) AS threshold, len(list_filter(px, lambda p: (CASE WHEN px[-1] > px[1] THEN trunc((p - px[1]) * 255.0 / (px[-1] - px[1])) ELSE p END) < 210)) / len(px) AS black FROM (SELECT vec_id, list_sort(list_transform(embedding, lambda v: {LEVEL})) AS px FROM embeddings)",
    "image_variants": "SELECT vec_id, key, mode, CAST(trunc(1240 * (t / greatest(1240, h))) AS INTEGER) AS new_width, CAST(trunc(h * (t / greatest(1240, h))) AS INTEGER) AS new_height FROM (SELECT vec_id, 1000 + vec_id % 700 AS h FROM embeddings), (VALUES ('ocr_default', 2600, 'L'), ('presentation_color', 2600, 'RGB'), ('chalkboard_strong', 2800, 'L')) p(key, t, mode)",
    "renumbered_figures": f"SELECT layout_id, page, old, printf('fig_page%03d_%02d.png', page, row_number() OVER (PARTITION BY layout_id, page ORDER BY part, n, old)) AS new FROM (SELECT layout_id, page, k % 2 + 1 AS part, k // 2 AS n, printf('page_images_page_%03d_p%d_figure_%d.PNG', page, k % 2 + 1, k // 2) AS old FROM (SELECT layout_id, page, generate_subscripts(figures, 1) - 1 AS k, unnest(figures) AS f FROM {LAYOUTS}))",
    "log_events": f"SELECT event, count(*) AS n, CAST(sum(current) AS BIGINT) AS sum_current, CAST(sum(total) AS BIGINT) AS sum_total FROM {LOG} WHERE event IS NOT NULL GROUP BY event",
    "job_progress": f"SELECT job_id, seq, event, current, total, round(max(least(99.0, 90.0 * least(current, total) / greatest(total, 1))) OVER (PARTITION BY job_id ORDER BY seq), 6) AS progress, CASE WHEN total > current THEN CAST(round(list_avg(list_slice(s, greatest(len(s) - 4, 1), len(s))) * (total - current)) AS BIGINT) END AS eta_seconds FROM (SELECT *, list_filter(list(secs) OVER (PARTITION BY job_id ORDER BY seq), lambda x: x IS NOT NULL) AS s FROM (SELECT *, CASE WHEN event = 'done' AND lag(event) OVER w = 'page' AND ts > lag(ts) OVER w THEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 END AS secs FROM (SELECT * FROM {LOG} WHERE event IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, seq ORDER BY arrived_at) = 1) WINDOW w AS (PARTITION BY job_id ORDER BY seq)) WHERE event = 'done')",
    "job_tail": "SELECT job_id, seq FROM (SELECT DISTINCT job_id, seq FROM progress_log) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 200",
    "marked_log": "SELECT DISTINCT job_id, seq, CASE WHEN starts_with(line, 'stderr') THEN '[err] ' || line ELSE line END AS line FROM progress_log WHERE line IS NOT NULL",
    "progress_stream": f"SELECT job_id, round(coalesce(max(CASE WHEN event = 'done' THEN least(99.0, 90.0 * least(current, total) / greatest(total, 1)) END), 0), 6) AS progress, max_by(current, seq) FILTER (WHERE event IS NOT NULL) AS current, max_by(total, seq) FILTER (WHERE event IS NOT NULL) AS total FROM {LOG} WHERE job_id IS NOT NULL AND seq IS NOT NULL GROUP BY job_id",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_stream_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "sliding_windows": "SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) h(k) WHERE ts IS NOT NULL GROUP BY ALL",
    "sessions": "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS ch FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, g",
    "event_properties": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(length(props) AS INTEGER) AS n FROM events",
    "all_labels": "SELECT label, count(*) AS n FROM (SELECT term AS label FROM term_list UNION ALL SELECT word FROM lexicon) GROUP BY label",
    "first_labels": "SELECT text, min(cell_id) AS cell_id FROM cells WHERE text IS NOT NULL GROUP BY text",
    "terms_not_words": "SELECT lower(term) AS label FROM term_list EXCEPT SELECT lower(word) FROM lexicon",
    "common_labels": "SELECT term FROM term_list INTERSECT SELECT text FROM cells",
    "star_revenue": f"SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {_STAR} GROUP BY ALL",
    "star_rollup": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "star_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "star_unordered": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "star_ranks": "SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "star_asof": "SELECT event_id, (SELECT max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts) AS last_order FROM events",
}

_KINDS = SQL["block_kinds"].replace("SELECT doc_id, line, CASE", "SELECT doc_id, line, s, CASE")
SQL["block_stream"] = f"SELECT doc_id, CAST(block AS BIGINT) AS block, kind, CAST(min(line) AS INTEGER) AS first_line, CAST(max(level) AS INTEGER) AS level, CASE WHEN kind = 'table' THEN string_agg(body, chr(10) ORDER BY line) ELSE {strip("string_agg(body, ' ' ORDER BY line)")} END AS text FROM {_BODIES % _KINDS} WHERE kind <> 'blank' GROUP BY doc_id, block, kind"
