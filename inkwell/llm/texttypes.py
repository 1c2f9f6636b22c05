"""Problem 5: text statistics, and with them what is prose and what is a list, a table, formulas or junk.

The statistics are built-in expressions over whole texts. Thresholds on them are noisy labelling functions: each
says yes or no to one type. How far each is to be trusted is learned by expectation-maximization from how they
agree over all texts (one latent type per text, functions independent given the type). Texts with the same votes
have the same posterior, so the learning sees one row per combination of votes, at most 2 to the number of functions,
however many texts there are. Sources whose types differ (pages, regions) are learned apart.

Results for odd input:
  * null, empty and blank texts have null statistics but counts of 0, and no type;
  * a page is the text of its lines without running headers, footers and page numbers; null lines are left out;
  * of rows delivered more than once the latest counts;
  * ties in the posterior go to the first of prose, list, table, formula, junk;
  * no texts at all give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TYPES = ("prose", "list", "table", "formula", "junk")
#: Common words that are looked up; a list of function words has a few thousand at most.
MAX_COMMON = 20_000

# Marks that end a sentence, that start a list item, that belong to formulas.
ENDS = "[.!?。！？]"
ITEM = r"^\s*(?:[-*•・□○●◆]\s*[\p{L}\p{N}]{2}|\([0-9a-z]{1,2}\)\s|[0-9]{1,3}[.)]\s|[0-9]{1,3}(?:\.[0-9]+)+[.)]?\s\s?\S)"
MATH = r"[=≒≠≈÷√∑±^\\]"
NUMBER = r"^\s*[-+]?[0-9０-９][0-9０-９.,/%％:\-]*\s*$"


def parts(text: Column) -> dict[str, Column]:
    """What the statistics are counted in. A projection of its own, so that it is made once a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'’\-]+"), lambda x: x != "")
    return {
        "__dense": F.regexp_replace(text, r"\s+", ""),
        "__lines": F.filter(F.split(text, r"\r\n?|\n"), lambda x: F.trim(x) != ""),
        "__words": words,
    }


def statistics(text: Column, common: Sequence[str]) -> dict[str, Column]:
    """Named statistics of one text, whose ``parts`` are columns."""
    dense, lines, words = F.col("__dense"), F.col("__lines"), F.col("__words")
    n, n_lines, n_words = F.length(dense), F.size(lines), F.size(words)
    latin = F.filter(words, lambda x: x.rlike("[a-zà-ÿœ]"))
    n_latin = F.size(latin)

    def share(test) -> Column:  # noqa: ANN001
        return F.when(n_lines > 0, F.size(F.filter(lines, test)) / n_lines)

    def of_chars(pattern: str) -> Column:
        return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n)

    return {
        "n_chars": n,
        "n_lines": n_lines,
        "n_words": n_words,
        "mean_word_length": F.when(n_words > 0, F.length(F.array_join(words, "")) / n_words),
        "symbol_ratio": of_chars(r"[^\p{L}\p{N}\p{M}\s.,、。・()（）%％'’\-/:ー]"),
        "digit_ratio": of_chars(r"\p{N}"),
        "kana_ratio": of_chars(r"[ぁ-ん]"),
        "ending_lines": share(lambda x: x.rlike(ENDS + r"[\"'」』)）]?\s*$")),
        "sentences": of_chars(r"[\p{L}\p{N}%％)）](?:[.!?](?=\s|$)|[。！？])") * 100,
        "common_words": F.when(n_latin > 0, F.size(F.filter(latin, lambda x: x.isin(list(common)))) / n_latin) if common else F.lit(None).cast("double"),
        "single_letters": F.when(n_words > 0, F.size(F.filter(words, lambda x: (F.length(x) == 1) | x.rlike(r"[a-z][0-9]|[0-9][a-z]"))) / n_words),
        "repeated": F.when(n > 0, 1 - F.length(F.regexp_replace(dense, r"([^0-9])\1{2,}", "")) / n),
        "item_lines": share(lambda x: x.rlike(ITEM)),
        "number_lines": share(lambda x: x.rlike(NUMBER)),
        "delimited_lines": share(lambda x: x.rlike(r"(?:\t[^\t]*){2}|(?:\|[^|]*){3}|(?:\S   ?\S.*){2}|(?:\S,(?=\S)[^,]*){2}")),
        "math_lines": share(lambda x: x.rlike(MATH) & x.rlike(r"[\p{L}\p{N}]")),
        "tex_marks": F.regexp_count(text, F.lit(r"\\[a-z]{3,}\s*[{0-9]")),
        "mean_line_length": F.when(n_lines > 0, n / n_lines),
    }


def labelling_functions() -> list[tuple[str, str, str]]:
    """(name, type, test on the statistics)"""
    worded = "delimited_lines < 0.5 and symbol_ratio + digit_ratio < 0.25 and repeated < 0.2 and (single_letters <= 0.4 or item_lines >= 0.5)"
    clean = "symbol_ratio < 0.35 and repeated < 0.2 and single_letters < 0.45"
    return [
        ("sentences", "prose", "sentences >= 0.7 and n_chars >= 15"),
        ("words_of_prose", "prose", "coalesce(common_words, 0) >= 0.2 or kana_ratio >= 0.25"),
        ("long_clean_lines", "prose", "mean_line_length >= 22 and symbol_ratio < 0.03 and symbol_ratio + digit_ratio < 0.1"),
        ("ends_and_no_delimiters", "prose", "ending_lines > 0 and delimited_lines < 0.2 and item_lines < 0.3 and repeated < 0.2"),
        ("item_marks", "list", "item_lines >= 0.5 and n_lines >= 2 and delimited_lines < 0.5 and math_lines < 0.5 and repeated < 0.3"),
        ("short_lines_without_ends", "list", f"n_lines >= 2 and ending_lines < 0.2 and sentences < 0.4 and mean_line_length < 40 and number_lines < 0.2 and {worded}"),
        ("few_figures_many_lines", "list", f"n_lines >= 3 and number_lines < 0.1 and kana_ratio < 0.25 and coalesce(common_words, 0) < 0.2 and sentences < 0.4 and {worded}"),
        ("delimiters", "table", f"delimited_lines >= 0.6 and n_lines >= 2 and {clean}"),
        ("number_cells", "table", "number_lines >= 0.3 and n_lines >= 4"),
        ("many_figures_few_signs", "table", f"digit_ratio >= 0.2 and n_lines >= 2 and math_lines < 0.3 and (delimited_lines >= 0.3 or number_lines >= 0.2) and {clean}"),
        ("math_signs", "formula", "math_lines >= 0.6 and (symbol_ratio < 0.45 or tex_marks > 0) and repeated < 0.3"),
        ("short_with_figures", "formula", "math_lines >= 0.5 and digit_ratio between 0.03 and 0.8 and mean_line_length < 45 and n_chars >= 5 and sentences < 1.5 and (symbol_ratio < 0.4 or tex_marks > 0)"),
        ("symbols", "junk", "tex_marks = 0 and (symbol_ratio >= 0.45 or (symbol_ratio >= 0.25 and digit_ratio < 0.02 and math_lines < 0.99))"),
        ("repeats", "junk", "repeated >= 0.3"),
        ("loose_letters", "junk", "single_letters >= 0.45 and kana_ratio < 0.05 and n_words >= 3 and math_lines < 0.5 and item_lines < 0.5"),
        ("no_words", "junk", "coalesce(common_words, 0) = 0 and kana_ratio < 0.02 and item_lines < 0.5 and delimited_lines < 0.5 and number_lines < 0.15 and sentences < 0.5 and (single_letters >= 0.3 or repeated >= 0.2 or symbol_ratio >= 0.2) and math_lines < 0.9"),
    ]


def learn(votes: np.ndarray, counts: np.ndarray, types: Sequence[str], rounds: int = 60) -> np.ndarray:
    """Posterior of each type (columns) for each combination of votes (rows of 0 and 1)."""
    target = np.array([types.index(t) if t in types else -1 for _, t, _ in labelling_functions()])
    say = np.full((len(types), votes.shape[1]), 0.05)
    for j, t in enumerate(target):
        if t >= 0:
            say[t, j] = 0.8
    prior = np.full(len(types), 1 / len(types))
    post = np.zeros((len(votes), len(types)))
    for _ in range(rounds):
        score = np.log(prior) + votes @ np.log(say).T + (1 - votes) @ np.log(1 - say).T
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
        mass = post * counts[:, None]
        total = mass.sum(axis=0)
        prior = (total + 1) / (total.sum() + len(types))
        # a pseudo-count keeps rare types near what their functions were written for
        start = np.where(target[None, :] == np.arange(len(types))[:, None], 0.8, 0.05)
        say = np.clip((mass.T @ votes + 4 * start) / (total[:, None] + 4), 0.002, 0.998)
    return post


def texts_with_statistics(texts: DataFrame, common: DataFrame) -> DataFrame:
    """``texts`` (src, row_id, order, text) with all statistics and the votes as bits of ``votes``. Blank texts have no votes."""
    words = [r.w for r in common.select(F.lower("word").alias("w")).where("w rlike '[a-zà-ÿœ]'").distinct().limit(MAX_COMMON + 1).collect()]
    if len(words) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words; give a list of function words")
    stats = statistics(F.col("text"), sorted(words))
    made = texts.select("src", "row_id", "order", "text", *[c.alias(k) for k, c in parts(F.col("text")).items()])
    df = made.select("src", "row_id", "order", *[c.alias(k) for k, c in stats.items()])
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, _, test) in enumerate(labelling_functions())]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return df.withColumn("votes", F.when(F.col("n_chars") > 0, total))


def classify(texts: DataFrame, common: DataFrame, without: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(src, row_id, kind, posterior, statistics) of every text that is not blank. ``without``: types a source does not have."""
    names = list(statistics(F.lit(""), [""]))
    scored = texts_with_statistics(texts, common).where("votes is not null")
    last = scored.groupBy("src", "row_id").agg(F.max(F.struct("order", "votes", *names)).alias("r")).select("src", "row_id", "r.votes", *[f"r.{n}" for n in names])
    scored = materialize(last, "votes")
    seen = scored.groupBy("src", "votes").count().collect()  # at most 2 to the number of functions, a source
    n = len(labelling_functions())
    rows = []
    for src in sorted({r.src for r in seen}):
        types = [t for t in TYPES if t not in (without or {}).get(src, ())]
        mine = [r for r in seen if r.src == src]
        votes = np.array([[r.votes >> k & 1 for k in range(n)] for r in mine], dtype=float)
        post = learn(votes, np.array([r["count"] for r in mine], dtype=float), types)
        rows += [(src, r.votes, types[int(p.argmax())], float(p.max())) for r, p in zip(mine, post)]
    kinds = texts.sparkSession.createDataFrame(rows, "src string, votes int, kind string, posterior double")
    return scored.join(F.broadcast(kinds), ["src", "votes"]).drop("votes")


def page_texts(pages: DataFrame, top: float = 0.085, bottom: float = 0.93, height: int = 3508) -> DataFrame:
    """(layout_id, order, text) of the lines of each page that do not run in its margins."""
    y = lambda d: F.coalesce(F.get(d["box"], F.lit(1)), F.array_min(F.transform(F.filter(d["points"], lambda p: p.isNotNull()), lambda p: F.get(p, F.lit(1)))))
    body = F.filter("detections", lambda d: d["content"].isNotNull() & F.coalesce(y(d).between(int(top * height), int(bottom * height)), F.lit(True)))
    return pages.select("layout_id", F.col("ingested_at").alias("order"), F.array_join(F.transform(body, lambda d: d["content"]), "\n").alias("text"))
