"""All queries of the core, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import corpus, problems, sql, workflow

FLAGSHIP = "math_issue_lines"

QUERIES = {
    **corpus.QUERIES,
    **workflow.QUERIES,
    "p1_elements": problems.p1_elements,
    "p1_found": problems.p1_found,
    "p3_bins": problems.p3_bins,
    "p3_compacted": problems.p3_compacted,
    "p3_found": problems.p3_found,
}

SQL: dict[str, str] = sql.SQL | workflow.SQL
