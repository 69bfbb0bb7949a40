"""HTML rendering of processed pages (K12) as a column.

Pure Catalyst: ``concat`` and ``array_join(transform(...))`` build the
document inside the JVM, one row per page, so rendering runs in whole-stage
codegen and is written with the ordinary file sinks (no file per call).
Values are inserted as they are (no escaping) unless ``escape=True``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults for missing metadata, the missing-cell text, the
# labels and section headings of the page, and the page style sheet.
DEFAULT_TITLE = "Untitled"
DEFAULT_TEXT = "Unknown"
DEFAULT_HREF = "#"
MISSING_CELL = "nan"
LABEL_LAST_MODIFIED = "Last modified: "
LABEL_URL = "URL: "
HEADING_TABLES = "Tables"
HEADING_CODE = "Code Blocks"
HEADING_COMMENTS = "Comments"
STYLE = (
    "body { font-family: Arial, sans-serif; line-height: 1.6; margin: 2rem; }\n"
    ".metadata { background: #f5f5f5; padding: 1rem; margin-bottom: 1rem; }\n"
    ".content { margin-bottom: 2rem; }\n"
    ".tables { margin-top: 2rem; }\n"
    "table { border-collapse: collapse; width: 100%; }\n"
    "th, td { border: 1px solid #ddd; padding: 8px; text-align: left; }\n"
    ".code-block { background: #f8f8f8; padding: 1rem; margin: 1rem 0; }\n"
    ".comments { margin-top: 2rem; border-top: 1px solid #ddd; }\n"
    ".comment { margin: 1rem 0; padding: 1rem; background: #f9f9f9; }\n"
)


def _esc(c: Column, escape: bool) -> Column:
    if not escape:
        return c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _section(arr: Column, head: str, body: Column) -> Column:
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0,
                  F.concat(F.lit(head), body, F.lit("</div>\n"))).otherwise(F.lit(""))


def render_html(processed: DataFrame, escape: bool = False, out_col: str = "html") -> DataFrame:
    """Add ``html``: the page as a standalone HTML document.

    Sections for tables, code blocks and comments appear only when the page
    has some.  Missing metadata values fall back to ``Untitled`` / ``Unknown``
    / ``#``; a missing table cell prints as ``nan``.
    """
    def meta(f, d):
        return _esc(F.coalesce(F.col(f"metadata.{f}"), F.lit(d)), escape)

    title = meta("title", DEFAULT_TITLE)
    tables = F.array_join(F.transform("tables", lambda t: F.concat(
        F.lit("<table><thead><tr>"),
        F.array_join(F.transform(t["headers"], lambda h: F.concat(F.lit("<th>"), _esc(h, escape), F.lit("</th>"))), ""),
        F.lit("</tr></thead><tbody>"),
        F.array_join(F.transform(t["data"], lambda row: F.concat(
            F.lit("<tr>"),
            F.array_join(F.transform(row, lambda c: F.concat(
                F.lit("<td>"), _esc(F.coalesce(c, F.lit(MISSING_CELL)), escape), F.lit("</td>"))), ""),
            F.lit("</tr>"))), ""),
        F.lit("</tbody></table>"))), "")
    codes = F.array_join(F.transform("code_blocks", lambda b: F.concat(
        F.lit('<div class="code-block"><code class="language-'),
        _esc(F.coalesce(b["language"], F.lit("text")), escape), F.lit('">\n'),
        _esc(F.coalesce(b["content"], F.lit("")), escape), F.lit("\n</code></div>\n"))), "")
    comments = F.array_join(F.transform("comments", lambda c: F.concat(
        F.lit('<div class="comment"><p><strong>'), _esc(F.coalesce(c["author"], F.lit(DEFAULT_TEXT)), escape),
        F.lit("</strong> - "), _esc(F.coalesce(c["created"], F.lit(DEFAULT_TEXT)), escape),
        F.lit("</p><p>"), _esc(F.coalesce(c["content"], F.lit("")), escape), F.lit("</p></div>\n"))), "")
    html = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head>\n<title>"), title, F.lit("</title>\n<style>\n" + STYLE + "</style>\n"),
        F.lit('</head>\n<body>\n<div class="metadata">\n<h1>'), title,
        F.lit("</h1>\n<p>" + LABEL_LAST_MODIFIED), meta("last_modified", DEFAULT_TEXT),
        F.lit('</p>\n<p>' + LABEL_URL + '<a href="'), meta("url", DEFAULT_HREF), F.lit('">'), meta("url", DEFAULT_TEXT),
        F.lit('</a></p>\n</div>\n<div class="content">\n'), _esc(F.coalesce("content", F.lit("")), escape),
        F.lit("\n</div>\n"),
        _section(F.col("tables"), f'<div class="tables"><h2>{HEADING_TABLES}</h2>', tables),
        _section(F.col("code_blocks"), f'<div class="code-blocks"><h2>{HEADING_CODE}</h2>\n', codes),
        _section(F.col("comments"), f'<div class="comments"><h2>{HEADING_COMMENTS}</h2>\n', comments),
        F.lit("</body>\n</html>\n"),
    )
    return processed.withColumn(out_col, html)
