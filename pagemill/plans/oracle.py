"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code: the adapters' rules are restated in
SQL over the driver's views (``pages``, ``part``, ``lineitem`` ...).  Shared
pieces are plain SQL text composed with ``format``.
"""

from __future__ import annotations

from pagemill.functions.text import PY_WS_CLASS

WS = PY_WS_CLASS
BASE = "https://wiki.example.com"


def _norm(expr: str) -> str:
    """Python ``" ".join(s.split())`` in SQL."""
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def _strip(expr: str) -> str:
    """Python ``s.strip()`` in SQL."""
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


# Cleaned text of the driver's pages (valid for this data: four entity names
# occur, and '&amp;' is decoded last).  Not an HTML parser - an oracle only.
CLEAN_PAGES = _norm(
    "regexp_replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(html, "
    "'(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), "
    "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '<[^>]+>', '', 'g')"
)

WIKI_PAGES = f"""
SELECT CAST(page_id AS VARCHAR) AS id,
       regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
       html AS content, url,
       CAST(page_id % 5 AS VARCHAR) AS version,
       CASE WHEN page_id % 7 = 0 THEN ''
            ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id), '%Y-%m-%dT%H:%M:%S') END
         AS last_modified,
       regexp_extract(url, '/(en|fr|de|es)/', 1) AS space_key,
       page_id, html
FROM pages
"""

ATTACHMENTS = f"""
SELECT CAST(p_partkey % 50 AS VARCHAR) AS page_id, CAST(p_partkey // 50 AS INTEGER) AS pos,
       'att-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_name AS filename,
       CASE WHEN p_size % 10 = 0 THEN '' ELSE coalesce(p_type, '') END AS mediaType,
       coalesce(CAST(p_size AS BIGINT) * 1024, 0) AS size,
       '{BASE}/wiki/download/attachments/' || CAST(p_partkey % 50 AS VARCHAR) || '/' || p_name AS url
FROM part
"""

COMMENTS = """
SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(turn AS INTEGER) AS pos,
       CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, role AS author,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn), '%Y-%m-%dT%H:%M:%S') AS created,
       '<p>' || text || '</p>' AS content, text
FROM conversations
"""

CHILDREN = f"""
a AS (SELECT page_id, count(*) AS n_attachments, CAST(sum(size) AS BIGINT) AS attachment_bytes
      FROM ({ATTACHMENTS}) GROUP BY page_id),
c AS (SELECT page_id, count(*) AS n_comments FROM ({COMMENTS}) GROUP BY page_id)
"""

# Line-item table pages: page id, row order and the displayed columns.
TABLE_ROWS = """
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber // 1000 AS VARCHAR) AS page_id, l_orderkey,
             CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber // 1000 ORDER BY l_linenumber, l_partkey, l_quantity,
                  l_extendedprice, l_returnflag, l_shipdate) - 1 AS INTEGER) AS row_idx,
             CAST(l_linenumber AS VARCHAR) AS c0, CAST(l_partkey AS VARCHAR) AS c1,
             CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) AS c2,
             CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS c3,
             l_returnflag AS c4, strftime(l_shipdate, '%Y-%m-%d') AS c5,
             CASE l_orderkey % 4 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) || 'd' WHEN 1 THEN CAST(l_linenumber AS VARCHAR) || 'e3'
                  WHEN 2 THEN CAST(l_linenumber AS VARCHAR) || ',234'
                  ELSE '-' || CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) END AS c6,
             CAST(NULL AS VARCHAR) AS c7, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'NA' END AS note
      FROM lineitem)
"""
TABLE_COLS = ("linenumber", "partkey", "quantity", "extendedprice", "returnflag", "shipdate", "size", "note")
# Long form; a column is a number if it has values and all of them can be cast.
TABLE_LONG = TABLE_ROWS + """,
l AS (""" + " UNION ALL ".join(f"SELECT page_id, row_idx, {j} AS col_idx, '{h}' AS header, c{j} AS value FROM r"
                             for j, h in enumerate(TABLE_COLS)) + """),
n AS (SELECT *, TRY_CAST(replace(value, ',', '') AS DOUBLE) AS num FROM l),
k AS (SELECT page_id, col_idx, CASE WHEN count(value) > 0 AND count(value) = count(num) THEN 'number' ELSE 'string' END AS col_type
      FROM n GROUP BY page_id, col_idx)
"""


SQL: dict[str, str] = {}

SQL["page_scan"] = f"""
SELECT id, title, content, '{BASE}/wiki/spaces/' || space_key || '/pages/' || id AS url,
       version, last_modified, space_key
FROM ({WIKI_PAGES})
"""

SQL["page_lookup"] = f"""
SELECT id, title, content, '{BASE}/wiki/pages/' || id AS url, version, last_modified, space_key
FROM ({WIKI_PAGES}) WHERE id = '7'
"""

SQL["clean_text"] = f"SELECT CAST(page_id AS VARCHAR) AS id, {CLEAN_PAGES} AS content FROM pages"

SQL["page_metadata"] = f"""
SELECT id, title, url, version, last_modified, 'confluence' AS source FROM ({WIKI_PAGES})
"""

SQL["attachment_scan"] = f"SELECT page_id, pos, id, title, filename, mediaType, size, url FROM ({ATTACHMENTS})"

SQL["comment_scan"] = f"SELECT page_id, pos, id, author, created, content FROM ({COMMENTS})"

SQL["comments_clean"] = f"""
SELECT page_id, pos, id, author, created, {_norm('text')} AS content FROM ({COMMENTS})
"""

SQL["attachments_projection"] = f"""
SELECT page_id, pos, id, filename, size, mediaType AS media_type FROM ({ATTACHMENTS})
"""

SQL["page_children"] = f"""
WITH {CHILDREN}
SELECT CAST(p.page_id AS VARCHAR) AS id,
       coalesce(a.n_attachments, 0) AS n_attachments, coalesce(a.attachment_bytes, 0) AS attachment_bytes,
       coalesce(c.n_comments, 0) AS n_comments
FROM pages p
LEFT JOIN a ON a.page_id = CAST(p.page_id AS VARCHAR)
LEFT JOIN c ON c.page_id = CAST(p.page_id AS VARCHAR)
"""

SQL["dead_letter"] = """
SELECT CAST(page_id AS VARCHAR) AS id, 'text' AS part,
       'Failed to process text: TypeError: content is null' AS message,
       'ProcessingError' AS error_type, 500 AS status_code
FROM pages WHERE page_id % 11 = 0
"""

SQL["table_cells"] = TABLE_LONG + """
SELECT n.page_id, 0 AS table_idx, n.row_idx, n.col_idx, n.header, n.value, k.col_type AS value_type,
       CASE WHEN k.col_type = 'number' THEN n.num END AS value_double
FROM n JOIN k ON n.page_id = k.page_id AND n.col_idx = k.col_idx
"""

SQL["table_shapes"] = TABLE_ROWS + """
SELECT page_id, 0 AS table_idx, CAST(count(*) AS INTEGER) AS n_rows, 8 AS n_cols,
       'linenumber|partkey|quantity|extendedprice|returnflag|shipdate|size|note' AS headers
FROM r GROUP BY page_id
"""

SQL["table_column_types"] = TABLE_LONG + """
SELECT DISTINCT n.page_id, 0 AS table_idx, n.col_idx, n.header, k.col_type
FROM n JOIN k ON n.page_id = k.page_id AND n.col_idx = k.col_idx
"""

SQL["code_blocks"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS page_id, 0 AS block_idx, 'text' AS language, {_strip('text')} AS content
FROM documents
UNION ALL
SELECT CAST(doc_id AS VARCHAR) AS page_id, 1 AS block_idx, 'language-' || lang AS language,
       {_strip('text')} AS content
FROM documents
"""


# -- step 4 ------------------------------------------------------------------
def _words(expr: str) -> str:
    n = _norm(f"coalesce({expr}, '')")
    return f"(CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END)"


def _sentences(expr: str) -> str:
    return f"len(regexp_split_to_array(coalesce({expr}, ''), '[.!?]+'))"


def _readability(expr: str) -> str:
    return (f"greatest(0.0, least(100.0, 206.835 - 1.015 * (CAST({_words(expr)} AS DOUBLE) / "
            f"CAST(greatest({_sentences(expr)}, 1) AS DOUBLE))))")


def _share(flags: list[str]) -> str:
    n = " + ".join(f"(CASE WHEN {f} THEN 1 ELSE 0 END)" for f in flags)
    return f"(({n}) / {len(flags)}) * 100"


def _meta_share(a: str = "") -> str:
    return _share([f"{a}id <> ''", f"{a}title <> ''", f"{a}url <> ''",
                   f"{a}version <> '' AND {a}version <> '0'", f"{a}last_modified <> ''"])


QUALITY_PAGES = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS title, text AS content,
       '{BASE}/wiki/pages/' || CAST(doc_id AS VARCHAR) AS url, CAST(doc_id % 5 AS VARCHAR) AS version,
       CASE WHEN doc_id % 7 = 0 THEN ''
            ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S') END
         AS last_modified
FROM documents
"""

_MARKS = ("<h1>", "<h2>", "<p>", "<table>", "<code>")


def _page_scores(src: str, content: str, extra_flags: list[str]) -> str:
    return f"""
SELECT id, CAST({_words(content)} AS INTEGER) AS n_words, CAST({_sentences(content)} AS INTEGER) AS n_sentences,
       {_readability(content)} AS readability,
       {_share([f"coalesce({content}, '') <> ''", 'TRUE'] + extra_flags)} AS content_completeness,
       {_meta_share()} AS metadata_completeness,
       {_share([f"contains(coalesce({content}, ''), '{m}')" for m in _MARKS])} AS formatting_quality
FROM ({src})
"""


SQL["document_quality"] = _page_scores(QUALITY_PAGES, "content", ["FALSE", "FALSE", "FALSE"])

# The mixed corpus: wiki pages, order tables and code pages with their cleaned text, raw
# HTML, and the tables, code blocks and comments they hold.
_STAMP = "CASE WHEN {n} % 7 = 0 THEN '' ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes({n}), '%Y-%m-%dT%H:%M:%S') END"
_ROW_TEXT = " || ' ' || ".join(f"c{j}" for j in range(7)) + " || CASE WHEN note = '' THEN '' ELSE ' ' || note END"
_ROW_HTML = "'<tr><td>' || " + " || '</td><td>' || ".join(f"c{j}" for j in range(7)) + " || '</td><td>' || note || '</td></tr>'"
_HEAD_HTML = "".join(f"<th>{h}</th>" for h in TABLE_COLS)
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
CORPUS = f"""
{TABLE_ROWS},
{CHILDREN},
tp AS (SELECT page_id, any_value(l_orderkey) AS num, string_agg({_ROW_TEXT}, ' ' ORDER BY row_idx) AS words,
              string_agg({_ROW_HTML}, '' ORDER BY row_idx) AS body FROM r GROUP BY page_id),
corpus AS (
SELECT 'p' || w.id AS id, w.title, {CLEAN_PAGES.replace('html', 'w.html')} AS content, w.html AS html, w.url, w.version, w.last_modified,
       0 AS n_tables, 0 AS n_code_blocks, coalesce(a.n_attachments, 0) AS n_attachments, coalesce(c.n_comments, 0) AS n_comments
FROM ({WIKI_PAGES}) w LEFT JOIN a ON a.page_id = w.id LEFT JOIN c ON c.page_id = w.id
UNION ALL
SELECT 't' || page_id, 'Order', 'Order ' || page_id || ' {' '.join(TABLE_COLS)} ' || words,
       '<h2>Order ' || page_id || '</h2><table><thead><tr>{_HEAD_HTML}</tr></thead><tbody>' || body || '</tbody></table>',
       '{BASE}/' || page_id, '1', {_STAMP.format(n='num')}, 1, 0, 0, 0
FROM tp
UNION ALL
SELECT 'c' || CAST(doc_id AS VARCHAR), 'Code', {_norm("regexp_replace(text, '<[^>]+>', '', 'g')")},
       '<pre><code class="language-' || lang || '">' || {_ESCAPED} || '</code></pre>',
       '{BASE}/' || CAST(doc_id AS VARCHAR), '1', {_STAMP.format(n='doc_id')}, 0, 2, 0, 0
FROM documents)
"""
SQL["process_pages"] = CORPUS + """
SELECT id, content, title, url, version, last_modified, 'confluence' AS source, n_tables, n_code_blocks, 0 AS n_errors,
       n_attachments, n_comments FROM corpus
"""
_PARTS = ["n_tables > 0", "n_code_blocks > 0", "n_comments > 0"]
SQL["page_quality"] = CORPUS + _page_scores("SELECT * FROM corpus", "content", _PARTS)

_Q = ("readability", "content_completeness", "metadata_completeness", "formatting_quality")
SQL["corpus_quality"] = CORPUS + ", s AS (" + _page_scores("SELECT * FROM corpus", "content", _PARTS) + ") SELECT " + ", ".join(
    f"round(coalesce(avg({s}), 0.0), 6) AS avg_{s}, CAST(coalesce(min({s}), 0.0) AS DOUBLE) AS min_{s}, "
    f"CAST(coalesce(max({s}), 0.0) AS DOUBLE) AS max_{s}" for s in _Q
) + ", round((" + " + ".join(f"coalesce(avg({s}), 0.0)" for s in _Q) + ") / 4.0, 6) AS quality_score FROM s"

SQL["raw_html_quality"] = CORPUS + _page_scores("SELECT * FROM corpus", "html", _PARTS)

SQL["corpus_summary"] = CORPUS + f""",
d AS (SELECT *, CASE WHEN last_modified <> '' THEN CAST(last_modified AS TIMESTAMP) END AS ts FROM corpus),
g AS (SELECT count(*) AS total_pages, CAST(sum({_words('content')}) AS BIGINT) AS total_words,
             CAST(sum(n_tables) AS BIGINT) AS total_tables, CAST(sum(n_code_blocks) AS BIGINT) AS total_code_blocks,
             CAST(sum(n_comments) AS BIGINT) AS total_comments, min(ts) AS oldest, max(ts) AS newest FROM d)
SELECT total_pages, total_words, total_tables, total_code_blocks, total_comments,
       total_words / total_pages AS words_per_page, total_tables / total_pages AS tables_per_page,
       total_code_blocks / total_pages AS code_blocks_per_page, total_comments / total_pages AS comments_per_page,
       strftime(oldest, '%Y-%m-%dT%H:%M:%S') AS oldest_page, strftime(newest, '%Y-%m-%dT%H:%M:%S') AS newest_page,
       (SELECT min(id) FROM d WHERE ts = oldest) AS oldest_page_id, (SELECT min(id) FROM d WHERE ts = newest) AS newest_page_id
FROM g
"""

# -- step 5 ------------------------------------------------------------------
SQL["rate_flag"] = """
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
s AS (SELECT DISTINCT user_id, sec FROM e),
c AS (SELECT user_id, sec, count(*) OVER (PARTITION BY user_id ORDER BY sec
                                          RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT e.event_id, e.user_id, e.sec, c.n AS n_in_window, c.n > 4 AS flagged
FROM e JOIN c ON e.user_id = c.user_id AND e.sec = c.sec
"""

SQL["rate_flag_by_function"] = """
WITH e AS (SELECT event_id, 'rate_limit:' || event_type || ':' || CAST(user_id AS VARCHAR) AS rate_key,
                  CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
s AS (SELECT DISTINCT rate_key, sec FROM e),
c AS (SELECT rate_key, sec, count(*) OVER (PARTITION BY rate_key ORDER BY sec
                                           RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT e.event_id, e.rate_key, e.sec, c.n AS n_in_window, c.n > 1 AS flagged
FROM e JOIN c ON e.rate_key = c.rate_key AND e.sec = c.sec
"""

_REQ = ("SELECT event_type AS method, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, "
        "value AS duration FROM events")
SQL["request_counter"] = f"SELECT method, status, count(*) AS n FROM ({_REQ}) GROUP BY method, status"

_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
SQL["latency_histogram"] = " UNION ALL ".join(
    [f"SELECT method, '{b!r}' AS le, CAST(count(*) FILTER (WHERE duration <= {b!r}) AS BIGINT) AS cumulative_count "
     f"FROM ({_REQ}) GROUP BY method" for b in _BUCKETS]
    + [f"SELECT method, '+Inf' AS le, CAST(count(duration) AS BIGINT) AS cumulative_count FROM ({_REQ}) GROUP BY method"]
)
SQL["latency_totals"] = f"SELECT method, count(duration) AS n, round(sum(duration), 6) AS total FROM ({_REQ}) GROUP BY method"


# -- step 6 ------------------------------------------------------------------
WORKLIST = """
SELECT CASE page_id % 3 WHEN 0 THEN '  CONF_' || CAST(page_id AS VARCHAR)
                        WHEN 1 THEN chr(9) || 'CONF_' || CAST(page_id * 2 AS VARCHAR)
                        ELSE 'CONF_' || CAST(page_id AS VARCHAR) || ' ' END AS value FROM pages
UNION ALL SELECT 'SPACE_' || regexp_extract(url, '/(en|fr|de|es)/', 1) FROM pages
UNION ALL SELECT 'JIRA_P' || CAST(o_custkey % 10 AS VARCHAR) || '-' || CAST(o_orderkey + o_orderkey % 100 AS VARCHAR)
          FROM orders
UNION ALL SELECT 'PROJECT_P' || CAST(o_orderkey % 12 AS VARCHAR) FROM orders
UNION ALL SELECT CASE WHEN page_id % 20 = 0 THEN '   ' ELSE 'X_' || CAST(page_id AS VARCHAR) END FROM pages
"""

ROUTED = f"""
WITH it AS (SELECT {_strip('value')} AS item FROM ({WORKLIST})),
r AS (SELECT item,
             CASE WHEN starts_with(item, 'SPACE_') THEN 'space' WHEN starts_with(item, 'CONF_') THEN 'page'
                  WHEN starts_with(item, 'JIRA_') THEN 'issue' WHEN starts_with(item, 'PROJECT_') THEN 'project'
                  ELSE 'unknown' END AS kind,
             CASE WHEN starts_with(item, 'SPACE_') THEN substr(item, 7) WHEN starts_with(item, 'CONF_') THEN substr(item, 6)
                  WHEN starts_with(item, 'JIRA_') THEN substr(item, 6) WHEN starts_with(item, 'PROJECT_') THEN substr(item, 9)
                  END AS ref
      FROM it WHERE item <> ''),
k AS (SELECT DISTINCT 'page' AS kind, CAST(page_id AS VARCHAR) AS ref FROM pages
      UNION SELECT DISTINCT 'issue', 'P' || CAST(o_custkey % 10 AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) FROM orders),
o AS (SELECT r.item, r.kind, r.ref,
             CASE WHEN r.kind = 'unknown' THEN 'skipped'
                  WHEN r.kind IN ('space', 'project') THEN 'successful'
                  WHEN k.ref IS NOT NULL THEN 'successful' ELSE 'failed' END AS status
      FROM r LEFT JOIN k ON r.kind = k.kind AND r.ref = k.ref)
"""

SQL["worklist_route"] = ROUTED + """
SELECT item, kind, ref, status, CASE WHEN status = 'failed' THEN 'not found: ' || item END AS error FROM o
"""
SQL["batch_result"] = ROUTED + "SELECT status, count(*) AS n FROM o GROUP BY status"

SQL["page_union"] = f"""
WITH w AS ({WIKI_PAGES})
SELECT id, space_key, '{BASE}/wiki/spaces/' || space_key || '/pages/' || id AS url FROM w WHERE space_key = 'en'
UNION ALL SELECT id, space_key, '{BASE}/wiki/spaces/' || space_key || '/pages/' || id FROM w WHERE space_key = 'fr'
UNION ALL SELECT id, space_key, '{BASE}/wiki/spaces/' || space_key || '/pages/' || id FROM w
"""

FILE_ENTRIES = """
WITH p AS (SELECT page_id, CAST(length(html) AS BIGINT) AS n, CAST(page_id AS VARCHAR) AS pid FROM pages)
SELECT 'page_' || pid || '_raw.json' AS name, n AS length FROM p
UNION ALL SELECT 'page_' || pid || '_processed.JSON', n * 1024 FROM p
UNION ALL SELECT CASE page_id % 11 WHEN 0 THEN 'page_' || pid || '_error.txt'
                                  WHEN 1 THEN '.page_' || pid || '.hid.json'
                                  WHEN 2 THEN 'trail' || pid || '.'
                                  WHEN 3 THEN 'noext' || pid
                                  ELSE 'a.' || pid || '.B.TXT' END,
                 n * CAST(pow(1024, page_id % 5) AS BIGINT) FROM p
"""


def _readable(size: str) -> str:
    """Exact half-even two-decimal size text (mirror of the S9 rule)."""
    s = f"(CAST({size} AS HUGEINT) * 100)"
    branches = []
    units = ("B", "KB", "MB", "GB", "TB")
    for k, unit in enumerate(units):
        d = 1024 ** k
        q = f"({s} // {d} + CASE WHEN 2 * ({s} % {d}) > {d} OR (2 * ({s} % {d}) = {d} AND ({s} // {d}) % 2 = 1) " \
            f"THEN 1 ELSE 0 END)"
        txt = f"CAST({q} // 100 AS VARCHAR) || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0') || ' {unit}'"
        if unit == "TB":
            branches.append(f"ELSE {txt}")
        else:
            branches.append(f"WHEN CAST({size} AS HUGEINT) < {1024 ** (k + 1)} THEN {txt}")
    return f"CASE WHEN {size} IS NULL THEN '0 B' " + " ".join(branches) + " END"


SQL["file_inventory"] = f"""
WITH e AS ({FILE_ENTRIES}),
g AS (SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT contains(name, '_error')) AS successful_files,
             count(*) FILTER (WHERE contains(name, '_error')) AS failed_files,
             CAST(coalesce(sum(length), 0) AS BIGINT) AS total_size FROM e)
SELECT total_files, successful_files, failed_files, total_size, {_readable('total_size')} AS total_size_readable FROM g
"""

SQL["file_types"] = f"""
WITH e AS ({FILE_ENTRIES})
SELECT lower(regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1)) AS ext, count(*) AS n FROM e GROUP BY 1
"""

SQL["readable_size"] = f"""
WITH d AS (SELECT doc_id, n_chars * CAST(pow(1024, doc_id % 5) AS BIGINT) + (doc_id % 7) * 37 AS size FROM documents)
SELECT doc_id, size, {_readable('size')} AS readable FROM d
"""


# -- step 7 ------------------------------------------------------------------
def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _render_sql() -> str:
    from pagemill.operators.render import STYLE
    head = _lit("<!DOCTYPE html>\n<html>\n<head>\n<title>")
    code = (f"{_lit('<div class=\"code-blocks\"><h2>Code Blocks</h2>' + chr(10))} || "
            f"{_lit('<div class=\"code-block\"><code class=\"language-text\">' + chr(10))} || {_strip('text')} || "
            f"{_lit(chr(10) + '</code></div>' + chr(10))} || "
            f"{_lit('<div class=\"code-block\"><code class=\"language-')} || 'language-' || lang || {_lit('\">' + chr(10))} || "
            f"{_strip('text')} || {_lit(chr(10) + '</code></div>' + chr(10))} || {_lit('</div>' + chr(10))}")
    return f"""
SELECT CAST(doc_id AS VARCHAR) AS id,
  {head} || '' || {_lit('</title>' + chr(10) + '<style>' + chr(10) + STYLE + '</style>' + chr(10))} ||
  {_lit('</head>' + chr(10) + '<body>' + chr(10) + '<div class="metadata">' + chr(10) + '<h1>')} || '' ||
  {_lit('</h1>' + chr(10) + '<p>Last modified: ')} || '' || {_lit('</p>' + chr(10) + '<p>URL: <a href="')} || '' ||
  {_lit('">')} || '' || {_lit('</a></p>' + chr(10) + '</div>' + chr(10) + '<div class="content">' + chr(10))} ||
  {_norm('text')} || {_lit(chr(10) + '</div>' + chr(10))} || {code} || {_lit('</body>' + chr(10) + '</html>' + chr(10))}
  AS html
FROM documents
"""


SQL["render_html"] = _render_sql()

# -- step 9 ------------------------------------------------------------------
ISSUES = """
SELECT 'P' || CAST(o_custkey % 10 AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS key,
       'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
       '<p>' || o_orderpriority || ' order for <b>' || coalesce(c_name, 'unknown') || '</b> worth '
         || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) || '</p>' AS description,
       CASE o_orderkey % 3 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Story' ELSE 'Task' END AS type,
       CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Open' END
         AS status,
       o_orderpriority AS priority,
       CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE c_name END AS assignee,
       'P' || CAST(o_custkey % 10 AS VARCHAR) AS project,
       'Sprint ' || strftime(o_orderdate, '%Y-%m') AS sprint,
       CAST(o_orderdate AS TIMESTAMP) AS created,
       CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS updated,
       o_orderkey, c_name, o_totalprice, o_orderpriority
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""

_ISSUE_OUT = ("key, title, type, status, priority, assignee, project, sprint, "
              "strftime(created, '%Y-%m-%dT%H:%M:%S') AS created, strftime(updated, '%Y-%m-%dT%H:%M:%S') AS updated")

SQL["issue_scan"] = f"SELECT {_ISSUE_OUT} FROM ({ISSUES}) WHERE project = 'P3'"
SQL["issue_first"] = f"SELECT {_ISSUE_OUT} FROM (SELECT * FROM ({ISSUES}) WHERE project = 'P3' ORDER BY o_orderkey LIMIT 1000)"
SQL["issue_lookup"] = f"SELECT {_ISSUE_OUT} FROM ({ISSUES}) WHERE key IN (" + \
    ", ".join(f"'P{i}-7'" for i in range(10)) + ")"

SPRINTS = f"""
SELECT CAST(replace(substr(sprint, 8, 7), '-', '') AS BIGINT) * 100 + CAST(substr(project, 2) AS BIGINT) AS id,
       sprint AS name, project, min(created) AS start, max(updated) AS "end"
FROM ({ISSUES}) GROUP BY project, sprint
"""
SQL["sprint_scan"] = f"""
SELECT id, name, project, strftime(start, '%Y-%m-%dT%H:%M:%S') AS start, strftime("end", '%Y-%m-%dT%H:%M:%S') AS "end"
FROM ({SPRINTS}) WHERE project = 'P3'
"""
SQL["sprint_issues"] = f"""
WITH s AS (SELECT * FROM ({SPRINTS}) WHERE project = 'P3' AND name = 'Sprint 1996-01' ORDER BY id LIMIT 1)
SELECT i.key, i.title, i.status, s.id AS sprint_id, strftime(i.created, '%Y-%m-%dT%H:%M:%S') AS created
FROM ({ISSUES}) i JOIN s ON i.project = s.project AND i.sprint = s.name
"""
SQL["issue_process"] = f"""
SELECT key, {_norm("o_orderpriority || ' order for ' || coalesce(c_name, 'unknown') || ' worth ' || "
                   "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR)")} AS content,
       title, type, status, priority, assignee,
       strftime(created, '%Y-%m-%dT%H:%M:%S') AS created, strftime(updated, '%Y-%m-%dT%H:%M:%S') AS updated
FROM ({ISSUES})
"""
_COMMENT_COUNTS = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey"
SQL["issue_children"] = f"""
SELECT i.key, coalesce(c.n, 0) AS n_comments
FROM ({ISSUES}) i LEFT JOIN ({_COMMENT_COUNTS}) c ON c.l_orderkey = i.o_orderkey
"""
_KEYS = "SELECT o_orderkey, 'P' || CAST(o_custkey % 10 AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS key FROM orders"
_LINE = "'Line ' || CAST(l_linenumber AS VARCHAR) || ': quantity ' || CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR)"
_COMMENT_ID = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)"
SQL["issue_comments"] = f"""
SELECT k.key, CAST(l_linenumber AS INTEGER) AS pos, {_COMMENT_ID} AS id, 'supplier-' || CAST(l_suppkey AS VARCHAR) AS author,
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS created, {_LINE} AS content
FROM lineitem JOIN ({_KEYS}) k ON k.o_orderkey = l_orderkey
"""
SQL["issue_attachment_rows"] = f"""
SELECT k.key, CAST(l_linenumber AS INTEGER) AS pos, 'att-' || {_COMMENT_ID} AS id, p_name AS filename,
       CAST(p_size AS BIGINT) * 1024 AS size, coalesce(p_type, '') AS media_type
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN ({_KEYS}) k ON k.o_orderkey = l_orderkey
"""
SQL["issue_links"] = f"""
SELECT k.key, CASE WHEN l_returnflag = 'R' THEN 'blocks' ELSE 'relates to' END AS type, 'PART-' || CAST(l_partkey AS VARCHAR) AS linked
FROM lineitem JOIN ({_KEYS}) k ON k.o_orderkey = l_orderkey
"""
SQL["issue_changes"] = f"""
SELECT k.key, 'supplier-' || CAST(l_suppkey AS VARCHAR) AS author, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS created,
       'status' AS field, 'Open' AS "from", l_linestatus AS "to"
FROM lineitem JOIN ({_KEYS}) k ON k.o_orderkey = l_orderkey
"""
SQL["issue_contents"] = f"""
WITH said AS (SELECT l_orderkey, count(*) AS n, string_agg({_LINE}, chr(10) || chr(10)
              ORDER BY l_linenumber, {_COMMENT_ID}, 'supplier-' || CAST(l_suppkey AS VARCHAR), l_shipdate, {_LINE}) AS words FROM lineitem GROUP BY l_orderkey),
held AS (SELECT l_orderkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT i.key, {_norm("o_orderpriority || ' order for ' || coalesce(c_name, 'unknown') || ' worth ' || "
                     "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR)")} || coalesce(chr(10) || chr(10) || said.words, '') AS content,
       CAST(coalesce(said.n, 0) AS INTEGER) AS n_comments, CAST(coalesce(held.n, 0) AS INTEGER) AS n_attachments,
       CAST(coalesce(said.n, 0) AS INTEGER) AS n_changelog, CAST(coalesce(said.n, 0) AS INTEGER) AS n_linked_issues
FROM ({ISSUES}) i LEFT JOIN said ON said.l_orderkey = i.o_orderkey LEFT JOIN held ON held.l_orderkey = i.o_orderkey
"""
SQL["page_children_long"] = f"""
SELECT page_id, pos, id, author, created FROM ({COMMENTS}) WHERE page_id IN (SELECT CAST(page_id AS VARCHAR) FROM pages)
"""
SQL["page_child_rows"] = f"""
WITH x AS (
SELECT page_id AS id, 'comment' AS kind, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, id) - 1 AS INTEGER) AS n,
       id AS child_id, author AS label FROM ({COMMENTS})
UNION ALL
SELECT page_id, 'attachment', CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, id) - 1 AS INTEGER), id, filename FROM ({ATTACHMENTS}))
SELECT * FROM x WHERE id IN (SELECT CAST(page_id AS VARCHAR) FROM pages)
"""
_DIMS = ("type", "status", "priority", "assignee")
SQL["project_summary"] = f"""
SELECT project,
       CASE {' '.join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in _DIMS)} ELSE 'total' END AS dimension,
       CASE {' '.join(f"WHEN grouping({d}) = 0 THEN coalesce({d}, '(none)')" for d in _DIMS)} END AS value,
       count(*) AS n
FROM ({ISSUES})
GROUP BY GROUPING SETS ({', '.join(f'(project, {d})' for d in _DIMS)}, (project))
"""
SQL["sprint_metrics"] = f"""
WITH j AS (SELECT i.*, coalesce(c.n, 0) AS n_comments,
                  (epoch_us(i.updated) - epoch_us(i.created)) / 86400000000 AS days
           FROM ({ISSUES}) i LEFT JOIN ({_COMMENT_COUNTS}) c ON c.l_orderkey = i.o_orderkey)
SELECT project, sprint, count(*) AS n_issues, count(*) FILTER (WHERE status = 'Done') AS n_done,
       count(*) FILTER (WHERE status = 'Done') / count(*) AS done_rate,
       round(avg(days), 6) AS mean_days, median(days) AS median_days,
       CAST(sum(n_comments) AS BIGINT) / count(*) AS comments_per_issue
FROM j GROUP BY project, sprint
"""


# -- additions ---------------------------------------------------------------
SQL["raw_page_errors"] = """
SELECT CAST(page_id AS VARCHAR) AS id, 'KeyError' AS error_type, '''value''' AS message
FROM pages WHERE page_id % 11 = 0
"""

SQL["space_summary"] = f"""
SELECT space_key, count(*) AS total_pages, 'all' AS output_formats FROM ({WIKI_PAGES}) GROUP BY space_key
"""

SQL["error_counter"] = """
SELECT 'E' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS type, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY 1
"""

SQL["issue_attachments"] = f"""
WITH a AS (SELECT l.l_orderkey, count(*) AS n, CAST(sum(CAST(p.p_size AS BIGINT) * 1024) AS BIGINT) AS bytes
           FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey)
SELECT i.key, coalesce(a.n, 0) AS n_attachments, coalesce(a.bytes, 0) AS attachment_bytes
FROM ({ISSUES}) i LEFT JOIN a ON a.l_orderkey = i.o_orderkey
"""


def _render_tables_sql() -> str:
    from pagemill.operators.render import STYLE
    nl = chr(10)
    heads = "".join(f"<th>{h}</th>" for h in TABLE_COLS)
    row = " || ".join([_lit("<tr>")] + [f"{_lit('<td>')} || coalesce(c{j}, 'nan') || {_lit('</td>')}" for j in range(8)]
                      + [_lit("</tr>")])
    return TABLE_ROWS + f"""
, g AS (SELECT page_id,
               string_agg({row}, '' ORDER BY row_idx) AS body,
               string_agg({_ROW_TEXT}, ' ' ORDER BY row_idx) AS words
        FROM r GROUP BY page_id)
SELECT page_id AS id,
  {_lit('<!DOCTYPE html>' + nl + '<html>' + nl + '<head>' + nl + '<title>')} ||
  {_lit('</title>' + nl + '<style>' + nl + STYLE + '</style>' + nl)} ||
  {_lit('</head>' + nl + '<body>' + nl + '<div class="metadata">' + nl + '<h1>')} ||
  {_lit('</h1>' + nl + '<p>Last modified: ')} || {_lit('</p>' + nl + '<p>URL: <a href="')} ||
  {_lit('">')} || {_lit('</a></p>' + nl + '</div>' + nl + '<div class="content">' + nl)} ||
  'Order ' || page_id || ' ' || {_lit(' '.join(TABLE_COLS))} || ' ' || words ||
  {_lit(nl + '</div>' + nl)} ||
  {_lit('<div class="tables"><h2>Tables</h2><table><thead><tr>' + heads + '</tr></thead><tbody>')} ||
  body || {_lit('</tbody></table></div>' + nl)} || {_lit('</body>' + nl + '</html>' + nl)} AS html
FROM g
"""


SQL["render_tables"] = _render_tables_sql()

# -- records, files, mergeable figures ------------------------------------------
_LINES = """
SELECT doc_id % 20 AS k, CAST(doc_id AS VARCHAR) AS id, n_chars, lang, doc_id % 5 AS number,
  '{"id":"' || doc_id || '",' || CASE WHEN doc_id % 20 = 11 THEN '' ELSE '"title":"Document ' || doc_id || '",' END ||
  '"body":{"storage":{"value":"<p>' || n_chars || '</p>"}},"version":{"number":' ||
  CASE WHEN doc_id % 20 = 7 THEN '"new"' ELSE CAST(doc_id % 5 AS VARCHAR) END || ',"when":"2024-01-01"},"space_key":"' || lang || '"}' AS line
FROM documents
"""

SQL["broken_records"] = f"""
SELECT CASE WHEN k <> 3 THEN id END AS id, CASE k WHEN 3 THEN 'JSONDecodeError' WHEN 7 THEN 'ValueError' ELSE 'KeyError' END AS error_type,
       CASE k WHEN 3 THEN 'not a JSON record' WHEN 7 THEN 'a field has another type than expected' ELSE '''title''' END AS message,
       CASE WHEN k = 3 THEN substr(line, 1, 30) ELSE line END AS raw
FROM ({_LINES}) WHERE k IN (3, 7, 11)
"""

SQL["sound_records"] = f"""
SELECT id, 'Document ' || id AS title, '<p>' || n_chars || '</p>' AS content, '{BASE}/wiki/spaces/' || lang || '/pages/' || id AS url,
       CAST(number AS VARCHAR) AS version, '2024-01-01' AS last_modified, lang AS space_key
FROM ({_LINES}) WHERE k NOT IN (3, 7, 11, 13)
"""

SQL["issue_records"] = """
SELECT 'P' || o_custkey % 10 || '-' || o_orderkey AS key, 'Order ' || o_orderkey AS title, 'P' || o_custkey % 10 AS project,
       CAST(NULL AS VARCHAR) AS status, CAST(o_custkey AS BIGINT) AS customer, o_orderstatus AS mark FROM orders
"""

SQL["page_files"] = f"""
SELECT 'page_' || id || '.html' AS name, md5(html) AS md5, CAST(strlen(html) AS INTEGER) AS n_bytes FROM ({SQL["render_html"]})
"""

SQL["page_json_files"] = """
SELECT 'page_' || doc_id || '_processed.json' AS name, CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(doc_id AS VARCHAR) AS metadata_id, 'confluence' AS source FROM documents
"""

SQL["exact_median"] = """
SELECT o_orderpriority, median(CAST(round(o_totalprice * 100) AS BIGINT)) AS median_cents FROM orders GROUP BY o_orderpriority
"""

SQL["corpus_summary_merged"] = SQL["corpus_summary"]
SQL["corpus_quality_merged"] = SQL["corpus_quality"]
