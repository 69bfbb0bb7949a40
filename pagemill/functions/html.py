"""Single-pass HTML reader used inside the ``parse_html`` Arrow UDF.

The stdlib ``html.parser`` tokenizer does the lexing; this module only keeps
the small amount of tree state needed to answer three questions about a page
in one pass:

* ``text``   - the cleaned page text (strip each text node, join with one
  space, drop ``<...>`` runs that appear after entity decoding, collapse
  whitespace);
* ``tables`` - every ``table`` element in document order as its column names and
  its body rows in run lengths (a cell that spans a million columns is one run;
  Catalyst expands them and marks missing values, see ``functions.udf``);
* ``code``   - every ``code`` / ``pre`` element in document order with its
  language (first ``class`` token, else ``text``) and its stripped text.

Tree rules follow a forgiving builder: an end tag closes the most recent open
element with that name (and everything opened after it); an end tag with no
open match is ignored; void elements never open.  Table rows and cells use
the usual implied-end rules (a new cell closes the open one, a new row closes
the open row) so ``<td>1<td>2`` is two cells.

It runs per row inside Spark tasks; nothing here touches Spark.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

# ---------------------------------------------------------------------------
# Fixed values (must stay as listed for parity of results)
# ---------------------------------------------------------------------------
# Elements whose text is not page text: script, style, template, rt, rp.
TEXT_EXCLUDED_ELEMENTS = frozenset({"script", "style", "template", "rt", "rp"})
# HTML void elements (never have children, never need an end tag).
VOID_ELEMENTS = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "keygen", "menuitem", "nextid", "spacer",
})
# Tag remover applied to the joined text, after entities are decoded.
TAG_PATTERN = re.compile("<[^>]+>")
# Cell text clean-up: strip, then runs of newlines or of 2+ whitespace -> " ".
CELL_WHITESPACE = re.compile(r"[\r\n]+|\s{2,}")
HIDDEN_STYLE = re.compile(r"display:\s*none")
CODE_ELEMENTS = frozenset({"code", "pre"})
# Elements that the tokenizer reads no differently from any other: their bare tags need none of it.
PLAIN_ELEMENTS = frozenset({
    "a", "b", "blockquote", "br", "code", "dd", "div", "dl", "dt", "em", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i",
    "li", "ol", "p", "pre", "section", "small", "span", "strong", "sub", "sup", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "u", "ul",
})
# Text, a bare tag, a reference that ends in ";", or a tag whose attributes are all quoted: pieces
# that mean the same whatever stands behind them.
PIECE = re.compile(r"([^<&]+)|<(/?)([a-z][a-z0-9]*)>|&([a-zA-Z][a-zA-Z0-9]*);|&#([0-9]+|[xX][0-9a-fA-F]+);"
                   r"|<[a-zA-Z][a-zA-Z0-9]*(?:[ \n]+[a-zA-Z][-a-zA-Z0-9]*=\"[^\"<>&]*\")+>")
# A table row of bare cells without markup or references.
PLAIN_ROW = re.compile(r"<tr>(?:(?:<td>[^<&]*</td>)+|(?:<th>[^<&]*</th>)+)</tr>")
# ---------------------------------------------------------------------------

# Named references: every HTML5 name, with or without its ";".
ENTITY_CHARS: dict[str, str] = {}
for _name, _char in sorted(html5.items()):
    ENTITY_CHARS.setdefault(_name[:-1] if _name.endswith(";") else _name, _char)


REPLACEMENT = "\ufffd"


def charref_text(name: str) -> str:
    """Text of ``&#NNN;`` / ``&#xHH;`` by the HTML standard's numeric reference rules:
    0x80-0x9F name windows-1252 characters; NUL, surrogates and numbers past the
    last code point become U+FFFD, which is also the text of a malformed number."""
    hexadecimal = name[:1].lower() == "x"
    digits = name[1:] if hexadecimal else name
    if not re.fullmatch("[0-9a-fA-F]+" if hexadecimal else "[0-9]+", digits):
        return REPLACEMENT
    code = int(digits, 16 if hexadecimal else 10) if len(digits) < 12 else 0
    if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
        return REPLACEMENT
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return chr(code)


def remove_tags(s: str) -> str:
    """``<...>`` runs removed.  Behind the last ``>`` nothing can match, so only the
    text up to it is searched and every search ends at the next ``>``."""
    end = s.rfind(">") + 1
    return TAG_PATTERN.sub("", s[:end]) + s[end:]


def normalize_ws(s: str) -> str:
    """``" ".join(s.split())`` - Python's whitespace definition."""
    return " ".join(s.split())


def clean_text_fast(s: str | None) -> str:
    """Text of a fragment with no markup at all (no ``<`` and no ``&``)."""
    return normalize_ws(s or "")


class _Cell:
    __slots__ = ("tag", "parts", "rowspan", "colspan")

    def __init__(self, tag, rowspan, colspan):
        self.tag = tag
        self.parts: list[str] = []
        self.rowspan = rowspan
        self.colspan = colspan


class _PlainRow:
    """The cells of a ``PLAIN_ROW``: one tag, a text each, no spans."""

    __slots__ = ("tag", "texts")

    def __init__(self, tag, texts):
        self.tag = tag
        self.texts = texts

    def __iter__(self):
        for text in self.texts:
            cell = _Cell(self.tag, 1, 1)
            cell.parts.append(text)
            yield cell


class _Table:
    __slots__ = ("slot", "section", "rows", "row", "cell", "bad", "has_text")

    def __init__(self, slot):
        self.slot = slot          # position in document order
        self.section = "root"     # thead / tbody / tfoot / root
        self.rows: list[tuple[str, list[_Cell] | _PlainRow]] = []
        self.row: list[_Cell] | None = None
        self.cell: _Cell | None = None
        self.bad = False          # an unparsable span makes the table unreadable
        self.has_text = False

    def close_cell(self):
        self.cell = None

    def close_row(self):
        self.cell = None
        self.row = None

    def open_row(self):
        self.close_row()
        self.row = []
        self.rows.append((self.section, self.row))

    def open_cell(self, tag, attrs):
        self.close_cell()
        if self.row is None:
            self.open_row()
        rowspan = colspan = 1
        if attrs:
            try:
                rowspan = int(attrs.get("rowspan") or 1)
                colspan = int(attrs.get("colspan") or 1)
            except ValueError:
                self.bad = True
                rowspan = colspan = 1
        self.cell = _Cell(tag, rowspan, colspan)
        self.row.append(self.cell)


_NO_ATTRS: dict = {}


class PageReader(HTMLParser):
    """Walks one document; results in ``texts``, ``tables``, ``codes``."""

    def __init__(self, want_text=True, want_tables=True, want_code=True):
        super().__init__(convert_charrefs=False)
        self.want_text = want_text
        self.want_tables = want_tables
        self.want_code = want_code
        self.stack: list[tuple] = []
        self.pending: list[str] = []
        self.texts: list[str] = []
        self.codes: list[tuple[str, list[str]]] = []
        self.open_codes: list[list[str]] = []
        self.table_stack: list[_Table] = []
        self.done_tables: list[_Table] = []
        self.n_tables = 0
        self.excluded_depth = 0
        self.hidden_depth = 0

    def read(self, html):
        """``feed`` of a whole document.  Pieces that need no tokenizer go straight to the
        handlers, whole rows of bare cells too; from the first other piece on (a comment, an odd
        tag or reference, raw text) the tokenizer reads the rest."""
        at, piece, plain_row = 0, PIECE.match, PLAIN_ROW.match
        while m := piece(html, at):
            text, slash, tag, entity, number = m.groups()
            if text is not None:
                self.pending.append(text)
            elif tag is not None and tag in PLAIN_ELEMENTS:
                if slash:
                    self.handle_endtag(tag)
                elif tag == "tr" and self._takes_rows() and (row := plain_row(html, at)):
                    self._plain_row(row.group())
                    at = row.end()
                    continue
                else:
                    self.handle_starttag(tag, ())
            elif entity is not None:
                self.handle_entityref(entity)
            elif number is not None:
                self.handle_charref(number)
            else:
                self.feed(m.group())
                if self.rawdata or self.cdata_elem is not None:
                    at = m.end()
                    break
            at = m.end()
        if at < len(html):
            self.feed(html[at:])

    def _takes_rows(self):
        """Whether a row's text is that of its cells and of the page, and of nothing else that is open."""
        return len(self.table_stack) == 1 and not (self.hidden_depth or self.excluded_depth or self.open_codes)

    def _plain_row(self, row):
        """The events of a ``PLAIN_ROW`` at once."""
        self._flush()
        table, tag = self.table_stack[-1], row[5:7]
        texts = row[8:-10].split(f"</{tag}><{tag}>")
        table.close_row()
        table.rows.append((table.section, _PlainRow(tag, texts)))
        table.has_text = table.has_text or any(texts)
        if self.want_text:
            self.texts.extend(filter(None, map(str.strip, texts)))

    # -- text nodes -------------------------------------------------------
    def handle_data(self, data):
        self.pending.append(data)

    def _flush(self, kind="text"):
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        self._emit(data, kind)

    def _emit(self, data, kind):
        # CDATA sections always count as text; plain text counts unless it sits
        # inside one of the excluded elements.  Comments / declarations never do.
        counted = kind == "cdata" or (kind == "text" and self.excluded_depth == 0)
        if counted and (self.want_text or self.open_codes):
            stripped = data.strip()
            if stripped:
                if self.want_text:
                    self.texts.append(stripped)
                if self.open_codes:
                    for parts in self.open_codes:
                        parts.append(stripped)
        if kind == "text" and self.table_stack and self.hidden_depth == 0:
            for t in self.table_stack:
                if t.cell is not None:
                    t.cell.parts.append(data)
                    t.has_text = True

    def handle_entityref(self, name):
        # unknown names stay literal text ("&name")
        self.pending.append(ENTITY_CHARS.get(name, "&" + name))

    def handle_charref(self, name):
        self.pending.append(charref_text(name))

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._emit(data[len("CDATA["):], "cdata")

    # -- elements ---------------------------------------------------------
    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if self.pending:
            self._flush()
        if attrs:
            amap = {k: ("" if v is None else v) for k, v in attrs}
            style = amap.get("style")
            hidden = bool(style) and HIDDEN_STYLE.search(style) is not None
        else:
            amap = _NO_ATTRS
            hidden = False
        table = None
        if self.want_tables and not hidden and self.hidden_depth == 0 and (self.table_stack or tag == "table"):
            table = self._table_event_start(tag, amap)
        code_parts = None
        if self.want_code and tag in CODE_ELEMENTS:
            classes = amap.get("class", "").split()
            code_parts = []
            self.codes.append((classes[0] if classes else "text", code_parts))
        if tag in VOID_ELEMENTS:
            return
        excluded = tag in TEXT_EXCLUDED_ELEMENTS
        if code_parts is not None:
            self.open_codes.append(code_parts)
        if hidden:
            self.hidden_depth += 1
        if excluded:
            self.excluded_depth += 1
        # stack entry: (name, code parts or None, hidden, excluded, table or None)
        self.stack.append((tag, code_parts, hidden, excluded, table))

    def handle_endtag(self, tag):
        if self.pending:
            self._flush()
        if self.table_stack and self.want_tables and self.hidden_depth == 0:
            self._table_event_end(tag)
        if tag in VOID_ELEMENTS:
            return
        stack = self.stack
        if stack and stack[-1][0] == tag:
            el = stack.pop()
            if el[1] is not None or el[2] or el[3] or el[4] is not None:
                self._closed(el)
            return
        for i in range(len(stack) - 2, -1, -1):
            if stack[i][0] == tag:
                closing = stack[i:]
                del stack[i:]
                for el in reversed(closing):
                    if el[1] is not None or el[2] or el[3] or el[4] is not None:
                        self._closed(el)
                return

    def _closed(self, el):
        _, code, hidden, excluded, table = el
        if table is not None:
            # a table ends when its element closes (explicitly or with an ancestor)
            table.close_row()
            for j in range(len(self.table_stack) - 1, -1, -1):
                if self.table_stack[j] is table:
                    del self.table_stack[j]
                    break
            self.done_tables.append(table)
        if code is not None:
            # identity match: two code elements may hold equal part lists
            for j in range(len(self.open_codes) - 1, -1, -1):
                if self.open_codes[j] is code:
                    del self.open_codes[j]
                    break
        if hidden:
            self.hidden_depth -= 1
        if excluded:
            self.excluded_depth -= 1

    # -- tables -----------------------------------------------------------
    def _table_event_start(self, tag, attrs):
        """Row / cell bookkeeping; returns the new table context for ``table``."""
        if tag == "table":
            t = _Table(self.n_tables)
            self.n_tables += 1
            self.table_stack.append(t)
            return t
        if not self.table_stack:
            return None
        t = self.table_stack[-1]
        if tag in ("thead", "tbody", "tfoot"):
            t.close_row()
            t.section = tag
        elif tag == "tr":
            t.open_row()
        elif tag in ("td", "th"):
            t.open_cell(tag, attrs)

    def _table_event_end(self, tag):
        if not self.table_stack:
            return
        t = self.table_stack[-1]
        if tag in ("td", "th"):
            t.close_cell()
        elif tag == "tr":
            t.close_row()
        elif tag in ("thead", "tbody", "tfoot"):
            t.close_row()
            t.section = "root"

    def finish(self):
        self.close()
        self._flush()
        while self.table_stack:
            t = self.table_stack.pop()
            t.close_row()
            self.done_tables.append(t)


# ---------------------------------------------------------------------------
# Tables: slots by the HTML table model, in run lengths
# ---------------------------------------------------------------------------

def _squeezed(text: str) -> str:
    text = text.strip()
    return CELL_WHITESPACE.sub(" ", text) if len(text.split(None, 1)) > 1 else text


def _cell_text(cell: _Cell) -> str:
    return _squeezed("".join(cell.parts))


def _fill(hanging: list, cells: list[_Cell] | _PlainRow) -> tuple[list, list]:
    """Slots of one row as (first column, width, text), and what hangs into the next row.

    ``hanging`` cells of earlier rows keep their slots, ordered by column; the row's own
    cells take the free slots from the left, ``colspan`` of them.
    """
    slots = [(col, width, text) for col, width, text, _ in hanging]
    below = [(col, width, text, rows - 1) for col, width, text, rows in hanging if rows > 1]
    occupied, col = iter([*slots, (None, 0, None)]), 0
    start, width, _ = next(occupied)
    for cell in cells:
        text, need = _cell_text(cell), max(cell.colspan, 1)
        while need:
            if start is not None and start <= col:
                col = start + width
                start, width, _ = next(occupied)
                continue
            free = need if start is None else min(need, start - col)
            slots.append((col, free, text))
            if cell.rowspan > 1:
                below.append((col, free, text, cell.rowspan - 1))
            col, need = col + free, need - free
    return sorted(slots, key=lambda x: x[0]), sorted(below, key=lambda x: x[0])


def _runs(slots: list) -> list[tuple[int, str | None]]:
    """(how many columns, text) from the left; columns that no cell takes are null."""
    out, col = [], 0
    for start, width, text in slots:
        if start > col:
            out.append((start - col, None))
        out.append((width, text))
        col = start + width
    return out


def lay_out(rows: list[list[_Cell] | _PlainRow]) -> list[tuple[int, list[tuple[int, str | None]]]]:
    """Rows as (how many equal rows, runs).  Cells that reach past the last row add rows."""
    out, hanging = [], []
    for cells in rows:
        if not hanging and isinstance(cells, _PlainRow):
            out.append((1, [(1, _squeezed(text)) for text in cells.texts]))
            continue
        slots, hanging = _fill(hanging, cells)
        out.append((1, _runs(slots)))
    while hanging:
        n = min(rows for *_, rows in hanging)
        out.append((n, _runs([(c, w, t) for c, w, t, _ in hanging])))
        hanging = [(c, w, t, r - n) for c, w, t, r in hanging if r > n]
    return out


def _width(runs: list[tuple[int, str | None]]) -> int:
    return sum(n for n, _ in runs)


def _column_names(head: list[list[tuple[int, str | None]]], width: int) -> list[str]:
    """Names of the columns: the texts of the header rows, top down; repeated names get
    the first free of ``.1``, ``.2`` ...; without text a column is ``Unnamed: n``."""
    levels = [[t or "" for n, t in runs for _ in range(n)] for runs in head]
    spoken = [row for row in levels if any(row)] or levels[:1]
    taken: set[str] = set()
    next_mark: dict[str, int] = {}
    names = []
    for j in range(width):
        name = " ".join(row[j] for row in spoken if j < len(row) and row[j]) or f"Unnamed: {j}"
        unique, mark = name, next_mark.get(name, 1)
        while unique in taken:
            unique, mark = f"{name}.{mark}", mark + 1
        next_mark[name] = mark
        taken.add(unique)
        names.append(unique)
    return names


def build_table(t: _Table):
    """``{headers, rows}`` or ``None`` when the table is unreadable or has no columns."""
    if t.bad or not t.has_text:
        return None
    by_section = {s: [r for section, r in t.rows if section == s] for s in ("thead", "tbody", "root", "tfoot")}
    head, body = by_section["thead"], by_section["tbody"] + by_section["root"]
    if not head:
        # leading rows of header cells only; a row without cells ends nothing
        n = 0
        while n < len(body) and not any(c.tag == "td" for c in body[n]):
            n += 1
        head, body = body[:n], body[n:]
    head_runs = [runs for n, runs in lay_out(head) for _ in range(n)]
    rows = lay_out(body) + lay_out(by_section["tfoot"])
    width = max([_width(runs) for runs in head_runs] + [_width(runs) for _, runs in rows], default=0)
    if width == 0:
        return None
    headers = _column_names(head_runs, width) if head_runs else [str(j) for j in range(width)]
    padded = [(n, [*runs, (width - _width(runs), None)]) for n, runs in rows]
    return {"headers": headers, "rows": [{"n": n, "cells": [{"n": k, "text": x} for k, x in runs if k]} for n, runs in padded]}


# ---------------------------------------------------------------------------
# Public per-document entry point
# ---------------------------------------------------------------------------

def read_page(html: str | None, want_text=True, want_tables=True, want_code=True) -> dict:
    """Parse one document once.  Returns a dict with the requested parts and
    an ``errors`` dict (part -> message) for parts that could not be made."""
    out: dict = {"errors": {}}
    if html is None:
        # a missing document has no text; its tables and code are simply empty
        if want_text:
            out["text"] = ""
            out["errors"]["text"] = "TypeError: content is null"
        if want_tables:
            out["tables"] = []
        if want_code:
            out["code"] = []
        return out
    if "<" not in html and "&" not in html:
        # no markup and no references: one text node, no tables, no code
        if want_text:
            out["text"] = clean_text_fast(html)
        if want_tables:
            out["tables"] = []
        if want_code:
            out["code"] = []
        return out
    reader = PageReader(want_text, want_tables, want_code)
    try:
        reader.read(html)
        reader.finish()
    except Exception as exc:  # tokenizer failure: every requested part falls back
        msg = f"{type(exc).__name__}: {exc}"
        for part, wanted, default in (("text", want_text, ""), ("tables", want_tables, []),
                                      ("code", want_code, [])):
            if wanted:
                out[part] = default
                out["errors"][part] = msg
        return out
    if want_text:
        out["text"] = normalize_ws(remove_tags(" ".join(reader.texts)))
    if want_tables:
        tables = []
        for t in sorted(reader.done_tables, key=lambda x: x.slot):
            try:
                built = build_table(t)
            except Exception as exc:  # one bad table is skipped, the page stays
                out["errors"]["tables"] = f"{type(exc).__name__}: {exc}"
                continue
            if built is not None:
                tables.append(built)
        out["tables"] = tables
    if want_code:
        out["code"] = [
            {"language": lang, "content": "".join(parts)} for lang, parts in reader.codes
        ] if html else []
    return out


def clean_text(html: str | None) -> str:
    """Cleaned text of one document (plain-Python form of the text part)."""
    return read_page(html, True, False, False).get("text", "")
