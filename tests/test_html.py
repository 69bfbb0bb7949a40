"""Per-document reader: the source tool's one exact-output test plus the
edge cases of its HTML handling."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import html as H


def grids(doc):
    """Tables of a document as the Spark projection gives them."""
    from pyspark.sql import SparkSession

    from pagemill.operators.pages import process_pages
    spark = SparkSession.getActiveSession()
    row = process_pages(spark.createDataFrame([("1", doc)], "id string, content string"), parts=("tables",)).first()
    return [{"headers": t.headers, "data": t.data, "shape": t.shape.asDict()} for t in row.tables]



def test_clean_html_content():
    # the source tool's own exact-output case
    assert H.clean_text("<p>Test content</p><div>More content</div>") == "Test content More content"


def test_inline_tags_insert_a_space_and_whitespace_collapses():
    assert H.clean_text("<p>a<b>b</b>c</p>\n\n  d\xa0e\x1df") == "a b c d e f"


def test_script_style_template_ruby_text_dropped():
    doc = "<style>p{}</style><script>var t='</p>';</script>x<template>t</template><ruby>k<rt>r</rt><rp>(</rp></ruby>"
    assert H.clean_text(doc) == "x k"


def test_decoded_tags_removed_after_decoding():
    assert H.clean_text("a &lt;b&gt; c") == "a c"


def test_entities():
    assert H.clean_text("&copy; &middot; &quot;x&quot; &amp;amp; &notice &foo; &#147;") == '© · "x" &amp; &notice &foo “'


def test_comments_and_doctype_are_not_text_cdata_is():
    assert H.clean_text("<!DOCTYPE html><!-- c -->a<![CDATA[b]]>c") == "a b c"


def test_null_empty_and_blank_content():
    assert H.read_page(None)["text"] == ""
    assert "text" in H.read_page(None)["errors"]
    assert H.clean_text("") == ""
    assert H.clean_text("   \n ") == ""
    assert H.read_page("", False, True, True) == {"errors": {}, "tables": [], "code": []}


def test_unclosed_tags():
    assert H.clean_text("<p><b>one<p>two<br>three") == "one two three"


def test_code_blocks_pre_code_gives_two_entries():
    r = H.read_page('<pre><code class="language-python x">a = 1\n <b>b</b> </code></pre>', False, False, True)
    assert r["code"] == [{"language": "text", "content": "a = 1b"},
                         {"language": "language-python", "content": "a = 1b"}]


def test_code_class_empty_and_missing():
    r = H.read_page('<code class="">x</code><code>y</code><pre class="  sh ">z</pre>', False, False, True)
    assert [c["language"] for c in r["code"]] == ["text", "text", "sh"]


def test_table_thead_header_and_body(spark):
    tables = grids("<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr>"
                   "</tbody></table>")
    assert tables == [{"headers": ["a", "b"], "data": [["1", "2"]], "shape": {"rows": 1, "cols": 2}}]


def test_table_leading_th_rows_are_headers_and_no_header_gives_numbers(spark):
    tables = grids("<table><tr><th>x</th><th>x</th></tr><tr><td>1</td><td>2</td></tr></table>"
                   "<table><tr><td>p</td><td>q</td></tr></table>")
    assert tables[0]["headers"] == ["x", "x.1"]
    assert tables[1]["headers"] == ["0", "1"]


def test_table_spans_ragged_rows_and_missing_values(spark):
    tables = grids("<table><tr><td colspan=2>a</td></tr><tr><td rowspan=2>b</td><td>NA</td></tr>"
                    "<tr><td>c</td></tr><tr><td>d</td><td>e</td><td>f</td></tr></table>")
    t = tables[0]
    assert t["shape"] == {"rows": 4, "cols": 3}
    assert t["data"] == [["a", "a", None], ["b", None, None], ["b", "c", None], ["d", "e", "f"]]


def test_nested_tables_are_listed_separately_in_document_order(spark):
    tables = grids("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>")
    assert [t["data"] for t in tables] == [[["oi"]], [["i"]]]  # cell text = all descendant text


def test_empty_and_hidden_tables_skipped_and_bad_span_skipped(spark):
    tables = grids('<table></table><table style="display: none"><tr><td>h</td></tr></table>'
                    '<table><tr><td colspan="x">1</td></tr></table><table><tr><td>ok</td></tr></table>')
    assert [t["data"] for t in tables] == [[["ok"]]]


def test_implied_cell_and_row_ends(spark):
    assert grids("<table><tr><td>1<td>2<tr><td>3<td>4</table>")[0]["data"] == [["1", "2"], ["3", "4"]]


# -- any markup is read ---------------------------------------------------------
PIECES = ["<p>", "</p>", "<b>", "</b>", "<td>", "<tr>", "<table>", "</table>", "<th>", "<pre>", "<code class='c d'>",
          "</code>", "text", " ", "&amp;", "&lt;", "&x", "&#65;", "&#x41;", "<!--c-->", "<!-- c -- >", "<br>", "<br/>",
          "<script>s</script>", "<", ">", "&", "\n", "\xa0", "<td rowspan=2>", '<td colspan="3">', "<thead>",
          "</thead>", "<rt>r</rt>", "<style x=1>st</style>", "<img src=a/>", "<![CDATA[c]]>", "<?pi?>", "</ x>",
          "<a href='u&amp;v'>", "<x-y>", "&#", "&#12a;", "<SCRIPT>", "<!DOCTYPE html>", "<template>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=0, max_size=30))
def test_any_markup_gives_all_parts(parts):
    r = H.read_page("".join(parts))
    assert set(r) == {"errors", "text", "tables", "code"} and r["text"] == " ".join(r["text"].split())
    for t in r["tables"]:
        assert all(sum(c["n"] for c in row["cells"]) == len(t["headers"]) for row in t["rows"])


def test_tag_removal_is_linear_and_stops_at_the_last_mark():
    assert H.remove_tags("a < b <i> c > d < e") == "a  c > d < e"
    began = time.perf_counter()
    assert H.clean_text("<p>" + "&lt;" * 80_000 + "</p>") == "<" * 80_000
    assert time.perf_counter() - began < 5


def test_huge_spans_are_runs():
    r = H.read_page('<table><tr><td colspan="3000">a</td></tr><tr><td rowspan="70000">b</td></tr></table>', False, True, False)
    assert [(row["n"], row["cells"]) for row in r["tables"][0]["rows"]] == [
        (1, [{"n": 3000, "text": "a"}]), (1, [{"n": 1, "text": "b"}, {"n": 2999, "text": None}]),
        (69999, [{"n": 1, "text": "b"}, {"n": 2999, "text": None}])]


def test_a_failing_table_keeps_its_page(monkeypatch):
    build = H.build_table
    monkeypatch.setattr(H, "build_table", lambda t: build(t) if t.slot else 1 / 0)
    r = H.read_page("<p>x</p><table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table>")
    assert r["text"] == "x 1 2" and len(r["tables"]) == 1 and "tables" in r["errors"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=200))
def test_plain_text_is_python_split_join(s):
    if "<" not in s and "&" not in s:
        assert H.clean_text(s) == " ".join(s.split())


def test_table_ends_with_its_element(spark):
    # an unclosed hidden element inside a cell does not keep the table open
    tables = grids('<table><tr><td>a<div style="display:none">x</table><table><tr><td>b</td></tr></table>')
    assert [t["data"] for t in tables] == [[["a"]], [["b"]]]
    # closing an ancestor closes the table inside it
    tables = grids("<div><table><tr><td>in</div><p>after</p><table><tr><td>c</td></tr></table>")
    assert [t["data"] for t in tables] == [[["in"]], [["c"]]]


def test_surrogate_and_out_of_range_references_become_replacement_char(spark):
    from pyspark.sql import functions as F

    from pagemill.functions.udf import clean_text
    assert H.clean_text("a&#xD800;b&#1114112;c") == "a�b�c"
    df = spark.createDataFrame([("<p>&#xDFFF;</p>",)], "h string")
    assert df.select(clean_text(F.col("h")).alias("t")).first().t == "�"


def test_multi_row_header_levels_join_and_unnamed_columns(spark):
    tables = grids("<table><thead><tr><th colspan=2>grp</th><th></th></tr><tr><th>a</th><th>b</th><th></th></tr>"
                    "</thead><tr><td>1</td><td>2</td><td>3</td></tr></table>")
    t = tables[0]
    assert t["headers"] == ["grp a", "grp b", "Unnamed: 2"]
    assert t["data"] == [["1", "2", "3"]]


def test_plain_pages_need_no_tokenizer(monkeypatch):
    def feed(self, data):
        raise AssertionError(f"tokenized: {data}")

    doc = "<h2>T</h2><table><tr><th>a</th><th>b</th></tr><tr><td>1 &amp; 2</td><td> x\n y </td></tr><tr><td></td><td>3</td></tr></table>"
    want = H.read_page(doc.replace("<h2>", "<!-- c --><h2>"))
    monkeypatch.setattr(H.PageReader, "feed", feed)
    assert H.read_page(doc) == want and want["errors"] == {}
    assert want["text"] == "T a b 1 & 2 x y 3" and want["tables"][0]["headers"] == ["a", "b"]


PIECES = ["<tr>", "</tr>", "<td>", "</td>", "<th>", "<table>", "</table>", "<thead>", "</thead>", "text", " a  b\n c", "&amp;", "&#65;", "&#x41", "&#",
          "&foo", "&", "<", ">", '"', "<!--", "-->", "<script>", "</script>", "<title>", "<pre>", '<code class="x y">', "</code>", '<div style="display: none">',
          "</div>", '<a href="x>y">', "<br/>", '<td colspan="2">', '<td rowspan="3" colspan="2">', "<TD>", "</", "<![CDATA[x]]>", "<rt>", "</rt>",
          "<tr><td>1</td><td></td><td> z </td></tr>", "<tr><th>h</th><th>h</th></tr>", "<tr><td></td></tr>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.tuples(st.booleans(), st.booleans(), st.booleans()))
def test_plain_pieces_mean_what_the_tokenizer_makes_of_them(pieces, want):
    class Tokenized(H.PageReader):
        def read(self, html):
            self.feed(html)

    doc = "<table>" + "".join(pieces)
    found, H.PageReader, kept = H.read_page(doc, *want), Tokenized, H.PageReader
    try:
        assert found == H.read_page(doc, *want)
    finally:
        H.PageReader = kept


def test_few_rows_and_bytes_are_held_parsed():
    import pyarrow as pa

    from pagemill.functions import udf as U
    docs = ["<p>x</p>"] * (U.SLICE_ROWS + 1) + [None, "y" * U.SLICE_BYTES, "z", ""]
    slices = list(U._slices(pa.array(docs)))
    assert [x for s in slices for x in s.to_pylist()] == docs
    assert all(len(s) <= U.SLICE_ROWS and (len(s) == 1 or sum(len(x or "") for x in s.to_pylist()) <= U.SLICE_BYTES) for s in slices)
    assert len(slices) > 2 and [len(s) for s in U._slices(pa.array([], pa.string()))] == [0]
