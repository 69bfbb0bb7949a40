"""Page operators: process_pages, children, dead letters, quality edge cases."""

from pyspark.sql import functions as F

from pagemill.operators import pages as P
from pagemill.operators import quality as Q

PAGE_COLS = "id string, title string, content string, url string, version string, last_modified string"


def test_process_page_keeps_id_and_has_content_and_metadata(spark):
    df = spark.createDataFrame([("123", "Test", "<p>Test content</p>", "http://test", "1", "2024-01-01")], PAGE_COLS)
    r = P.process_pages(df).first()
    assert r.content == "Test content"
    assert r.metadata.id == "123" and r.metadata.source == "confluence"
    assert r.tables == [] and r.code_blocks == [] and r.attachments == [] and r.comments == []
    assert r.errors == {}


def test_children_nested_in_pos_order_and_defaults(spark):
    pages = spark.createDataFrame([("1", "t", "<p>x</p>", "u", "1", ""), ("2", "t", "y", "u", "1", "")], PAGE_COLS)
    att = spark.createDataFrame([("1", 1, "b", "b.txt", 5, "text/plain"), ("1", 0, "a", "a.txt", None, None)],
                                "page_id string, pos int, id string, filename string, size long, mediaType string")
    cmt = spark.createDataFrame([("1", 0, "c1", "ann", "2024", "<p>hi <b>there</b></p>")],
                                "page_id string, pos int, id string, author string, created string, content string")
    out = {r.id: r for r in P.process_pages(pages, P.process_attachments(att), P.clean_comments(cmt)).collect()}
    assert [a.id for a in out["1"].attachments] == ["a", "b"]
    assert out["1"].attachments[0].size == 0 and out["1"].attachments[0].media_type == ""
    assert out["1"].comments[0].content == "hi there"
    assert out["2"].attachments == [] and out["2"].comments == []


def test_dead_letter_for_null_content(spark):
    df = spark.createDataFrame([("1", "t", None, "u", "1", ""), ("2", "t", "<p>ok</p>", "u", "1", "")], PAGE_COLS)
    ok, dead = P.split_errors(P.process_pages(df))
    assert [r.id for r in ok.collect()] == ["2"]
    d = dead.collect()
    assert len(d) == 1 and d[0].part == "text" and d[0].status_code == 500
    assert d[0].error_type == "ProcessingError" and d[0].details["page_id"] == "1"


def test_error_record_defaults(spark):
    r = spark.range(1).select(P.error_record("Test error", "BaseError", 400,
                                             F.create_map(F.lit("test"), F.lit("detail"))).alias("e")).first().e
    assert (r[0], r[1], r.status_code, r.details) == ("Test error", "BaseError", 400, {"test": "detail"})
    r = spark.range(1).select(P.error_record(P.UNEXPECTED_MESSAGE, P.UNEXPECTED_TYPE).alias("e")).first().e
    assert r.status_code == 500 and r[0] == "An unexpected error occurred"


def test_long_sentences_lower_readability(spark):
    long = " ".join(["word"] * 150) + "."
    df = spark.createDataFrame([("1", long), ("2", "Short one. Another.")], "id string, content string")
    df = df.select("id", "content", F.struct(F.col("id").alias("id")).alias("metadata"))
    s = {r.id: r for r in Q.page_scores(df).collect()}
    expected = max(0, min(100, 206.835 - 1.015 * (150 / 2)))
    assert abs(s["1"].readability - expected) < 1e-9
    assert s["2"].readability == 100.0


def test_empty_inputs_give_zero_reports(spark):
    empty = spark.createDataFrame([], "id string, content string, metadata struct<id:string>, n_comments long")
    q = Q.corpus_quality(Q.page_scores(empty)).first()
    assert q.quality_score == 0 and q.avg_readability == 0 and q.min_readability == 0
    s = Q.corpus_summary(empty.withColumn("metadata", F.struct(F.lit("").alias("last_modified")))).first()
    assert s.total_pages == 0 and s.words_per_page is None
    assert Q.report(s.asDict(), "summary").keys() == {"total_pages", "generated_at"}


def test_formatting_is_zero_on_clean_text_but_counts_raw_marks(spark):
    df = spark.createDataFrame([("1", "<h1>T</h1><p>x</p><code>c</code>")], "id string, content string")
    df = df.select("id", "content", F.struct(F.col("id").alias("id")).alias("metadata"))
    raw = Q.page_scores(df).first().formatting_quality
    done = P.process_pages(df.select("id", "content"), parts=("text",))
    clean = Q.page_scores(done).first().formatting_quality
    assert raw == 60.0 and clean == 0.0


def test_strict_summary_fails_on_bad_date_lenient_skips_it(spark):
    import pytest
    df = spark.createDataFrame([("1", "a b"), ("2", "c")], "id string, content string")
    df = df.withColumn("metadata", F.struct(F.col("id").alias("id"),
                                            F.when(F.col("id") == "1", "2024-01-02").otherwise("not a date")
                                            .alias("last_modified")))
    lenient = Q.corpus_summary(df).first()
    assert lenient.oldest_page == lenient.newest_page == "2024-01-02T00:00:00" and lenient.total_words == 3
    with pytest.raises(Exception):
        Q.corpus_summary(df, strict=True).collect()


def test_tokenizer_failure_becomes_per_part_errors(spark):
    df = spark.createDataFrame([("1", "t", "<![foo bar]>x", "u", "1", ""), ("2", "t", "<p>fine</p>", "u", "1", "")],
                               PAGE_COLS)
    done = P.process_pages(df)
    rows = {r.id: r for r in done.collect()}
    assert rows["1"].content == "" and rows["1"].tables == [] and rows["1"].code_blocks == []
    assert sorted(rows["1"].errors) == ["code", "tables", "text"]
    assert rows["2"].content == "fine" and rows["2"].errors == {}
    ok, dead = P.split_errors(done)
    assert [r.id for r in ok.collect()] == ["2"]
    assert sorted(r.part for r in dead.collect()) == ["code", "tables", "text"]


def test_page_figures_count_what_process_pages_lists(spark):
    from pyspark.sql import functions as F

    from pagemill.operators import pages as P
    from pagemill.operators import quality as Q
    html = ["<table><tr><td>1</td></tr></table><pre>x</pre><table></table>", "<code>a</code><pre><code>b</code></pre>", "plain", None, ""]
    df = spark.createDataFrame([(str(i), h, 1) for i, h in enumerate(html)], "id string, content string, n_comments int")
    listed = P.process_pages(df, keep=("id", "n_comments")).drop("comments")
    counted = P.page_figures(df, keep=("id", "n_comments"))
    want = listed.select("id", "content", F.size("tables").alias("n_tables"), F.size("code_blocks").alias("n_code_blocks"))
    assert sorted(counted.select(want.columns).collect()) == sorted(want.collect())
    figures = [Q.corpus_summary(p).drop("generated_at").first() for p in (listed, counted)]
    assert figures[0] == figures[1]
    assert sorted(Q.page_scores(listed).collect()) == sorted(Q.page_scores(counted).collect())
