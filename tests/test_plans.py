"""Plan shapes the design relies on (checked on the physical plan text)."""

from pyspark.sql import functions as F

from pagemill.operators import pages as P
from pagemill.plans.catalog import QUERIES
from pagemill.session import PARSE_PARTITIONS, spread_for_parse
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rate_flag_sums_steps_without_a_sliding_frame(spark):
    p = plan(QUERIES["rate_flag"](spark, SF_SMALL))
    assert "RangeFrame" not in p and "RowFrame, unboundedpreceding" in p
    assert "partial_sum" in p


def test_rate_flag_deals_its_steps_once(spark):
    """The running sums and the chunk totals read one exchange: events are scanned for the steps and for the output."""
    df = QUERIES["rate_flag"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and final.count("FileScan") == 2


def test_issue_cap_is_top_k_and_only_on_request(spark):
    p = plan(QUERIES["issue_first"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p and "Sort [" not in p
    assert "Limit" not in plan(QUERIES["issue_scan"](spark, SF_SMALL)) and "TakeOrdered" not in plan(QUERIES["issue_scan"](spark, SF_SMALL))


def test_page_lookup_reaches_the_scan_and_moves_nothing(spark):
    p = plan(QUERIES["page_lookup"](spark, SF_SMALL))
    assert "EqualTo(page_id,7)" in p and "Exchange" not in p


def test_worklist_is_one_join(spark):
    p = plan(QUERIES["worklist_route"](spark, SF_SMALL))
    assert p.count("Join") <= 2 and p.count("FileScan") <= 7


def test_corpus_is_parsed_after_its_joins(spark):
    p = plan(QUERIES["process_pages"](spark, SF_SMALL))
    assert p.index("ArrowEvalPython") < p.index("Join")  # plans print from the top


def test_sprint_join_broadcasts_one_row(spark):
    p = plan(QUERIES["sprint_issues"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "TakeOrderedAndProject" in p or "GlobalLimit 1" in p


def test_python_udf_runs_once_per_page(spark):
    p = plan(QUERIES["process_pages"](spark, SF_SMALL))
    assert p.count("ArrowEvalPython") == 1


def test_children_aggregated_before_join(spark):
    p = plan(QUERIES["page_children"](spark, SF_SMALL))
    # each child table is reduced by hash aggregation (partial + final) before its join
    assert p.count("HashAggregate") >= 4
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p


def test_table_pages_are_built_in_one_shuffle(spark):
    p = plan(QUERIES["table_cells"](spark, SF_SMALL))
    assert p.count("Exchange") == 1 and p.count("FileScan") == 1 and "ObjectHashAggregate" in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["issue_scan"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string" in p
    p = plan(QUERIES["error_counter"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p


def test_spreading_only_on_request(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    assert "Exchange" not in plan(spread_for_parse(pages))
    spark.conf.set(PARSE_PARTITIONS, "16")
    try:
        assert "Exchange RoundRobinPartitioning(16)" in plan(spread_for_parse(pages))
    finally:
        spark.conf.unset(PARSE_PARTITIONS)


def test_text_only_parse_requests_only_text(spark):
    df = spark.createDataFrame([("1", "<p>x</p>")], "id string, content string")
    out = P.process_pages(df, parts=("text",))
    assert out.select(F.size("tables"), F.size("code_blocks")).first() == (0, 0)
    assert "ArrowEvalPython" in plan(out)


def test_bucketed_pages_join_children_without_moving_pages(spark, tmp_out):
    from pagemill import sinks
    from pagemill.operators import pages as P2
    from pagemill.sources import landed as A
    from pagemill.sources import testdata as D
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = D.wiki_pages(spark, SF_SMALL, spread=False).select("id", "title", "content", "url", "version",
                                                                     "last_modified")
        spark.sql(f"DROP TABLE IF EXISTS pages_by_id")
        sinks.write_bucketed(pages, "pages_by_id", "id", 8)
        bucketed = spark.table("pages_by_id")
        comments = A.comments(D.wiki_comments_landed(spark, SF_SMALL, spread=False))
        # join the child summary first: the Python step does not keep the
        # bucketed partitioning, so the join must come before it
        joined = P2.child_summary(bucketed, comments=comments)
        out = P2.process_pages(joined, parts=("text",), keep=("id", "n_comments"))
        p = plan(out)
        # only the comment side is exchanged; the bucketed page scan feeds the join directly
        assert p.count("Exchange hashpartitioning(") == 1
        assert "Bucketed: true" in p
        assert out.count() == pages.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS pages_by_id")


def test_parse_runs_at_most_once_in_every_query(spark):
    counts = {name: plan(fn(spark, SF_SMALL)).count("ArrowEvalPython") for name, fn in QUERIES.items()}
    # an issue's description and its comments are texts of two tables
    two = {"issue_contents", "issue_links", "issue_changes"}
    assert all(v <= (2 if k in two else 1) for k, v in counts.items()), counts
    for name in ("code_blocks", "dead_letter", "table_cells", "render_tables", "clean_text", "comments_clean"):
        assert counts[name] == 1, name
