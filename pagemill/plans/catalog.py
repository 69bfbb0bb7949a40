"""Registered queries: one per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the whole driver tables.
Every computed column is aliased to the name the oracle SQL uses.  Queries
return scalar columns (nested results are exploded or summarised) so results
can be compared row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import schemas, sinks
from pagemill.functions import text as X
from pagemill.functions.text import iso_format
from pagemill.operators import batch as B
from pagemill.operators import issues as I
from pagemill.operators import metrics as M
from pagemill.operators import pages as P
from pagemill.operators import quality as Q
from pagemill.operators import rate as R
from pagemill.operators import render as RH
from pagemill.operators import tables as TB
from pagemill.operators.median import exact_medians
from pagemill.session import shared_path
from pagemill.sources import landed as A
from pagemill.sources import testdata as D
from pagemill.sources.named_files import read_files

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _attachments(spark, sf):
    return A.attachments(D.wiki_attachments_landed(spark, sf), D.BASE_URL)


def _comments(spark, sf, spread=False):
    """Comment rows; ``spread`` only when their content is parsed."""
    return A.comments(D.wiki_comments_landed(spark, sf, spread))


# -- step 1: scans, clean text, metadata -----------------------------------
@query
def page_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A1: flatten raw API pages of every space."""
    return A.space_pages(D.wiki_pages_raw(spark, sf), None, D.BASE_URL)


@query
def raw_page_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A1 guard + P10: raw pages missing a required field become dead letters."""
    _, bad = A.split_raw_pages(D.wiki_pages_raw_broken(spark, sf))
    return bad


@query
def space_summary(spark: SparkSession, sf: str) -> DataFrame:
    """K7 for every space: raw page count per space key (clock value left out)."""
    pages = A.space_pages(D.wiki_pages_raw(spark, sf), None, D.BASE_URL)
    return (pages.groupBy("space_key").agg(F.count(F.lit(1)).alias("total_pages"))
            .withColumn("output_formats", F.lit("all")))


@query
def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A2: one page by id, with the single-page URL."""
    return A.single_page(D.wiki_page_raw(spark, sf, "7"), "7", D.BASE_URL)


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned text of every page."""
    pages = D.wiki_pages(spark, sf)
    out = P.process_pages(pages.select("id", "content"), parts=("text",))
    return out.select("id", "content")


@query
def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata projection (``processed_at`` left out: clock value)."""
    pages = D.wiki_pages(spark, sf, spread=False)
    return pages.select(P.metadata(pages).alias("m")).select(
        "m.id", "m.title", "m.url", "m.version", "m.last_modified", "m.source")


# -- step 2: children, process_pages, dead letters --------------------------
@query
def attachment_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A3: attachment rows with defaults and download URL."""
    return _attachments(spark, sf)


@query
def comment_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A4: comment rows."""
    return _comments(spark, sf)


@query
def comments_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with cleaned content."""
    return P.clean_comments(_comments(spark, sf, spread=True))


@query
def attachments_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Attachment projection."""
    return P.process_attachments(_attachments(spark, sf))


@query
def page_children(spark: SparkSession, sf: str) -> DataFrame:
    """J-1: pages left-joined to their (pre-aggregated) children."""
    pages = D.wiki_pages(spark, sf, spread=False).select("id")
    return P.child_summary(pages, P.process_attachments(_attachments(spark, sf)), _comments(spark, sf))


@query
def process_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Processed pages of the mixed corpus, flattened to scalars (children counted).

    Child summaries join the pages before the parse, so no cleaned text moves."""
    attachments = _attachments(spark, sf).withColumn("page_id", F.concat(F.lit("p"), "page_id"))
    pages = P.child_summary(D.corpus_pages(spark, sf), P.process_attachments(attachments), _corpus_comments(spark, sf))
    done = P.process_pages(pages, keep=("id", "n_attachments", "n_comments"))
    return done.select(
        "id", "content",
        F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"),
        F.col("metadata.version").alias("version"), F.col("metadata.last_modified").alias("last_modified"),
        F.col("metadata.source").alias("source"),
        F.size("tables").alias("n_tables"), F.size("code_blocks").alias("n_code_blocks"),
        F.size("errors").alias("n_errors"), "n_attachments", "n_comments")


@query
def dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    """P10: failed parts of pages become error records."""
    broken = D.wiki_pages_broken(spark, sf).select("id", "title", "content", "url", "version", "last_modified")
    _, dead = P.split_errors(P.process_pages(broken, parts=("text",)))
    return dead.select("id", "part", "message", "error_type", "status_code")


# -- step 3: tables and code -----------------------------------------------
def _table_processed(spark, sf):
    tp = D.table_pages(spark, sf).withColumnRenamed("page_id", "id")
    return P.process_pages(tp, parts=("tables",))


@query
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """P2 + P4: every table cell of the line-item pages, typed."""
    return TB.table_cells(_table_processed(spark, sf))


@query
def table_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per extracted table."""
    return TB.table_shapes(_table_processed(spark, sf))


@query
def table_column_types(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred type of every table column."""
    return TB.column_types(_table_processed(spark, sf))


@query
def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """P5: code / pre blocks of the code pages (``pre > code`` gives two)."""
    cp = D.code_pages(spark, sf).select(F.col("page_id").alias("id"), "content")
    return TB.code_rows(P.process_pages(cp, parts=("code",)))


# -- step 4: summary and quality -------------------------------------------


def _corpus_comments(spark, sf):
    return A.comments(D.corpus_comments(spark, sf))


def _processed_corpus(spark, sf):
    """The mixed corpus with its text, and its tables, code blocks and comments counted."""
    pages = P.child_summary(D.corpus_pages(spark, sf), comments=_corpus_comments(spark, sf))
    return P.page_figures(pages, keep=("id", "n_comments"))


@query
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    """G1: corpus figures over the processed pages, tables and code of the mixed corpus."""
    return Q.corpus_summary(_processed_corpus(spark, sf))


@query
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per-page quality scores of the processed corpus."""
    return Q.page_scores(_processed_corpus(spark, sf))


@query
def corpus_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus quality report of the processed corpus."""
    return Q.corpus_quality(Q.page_scores(_processed_corpus(spark, sf)))


@query
def document_quality(spark: SparkSession, sf: str) -> DataFrame:
    """G2 on plain text: scores of every document as a page without parts."""
    qp = D.quality_pages(spark, sf)
    return Q.page_scores(qp.select("id", "content", P.metadata(qp).alias("metadata")))


@query
def raw_html_quality(spark: SparkSession, sf: str) -> DataFrame:
    """G2 on the corpus's raw HTML (formatting marks measurable) with parsed tables and code."""
    pages = P.child_summary(D.corpus_pages(spark, sf), comments=_corpus_comments(spark, sf))
    done = P.process_pages(pages.withColumn("html", F.col("content")), parts=("tables", "code"), keep=("id", "n_comments", "html"))
    return Q.page_scores(done.drop("comments", "content").withColumnRenamed("html", "content"))


# -- step 5: rate flags and request metrics --------------------------------


@query
def rate_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user sliding-window flag (window 86,400 s, limit 4)."""
    ev = D.table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = R.flag_rate(ev, "user_id", "ts", limit=4, window_seconds=86400)
    return out.select("event_id", "user_id", "sec", "n_in_window", "flagged")


@query
def rate_flag_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Rate key ``rate_limit:{event_type}:{user_id}``, window 3,600 s, limit 1."""
    ev = D.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    out = R.flag_rate(ev, R.rate_key(F.col("event_type"), F.col("user_id")), "ts", limit=1,
                      window_seconds=3600)
    return out.select("event_id", "rate_key", "sec", "n_in_window", "flagged")


@query
def request_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by (method, status)."""
    return M.count_by(D.requests(spark, sf), "method", "status")


@query
def error_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Errors by type (type read from the event's JSON properties)."""
    e = D.table(spark, sf, "events").filter(F.col("event_type") == "error")
    typed = e.select(F.concat(F.lit("E"), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(5))
                              .cast("string")).alias("type"))
    return M.count_by(typed, "type")


@query
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative latency buckets per method."""
    return M.latency_histogram(D.requests(spark, sf), "method", "duration")


@query
def latency_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Observation count and sum per method."""
    return M.latency_totals(D.requests(spark, sf), "method", "duration")


# -- step 6: work lists, unions, inventories --------------------------------


def _routed_outcome(spark, sf):
    items = B.route_items(A.worklist_lines(D.worklist(spark, sf)))
    known = B.known_keys(D.wiki_pages(spark, sf, spread=False), D.tracker_issue_keys(spark, sf))
    return B.batch_outcome(items, known)


@query
def worklist_route(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + F1 + F2 + J-4 + U2: every work-list item routed and checked."""
    return _routed_outcome(spark, sf).select("item", "kind", "ref", "status", "error")


@query
def batch_result(spark: SparkSession, sf: str) -> DataFrame:
    """Work-list items per status."""
    return B.batch_counts(_routed_outcome(spark, sf))


@query
def page_union(spark: SparkSession, sf: str) -> DataFrame:
    """Bag union of space scans (duplicates kept).

    The scans are of one table, so it is read once and a page is repeated for each scan that holds it."""
    pages = A.space_pages(D.wiki_pages_raw(spark, sf), None, D.BASE_URL)
    scans = F.when(F.col("space_key").isin("en", "fr"), F.array(F.lit("space"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return pages.select("id", "space_key", "url", F.explode(scans).alias("_scan")).drop("_scan")


@query
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of an output tree (files, successes, failures, bytes)."""
    return B.inventory(D.file_entries(spark, sf))


@query
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    """G4 + S6: file count per lower-cased extension."""
    return B.file_types(D.file_entries(spark, sf))


@query
def readable_size(spark: SparkSession, sf: str) -> DataFrame:
    """Human-readable sizes (B to TB) of derived byte counts."""
    d = D.table(spark, sf, "documents")
    size = (F.col("n_chars") * F.pow(F.lit(1024), F.pmod("doc_id", F.lit(5))).cast("long")
            + F.pmod("doc_id", F.lit(7)) * 37)
    return d.select(F.col("doc_id"), size.alias("size")).withColumn("readable", X.readable_size("size"))


# -- step 7: rendering --------------------------------------------------------


@query
def render_html(spark: SparkSession, sf: str) -> DataFrame:
    """Processed code pages rendered as standalone HTML documents."""
    cp = D.code_pages(spark, sf).select(F.col("page_id").alias("id"), "content")
    return RH.render_html(P.process_pages(cp, parts=("text", "code"))).select("id", "html")


@query
def render_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Processed line-item table pages rendered (text and tables sections)."""
    tp = D.table_pages(spark, sf).withColumnRenamed("page_id", "id")
    return RH.render_html(P.process_pages(tp, parts=("text", "tables"))).select("id", "html")


# -- step 9: tracker issues ---------------------------------------------------

ISSUE_COLUMNS = ["key", "title", "type", "status", "priority", "assignee", "project", "sprint"]


def _issue_rows(df):
    return df.select(*ISSUE_COLUMNS, iso_format("created").alias("created"), iso_format("updated").alias("updated"))


def _issue_comment_rows(spark, sf):
    """Comments of issues (A4 over the tracker's records), keyed by order."""
    return A.comments(D.issue_comments_landed(spark, sf).withColumnRenamed("l_orderkey", "page_id"))


@query
def issue_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All issues of project P3."""
    return _issue_rows(I.project_issues(D.tracker_issues(spark, sf), "P3"))


@query
def issue_first(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + L1: the first 1,000 issues of project P3 by number, as a caller may ask."""
    return _issue_rows(I.project_issues(D.tracker_issues(spark, sf), "P3", 1000))


@query
def issue_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Issue lookup by key (the keys of order 7 in every project)."""
    return _issue_rows(I.single_issue(D.tracker_issues(spark, sf), [f"P{i}-7" for i in range(10)]))


@query
def sprint_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A10: sprints of project P3."""
    sp = I.project_sprints(I.sprints(D.tracker_issues(spark, sf)), "P3")
    return sp.select("id", "name", "project", iso_format("start").alias("start"), iso_format("end").alias("end"))


@query
def sprint_issues(spark: SparkSession, sf: str) -> DataFrame:
    """L2 + J-3 + F4: issues of the first sprint named 'Sprint 1996-01' in P3."""
    issues = D.tracker_issues(spark, sf)
    out = I.sprint_issues(issues, I.sprints(issues), "P3", "Sprint 1996-01")
    return out.select("key", "title", "status", "sprint_id", iso_format("created").alias("created"))


@query
def issue_process(spark: SparkSession, sf: str) -> DataFrame:
    """Processed issues (cleaned description + metadata)."""
    p = I.process_issues(D.tracker_issues(spark, sf))
    return p.select("key", "content", *[F.col(f"metadata.{f}").alias(f) for f in
                                        ("title", "type", "status", "priority", "assignee", "created", "updated")])


def _issue_child(spark, sf, landed):
    return D.keyed_by_issue(spark, sf, landed)


def _processed_issues(spark, sf):
    """P11 with all children; tracker children are cleaned and projected as the wiki's.

    Children are gathered by order, as they landed, so each moves once and not again by the issue's key."""
    def by_order(landed):
        return landed.withColumn("l_orderkey", F.col("l_orderkey").cast("string")).withColumnRenamed("l_orderkey", "page_id")
    attachments = P.process_attachments(A.attachments(by_order(D.issue_attachments_landed(spark, sf)), D.BASE_URL))
    return I.process_issues(D.issues_by_order(spark, sf), P.clean_comments(A.comments(by_order(D.issue_comments_landed(spark, sf)))), attachments,
                            by_order(D.issue_changelog_landed(spark, sf)), by_order(D.issue_links_landed(spark, sf)),
                            child_key="order", times="times")


@query
def issue_contents(spark: SparkSession, sf: str) -> DataFrame:
    """P11 + J-2: processed issues with comments in their content, children counted."""
    return _processed_issues(spark, sf).select(
        "key", "content", *(F.size(c).alias(f"n_{c}") for c in ("comments", "attachments", "changelog", "linked_issues")))


@query
def issue_comments(spark: SparkSession, sf: str) -> DataFrame:
    """A9 + P7: every issue comment, cleaned, keyed by its issue."""
    return P.clean_comments(A.comments(_issue_child(spark, sf, D.issue_comments_landed(spark, sf)))).withColumnRenamed("page_id", "key")


@query
def issue_attachment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A9 + P8: every issue attachment, projected, keyed by its issue."""
    att = A.attachments(_issue_child(spark, sf, D.issue_attachments_landed(spark, sf)), D.BASE_URL)
    return P.process_attachments(att).withColumnRenamed("page_id", "key")


@query
def issue_links(spark: SparkSession, sf: str) -> DataFrame:
    """Linked issues of every issue, from the nested arrays."""
    done = _processed_issues(spark, sf).select("key", F.posexplode("linked_issues").alias("pos", "z"))
    return done.select("key", F.col("z.type").alias("type"), F.col("z.key").alias("linked"))


@query
def issue_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of every issue, from the nested arrays."""
    done = _processed_issues(spark, sf).select("key", F.explode("changelog").alias("z"))
    return done.select("key", "z.author", "z.created", "z.field", "z.from", "z.to")


@query
def page_child_rows(spark: SparkSession, sf: str) -> DataFrame:
    """J-1 nested: the comments and attachments that processed pages hold, in order, as rows."""
    pages = D.wiki_pages(spark, sf, spread=False).select("id")
    nested = P.nest_children(pages, P.process_attachments(_attachments(spark, sf)), _comments(spark, sf))
    comments = nested.select("id", F.lit("comment").alias("kind"), F.posexplode("comments").alias("n", "z"))
    attachments = nested.select("id", F.lit("attachment").alias("kind"), F.posexplode("attachments").alias("n", "z"))
    return (comments.select("id", "kind", "n", F.col("z.id").alias("child_id"), F.col("z.author").alias("label"))
            .unionByName(attachments.select("id", "kind", "n", F.col("z.id").alias("child_id"), F.col("z.filename").alias("label"))))


@query
def page_children_long(spark: SparkSession, sf: str) -> DataFrame:
    """J-1 long form: comments of existing pages, one row each, so no page grows with its children."""
    pages = D.wiki_pages(spark, sf, spread=False).select(F.col("id").alias("page_id"))
    return _comments(spark, sf).join(pages, "page_id", "left_semi").select("page_id", "pos", "id", "author", "created")


@query
def issue_children(spark: SparkSession, sf: str) -> DataFrame:
    """J-2: issues left-joined to their pre-aggregated comments."""
    issues = D.tracker_issues(spark, sf).select("key", "o_orderkey")
    out = P.child_summary(issues, comments=_issue_comment_rows(spark, sf), key="o_orderkey")
    return out.select("key", "n_comments")


@query
def issue_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """A9 + J-2: issues left-joined to their pre-aggregated attachments."""
    issues = D.tracker_issues(spark, sf).select("key", "o_orderkey")
    att = A.attachments(D.issue_attachments_landed(spark, sf).withColumnRenamed("l_orderkey", "page_id"),
                        D.BASE_URL)
    out = P.child_summary(issues, attachments=P.process_attachments(att), key="o_orderkey")
    return out.select("key", "n_attachments", "attachment_bytes")


@query
def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per project, issue counts by type, status, priority, assignee, total."""
    return I.project_summary(D.tracker_issues(spark, sf))


@query
def sprint_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per sprint counts, done rate, mean / median age, comments per issue."""
    issues = D.tracker_issues(spark, sf)
    with_counts = P.child_summary(issues, comments=_issue_comment_rows(spark, sf), key="o_orderkey")
    return I.sprint_metrics(with_counts)


# -- records as they came, files of their own, mergeable figures --------------------
@query
def broken_records(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + P10: landed lines that can't be read, with the line itself."""
    _, bad = A.split_raw_pages(A.typed(A.as_records(D.page_lines(spark, sf)), schemas.RAW_PAGE))
    return bad.select("id", "error_type", "message", "raw")


@query
def sound_records(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over the same lines: the pages that can be read."""
    ok, _ = A.split_raw_pages(A.typed(A.as_records(D.page_lines(spark, sf)), schemas.RAW_PAGE))
    return A.space_pages(ok, None, D.BASE_URL)


@query
def issue_records(spark: SparkSession, sf: str) -> DataFrame:
    """Issues with the fixed columns and fields that only the record has."""
    issues = A.typed(A.as_records(D.issue_lines(spark, sf)), schemas.ISSUE)
    return I.raw_rows(issues).select(
        "key", "title", "project", "status",
        F.variant_get("record", "$.fields.customfield_1.customer", "bigint").alias("customer"),
        F.variant_get("record", "$.fields.customfield_1.marks[0]", "string").alias("mark"))


@query
def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered code pages written as one HTML file per page, and read back."""
    path = shared_path(spark, f"page-files-{uuid.uuid4().hex}")
    sinks.write_rendered(render_html(spark, sf), path, "html")
    return read_files(spark, path).select("name", F.md5("content").alias("md5"), F.octet_length("content").alias("n_bytes"))


@query
def page_json_files(spark: SparkSession, sf: str) -> DataFrame:
    """K5: processed documents written as one indented JSON file per page, and read back."""
    path = shared_path(spark, f"page-json-{uuid.uuid4().hex}")
    qp = D.quality_pages(spark, sf)
    sinks.write_json_documents(qp.select("id", F.length("content").alias("n_chars"), P.metadata(qp).alias("metadata")),
                               path, sinks.page_file("id", "_processed.json"))
    back = spark.read.schema("id string, n_chars long, metadata struct<id:string,title:string,source:string>").option("multiLine", "true").json(path)
    return back.select(F.col("_metadata.file_name").alias("name"), "id", "n_chars", F.col("metadata.id").alias("metadata_id"), "metadata.source")


@query
def exact_median(spark: SparkSession, sf: str) -> DataFrame:
    """G9's selection over values with a wide range: median price in cents per order priority."""
    o = D.table(spark, sf, "orders")
    cents = o.select("o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return exact_medians(cents, ["o_orderpriority"], "cents").withColumnRenamed("median", "median_cents")


@query
def corpus_summary_merged(spark: SparkSession, sf: str) -> DataFrame:
    """G1 from stored partial states of eight batches of the corpus."""
    pages = _processed_corpus(spark, sf).withColumn("part", F.pmod(F.crc32("id"), F.lit(8)))
    path = shared_path(spark, f"summary-states-{uuid.uuid4().hex}")
    Q.write_state(Q.summary_state(pages, "part"), path, 0)
    return Q.finish_summary(Q.merge_states(Q.read_states(spark, path).drop("part")))


@query
def corpus_quality_merged(spark: SparkSession, sf: str) -> DataFrame:
    """G3 from partial states of eight batches of the corpus."""
    scores = Q.page_scores(_processed_corpus(spark, sf))
    scores = scores.withColumn("part", F.pmod(F.crc32("id"), F.lit(8)))
    return Q.finish_quality(Q.merge_states(Q.quality_state(scores, "part").drop("part")))
