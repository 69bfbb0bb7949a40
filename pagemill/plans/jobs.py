"""The command lifecycles as Spark jobs.

Each job reads landed tables, runs the operators and writes with the
DataFrame writers.  A job that needs a result twice (processed pages for the
JSONL sink and for a summary) writes it once and reads the written table back,
which also cuts the lineage; nothing is gathered on the driver except one-row
summaries.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import schemas, sinks
from pagemill.operators import batch as B
from pagemill.operators import issues as I
from pagemill.operators import pages as P
from pagemill.operators import quality as Q
from pagemill.sources import landed as A


def _p(out_dir: str, name: str) -> str:
    return os.path.join(out_dir, name)


def extract_space(spark: SparkSession, raw_pages: DataFrame, space_key: str, out_dir: str,
                  base_url: str, output_format: str = "all") -> dict:
    """extract-space: A1 -> [K1 raw CSV] -> [P9 -> K3 processed JSONL] -> K7 summary.

    Raw records missing a required field go to ``{space}_errors.jsonl`` (P10)
    instead of failing the whole job; the summary counts all raw pages.  Lines that can't
    be read belong to no space that one could tell, so they are among the errors of each
    job, with the line and its file."""
    found = raw_pages.filter(F.col("space_key") == space_key)
    readable = F.col("space_key") == space_key
    _, bad = A.split_raw_pages(raw_pages.filter(readable | F.col("problem").isNotNull() if "problem" in raw_pages.columns else readable))
    ok, _ = A.split_raw_pages(found)
    sinks.write_jsonl(bad, _p(out_dir, f"{space_key}_errors.jsonl"))
    pages = A.space_pages(ok, None, base_url).drop("space_key")
    write_raw, write_processed = sinks.sinks_for(output_format)
    if write_raw:
        sinks.write_csv(pages, _p(out_dir, f"{space_key}_raw.csv"))
    if write_processed:
        sinks.write_jsonl(P.process_pages(pages), _p(out_dir, f"{space_key}_processed.jsonl"))
    # one pass: the row that is returned is the row that is written
    summary = sinks.space_summary(found, space_key, output_format).first().asDict()
    sinks.write_summary(spark, summary, _p(out_dir, f"{space_key}_summary.json"))
    return summary


def extract_page(spark: SparkSession, raw_pages: DataFrame, page_id: str, out_dir: str, base_url: str,
                 attachments: DataFrame | None = None, comments: DataFrame | None = None,
                 include_attachments: bool = True, include_comments: bool = True,
                 output_format: str = "all") -> None:
    """extract-page: A2 -> J-1 (F6 flags) -> K5 raw -> P9 -> K5 processed.

    ``attachments`` / ``comments`` are raw child rows (A3 / A4 output)."""
    page = A.single_page(raw_pages, page_id, base_url).drop("space_key")
    att = attachments.filter(F.col("page_id") == page_id) if (include_attachments and attachments is not None) else None
    cmt = comments.filter(F.col("page_id") == page_id) if (include_comments and comments is not None) else None
    write_raw, write_processed = sinks.sinks_for(output_format)
    if write_raw:
        raw = P.nest_children(page, att, cmt) if (att is not None or cmt is not None) else page
        sinks.write_single_json(raw, _p(out_dir, f"page_{page_id}_raw.json"))
    if write_processed:
        done = P.process_pages(page, P.process_attachments(att) if att is not None else None,
                               P.clean_comments(cmt) if cmt is not None else None)
        sinks.write_single_json(done, _p(out_dir, f"page_{page_id}_processed.json"))


def extract_project(spark: SparkSession, issues: DataFrame, project_key: str, out_dir: str,
                    max_results: int | None = None, output_format: str = "all") -> None:
    """extract-project: A7 -> K2 -> P11 -> K4 -> G8 -> K8.

    All issues, or with ``max_results`` (L1) the first so many; the summary is of the
    whole project either way.  The raw CSV has the record as it came in the column
    ``record`` if the issues were read from JSON lines (``issues.read_issues``)."""
    found = I.project_issues(issues, project_key, max_results)
    write_raw, write_processed = sinks.sinks_for(output_format)
    if write_raw:
        sinks.write_csv(I.raw_rows(found), _p(out_dir, f"{project_key}_raw.csv"))
    if write_processed:
        sinks.write_jsonl(I.process_issues(found), _p(out_dir, f"{project_key}_processed.jsonl"))
        whole = I.project_issues(issues, project_key)
        sinks.write_jsonl(I.project_summary(whole, by_project=False), _p(out_dir, f"{project_key}_summary.json"))


def extract_issue(spark: SparkSession, issues: DataFrame, key: str, out_dir: str,
                  comments: DataFrame | None = None, attachments: DataFrame | None = None,
                  include_comments: bool = True, include_attachments: bool = True,
                  output_format: str = "all") -> None:
    """extract-issue: A8 -> J-2 (F6 flags) -> K6 raw -> P11 -> K6 processed.

    ``comments`` / ``attachments`` are raw child rows (A3 / A4 output) keyed by the issue.
    The raw file has every field of the record if the issue was read from JSON lines."""
    one = I.single_issue(issues, key)
    cmt = comments.filter(F.col("page_id") == key) if (include_comments and comments is not None) else None
    att = attachments.filter(F.col("page_id") == key) if (include_attachments and attachments is not None) else None
    write_raw, write_processed = sinks.sinks_for(output_format)
    if write_raw:
        raw = I.raw_rows(one)
        raw = P.nest_children(raw, att, cmt, key="key") if (att is not None or cmt is not None) else raw
        sinks.write_single_json(raw, _p(out_dir, f"issue_{key}_raw.json"))
    if write_processed:
        done = I.process_issues(one, P.clean_comments(cmt) if cmt is not None else None,
                                P.process_attachments(att) if att is not None else None)
        sinks.write_single_json(done, _p(out_dir, f"issue_{key}_processed.json"))


def analyze_sprint(spark: SparkSession, issues: DataFrame, sprint_table: DataFrame, project_key: str,
                   sprint_name: str, out_dir: str, comments: DataFrame | None = None) -> dict:
    """analyze-sprint: L2 (missing sprint -> LookupError) -> issues -> P11 -> G8 + G9 -> K9.

    The report row holds the sprint, the summary and the metrics; the sprint's
    issues go to their own JSONL directory beside it (D7).  ``comments`` are raw child
    rows keyed by the issue (``page_id``).  A sprint without issues has zero metrics.
    """
    sprint = I.first_sprint(I.project_sprints(sprint_table, project_key), sprint_name).first()
    if sprint is None:
        raise LookupError(f"Sprint '{sprint_name}' not found in project {project_key}")
    base = _p(out_dir, sinks.sprint_file_name(project_key, sprint_name))
    found = issues.filter((F.col("project") == project_key) & (F.col("sprint") == sprint_name))
    if comments is not None:  # only those of the sprint are parsed and nested
        comments = comments.join(found.select(F.col("key").alias("page_id")), "page_id", "left_semi")
    processed = I.process_issues(found, P.clean_comments(comments) if comments is not None else None)
    sinks.write_jsonl(processed, base + "_issues")
    # lineage cut: summaries read the written issues
    written = spark.read.schema(processed.schema).json(base + "_issues")
    rows = written.select("metadata.*", F.size("comments").alias("n_comments"), F.lit(project_key).alias("project"))
    sinks.write_jsonl(I.project_summary(rows, by_project=False), base + "_summary")  # one row per dimension value
    metrics = I.sprint_metrics(rows.select(
        "project", F.lit(sprint_name).alias("sprint"), "status", "n_comments",
        F.to_timestamp("created").alias("created"), F.to_timestamp("updated").alias("updated"))).collect()  # at most one row
    report = {
        "sprint_info": {k: (str(v) if v is not None else None) for k, v in sprint.asDict().items()},
        "summary": base + "_summary",
        "metrics": metrics[0].asDict() if metrics else {"n_issues": 0, "n_done": 0, "n_comments": 0},
        "issues": base + "_issues",
    }
    sinks.write_summary(spark, report, base + ".json")
    return report


def batch_process(spark: SparkSession, worklist_path: str, out_dir: str, pages: DataFrame,
                  issues: DataFrame | None = None) -> dict:
    """batch-process: A5 + F1 -> F2 -> J-4 -> K10 (one folder per status) -> G7."""
    items = B.route_items(A.read_worklist(spark, worklist_path))
    outcome = B.batch_outcome(items, B.known_keys(pages, issues))
    outcome = outcome.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    path = _p(out_dir, "batch_results")
    results = outcome.select(F.col("item").alias("id"), "kind", "status", "error", "timestamp")
    sinks.write_jsonl(results, path, partition_by="status")
    counts = B.batch_counts(spark.read.schema(results.schema).json(path))
    return {r["status"]: r["n"] for r in counts.collect()}


def batch_summary(spark: SparkSession, out_dir: str, report_dir: str | None = None) -> dict:
    """G4 over a real output tree (A6 listing, error files read on their own).

    The totals are one row.  ``file_types`` (``ext, n``) and ``processing_errors`` (``file,
    error``, read inside tasks) are as long as the tree makes them: they are
    DataFrames, or with ``report_dir`` JSON-lines folders there and the report names them.
    A missing directory gives the zero summary without a readable size or
    timestamp, as the source tool does.
    """
    from datetime import datetime, timezone
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(out_dir)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return {"total_files": 0, "successful_files": 0, "failed_files": 0, "file_types": {}, "total_size": 0,
                "processing_errors": []}
    entries = A.list_files(spark, out_dir)
    parts = {"file_types": B.file_types(entries), "processing_errors": B.error_contents(spark, entries)}
    if report_dir:
        for name, rows in parts.items():
            sinks.write_jsonl(rows, _p(report_dir, name))
            parts[name] = _p(report_dir, name)
    return {**B.inventory(entries).first().asDict(), **parts,
            "generated_at": datetime.now(timezone.utc).replace(tzinfo=None).isoformat()}


def corpus_report(processed: DataFrame) -> dict:
    """G1 report dict (rounded averages) from processed pages."""
    row = Q.corpus_summary(processed).first()
    return Q.report(row.asDict() if row else None, "summary")


def quality_report(processed: DataFrame) -> dict:
    """G3 report dict from processed pages."""
    row = Q.corpus_quality(Q.page_scores(processed), digits=None).first()
    return Q.report(row.asDict(), "quality")


__all__ = ["extract_space", "extract_page", "extract_project", "extract_issue", "analyze_sprint",
           "batch_process", "batch_summary", "corpus_report", "quality_report", "schemas"]
