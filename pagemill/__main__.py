"""Command-line entry: ``python -m pagemill <command> ...`` (or spark-submit).

Each command reads landed tables from paths and runs the matching job in
``pagemill.plans.jobs``; the session comes from the submit environment.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from pagemill import schemas
from pagemill.operators import issues as I
from pagemill.plans import jobs
from pagemill.session import get_session
from pagemill.sources import landed as A


def _fmt(path: str) -> str:
    return "json" if path.endswith((".json", ".jsonl")) else "parquet"


def _read(spark, path, schema):
    """A landed table with its declared schema; nothing is inferred."""
    return spark.read.schema(schema).format(_fmt(path)).load(path)


def _children(spark, args):
    """(attachment rows, comment rows) of the landed child tables that the command names."""
    att, cmt = getattr(args, "attachments", None), getattr(args, "comments", None)
    return (A.attachments(_read(spark, att, schemas.RAW_ATTACHMENTS), args.base_url) if att else None,
            A.comments(_read(spark, cmt, schemas.RAW_COMMENTS)) if cmt else None)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill", description="Corpus preparation jobs on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("extract-space", help="all pages of a space -> raw CSV, processed JSONL, summary")
    s.add_argument("space_key")
    s.add_argument("--pages", required=True, help="landed raw pages (JSON lines or Parquet)")
    s.add_argument("--base-url", required=True)
    s.add_argument("--output-dir", default="output")
    s.add_argument("--format", default="all", help="raw, processed or all")
    s = sub.add_parser("extract-page", help="one page with its children")
    s.add_argument("page_id")
    s.add_argument("--pages", required=True)
    s.add_argument("--base-url", required=True)
    s.add_argument("--attachments", help="landed attachment records")
    s.add_argument("--comments", help="landed comment records")
    s.add_argument("--no-attachments", action="store_true")
    s.add_argument("--no-comments", action="store_true")
    s.add_argument("--output-dir", default="output")
    s.add_argument("--format", default="all")
    s = sub.add_parser("extract-project", help="a project's issues -> raw CSV, processed JSONL, summary")
    s.add_argument("project_key")
    s.add_argument("--issues", required=True)
    s.add_argument("--max-results", type=int, help="only the first so many issues (default: all)")
    s.add_argument("--output-dir", default="output")
    s.add_argument("--format", default="all")
    s = sub.add_parser("extract-issue", help="one issue with its children")
    s.add_argument("issue_key")
    s.add_argument("--issues", required=True)
    s.add_argument("--base-url", default="")
    s.add_argument("--comments", help="landed comment records, keyed by issue")
    s.add_argument("--attachments", help="landed attachment records, keyed by issue")
    s.add_argument("--no-comments", action="store_true")
    s.add_argument("--no-attachments", action="store_true")
    s.add_argument("--output-dir", default="output")
    s.add_argument("--format", default="all")
    s = sub.add_parser("analyze-sprint", help="a sprint's issues, summary and metrics")
    s.add_argument("project_key")
    s.add_argument("sprint_name")
    s.add_argument("--issues", required=True)
    s.add_argument("--sprints", help="sprint table; derived from the issues when absent")
    s.add_argument("--comments", help="landed comment records, keyed by issue")
    s.add_argument("--output-dir", default="output")
    s = sub.add_parser("batch-process", help="route and check a work list")
    s.add_argument("input_file")
    s.add_argument("--pages", required=True)
    s.add_argument("--issues")
    s.add_argument("--output-dir", default="output")
    s = sub.add_parser("batch-summary", help="inventory of an output tree")
    s.add_argument("output_dir")
    s.add_argument("--report-dir", help="folder for the file types and the error contents (default: printed)")
    s = sub.add_parser("stream-pages", help="T1: process raw pages as they land (JSON lines)")
    s.add_argument("source")
    s.add_argument("output")
    s.add_argument("checkpoint")
    s.add_argument("--base-url", required=True)
    s.add_argument("--errors", help="folder of the records that can't be read (default: OUTPUT_errors)")
    s.add_argument("--continuous", action="store_true", help="keep running instead of draining what is there")
    s = sub.add_parser("stream-rate-flags", help="T3: flag events of a landed Parquet event stream")
    s.add_argument("source")
    s.add_argument("output")
    s.add_argument("checkpoint")
    s.add_argument("--key", required=True)
    s.add_argument("--ts", required=True)
    s.add_argument("--limit", type=int, required=True)
    s.add_argument("--window-seconds", type=int, required=True)
    s.add_argument("--max-files", type=int, default=100, help="event files per micro-batch")
    s.add_argument("--late", help="folder of the events behind the watermark, written when the stream ends (default: OUTPUT_late)")
    s.add_argument("--continuous", action="store_true")
    return p


def main(argv=None) -> int:
    args = build_parser().parse_args(argv)
    spark = get_session()
    c = args.command
    if c == "extract-space":
        raw = A.read_raw_pages(spark, args.pages, _fmt(args.pages))
        out = jobs.extract_space(spark, raw, args.space_key, args.output_dir, args.base_url, args.format)
    elif c == "extract-page":
        raw = A.read_raw_pages(spark, args.pages, _fmt(args.pages))
        att, cmt = _children(spark, args)
        jobs.extract_page(spark, raw, args.page_id, args.output_dir, args.base_url, att, cmt,
                          not args.no_attachments, not args.no_comments, args.format)
        out = {"page": args.page_id}
    elif c == "extract-project":
        jobs.extract_project(spark, I.read_issues(spark, args.issues, _fmt(args.issues)), args.project_key, args.output_dir,
                             args.max_results, args.format)
        out = {"project": args.project_key}
    elif c == "extract-issue":
        att, cmt = _children(spark, args)
        jobs.extract_issue(spark, I.read_issues(spark, args.issues, _fmt(args.issues)), args.issue_key, args.output_dir, cmt, att,
                           not args.no_comments, not args.no_attachments, args.format)
        out = {"issue": args.issue_key}
    elif c == "analyze-sprint":
        issues = I.read_issues(spark, args.issues, _fmt(args.issues))
        sprints = _read(spark, args.sprints, schemas.SPRINT) if args.sprints else I.sprints(issues)
        out = jobs.analyze_sprint(spark, issues, sprints, args.project_key, args.sprint_name, args.output_dir, _children(spark, args)[1])
    elif c == "batch-process":
        issues = I.read_issues(spark, args.issues, _fmt(args.issues)) if args.issues else None
        out = jobs.batch_process(spark, args.input_file, args.output_dir, _read(spark, args.pages, schemas.PAGE), issues)
    elif c == "stream-pages":
        from pagemill.streaming import pages as SP
        q = SP.start_processing(spark, args.source, args.output, args.checkpoint, args.base_url,
                                available_now=not args.continuous)
        errors = args.errors or args.output.rstrip("/") + "_errors"
        dead = SP.start_dead_letters(spark, args.source, errors, args.checkpoint.rstrip("/") + "_errors", available_now=not args.continuous)
        q.awaitTermination()
        dead.awaitTermination()
        out = {"stream": "pages", "output": args.output, "errors": errors}
    elif c == "stream-rate-flags":
        from pagemill.streaming import rate as SR
        schema = spark.read.parquet(args.source).schema  # from the landed files' footers
        q = SR.start_rate_flags(spark, args.source, schema, args.output, args.checkpoint, args.key, args.ts,
                                args.limit, args.window_seconds, available_now=not args.continuous, max_files=args.max_files)
        q.awaitTermination()
        late = args.late or args.output.rstrip("/") + "_late"
        SR.write_late_events(spark, args.source, schema, args.output, late)
        out = {"stream": "rate-flags", "output": args.output, "late": late}
    else:
        out = jobs.batch_summary(spark, args.output_dir, args.report_dir)
        for name in ("file_types", "processing_errors"):
            if isinstance(out[name], DataFrame):  # row by row, so the driver holds one partition at most
                for row in out.pop(name).toLocalIterator(prefetchPartitions=False):
                    print(json.dumps({name: row.asDict()}, default=str))
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
