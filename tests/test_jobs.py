"""Command lifecycles end to end on the smallest tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import issues as I
from pagemill.operators import pages as P
from pagemill.plans import jobs
from pagemill.sources import landed as A
from pagemill.sources import testdata as D
from tests.conftest import SF_SMALL


def _json_rows(spark, path):
    assert os.path.isfile(path)
    return spark.read.json(path, multiLine=True).collect()


def test_extract_space_all_formats(spark, tmp_out):
    raw = D.wiki_pages_raw(spark, SF_SMALL)
    summary = jobs.extract_space(spark, raw, "en", tmp_out, "http://w", "all")
    n_en = raw.filter(F.col("space_key") == "en").count()
    assert summary["total_pages"] == n_en and summary["output_formats"] == "all"
    processed = spark.read.json(os.path.join(tmp_out, "en_processed.jsonl"))
    assert processed.count() == n_en
    assert set(processed.columns) >= {"content", "metadata", "tables", "code_blocks", "attachments", "comments"}
    assert os.path.isdir(os.path.join(tmp_out, "en_raw.csv"))


def test_extract_space_unknown_format_writes_only_summary(spark, tmp_out):
    raw = D.wiki_pages_raw(spark, SF_SMALL)
    s = jobs.extract_space(spark, raw, "fr", tmp_out, "http://w", "pdf")
    assert s["total_pages"] > 0
    assert sorted(os.listdir(tmp_out)) == ["fr_errors.jsonl", "fr_summary.json"]


def test_extract_space_routes_broken_raw_pages(spark, tmp_out):
    raw = D.wiki_pages_raw_broken(spark, SF_SMALL)
    s = jobs.extract_space(spark, raw, "en", tmp_out, "http://w", "processed")
    bad = spark.read.json(os.path.join(tmp_out, "en_errors.jsonl"))
    n_en = raw.filter(F.col("space_key") == "en")
    assert bad.count() == n_en.filter(F.col("body").isNull()).count() > 0
    assert s["total_pages"] == n_en.count()


def test_extract_page_with_children(spark, tmp_out):
    raw = D.wiki_pages_raw(spark, SF_SMALL)
    att = A.attachments(D.wiki_attachments_landed(spark, SF_SMALL), "http://w")
    cmt = A.comments(D.wiki_comments_landed(spark, SF_SMALL))
    jobs.extract_page(spark, raw, "3", tmp_out, "http://w", att, cmt)
    done = _json_rows(spark, os.path.join(tmp_out, "page_3_processed.json"))[0]
    assert done.id == "3" and done.metadata.url == "http://w/wiki/pages/3"
    assert len(done.attachments) == att.filter("page_id = '3'").count()
    assert [c.id for c in done.comments] == [r.id for r in cmt.filter("page_id = '3'").orderBy("pos").collect()]
    rawp = _json_rows(spark, os.path.join(tmp_out, "page_3_raw.json"))[0]
    assert rawp.content.startswith("<!DOCTYPE html>")


def test_extract_page_without_children(spark, tmp_out):
    raw = D.wiki_pages_raw(spark, SF_SMALL)
    jobs.extract_page(spark, raw, "4", tmp_out, "http://w", include_attachments=False, include_comments=False,
                      output_format="processed")
    done = _json_rows(spark, os.path.join(tmp_out, "page_4_processed.json"))[0]
    assert done.attachments == [] and done.comments == []
    assert not os.path.exists(os.path.join(tmp_out, "page_4_raw.json"))


def test_extract_project_and_issue(spark, tmp_out):
    issues = D.tracker_issues(spark, SF_SMALL)
    jobs.extract_project(spark, issues, "P3", tmp_out, max_results=25)
    assert spark.read.json(os.path.join(tmp_out, "P3_processed.jsonl")).count() == 25
    summ = spark.read.json(os.path.join(tmp_out, "P3_summary.json"))
    assert summ.filter("dimension = 'total'").first().n == issues.filter("project = 'P3'").count() > 25
    key = issues.filter("project = 'P3'").orderBy("key").first().key
    jobs.extract_issue(spark, issues, key, tmp_out)
    one = _json_rows(spark, os.path.join(tmp_out, f"issue_{key}_processed.json"))[0]
    assert one.key == key and one.metadata.key == key


def test_analyze_sprint_and_missing_sprint(spark, tmp_out):
    issues = D.tracker_issues(spark, SF_SMALL)
    sp = I.sprints(issues)
    name = sp.filter("project = 'P1'").orderBy("id").first().name
    rep = jobs.analyze_sprint(spark, issues, sp, "P1", name, tmp_out)
    n = issues.filter((F.col("project") == "P1") & (F.col("sprint") == name)).count()
    assert rep["metrics"]["n_issues"] == n
    total = spark.read.json(rep["summary"]).filter("dimension = 'total'").first().n
    assert total == n
    assert os.path.exists(os.path.join(tmp_out, f"sprint_P1_{name.replace(' ', '_')}.json"))
    with pytest.raises(LookupError):
        jobs.analyze_sprint(spark, issues, sp, "P1", "Sprint 1800-01", tmp_out)


def test_batch_process(spark, tmp_out):
    wl = os.path.join(tmp_out, "work.txt")
    with open(wl, "w") as f:
        f.write("CONF_1\n  CONF_9999\n\nSPACE_en\nX_1\n\tPROJECT_P1 \n")
    pages = D.wiki_pages(spark, SF_SMALL)
    counts = jobs.batch_process(spark, wl, tmp_out, pages, D.tracker_issues(spark, SF_SMALL))
    assert counts == {"successful": 3, "failed": 1, "skipped": 1}
    failed = spark.read.json(os.path.join(tmp_out, "batch_results")).filter("status = 'failed'").first()
    assert failed.id == "CONF_9999" and failed.error == "not found: CONF_9999"


def test_reports(spark):
    pages = D.wiki_pages(spark, SF_SMALL).select("id", "title", "content", "url", "version", "last_modified")
    done = P.process_pages(pages)
    s = jobs.corpus_report(done)
    assert s["total_pages"] == 50 and s["date_range"]["oldest_page"] == "2024-01-01T01:00:00"
    q = jobs.quality_report(done)
    assert set(q) == {"averages", "ranges", "quality_score"}
    assert q["averages"]["formatting_quality"] == 0.0


def test_command_line_entry(spark, tmp_out, capsys):
    from pagemill.__main__ import main
    src = os.path.join(tmp_out, "raw.parquet")
    D.wiki_pages_raw(spark, SF_SMALL).write.parquet(src)
    out = os.path.join(tmp_out, "out")
    assert main(["extract-space", "de", "--pages", src, "--base-url", "http://w", "--output-dir", out]) == 0
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["space_key"] == "de" and printed["total_pages"] > 0
    assert main(["batch-summary", out]) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["total_files"] > 0


def test_extract_project_has_no_cap(spark, tmp_out):
    rows = [(f"P1-{i}", "t", "<p>d</p>", "Bug", "Done", "1", None, "P1", "S") for i in range(1202)]
    issues = spark.createDataFrame(rows, "key string, title string, description string, type string, status string, "
                                         "priority string, assignee string, project string, sprint string")
    issues = issues.withColumn("created", F.lit("2024-01-01").cast("timestamp")).withColumn("updated", F.col("created"))
    jobs.extract_project(spark, issues, "P1", tmp_out)
    assert spark.read.json(os.path.join(tmp_out, "P1_processed.jsonl")).count() == 1202
    assert spark.read.json(os.path.join(tmp_out, "P1_summary.json")).filter("dimension = 'total'").first().n == 1202
    firsts = [r.key for r in I.project_issues(issues, "P1", 3).collect()]
    assert firsts == ["P1-0", "P1-1", "P1-2"]


def test_analyze_sprint_counts_comments_and_takes_empty_sprints(spark, tmp_out):
    issues = D.tracker_issues(spark, SF_SMALL)
    sp = I.sprints(issues)
    name = sp.filter("project = 'P1'").orderBy("id").first().name
    comments = A.comments(D.keyed_by_issue(spark, SF_SMALL, D.issue_comments_landed(spark, SF_SMALL)))
    keys = issues.filter((F.col("project") == "P1") & (F.col("sprint") == name)).select(F.col("key").alias("page_id"))
    rep = jobs.analyze_sprint(spark, issues, sp, "P1", name, tmp_out, comments)
    assert rep["metrics"]["comments_per_issue"] == comments.join(keys, "page_id").count() / keys.count() > 0
    empty = spark.createDataFrame([(1, "Empty", "P1", None, None)], sp.schema)
    assert jobs.analyze_sprint(spark, issues, empty, "P1", "Empty", tmp_out)["metrics"] == {"n_issues": 0, "n_done": 0, "n_comments": 0}


def test_blank_work_list_and_empty_space(spark, tmp_out):
    wl = os.path.join(tmp_out, "blank.txt")
    with open(wl, "w") as f:
        f.write("\n  \n")
    assert jobs.batch_process(spark, wl, tmp_out, D.wiki_pages(spark, SF_SMALL)) == {}
    assert jobs.extract_space(spark, D.wiki_pages_raw(spark, SF_SMALL), "none", tmp_out, "http://w")["total_pages"] == 0


def test_extract_issue_with_attachments_and_flags(spark, tmp_out):
    issues = D.tracker_issues(spark, SF_SMALL)
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    key = issues.join(li, "o_orderkey").orderBy("key").first().key
    comments = A.comments(D.keyed_by_issue(spark, SF_SMALL, D.issue_comments_landed(spark, SF_SMALL)))
    atts = A.attachments(D.keyed_by_issue(spark, SF_SMALL, D.issue_attachments_landed(spark, SF_SMALL)), "http://w")
    jobs.extract_issue(spark, issues, key, tmp_out, comments, atts)
    done = _json_rows(spark, os.path.join(tmp_out, f"issue_{key}_processed.json"))[0]
    assert len(done.comments) == comments.filter(F.col("page_id") == key).count() > 0
    assert len(done.attachments) == atts.filter(F.col("page_id") == key).count() > 0
    assert all(c.content in done.content for c in done.comments)
    jobs.extract_issue(spark, issues, key, tmp_out, comments, atts, include_comments=False, include_attachments=False)
    done = _json_rows(spark, os.path.join(tmp_out, f"issue_{key}_processed.json"))[0]
    assert done.comments == done.attachments == []


def test_batch_summary_lists_types_and_error_contents(spark, tmp_out, capsys):
    from pagemill.__main__ import main
    tree, report = os.path.join(tmp_out, "tree"), os.path.join(tmp_out, "report")
    os.makedirs(tree)
    for name, text in (("a_error.txt", "went wrong"), ("b.json", "{}")):
        with open(os.path.join(tree, name), "w") as f:
            f.write(text)
    assert main(["batch-summary", tree]) == 0
    printed = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [p["processing_errors"]["error"] for p in printed if "processing_errors" in p] == ["went wrong"]
    assert printed[-1]["total_files"] == 2 and printed[-1]["failed_files"] == 1
    jobs.batch_summary(spark, tree, report)
    assert {r.ext: r.n for r in spark.read.json(os.path.join(report, "file_types")).collect()} == {".txt": 1, ".json": 1}


def test_extract_issue_nests_comments_in_order(spark, tmp_out):
    issues = D.tracker_issues(spark, SF_SMALL)
    key = issues.orderBy("key").first().key
    cmts = spark.createDataFrame([(key, 1, "c2", "bo", "2024-01-02", "<p>two</p>"),
                                  (key, 0, "c1", "al", "2024-01-01", "<p>one</p>"),
                                  ("other", 0, "x", "zz", "2024-01-01", "<p>no</p>")],
                                 "page_id string, pos int, id string, author string, created string, content string")
    jobs.extract_issue(spark, issues, key, tmp_out, comments=cmts)
    raw = _json_rows(spark, os.path.join(tmp_out, f"issue_{key}_raw.json"))[0]
    assert [c.id for c in raw.comments] == ["c1", "c2"]
    done = _json_rows(spark, os.path.join(tmp_out, f"issue_{key}_processed.json"))[0]
    assert done.metadata.key == key and done.content


def test_command_line_stream_pages(spark, tmp_out, capsys):
    from pagemill.__main__ import main
    src = os.path.join(tmp_out, "landing")
    D.wiki_pages_raw(spark, SF_SMALL).write.json(src)
    out, ck = os.path.join(tmp_out, "processed"), os.path.join(tmp_out, "ck")
    assert main(["stream-pages", src, out, ck, "--base-url", "http://w"]) == 0
    assert spark.read.json(out).count() == 50
