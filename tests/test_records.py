"""Landed JSON lines as they came: broken records, unknown fields, files of their own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill import sinks
from pagemill.operators import issues as I
from pagemill.operators import render as RH
from pagemill.plans import jobs
from pagemill.sources import landed as A
from pagemill.sources import named_files as N
from pagemill.streaming import pages as SP

GOOD = {"id": "1", "title": "One", "body": {"storage": {"value": "<p>x</p>"}}, "version": {"number": 1, "when": "2024-01-01"}, "space_key": "en",
        "labels": ["new"]}
LINES = [json.dumps(GOOD), json.dumps(GOOD)[:-20], json.dumps({**GOOD, "id": 2, "version": {"number": "abc", "when": ""}}),
         json.dumps({k: v for k, v in GOOD.items() if k != "title"}), "", "   ", "[1, 2]", "null", '"text"', json.dumps({**GOOD, "id": "9", "title": None})]


def _land(folder, lines, name="a.json"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")
    return str(folder)


# -- broken records -------------------------------------------------------------
def _check_split(ok, bad, folder):
    assert [r.id for r in ok] == ["1"]
    found = sorted((r.error_type, r.message, r.raw) for r in bad)
    assert found == sorted([
        ("JSONDecodeError", "not a JSON record", LINES[1]), ("ValueError", "a field has another type than expected", LINES[2]),
        ("KeyError", "'title'", LINES[3]), ("KeyError", "'id'", "[1, 2]"), ("KeyError", "'id'", "null"), ("KeyError", "'id'", '"text"'),
        ("KeyError", "'title'", LINES[9])])
    assert {os.path.basename(r.source_file) for r in bad} == {"a.json"}


def test_broken_lines_keep_text_and_file(spark, tmp_path):
    folder = _land(tmp_path / "in", LINES)
    ok, bad = A.split_raw_pages(A.read_raw_pages(spark, folder))
    assert set(ok.columns) == {"id", "title", "body", "version", "space_key"}
    _check_split(ok.collect(), bad.collect(), folder)


def test_broken_lines_of_a_stream(spark, tmp_path):
    folder = _land(tmp_path / "in", LINES)
    SP.start_processing(spark, folder, f"{tmp_path}/out", f"{tmp_path}/ck1", "http://w").awaitTermination()
    SP.start_dead_letters(spark, folder, f"{tmp_path}/dead", f"{tmp_path}/ck2").awaitTermination()
    _check_split(spark.read.json(f"{tmp_path}/out").collect(), spark.read.json(f"{tmp_path}/dead").collect(), folder)


def test_space_job_writes_broken_lines(spark, tmp_path):
    raw = A.read_raw_pages(spark, _land(tmp_path / "in", [*LINES, json.dumps({**GOOD, "space_key": "fr", "title": None})]))
    summary = jobs.extract_space(spark, raw, "en", f"{tmp_path}/out", "http://w", "processed")
    bad = spark.read.json(f"{tmp_path}/out/en_errors.jsonl").collect()
    # unreadable lines are among the errors of any space, lines of another space are not
    assert sorted(r.raw for r in bad) == sorted([LINES[1], LINES[2], LINES[3], LINES[9]])
    assert summary["total_pages"] == 4


# -- raw issues ------------------------------------------------------------------
ISSUE = {"key": "P1-1", "title": "T", "project": "P1", "status": "Open", "created": "2024-01-01T10:00:00", "fields": {"custom_7": {"deep": [1, {"x": "é"}]}}}


def test_unknown_fields_of_issues_survive(spark, tmp_path):
    folder = _land(tmp_path / "in", [json.dumps(ISSUE), json.dumps({**ISSUE, "key": "P1-2", "created": "soon"}), "{broken"])
    issues = I.read_issues(spark, folder)
    out = f"{tmp_path}/out"
    jobs.extract_issue(spark, issues, "P1-1", out)
    with open(f"{out}/issue_P1-1_raw.json") as f:
        raw = json.load(f)
    assert raw["record"] == ISSUE and raw["title"] == "T" and raw["sprint"] is None
    jobs.extract_project(spark, issues, "P1", out)
    rows = sinks.read_csv(spark, f"{out}/P1_raw.csv", "key string, title string, description string, type string, status string, priority string, "
                          "assignee string, project string, sprint string, created string, updated string, record string").collect()
    assert {r.key for r in rows} == {"P1-1", "P1-2"}
    assert all(json.loads(r.record)["fields"] == ISSUE["fields"] for r in rows)
    assert sorted((r.error_type, r.raw[:7]) for r in I.broken_issues(issues).collect()) == [("JSONDecodeError", "{broken"), ("ValueError", '{"key":')]


# -- files of their own ------------------------------------------------------------
def _files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


def test_named_files_appear_as_a_whole_and_are_replaced(spark, tmp_path):
    out = f"{tmp_path}/pages"
    df = spark.range(40).select(F.format_string("p%02d.html", "id").alias("name"), F.concat(F.lit("<é>\n"), F.col("id")).alias("content")).repartition(6)
    N.write_files(df, out, "overwrite")
    assert _files(out) == {f"p{i:02d}.html": f"<é>\n{i}".encode() for i in range(40)}
    N.write_files(df.limit(2).select(F.concat(F.lit("sub/"), "name").alias("name"), F.lit(None).cast("binary").alias("content")), out, "overwrite")
    assert len(_files(out)) == 2 and set(_files(out).values()) == {b""}
    one = spark.createDataFrame([("a.txt", b"1")], "name string, content binary")
    N.write_files(one, out, "append")
    N.write_files(one.withColumn("content", F.lit(b"2")), out, "append")
    assert len(_files(out)) == 3 and _files(out)["a.txt"] == b"2"
    N.write_files(one.limit(0), out, "overwrite")
    assert os.path.isdir(out) and _files(out) == {}
    assert os.listdir(tmp_path) == ["pages"]


@pytest.mark.parametrize("name", [None, "", "../x", "/x", "a/../b", "a//b"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, name):
    out = f"{tmp_path}/pages"
    good = spark.range(20).select(F.format_string("p%d", "id").alias("name"), F.lit("new").alias("content")).repartition(4)
    N.write_files(good.select("name", F.lit("old").alias("content")), out, "overwrite")
    bad = good.unionByName(spark.createDataFrame([(name, "x")], "name string, content string"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="not a file name"):
            N.write_files(bad, out, mode)
    assert set(_files(out).values()) == {b"old"} and len(_files(out)) == 20
    assert os.listdir(tmp_path) == ["pages"]


def test_rendered_pages_are_html_files(spark, tmp_path):
    df = spark.createDataFrame([("42", "<p>é</p>"), ("a/b", "x")], "id string, html string")
    sinks.write_rendered(df, f"{tmp_path}/html", "html")
    assert _files(f"{tmp_path}/html") == {"page_42.html": "<p>é</p>".encode(), "page_a_b.html": b"x"}
    assert "html" in RH.render_html.__doc__.lower()


def test_page_files_are_read_back_without_the_driver_holding_them(spark, tmp_path):
    import hashlib

    from pagemill.plans.catalog import QUERIES, render_html
    rows = [(i, f"Line {i} é <b> & more\n" * (i % 7), "en", "s", 1) for i in range(60)] + [(None, "no id", "en", "s", 1), (60, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    files = QUERIES["page_files"](spark, str(tmp_path))
    assert files.inputFiles() == []  # of Spark's file sources the driver holds the status of each file
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files.dtypes == [("name", "string"), ("md5", "string"), ("n_bytes", "int")]
    pages = {f"page_{r.id or ''}.html": r.html.encode() for r in render_html(spark, str(tmp_path)).collect()}
    assert len(pages) == 62
    assert sorted(map(tuple, files.collect())) == sorted((n, hashlib.md5(b).hexdigest(), len(b)) for n, b in pages.items())
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["page_files"](spark, f"{tmp_path}/none").collect() == []


def test_files_are_listed_and_read_in_parts(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from pagemill.sources import landed as A
    out = f"{tmp_path}/files"
    df = spark.range(25).select(F.format_string("_%02d", "id").alias("name"), F.expr("repeat('x', cast(id as int))").alias("content"))
    N.write_files(df, out, "overwrite")
    os.makedirs(f"{out}/sub")
    want = {f"_{i:02d}": b"x" * i for i in range(25)}
    assert {r.name: bytes(r.content) for r in N.read_files(spark, out).collect()} == want
    monkeypatch.setattr(A, "LISTING_ROWS", 7)
    names = list(N._list_names([pa.RecordBatch.from_pydict({"dir": [out]})]))
    assert [b.num_rows for b in names] == [7, 7, 7, 4]
    monkeypatch.setattr(N, "READ_FILES", 6)
    monkeypatch.setattr(N, "READ_BYTES", 40)
    parts = list(N._read_named(out)([pa.RecordBatch.from_pydict({"name": sorted(want)})]))
    assert {n: c for b in parts for n, c in zip(*b.to_pydict().values(), strict=True)} == want
    assert all(b.num_rows <= 6 and sum(map(len, b.column("content").to_pylist())) <= 40 for b in parts) and parts[0].num_rows == 6


def test_single_json_takes_no_part_of_the_scan_away(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("x"), F.struct(F.lit(1).alias("é")).alias("s")).repartition(5).write.parquet(src)
    sinks.write_single_json(spark.read.parquet(src).filter("id = '7'"), f"{tmp_path}/out/page_7_raw.json")
    sinks.write_single_json(spark.read.parquet(src).filter("id = 'none'"), f"{tmp_path}/out/page_none_raw.json")
    assert os.listdir(f"{tmp_path}/out") == ["page_7_raw.json"]
    text = open(f"{tmp_path}/out/page_7_raw.json").read()
    assert json.loads(text) == {"id": "7", "x": None, "s": {"é": 1}} and text.startswith("{\n  ")


def test_a_task_makes_each_folder_once():
    class Files:
        calls = []

        def create_dir(self, path, recursive):
            self.calls.append(path)

    made = set()
    assert [N._below(Files(), "r", name, made) for name in ("a/b/1", "a/b/2", "a/3")] == ["r/a/b/1", "r/a/b/2", "r/a/3"]
    assert Files.calls == ["r/a", "r/a/b"]


def test_children_of_issues_move_once_and_come_once_for_each_order_row(spark, tmp_path):
    import datetime as dt

    from pagemill.plans.catalog import QUERIES
    at, day = str(tmp_path), dt.date(2020, 1, 2)
    # Order 1 stands twice for P3-1 and once for P4-1; order 2 has no customer number, 3 no lines, 9 no order.
    orders = [(1, 13, "F", 1.0, day, "5-LOW"), (1, 23, "O", 2.0, day, "5-LOW"), (1, 4, "P", 3.0, day, "5-LOW"),
              (2, None, "F", 4.0, day, "5-LOW"), (3, 13, "F", 5.0, day, "5-LOW"), (None, 13, "F", 6.0, day, "5-LOW")]
    lines = [(1, 7, 1, 2, 5.0, 1.0, 0.0, 0.0, "R", "O", day), (1, 8, 1, 1, 6.0, 1.0, 0.0, 0.0, "N", "F", day), (2, 7, 1, 1, 7.0, 1.0, 0.0, 0.0, "N", "F", day),
             (9, 7, 1, 1, 8.0, 1.0, 0.0, 0.0, "N", "F", day), (None, 7, 1, 1, 9.0, 1.0, 0.0, 0.0, "N", "F", day)]
    for name, rows, kind in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
            ("customer", [(13, "c13"), (13, "c13 too"), (4, "c4")], "c_custkey long, c_name string"),
            ("part", [(7, "a", "t", 1)], "p_partkey long, p_name string, p_type string, p_size int")):
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    done = QUERIES["issue_contents"](spark, at)
    found = sorted((r.key or "", r.content.count("Line 1"), r.content.count("Line 2"), r.n_comments, r.n_attachments, r.n_changelog, r.n_linked_issues)
                   for r in done.collect())
    assert found == [("", 0, 0, 0, 0, 0, 0)] * 3 + [("P3-1", 2, 2, 4, 2, 4, 4)] * 3 + [("P3-3", 0, 0, 0, 0, 0, 0)] * 2 + [("P4-1", 1, 1, 2, 1, 2, 2)]
    links = sorted((r.key, r.type, r.linked) for r in QUERIES["issue_links"](spark, at).collect() if r.key == "P4-1")
    assert links == [("P4-1", "blocks", "PART-7"), ("P4-1", "relates to", "PART-8")]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 4 and plan.count("Relation [o_orderkey") == 2
