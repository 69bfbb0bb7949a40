"""Sinks and the output-tree inventory: write / read round trips."""

import json
import os

from pyspark.sql import functions as F

from pagemill import schemas, sinks
from pagemill.operators import batch as B
from pagemill.plans import jobs
from pagemill.sources import landed as A
from pagemill.sources import testdata as D
from tests.conftest import SF_SMALL


def test_csv_round_trip_keeps_quotes_and_newlines(spark, tmp_out):
    pages = D.wiki_pages(spark, SF_SMALL).select("id", "title", "content", "url", "version", "last_modified")
    docs = D.table(spark, SF_SMALL, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"),
        F.lit("u").alias("url"), F.lit("1").alias("version"), F.lit("").alias("last_modified"))
    both = pages.unionByName(docs)
    sinks.write_csv(both, os.path.join(tmp_out, "raw.csv"))
    back = sinks.read_csv(spark, os.path.join(tmp_out, "raw.csv"), schemas.PAGE)
    norm = F.coalesce(F.col("last_modified"), F.lit(""))
    a = both.withColumn("last_modified", norm)
    b = back.withColumn("last_modified", norm)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_jsonl_keeps_null_fields(spark, tmp_out):
    df = spark.createDataFrame([("1", None)], "id string, assignee string")
    path = os.path.join(tmp_out, "j")
    sinks.write_jsonl(df, path)
    line = spark.read.text(path).first().value
    assert json.loads(line) == {"id": "1", "assignee": None}


def test_raw_page_json_read_and_flatten(spark, tmp_out):
    path = os.path.join(tmp_out, "raw")
    D.wiki_pages_raw(spark, SF_SMALL).write.json(path)
    raw = A.read_raw_pages(spark, path)
    flat = A.space_pages(raw, "en", "http://test")
    r = flat.first()
    assert r.url == f"http://test/wiki/spaces/en/pages/{r.id}" and r.space_key == "en"
    one = A.single_page(raw, "3", "http://test").first()
    assert one.url == "http://test/wiki/pages/3" and one.version == "3"


def test_api_shaped_children(spark):
    atts = spark.createDataFrame(
        [("9", [("a1", "f.txt", ("text/plain",), (12,)), ("a2", "g.bin", None, None)])], schemas.RAW_ATTACHMENTS)
    rows = A.attachments(atts, "http://x").orderBy("pos").collect()
    assert [(r.filename, r.mediaType, r.size) for r in rows] == [("f.txt", "text/plain", 12), ("g.bin", "", 0)]
    assert rows[0].url == "http://x/wiki/download/attachments/9/f.txt"
    cm = spark.createDataFrame([("9", [("c1", ("Ann",), "2024-01-01", (("<p>x</p>",),))])], schemas.RAW_COMMENTS)
    c = A.comments(cm).first()
    assert (c.author, c.content, c.pos) == ("Ann", "<p>x</p>", 0)


def _tree(root):
    files = {"page_1_raw.json": b"x" * 10, "sub/page_2_processed.JSON": b"y" * 1024, "_error.txt": b"boom",
             "sub/.hid.json": b"h", "trail.": b"", "noext": b"n" * 1023, "a.B.TXT": b"q" * 1152,
             "sub/deep/p_error.log": b"bad thing"}
    for name, data in files.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
    return files


def test_list_files_includes_hidden_names_and_inventory(spark, tmp_out):
    files = _tree(tmp_out)
    entries = A.list_files(spark, tmp_out)
    assert sorted(r.name for r in entries.collect()) == sorted(os.path.basename(n) for n in files)
    inv = B.inventory(entries).first()
    assert inv.total_files == 8 and inv.failed_files == 2 and inv.successful_files == 6
    assert inv.total_size == sum(len(v) for v in files.values())
    types = {r.ext: r.n for r in B.file_types(entries).collect()}
    assert types == {".json": 3, ".txt": 2, "": 2, ".log": 1}
    summary = jobs.batch_summary(spark, tmp_out)
    errs = sorted(r.error for r in summary["processing_errors"].collect())
    assert errs == ["bad thing", "boom"]
    from tests.test_functions import exact_size
    assert summary["total_size_readable"] == exact_size(inv.total_size) and "generated_at" in summary


def test_deep_and_wide_trees_are_listed_by_many_tasks(spark, tmp_out):
    deep = os.path.join(tmp_out, "deep", *["d"] * 70)
    os.makedirs(deep)
    for path in [os.path.join(deep, "x_error.txt"), os.path.join(tmp_out, "top.txt")]:
        with open(path, "w") as f:
            f.write("e")
    for i in range(36):
        os.makedirs(os.path.join(tmp_out, f"wide{i}"))
        for k in range(3):
            with open(os.path.join(tmp_out, f"wide{i}", f"{k}_error.txt"), "w") as f:
                f.write("e")
    entries = A.list_files(spark, tmp_out)
    assert entries.count() == 2 + 108
    full = entries.withColumn("p", F.spark_partition_id()).filter(F.col("path").contains("wide")).select("p").distinct().count()
    assert full > 2
    errors = B.error_contents(spark, entries)
    assert errors.count() == 109
    assert errors.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_missing_tree_gives_zero_summary(spark, tmp_out):
    s = jobs.batch_summary(spark, os.path.join(tmp_out, "nope"))
    assert s["total_files"] == 0 and "total_size_readable" not in s and "generated_at" not in s


def test_render_then_reparse_tables_round_trip(spark):
    from pagemill.operators import pages as P
    from pagemill.operators import render as RH
    html = ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x</td></tr><tr><td>2</td></tr></table>"
            "<table><thead><tr><th>k</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>")
    src = spark.createDataFrame([("p1", html)], "id string, content string")
    first = P.process_pages(src, parts=("tables",))
    rendered = RH.render_html(first).select("id", F.col("html").alias("content"))
    second = P.process_pages(rendered, parts=("tables",))
    t1 = [(t.headers, t.data) for t in first.first().tables]
    t2 = [(t.headers, t.data) for t in second.first().tables]
    assert t1 == t2 == [(["a", "b"], [["1", "x"], ["2", None]]), (["k"], [["v"]])]


def test_rendered_pages_sink_round_trip(spark, tmp_out):
    from pagemill.operators import pages as P
    from pagemill.operators import render as RH
    src = spark.createDataFrame([("a", "<p>x</p><pre><code>y</code></pre>"), ("b", "<p>z</p>")],
                                "id string, content string")
    rendered = RH.render_html(P.process_pages(src))
    sinks.write_rendered(rendered, os.path.join(tmp_out, "pq"))
    sinks.write_rendered(rendered, os.path.join(tmp_out, "txt"), fmt="text")
    back = spark.read.parquet(os.path.join(tmp_out, "pq"))
    assert back.exceptAll(rendered.select("id", "html")).count() == 0 and back.count() == 2
    lines = [json.loads(r.value) for r in spark.read.text(os.path.join(tmp_out, "txt")).collect()]
    assert sorted(x["id"] for x in lines) == ["a", "b"] and all(x["html"].startswith("<!DOCTYPE html>") for x in lines)


def test_csv_sink_writes_nested_columns_as_json(spark, tmp_out):
    df = spark.createDataFrame([("k1", ["a", "b"], ("x", 1))],
                               "key string, tags array<string>, meta struct<s:string,n:int>")
    path = os.path.join(tmp_out, "nested.csv")
    sinks.write_csv(df, path)
    back = spark.read.options(**sinks.CSV_READ_OPTIONS).csv(path).first()
    assert back.key == "k1" and json.loads(back.tags) == ["a", "b"] and json.loads(back.meta) == {"s": "x", "n": 1}


def test_a_wide_folder_is_listed_in_parts(tmp_out, monkeypatch):
    import pandas as pd
    for i in range(25):
        with open(os.path.join(tmp_out, f"_{i}.txt"), "w") as f:
            f.write("x" * i)
    os.makedirs(os.path.join(tmp_out, "sub"))
    monkeypatch.setattr(A, "LISTING_ROWS", 7)
    parts = list(A._list_children([pd.DataFrame({"dir": [tmp_out, os.path.join(tmp_out, "sub")]})]))
    assert [len(p) for p in parts] == [7, 7, 7, 5]
    rows = pd.concat(parts)
    assert rows["is_dir"].sum() == 1 and rows.loc[~rows["is_dir"], "length"].sum() == sum(range(25))
    assert set(rows["path"]) == {"file:" + os.path.join(tmp_out, n) for n in [*(f"_{i}.txt" for i in range(25)), "sub"]}


def test_inventory_of_more_bytes_than_a_long_holds(spark):
    from tests.test_functions import exact_size
    sizes = [2**63 - 1, 2**63 - 1, 5, None]
    row = B.inventory(spark.createDataFrame([(f"{i}", n) for i, n in enumerate(sizes)], "name string, length long")).first()
    assert row.total_files == 4 and row.total_size is None
    assert row.total_size_readable == exact_size(2**64 + 3)
