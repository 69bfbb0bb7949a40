"""Exact medians by selection, and figures merged from partial states."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from pagemill.operators import issues as I
from pagemill.operators import quality as Q
from pagemill.operators.median import exact_medians

ROWS = ([("hot", (i * 7919) % 10_007 - 5000) for i in range(20_001)] + [("hot", 3)] * 5000 + [("two", 10), ("two", -11)] + [("one", 5)]
        + [("wide", -(2**52)), ("wide", 2**52), ("wide", 7), ("wide", 8)] + [(None, 1), (None, 4), (None, None)] + [("none", None)])


@pytest.mark.parametrize(("steps", "sorted_values"), [(1024, 1_000_000), (1024, 10), (16, 3)])
def test_medians_equal_sorting(spark, steps, sorted_values):
    df = spark.createDataFrame(ROWS, "g string, x long").repartition(5)
    got = {r.g: r.median for r in exact_medians(df, ["g"], "x", steps, sorted_values).collect()}
    groups = {}
    for g, x in ROWS:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert got == {g: float(statistics.median(xs)) for g, xs in groups.items()}
    assert exact_medians(df.limit(0), ["g"], "x").collect() == []


def test_sprint_ages_are_real_durations(spark):
    rows = [("P1", "S", "Done", "2024-01-01 00:00:00", "2024-01-01 06:00:00"), ("P1", "S", "Open", "2024-01-01 00:00:00", "2024-01-02 00:00:00.5"),
            ("P1", None, "Open", "2024-01-01 00:00:00", None), ("P1", "S", "Open", None, None)]
    df = spark.createDataFrame(rows, "project string, sprint string, status string, c string, u string")
    df = df.select("project", "sprint", "status", F.to_timestamp("c").alias("created"), F.to_timestamp("u").alias("updated"))
    got = {r.sprint: r for r in I.sprint_metrics(df).collect()}
    assert got["S"].n_issues == 3 and got["S"].mean_days == pytest.approx(0.625003, abs=1e-6)
    assert got["S"].median_days == pytest.approx((0.25 + 1 + 0.5 / 86400) / 2, abs=1e-12)
    assert got[None].n_issues == 1 and got[None].median_days is None


def _pages(spark):
    rows = [(str(i), " ".join(["word"] * (i % 9)) + ".", f"2024-0{i % 8 + 1}-01T00:00:00" if i % 5 else "", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, content string, lm string, n_tables int")
    meta = F.struct("id", F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("1").alias("version"), F.col("lm").alias("last_modified"))
    return df.select("id", "content", meta.alias("metadata"), "n_tables")


def test_states_of_batches_merge_to_the_whole(spark, tmp_path):
    pages, path = _pages(spark), str(tmp_path)
    for batch in (0, 1, 2, 1):  # the second run of a batch replaces the first
        part = pages.where(F.pmod(F.col("id").cast("int"), F.lit(3)) == batch)
        Q.write_state(Q.summary_state(part), os.path.join(path, "summary"), batch)
        Q.write_state(Q.quality_state(Q.page_scores(part)), os.path.join(path, "quality"), batch)
    Q.write_state(Q.summary_state(pages.limit(0)), os.path.join(path, "summary"), 3)
    merged = Q.finish_summary(Q.merge_states(Q.read_states(spark, os.path.join(path, "summary"))))
    assert merged.collect() == Q.corpus_summary(pages).collect()
    merged = Q.finish_quality(Q.merge_states(Q.read_states(spark, os.path.join(path, "quality"))))
    assert merged.collect() == Q.corpus_quality(Q.page_scores(pages)).collect()
    empty = Q.corpus_summary(pages.limit(0)).first()
    assert empty.total_pages == 0 and empty.total_words is None and empty.oldest_page_id is None
    assert Q.corpus_quality(Q.page_scores(pages.limit(0))).first().quality_score == 0.0
