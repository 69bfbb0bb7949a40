"""No task of near-dedup or redaction holds more than one Python worker."""

from __future__ import annotations

import re

import pyarrow as pa

from pagemill.llm import minhash, personal
from pagemill.llm.common import materialise

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def python_steps(df) -> int:
    return len(re.findall(r"MapIn|EvalPython", plan(df)))


def test_near_dedup_runs_one_python_step_at_a_time(spark, monkeypatch):
    steps = {}

    def written(df, name):
        steps[name] = max(steps.get(name, 0), python_steps(df))
        return materialise(df, name)

    monkeypatch.setattr(minhash, "materialise", written)
    rows = [(1, WORDS * 3), (2, WORDS * 3), (2, WORDS * 3), (3, WORDS * 3 + " more"), (None, "a text"), (4, None)]
    kept = minhash.keep_first(materialise(spark.createDataFrame(rows, "doc_id long, text string"), "docs"))
    assert steps["signed"] == steps["links"] == 1 and max(steps.values()) == 1
    # Two branches, each with the keys of its rows.
    assert python_steps(kept) == 2
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a text"), (1, WORDS * 3), (4, None)]


def test_accepted_instances_begin_without_python(spark):
    edges = spark.range(3).selectExpr("'phone' AS kind", "'call' AS pat", "cast(id AS string) AS inst", "false AS seed")
    accepted = personal.bootstrap(edges)
    assert "RDD" not in plan(accepted) and accepted.dtypes == [("kind", "string"), ("inst", "string")]
    assert accepted.collect() == []


def test_rows_of_batches_keep_their_order(monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_ROWS", 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(6), None], "text": ["a", None, "b", "", "c", "d", "e"]})
    assert list(minhash._rows(batch)) == list(zip(*batch.to_pydict().values(), strict=True))
    assert list(minhash._rows(batch.slice(0, 0))) == []
