"""Scalar column functions against their plain-Python definitions."""

import re
from fractions import Fraction
from pathlib import PurePosixPath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as X

WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        　"
TEXT = st.text(alphabet=st.sampled_from(list("ab.!?,x") + list(WS)), max_size=40)


def exact_size(size):
    """The size text by exact arithmetic: the unit is the largest power of 1,024 not above the
    size (TB at most), its two decimals are rounded half to even."""
    power = next((k for k in range(4) if size < 1024 ** (k + 1)), 4)
    hundredths = round(Fraction(size * 100, 1024 ** power))
    return f"{hundredths // 100}.{hundredths % 100:02d} {('B', 'KB', 'MB', 'GB', 'TB')[power]}"


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_words_sentences_normalise_strip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", X.word_count("s").alias("w"), X.sentence_count("s").alias("n"),
                     X.normalize_ws("s").alias("j"), X.py_strip("s").alias("p")).collect()
    for r in rows:
        assert r.w == len(r.s.split())
        assert r.n == len(re.split(r"[.!?]+", r.s))
        assert r.j == " ".join(r.s.split())
        assert r.p == r.s.strip()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2 ** 52), st.integers(0, 2 ** 20), st.integers(1024 ** 4, 1024 ** 4 * 4096)),
                min_size=1, max_size=60))
def test_readable_size_equals_python(spark, sizes):
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    for r in df.select("s", X.readable_size("s").alias("t")).collect():
        assert r.t == exact_size(r.s), r.s


def test_readable_size_fixture_values_and_null(spark):
    vals = [0, 1023, 1024, 1152, 1024 ** 4, 1536, 1024 ** 2 * 5 + 1, None]
    df = spark.createDataFrame([(v,) for v in vals], "s long")
    got = {r.s: r.t for r in df.select("s", X.readable_size("s").alias("t")).collect()}
    assert got[None] == "0 B"
    for v in vals[:-1]:
        assert got[v] == exact_size(v)
    assert [got[v] for v in (0, 1023, 1024, 1152, 1536)] == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.50 KB"]


def test_path_suffix(spark):
    names = ["_error.txt", ".hid.json", "trail.", "noext", "a.B.TXT", ".bashrc", "a..b", "x.tar.gz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.e for r in df.select("n", X.path_suffix("n").alias("e")).collect()}
    for n in names:
        assert got[n] == PurePosixPath(n).suffix.lower(), n


def test_iso_parse_lenient_and_strict(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01T10:00:00Z",), ("2024-01-01T12:00:00+02:00",),
                                ("bad",), ("",)], "s string")
    got = [r.t for r in df.select(X.iso_format(X.iso_timestamp("s")).alias("t")).collect()]
    assert got == ["2024-01-01T00:00:00", "2024-01-01T10:00:00", "2024-01-01T10:00:00", None, None]


def test_truthiness(spark):
    df = spark.createDataFrame([("0", [], None), ("1", ["a"], "x"), ("", None, "")], "v string, a array<string>, s string")
    rows = df.select(X.truthy("v", "version").alias("v"), X.truthy("a", "array").alias("a"),
                     X.truthy("s").alias("s")).collect()
    assert [tuple(r) for r in rows] == [(False, False, False), (True, True, True), (False, False, False)]
