"""Corpus summary (G1), per-page quality scores (G2) and the corpus quality
report (G3).  Per-page scores are one projection; corpus figures are global
aggregates (map-side partials, one tiny final merge)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X

# Literal formatting marks looked for in the content, the
# required processed-page fields and metadata fields, and the score names.
FORMAT_MARKS = ("<h1>", "<h2>", "<p>", "<table>", "<code>")
REQUIRED_CONTENT = ("content", "metadata", "tables", "code_blocks", "comments")
REQUIRED_METADATA = ("id", "title", "url", "version", "last_modified")
SCORES = ("readability", "content_completeness", "metadata_completeness", "formatting_quality")


def _present(df: DataFrame, name: str) -> Column:
    """Truthiness of a processed-page field, from the array or its ``n_`` count."""
    if name == "content":
        return X.truthy(F.col("content"))
    if name == "metadata":
        if "metadata" not in df.columns:
            return F.lit(False)
        return F.col("metadata").isNotNull()
    count_col = f"n_{name}"
    if count_col in df.columns:
        return F.coalesce(F.col(count_col), F.lit(0)) > 0
    if name in df.columns:
        return X.truthy(F.col(name), "array")
    return F.lit(False)


def _share(flags) -> Column:
    n = sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    return (n / F.lit(len(flags))) * F.lit(100)


def page_scores(df: DataFrame, key: str = "id", content_col: str = "content") -> DataFrame:
    """Per-page scores.

    ``df`` is a processed page: ``content``, ``metadata`` struct and either the
    ``tables`` / ``code_blocks`` / ``comments`` arrays or ``n_*`` counts.
    ``content_col`` lets formatting be measured on raw HTML instead of the
    cleaned text (on cleaned text it is always 0).
    """
    text = F.coalesce(F.col(content_col), F.lit(""))
    have = set()
    if "metadata" in df.columns:
        have = {f.name for f in df.schema["metadata"].dataType.fields}
    meta = [X.truthy(F.col(f"metadata.{f}"), "version" if f == "version" else "string") if f in have
            else F.lit(False) for f in REQUIRED_METADATA]
    return df.select(
        F.col(key).alias("id"),
        X.word_count(text).alias("n_words"),
        X.sentence_count(text).alias("n_sentences"),
        X.readability(text).alias("readability"),
        _share([_present(df, f) for f in REQUIRED_CONTENT]).alias("content_completeness"),
        _share([F.coalesce(m, F.lit(False)) for m in meta]).alias("metadata_completeness"),
        _share([text.contains(m) for m in FORMAT_MARKS]).alias("formatting_quality"),
    )


def quality_state(scores: DataFrame, *by: str) -> DataFrame:
    """G3, partial: count, sum, min and max of each score, one row (or one per ``by``).

    States of parts of a corpus are merged by ``merge_states``, in any order and grouping."""
    aggs = [F.count(F.lit(1)).alias("n_pages")]
    for s in SCORES:
        aggs += [F.count(s).alias(f"n_{s}"), F.sum(s).alias(f"sum_{s}"), F.min(s).alias(f"min_{s}"), F.max(s).alias(f"max_{s}")]
    return scores.groupBy(*by).agg(*aggs)


def corpus_quality(scores: DataFrame, digits: int | None = 6) -> DataFrame:
    """Mean, min and max of each score and ``quality_score`` (mean of the
    four means).  Empty input gives zeros.  ``digits`` rounds the means."""
    return finish_quality(quality_state(scores), digits)


def finish_quality(state: DataFrame, digits: int | None = 6) -> DataFrame:
    """The figures of ``corpus_quality`` from one (merged) state."""
    def r(c):
        return F.round(c, digits) if digits is not None else c

    def mean(s):
        return F.coalesce(F.col(f"sum_{s}") / F.nullif(F.col(f"n_{s}"), F.lit(0)), F.lit(0.0))
    cols = []
    for s in SCORES:
        cols += [r(mean(s)).alias(f"avg_{s}"),
                 F.coalesce(f"min_{s}", F.lit(0.0)).cast("double").alias(f"min_{s}"),
                 F.coalesce(f"max_{s}", F.lit(0.0)).cast("double").alias(f"max_{s}")]
    q = sum((mean(s) for s in SCORES), F.lit(0.0)) / F.lit(4.0)
    return state.select(*cols, r(q).alias("quality_score"))


TOTALS = ("words", "tables", "code_blocks", "comments")


def summary_state(pages: DataFrame, *by: str, strict: bool = False) -> DataFrame:
    """G1, partial: counts, sums and the oldest and newest page, one row (or one per ``by``).

    States of parts of a corpus are merged by ``merge_states``, in any order and grouping."""
    def n(name):
        c = f"n_{name}"
        if c in pages.columns:
            return F.coalesce(F.col(c), F.lit(0))
        if name in pages.columns:
            return F.coalesce(F.size(name), F.lit(0))
        return F.lit(0)

    lm = F.col("metadata.last_modified")
    ts = X.iso_timestamp(lm, strict)
    meta_fields = {f.name for f in pages.schema["metadata"].dataType.fields}
    page_id = F.col("metadata.id") if "id" in meta_fields else F.lit(None).cast("string")
    dated = X.truthy(lm) & ts.isNotNull()
    micros = F.unix_micros(ts)
    return pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum(X.word_count("content")).cast("long").alias("sum_words"),
        *[F.sum(n(t)).cast("long").alias(f"sum_{t}") for t in TOTALS[1:]],
        # Of several pages of one time the one of the smallest id, hence the newest as a minimum.
        F.min(F.when(dated, F.struct(micros.alias("t"), page_id.alias("id")))).alias("min_time"),
        F.min(F.when(dated, F.struct((-micros).alias("t"), page_id.alias("id")))).alias("min_before"))


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """One state of many: columns ``n_*`` and ``sum_*`` are added, ``min_*`` and ``max_*`` are compared."""
    how = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    names = [c for c in states.columns if c not in by and c.partition("_")[0] in how]
    merged = states.groupBy(*by).agg(*[how[c.partition("_")[0]](c).alias(c) for c in names])
    return merged.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names if c.startswith("n_")})


def write_state(state: DataFrame, path: str, batch: int) -> None:
    """Keep the state of a batch under ``path``; the same batch again replaces it."""
    state.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The kept states of all batches."""
    return spark.read.parquet(path).drop("batch")


def corpus_summary(pages: DataFrame, strict: bool = False) -> DataFrame:
    """G1: one row of corpus figures over processed pages.

    Totals of words (of ``content``), tables, code blocks and comments, the
    averages per page (unrounded; the report formatter rounds), and the
    oldest / newest non-empty ``metadata.last_modified`` and the ids of those
    pages (L4; of several pages the one of the smallest id).  With ``strict`` an
    unparsable date fails the query like the source tool; by default it is
    skipped.  On empty input every figure but ``total_pages`` is null.
    """
    return finish_summary(summary_state(pages, strict=strict))


def finish_summary(state: DataFrame) -> DataFrame:
    """The figures of ``corpus_summary`` from one (merged) state."""
    n = F.col("n_pages")
    return state.select(
        n.alias("total_pages"),
        *[F.col(f"sum_{t}").alias(f"total_{t}") for t in TOTALS],
        *[F.when(n > 0, F.col(f"sum_{t}") / n).alias(f"{t}_per_page") for t in TOTALS],
        X.iso_format(F.timestamp_micros("min_time.t")).alias("oldest_page"),
        X.iso_format(F.timestamp_micros(-F.col("min_before.t"))).alias("newest_page"),
        F.col("min_time.id").alias("oldest_page_id"), F.col("min_before.id").alias("newest_page_id"),
    )


def report(row: dict | None, kind: str = "summary") -> dict:
    """Shape a one-row result as the nested report dict (driver side, one row).

    Rounds averages to 2 places with Python ``round`` and drops figures that
    are null on empty input, as the source tool's report does.
    """
    from datetime import datetime, timezone
    now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
    if kind == "summary":
        if not row or not row.get("total_pages"):
            return {"total_pages": 0, "generated_at": now}
        return {
            "total_pages": row["total_pages"], "total_words": row["total_words"],
            "total_tables": row["total_tables"], "total_code_blocks": row["total_code_blocks"],
            "total_comments": row["total_comments"],
            "averages": {k: round(row[k], 2) for k in
                         ("words_per_page", "tables_per_page", "code_blocks_per_page", "comments_per_page")},
            "date_range": {"oldest_page": row["oldest_page"], "newest_page": row["newest_page"]},
            "generated_at": now,
        }
    return {
        "averages": {s: row[f"avg_{s}"] for s in SCORES},
        "ranges": {s: (row[f"min_{s}"], row[f"max_{s}"]) for s in SCORES},
        "quality_score": row["quality_score"],
    }
