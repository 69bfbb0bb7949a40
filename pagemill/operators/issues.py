"""Tracker issues: scans (A7-A10), processing (P11), joins (J-2, J-3),
limits (L1, L2), project summary (G8) and sprint metrics (G9).

The source tool calls a tracker module that it does not ship; only call
sites and an output shape survive.  The semantics here are therefore ours,
built from the same operators as the page side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions.text import iso_format
from pagemill.functions.udf import clean_text
from pagemill.operators.median import exact_medians
from pagemill.operators.pages import nest
from pagemill.sources import landed as A

DONE_STATUS = "Done"
MICROS_PER_DAY = 86_400 * 1_000_000
COMMENT_ARRAY = "array<struct<id:string,author:string,created:string,content:string>>"
ATTACHMENT_ARRAY = "array<struct<id:string,filename:string,size:bigint,media_type:string>>"
CHANGE_ARRAY = "array<struct<author:string,created:string,field:string,from:string,to:string>>"
LINK_ARRAY = "array<struct<type:string,key:string>>"
SUMMARY_DIMENSIONS = ("type", "status", "priority", "assignee")


def read_issues(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A7 / A8 source: landed issues with the fixed columns (``ISSUE``), and from JSON lines the
    whole record as the VARIANT column ``record``.

    The fixed columns are what the operators use; a field that no column names, at any
    depth, is still in the record.  A fixed column of another type is null, and a line that
    is no JSON has null columns, so no project has it; ``broken_issues`` lists both.
    """
    if fmt != "json":
        return spark.read.schema(schemas.ISSUE).format(fmt).load(path)
    return A.typed(A.read_records(spark, path), schemas.ISSUE)


def broken_issues(issues: DataFrame) -> DataFrame:
    """P10 for ``read_issues``: lines that can't be read (error_type, raw, source_file)."""
    kind = F.when(F.col("problem") == "json", A.NOT_JSON).otherwise(A.WRONG_TYPE)
    return issues.filter(F.col("problem").isNotNull()).select(kind.alias("error_type"), "raw", "source_file")


def raw_rows(issues: DataFrame) -> DataFrame:
    """K2 / K6: issues for the raw sinks, the fixed columns and the record as it came."""
    extra = ["record"] if "record" in issues.columns else []
    return issues.select(*schemas.ISSUE.names, *extra)


def project_issues(issues: DataFrame, project_key: str, max_results: int | None = None,
                   jql: str | None = None) -> DataFrame:
    """A7 (+ F4): a project's issues; with ``max_results`` (L1) the first so many
    by number, else all of them.

    ``jql`` accepts the one condition form the source tool builds,
    ``sprint = "<name>"``, as an equality filter.
    """
    out = issues.filter(F.col("project") == project_key)
    if jql:
        field, _, value = jql.partition("=")
        out = out.filter(F.col(field.strip()) == value.strip().strip('"'))
    if max_results is not None:
        number = F.regexp_extract("key", "([0-9]+)$", 1).try_cast("long")
        out = out.orderBy("project", number, "key").limit(int(max_results))
    return out


def single_issue(issues: DataFrame, keys) -> DataFrame:
    """Lookup by key (one key or a small list of keys)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return issues.filter(F.col("key").isin(*keys))


def sprints(issues: DataFrame) -> DataFrame:
    """A10 source: the sprint table derived from issues (``SPRINT``).
    ``id = yyyymm * 100 + project number``."""
    g = issues.groupBy("project", "sprint").agg(F.min("created").alias("start"), F.max("updated").alias("end"))
    ident = (F.regexp_replace(F.substring("sprint", 8, 7), "-", "").cast("long") * 100
             + F.substring("project", 2, 10).cast("long"))
    return g.select(ident.alias("id"), F.col("sprint").alias("name"), "project", "start", "end")


def project_sprints(sprint_table: DataFrame, project_key: str) -> DataFrame:
    """A10: sprints of one project."""
    return sprint_table.filter(F.col("project") == project_key)


def first_sprint(sprint_table: DataFrame, name: str) -> DataFrame:
    """L2: the first sprint (lowest id) with this name, as a one-row frame."""
    return sprint_table.filter(F.col("name") == name).orderBy("id").limit(1)


def sprint_issues(issues: DataFrame, sprint_table: DataFrame, project_key: str, sprint_name: str) -> DataFrame:
    """J-3: sprint name -> first matching sprint of the project -> its issues.

    The sprint side is one row (``limit 1``), so broadcasting it is bounded.
    """
    sp = first_sprint(project_sprints(sprint_table, project_key), sprint_name)
    sp = sp.select(F.col("project").alias("_p"), F.col("name").alias("_n"), F.col("id").alias("sprint_id"))
    return (issues.join(F.broadcast(sp), (issues.project == sp._p) & (issues.sprint == sp._n), "inner")
            .drop("_p", "_n"))


def process_issues(issues: DataFrame, comments: DataFrame | None = None, attachments: DataFrame | None = None,
                   changelog: DataFrame | None = None, links: DataFrame | None = None,
                   child_key: str = "key", times: str | None = None) -> DataFrame:
    """``key``, ``content``, a ``metadata`` struct (key, title, type, status,
    priority, assignee, created, updated) and the arrays ``comments``,
    ``attachments``, ``changelog`` and ``linked_issues``.

    ``content`` is the cleaned description followed by the cleaned comments, one per
    paragraph.  Child rows are long form, keyed by ``page_id`` (the issue's key) and
    ordered by ``pos``: cleaned comments (P7), attachments (P8), ``changelog`` (author,
    created, field, from, to) and ``links`` (type, key).  The arrays are the output
    format of one issue; the long-form tables stand beside them for issues with very
    many children.
    """
    meta = F.struct(
        F.col("key"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("priority", F.lit("")).alias("priority"), F.col("assignee"),
        iso_format("created").alias("created"), iso_format("updated").alias("updated"),
    )
    # Children join before the parse, so the cleaned text never moves.
    out = issues
    for name, rows, kind in (("comments", comments, COMMENT_ARRAY), ("attachments", attachments, ATTACHMENT_ARRAY),
                             ("changelog", changelog, CHANGE_ARRAY), ("linked_issues", links, LINK_ARRAY)):
        out = out.withColumn(name, F.array().cast(kind)) if rows is None else nest(out, rows, name, child_key)
        if rows is not None and times is not None:
            repeated = F.flatten(F.transform(name, lambda x: F.array_repeat(x, F.col(times).cast("int"))))
            out = out.withColumn(name, F.when(F.col(times) > 1, repeated).otherwise(F.col(name)))
    described = clean_text(F.coalesce("description", F.lit("")))
    said = F.transform("comments", lambda c: c["content"])
    content = F.array_join(F.filter(F.concat(F.array(F.col("_described")), said), lambda x: x != ""), "\n\n")
    return (out.withColumn("_described", described)
            .select("key", content.alias("content"), meta.alias("metadata"), "comments", "attachments", "changelog", "linked_issues"))


def project_summary(issues: DataFrame, by_project: bool = True) -> DataFrame:
    """Issue counts per dimension value plus the total, as
    ``[project,] dimension, value, n`` rows (one grouping-sets aggregate)."""
    keys = ["project"] if by_project else []
    sets = [[*keys, d] for d in SUMMARY_DIMENSIONS] + [keys]
    g = issues.groupingSets(sets, *keys, *SUMMARY_DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in SUMMARY_DIMENSIONS])
    dim = F.when(F.col("_g_type") == 0, "type").when(F.col("_g_status") == 0, "status") \
           .when(F.col("_g_priority") == 0, "priority").when(F.col("_g_assignee") == 0, "assignee") \
           .otherwise("total")
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.coalesce(F.col(d), F.lit("(none)")))
                         for d in SUMMARY_DIMENSIONS])
    return g.select(*keys, dim.alias("dimension"), value.alias("value"), "n")


def sprint_metrics(issues: DataFrame) -> DataFrame:
    """G9 per (project, sprint): issues, done, done rate, mean and median days from created to
    updated, comments per issue.

    Ages are real durations, to the microsecond, in days.  The median is exact and comes
    from ``exact_medians``, which gathers no group; issues without one of the times have no
    age.  ``n_comments`` per issue is used when present (from J-2's child summary).
    """
    df = issues
    n_comments = F.coalesce(F.col("n_comments"), F.lit(0)) if "n_comments" in df.columns else F.lit(0)
    age = F.unix_micros(F.col("updated").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))
    g = df.groupBy("project", "sprint").agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.count_if(F.col("status") == DONE_STATUS).alias("n_done"),
        F.avg(age / MICROS_PER_DAY).alias("mean_days"),
        F.sum(n_comments).cast("long").alias("n_comments"),
    )
    medians = exact_medians(df, ["project", "sprint"], age).select(
        F.col("project").alias("_p"), F.col("sprint").alias("_s"), (F.col("median") / MICROS_PER_DAY).alias("median_days"))
    g = g.join(medians, g["project"].eqNullSafe(medians["_p"]) & g["sprint"].eqNullSafe(medians["_s"]), "left")
    return g.select("project", "sprint", "n_issues", "n_done",
                    (F.col("n_done") / F.col("n_issues")).alias("done_rate"),
                    F.round("mean_days", 6).alias("mean_days"), "median_days",
                    (F.col("n_comments") / F.col("n_issues")).alias("comments_per_issue"))
