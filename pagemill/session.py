"""Session construction and cluster-level helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Defaults for a session.  Submit-time settings win: only keys the submitted
# configuration leaves unset are filled in.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HTML pages can be large: keep Arrow batches to a bounded size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Only for local runs (tests, bench): no web UI, smaller scan splits.
LOCAL_ONLY_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_session(master: str | None = None, app: str = "pagemill", **conf) -> SparkSession:
    """Build (or reuse) a session with UTC time and AQE on.

    ``LOCAL_DEFAULTS`` only fill keys that the submitted configuration
    (``spark-submit`` / cluster defaults) does not set; ``conf`` always applies.
    """
    from pyspark import SparkConf

    submitted = SparkConf()
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    local = (master or submitted.get("spark.master", "")).startswith("local")
    defaults = {**LOCAL_DEFAULTS, **(LOCAL_ONLY_DEFAULTS if local else {})}
    for k, v in defaults.items():
        if not submitted.contains(k):
            b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (set by the cluster); only where that
    is unset, as in tests, it is a folder of the warehouse, never a machine-local one.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written intermediate tables)."""
    return os.path.join(checkpoint_dir(spark), *parts)


def written(df, name: str):
    """``df`` written once under the shared folder and read back: later reads see one fixed set
    of rows, and a lost executor costs no earlier stage."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Session setting: how many partitions text is dealt over before it is parsed.
PARSE_PARTITIONS = "spark.pagemill.parsePartitions"


def spread_for_parse(df):
    """Deal rows evenly over the partitions that the session asks for, if it does.

    Unset, a scan keeps its natural splits.  Set it where the input comes in fewer
    splits than there are cores (a benchmark's single file); sizes are never looked at.
    """
    n = df.sparkSession.conf.get(PARSE_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def deal_by(df, key: str):
    """Rows dealt by ``key`` over all shuffle partitions: for rows that are small but stand for
    much work (paths to list or read), which AQE would otherwise gather in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
