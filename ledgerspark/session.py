"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on, for sessions whose user has not set them.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins that put a hot key on one side may be followed by an aggregation on the same key; allow the
    # split there too and pay the extra exchange only when a partition is really skewed.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_scratch_roots: dict[str, str] = {}


def build_session(app: str = "ledgerspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", **RUNTIME_SETTINGS, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the runtime settings the plans rely on, where its user has not set them."""
    for key, value in RUNTIME_SETTINGS.items():
        if not spark.sparkContext.getConf().contains(key) and not spark.conf.get(key, None) == value:
            spark.conf.set(key, value)
    # Dates in text are written and read in one time zone, which the results depend on.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, named by ``spark.checkpoint.dir``.

    Only a single-process session without that setting (tests, a laptop) gets a private folder, which goes with it. On a cluster
    a missing setting is an error: a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/") + "/ledgerspark"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    key = context.applicationId
    if key not in _scratch_roots:
        _scratch_roots[key] = tempfile.mkdtemp(prefix="ledgerspark-")
        atexit.register(shutil.rmtree, _scratch_roots[key], ignore_errors=True)
    return _scratch_roots[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Used where two branches of one plan must see the very same rows, and where a result feeds many jobs. The
    table outlives lost executors, so nothing upstream is recomputed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
