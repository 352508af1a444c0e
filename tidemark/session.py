"""Session helpers: sensible defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: dict[str, str] = {}


def build_session(app: str = "tidemark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow on. On a cluster leave ``master`` unset."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, else the
    context's own checkpoint folder.

    Only a local session may go without one: it gets a folder of our own, made
    once per application. On a cluster such a folder would be another one on each
    machine, so an absent setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that every machine of {master or 'the cluster'} shares")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _OWN_SCRATCH[app]


def _context_dir(spark: SparkSession) -> str | None:
    try:
        return spark.sparkContext.getCheckpointDir()
    except PySparkException:  # a Connect session has no context
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; never reuses an older run's data."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Cuts the lineage so that several later passes do not repeat the shuffles
    before it, survives the loss of executors, and keeps column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PIN_ROWS = 10_000


def pin(df: DataFrame, name: str = "result", max_rows: int = PIN_ROWS) -> DataFrame:
    """Compute a result once for its later readers: a result of at most
    ``max_rows`` rows becomes a local table, a larger one goes to the shared
    folder. The driver never holds more than ``max_rows + 1`` rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return materialize(df, name)
    return df.sparkSession.createDataFrame(rows, df.schema)
